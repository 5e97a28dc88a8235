"""Governed access: tokens, scopes, transformations, consents, exports and the audit trail.

A governed read drops fields, rows and excess, in this order: tables, fields, time and positions,
transformations, row cap. Every attempt is audited, refused ones too. Tokens are small driver-side
state; everything about rows is a DataFrame plan.
"""

from __future__ import annotations

import hashlib
import json
import secrets
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.errors import ConsentNotFound, LedgerError, ScopeViolation, TokenExpired, TokenNotFound, TokenRevoked
from ledgerlake.functions import anonymize, keyed
from ledgerlake.operators.log import record_hash  # noqa: F401  (part of the public surface for proofs)
from ledgerlake.operators.ordered import dense_offsets, neighbour
from ledgerlake.plans.select import Catalog, Select

DEFAULT_ROWS, MOST_EXPORTED = 1_000, 10_000


@dataclass(frozen=True)
class Rule:
    """A transformation of the columns that the pattern names: *, *.suffix, prefix.* or a name."""

    pattern: str
    kind: str
    args: tuple = ()

    def matches(self, column: str) -> bool:
        if self.pattern == "*":
            return True
        if self.pattern.startswith("*."):
            return column.endswith(self.pattern[1:])
        if self.pattern.endswith(".*"):
            return column.startswith(self.pattern[:-2])
        return column == self.pattern

    def apply(self, c: Column) -> Column:
        made = {
            "redact": anonymize.redact,
            "mask": anonymize.mask,
            "partial_mask": anonymize.partial_mask,
            "pseudonymize": anonymize.pseudonym,
            "generalize": lambda x, width=10: anonymize.bucket(x, width),
            "hash": anonymize.hash_text,
            "encrypt": keyed.encrypt,
            "tokenize": keyed.token,
        }
        if self.kind == "encrypt" and not self.args:
            return keyed.encrypt(c, None)
        return made[self.kind](c, *self.args)


def transform(df: DataFrame, rules: list[Rule], policy: str = "chain") -> tuple[DataFrame, list[str]]:
    """df with the rules applied, and "kind:column" for each application. policy: all matching rules in
    order ("chain") or only the first ("first")."""
    done, columns = [], []
    for name in df.columns:
        c = F.col(f"`{name}`")
        found = [r for r in rules if r.matches(name)]
        for r in found if policy == "chain" else found[:1]:
            c = r.apply(c)
            done.append(f"{r.kind}:{name}")
        columns.append(c.alias(name))
    return df.select(*columns), done


@dataclass(frozen=True)
class Scope:
    """What a token may see; empty means all."""

    tables: frozenset[str] = frozenset()
    fields: frozenset[str] = frozenset()
    excluded: frozenset[str] = frozenset()
    streams: frozenset[str] = frozenset()
    time_range: tuple | None = None
    positions: tuple[int, int] | None = None
    max_rows: int | None = None
    rules: tuple[Rule, ...] = ()

    def check(self, table: str) -> None:
        if self.tables and table not in self.tables:
            raise ScopeViolation(f"table {table} is outside the scope")

    def shows(self, name: str) -> bool:
        return (not self.fields or name in self.fields) and name not in self.excluded

    def check_used(self, names: set[str]) -> None:
        """A hidden column can't be searched or sorted by either."""
        hidden = sorted(n for n in names if not self.shows(n))
        if hidden:
            raise ScopeViolation(f"{', '.join(hidden)} is outside the scope")

    def restrict(self, df: DataFrame, ts: str | None = None, pos: str | None = None, stream: str | None = None) -> DataFrame:
        if self.streams and stream:
            df = df.where(F.col(stream).isin(sorted(self.streams)))
        if self.time_range and ts:
            df = df.where(F.col(ts).between(*[F.lit(x) for x in self.time_range]))
        if self.positions and pos:
            df = df.where(F.col(pos).between(*self.positions))
        return df.select(*[c for c in df.columns if self.shows(c)])


def list_tables(catalog: Catalog, scope: Scope) -> list[tuple[str, list[str], bool]]:
    """(table, visible fields, are any transformed?) for the tables of a scope."""
    out = []
    for name in sorted(t for t in catalog.tables if not scope.tables or t in scope.tables):
        seen = scope.restrict(catalog.get(name).rows).columns
        out.append((name, seen, any(r.matches(c) for r in scope.rules for c in seen)))
    return out


@dataclass(frozen=True)
class Token:
    id: str
    tenant: str
    scope: Scope
    expires_at: datetime
    max_uses: int = 0
    uses: int = 0
    revoked: bool = False
    purpose: str = ""

    def check(self, now: datetime) -> None:
        if self.revoked:
            raise TokenRevoked(self.id)
        if now >= self.expires_at or (self.max_uses and self.uses >= self.max_uses):
            raise TokenExpired(self.id)


@dataclass
class TokenStore:
    tokens: dict[str, Token] = field(default_factory=dict)

    def issue(self, tenant: str, scope: Scope, now: datetime, ttl: timedelta, max_uses: int = 0, purpose: str = "", id: str | None = None) -> Token:
        made = Token(id or secrets.token_hex(16), tenant, scope, now + ttl, max_uses, purpose=purpose)
        self.tokens[made.id] = made
        return made

    def use(self, id: str, now: datetime) -> Token:
        if id not in self.tokens:
            raise TokenNotFound(id)
        self.tokens[id].check(now)
        self.tokens[id] = replace(self.tokens[id], uses=self.tokens[id].uses + 1)
        return self.tokens[id]

    def revoke(self, id: str) -> None:
        if id not in self.tokens:
            raise TokenNotFound(id)
        self.tokens[id] = replace(self.tokens[id], revoked=True)

    def revoke_purpose(self, prefix: str) -> int:
        found = [t.id for t in self.tokens.values() if t.purpose.startswith(prefix) and not t.revoked]
        for id in found:
            self.revoke(id)
        return len(found)

    def active(self, now: datetime) -> list[Token]:
        def ok(t: Token) -> bool:
            try:
                t.check(now)
            except LedgerError:
                return False
            return True

        return [t for t in self.tokens.values() if ok(t)]

    def cleanup(self, now: datetime) -> int:
        gone = [t.id for t in self.tokens.values() if now >= t.expires_at]
        for id in gone:
            del self.tokens[id]
        return len(gone)


def json_lines(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., line): each row as an object of texts, with columns in the order of the schema."""
    return df.select(*key, F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("line"))


def csv_lines(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., line): texts in quotes, doubled within; numbers bare; NULL empty."""
    cells = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if t == "string" else F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
    return df.select(*key, F.concat_ws(",", *cells).alias("line"))


def content_hash(lines: DataFrame, key: list[str]) -> DataFrame:
    """(n_rows, sha256): the hash of the ordered lines' hashes. The lines are hashed where they are; only
    the hashes of an export, MOST_EXPORTED at most, are put in order."""
    marks = lines.select(*key, F.sha2("line", 256).alias("h")).orderBy(*key).limit(MOST_EXPORTED)
    parts = marks.agg(F.array_sort(F.collect_list(F.struct(*key, "h"))).alias("rows"))
    return parts.select(F.size("rows").cast("long").alias("n_rows"), F.sha2(F.array_join(F.transform("rows", lambda r: r["h"]), ""), 256).alias("sha256"))


#: Columns of the audit trail, and records that are held until they are written.
AUDIT = "at timestamp, tool string, token string, tenant string, tables array<string>, success boolean, error string, transformations array<string>"
AUDIT_BATCH = 1_000
EXPORTS = "export_id string, at timestamp, token string, tenant string, table string, n_rows long, sha256 string"


@dataclass
class Governed:
    """A catalog behind tokens. now() is given, so that results do not hang on the wall clock.

    Each attempt is one audit record. With a folder, records are appended to tables there, AUDIT_BATCH at a
    time and on flush(); without one they stay in audit."""

    catalog: Catalog
    tokens: TokenStore
    now: object
    folder: str | None = None
    audit: list[dict] = field(default_factory=list)

    def _note(self, tool: str, token: Token | None, tables: list[str], error: str | None, **more) -> None:
        self.audit.append({"at": self.now(), "tool": tool, "token": token.id if token else None, "tenant": token.tenant if token else None, "tables": tables, "success": error is None, "error": error, **more})
        if self.folder and len(self.audit) >= AUDIT_BATCH:
            self.flush()

    def flush(self) -> None:
        """Append the held records to the audit table."""
        if self.folder and self.audit:
            spark = SparkSession.active()
            names = [c.split()[0] for c in AUDIT.split(", ")]
            spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.audit], AUDIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/audit")
            self.audit.clear()

    def query(self, id: str, select: Select, *params, ts: str | None = None, pos: str | None = None, stream: str | None = None) -> DataFrame:
        """The selected rows that the token's scope shows: its max_rows at most, or 1,000 if it has none."""
        return self._read("query", id, select, params, DEFAULT_ROWS, ts, pos, stream)[0]

    def page(self, id: str, select: Select, *params, **columns) -> tuple[DataFrame, DataFrame]:
        """(rows, state): as query, and one row with returned and truncated, whether there is more."""
        rows, more, most = self._read("query", id, select, params, DEFAULT_ROWS, **columns)
        return rows, capped(more, most)

    def _read(self, tool: str, id: str, select: Select, params: tuple, default: int, ts: str | None = None, pos: str | None = None, stream: str | None = None) -> tuple[DataFrame, DataFrame, int]:
        token = None
        try:
            token = self.tokens.use(id, self.now())
            token.scope.check(select.table)
            bound = select.bind(*params)
            token.scope.check_used(bound.used())
            wanted = bound.columns
            rows = replace(bound, columns=None, order=(), most=None).build(self.catalog)
            order = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, down in bound.order]
            rows = rows.orderBy(*order) if order else rows
            cap = default if token.scope.max_rows is None else token.scope.max_rows
            most = cap if bound.most is None else min(bound.most, cap)
            seen = token.scope.restrict(rows, ts, pos, stream)
            if wanted is not None:
                seen = seen.select(*[F.col(o).alias(n) for o, n in wanted if o in seen.columns])
            out, done = transform(seen.limit(most), list(token.scope.rules))
        except Exception as e:
            self._note(tool, token, [select.table], type(e).__name__)
            raise
        self._note(tool, token, [select.table], None, transformations=done)
        return out, seen, most

    def export(self, id: str, table: str, key: list[str], kind: str = "json", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(lines, proof) of a table's export: limit is 1,000 unless asked for, and 10,000 at most; the
        scope's max_rows may lower it."""
        most = min(DEFAULT_ROWS if limit is None else limit, MOST_EXPORTED)
        rows, _, _ = self._read("export", id, Select(table).order_by(*key).limit(most), (), MOST_EXPORTED)
        lines = (json_lines if kind == "json" else csv_lines)(rows, key)
        return lines, content_hash(lines, key)

    def register(self, export_id: str, id: str, table: str, proof: DataFrame) -> None:
        """Enter an export's proof in the registry."""
        token = self.tokens.tokens[id]
        names = [c.split()[0] for c in EXPORTS.split(", ")]
        row = proof.select(F.lit(export_id).alias("export_id"), F.lit(self.now()).cast("timestamp").alias("at"), F.lit(id).alias("token"), F.lit(token.tenant).alias("tenant"), F.lit(table).alias("table"), "n_rows", "sha256")
        row.select(*names).write.mode("append").parquet(f"{self.folder}/exports")


def capped(rows: DataFrame, most: int) -> DataFrame:
    """One row: returned (most at most) and truncated, whether there are more. Counts most + 1 rows at most."""
    n = rows.limit(most + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(most)).cast("long").alias("returned"), (F.col("n") > most).alias("truncated"))


def verify_exports(registry: DataFrame, claims: DataFrame) -> DataFrame:
    """claims(export_id, sha256) with verified and message: against the registry, not by their form alone."""
    known = registry.select("export_id", F.col("sha256").alias("_known"))
    form = F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    message = F.when(~form, "not a hash of 64 hex digits").when(F.col("_known").isNull(), "no such export").when(F.lower("sha256") != F.col("_known"), "another content").otherwise("verified")
    return claims.join(known, "export_id", "left").select("export_id", "sha256", (message == "verified").alias("verified"), message.alias("message"))


def system_views(log: DataFrame, exports: DataFrame, holds: DataFrame) -> None:
    """The views __events, __export_audit and __legal_holds. What the log doesn't have of an event's metadata
    is NULL."""
    names = {"position": "long", "timestamp": "timestamp", "tenant_id": "long", "stream": "string", "actor": "string", "caused_by": "string", "client_ip": "string", "operation": "string", "data": "string"}
    log.select(*[(F.col(n) if n in log.columns else F.lit(None)).cast(t).alias(n) for n, t in names.items()]).createOrReplaceTempView("__events")
    exports.createOrReplaceTempView("__export_audit")
    holds.createOrReplaceTempView("__legal_holds")


# What each role may do, and the years that audit events of a kind are kept.
ROLES = {
    "Owner": ("View data", "Query data", "Create streams", "Append events", "Delete streams", "Manage users", "Manage roles", "Manage billing", "Delete org"),
    "Admin": ("View data", "Query data", "Create streams", "Append events", "Delete streams", "Manage users"),
    "Member": ("View data", "Query data", "Create streams", "Append events"),
    "Viewer": ("View data", "Query data"),
}
AUDIT_YEARS = {"authentication": 2, "data access": 7, "administrative": 10}
AUDIT_KINDS = {
    "LoginSuccess": "authentication", "LoginFailure": "authentication", "Logout": "authentication", "SessionExpired": "authentication",
    "QueryExecuted": "data access", "DataExported": "data access", "StreamCreated": "data access", "StreamDeleted": "data access",
    "UserCreated": "administrative", "UserDeleted": "administrative", "ApiKeyCreated": "administrative", "ApiKeyRevoked": "administrative",
}


def permitted(requests: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """requests(id, role, permission, ...) with allowed: by the role, or by grants(principal, resource, permission)
    where requests have principal and resource."""
    table = F.create_map(*[F.lit(x) for role, may in ROLES.items() for x in (role, list(may))])
    by_role = F.coalesce(F.array_contains(table[F.col("role")], F.col("permission")), F.lit(False))
    if grants is None:
        return requests.withColumn("allowed", by_role)
    own = grants.select("principal", "resource", "permission", F.lit(True).alias("_granted")).distinct()
    return requests.join(own, ["principal", "resource", "permission"], "left").withColumn("allowed", by_role | F.coalesce("_granted", F.lit(False))).drop("_granted")


def audit_kept(audit: DataFrame, now, kind: str = "kind", at: str = "at", years: dict | None = None) -> DataFrame:
    """audit with keep_until and kept: by the years of its kind; kinds without a period are kept."""
    periods = F.create_map(*[F.lit(x) for pair in (years or AUDIT_YEARS).items() for x in pair])
    until = F.add_months(F.to_date(at), 12 * periods[F.col(kind)])
    return audit.withColumn("keep_until", until).withColumn("kept", F.coalesce(until > F.to_date(F.lit(now)), F.lit(True)))


def consent_history(events: DataFrame) -> DataFrame:
    """events(consent_id, at, action) -> each consent's actions in order, as (seq, at, action, until): until is
    when the next one came, NULL for the one that holds."""
    numbered = dense_offsets(events, "consent_id", "at", "seq")
    return neighbour(numbered, "consent_id", ("seq",), F.col("at"), "until", ahead=True).select("consent_id", "seq", "at", "action", "until")


def exports_per_consent(consents: DataFrame, exports: DataFrame) -> DataFrame:
    """consents(consent_id, ...) with the exports(consent_id, at) made under them: n_exports, last_export."""
    n = exports.groupBy("consent_id").agg(F.count(F.lit(1)).alias("n_exports"), F.max("at").alias("last_export"))
    return consents.join(n, "consent_id", "left").withColumn("n_exports", F.coalesce("n_exports", F.lit(0)).cast("long"))


def json_params(text: str) -> list:
    """Parameters out of a JSON array: null, booleans, texts and whole numbers of 64 bits as they are, all other
    numbers, arrays and objects as their JSON text."""

    def one(v):
        if v is None or isinstance(v, (bool, str)):
            return v
        if isinstance(v, int) and -(2**63) <= v < 2**63:
            return v
        return v.text if isinstance(v, _Number) else json.dumps(v, separators=(",", ":"), ensure_ascii=False, default=str) if isinstance(v, (list, dict)) else str(v)

    return [one(v) for v in json.loads(text, parse_float=_Number)]


class _Number(float):
    """A number with the text that it was read from."""

    def __new__(cls, text: str):
        made = super().__new__(cls, text)
        made.text = text
        return made


def valid_consents(consents: DataFrame, now) -> DataFrame:
    """consents(subject, recipient, status, expires_at): active and not expired."""
    return consents.where((F.col("status") == "granted") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))


def consent_status(events: DataFrame) -> DataFrame:
    """events(consent_id, at, action): the last action of each consent, as an aggregate."""
    return events.groupBy("consent_id").agg(F.max_by("action", "at").alias("status"), F.count(F.lit(1)).alias("n_actions"))


def with_consent(rows: DataFrame, consents: DataFrame, now, subject: str, recipient: Column) -> DataFrame:
    ok = valid_consents(consents, now).select(F.col("subject").alias("_s"), F.col("recipient").alias("_r"))
    return rows.join(ok, (F.col(subject) == F.col("_s")) & (recipient == F.col("_r")), "left_semi")


def require_consent(consents: DataFrame, now, subject, recipient) -> None:
    if valid_consents(consents, now).where((F.col("subject") == subject) & (F.col("recipient") == recipient)).first() is None:
        raise ConsentNotFound(f"{subject} for {recipient}")


def recent(audit: DataFrame, n: int, at: str = "at", tie: str = "id") -> DataFrame:
    return audit.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


def expired(rows: DataFrame, at: str, cutoff, holds: DataFrame, subject: str) -> DataFrame:
    """Rows past their retention that no legal hold keeps."""
    return rows.where(F.col(at) < F.lit(cutoff)).join(holds, subject, "left_anti")


def export_proof(content_sha: str, position: int, head: bytes) -> str:
    """One hash over an export's content, the log position and the log's head."""
    return hashlib.sha256(f"{content_sha}:{position}:".encode() + head).hexdigest()


def proof_row(content: DataFrame, log: DataFrame, pos: str = "pos") -> DataFrame:
    """content(n_rows, sha256) with log_position and log_hash, the head of log(pos, hash) at that time, and a
    signature column, which stays NULL."""
    head = log.agg(F.max(F.struct(F.col(pos).alias("p"), F.col("hash").alias("h"))).alias("head"))
    return content.withColumn("_k", F.lit(1)).join(head.withColumn("_k", F.lit(1)), "_k").select("n_rows", F.col("sha256").alias("content_hash"), F.col("head.p").alias("log_position"), F.lower(F.hex("head.h")).alias("log_hash"), F.lit(None).cast("binary").alias("signature"))


def placed(streams: DataFrame, groups: DataFrame) -> DataFrame:
    """streams(…, region) with their group; regions without one keep NULL and fail `require_placed`."""
    return streams.join(groups, "region", "left")


def require_placed(found: DataFrame) -> DataFrame:
    bad = found.where("group_id is null").first()
    if bad:
        raise LedgerError(f"region {bad['region']} has no group")
    return found


def latest_by_tenant(audit: DataFrame, tenant: str, at: str, n: int) -> DataFrame:
    """The last n records of each tenant."""
    w = Window.partitionBy(tenant).orderBy(F.col(at).desc())
    return audit.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
