"""Registered queries over the analytic tables, with the SQL that they are checked against.

Fixtures that queries need are derived from the tables: an event log (stream = event type), an
operation log (key = user, "error" deletes), replicas, consents and audit records.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions import anonymize as A
from ledgerlake.functions import keyed
from ledgerlake.operators import checks, governance, log, projections, versions
from ledgerlake.operators.merkle import blake3_all, entry_leaves, merkle_root
from ledgerlake.operators.ordered import dense_offsets
from ledgerlake.plans.materialize import fresh_path, materialize
from ledgerlake.plans.select import Catalog, Param, Select, TableDef
from ledgerlake.functions import text
from ledgerlake.sources import records
from ledgerlake.sources import rows as json_rows
from ledgerlake.sources.rows import decode_rows
from ledgerlake.streaming.apply import run_projection, unique_ids

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",), "conversations": ("conv_id", "turn"),
}
NOW = datetime(2024, 6, 1)
FIELD_KEY = keyed.field_key(b"\x01" * 32, "c_name")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalog(spark: SparkSession, sf: str, *names: str) -> Catalog:
    made = Catalog()
    for n in names:
        made.add(TableDef(n, table(spark, sf, n), KEYS[n]))
    return made


# ---------------------------------------------------------------- selections


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf):
    return Select("customer").pick("c_custkey", "c_name").where("c_custkey", "=", Param(1)).bind(42).build(catalog(spark, sf, "customer"))


@query("SELECT * FROM customer WHERE c_custkey = 42 AND c_mktsegment >= 'A' AND c_acctbal < 1e9")
def point_lookup_residual(spark, sf):
    s = Select("customer").where("c_custkey", "=", 42).where("c_mktsegment", ">=", "A").where("c_acctbal", "<", 1e9)
    return s.build(catalog(spark, sf, "customer"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def composite_pk_lookup(spark, sf):
    return Select("conversations").pick("conv_id", "turn", "role", "text").where("conv_id", "=", 3).where("turn", "=", 1).build(catalog(spark, sf, "conversations"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 AND o_totalprice > 1000")
def range_scan(spark, sf):
    s = Select("orders").pick("o_orderkey", "o_custkey", "o_totalprice").where("o_orderkey", ">=", Param(1)).where("o_orderkey", "<", Param(2)).where("o_totalprice", ">", 1000)
    return s.order_by("o_orderkey").bind(100, 900).build(catalog(spark, sf, "orders"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 50 AND o_orderstatus <= 'O' ORDER BY o_orderkey DESC LIMIT 25")
def range_scan_desc_topk(spark, sf):
    s = Select("orders").pick("o_orderkey", "o_orderstatus").where("o_orderkey", ">", 50).where("o_orderstatus", "<=", "O").order_by("-o_orderkey").limit(25)
    return s.build(catalog(spark, sf, "orders"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 40 AND p_retailprice < 1500 AND p_brand = 'Brand#13'")
def table_scan_filter(spark, sf):
    s = Select("part").pick("p_partkey", "p_name", "p_retailprice").where("p_size", ">", 40).where("p_retailprice", "<", 1500).where("p_brand", "=", "Brand#13")
    return s.build(catalog(spark, sf, "part"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (1, 7, 32, 999999999) OR (o_orderkey IS NULL)")
def in_list(spark, sf):
    return Select("orders").pick("o_orderkey", "o_orderpriority").where("o_orderkey", "in", [1, 7, Param(1), 999999999, None]).bind(32).build(catalog(spark, sf, "orders"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 25 AND l_quantity <= 30 AND l_discount = 0.05 AND l_returnflag = 'R'")
def and_filter(spark, sf):
    s = Select("lineitem").pick("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    s = s.where("l_quantity", ">=", 25).where("l_quantity", "<=", 30).where("l_discount", "=", 0.05).where("l_returnflag", "=", "R")
    return s.build(catalog(spark, sf, "lineitem"))


@query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def sort_hidden_column_topk(spark, sf):
    return Select("customer").pick("c_name").order_by("-c_acctbal", "c_custkey").limit(20).build(catalog(spark, sf, "customer"))


@query("SELECT c_custkey AS id, c_name AS label, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def alias_projection(spark, sf):
    s = Select("customer", columns=(("c_custkey", "id"), ("c_name", "label"), ("c_custkey", "c_custkey"))).where("c_mktsegment", "=", "BUILDING")
    return s.build(catalog(spark, sf, "customer"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderkey < 50 OR o_orderstatus = 'P' OR o_orderstatus IS NULL) AND o_totalprice BETWEEN 1000 AND 100000")
def or_filter(spark, sf):
    s = Select("orders").pick("o_orderkey", "o_orderstatus").where_any(("orders.o_orderkey", "<", Param(1)), ("o_orderstatus", "in", ["P", None])).where("orders.o_totalprice", "between", (1000, Param(2)))
    return s.bind(50, 100000).build(catalog(spark, sf, "orders"))


@query("SELECT o_custkey AS token_id, o_orderdate AS at FROM orders WHERE list_contains([o_orderstatus, o_orderpriority], 'F')")
def any_of_array(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("token_id"), F.col("o_orderdate").alias("at"), F.array("o_orderstatus", "o_orderpriority").alias("tables"))
    return Select("exports").pick("token_id", "at").where("tables", "has", "F").build(Catalog().add(TableDef("exports", o)))


_SOME_NULL = "(SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS k FROM customer)"


@query(
    f"SELECT 'less' AS test, c_custkey, k FROM {_SOME_NULL} WHERE k < 5 OR k IS NULL UNION ALL SELECT 'is', c_custkey, k FROM {_SOME_NULL} WHERE k IS NULL "
    f"UNION ALL SELECT 'more', c_custkey, k FROM {_SOME_NULL} WHERE k IS NOT NULL UNION ALL SELECT 'in', c_custkey, k FROM {_SOME_NULL} WHERE k IN (1, 2) OR k IS NULL "
    f"UNION ALL SELECT 'first', c_custkey, k FROM (SELECT * FROM {_SOME_NULL} ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 30)"
)
def null_order_semantics(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("k"))
    made = Catalog().add(TableDef("some", rows, ("c_custkey",)))
    parts = {"less": ("<", 5), "is": ("=", None), "more": (">", None), "in": ("in", [1, None, 2])}
    out = [Select("some").where("k", op, v).build(made).select(F.lit(t).alias("test"), "*") for t, (op, v) in parts.items()]
    out.append(Select("some").order_by("k", "c_custkey").limit(30).build(made).select(F.lit("first").alias("test"), "*"))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


# ---------------------------------------------------------------- versions


def op_log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("pos"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"), F.col("event_type").alias("value"))


_OPS = "(SELECT user_id AS key, event_id + 1 AS pos, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, event_type AS value FROM events)"
_VERSIONS = f"(SELECT * FROM (SELECT key, value, pos AS created_at, op, lead(pos) OVER (PARTITION BY key ORDER BY pos) AS deleted_at FROM {_OPS}) WHERE op = 'P')"


@query(f"SELECT key, value, created_at, deleted_at FROM {_VERSIONS}")
def mvcc_versions(spark, sf):
    return versions.versions(op_log(spark, sf)).select("key", "value", "created_at", "deleted_at")


_HALF = "(SELECT max(event_id + 1) // 2 AS p FROM events)"


def half(ops):
    """The position in the middle of an operation log."""
    return versions.applied_position(ops) // 2


@query(f"SELECT key, created_at, value FROM {_VERSIONS}, {_HALF} WHERE created_at <= p AND (deleted_at IS NULL OR deleted_at > p)")
def mvcc_as_of(spark, sf):
    ops = op_log(spark, sf)
    return versions.read_at(ops, half(ops))


@query(f"SELECT key, value, created_at FROM {_VERSIONS}, {_HALF} WHERE created_at <= p AND (deleted_at IS NULL OR deleted_at > p)")
def mvcc_visible(spark, sf):
    ops = op_log(spark, sf)
    return versions.visible(versions.versions(ops), half(ops)).select("key", "value", "created_at")


_TIED = "(SELECT user_id AS key, event_id // 5 + 1 AS pos, arg_max(CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END, event_id) AS op, arg_max(event_type, event_id) AS value FROM (SELECT user_id % 4 AS user_id, event_id, event_type FROM events) GROUP BY ALL)"


def tied_log(spark, sf):
    """Five operations share a position; seq is their order. Four keys have all of them."""
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 4).alias("key"), F.floor(F.col("event_id") / 5 + 1).alias("pos"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))


@query(f"SELECT key, value, pos AS created_at, deleted_at FROM (SELECT *, lead(pos) OVER (PARTITION BY key ORDER BY pos) AS deleted_at FROM {_TIED}) WHERE op = 'P'")
def mvcc_ties(spark, sf):
    return versions.versions(tied_log(spark, sf)).select("key", "value", "created_at", "deleted_at")


@query(f"SELECT key, pos AS created_at, value FROM {_TIED} QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1 AND op = 'P'")
def mvcc_ties_current(spark, sf):
    return versions.state_at(tied_log(spark, sf))


def row_log(spark, sf):
    """An operation log whose values are JSON rows of a users table."""
    e = table(spark, sf, "events")
    row = json_rows.encode_row([("user_id", e.schema["user_id"].dataType), ("event_type", e.schema["event_type"].dataType), ("value", e.schema["value"].dataType)])
    return e.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("pos"), F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"), row.alias("value"))


USERS = T.StructType([T.StructField("user_id", T.LongType(), False), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
_USERS_AT = f"(SELECT user_id, event_type, value FROM events, {_HALF} WHERE event_id + 1 <= p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error')"


def users(spark):
    return Catalog().add(TableDef("users", spark.createDataFrame([], USERS), ("user_id",)))


@query(f"SELECT user_id, value FROM {_USERS_AT} WHERE value > 50 ORDER BY user_id LIMIT 200")
def select_as_of(spark, sf):
    ops = row_log(spark, sf)
    s = Select("users").pick("user_id", "value").where("users.value", ">", Param(1)).order_by("user_id").limit(200).bind(50)
    return s.at(users(spark), ops, half(ops), lambda found: decode_rows(found, "value", USERS))


@query(f"SELECT key, created_at, value FROM {_VERSIONS}, {_HALF} WHERE created_at <= p AND (deleted_at IS NULL OR deleted_at > p) AND key >= 10 AND key < 200 ORDER BY key LIMIT 50")
def kv_scan_as_of(spark, sf):
    ops = op_log(spark, sf)
    return versions.scan(versions.read_at(ops, half(ops)), 10, 200, 50)


@query("SELECT event_id, user_id, event_type, value, lower(hex(encode(event_type || event_id))) AS mark FROM events")
def json_row_decode(spark, sf):
    e = table(spark, sf, "events").withColumn("mark", F.encode(F.concat("event_type", F.col("event_id").cast("string")), "utf-8"))
    schema = T.StructType([T.StructField("event_id", T.LongType(), False), *USERS.fields, T.StructField("mark", T.BinaryType())])
    packed = e.select(json_rows.encode_row([(f.name, f.dataType) for f in schema.fields]).alias("payload"))
    return decode_rows(packed, "payload", schema).withColumn("mark", F.lower(F.hex("mark")))


_APPLIED = (
    "(SELECT user_id AS key, event_id + 1 AS pos, 0 AS seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, event_type AS value FROM events "
    "UNION ALL SELECT c_custkey, n + 1, c_nationkey, 'P', c_mktsegment FROM customer, (SELECT max(event_id + 1) AS n FROM events) WHERE c_custkey % 2 = 0 "
    "UNION ALL SELECT c_custkey, n + 2, 0, 'D', NULL FROM customer, (SELECT max(event_id + 1) AS n FROM events) WHERE c_custkey % 6 = 0)"
)


@query(f"SELECT key, pos AS created_at, value FROM {_APPLIED} QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC, seq DESC) = 1 AND op = 'P'")
def apply_rows(spark, sf):
    c = table(spark, sf, "customer")
    ops = versions.apply(op_log(spark, sf), "insert", c.where("c_custkey % 2 = 0"), "c_custkey", F.col("c_mktsegment"), F.col("c_nationkey"))
    ops = versions.apply(ops, "delete", c.where("c_custkey % 6 = 0"), "c_custkey", F.lit(None).cast("string"))
    return versions.read_consistent(ops, "linearizable", head=versions.applied_position(ops))


@query(f"SELECT key, created_at, value FROM {_VERSIONS} WHERE deleted_at IS NULL")
def mvcc_current(spark, sf):
    return versions.state_at(op_log(spark, sf))


@query(f"SELECT key, pos AS deleted_pos FROM (SELECT key, pos, op, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS r FROM {_OPS}) WHERE r = 1 AND op = 'D'")
def mvcc_delete(spark, sf):
    last = op_log(spark, sf).groupBy("key").agg(F.max(F.struct("pos", "op")).alias("last"))
    return last.where("last.op = 'D'").select("key", F.col("last.pos").alias("deleted_pos"))


@query(
    f"SELECT key, created_at, value FROM {_VERSIONS}, (SELECT coalesce(max(event_id + 1), 0) AS p FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)) "
    "WHERE created_at <= p AND (deleted_at IS NULL OR deleted_at > p)"
)
def as_of_timestamp(spark, sf):
    e = table(spark, sf, "events").withColumn("pos", F.col("event_id") + 1)
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    return versions.state_at(op_log(spark, sf), versions.position_at(e, first + (last - first) / 2))


@query(f"SELECT key, count(*) AS n_versions FROM {_OPS} WHERE op = 'P' GROUP BY key")
def version_counts(spark, sf):
    return versions.version_counts(op_log(spark, sf))


@query(
    f"SELECT key, pos, CASE WHEN op = 'D' THEN 'delete' WHEN was IS NULL THEN 'insert' ELSE 'update' END AS change, was AS old_value, CASE WHEN op = 'P' THEN value END AS new_value "
    f"FROM (SELECT *, CASE WHEN lag(op) OVER w = 'P' THEN lag(value) OVER w END AS was FROM {_OPS} WINDOW w AS (PARTITION BY key ORDER BY pos))"
)
def change_data_old_new(spark, sf):
    return versions.change_data(op_log(spark, sf))


@query(f"SELECT key, created_at, value FROM {_VERSIONS} WHERE deleted_at IS NULL AND key >= 10 AND key < 200 ORDER BY key LIMIT 50")
def kv_scan(spark, sf):
    return versions.scan(versions.state_at(op_log(spark, sf)), 10, 200, 50)


# ---------------------------------------------------------------- the log


def event_log(spark, sf):
    """stream, offset, pos, kind and payload of every event."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("stream"), "event_id", (F.col("event_id") + 1).alias("pos"), F.lit(0).alias("kind"), F.encode(F.concat_ws("|", "event_id", "user_id", "event_type"), "utf-8").alias("payload"))
    return dense_offsets(rows, "stream", "event_id")


def chained_log(spark, sf):
    return materialize(log.chained(event_log(spark, sf)), "chained")


def tampered_log(spark, sf):
    """The chained log with another payload at offset 7 of each stream, none at 13, no hash at 11 and at the
    last offset, record 17 twice, zeros for the previous hash at 21, and without record 25."""
    rows = chained_log(spark, sf)
    last = rows.groupBy("stream").agg(F.max("offset").alias("last"))
    offset = F.col("offset")
    wrong = F.when(offset == 7, F.concat(F.col("payload"), F.lit(b"!"))).when(offset != 13, F.col("payload"))
    bad = rows.join(last, "stream").withColumn("payload", wrong).withColumn("hash", F.when((offset != 11) & (offset != F.col("last")), F.col("hash")))
    bad = bad.withColumn("prev_hash", F.when(offset == 21, F.unhex(F.lit("00" * 32))).otherwise(F.col("prev_hash"))).drop("last").where("offset <> 25")
    return bad.unionByName(bad.where("offset = 17"))


_LOG = "(SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS \"offset\", event_id + 1 AS pos, concat_ws('|', event_id, user_id, event_type) AS payload FROM events)"
_CHAIN = (
    f"log AS MATERIALIZED {_LOG}, chain AS (SELECT stream, \"offset\", payload, NULL::BLOB AS prev, unhex(sha256(unhex('00') || encode(payload))) AS h FROM log WHERE \"offset\" = 0 "
    "UNION ALL SELECT l.stream, l.\"offset\", l.payload, c.h, unhex(sha256(c.h || unhex('00') || encode(l.payload))) FROM chain c JOIN log l ON l.stream = c.stream AND l.\"offset\" = c.\"offset\" + 1)"
)


@query(f'SELECT stream, "offset", pos, payload FROM {_LOG}')
def event_log_offsets(spark, sf):
    return event_log(spark, sf).select("stream", "offset", "pos", F.decode("payload", "utf-8").alias("payload"))


@query(f'SELECT stream, "offset", payload FROM (SELECT *, sum(strlen(payload)) OVER (PARTITION BY stream ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {_LOG} WHERE "offset" >= 10) WHERE coalesce(b, 0) < 5000')
def byte_budget_read(spark, sf):
    rows = event_log(spark, sf).where("offset >= 10")
    return log.within_budget(rows, 5000).select("stream", "offset", F.decode("payload", "utf-8").alias("payload"))


@query(f"SELECT l.stream, max(\"offset\") AS last_offset, count(*) AS n, coalesce(max(r_name), 'Global') AS placement FROM {_LOG} l LEFT JOIN region ON strlen(l.stream) = r_regionkey + 4 GROUP BY l.stream")
def stream_metadata(spark, sf):
    """A stream stays in the region that a table names for it (here by the length of its name), else it is global."""
    streams = event_log(spark, sf).groupBy("stream").agg(F.max("offset").alias("last_offset"), F.count(F.lit(1)).alias("n"))
    places = table(spark, sf, "region").select((F.col("r_regionkey") + 4).alias("length"), F.col("r_name").alias("region"))
    found = streams.withColumn("length", F.octet_length("stream")).join(places, "length", "left")
    return found.select("stream", "last_offset", "n", F.coalesce("region", F.lit("Global")).alias("placement"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT stream, \"offset\", lower(hex(h)) AS hash FROM chain")
def hash_chain(spark, sf):
    return chained_log(spark, sf).select("stream", "offset", F.lower(F.hex("hash")).alias("hash"))


@query("SELECT stream, n, 0::BIGINT AS n_bad FROM (SELECT event_type AS stream, count(*) AS n FROM events GROUP BY event_type)")
def chain_verify(spark, sf):
    rows = chained_log(spark, sf)
    bad = log.chain_breaks(rows).groupBy("stream").agg(F.count(F.lit(1)).alias("b"))
    n = rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n"))
    return n.join(bad, "stream", "left").select("stream", "n", F.coalesce("b", F.lit(0)).cast("long").alias("n_bad"))


_TAMPERED = (
    "bad AS (SELECT stream, \"offset\", CASE WHEN \"offset\" = 7 THEN payload || '!' WHEN \"offset\" = 13 THEN NULL ELSE payload END AS payload, "
    "CASE WHEN \"offset\" = 21 THEN unhex(repeat('00', 32)) ELSE prev END AS prev, CASE WHEN \"offset\" IN (11, last) THEN NULL ELSE h END AS h "
    "FROM chain JOIN (SELECT stream, max(\"offset\") AS last FROM log GROUP BY stream) USING (stream), (SELECT unnest([1, 2]) AS copy) WHERE (copy = 1 OR \"offset\" = 17) AND \"offset\" <> 25), "
    "own AS (SELECT stream, \"offset\", count(*) AS times, max(h) AS h FROM bad GROUP BY ALL)"
)


@query(
    f"WITH RECURSIVE {_CHAIN}, {_TAMPERED} SELECT DISTINCT * FROM (SELECT b.stream, b.\"offset\", CASE WHEN o.times > 1 THEN 'doubled' "
    "WHEN b.h IS NULL OR payload IS NULL OR b.h <> unhex(sha256(coalesce(prev, ''::BLOB) || unhex('00') || encode(payload))) THEN 'hash' WHEN b.\"offset\" > 0 AND p.stream IS NULL THEN 'gap' "
    "WHEN b.\"offset\" > 0 AND b.prev IS DISTINCT FROM p.h THEN 'link' END AS problem FROM bad b JOIN own o ON o.stream = b.stream AND o.\"offset\" = b.\"offset\" "
    "LEFT JOIN own p ON p.stream = b.stream AND p.\"offset\" = b.\"offset\" - 1) WHERE problem IS NOT NULL"
)
def chain_tamper(spark, sf):
    return log.chain_breaks(tampered_log(spark, sf))


@query(f"SELECT stream, count(*) AS n, max(\"offset\") AS last FROM {_LOG} WHERE \"offset\" % 50 <> 3 GROUP BY stream HAVING count(*) <> max(\"offset\") + 1")
def count_mismatch(spark, sf):
    return checks.count_mismatches(event_log(spark, sf).where("offset % 50 <> 3"))


@query(
    f"WITH RECURSIVE log AS MATERIALIZED {_LOG}, mixed AS MATERIALIZED (SELECT stream, \"offset\" + \"offset\" // 100 AS \"offset\", 0 AS kind, payload FROM log "
    "UNION ALL SELECT stream, \"offset\" + 1 + \"offset\" // 100, 1, NULL FROM log WHERE (\"offset\" + 1) % 100 = 0), "
    "chain AS (SELECT stream, \"offset\", kind, encode(payload) AS payload, unhex(sha256(unhex('00') || encode(payload))) AS h FROM mixed WHERE \"offset\" = 0 "
    "UNION ALL SELECT stream, \"offset\", kind, payload, unhex(sha256(prev || unhex('0' || kind) || payload)) FROM (SELECT l.stream, l.\"offset\", l.kind, c.h AS prev, "
    "CASE WHEN l.kind = 1 THEN c.h || unhex(lpad(to_hex((l.\"offset\" + 1) % 256), 2, '0') || lpad(to_hex((l.\"offset\" + 1) // 256 % 256), 2, '0') || lpad(to_hex((l.\"offset\" + 1) // 65536 % 256), 2, '0') || repeat('00', 5)) ELSE encode(l.payload) END AS payload "
    "FROM chain c JOIN mixed l ON l.stream = c.stream AND l.\"offset\" = c.\"offset\" + 1)) SELECT stream, \"offset\", kind, lower(hex(payload)) AS payload, lower(hex(h)) AS hash FROM chain"
)
def checkpoint_append(spark, sf):
    found = log.with_checkpoints(event_log(spark, sf), 100)
    return found.select("stream", "offset", "kind", F.lower(F.hex("payload")).alias("payload"), F.lower(F.hex("hash")).alias("hash"))


@query(f"WITH l AS {_LOG} SELECT stream, \"offset\", payload FROM l WHERE stream IN ('click', 'view') AND \"offset\" >= 5")
def log_table_roundtrip(spark, sf):
    path = fresh_path(spark, "log-table")
    records.write_log(event_log(spark, sf), path)
    return records.read_log(spark, path).where("stream IN ('click', 'view') AND offset >= 5").select("stream", "offset", F.decode("payload", "utf-8").alias("payload"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT stream, \"offset\", lower(hex(h)) AS hash FROM chain JOIN (SELECT stream, max(\"offset\") AS last FROM log GROUP BY stream) USING (stream) WHERE \"offset\" > last // 2")
def append_batch(spark, sf):
    """The later half of each stream appended to the earlier one, at the offsets that are expected."""
    rows = event_log(spark, sf)
    rows = materialize(rows.join(rows.groupBy("stream").agg(F.floor(F.max("offset") / 2).alias("mid")), "stream"), "halves")
    old = materialize(log.with_crc(log.chained(rows.where("offset <= mid"))), "old")
    expected = {r["stream"]: r["at"] for r in rows.groupBy("stream").agg((F.max("mid") + 1).alias("at")).collect()}  # a row per stream of the batch
    new = rows.where("offset > mid").select("stream", (F.col("offset") - F.col("mid") - 1).alias("n"), "payload")
    return log.append(old, new, expected).select("stream", "offset", F.lower(F.hex("hash")).alias("hash"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT stream, min(\"offset\") AS first, max(\"offset\") AS last, count(*) AS n, lower(hex(arg_min(prev, \"offset\"))) AS first_prev_hash, lower(hex(arg_max(h, \"offset\"))) AS last_hash FROM chain JOIN log USING (stream, \"offset\"), {_HALF} WHERE pos >= p GROUP BY stream")
def range_export_proof(spark, sf):
    positions = event_log(spark, sf).select("stream", "offset", "pos")
    return log.range_proof(chained_log(spark, sf).join(positions, ["stream", "offset"]).where(F.col("pos") >= half(op_log(spark, sf))))


@query(f"SELECT level, stream, \"offset\", payload FROM {_LOG}, (SELECT unnest(['full', 'checkpoint', 'none']) AS level) WHERE stream = 'view' AND \"offset\" >= 120")
def read_levels(spark, sf):
    """The same records at each level of verification."""
    rows = materialize(log.with_crc(chained_log(spark, sf)), "levels")
    parts = [log.read(rows, "view", 120, verify=v).select(F.lit(v).alias("level"), "stream", "offset", F.decode("payload", "utf-8").alias("payload")) for v in ("full", "checkpoint", "none")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT stream, \"offset\", pos FROM {_LOG}, {_HALF} WHERE stream IN ('click', 'view') AND pos BETWEEN p // 2 AND p")
def scope_ranges(spark, sf):
    at = half(op_log(spark, sf))
    scope = governance.Scope(fields=frozenset({"stream", "offset", "pos"}), streams=frozenset({"click", "view"}), positions=(at // 2, at))
    return scope.restrict(event_log(spark, sf), pos="pos", stream="stream")


@query("SELECT DISTINCT user_id FROM events")
def streaming_unique(spark, sf):
    e = table(spark, sf, "events").schema
    return unique_ids(spark, f"{sf}/event[s].parquet", e, "user_id", "ts", "100000 hours")


_STREAMS = "(SELECT n_nationkey + 1 AS id, n_name AS name, n_regionkey AS region FROM nation)"


@query(f"SELECT id, name, region FROM {_STREAMS} UNION ALL SELECT (SELECT max(id) FROM {_STREAMS}) + 1 + r_regionkey, r_name, r_regionkey FROM region")
def create_streams(spark, sf):
    known = log.streams_table(spark)
    n = table(spark, sf, "nation")
    known = log.create_streams(known, n.select((F.col("n_nationkey") + 1).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region")))
    return log.create_streams(known, table(spark, sf, "region").select(F.lit(None).cast("long").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("region")))


@query(f'SELECT stream, "offset" FROM {_LOG} WHERE "offset" > 0 AND (pos - 1) % 97 <> 5 AND (stream, "offset" - 1) NOT IN (SELECT (stream, "offset") FROM {_LOG} WHERE (pos - 1) % 97 <> 5)')
def offset_continuity(spark, sf):
    return checks.offset_gaps(event_log(spark, sf).where("(pos - 1) % 97 <> 5"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT stream, \"offset\", lower(hex(coalesce(prev, unhex(repeat('00', 32))))) AS chain_hash, \"offset\" + 1 AS record_count FROM chain WHERE (\"offset\" + 1) % 100 = 0")
def checkpoint_positions(spark, sf):
    return log.checkpoints(chained_log(spark, sf), 100).withColumn("chain_hash", F.lower(F.hex("chain_hash")))


@query(f"SELECT stream, \"offset\", payload FROM {_LOG} WHERE stream = 'click' AND \"offset\" >= 130")
def verified_suffix(spark, sf):
    rows = log.verified_suffix(chained_log(spark, sf), "click", 130, 100)
    return rows.select("stream", "offset", F.decode("payload", "utf-8").alias("payload"))


@query(f"SELECT stream, \"offset\", payload FROM (SELECT *, sum(strlen(payload)) OVER (ORDER BY \"offset\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {_LOG} WHERE stream = 'view' AND \"offset\" >= 20) WHERE coalesce(b, 0) < 900")
def verified_read(spark, sf):
    rows = log.read(log.with_crc(chained_log(spark, sf)), "view", 20, 900)
    return rows.select("stream", "offset", F.decode("payload", "utf-8").alias("payload"))


@query()
def crc_check(spark, sf):
    rows = log.with_crc(event_log(spark, sf))
    changed = rows.withColumn("payload", F.when(F.col("offset") % 50 == 3, F.concat(F.lit(b"x"), F.col("payload"))).otherwise(F.col("payload")))
    return log.crc_breaks(changed)


@query(f"WITH RECURSIVE {_CHAIN} SELECT stream, \"offset\", payload, lower(hex(h)) AS hash, true AS ok FROM chain")
def record_roundtrip(spark, sf):
    back = records.decode(records.encode(chained_log(spark, sf)))
    again = log.record_hash(F.col("prev_hash"), F.col("kind"), F.col("payload"))
    return back.select("stream", "offset", F.decode("payload", "utf-8").alias("payload"), F.lower(F.hex(again)).alias("hash"), "ok")


@query(
    f"WITH RECURSIVE n AS (SELECT stream, 0 AS lv, \"offset\" AS i, unhex(sha256(encode(payload))) AS h, count(*) OVER (PARTITION BY stream) AS c FROM {_LOG} "
    "UNION ALL SELECT stream, lv + 1, i // 2, h, (c + 1) // 2 FROM (SELECT stream, lv, i, c, CASE WHEN i + 1 = c THEN h ELSE unhex(sha256(h || nx)) END AS h FROM "
    "(SELECT *, lead(h) OVER (PARTITION BY stream, lv ORDER BY i) AS nx FROM n) WHERE i % 2 = 0) WHERE c > 1) "
    f"SELECT stream, lower(hex(h)) AS root, k AS n_leaves FROM n JOIN (SELECT stream, count(*) AS k FROM {_LOG} GROUP BY stream) USING (stream) WHERE c = 1"
)
def merkle_roots(spark, sf):
    leaves = event_log(spark, sf).select("stream", "offset", F.unhex(F.sha2("payload", 256)).alias("h"))
    return merkle_root(leaves, "stream", "offset", "h").select("stream", F.lower(F.hex("root")).alias("root"), "n_leaves")


@query()
def merkle_roots_blake3(spark, sf):
    """Roots over entries (operation, view, checksum), all hashes BLAKE3."""
    entries = event_log(spark, sf).select("stream", "offset", "pos", F.floor(F.col("pos") / 1000).alias("view"), F.crc32("payload").alias("checksum"))
    found = merkle_root(entry_leaves(entries, "pos", "view", "checksum"), "stream", "offset", "leaf", blake3_all)
    return found.select("stream", F.lower(F.hex("root")).alias("root"), "n_leaves")


@query("SELECT event_id AS id, min(ts) AS ts, count(*) AS times FROM (SELECT event_id, ts FROM events UNION ALL SELECT event_id, ts + INTERVAL 1 DAY FROM events WHERE event_id % 10 = 0) GROUP BY event_id")
def idempotent_dedup(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    again = e.where("id % 10 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return log.first_submits(e.unionByName(again), "id", "ts")


@query(f'SELECT i.id, stream, "offset", CASE WHEN payload IS NOT NULL THEN sha256(payload) END AS hash, "offset" IS NOT NULL AS committed FROM (SELECT o_orderkey AS id FROM orders) i LEFT JOIN {_LOG} l ON l.pos - 1 = i.id')
def commitment_proof(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    rows = event_log(spark, sf).select((F.col("pos") - 1).alias("id"), "stream", "offset", F.sha2("payload", 256).alias("hash"))
    return log.commitment_proof(rows, ids)


@query("SELECT event_id AS id, greatest(0, n)::BIGINT AS affected, CASE WHEN n > 0 THEN event_id END AS first, CASE WHEN n > 0 THEN event_id + n - 1 END AS last, n > 0 AS had_data_loss FROM (SELECT event_id, event_id % 4 - 1 AS n FROM events WHERE event_type = 'error')")
def recovery_loss_report(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    return log.loss_report(e.select(F.col("event_id").alias("id"), F.col("event_id").alias("discarded_from"), (F.col("event_id") + F.col("event_id") % 4 - 1).alias("discarded_to")))


# ---------------------------------------------------------------- anonymising


@query("SELECT c_custkey, NULL::VARCHAR AS redacted, repeat('*', strlen(c_name)) AS masked, repeat('*', strlen(c_custkey::VARCHAR)) AS masked_number, '[REDACTED]' AS fixed, repeat('#', length(c_name)) AS each FROM customer")
def mask_functions(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", A.redact(n).alias("redacted"), A.mask(n).alias("masked"), A.mask(F.col("c_custkey")).alias("masked_number"), A.mask_fixed(n, "[REDACTED]").alias("fixed"), A.mask_each(n, "#").alias("each"))


@query("SELECT doc_id, CASE WHEN length(t) <= 6 THEN repeat('*', length(t)) ELSE left(t, 2) || repeat('*', length(t) - 6) || right(t, 4) END AS partial FROM (SELECT doc_id, split_part(text, ' ', 1) AS t FROM documents)")
def partial_mask(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.partial_mask(F.split_part("text", F.lit(" "), F.lit(1)), 2, 4).alias("partial"))


@query("SELECT doc_id, CASE WHEN length(t) <= 6 THEN repeat('*', length(t)) ELSE left(t, 2) || repeat('*', length(t) - 6) || right(t, 4) END AS partial FROM (SELECT doc_id, text AS t FROM documents)")
def partial_mask_whole(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.partial_mask(F.col("text"), 2, 4).alias("partial"))


@query("SELECT c_custkey, left(c_name, 4) || repeat('*', greatest(length(c_name) - 4, 0)) AS prefix, repeat('*', greatest(length(c_name) - 3, 0)) || right(c_name, 3) AS suffix FROM customer")
def preserve_masks(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", A.mask_but_prefix(F.col("c_name"), 4).alias("prefix"), A.mask_but_suffix(F.col("c_name"), 3).alias("suffix"))


@query("SELECT c_custkey, (floor(c_acctbal / 1000) * 1000)::BIGINT::VARCHAR || '-' || ((floor(c_acctbal / 1000) * 1000)::BIGINT + 999)::VARCHAR AS range FROM customer")
def generalize_numeric(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", A.bucket(F.col("c_acctbal"), 1000).alias("range"))


@query("SELECT p_partkey, CASE WHEN age >= 90 THEN '90+' ELSE (age // 5 * 5)::VARCHAR || '-' || (age // 5 * 5 + 4)::VARCHAR END AS age_range FROM (SELECT p_partkey, p_size * 2 AS age FROM part)")
def generalize_age(spark, sf):
    return table(spark, sf, "part").select("p_partkey", A.generalize_age(F.col("p_size") * 2, 5).alias("age_range"))


@query("SELECT c_custkey, left(lpad(c_custkey::VARCHAR, 5, '0'), 3) || '**' AS zip FROM customer")
def generalize_zip(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", A.generalize_zip(F.lpad(F.col("c_custkey").cast("string"), 5, "0"), 3).alias("zip"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR AS q FROM orders")
def truncate_date(spark, sf):
    c = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", *[A.truncate_date(c, p).alias(n) for n, p in (("y", "year"), ("m", "month"), ("d", "day"), ("q", "quarter"))])


@query("SELECT c_custkey, sha256(c_name) AS hash FROM customer")
def hash_column(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", A.hash_text(F.col("c_name")).alias("hash"))


@query(f"SELECT c_custkey, sha256(unhex('{FIELD_KEY.hex()}') || encode(c_name)) AS token FROM customer")
def tokenize_keyed(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", keyed.token(F.col("c_name"), FIELD_KEY).alias("token"))


@query(f"SELECT c_custkey, 'tok_' || left(sha256(unhex('{keyed.field_key(FIELD_KEY, 'tenant-a').hex()}') || encode(c_name)), 16) AS pseudonym FROM customer")
def tenant_pseudonyms(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", keyed.tenant_pseudonym(F.col("c_name"), FIELD_KEY, "tenant-a").alias("pseudonym"))


@query("SELECT c_custkey, c_name AS revealed, strlen(c_name) + 28 AS n_bytes FROM customer")
def field_encrypt_roundtrip(spark, sf):
    sealed = table(spark, sf, "customer").select("c_custkey", keyed.encrypt(F.col("c_name"), FIELD_KEY, keyed.position_nonce(F.col("c_custkey"))).alias("c"))
    return sealed.select("c_custkey", keyed.decrypt(F.col("c"), FIELD_KEY).alias("revealed"), F.octet_length("c").cast("long").alias("n_bytes"))


@query(f"SELECT c_custkey, sha256(unhex('{FIELD_KEY.hex()}') || encode(c_name)) AS token, c_name AS revealed FROM customer")
def reversible_tokens(spark, sf):
    made = table(spark, sf, "customer").select("c_custkey", keyed.reversible(F.col("c_name"), FIELD_KEY).alias("t"))
    return made.select("c_custkey", "t.token", keyed.decrypt(F.col("t.ciphertext"), FIELD_KEY).alias("revealed"))


@query("SELECT c_custkey, sha256(repeat('*', strlen(c_name))) AS chained, repeat('*', strlen(c_name)) AS first FROM customer")
def rule_policies(spark, sf):
    """All matching rules in order, or only the first."""
    rules = [governance.Rule("c_name", "mask"), governance.Rule("c_name", "hash")]
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    chain, first = (governance.transform(rows, rules, policy)[0] for policy in ("chain", "first"))
    return chain.withColumnRenamed("c_name", "chained").join(first.withColumnRenamed("c_name", "first"), "c_custkey")


@query()
def pseudonymize_blake3(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", A.pseudonym(F.col("c_name")).alias("pseudonym"))


@query("SELECT c_custkey, 'PSEUDO-' || left(sha256(c_name), 16) AS pseudonym FROM customer")
def pseudonymize_sha256(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", A.pseudonym(F.col("c_name"), "sha256").alias("pseudonym"))


@query("SELECT min(n) AS k, min(n) >= 5 AS satisfies_target, count(*) AS equivalence_classes, min(n) AS smallest_class_size FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey)")
def k_anonymity(spark, sf):
    return checks.k_anonymity(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], 5)


# ---------------------------------------------------------------- governed access

RULES = (
    governance.Rule("c_name", "partial_mask", (0, 4)),
    governance.Rule("c_address", "redact"),
    governance.Rule("c_nationkey", "generalize", (5,)),
    governance.Rule("c_mkt.*", "hash"),
)
_SEEN = (
    "c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS c_name, "
    "(c_nationkey // 5 * 5)::VARCHAR || '-' || (c_nationkey // 5 * 5 + 4)::VARCHAR AS c_nationkey, sha256(c_mktsegment) AS c_mktsegment"
)


def governed(spark, sf, scope, *names):
    store = governance.TokenStore()
    store.issue("tenant-a", scope, NOW, timedelta(hours=1), id="t")
    return governance.Governed(catalog(spark, sf, *names), store, lambda: NOW)


@query(f"SELECT {_SEEN} FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 200")
def scoped_query(spark, sf):
    g = governed(spark, sf, governance.Scope(frozenset({"customer"}), excluded=frozenset({"c_acctbal"}), max_rows=200, rules=RULES), "customer")
    return g.query("t", Select("customer").where("c_custkey", ">", Param(1)).order_by("c_custkey"), 100)


@query("SELECT event_id, ts, '***' AS event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-10' ORDER BY event_id LIMIT 300")
def governed_rewrite(spark, sf):
    scope = governance.Scope(fields=frozenset({"event_id", "ts", "event_type"}), time_range=(datetime(2024, 1, 1), datetime(2024, 1, 10)), max_rows=300)
    rows = scope.restrict(table(spark, sf, "events"), ts="ts").orderBy("event_id").limit(300)
    return rows.withColumn("event_type", A.mask_fixed(F.col("event_type"), "***"))


@query("SELECT c_custkey, '{\"c_custkey\":\"' || c_custkey || '\",\"c_name\":\"' || c_name || '\",\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS line FROM customer ORDER BY c_custkey LIMIT 500")
def scoped_export_json(spark, sf):
    g = governed(spark, sf, governance.Scope(fields=frozenset({"c_custkey", "c_name", "c_mktsegment"}), max_rows=500), "customer")
    return g.export("t", "customer", ["c_custkey"], "json")[0]


@query("SELECT c_custkey, c_custkey || ',\"' || c_name || '\",\"' || c_mktsegment || '\"' AS line FROM customer ORDER BY c_custkey LIMIT 500")
def scoped_export_csv(spark, sf):
    g = governed(spark, sf, governance.Scope(fields=frozenset({"c_custkey", "c_name", "c_mktsegment"}), max_rows=500), "customer")
    return g.export("t", "customer", ["c_custkey"], "csv")[0]


@query("SELECT count(*) AS n_rows, sha256(string_agg(sha256(line), '' ORDER BY c_custkey)) AS sha256 FROM (SELECT c_custkey, c_custkey || ',\"' || c_name || '\"' AS line FROM customer ORDER BY c_custkey LIMIT 1000)")
def export_content_hash(spark, sf):
    g = governed(spark, sf, governance.Scope(fields=frozenset({"c_custkey", "c_name"})), "customer")
    return g.export("t", "customer", ["c_custkey"], "csv")[1]


@query("SELECT least(count(*), 100) AS returned, count(*) > 100 AS truncated FROM customer WHERE c_mktsegment = 'BUILDING'")
def row_cap(spark, sf):
    g = governed(spark, sf, governance.Scope(max_rows=100), "customer")
    return g.page("t", Select("customer").where("c_mktsegment", "=", "BUILDING"))[1]


@query("SELECT count(*) AS n_rows, sha256(string_agg(sha256(line), '' ORDER BY o_orderkey)) AS sha256 FROM (SELECT o_orderkey, o_orderkey || ',' || o_custkey AS line FROM orders ORDER BY o_orderkey LIMIT 5000)")
def export_beyond_the_default(spark, sf):
    g = governed(spark, sf, governance.Scope(fields=frozenset({"o_orderkey", "o_custkey"})), "orders")
    return g.export("t", "orders", ["o_orderkey"], "csv", 5000)[1]


_EXPORT_SHA = "(SELECT count(*) AS n, sha256(string_agg(sha256(line), '' ORDER BY c_custkey)) AS h FROM (SELECT c_custkey, c_custkey || ',\"' || c_name || '\"' AS line FROM customer ORDER BY c_custkey LIMIT 1000))"


@query(
    f"SELECT 'export-' || n_nationkey AS export_id, CASE n_nationkey % 3 WHEN 0 THEN h WHEN 1 THEN repeat('0', 64) ELSE 'short' END AS sha256, n_nationkey = 0 AS verified, "
    f"CASE WHEN n_nationkey % 3 = 2 THEN 'not a hash of 64 hex digits' WHEN n_nationkey > 1 THEN 'no such export' WHEN n_nationkey = 1 THEN 'another content' ELSE 'verified' END AS message FROM nation, {_EXPORT_SHA}"
)
def export_verify(spark, sf):
    g = governed(spark, sf, governance.Scope(fields=frozenset({"c_custkey", "c_name"})), "customer")
    g.folder = fresh_path(spark, "governed")
    proof = materialize(g.export("t", "customer", ["c_custkey"], "csv")[1], "proof")
    for number in (0, 1):
        g.register(f"export-{number}", "t", "customer", proof)
    claim = F.when(F.col("n_nationkey") % 3 == 0, F.col("sha256")).when(F.col("n_nationkey") % 3 == 1, F.lit("0" * 64)).otherwise("short")
    n = table(spark, sf, "nation").withColumn("k", F.lit(1)).join(proof.withColumn("k", F.lit(1)), "k")
    claims = n.select(F.concat(F.lit("export-"), F.col("n_nationkey").cast("string")).alias("export_id"), claim.alias("sha256"))
    return governance.verify_exports(spark.read.parquet(f"{g.folder}/exports"), claims)


@query(
    f"WITH RECURSIVE {_CHAIN} SELECT n AS n_rows, h AS content_hash, p AS log_position, head AS log_hash, NULL::BLOB AS signature FROM {_EXPORT_SHA}, "
    "(SELECT max(pos) AS p, arg_max(lower(hex(h)), pos) AS head FROM chain JOIN log USING (stream, \"offset\"))"
)
def export_proof_row(spark, sf):
    g = governed(spark, sf, governance.Scope(fields=frozenset({"c_custkey", "c_name"})), "customer")
    positions = event_log(spark, sf).select("stream", "offset", "pos")
    return governance.proof_row(g.export("t", "customer", ["c_custkey"], "csv")[1], chained_log(spark, sf).join(positions, ["stream", "offset"]))


@query(
    "SELECT consent_id, seq, \"at\", action, lead(\"at\") OVER (PARTITION BY consent_id ORDER BY seq) AS until FROM (SELECT user_id % 50 AS consent_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS seq, event_id AS \"at\", event_type AS action FROM events)"
)
def consent_history(spark, sf):
    e = table(spark, sf, "events")
    return governance.consent_history(e.select((F.col("user_id") % 50).alias("consent_id"), F.col("event_id").alias("at"), F.col("event_type").alias("action")))


@query("SELECT c_custkey AS consent_id, count(o_orderkey) AS n_exports, max(o_orderdate) AS last_export FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def exports_per_consent(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("consent_id"), F.col("o_orderdate").alias("at"))
    return governance.exports_per_consent(table(spark, sf, "customer").select(F.col("c_custkey").alias("consent_id")), o)


@query("SELECT event_id + 1 AS position, ts AS timestamp, user_id % 8 AS tenant_id, event_type AS stream, 'user:' || user_id AS actor, NULL::VARCHAR AS caused_by, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INSERT' END AS operation FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-02'")
def events_view(spark, sf):
    e = table(spark, sf, "events")
    meta = e.select((F.col("event_id") + 1).alias("position"), F.col("ts").alias("timestamp"), (F.col("user_id") % 8).alias("tenant_id"), F.col("event_type").alias("stream"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("actor"), F.when(F.col("event_type") == "error", "DELETE").otherwise("INSERT").alias("operation"), F.col("props").alias("data"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("token_id"), F.array("o_orderstatus").alias("tables_accessed"))
    governance.system_views(meta, o, table(spark, sf, "customer").select(F.col("c_custkey").alias("subject")))
    return spark.sql("SELECT position, timestamp, tenant_id, stream, actor, caused_by, operation FROM __events WHERE operation = 'DELETE' AND timestamp >= TIMESTAMP '2024-01-02'")


@query("SELECT o.o_custkey AS token_id, count(*) AS n FROM orders o WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) GROUP BY o_custkey")
def export_audit_view(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("token_id"), F.array("o_orderstatus").alias("tables_accessed"))
    governance.system_views(table(spark, sf, "events").select(F.col("event_type").alias("stream")), o, table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("subject")))
    return spark.sql("SELECT token_id, count(*) AS n FROM __export_audit LEFT ANTI JOIN __legal_holds ON token_id = subject WHERE array_contains(tables_accessed, 'O') GROUP BY token_id")


_ROLE = "CASE user_id % 5 WHEN 0 THEN 'Owner' WHEN 1 THEN 'Admin' WHEN 2 THEN 'Member' WHEN 3 THEN 'Viewer' ELSE 'Guest' END"
_PERMISSION = "CASE event_id % 4 WHEN 0 THEN 'View data' WHEN 1 THEN 'Append events' WHEN 2 THEN 'Delete streams' ELSE 'Manage roles' END"


@query(
    f"SELECT id, role, permission, (role = 'Owner' OR role = 'Admin' AND permission <> 'Manage roles' OR role = 'Member' AND permission IN ('View data', 'Append events') OR role = 'Viewer' AND permission = 'View data' OR c_custkey IS NOT NULL) AS allowed "
    f"FROM (SELECT event_id AS id, user_id, {_ROLE} AS role, {_PERMISSION} AS permission, event_type FROM events) LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = user_id AND event_type = 'view' AND permission = 'Append events'"
)
def role_permissions(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id AS id", "user_id AS principal", "event_type AS resource", f"{_ROLE} AS role", f"{_PERMISSION} AS permission")
    grants = table(spark, sf, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS principal", "'view' AS resource", "'Append events' AS permission")
    return governance.permitted(e, grants).select("id", "role", "permission", "allowed")


_KIND = "CASE o_custkey % 4 WHEN 0 THEN 'authentication' WHEN 1 THEN 'data access' WHEN 2 THEN 'administrative' ELSE 'other' END"
_YEARS = "CASE o_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 10 END"


@query(f"SELECT o_orderkey AS id, {_KIND} AS kind, (o_orderdate + to_years({_YEARS}))::DATE::VARCHAR AS keep_until, coalesce((o_orderdate + to_years({_YEARS}))::DATE > DATE '2002-06-01', true) AS kept FROM orders")
def audit_retention(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_KIND} AS kind", "o_orderdate AS at")
    return governance.audit_kept(o, datetime(2002, 6, 1)).select("id", "kind", F.col("keep_until").cast("string").alias("keep_until"), "kept")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE user_id::VARCHAR END AS number_text, (epoch_us(ts) * 1000)::VARCHAR AS time_ns, base64(encode(event_type)) AS bytes_text, (epoch_us(ts) // 1000000)::VARCHAR || '.' || lpad((epoch_us(ts) % 1000000 * 1000)::VARCHAR, 9, '0') AS rendered FROM events")
def value_texts(spark, sf):
    ts = F.to_utc_timestamp("ts", spark.conf.get("spark.sql.session.timeZone")) if dict(table(spark, sf, "events").dtypes)["ts"] == "timestamp_ntz" else F.col("ts")
    e = table(spark, sf, "events").withColumn("t", ts.cast("timestamp"))
    return e.select("event_id", text.value_text(F.when(F.col("event_type") != "error", F.col("user_id")), "long").alias("number_text"), text.value_text(F.col("t"), "timestamp").alias("time_ns"), text.value_text(F.encode("event_type", "utf-8"), "binary").alias("bytes_text"), text.time_text(F.col("t")).alias("rendered"))


@query("SELECT event_id, key, i + max(v - i) OVER (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING) AS ts_ns FROM (SELECT event_id, user_id % 3 AS key, value::BIGINT AS v, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS i FROM events)")
def rising_times(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 3).alias("key"), F.round("value").cast("long").alias("v"))
    return text.rising(e, "key", "event_id", F.col("v")).select("event_id", "key", "ts_ns")


@query("SELECT c_custkey, sha256(c_name) AS hash FROM customer")
def hash_for_compliance(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.hash_for(F.col("c_name"), "compliance").alias("hash"))


def consents(spark, sf):
    c = table(spark, sf, "customer")
    status = F.element_at(F.array(F.lit("granted"), F.lit("withdrawn"), F.lit("granted")), (F.col("c_custkey") % 3 + 1).cast("int"))
    expires = F.when(F.col("c_custkey") % 5 != 0, F.lit(NOW) + F.make_dt_interval((F.col("c_custkey") % 7 - 3).cast("int")))
    return c.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("recipient"), status.alias("status"), expires.alias("expires_at"))


_CONSENTED = "c_custkey % 3 <> 1 AND (c_custkey % 5 = 0 OR c_custkey % 7 > 3)"


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND {_CONSENTED}")
def consent_valid_semijoin(spark, sf):
    rows = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return governance.with_consent(rows, consents(spark, sf), NOW, "c_custkey", F.lit("BUILDING")).select("c_custkey", "c_name")


@query("SELECT user_id % 50 AS consent_id, max_by(event_type, event_id) AS status, count(*) AS n_actions FROM events GROUP BY user_id % 50")
def consent_latest_status(spark, sf):
    e = table(spark, sf, "events")
    return governance.consent_status(e.select((F.col("user_id") % 50).alias("consent_id"), F.col("event_id").alias("at"), F.col("event_type").alias("action")))


@query("SELECT o_custkey % 20 AS token_id, count(*) AS n_exports, max(o_orderdate) AS last_export FROM orders WHERE o_custkey % 20 IN (3, 5, 7) GROUP BY o_custkey % 20")
def export_by_token(spark, sf):
    o = table(spark, sf, "orders").withColumn("token_id", F.col("o_custkey") % 20).where(F.col("token_id").isin(3, 5, 7))
    return o.groupBy("token_id").agg(F.count(F.lit(1)).alias("n_exports"), F.max("o_orderdate").alias("last_export"))


def audit(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("user_id") % 8).alias("tenant"), F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("success"))


@query("SELECT event_id AS id, ts AS at, user_id % 8 AS tenant, event_type AS tool, event_type <> 'error' AS success FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def audit_recent(spark, sf):
    return governance.recent(audit(spark, sf), 40)


@query("SELECT user_id % 8 AS tenant, event_type AS tool, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok FROM events GROUP BY ALL")
def audit_by_tenant(spark, sf):
    return audit(spark, sf).groupBy("tenant", "tool").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_ok"))


@query("SELECT event_type AS method, value > 50 AS status, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS longest FROM events GROUP BY ALL")
def request_metrics(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("method"), (F.col("value") > 50).alias("status"), F.col("value").alias("duration"))
    return checks.request_counts(e)


@query("SELECT user_id AS client, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_windows(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("client"), "ts")
    return checks.over_rate(e, "1 hour", 1)


_BUCKETS = (10.0, 50.0, 90.0, 99.0)


@query(
    "SELECT method, status, le, CASE WHEN le IS NULL THEN n WHEN le = 10 THEN b10 WHEN le = 50 THEN b50 WHEN le = 90 THEN b90 ELSE b99 END AS n, "
    "CASE WHEN le IS NULL THEN n WHEN le = 10 THEN b10 WHEN le = 50 THEN b50 WHEN le = 90 THEN b90 ELSE b99 END >= n * 0.99 AS holds FROM (SELECT event_type AS method, value > 50 AS status, count(*) AS n, "
    "count(*) FILTER (value <= 10) AS b10, count(*) FILTER (value <= 50) AS b50, count(*) FILTER (value <= 90) AS b90, count(*) FILTER (value <= 99) AS b99 FROM events GROUP BY ALL), (SELECT unnest([10, 50, 90, 99, NULL])::DOUBLE AS le)"
)
def request_histogram(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("method"), (F.col("value") > 50).alias("status"), F.col("value").alias("duration"))
    return checks.request_histogram(e, list(_BUCKETS))


@query("SELECT client, ts, n FROM (SELECT user_id % 5 AS client, ts, count(*) OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 3")
def rate_limit_sliding(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    found = checks.over_sliding_rate(e, 3600, 3)
    return found.withColumn("ts", F.col("ts").cast(table(spark, sf, "events").schema["ts"].dataType))


@query("SELECT event_id, user_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def retention_anti_hold(spark, sf):
    holds = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id"))
    return governance.expired(table(spark, sf, "events"), "ts", datetime(2024, 1, 15), holds, "user_id").select("event_id", "user_id", "ts")


@query("SELECT n_nationkey, n_name, r_name AS region, r_regionkey + 100 AS group_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def placement_routing(spark, sf):
    streams = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("region"))
    groups = table(spark, sf, "region").select(F.col("r_name").alias("region"), (F.col("r_regionkey") + 100).alias("group_id"))
    return governance.require_placed(governance.placed(streams, groups)).select("n_nationkey", "n_name", "region", "group_id")


# ---------------------------------------------------------------- projections and invariants


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def projection_left_join_agg(spark, sf):
    return projections.customer_orders(table(spark, sf, "customer"), table(spark, sf, "orders"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY user_id")
def projection_incremental(spark, sf):
    found = run_projection(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema, "user_id", "value")
    return found.withColumn("total", F.round("total", 4))


@query("SELECT user_id, count(*) AS n, max(value) AS top FROM events WHERE event_id % 7 <> 3 GROUP BY user_id")
def projection_refresh(spark, sf):
    e = table(spark, sf, "events")
    agg = lambda x: x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return projections.refresh(agg(e), e.where("event_id % 7 <> 3"), e.where("event_id % 7 = 3"), "user_id", agg)


@query(f"WITH l AS {_LOG} SELECT stream, \"offset\", sha256(payload || '?') AS read_hash, sha256(payload) AS committed_hash FROM l WHERE pos % 101 = 0")
def log_consistency(spark, sf):
    rows = event_log(spark, sf)
    held = materialize(rows.select("stream", "offset", "pos", F.sha2("payload", 256).alias("hash"), F.sha2(F.concat("payload", F.lit(b"?")), 256).alias("other")), "committed")
    read = held.withColumn("hash", F.when(F.col("pos") % 101 == 0, F.col("other")).otherwise(F.col("hash")))
    return checks.log_mismatches(read, held)


@query(f"SELECT stream, \"offset\", 2::BIGINT AS n_hashes, 3::BIGINT AS n_replicas FROM {_LOG} WHERE pos % 89 = 0")
def replica_consistency(spark, sf):
    rows = event_log(spark, sf).select("stream", "offset", "pos", F.sha2("payload", 256).alias("hash"))
    bad = F.when((F.col("pos") % 89 == 0) & (F.col("replica") == 2), F.lit("other")).otherwise(F.col("hash"))
    return checks.replica_conflicts(rows.withColumn("replica", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("hash", bad))


@query("SELECT o_orderkey AS position, count(DISTINCT l_suppkey % 5) AS votes, count(DISTINCT l_suppkey % 5) >= 3 AS committed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def quorum_commit(spark, sf):
    votes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("position"), (F.col("l_suppkey") % 5).alias("replica"))
    # an order counts once however often it is there, so the votes are summed up before they meet the orders
    return checks.quorums(votes, 5, range(-4, 5)).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("position")), "position", "left_semi")


_HISTORY = (
    "h AS MATERIALIZED (SELECT event_id // 3 % 7 AS key, CASE WHEN event_id % 3 = 0 THEN 'w' ELSE 'r' END AS op, event_id * 10 AS \"begin\", event_id * 10 + 5 AS \"end\", "
    "CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id - 1 ELSE event_id - 2 - CASE WHEN event_id % 2 = 0 THEN 21 ELSE 0 END END AS value FROM events)"
)


@query(
    f"WITH {_HISTORY}, w AS (SELECT key, value, \"begin\" AS wb, \"end\" AS we FROM h WHERE op = 'w') SELECT DISTINCT r.key, r.value, r.\"begin\" FROM h r LEFT JOIN w ON w.key = r.key AND w.value = r.value WHERE r.op = 'r' AND "
    "(w.wb IS NULL OR w.wb > r.\"end\" OR EXISTS (SELECT 1 FROM w o WHERE o.key = r.key AND o.wb > w.we AND o.we < r.\"begin\"))"
)
def stale_reads(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    value = F.when(i % 3 == 0, i).when(i % 3 == 1, i - 1).otherwise(i - 2 - F.when(i % 2 == 0, 21).otherwise(0))
    return checks.stale_reads(e.select((F.floor(i / 3) % 7).alias("key"), F.when(i % 3 == 0, "w").otherwise("r").alias("op"), (i * 10).alias("begin"), (i * 10 + 5).alias("end"), value.alias("value")))


@query("SELECT event_id, user_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT BETWEEN 10 AND 20")
def json_payload_filter(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", "user_id", k.alias("k")).where(F.col("k").between(10, 20))


@query(f"WITH RECURSIVE {_CHAIN} SELECT stream, sha256(h_first || h_last) AS sealed, n FROM (SELECT stream, arg_min(h, \"offset\") AS h_first, arg_max(h, \"offset\") AS h_last, count(*) AS n FROM chain GROUP BY stream)")
def sealed_checkpoint(spark, sf):
    rows = chained_log(spark, sf).groupBy("stream").agg(F.min_by("hash", "offset").alias("first"), F.max_by("hash", "offset").alias("last"), F.count(F.lit(1)).alias("n"))
    return rows.select("stream", F.sha2(F.concat("first", "last"), 256).alias("sealed"), "n")


_MERKLE = SQL["merkle_roots"].removeprefix("WITH RECURSIVE ")


@query(
    f"WITH RECURSIVE {_CHAIN}, m AS (WITH RECURSIVE {_MERKLE}) SELECT stream, max(pos) AS position, arg_max(lower(hex(h)), \"offset\") AS log_hash, any_value(root) AS state_root, any_value(sealed_at) AS sealed_at "
    "FROM chain JOIN log USING (stream, \"offset\") JOIN m USING (stream) JOIN (SELECT event_type AS stream, max(ts) AS sealed_at FROM events GROUP BY event_type) USING (stream) GROUP BY stream"
)
def sealed_checkpoint_state(spark, sf):
    """The position, the log's hash there, the Merkle root of the state and the time of each stream's seal."""
    positions = event_log(spark, sf).select("stream", "offset", "pos")
    head = chained_log(spark, sf).join(positions, ["stream", "offset"])
    times = table(spark, sf, "events").groupBy(F.col("event_type").alias("stream")).agg(F.max("ts").alias("sealed_at"))
    return log.sealed(head, merkle_roots(spark, sf), times)
