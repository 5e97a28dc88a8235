"""Semantics and errors of the core library."""

import hashlib
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake import errors
from ledgerlake.functions import anonymize as A
from ledgerlake.functions import keyed
from ledgerlake.functions.blake3 import digest_all
from ledgerlake.operators import checks, governance, log, versions
from ledgerlake.operators.merkle import fold, merkle_root
from ledgerlake.operators.ordered import dense_offsets, sum_before
from ledgerlake.plans.select import Catalog, Param, Select, TableDef
from ledgerlake.queries import QUERIES
from ledgerlake.sources import records

NOW = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def users(spark):
    df = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35), (4, "Dan", None)], "id long, name string, age long")
    return Catalog().add(TableDef("users", df, ("id",), frozenset({"name"})))


def ids(df):
    return [r.id for r in df.collect()]


def test_selections(users):
    s = Select("users")
    assert len(s.build(users).columns) == 3
    assert ids(s.where("id", "=", Param(1)).bind(2).build(users)) == [2]
    assert ids(s.where("id", ">=", Param(1)).where("id", "<=", Param(2)).bind(1, 2).build(users)) == [1, 2]
    assert ids(s.where("id", "in", [1, 3]).build(users)) == [1, 3]
    assert ids(s.where("id", "=", 1).where("name", "=", "zzz").build(users)) == []
    assert ids(s.where("id", ">", 10).where("id", ">", 5).build(users)) == []
    assert ids(s.where("id", "=", 1).limit(0).build(users)) == []
    assert s.pick("name", years="age").build(users).columns == ["name", "years"]
    assert [r.name for r in s.pick("name").order_by("-age").build(users).collect()] == ["Charlie", "Alice", "Bob", "Dan"]
    assert [s.where("id", "=", 1).path(users), s.where("id", "<", 1).path(users), s.where("age", "<", 1).path(users)] == ["point", "range", "scan"]


def test_null_is_the_least_value(users):
    s = Select("users")
    assert ids(s.where("age", "<", 30).build(users)) == [2, 4]
    assert ids(s.where("age", "=", None).build(users)) == [4]
    assert ids(s.where("age", "in", [30, None]).build(users)) == [1, 4]
    assert ids(s.where("age", ">", None).build(users)) == [1, 2, 3]
    assert len(ids(s.where("age", ">=", None).build(users))) == 4
    assert ids(s.where("age", "<", None).build(users)) == [] and ids(s.where("age", "<=", None).build(users)) == [4]
    assert ids(s.order_by("age").build(users)) == [4, 2, 1, 3]


def test_errors(users):
    s = Select("users")
    with pytest.raises(errors.TableNotFound):
        Select("none").build(users)
    with pytest.raises(errors.ColumnNotFound):
        s.pick("none").build(users)
    with pytest.raises(errors.ColumnNotFound):
        s.where("Name", "=", "x").build(users)
    for n in (0, 1):
        with pytest.raises(errors.ParameterNotFound):
            s.where("id", "=", Param(n)).build(users)
    with pytest.raises(errors.TypeMismatch):
        s.where("id", "=", "1").build(users)
    with pytest.raises(errors.UnsupportedFeature):
        s.where("name", "like", "A%")
    with pytest.raises(errors.UnsupportedFeature):
        s.limit(-1)


def test_filters_reach_the_scan(spark, sf):
    made = Catalog().add(TableDef("orders", spark.read.parquet(f"{sf}/orders.parquet"), ("o_orderkey",)))
    plan = Select("orders").pick("o_orderkey").where("o_orderkey", ">=", 5).build(made)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans(), st.integers(0, 9)), min_size=1, max_size=12), st.integers(0, 13))
def test_replay_equals_versions(spark, steps, at):
    ops = spark.createDataFrame([(k, i + 1, "D" if d else "P", v) for i, (k, d, v) in enumerate(steps)], "key long, pos long, op string, value long")
    state = {}
    for k, d, v in steps[:at]:
        state.pop(k, None) if d else state.__setitem__(k, v)
    seen = versions.visible(versions.versions(ops), at).select("key", "value").collect()
    assert sorted(map(tuple, seen)) == sorted(state.items())
    assert sorted((r.key, r.value) for r in versions.state_at(ops, at).collect()) == sorted(state.items())


def test_positions(spark):
    ops = spark.createDataFrame([("a", 1, "P", "x")], "key string, pos long, op string, value string")
    with pytest.raises(errors.PositionAhead):
        versions.read_at(ops, 2)
    assert versions.next_batch(1, 2) == 2
    with pytest.raises(errors.NonSequentialBatch):
        versions.next_batch(1, 3)


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(s, i, 0, f"{s}{i}".encode()) for s in "ab" for i in range(40)]
    return log.with_crc(log.chained(spark.createDataFrame(rows, "stream string, offset long, kind int, payload binary"))).cache()


def test_chain(chain):
    last, want = b"", []
    for i in range(40):
        last = hashlib.sha256(last + b"\x00" + f"a{i}".encode()).digest()
        want.append(last)
    assert [bytes(r.hash) for r in chain.where("stream = 'a'").orderBy("offset").collect()] == want
    assert log.chain_breaks(chain).count() == 0 and log.crc_breaks(chain).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 39), st.integers(0, 1), st.integers(1, 255))
def test_any_changed_byte_is_found(chain, offset, at, flip):
    changed = F.when((F.col("offset") == offset) & (F.col("stream") == "b"), F.concat(F.substring("payload", 1, at), F.lit(bytes([flip])), F.substring("payload", at + 2, 99))).otherwise(F.col("payload"))
    bad = chain.withColumn("was", F.col("payload")).withColumn("payload", changed)
    if bad.where("was <> payload").count():
        assert [(r.stream, r.offset) for r in log.chain_breaks(bad).collect()] == [("b", offset)]
        with pytest.raises(errors.ChainVerificationFailed):
            log.read(bad, "b")


def test_append_and_read(spark, chain):
    more = spark.createDataFrame([("a", 0, b"x"), ("a", 1, b"y"), ("new", 0, b"z")], "stream string, n long, payload binary")
    with pytest.raises(errors.UnexpectedStreamOffset):
        log.append(chain, more, {"a": 39, "new": 0})
    whole = chain.unionByName(log.append(chain, more, {"a": 40, "new": 0}))
    assert log.chain_breaks(whole).count() == 0
    assert [bytes(r.payload) for r in log.read(whole, "a", 40).orderBy("offset").collect()] == [b"x", b"y"]
    assert log.read(whole, "a", 0, 5).count() == 3 and log.read(whole, "a", 0, 0).count() == 0
    assert log.read(whole, "a", 35, verify="checkpoint").count() == 7
    assert log.next_cursor(5, 0) is None and log.next_cursor(5, 2) == 7
    with pytest.raises(errors.CorruptedRecord):
        log.read(whole.withColumn("crc", F.col("crc") + 1), "a", verify="none")


def test_ordered(spark):
    rows = [(s, k) for s, n in (("hot", 300), ("b", 3)) for k in range(n)]
    df = dense_offsets(spark.createDataFrame(rows, "s string, k long").repartition(7), "s", "k")
    assert df.where("offset <> k").count() == 0
    got = sum_before(df, "s", "offset", F.col("k"), "before", block=32).collect()
    assert all(r.before == r.k * (r.k - 1) // 2 for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1025, 2049])
def test_merkle(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    df = spark.createDataFrame([("k", i, h) for i, h in enumerate(leaves)], "k string, i long, h binary")
    r = merkle_root(df, "k", "i", "h").first()
    assert bytes(r.root) == fold(leaves) and r.n_leaves == n


def test_records(chain):
    back = records.decode(records.encode(chain))
    assert back.where("not ok").count() == 0 and back.join(chain, ["stream", "offset", "payload", "kind"]).count() == 80
    cut = records.encode(chain).withColumn("record", F.expr("substring(record, 1, octet_length(record) - 1)"))
    assert records.decode(cut).where("ok").count() == 0


def test_masks(spark):
    df = spark.createDataFrame([("secret", "1234567890", "90210", 23, "é")], "a string, b string, z string, n int, u string")
    c = F.col
    got = df.select(
        A.mask_fixed(c("a"), "[REDACTED]"), A.mask_each(c("a")), A.mask_but_prefix(F.lit("555-123-4567"), 4), A.mask_but_suffix(F.lit("4111111111111111"), 4), A.partial_mask(c("b"), 0, 4), A.partial_mask(F.lit("4111111111111111"), 4, 4),
        A.generalize_age(c("n"), 5), A.generalize_age(F.lit(95), 5), A.generalize_zip(c("z"), 3), A.generalize_zip(F.lit("02134"), 5), A.bucket(F.lit(75000), 10000), A.bucket(F.lit(-7), 10), A.mask(F.lit(12345)), A.mask(c("u")),
        A.truncate_date(F.lit("2024-03-15").cast("date"), "quarter"), A.redact(c("a")), A.mask_but_prefix(c("a"), 9),
    ).first()
    assert list(got) == ["[REDACTED]", "******", "555-********", "************1111", "******7890", "4111********1111", "20-24", "90+", "902**", "02134", "70000-79999", "-10--1", "*****", "**", "2024-Q1", None, "secret"]


def test_blake3_vectors():
    """Inputs are 0, 1, ... 250, 0, 1 ...; values are the published test vectors."""
    made = digest_all([bytes(i % 251 for i in range(n)) for n in (0, 1024, 1025, 3073)])
    assert made == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", "7124b49501012f81cc7f11ca069ec9226cecb8a2c850cfe644e327d22d3e1cd3"]


def test_keyed(spark):
    key = keyed.field_key(b"k" * 32, "f")
    df = spark.createDataFrame([("v", 7)], "v string, p long")
    r = df.select(keyed.token(F.col("v"), key).alias("t"), keyed.encrypt(F.col("v"), key).alias("c"), keyed.position_nonce(F.col("p")).alias("n")).first()
    assert r.t == hashlib.sha256(key + b"v").hexdigest() and len(r.c) == 29 and bytes(r.n) == (7).to_bytes(8, "little") + b"\0" * 4
    with pytest.raises(errors.KeyRequired):
        keyed.encrypt(F.col("v"), None)


def test_rules(spark):
    df = spark.createDataFrame([("123-45-6789", "John Doe", 42, "555-123-4567", "Boston")], "ssn string, name string, age long, phone string, city string")
    rules = [governance.Rule("ssn", "redact"), governance.Rule("name", "pseudonymize"), governance.Rule("age", "generalize", (10,)), governance.Rule("phone", "partial_mask", (0, 4))]
    out, done = governance.transform(df, rules)
    r = out.first()
    assert r.ssn is None and r.name.startswith("PSEUDO-") and r.age == "40-49" and r.phone == "********4567" and r.city == "Boston"
    assert done == ["redact:ssn", "pseudonymize:name", "generalize:age", "partial_mask:phone"]
    assert [governance.Rule(p, "mask").matches(c) for p, c in (("*", "x"), ("*.id", "user.id"), ("*.id", "userid"), ("user.*", "user.a"), ("a", "b"))] == [True, True, False, True, False]


def test_tokens_and_scope(users):
    store = governance.TokenStore()
    scope = governance.Scope(frozenset({"users"}), excluded=frozenset({"age"}), max_rows=2)
    store.issue("t", scope, NOW, timedelta(hours=1), max_uses=2, purpose="audit-1", id="a")
    g = governance.Governed(users, store, lambda: NOW)
    assert g.query("a", Select("users").order_by("id")).columns == ["id", "name"]
    with pytest.raises(errors.ScopeViolation):
        g.query("a", Select("other"))
    with pytest.raises(errors.TokenExpired):
        g.query("a", Select("users"))
    store.issue("t", scope, NOW, timedelta(hours=1), purpose="audit-2", id="b")
    assert store.revoke_purpose("audit") == 2 and store.active(NOW) == []
    with pytest.raises(errors.TokenRevoked):
        store.use("b", NOW)
    with pytest.raises(errors.TokenNotFound):
        store.use("c", NOW)
    assert [a["error"] for a in g.audit] == [None, "ScopeViolation", "TokenExpired"]
    assert store.cleanup(NOW + timedelta(hours=2)) == 2
    assert governance.list_tables(users, governance.Scope()) == [("users", ["id", "name", "age"], False)]


def test_row_caps(spark):
    """A scope's max_rows replaces the default of 1,000 rows; exports go to the limit asked for, 10,000 at most."""
    made = Catalog().add(TableDef("n", spark.range(12_000), ("id",)))
    store = governance.TokenStore()
    for name, most in (("free", None), ("wide", 5000), ("tight", 20)):
        store.issue("t", governance.Scope(frozenset({"n"}), max_rows=most), NOW, timedelta(hours=1), id=name)
    g = governance.Governed(made, store, lambda: NOW)
    assert [g.query(x, Select("n").order_by("id")).count() for x in ("free", "wide", "tight")] == [1000, 5000, 20]
    assert g.query("wide", Select("n").order_by("id").limit(3000)).count() == 3000
    for name, limit, want in (("free", None, 1000), ("free", 5000, 5000), ("free", 20_000, 10_000), ("wide", 7000, 5000), ("wide", None, 1000), ("tight", 5000, 20)):
        lines, proof = g.export(name, "n", ["id"], "csv", limit)
        hashes = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(want))
        assert lines.count() == want and tuple(proof.first()) == (want, hashlib.sha256(hashes.encode()).hexdigest())


def test_checks(spark):
    empty = spark.createDataFrame([], "a string")
    assert tuple(checks.k_anonymity(empty, ["a"], 2).first()) == (0, False, 0, 0)
    five = spark.createDataFrame([("20-29,902**",)] * 2 + [("30-39,902**",)] * 3, "q string")
    assert tuple(checks.k_anonymity(five, ["q"], 2).first()) == (2, True, 2, 2)
    h = spark.createDataFrame([("k", "w", 0, 1, "a"), ("k", "w", 2, 3, "b"), ("k", "r", 4, 5, "a"), ("k", "r", 4, 5, "b")], "key string, op string, begin long, end long, value string")
    assert [r.value for r in checks.stale_reads(h).collect()] == ["a"]


def test_entry_without_text_subpackage():
    """The entry module imports without the text subpackage, which nothing else imports."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ledgerlake.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for folder, _, names in os.walk(os.path.join(root, "ledgerlake")):
        if not folder.endswith("llm"):
            assert not any("ledgerlake.llm" in open(os.path.join(folder, n)).read() for n in names if n.endswith(".py"))


def small_log(spark, n=6):
    rows = spark.createDataFrame([("s", i, 0, bytearray(b"p%d" % i)) for i in range(n)], "stream string, offset long, kind int, payload binary")
    return log.with_crc(log.chained(rows))


def test_tampering_with_nulls_and_doubles(spark):
    """Taking out a hash, a payload, a link or a record, or writing one twice, is found where it was done."""
    good = small_log(spark)
    assert log.chain_breaks(good).count() == 0 and log.crc_breaks(good).count() == 0
    at = lambda c, k, v: good.withColumn(c, F.when(F.col("offset") == k, v).otherwise(F.col(c)))
    none = F.lit(None)
    broken = {
        "last hash": (at("hash", 5, none), {(5, "hash")}),
        "a hash": (at("hash", 2, none), {(2, "hash"), (3, "link")}),
        "a payload": (at("payload", 2, none), {(2, "hash")}),
        "a link": (at("prev_hash", 3, none), {(3, "hash")}),
        "a kind": (at("kind", 4, none), {(4, "hash")}),
        "a record": (good.where("offset <> 3"), {(4, "gap")}),
        "twice": (good.unionByName(good.where("offset = 2")), {(2, "doubled")}),
        "no offset": (good.unionByName(good.where("offset = 5").withColumn("offset", none.cast("long"))), {(None, "gap")}),
        "genesis": (at("prev_hash", 0, F.col("hash")), {(0, "hash")}),
    }
    for name, (bad, want) in broken.items():
        assert {(r.offset, r.problem) for r in log.chain_breaks(bad).collect()} == want, name
    for bad in (at("payload", 2, none), at("crc", 2, none)):
        assert [r.offset for r in log.crc_breaks(bad).collect()] == [2]


def test_crc_against_zlib(spark, sf):
    import zlib

    from ledgerlake.queries import QUERIES, event_log

    want = set()
    for r in event_log(spark, sf).collect():
        payload = bytes(r.payload)
        if zlib.crc32(b"x" + payload if r.offset % 50 == 3 else payload) != zlib.crc32(payload):
            want.add((r.stream, r.offset))
    assert {(r.stream, r.offset) for r in QUERIES["crc_check"](spark, sf).collect()} == want and want


def test_explicit_checkpoints(spark):
    rows = small_log(spark).select("stream", "offset", "payload")
    marks = spark.createDataFrame([("s", 1), ("s", 4)], "stream string, after long")
    got = [(r.offset, r.kind, bytes(r.payload)) for r in log.with_checkpoints(rows, explicit=marks).orderBy("offset").collect()]
    hashes = [bytes(r.hash) for r in log.with_checkpoints(rows, explicit=marks).orderBy("offset").collect()]
    assert [(o, k) for o, k, _ in got] == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (6, 1), (7, 0)]
    assert got[2][2] == hashes[1] + (3).to_bytes(8, "little") and got[6][2] == hashes[5] + (7).to_bytes(8, "little")
    assert log.chain_breaks(log.with_checkpoints(rows, explicit=marks)).count() == 0


def test_ranges_of_a_hot_group(spark):
    """Numbers, neighbours and maxima across the borders of ranges, for one key with most rows."""
    from ledgerlake.operators.ordered import dense_offsets, most_before, neighbour

    r = __import__("random").Random(5)
    rows = [("hot" if i % 9 else f"k{i % 4}", i, r.randrange(1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    by = {}
    for g, o, v in sorted(rows, key=lambda x: x[1]):
        by.setdefault(g, []).append((o, v))
    want = {(g, o): (i, own[i + 1][1] if i + 1 < len(own) else None, own[i - 1][1] if i else None, max((v for _, v in own[:i]), default=None)) for g, own in by.items() for i, (o, _) in enumerate(own)}
    found = dense_offsets(df, "g", "o", "i")
    found = neighbour(found, "g", ("o",), F.col("v"), "after", ahead=True)
    found = neighbour(found, "g", ("o",), F.col("v"), "before", ahead=False)
    found = most_before(found, "g", ("o",), F.col("v"), "most")
    assert {(x.g, x.o): (x.i, x.after, x.before, x.most) for x in found.collect()} == want
    empty = df.where("false")
    assert dense_offsets(empty, "g", "o").count() == 0 and neighbour(empty, "g", ("o",), F.col("v"), "n", True).count() == 0


def test_ties_at_one_position(spark):
    """Of operations at one position the last in order wins; without an order, a delete."""
    rows = [("a", 1, "P", "x", 0), ("a", 1, "D", None, 1), ("b", 1, "D", None, 0), ("b", 1, "P", "y", 1), ("b", 2, "P", "z", 0)]
    ops = spark.createDataFrame(rows, "key string, pos long, op string, value string, seq long")
    assert [tuple(r) for r in versions.versions(ops).orderBy("created_at").collect()] == [("b", "y", 1, 2), ("b", "z", 2, None)]
    assert [tuple(r) for r in versions.state_at(ops).collect()] == [("b", 2, "z")]
    assert [tuple(r) for r in versions.state_at(ops, 1).collect()] == [("b", 1, "y")]
    assert versions.state_at(ops.drop("seq"), 1).count() == versions.versions(ops.drop("seq")).where("created_at = 1").count() == 0
    more = versions.apply_batch(ops, spark.createDataFrame([("c", "P", "w", 0)], "key string, op string, value string, seq long"), 3)
    assert versions.read_consistent(more, "causal", position=3).count() == 2
    for bad in (2, 4):
        with pytest.raises(errors.NonSequentialBatch):
            versions.apply_batch(more, ops.select("key", "op", "value", "seq"), bad + 1 if bad > 3 else bad)
    for mode, kw in (("causal", {"position": 4}), ("linearizable", {"head": 9}), ("at_position", {"position": 4})):
        with pytest.raises(errors.PositionAhead):
            versions.read_consistent(more, mode, **kw)
    assert versions.read_consistent(more, "eventual").count() == 2


def test_rows_fail_fast(spark):
    from pyspark.sql import types as T

    from ledgerlake.sources.rows import decode_rows

    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("b", T.BinaryType())])
    good = spark.createDataFrame([('{"id":1,"b":"aGk="}',), ('{"id":2,"b":null}',)], "p string")
    assert [(r.id, r.b and bytes(r.b)) for r in decode_rows(good, "p", schema).orderBy("id").collect()] == [(1, b"hi"), (2, None)]
    for bad in ('{"id":"x"}', "no json", '{"b":"aGk="}'):
        with pytest.raises(Exception):  # noqa: B017  (whatever Spark wraps it in)
            decode_rows(spark.createDataFrame([(bad,)], "p string"), "p", schema).collect()


def test_select_arms(users):
    assert {r.id for r in Select("users").where_any(("users.id", "=", 1), ("name", "=", None)).build(users).collect()} >= {1}
    with pytest.raises(errors.ColumnNotFound):
        Select("users").where("other.id", "=", 1)
    with pytest.raises(errors.TypeMismatch):
        Select("users").where("id", "has", 1).build(users)
    with pytest.raises(errors.TypeMismatch):
        Select("users").where_any(("id", "=", "x")).build(users)


def test_governed_trail(spark, users, tmp_path):
    """Hidden columns can't be searched or sorted by; each attempt is one record of the written trail."""
    store = governance.TokenStore()
    store.issue("t", governance.Scope(excluded=frozenset({"age"}), max_rows=1), NOW, timedelta(hours=1), id="a")
    g = governance.Governed(users, store, lambda: NOW, folder=str(tmp_path))
    for s in (Select("users").where("age", ">", 1), Select("users").order_by("-age"), Select("users").where_any(("id", "=", 1), ("age", "=", 2))):
        with pytest.raises(errors.ScopeViolation):
            g.query("a", s)
    rows, state = g.page("a", Select("users").order_by("id"))
    assert rows.count() == 1 and tuple(state.first()) == (1, True)
    lines, proof = g.export("a", "users", ["id"], "csv")
    g.register("e1", "a", "users", proof)
    g.flush()
    trail = spark.read.parquet(f"{tmp_path}/audit")
    assert sorted((r.tool, r.success, r.tenant) for r in trail.collect()) == [("export", True, "t"), ("query", False, "t"), ("query", False, "t"), ("query", False, "t"), ("query", True, "t")]
    sha = proof.first().sha256
    claims = spark.createDataFrame([("e1", sha.upper()), ("e1", "0" * 64), ("e2", sha), ("e1", None)], "export_id string, sha256 string")
    found = governance.verify_exports(spark.read.parquet(f"{tmp_path}/exports"), claims)
    assert sorted(r.message for r in found.collect()) == ["another content", "no such export", "not a hash of 64 hex digits", "verified"]


def test_json_params():
    got = governance.json_params('[null, true, "x", 7, 9223372036854775808, 1.50, [1, {"a": 2}]]')
    assert got == [None, True, "x", 7, "9223372036854775808", "1.50", '[1,{"a":2}]']


def test_streams_and_gaps(spark, tmp_path):
    known = log.create_streams(log.streams_table(spark), spark.createDataFrame([(5, "a", 0)], log.STREAMS))
    more = log.create_streams(known, spark.createDataFrame([(None, "c", 1), (None, "b", 1), (9, "d", 2)], log.STREAMS))
    assert sorted((r.id, r.name) for r in more.collect()) == [(5, "a"), (9, "d"), (10, "b"), (11, "c")]
    for bad in ([(5, "x", 0)], [(6, "x", 0), (6, "y", 0)]):
        with pytest.raises(errors.StreamIdTaken):
            log.create_streams(known, spark.createDataFrame(bad, log.STREAMS))
    # a state folder that is lost between batches stops the stream
    from ledgerlake.streaming.apply import follow, log_stream

    import shutil

    schema = "k long, v double"
    for i in range(2):
        spark.createDataFrame([(1, float(i))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i:
            shutil.rmtree(f"{tmp_path}/state/batch=0")
            with pytest.raises(Exception, match="NonSequentialBatch"):
                follow(log_stream(spark, f"{tmp_path}/in", schema), "k", "v", f"{tmp_path}/state", f"{tmp_path}/cp")
        else:
            follow(log_stream(spark, f"{tmp_path}/in", schema), "k", "v", f"{tmp_path}/state", f"{tmp_path}/cp")


def test_merkle_blake3(spark, sf):
    """Against a plain tree over the same entries."""
    import zlib

    from ledgerlake.queries import QUERIES, event_log

    entries = {}
    for r in event_log(spark, sf).orderBy("offset").collect():
        data = r.pos.to_bytes(8, "little") + (r.pos // 1000).to_bytes(8, "little") + zlib.crc32(bytes(r.payload)).to_bytes(4, "little")
        entries.setdefault(r.stream, []).append(data)
    want = {}
    for stream, leaves in entries.items():
        nodes = [bytes.fromhex(h) for h in digest_all(leaves)]
        while len(nodes) > 1:
            up = [bytes.fromhex(digest_all([nodes[i] + nodes[i + 1]])[0]) for i in range(0, len(nodes) - 1, 2)]
            nodes = up + nodes[len(up) * 2 :]
        want[stream] = (nodes[0].hex(), len(leaves))
    assert {r.stream: (r.root, r.n_leaves) for r in QUERIES["merkle_roots_blake3"](spark, sf).collect()} == want and want


def test_catalog_and_levels(spark, users):
    made = Catalog().add(users.get("users"))
    assert "users" not in made.drop("users").tables
    with pytest.raises(errors.TableNotFound):
        made.drop("users")
    bad = log.with_crc(small_log(spark)).withColumn("hash", F.when(F.col("offset") != 1, F.col("hash")))
    assert log.read(bad, "s", 3, verify="none").count() == 3
    with pytest.raises(errors.ChainVerificationFailed):
        log.read(bad, "s", 3).count()
    assert log.next_cursor(3, 2) == 5 and log.next_cursor(3, 0) is None


def test_quorums_as_bits(spark, sf):
    """Votes as bits are the distinct votes; the query sums them up before its join."""
    votes = spark.createDataFrame([(1, 0), (1, 0), (1, 4), (1, -4), (2, None), (3, 2), (3, None), (None, 1)], "position long, replica long")
    got = lambda *numbers: sorted(map(tuple, checks.quorums(votes, 5, *numbers).collect()), key=str)
    assert got(range(-4, 5)) == got() == [(1, 3, True), (2, 0, False), (3, 1, False), (None, 1, False)]
    plan = QUERIES["quorum_commit"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("bit_or")
