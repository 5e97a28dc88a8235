"""The append-only event log: offsets, appends with a hash chain, reads and checks.

A log row has stream, offset (from 0), kind (0 data, 1 checkpoint, 2 tombstone), prev_hash, hash,
payload and crc. hash = SHA-256(prev_hash, kind byte, payload); the first record has no prev_hash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.errors import ChainVerificationFailed, CorruptedRecord, StreamIdTaken, UnexpectedStreamOffset
from ledgerlake.operators.ordered import dense_offsets, sum_before

CHECKPOINT_EVERY = 1000
DATA, CHECKPOINT, TOMBSTONE = 0, 1, 2
ZEROS = "X'" + "00" * 32 + "'"


def record_hash(prev: Column, kind: Column, payload: Column) -> Column:
    """SHA-256 over the previous hash (nothing for the first record), one byte of kind and the payload."""
    one = F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0"))
    return F.unhex(F.sha2(F.concat(F.coalesce(prev, F.lit(b"")), one, payload), 256))


def chained(rows: DataFrame, heads: dict | None = None) -> DataFrame:
    """rows(stream, offset, kind, payload) with prev_hash and hash, each stream's records in order.

    A chain is sequential, so a stream is folded by one task, batch by batch: only the last hash is
    held. heads gives the hashes that streams go on from, for appends. A checkpoint record without a payload
    gets its own: the hash before it (zeros for none) and the number of records with it."""
    known = dict(heads or {})
    schema = rows.select("stream", "offset", "kind", "payload").schema.add("prev_hash", "binary").add("hash", "binary")

    def run(batches):
        stream, last = None, None
        for batch in batches:
            prevs, hashes, payloads = [], [], []
            for s, o, k, p in zip(*[batch.column(c).to_pylist() for c in ("stream", "offset", "kind", "payload")]):
                if s != stream:
                    stream, last = s, known.get(s)
                prevs.append(last)
                if k == CHECKPOINT and p is None:
                    p = checkpoint_payload(last, o + 1)
                payloads.append(p)
                last = hashlib.sha256((last or b"") + bytes([k]) + p).digest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(payloads, pa.binary()), pa.array(prevs, pa.binary()), pa.array(hashes, pa.binary())], names=[*batch.schema.names, "prev_hash", "hash"])

    ordered = rows.select("stream", "offset", "kind", "payload").repartition("stream").sortWithinPartitions("stream", "offset")
    return ordered.mapInArrow(run, schema)


def checkpoint_payload(before: bytes | None, records: int) -> bytes:
    """32 bytes of chain hash and the record count as an unsigned long, lowest byte first."""
    return (before or bytes(32)) + records.to_bytes(8, "little")


def with_checkpoints(rows: DataFrame, every: int = CHECKPOINT_EVERY, explicit: DataFrame | None = None) -> DataFrame:
    """rows(stream, offset, payload) of data records as chained records with checkpoints between them: one after
    every `every` data records, or, with explicit(stream, after), after the data offsets named there alone."""
    data = rows.select("stream", "offset", F.lit(DATA).alias("kind"), "payload")
    if explicit is None:
        moved = data.withColumn("offset", F.col("offset") + F.floor(F.col("offset") / every))
        due = rows.where((F.col("offset") + 1) % every == 0).select("stream", (F.col("offset") + 1 + F.floor(F.col("offset") / every)).alias("offset"))
    else:
        marks = explicit.select("stream", F.col("after").cast("long").alias("after")).distinct()
        before = data.withColumn("_mark", F.lit(0)).unionByName(marks.select("stream", F.col("after").alias("offset"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("binary").alias("payload"), F.lit(1).alias("_mark")))
        summed = sum_before(before.withColumn("_key", F.col("offset") * 2 + F.col("_mark")), "stream", "_key", F.col("_mark"), "_marks")
        shifted = summed.withColumn("offset", F.col("offset") + F.col("_marks") + F.col("_mark"))
        moved, due = shifted.where("_mark = 0").select(*data.columns), shifted.where("_mark = 1").select("stream", "offset")
    marks = due.select("stream", "offset", F.lit(CHECKPOINT).alias("kind"), F.lit(None).cast("binary").alias("payload"))
    return chained(moved.unionByName(marks))


def with_crc(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", F.crc32("payload"))


def append(log: DataFrame, batch: DataFrame, expected: dict[str, int]) -> DataFrame:
    """The rows to add for batch(stream, n, payload), n being the order within the batch: refused unless
    every stream is at its expected offset (0 for a new one)."""
    names = list(expected)
    tails = log.where(F.col("stream").isin(names)).groupBy("stream").agg(F.max(F.struct("offset", "hash")).alias("t")).collect()  # one row per stream of the batch
    at = {r["stream"]: (r["t"]["offset"] + 1, bytes(r["t"]["hash"])) for r in tails}
    for s in names:
        if at.get(s, (0, None))[0] != expected[s]:
            raise UnexpectedStreamOffset(expected[s], at.get(s, (0, None))[0])
    base = F.coalesce(*[F.when(F.col("stream") == s, F.lit(expected[s])) for s in names], F.lit(0)).cast("long")
    rows = batch.select("stream", (F.col("n") + base).alias("offset"), F.lit(0).alias("kind"), "payload")
    return with_crc(chained(rows, {s: h for s, (_, h) in at.items()}))


def chain_breaks(log: DataFrame) -> DataFrame:
    """(stream, offset, problem) of records whose hash, link, offset or first link is wrong, one row per
    stream and offset. Every record meets its predecessor by an equi-join, so the check is parallel within a
    stream too.

    A NULL hash, payload or kind is as wrong as another one (hash); an offset that several records have is
    doubled; a record whose predecessor is missing follows a gap; a NULL offset is a gap of its own."""
    own = log.groupBy("stream", "offset").agg(F.count(F.lit(1)).alias("times"), F.max("hash").alias("before"))
    prev = own.select("stream", (F.col("offset") + 1).alias("offset"), "before", F.lit(True).alias("follows"))
    at = log.join(own.select("stream", "offset", "times"), ["stream", "offset"], "left").join(prev, ["stream", "offset"], "left")
    zero = F.expr(ZEROS)
    link = F.when(F.col("prev_hash") == zero, F.lit(None)).otherwise(F.col("prev_hash"))
    right = record_hash(F.col("prev_hash"), F.col("kind"), F.col("payload"))
    problem = (
        F.when(F.col("offset").isNull(), "gap")
        .when(F.col("times") > 1, "doubled")
        .when(F.col("hash").isNull() | ~F.col("hash").eqNullSafe(right), "hash")
        .when((F.col("offset") == 0) & link.isNotNull(), "genesis")
        .when((F.col("offset") != 0) & F.col("follows").isNull(), "gap")
        .when((F.col("offset") != 0) & ~F.col("prev_hash").eqNullSafe(F.col("before")), "link")
    )
    return at.select("stream", "offset", problem.alias("problem")).where("problem is not null").distinct()


def crc_breaks(log: DataFrame) -> DataFrame:
    """Records whose checksum is not their payload's; a NULL payload or checksum is a break."""
    return log.where(F.col("payload").isNull() | ~F.crc32("payload").eqNullSafe(F.col("crc"))).select("stream", "offset")


def checkpoints(log: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Positions at which the policy asks for a checkpoint, with its content."""
    due = log.where((F.col("offset") + 1) % every == 0)
    return due.select("stream", "offset", F.coalesce("prev_hash", F.expr(ZEROS)).alias("chain_hash"), (F.col("offset") + 1).alias("record_count"))


def verified_suffix(log: DataFrame, stream: str, start: int, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Data records from start on, after the chain since the checkpoint before start was verified."""
    mine = log.where(F.col("stream") == stream)
    mark = mine.where(((F.col("offset") + 1) % every == 0) & (F.col("offset") <= start)).agg(F.max("offset")).first()[0]
    part = mine if mark is None else mine.where(F.col("offset") >= mark)
    wrong = chain_breaks(part).where(F.lit(mark is None) | ~((F.col("offset") == F.lit(mark or 0)) & (F.col("problem") == "gap"))).first()
    if wrong:
        raise ChainVerificationFailed(f"{stream} at offset {wrong['offset']}: {wrong['problem']}")
    return part.where((F.col("offset") >= start) & (F.col("kind") == 0))


def read(log: DataFrame, stream: str, start: int = 0, max_bytes: int | None = None, verify: str = "full") -> DataFrame:
    """Payloads of a stream from an offset on. The budget is soft: the record that passes it is still
    returned. verify: "full" from the first record, "checkpoint" from the last one before, or "none"."""
    mine = log.where(F.col("stream") == stream)
    if verify == "full" and (wrong := chain_breaks(mine).first()):
        raise ChainVerificationFailed(f"{stream} at offset {wrong['offset']}: {wrong['problem']}")
    if verify == "checkpoint":
        mine = verified_suffix(log, stream, start)
    if crc_breaks(mine).first():
        raise CorruptedRecord(stream)
    found = mine.where((F.col("offset") >= start) & (F.col("kind") == 0))
    return found if max_bytes is None else within_budget(found, max_bytes)


def within_budget(rows: DataFrame, max_bytes: int) -> DataFrame:
    summed = sum_before(rows, "stream", "offset", F.octet_length("payload"), "bytes_before")
    return summed.where(F.col("bytes_before") < max_bytes)


def next_cursor(start: int, returned: int) -> int | None:
    return start + returned if returned else None


def commitment_proof(log: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """For each id whether, where and under which hash it was committed."""
    return ids.join(log.select(id_col, "stream", "offset", "hash"), id_col, "left").withColumn("committed", F.col("offset").isNotNull())


def first_submits(submits: DataFrame, id_col: str, order: str) -> DataFrame:
    """The first submission of each id, as an aggregate."""
    rest = [c for c in submits.columns if c not in (id_col, order)]
    first = submits.groupBy(id_col).agg(F.min(F.struct(order, *rest)).alias("f"), F.count(F.lit(1)).alias("times"))
    return first.select(id_col, "f.*", "times")


def loss_report(recoveries: DataFrame) -> DataFrame:
    """recoveries(id, discarded_from, discarded_to) -> what was lost; the range is half open."""
    n = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("discarded_to") - F.col("discarded_from"), F.lit(0)).cast("long"))
    lost = n > 0
    return recoveries.select("id", n.alias("affected"), F.when(lost, F.col("discarded_from")).alias("first"), F.when(lost, F.col("discarded_to") - 1).alias("last"), lost.alias("had_data_loss"))


def sealed(head: DataFrame, roots: DataFrame, times: DataFrame) -> DataFrame:
    """Checkpoints to seal: head(stream, pos, hash), roots(stream, root) of the state, times(stream, sealed_at)."""
    last = head.groupBy("stream").agg(F.max(F.struct("pos", "hash")).alias("h"))
    found = last.join(roots, "stream").join(times, "stream")
    return found.select("stream", F.col("h.pos").alias("position"), F.lower(F.hex("h.hash")).alias("log_hash"), F.col("root").alias("state_root"), "sealed_at")


def range_proof(log: DataFrame) -> DataFrame:
    """What proves an exported range of chained records, per stream: the first record's previous hash, the last
    hash, the offsets and the number of records."""
    ends = log.groupBy("stream").agg(F.min_by("prev_hash", "offset").alias("p"), F.max_by("hash", "offset").alias("h"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.count(F.lit(1)).alias("n"))
    return ends.select("stream", "first", "last", "n", F.lower(F.hex("p")).alias("first_prev_hash"), F.lower(F.hex("h")).alias("last_hash"))


STREAMS = "id long, name string, region long"


def streams_table(spark: SparkSession) -> DataFrame:
    """An empty table of streams."""
    return spark.createDataFrame([], STREAMS)


def create_streams(known: DataFrame, made: DataFrame) -> DataFrame:
    """known with made(id, name, region). An id that is taken or given twice is refused; rows without one get the
    ids after the largest, by name."""
    given, free = made.where("id IS NOT NULL"), made.where("id IS NULL")
    both = known.select("id").unionByName(given.select("id"))
    twice = both.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise StreamIdTaken(twice["id"])
    first = (both.agg(F.max("id")).first()[0] or 0) + 1
    numbered = dense_offsets(free.withColumn("_all", F.lit(0)), "_all", "name", "_n").withColumn("id", F.col("_n") + first)
    return known.unionByName(given.select(known.columns)).unionByName(numbered.select(known.columns))
