"""Quality classifier: a sparse rule ensemble over statistics of the text.

Small boosted trees are grown on a bounded sample of labelled rows; every path from a root is a rule,
a conjunction of thresholds on statistics. Lasso-regularised logistic regression keeps few of them,
and the kept rules become one Spark column expression over the columns of statistics.

Labels of rows in fold 0 of FOLDS (crc32 of the id as text) are never read. The sample has at most
SAMPLE labelled rows, chosen by a hash of the id; everything else covers all rows and whole texts.

Defined results: null and empty texts have the statistics of an empty text and get a score; very long texts
are read whole; an id with several labels has their mean, and of rows that repeat an id the one with the
least statistics is learned from, so reruns agree; every row gets its own score; without usable labels of
both kinds every score is the share of label 1 (0.5 if there are none, as with empty tables); extra columns
are ignored by `score` and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FOLDS, SAMPLE, THRESHOLD = 5, 20_000, 0.3
TREES, DEPTH, BINS, RATE, LASSO, LEAST = 24, 3, 32, 0.3, 0.002, 20

FEATURES = ("words", "word_bytes", "upper", "symbols", "digits", "marks", "non_ascii", "distinct", "top_word", "repeats", "short", "odd_ends", "bars", "line_words", "line_dups", "spaces")
SYMBOLS = np.frombuffer(b"#$%&*+<=>@^_`~|\\{}[]!?", np.uint8)
MARKS = np.frombuffer(b".,;:", np.uint8)
ODD_END = frozenset(b"#$%&*!@^~|")


def text_statistics(raw: bytes) -> list[float]:
    """The numbers named by FEATURES, of one whole text."""
    words = raw.split()
    n = len(words)
    size = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    m = max(1, n)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / m,
        float(count[65:91].sum()) / letters,
        float(count[SYMBOLS].sum()) / size,
        float(count[48:58].sum()) / size,
        float(count[MARKS].sum()) / m,
        float(count[128:].sum()) / size,
        len(seen) / m,
        max(seen.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        sum(len(w) <= 3 for w in words) / m,
        sum(w[-1] in ODD_END for w in words) / m,
        float(count[124]) / m,
        float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        float(count[32] + count[9:14].sum()) / size,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "stat_") -> DataFrame:
    """docs with a double column for each of FEATURES, in one Arrow pass and without a shuffle."""
    schema = StructType(list(docs.schema.fields))
    at = schema.fieldNames().index(text_col)
    for name in FEATURES:
        schema = schema.add(prefix + name, "double")

    def run(batches):
        for batch in batches:
            rows = np.array([text_statistics(t.as_py() or b"") for t in batch.column(at).cast(pa.large_binary())], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(rows[:, j]) for j in range(len(FEATURES))]], names=[*batch.schema.names, *[prefix + f for f in FEATURES]])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction: (feature, is it above?, threshold) for each step of a path."""

    steps: tuple[tuple[int, bool, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, t in self.steps:
            out &= (x[:, j] > t) if above else (x[:, j] <= t)
        return out

    def column(self, prefix: str = "stat_") -> Column:
        out = F.lit(True)
        for j, above, t in self.steps:
            c = F.col(prefix + FEATURES[j])
            out = out & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return out


@dataclass(frozen=True)
class RuleModel:
    base: float
    rules: tuple[tuple[Rule, float], ...] = field(default=())

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for rule, w in self.rules:
            z += w * rule.on(x)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "stat_") -> Column:
        z = F.lit(self.base)
        for rule, w in self.rules:
            z = z + F.when(rule.column(prefix), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple, out: list) -> np.ndarray:
    """Adds to a tree below path; returns the steps of its leaves on rows. out gets every path."""
    value = np.zeros(len(g))
    best = None
    if len(path) < DEPTH and len(rows) >= 2 * LEAST:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j in range(x.shape[1]):
            b = binned[rows, j]
            sg, sh, sn = (np.bincount(b, w, BINS) for w in (g[rows], h[rows], np.ones(len(rows))))
            cg, ch, cn = sg.cumsum()[:-1], sh.cumsum()[:-1], sn.cumsum()[:-1]
            gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
            gain[(cn < LEAST) | (len(rows) - cn < LEAST)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-3 and k < len(edges[j]) and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k)
    if best is None:
        value[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return value
    _, j, k = best
    low = binned[rows, j] <= k
    for side, above in ((rows[low], False), (rows[~low], True)):
        step = (*path, (j, above, float(edges[j][k])))
        out.append(Rule(step))
        value += _grow(x, binned, edges, g, h, side, step, out)
    return value


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Grow trees, take their paths as rules and weigh the rules by lasso logistic regression."""
    if len(y) == 0:
        return RuleModel(0.0)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return RuleModel(base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], 1)
    z, rules = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        z = z + RATE * _grow(x, binned, edges, p - y, p * (1 - p), np.arange(len(y)), (), rules)
    rules = list(dict.fromkeys(rules))
    if not rules:
        return RuleModel(base)
    m = np.stack([r.on(x) for r in rules], 1).astype(np.float32)
    _, first = np.unique(np.packbits(m.astype(bool), axis=0), axis=1, return_index=True)
    first = np.sort(first)
    rules, m = [rules[i] for i in first], m[:, first]
    scale = np.maximum(m.std(0), 1e-3)
    mean = m.mean(0)
    a = (m - mean) / scale
    w, v, b, t = np.zeros(a.shape[1], np.float32), np.zeros(a.shape[1], np.float32), base, 1.0
    step = 4 / max(1e-6, float(np.linalg.norm(a[: min(len(a), 4000)], 2) ** 2 / min(len(a), 4000)))
    for _ in range(400):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(a @ v + b)))
        b -= 2.0 * float((p - y).mean())
        new = v - step * (a.T @ (p - y).astype(np.float32)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / nt) * (new - w), new, nt
    kept = np.flatnonzero(w)
    weights = w[kept] / scale[kept]
    return RuleModel(float(b - (weights * mean[kept]).sum()), tuple((rules[i], float(c)) for i, c in zip(kept, weights)))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> RuleModel:
    """Fit on at most `sample` labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col("quality").cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    usable = known.groupBy("l_id").agg(F.avg("y").alias("y"))
    n = usable.count()
    bucket = F.pmod(F.xxhash64("l_id"), F.lit(1 << 30))
    chosen = usable.where(bucket < int((1 << 30) * min(1.0, 0.97 * sample / max(1, n)))).orderBy(bucket, "l_id").limit(sample)
    # at most `sample` rows of 16 bytes, so it can be broadcast at any size of the tables
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("d_id") == F.col("l_id"))
    stats = ["stat_" + f for f in FEATURES]
    one = with_statistics(rows.select("d_id", "y", "text")).groupBy("d_id").agg(F.min(F.struct("y", *stats)).alias("s"))
    data = one.select("d_id", "s.*").toPandas().sort_values("d_id")
    return fit_rules(data[["stat_" + f for f in FEATURES]].to_numpy(float), data["y"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    stats = with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier predicts to be good, with their own columns."""
    model = train(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    return with_statistics(rows).where(model.column() >= THRESHOLD).select("row.*")
