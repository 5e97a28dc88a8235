"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, whole. The tokens' byte lengths give their offsets; a sorted interval
join (binary search over section ends, per document) gives every token to one section. The rule for
tokens that cross a boundary is explicit: "start" gives a token to the section that has its first
byte, "end" to that of its last. The line end after a section belongs to that section.

The default sections of a text are its lines. Other spans may be given as a column of structs
(begin, end) in code points, sorted and apart; tokens outside of all of them get section -1.

The driver reads the vocabulary once, from `vocabulary` (spark.ledgerlake.vocabulary for the query), and
broadcasts it; executors need no file of their own. It may have VOCABULARY_BYTES at most.

Defined results: a null or empty text has one empty section without tokens; very long texts and runs of
one character are encoded whole; an empty table gives no rows; rows that repeat an id are counted apart;
a null id stays null; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's file, and the pattern that belongs to byte-level vocabularies of this kind.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY_BYTES = 64 << 20
#: White space that the pattern's matcher can't take at once: it goes back step by step.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{20000,}")


def vocabulary_file(path: str) -> bytes:
    with open(path, "rb") as f:
        found = f.read(VOCABULARY_BYTES + 1)
    if len(found) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return found


class Encoder:
    """Takes up a vocabulary of ranks once per task."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.cuts = pattern == PATTERN
        self.coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def tokens(self, text: str) -> list[int]:
        """PATTERN takes a run of white space as one piece, up to its last character if text follows. Long runs
        are encoded as that piece here, so the tokens are those of the whole text."""
        out, at = [], 0
        for m in LONG_SPACE.finditer(text) if self.cuts else ():
            stop = m.end() - (m.end() < len(text))
            out += self.coder.encode_ordinary(text[at : m.start()]) + self.coder._encode_single_piece(text[m.start() : stop])
            at = stop
        return out + self.coder.encode_ordinary(text[at:])

    def ends(self, text: str) -> np.ndarray:
        """The byte offset at which each token ends."""
        return np.cumsum(self.sizes[np.asarray(self.tokens(text), np.int64)])


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines, the line end included."""
    cuts = np.flatnonzero(raw == 10) + 1
    begin = np.concatenate([[0], cuts])
    return begin, np.concatenate([cuts, [len(raw)]])


def attribute(ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section, and at the last place those of none."""
    point = np.concatenate([[0], ends[:-1]]) if rule == "start" else ends - 1
    if len(ends) == 0:
        return np.zeros(len(begin) + 1, np.int64)
    at = np.searchsorted(begin, point, side="right") - 1
    inside = (at >= 0) & (point < end[np.maximum(at, 0)]) if len(begin) else np.zeros(len(point), bool)
    return np.bincount(np.where(inside, at, len(begin)), minlength=len(begin) + 1)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "start") -> DataFrame:
    """One row per section: doc_id, section, begin, end (code points), n_tokens, doc_tokens."""
    if rule not in ("start", "end"):
        raise ValueError("rule must be 'start' or 'end'")
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    if spans_col:
        cols.append(F.transform(F.col(spans_col), lambda s: F.struct(s["begin"].cast("int").alias("begin"), s["end"].cast("int").alias("end"))).alias("spans"))

    held = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))

    def run(batches):
        coder = Encoder(held.value, pattern)
        for batch in batches:
            spans = batch.column("spans").to_pylist() if spans_col else [None] * batch.num_rows
            ids = batch.column("doc_id").to_pylist()
            rows = [[] for _ in range(6)]
            for doc_id, text, given in zip(ids, batch.column("text").to_pylist(), spans):
                raw = np.frombuffer(text.encode(), np.uint8)
                starts = (raw & 0xC0) != 0x80
                points = np.concatenate([[0], np.cumsum(starts)])  # code points before each byte
                if spans_col:
                    byte_of = np.append(np.flatnonzero(starts), len(raw))
                    pick = np.array([(s["begin"], s["end"]) for s in given or []], np.int64).reshape(-1, 2).clip(0, len(byte_of) - 1)
                    begin, end = byte_of[pick[:, 0]], byte_of[pick[:, 1]]
                else:
                    begin, end = line_spans(raw)
                ends = coder.ends(text)
                n = attribute(ends, begin, end, rule)
                k = len(begin) + (1 if n[-1] else 0)
                rows[0].append(np.full(k, -1 if doc_id is None else doc_id))
                rows[1].append(np.append(np.arange(len(begin)), -1)[:k])
                rows[2].append(np.append(points[begin], 0)[:k])
                rows[3].append(np.append(points[end], points[-1])[:k])
                rows[4].append(n[:k])
                rows[5].append(np.full(k, len(ends)))
            flat = [np.concatenate(r).astype(np.int64) if r else np.zeros(0, np.int64) for r in rows]
            none = np.concatenate([np.full(len(r), i is None) for i, r in zip(ids, rows[0])]) if ids else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(flat[0], mask=none), *[pa.array(x) for x in flat[1:]]], names=["doc_id", "section", "begin", "end", "n_tokens", "doc_tokens"])

    return docs.select(*cols).mapInArrow(run, "doc_id long, section long, begin long, end long, n_tokens long, doc_tokens long")
