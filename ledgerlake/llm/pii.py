"""Personal data by exact base patterns and a semi-Markov conditional random field.

Base spans follow fixed patterns with checks (fixed values below). The model then reads windows of
text around digits, @ and +: candidate segments of MAX_TOKENS tokens or fewer are scored by features
of the whole span and its neighbours and by a weight for each kind after the one before it, and a
dynamic program over segments chooses boundaries and types together. Its spans that meet no base span
are added; base spans always stay. A token outside of every segment is labelled O, as is all text that
has no trigger character near it; white space between segments passes the last label on.

The weights are fitted by exact gradients of the likelihood (forward and backward sums over segments)
on windows of at most SAMPLE documents, chosen by a hash of the id: WINDOWS at most, of WINDOW_CHARS
characters or fewer. Their base spans are labels, and so are spans that were made of these: parted by
other signs, spaced, or written with brackets (FORMS), which the patterns miss. Everything else covers
whole texts of all rows; a long window is decoded in slices of SLICE tokens, so memory does not grow.

Defined results: a null text is empty; very long texts are read whole; offsets are code points, end
exclusive; rows that repeat an id are judged apart; with nothing to learn from, as in an empty table,
only base spans are returned; of equal scores, the longer outside stretch and the kind listed first win;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE, EPOCHS, STEP, DECAY = 8_000, 6, 0.3, 1e-3
#: Tokens of a segment, words kept on each side of a trigger, windows that are learned from.
MAX_TOKENS, NEAR, WINDOWS, WINDOW_CHARS = 16, 1, 1_500, 500
#: Tokens of a long window that are decoded at once, with MAX_TOKENS more to look ahead.
SLICE = 512
#: The label of text outside of segments.
O = len(KINDS)

# The base patterns. Lookbehinds and possessive repeats only save useless attempts.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) by kind, then begin."""
    out = [(0, a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(_digits(m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


TOKEN = re.compile(r"[^\W\d_]+|\d+|\s+|[^\w\s]|_", re.S)
TRIGGER = re.compile(r"[0-9@+]")
WORD = re.compile(r"\S+")


def windows(text: str) -> list[tuple[int, int]]:
    """Spans of text around trigger characters: the words that have them and NEAR words on each side."""
    if not TRIGGER.search(text):
        return []
    words = [(m.start(), m.end(), bool(TRIGGER.search(m[0]))) for m in WORD.finditer(text)]
    out: list[list[int]] = []
    reach = -1
    for i, (_, _, hot) in enumerate(words):
        if hot:
            lo, hi = max(0, i - NEAR), min(len(words) - 1, i + NEAR)
            if out and lo <= reach:
                out[-1][1] = words[hi][1]
            else:
                out.append([words[lo][0], words[hi][1]])
            reach = hi
    return [(a, b) for a, b in out]


DIGIT_STEPS = (1, 4, 8, 12, 16, 20)


def span_features(text: str, a: int, b: int) -> list[str]:
    """Features of the whole span text[a:b] and of the characters beside it."""
    s = text[a:b]
    digits = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    letters = sum(c.isalpha() for c in s)
    at, dots = s.count("@"), s.count(".")
    plain = re.sub(r"[\s\[\](){}]", "", s)
    parts = plain.split(".")
    left, right = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    kind = lambda c: "s" if c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else c if c in "@.+-_%" else "p"
    return [
        "bias",
        f"digits{sum(len(digits) >= x for x in DIGIT_STEPS)}",
        f"groups{min(len(groups), 5)}",
        f"letters{0 if not letters else 1 if letters < 4 else 2}",
        f"at{min(at, 2)}",
        f"dots{min(dots, 4)}",
        f"domain{at == 1 and '.' in plain[plain.find('@') + 2 : -1]}",
        f"octets{len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[:6]) <= 255 for p in parts)}",
        f"luhn{16 <= len(digits) <= 19 and not letters and luhn(digits)}",
        f"first{kind(s[0])}",
        f"last{kind(s[-1])}",
        f"space{min(2, sum(c.isspace() for c in s))}",
        f"brackets{'(' in s and ')' in s}{'[' in s and ']' in s}",
        f"parted{len({x for x in re.findall(r'(?<=[0-9])[^0-9]+(?=[0-9])', s)})}",
        f"whole{s.count('[') == s.count(']') and s.count('(') == s.count(')')}",
        f"odd{any(not (c.isalnum() or c.isspace() or c in '@.+-_%()[]') for c in s)}",
        f"left{kind(left)}",
        f"right{kind(right)}",
        f"cut{left.isalnum() and s[0].isalnum() or right.isalnum() and s[-1].isalnum() or left in '@+' or right == '@'}",
        f"follow{right in '.-' and b + 1 < len(text) and text[b + 1].isalnum()}",
    ]


@dataclass(frozen=True)
class Lattice:
    """The segments of one window: token bounds, which tokens are white space, and for each segment its ends
    and features."""

    bounds: np.ndarray
    blank: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    features: np.ndarray


def lattice(text: str, a: int, b: int, index: dict[str, int], grow: bool = False, tokens: list | None = None) -> Lattice:
    tokens = [(m.start() + a, m.end() + a) for m in TOKEN.finditer(text[a:b])] if tokens is None else tokens
    bounds = np.array([t[0] for t in tokens] + [tokens[-1][1] if tokens else b])
    begin, end, features = [], [], []
    hot = [bool(TRIGGER.search(text, x, y)) for x, y in tokens]
    blank = [text[x].isspace() for x, _ in tokens]
    for i in range(len(tokens)):
        if blank[i]:
            continue
        seen = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            seen += hot[j]
            if not seen or blank[j] or tokens[j][1] - tokens[i][0] < 6:
                continue
            f = span_features(text, tokens[i][0], tokens[j][1])
            if grow:
                for x in f:
                    index.setdefault(x, len(index))
            begin.append(i)
            end.append(j + 1)
            features.append([index.get(x, -1) for x in f])
    return Lattice(bounds, np.array(blank, bool), np.array(begin, int), np.array(end, int), np.array(features, int).reshape(len(begin), len(features[0]) if features else 0))


def segment_scores(lat: Lattice, weights: np.ndarray) -> np.ndarray:
    """Scores of the segments for each kind; the last row of weights is for unknown features, all 0."""
    return weights[lat.features].sum(1) if len(lat.begin) else np.zeros((0, len(KINDS)))


def _by(ends: np.ndarray, n: int) -> list[np.ndarray]:
    """The segments at each place."""
    order = np.argsort(ends, kind="stable")
    return np.split(order, np.searchsorted(ends[order], np.arange(1, n + 1)))


def decode(lat: Lattice, weights: np.ndarray, steps: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's spans (kind, begin, end). steps[x, y] is the weight of label y after x."""
    n = len(lat.bounds) - 1
    score = segment_scores(lat, weights)
    best = np.full((n + 1, O + 1), -np.inf)
    best[0, O] = 0
    back: list[dict] = [{} for _ in range(n + 1)]
    by_end = _by(lat.end, n)
    for e in range(1, n + 1):
        if lat.blank[e - 1]:
            best[e] = best[e - 1]
            back[e] = {y: (y, e - 1, None) for y in range(O + 1)}
        else:
            from_any = best[e - 1] + steps[:, O]
            y = int(from_any.argmax())
            best[e, O], back[e][O] = from_any[y], (y, e - 1, None)
        for s in by_end[e]:
            i = int(lat.begin[s])
            values = best[i][:, None] + steps[:, :O] + score[s][None, :]
            before = values.argmax(0)
            for k in range(O):
                if values[before[k], k] > best[e, k]:
                    best[e, k], back[e][k] = values[before[k], k], (int(before[k]), i, k)
    out, e = [], n
    y = O if best[n, O] >= best[n].max() else int(best[n].argmax())
    while e:
        before, i, k = back[e][y]
        if k is not None:
            out.append((k, int(lat.bounds[i]), int(lat.bounds[e])))
        e, y = i, before
    return out[::-1]


def gradient(lat: Lattice, gold: list[tuple[int, int]], weights: np.ndarray, steps: np.ndarray, out: np.ndarray, out_steps: np.ndarray) -> None:
    """Adds the log-likelihood's gradients for gold segments (segment, kind) to out and out_steps."""
    n = len(lat.bounds) - 1
    score = segment_scores(lat, weights)
    ahead, behind = np.full((n + 1, O + 1), -np.inf), np.full((n + 1, O + 1), -np.inf)
    ahead[0, O], behind[n] = 0, 0
    by_end, by_begin = _by(lat.end, n), _by(lat.begin, n)
    for e in range(1, n + 1):
        if lat.blank[e - 1]:
            ahead[e] = ahead[e - 1]
        else:
            ahead[e, O] = np.logaddexp.reduce(ahead[e - 1] + steps[:, O])
        if len(by_end[e]):
            s = by_end[e]
            into = np.logaddexp.reduce(ahead[lat.begin[s]][:, :, None] + steps[None, :, :O], 1) + score[s]
            ahead[e, :O] = np.logaddexp(ahead[e, :O], np.logaddexp.reduce(into, 0))
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1] if lat.blank[i] else steps[:, O] + behind[i + 1, O]
        if len(by_begin[i]):
            s = by_begin[i]
            onto = steps[:, None, :O] + (score[s] + behind[lat.end[s], :O])[None, :, :]
            behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(onto.reshape(O + 1, -1), 1))
    whole = behind[0, O]
    for e in np.flatnonzero(~lat.blank):
        out_steps[:, O] -= np.exp(ahead[e] + steps[:, O] + behind[e + 1, O] - whole)
    if len(score):
        p = np.exp(ahead[lat.begin][:, :, None] + steps[None, :, :O] + (score + behind[lat.end, :O])[:, None, :] - whole)
        out_steps[:, :O] -= p.sum(0)
        of = p.sum(1)
        for s, k in gold:
            of[s, k] -= 1
        np.add.at(out, lat.features.reshape(-1), -np.repeat(of, lat.features.shape[1], 0))
    # the labels' own steps
    at, label, starts = 0, O, {int(lat.begin[s]): (int(lat.end[s]), k) for s, k in gold}
    while at < n:
        if at in starts:
            at, k = starts[at]
            out_steps[label, k] += 1
            label = k
        else:
            if not lat.blank[at]:
                out_steps[label, O] += 1
                label = O
            at += 1


#: Ways to write a span that the base patterns miss, by kind.
FORMS = {
    0: (lambda s: s.replace("@", " @ "), lambda s: s.replace("@", "(@)"), lambda s: s[: s.index("@")] + s[s.index("@") :].replace(".", "[.]")),
    1: (lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", " . "), lambda s: s.replace(".", "(.)")),
    2: (lambda s: _grouped(s, "."), lambda s: _grouped(s, "/"), lambda s: _grouped(s, "  "), lambda s: _grouped(s, " - ")),
    3: (lambda s: _grouped(s, "/"), lambda s: "00" + _grouped(s[1:], " "), lambda s: _grouped(s, "_")),
}


def _grouped(s: str, sign: str) -> str:
    """The groups of digits in s, or fours of them, with the sign between."""
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    groups = groups if len(groups) > 1 else [digits[i : i + 4] for i in range(0, len(digits), 4)]
    return ("+" if s.startswith("+") else "") + sign.join(groups)


def rewritten(text: str, spans: list[tuple[int, int, int]], number: int) -> tuple[str, list[tuple[int, int, int]]]:
    """text with each span (kind, begin, end) in another form, the number-th, and the spans there."""
    out, moved, at = [], [], 0
    for k, a, b in sorted(spans, key=lambda x: x[1]):
        if a < at:
            continue
        form = FORMS[k][number % len(FORMS[k])](text[a:b])
        out.append(text[at:a])
        begin = sum(map(len, out))
        out.append(form)
        moved.append((k, begin, begin + len(form)))
        at = b
    return "".join(out) + text[at:], moved


@dataclass(frozen=True)
class Model:
    index: dict
    weights: np.ndarray
    steps: np.ndarray

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        if not self.index:
            return []
        out: list[tuple[int, int, int]] = []
        for a, b in windows(text):
            tokens = [(m.start() + a, m.end() + a) for m in TOKEN.finditer(text[a:b])]
            for i in range(0, len(tokens), SLICE):
                part = tokens[i : i + SLICE + MAX_TOKENS]
                stop = tokens[i + SLICE][0] if i + SLICE < len(tokens) else b
                for s in decode(lattice(text, a, b, self.index, tokens=part), self.weights, self.steps):
                    if s[1] < stop and (not out or s[1] >= out[-1][2]):
                        out.append(s)
        return out


def fit(texts: list[str]) -> Model:
    """Learn from the windows of texts, with their base spans as labels, and from each of these windows again
    with its spans in another form."""
    index: dict[str, int] = {}
    data = []

    def learn(text: str, spans: list[tuple[int, int, int]], a: int, b: int):
        lat = lattice(text, a, b, index, grow=True)
        at = {(int(lat.bounds[i]), int(lat.bounds[e])): s for s, (i, e) in enumerate(zip(lat.begin, lat.end))}
        gold, last = [], 0
        for k, x, y in sorted(spans, key=lambda s: s[1]):
            if (x, y) in at and x >= last:
                gold.append((at[x, y], k))
                last = y
        data.append((lat, gold))

    for text in texts:
        found = windows(text)
        spans = base_spans(text) if found else []
        for a, b in found:
            if len(data) >= 2 * WINDOWS:
                break
            learn(text, spans, a, b)
            mine = [(k, x - a, y - a) for k, x, y in spans if a <= x and y <= b]
            if mine:
                other, moved = rewritten(text[a:b], mine, len(data))
                learn(other, moved, 0, len(other))
    weights, steps = np.zeros((len(index) + 1, len(KINDS))), np.zeros((O + 1, O + 1))
    if not any(g for _, g in data):
        return Model({}, weights, steps)
    total, total_steps = np.full(weights.shape, 1e-2), np.full(steps.shape, 1e-2)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(data)):
            out, out_steps = np.zeros(weights.shape), np.zeros(steps.shape)
            gradient(*data[i], weights, steps, out, out_steps)
            out -= DECAY * weights
            out_steps -= DECAY * steps
            out[-1] = 0
            total += out**2
            total_steps += out_steps**2
            weights += STEP * out / np.sqrt(total)
            steps += STEP * out_steps / np.sqrt(total_steps)
    return Model(index, weights, steps)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the documents of a hash sample that have a trigger character; at most `sample` are read."""
    n = docs.count()
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n)))
    rows = docs.where(part & F.col(text_col).rlike("[0-9@+]")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def cutouts(batches):
        for batch in batches:
            found = [(i, text[max(0, a - 1) : b + 2]) for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) for a, b in windows(text)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["id", "text"])

    short = rows.withColumn("id", F.col("id").cast("long")).mapInArrow(cutouts, "id long, text string").where(F.length("text") <= WINDOW_CHARS)
    # ordered by a hash, so that the choice does not hang on the order of tasks
    chosen = short.orderBy(F.xxhash64("id", "text"), "id", "text").limit(WINDOWS).collect()
    return fit([r["text"] for r in chosen])


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans
    (all), n_added."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = [s for s in model.spans(text) if all(s[2] <= a or b <= s[1] for _, a, b in base)]
                count = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((*count, hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + more)), len(more)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
