"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line is good or bad. Its features are its own make-up and that of the lines before and after. Documents carry labels,
lines don't: lines of good documents count as good, and those of bad documents are first taken as bad, then as what the
model fitted so far makes of them (the worst line stays bad). A document's score is the mean of its lines' marginals of
`good` from forward-backward, weighted by length, put on a probability scale by a logistic fit on the same documents.

Only the text is used. The model is fitted on at most `sample` labelled documents of those that the caller lets it learn
from, taken by a hash of their id, and at most `sample_lines` lines of them, half of each kind; a document that would go beyond
its half is passed over, and of one that is longer than a half by itself only so many first lines are learnt from, and only if
nothing else is there. Every document is scored on its whole text: short ones many at a time, a long one piece by piece, with
the messages of forward-backward carried from piece to piece, so that memory doesn't grow with a text's lines.

Defined cases: a null text is an empty one, which is one empty line and gets a score like any other; rows without a doc_id
are scored, but never learnt from; labels that are null or for unknown documents are passed over; without labels of both
kinds every score is 0.5. Repeated rows get equal scores. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialize, word_hashes

#: Lines and bytes of a piece, and of the texts that are scored at once, but for a longer line by itself.
LINES, BYTES = 1 << 15, 1 << 22
#: Fitting cuts a longer document into chains of so many lines.
CHAIN = 1000
CLASSES = 9
OF_BYTE = np.full(256, 7, np.uint8)  # what is left: other punctuation
for _i, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"!?", b"|", b"#$%&*@^~=<>+\\_{}[]")):
    OF_BYTE[list(_bytes)] = _i
OF_BYTE[128:] = 8
OWN = 13  # features of one line


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with those of their neighbours and a constant, lengths of lines, lines of each text."""
    lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    whole = b"\n".join(texts)
    raw = np.frombuffer(whole, np.uint8)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    h, first_word = word_hashes(raw, np.append(starts, len(raw)))
    n_words = np.diff(first_word)
    of_line = np.repeat(np.arange(len(ends)), n_words)
    beside = of_line[1:] == of_line[:-1]
    some = np.maximum(n_words, 1)
    same = np.bincount(of_line[1:][beside & (h[1:] == h[:-1])], minlength=len(ends)) / some
    order = np.lexsort((h, of_line))
    again = beside & (h[order][1:] == h[order][:-1])  # of_line is sorted already
    distinct = (n_words - np.bincount(of_line[1:][again], minlength=len(ends))) / some
    n = np.zeros((len(ends), CLASSES))
    step = 1 << 22
    for at in range(0, len(raw), step):
        part = raw[at : at + step]
        lo, hi = np.searchsorted(ends, [at, at + len(part) - 1])
        line = np.repeat(np.arange(lo, hi + 1), np.minimum(ends[lo : hi + 1] + 1, at + len(part)) - np.maximum(starts[lo : hi + 1], at))
        text = part != 10
        n[lo : hi + 1] += np.bincount((line[text] - lo) * CLASSES + OF_BYTE[part[text]], minlength=(hi + 1 - lo) * CLASSES).reshape(-1, CLASSES)
    full = np.maximum(size, 1)
    letters = n[:, 0] + n[:, 1] + n[:, 8]
    words = n[:, 3] + 1
    own = np.column_stack([
        np.log1p(size) / 6, size == 0, n[:, 1] / np.maximum(letters, 1), n[:, 2] / full, n[:, 3] / full,
        np.minimum(n[:, 4] / words, 2), np.minimum(n[:, 5] / words, 2), np.minimum(n[:, 6] / words, 4) / 2, np.minimum(n[:, 7] / words, 2), n[:, 8] / full, np.minimum((size - n[:, 3]) / words, 30) / 10,
        same, distinct,
    ])
    first = np.cumsum(lines) - lines
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[first + lines - 1] = 0, 0
    return np.column_stack([own, before, after, np.ones(len(own))]), size + 1.0, lines


def by_step(lines: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each position the rows of the lines there, longest texts first, and the texts' order."""
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    active = len(lines) - np.searchsorted(np.sort(lines), np.arange(lines.max()), "right")
    return [first[:a] + t for t, a in enumerate(active)], order


def marginals(good: np.ndarray, change: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2, 2), and the log of the normalising constants' product.

    `good`: each line's log-odds of good; `change`: log weights of (state, next state).
    """
    steps, _ = by_step(lines)
    local = np.column_stack([np.zeros(len(good)), good])
    top = local.max(axis=1, keepdims=True)
    local, m = np.exp(local - top), np.exp(change)
    alpha, beta = np.empty_like(local), np.ones_like(local)
    log_z = float(top.sum())
    for t, rows in enumerate(steps):
        a = local[rows] if not t else (alpha[steps[t - 1][: len(rows)]] @ m) * local[rows]
        z = a.sum(axis=1, keepdims=True)
        log_z += float(np.log(z).sum())
        alpha[rows] = a / z
    pairs = np.zeros((2, 2))
    for t in range(len(steps) - 1, 0, -1):
        rows, back = steps[t], steps[t - 1][: len(steps[t])]
        b = (local[rows] * beta[rows]) @ m.T
        joint = alpha[back][:, :, None] * m[None] * (local[rows] * beta[rows])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[back] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(axis=1), pairs, log_z


def document_means(p: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    first = np.cumsum(lines) - lines
    return np.add.reduceat(p * size, first) / np.add.reduceat(size, first)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Model:
    def __init__(self, weights: np.ndarray, change: np.ndarray, scale: tuple[float, float]):
        self.weights, self.change, self.scale = weights, change, scale

    def lines(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, size, lines = line_features(texts)
        return marginals(x @ self.weights, self.change, lines)[0], size, lines

    def long_mean(self, text: bytes) -> float:
        """What `document_means` gives for one text, piece by piece: forward for the messages into each piece, then back."""
        pieces = list(line_pieces(text))
        into, p = [], None
        for piece in pieces:
            into.append(p)
            p = self._forward(self._odds(text, *piece)[0], p)[-1]
        total = weight = 0.0
        behind = 0.5
        for piece, before in zip(reversed(pieces), reversed(into), strict=True):
            good, size = self._odds(text, *piece)
            p = np.array(self._forward(good, before))
            b, behind = self._backward(good, behind)
            one, none = p * b, (1 - p) * (1 - b)
            total += float((one / (one + none)) @ size)
            weight += float(size.sum())
        return total / weight

    def _odds(self, text: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Each line's log-odds and size for the lines in [start, end], with the features of the lines beside them."""
        left = text.rfind(b"\n", 0, start - 1) + 1 if start else 0
        right = text.find(b"\n", end + 1) if end < len(text) else end
        x, size, _ = line_features([text[left : right if right >= 0 else len(text)]])
        keep = slice(int(start > 0), len(x) - int(end < len(text)))
        return x[keep] @ self.weights, size[keep]

    def _forward(self, good: np.ndarray, p: float | None) -> list[float]:
        """P(good) of each line given the lines up to it; p: that of the line before."""
        (m00, m01), (m10, m11) = np.exp(self.change - self.change.max()).tolist()
        out = []
        for zero, one in zip(np.exp(np.minimum(-good, 0)).tolist(), np.exp(np.minimum(good, 0)).tolist(), strict=True):
            if p is not None:
                zero, one = zero * (m00 * (1 - p) + m10 * p), one * (m01 * (1 - p) + m11 * p)
            p = one / (zero + one)
            out.append(p)
        return out

    def _backward(self, good: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        """The share of `good` in what the lines behind each line say of it, and of the line before; b: that of the last line."""
        (m00, m01), (m10, m11) = np.exp(self.change - self.change.max()).tolist()
        out = []
        for zero, one in zip(reversed(np.exp(np.minimum(-good, 0)).tolist()), reversed(np.exp(np.minimum(good, 0)).tolist()), strict=True):
            out.append(b)
            zero, one = zero * (1 - b), one * b
            zero, one = m00 * zero + m01 * one, m10 * zero + m11 * one
            b = one / (zero + one)
        return np.array(out[::-1]), b

    def score(self, texts: Iterable[bytes]) -> np.ndarray:
        a, b = self.scale
        means, held, lines, size = [np.empty(0)], [], 0, 0
        for text in texts:
            n = text.count(b"\n") + 1
            if held and (lines + n > LINES or size + len(text) > BYTES):  # means stay in the texts' order
                means.append(document_means(*self.lines(held)))
                held, lines, size = [], 0, 0
            if n > LINES or len(text) > BYTES:
                means.append(np.array([self.long_mean(text)]))
            else:
                held.append(text)
                lines, size = lines + n, size + len(text)
        if held:
            means.append(document_means(*self.lines(held)))
        return 1 / (1 + np.exp(-(a * logit(np.concatenate(means)) + b)))


def line_pieces(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of whole lines, end at a line feed or at the text's end: LINES lines and BYTES bytes at most, but for a longer line."""
    raw, start = np.frombuffer(text, np.uint8), 0
    while True:
        feeds = np.flatnonzero(raw[start : start + BYTES] == 10)
        if len(feeds) >= LINES:
            end = start + int(feeds[LINES - 1])
        elif start + BYTES >= len(raw):
            end = len(raw)
        elif len(feeds):
            end = start + int(feeds[-1])
        else:
            end = text.find(b"\n", start + BYTES)
            end = end if end >= 0 else len(raw)
        yield start, end
        if end == len(raw):
            return
        start = end + 1


def _ascend(x: np.ndarray, y: np.ndarray, lines: np.ndarray, w: np.ndarray, change: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the penalised conditional likelihood of the line labels y."""
    first = np.cumsum(lines) - lines
    inner = np.ones(len(y), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(y[at - 1] * 2 + y[at], minlength=4).reshape(2, 2)
    theta = np.concatenate([w, change.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        w, change = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs, _ = marginals(x @ w, change, lines)
        g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(y) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit_lines(x: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray, rounds: int = 150) -> Model:
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(3 * OWN + 1), np.zeros((2, 2)), (0.0, 0.0))
    doc = np.repeat(np.arange(len(lines)), lines)
    y = label[doc]
    w, change = np.zeros(x.shape[1]), np.zeros((2, 2))
    for turn in range(3):
        w, change = _ascend(x, y, lines, w, change, rounds)
        if turn < 2:
            p = marginals(x @ w, change, lines)[0]
            worst = np.zeros(len(y), bool)
            worst[np.lexsort((p, doc))[np.cumsum(lines) - lines]] = True
            y = np.where(label[doc] == 1, 1, ((p > 0.5) & ~worst).astype(np.int64))
    z = logit(document_means(marginals(x @ w, change, lines)[0], size, lines))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-(a * z + b)))
        r, s = label - p, p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(r * z).sum() - (a - 1), r.sum()])
        a, b = a + np.clip(step[0], -0.5, 0.5), b + np.clip(step[1], -0.5, 0.5)
    return Model(w, change, (float(max(a, 0.05)), float(b)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_lines: int = 100_000) -> Model:
    """Fit on documents of `docs` with a quality of 0 or 1 in `labels`; only their features come to the driver."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # as many of each kind as the half of the sample holds
    chosen = [chosen.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for q in (0, 1)]
    d = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, quality in zip(*(batch.column(c) for c in ("doc_id", "text", "quality")), strict=True):
                raw = (text.as_py() or "").encode()
                n = raw.count(b"\n") + 1
                if n > half:  # the first lines, and the one behind them for its features
                    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
                    raw = raw[: feeds[half]] if len(feeds) > half else raw
                x, size, _ = line_features([raw])
                kept = min(n, half)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([kept]), pa.array([kept < n]), pa.array([quality.as_py()], pa.int32()), pa.array([x[:kept].astype(np.float32).tobytes()]), pa.array([size[:kept].tobytes()])], ["doc_id", "lines", "cut", "quality", "x", "size"])

    half = max(1, sample_lines // 2)
    kept = d.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").mapInArrow(run, "doc_id long, lines long, cut boolean, quality int, x binary, size binary")
    kept = materialize(kept.withColumn("no", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("x")))
    chosen, total = [], {0: 0, 1: 0}
    for r in kept.orderBy("cut", F.xxhash64("doc_id"), "doc_id", "h", "no").select("no", "lines", "quality").limit(sample).collect():  # `sample` rows of three numbers
        if total[r.quality] + r.lines <= half:
            total[r.quality] += r.lines
            chosen.append(r.no)
    got = {r.no: r for r in kept.where(F.col("no").isin(chosen)).collect()} if chosen else {}
    got = [got[i] for i in chosen]
    if not got:
        return fit_lines(np.zeros((0, 1)), np.zeros(0), np.zeros(0), np.zeros(0))
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, 3 * OWN + 1) for r in got]).astype(np.float64)
    size = np.concatenate([np.frombuffer(r["size"], np.float64) for r in got])
    chains = [(min(CHAIN, r.lines - at), r.quality) for r in got for at in range(0, r.lines, CHAIN)]
    return fit_lines(x, size, *np.array(chains).T)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns of `docs`, and the score; a column of its name is replaced."""
    docs = docs.drop(name)
    # columns by number, as names may hold anything
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = ((t.as_py() or "").encode() for t in batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(texts))], schema.names)

    return docs.toDF(*schema.names[:-1]).mapInArrow(run, schema).toDF(*docs.columns, name)
