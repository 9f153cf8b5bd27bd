"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of the whole text, many texts at a time. Trees split on bins of the training
values; the fitted forest is flattened into arrays (feature, threshold, children, value), and scoring moves all
rows of a batch down a level at a time. Fitting uses a bounded sample of labelled rows, the least hashes.

Null and empty texts have statistics of zero and get a score like any other. Repeated rows score alike, and train once
an id; of several labels of an id the greatest counts. Equal gains split at the first statistic and bin. Without
labelled rows of both kinds every score is the share of label 1 (0.5 if there are none). Long texts are read whole.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise
from .words import LOWER, SPACE, text_slices, word_hashes

#: Bound of the training sample, in labelled rows.
SAMPLE_ROWS = 20_000
TREES, LEAVES_DEPTH, BINS, RATE, L2, LEAST_ROWS = 60, 4, 64, 0.15, 1.0, 12
NAMES = [
    "bytes", "words", "lines", "word_bytes", "long_words", "distinct_words", "top_word", "distinct_lines", "line_bytes", "upper", "digit", "space", "period", "comma",
    "other_punct", "high_bytes", "bang", "pipe_star_hash", "brackets", "ends_sentence", "upper_words", "repeated_neighbours", "byte_entropy", "short_lines",
]
CLASS = np.zeros(256, dtype=np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\v\f\r", 3), (b".", 4), (b",", 5), (b"!", 7), (b"|*#%&$", 8), (b"()[]{}<>=/\\", 9), (b"\"'-:;?@+_^~`", 6)):
    CLASS[list(_chars)] = _k
CLASS[128:] = 10


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    tally = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    classes = np.zeros((n, 11))
    for k in range(11):
        classes[:, k] = tally[:, CLASS == k].sum(axis=1)
    hashes, first = word_hashes(data, offsets)
    words = np.diff(first)
    wrow = np.repeat(np.arange(n), words)
    inside = ~SPACE[data]
    word_bytes = np.bincount(row, weights=inside, minlength=n)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1 : len(data)]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1 : len(data)]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    upper_sum = np.concatenate([[0], np.cumsum((LOWER[data] != data))])
    shout = (upper_sum[end] - upper_sum[begin]) >= 2
    order = np.lexsort((hashes, wrow))
    h, r = hashes[order], wrow[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=n)
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[starts], runs)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (wrow[1:] == wrow[:-1])
    newline = (data == 10).astype(np.float64)
    lines = np.bincount(row, weights=newline, minlength=n) + (size > 0)
    # a line's hash is the sum of its words' hashes by line number
    line_no = np.concatenate([[0], np.cumsum(data == 10)])
    lid = (line_no[begin] if len(begin) else np.zeros(0, dtype=np.int64)) + wrow
    lines_n = int(lid.max(initial=-1)) + 1
    lsum = np.zeros(lines_n, dtype=np.uint64)
    np.add.at(lsum, lid, hashes)
    lrow = np.zeros(lines_n, dtype=np.int64)
    lrow[lid] = wrow
    used = np.zeros(lines_n, dtype=bool)
    used[lid] = True
    lw = np.bincount(lid, minlength=lines_n)[used]
    lsum, lrow = lsum[used], lrow[used]
    order = np.lexsort((lsum, lrow))
    new = np.ones(len(lsum), dtype=bool)
    new[1:] = (lsum[order][1:] != lsum[order][:-1]) | (lrow[order][1:] != lrow[order][:-1])
    distinct_lines = np.bincount(lrow[order][new], minlength=n)
    full_lines = np.bincount(lrow, minlength=n)
    short_lines = np.bincount(lrow, weights=lw < 4, minlength=n)
    last = np.zeros(n)
    some = size > 0
    last[some] = np.isin(data[offsets[1:][some] - 1], list(b".!?"))
    p = tally / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    per = lambda x, y: x / np.maximum(y, 1)
    return np.column_stack(
        [
            size, words, lines, per(word_bytes, words), per(np.bincount(wrow, weights=(end - begin) > 12, minlength=n), words), per(distinct, words), per(top, words), per(distinct_lines, full_lines), per(size, lines), per(classes[:, 1], size), per(classes[:, 2], size),
            per(classes[:, 3], size), per(classes[:, 4], size), per(classes[:, 5], size), per(classes[:, 6], size), per(classes[:, 10], size), per(classes[:, 7], size), per(classes[:, 8], size), per(classes[:, 9], size), last, per(np.bincount(wrow, weights=shout, minlength=n), words),
            per(np.bincount(wrow, weights=same, minlength=n), words), entropy, per(short_lines, full_lines),
        ]
    )


@dataclass
class Forest:
    """Trees of one depth as arrays: node i of a tree has children 2i + 1 and 2i + 2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(LEAVES_DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            raw += v[node - (1 << LEAVES_DEPTH) + 1]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    share = float(y.mean()) if len(y) else 0.5
    trees: list[tuple] = []
    start = float(np.log(share / (1 - share))) if 0 < share < 1 else (0.0 if not len(y) else 30.0 * (2 * share - 1))
    inner = (1 << LEAVES_DEPTH) - 1
    if len(y) and 0 < share < 1:
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)])
        flat = binned + np.arange(x.shape[1]) * BINS
        raw = np.full(len(y), start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(LEAVES_DEPTH):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    rows = np.flatnonzero(node == k)
                    split = best_split(flat[rows], g[rows], h[rows], x.shape[1]) if len(rows) >= 2 * LEAST_ROWS else None
                    if split and split[1] < len(cuts[split[0]]):
                        feature[k], threshold[k] = split[0], cuts[split[0]][split[1]]
                    node[rows] = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
            leaf = node - inner
            value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
            raw += value[leaf]
            trees.append((feature, threshold, value))
    parts = [np.array([t[i] for t in trees]) for i in range(3)] if trees else [np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))]
    return Forest(start, *parts)


def best_split(flat: np.ndarray, g: np.ndarray, h: np.ndarray, features: int) -> tuple[int, int] | None:
    shape = (features, BINS)
    of = lambda w: np.bincount(flat.ravel(), np.repeat(w, features), features * BINS).reshape(shape).cumsum(axis=1)
    gl, hl, nl = of(g), of(h), of(np.ones(len(g)))
    gain = gl**2 / (hl + L2) + (g.sum() - gl) ** 2 / (h.sum() - hl + L2) - g.sum() ** 2 / (h.sum() + L2)
    gain[(nl < LEAST_ROWS) | (len(g) - nl < LEAST_ROWS)] = -np.inf
    at = int(gain.argmax())
    return (at // BINS, at % BINS) if gain.flat[at] > 1e-9 else None


def with_statistics(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows (keep..., text) -> keep..., stats (array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(len(keep))):
                values = statistics(data, offsets)
                stats = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in range(len(keep))], stats], names=[*keep, "stats"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(run, f"{kinds}, stats array<double>")


def training(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, folds: int, held: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most SAMPLE_ROWS labelled rows outside fold `held`, those of the least hashes."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    marks = marks.where(fold("_id", folds) != held).withColumn("_h", F.xxhash64(F.lit("quality"), "_id")).orderBy("_h", "_id").limit(SAMPLE_ROWS)
    met = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(materialise(marks, "marks")), "_id")  # at most SAMPLE_ROWS rows
    # rows that repeat an id train once, by the one of the least hash, so that the sample's bound holds for rows too
    rows = met.groupBy("_id", "_h", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("_y", "_h", "text")
    got = sorted(with_statistics(rows, ["_y", "_h"]).select("_h", "_y", "stats").toLocalIterator(), key=lambda r: (r._h, r._y, r.stats))
    return np.array([r.stats for r in got], dtype=np.float64).reshape(len(got), len(NAMES)), np.array([r._y for r in got], dtype=np.float64)


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(*training(docs, labels, doc_id=doc_id, text=text, label=label, folds=folds, held=held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                p = model.probability(statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, folds) == held).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
