"""Quality rules: counted statistics with fixed limits, and an isolation forest over them.

Every text gets the counts of the usual rules. Two of them have fixed limits; the rest are judged together by an
isolation forest. Its random splits are drawn from the box that all labelled rows fill, and all good ones are counted
in every tree, so that a text unlike the good ones soon stands alone: its paths are short. (With splits drawn between the
rows of a node, common kinds of junk hid each other: nine of ten stayed.) The length of path below which a row is
rejected is calibrated on all labels: the strictest at which at most SPARE of the good rows go. Nothing is sampled; the
driver holds the trees, whose size is fixed, and Spark counts the rows at their ends. Every text is counted once.

Null and empty texts have no words and fail the base rules. Repeated rows get equal results; of rows that repeat a
labelled id one trains, and of several labels of an id the greatest counts. Equal path lengths are judged alike, at
the limit as kept. Without labelled rows of both kinds nothing but the base rules rejects. Words and windows of long
texts are numbered in pieces: a text costs about nine bytes a word beside its own distinct words and lines. An empty
table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.operators.views import ranked_values

from .common import fold, free_name, materialise, row_key, sided

TREES, DEPTH, SEED = 100, 10, 17
#: The share of good labelled rows that the calibrated limit may reject.
SPARE = 0.005
#: Bytes of a text whose words are split at once.
PIECE = 1 << 20
#: Fixed by the contract: symbols, words of a window, least words, and percents of repeated words.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 8, 20, 30
#: Texts of this many bytes together are judged at once.
SLICE = 4 << 20
SPACE_BYTES = b" \t\n\v\f\r"
_space = re.compile(rb"[ \t-\r]")
_later = bytes(range(0x80, 0xC0))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares of words, lines or letters, and of marks among words and marks; the forest sees log(1 + 100 share), in which
#: none and some lie far apart. None is above 1, so that no labelled row, however odd, widens the box for all others.
SHARES = ["symbols", "dup_lines", "repeat_words", "upper", "neighbours", "bangs"]


def word_ids(text: bytes) -> np.ndarray:
    """The words of a text as numbers in order of first appearance, equal for equal words only."""
    ids: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        stop = _space.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        parts.append(np.array([ids.setdefault(w, len(ids)) for w in text[at:end].split()], dtype=np.int64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def repeated_words(ids: np.ndarray, k: int = WINDOW) -> int:
    """How many words stand in a window of k words that the text holds twice or more.

    Windows are numbered by doubling: one of 2s words is a pair of windows of s words, so equal numbers are equal words.
    """
    n = len(ids)
    if n <= k:
        return 0
    name, span = ids, 1
    while span < k:
        step = min(span, k - span)
        pair = name[: len(name) - step] * (int(name.max()) + 1) + name[step:]
        name = np.unique(pair, return_inverse=True)[1]
        span += step
    twice = (np.bincount(name) > 1)[name]
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: len(twice)] += twice
    edge[k : k + len(twice)] -= twice
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    seen: set[bytes] = set()
    lines = 0
    for line in io.BytesIO(text):
        if line.strip():
            lines += 1
            seen.add(line.removesuffix(b"\n"))
    return lines, lines - len(seen)


def without(text: bytes, marks: bytes) -> int:
    """How many bytes of a text are among marks."""
    return len(text) - len(text.translate(None, marks))


def counted(text: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and SHARES of one text."""
    ids = word_ids(text)
    n = len(ids)
    chars = len(text.translate(None, SPACE_BYTES + _later))
    lines, dup = repeated_lines(text)
    repeated = repeated_words(ids)
    symbols = without(text, SYMBOLS)
    words, letters = max(n, 1), max(chars, 1)
    upper = without(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    bangs = without(text, b"!")
    shares = [symbols / (words + symbols), dup / max(lines, 1), repeated / words, upper / letters, float((ids[1:] == ids[:-1]).sum()) / words, bangs / (words + bangs)]
    return [n, chars, symbols, dup, repeated], [math.log1p(100 * x) for x in shares]


def base_failed(n_words, n_repeat_words):
    """For arrays and columns alike."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


@dataclass
class Isolation:
    """Trees of one depth as arrays: node i has children 2i + 1 and 2i + 2, and `length` holds a path's worth at its end."""

    feature: np.ndarray
    threshold: np.ndarray
    length: np.ndarray
    limit: float = -np.inf

    @property
    def depth(self) -> int:
        return (self.length.shape[1] + 1).bit_length() - 2

    def ends(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the node of the last level that each row comes to."""
        rows = np.arange(len(x))
        for f, t in zip(self.feature, self.threshold, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            yield node

    def counts(self, x: np.ndarray) -> np.ndarray:
        """How many rows come to each node of the last level, a row a tree."""
        width = 1 << self.depth
        return np.array([np.bincount(node - width + 1, minlength=width) for node in self.ends(x)], dtype=np.int64).reshape(-1, width)

    def paths(self, x: np.ndarray) -> np.ndarray:
        """The mean length of each row's paths; short ones are anomalous."""
        total = np.zeros(len(x))
        for node, length in zip(self.ends(x), self.length, strict=True):
            total += length[node]
        return total / max(len(self.feature), 1)

    def anomalous(self, x: np.ndarray) -> np.ndarray:
        return self.paths(x) < self.limit


def spare_length(n: np.ndarray) -> np.ndarray:
    """The expected length of a search that fails among n rows: what a leaf of n rows adds to its depth."""
    many = np.maximum(n, 2)
    return np.where(n < 2, 0.0, 2 * (np.log(many - 1) + 0.5772156649015329) - 2 * (many - 1) / many)


def splits(low: np.ndarray, high: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Isolation:
    """Trees of random splits of the box from low to high, in which no rows are counted yet."""
    rng = np.random.default_rng(seed)
    size = (1 << (depth + 1)) - 1
    feature, threshold = np.zeros((trees, size), dtype=np.int64), np.full((trees, size), np.inf)
    low, high = (np.tile(side, (trees, 1, 1)) for side in (low, high))
    for level in range(depth):
        wide = high > low
        k = np.where(wide, rng.random(wide.shape), -1.0).argmax(axis=2)[..., None]
        a, b = np.take_along_axis(low, k, 2), np.take_along_axis(high, k, 2)
        cut = np.where(wide.any(axis=2, keepdims=True), a + rng.random(a.shape) * (b - a), np.inf)
        here = slice((1 << level) - 1, (2 << level) - 1)
        feature[:, here], threshold[:, here] = k[..., 0], cut[..., 0]
        low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
        np.put_along_axis(high[:, ::2], k, np.minimum(b, cut), 2)
        np.put_along_axis(low[:, 1::2], k, np.minimum(b, cut), 2)
    return Isolation(feature, threshold, np.zeros((trees, size)))


def filled(forest: Isolation, counts: np.ndarray) -> Isolation:
    """forest with the lengths that its counts give: a path ends at the first part of the box that holds one row or none."""
    depth = forest.depth
    threshold, length = forest.threshold.copy(), forest.length.copy()
    n, levels = counts, []
    for level in range(depth, -1, -1):
        levels.append((level, n))
        n = n.reshape(len(n), n.shape[1] // 2, 2).sum(axis=2) if level else n
    worth, ended = np.zeros((len(counts), 1)), np.zeros((len(counts), 1), dtype=bool)
    for level, n in reversed(levels):
        here = slice((1 << level) - 1, (2 << level) - 1)
        worth = np.where(ended, worth, level + spare_length(n))
        ended = ended | (n < 2) | np.isinf(threshold[:, here])
        threshold[:, here][ended] = np.inf
        if level < depth:
            worth, ended = np.repeat(worth, 2, axis=1), np.repeat(ended, 2, axis=1)
    length[:, (1 << depth) - 1 :] = worth
    return Isolation(forest.feature, threshold, length)


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Isolation:
    """Trees in which all rows of x are counted; none without rows."""
    forest = splits(low, high, trees=trees if len(x) else 0, depth=depth, seed=seed)
    return filled(forest, forest.counts(x))


def calibrated(forest: Isolation, x: np.ndarray, good: np.ndarray, spare: float = SPARE) -> Isolation:
    """forest with the greatest limit that rejects at most a share `spare` of the good rows."""
    if len(x) and good.any() and not good.all():
        paths = np.sort(forest.paths(x[good]))
        forest.limit = float(paths[int(spare * len(paths))])
    return forest


def with_statistics(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows (keep..., text) -> keep..., COUNTS, base_failed, shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts, shares in slices(batch, len(keep)):
                columns = [*[pa.array(counts[:, k]) for k in range(len(COUNTS))], pa.array(base_failed(counts[:, 0], counts[:, 4])), pa.array(list(shares), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=[*keep, *COUNTS, "base_failed", "shares"])

    kinds = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], *[f"{c} bigint" for c in COUNTS]])
    return rows.select(*keep, "text").mapInArrow(run, f"{kinds}, base_failed boolean, shares array<double>")


def slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about SLICE bytes of the text column, with the COUNTS and SHARES of each row."""
    start, size, found = 0, 0, []
    column = batch.column(at).cast(pa.large_binary())
    for i, value in enumerate(column):
        text = value.as_py() or b""
        found.append(counted(text))
        size += len(text)
        if size >= SLICE or i == len(column) - 1:
            yield batch.slice(start, i + 1 - start), np.array([c for c, _ in found], dtype=np.int64), np.array([s for _, s in found])
            start, size, found = i + 1, 0, []


def shares_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("shares").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SHARES))


def training(rows: DataFrame, labels: DataFrame, *, doc_id: str, label: str) -> DataFrame:
    """_y and shares of all labelled rows that pass the base rules and are not held out, one an id."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    one = rows.where("not held_out").groupBy("_id").agg(F.min(F.struct("_t", *COUNTS, "shares", "base_failed")).alias("one"))
    return one.join(marks, "_id").where("not one.base_failed").select("_y", "one.shares")


def counted_in(forest: Isolation, x: DataFrame) -> np.ndarray:
    """What forest.counts gives for the shares of all rows of x. Tasks send sums by node; the driver gets one number a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(forest.feature), 1 << forest.depth), dtype=np.int64)
        for batch in batches:
            n += forest.counts(shares_of(batch))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n.ravel()[met])], names=["node", "n"])

    sums = x.select("shares").mapInArrow(run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(forest.feature), 1 << forest.depth), dtype=np.int64)
    n.ravel()[sums["node"].to_numpy()] = sums["n"].to_numpy()
    return n


def fitted(rows: DataFrame) -> Isolation:
    """The forest of all good rows of training, within the box of all rows, calibrated on all good ones."""
    sides = [f(F.get("shares", F.lit(k))) for f in (F.min, F.max) for k in range(len(SHARES))]
    goods, bads, *box = rows.agg(F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0), *sides).first()
    if not goods or not bads:
        nothing = np.zeros((0, len(SHARES)))
        return grow(nothing, np.zeros(len(SHARES)), np.zeros(len(SHARES)))
    good = rows.where("_y = 1")
    empty = splits(*np.array(box).reshape(2, -1))
    forest = filled(empty, counted_in(empty, good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.paths(shares_of(batch)))], names=["path"])

    paths = materialise(good.select("shares").mapInArrow(run, "path double"), "paths")
    forest.limit = ranked_values(paths, [("path", int(SPARE * goods))])[0]
    return forest


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0, key: str | None = None) -> DataFrame:
    """doc_id (the column `key` instead, if named), COUNTS, base_failed, kept, path_length, held_out for every row of docs."""
    texts = docs.select(F.col(key or doc_id).alias("doc_id"), F.col(doc_id).alias("_id"), (fold(doc_id, folds) == held).alias("held_out"), F.xxhash64(text).alias("_t"), F.col(text).alias("text"))
    rows = materialise(with_statistics(texts, ["doc_id", "_id", "held_out", "_t"]), "statistics")
    forest = fitted(materialise(training(rows, labels, doc_id=doc_id, label=label), "training"))
    given = ["doc_id", *COUNTS, "base_failed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = forest.paths(shares_of(batch))
            kept = ~batch.column("base_failed").to_numpy(zero_copy_only=False) & ~(paths < forest.limit)
            columns = [*[batch.column(c) for c in given], pa.array(kept), pa.array(paths), batch.column("held_out")]
            yield pa.RecordBatch.from_arrays(columns, names=[*given, "kept", "path_length", "held_out"])

    kinds = ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.select(*given, "held_out", "shares").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}, base_failed boolean, kept boolean, path_length double, held_out boolean")


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that a rule or the forest rejects."""
    key = free_name("key", docs.columns)
    keyed = docs.withColumn(key, row_key(doc_id, text))
    judged = judge(keyed, labels, doc_id=doc_id, text=text, key=key, **options)
    bad = judged.where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(sided(materialise(bad, "bad")), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
