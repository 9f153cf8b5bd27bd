"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the hashed words of a text and their beginnings of several lengths, present or not, over all of the
text. One weight vector serves every ordered threshold: P(grade > k) = sigmoid(w.x - theta_k), theta rising with
k, and the severity is the expected grade. Labels mark texts toxic or not; the grades above 0 are the labelled
toxic texts divided by the density of what a first fit of two grades holds against them.

Fitting uses a bounded, stratified sample of labelled rows, those of the least hashes. Null and empty texts have
no features and get severity by the thresholds alone, which training keeps below grade 1. Without labels of both
kinds severity is 0. Repeated rows score alike, and train once an id; of several labels of an id the greatest counts.
Equal probabilities of grades give the lowest one. Long texts are worked in parts, all of them. An empty table gives
an empty result; score ignores extra columns, keep_clean returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialise
from .words import SLICE, hash_of, parts_of, text_slices, tokens

#: Bounds of the training sample: toxic rows, and others.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
GRADES, BUCKETS, PREFIXES = 4, 1 << 20, (4, 5, 6)
STEPS, RATE, L2 = 120, 0.3, 1.0
LEAST_TEXTS, LEAST_DEVIATIONS = 6, 4.5
#: Everything but letters and the bytes of other scripts lies between words.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature buckets of every text, in one array, where each text's begin, and each text's words."""
    if len(offsets) == 2 and len(data) > 2 * SLICE:  # one long text: worked in parts, cut between words
        parts = [features(part, np.array([0, len(part)])) for part in parts_of(data, BETWEEN)]
        index = np.unique(np.concatenate([p[0] for p in parts]))
        return index, np.array([0, len(index)]), np.sum([p[2] for p in parts], axis=0)
    begin, end, first, sums = tokens(data, offsets, BETWEEN)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    parts, rows = [hash_of(begin, end, sums)], [row]
    for k in PREFIXES:
        longer = end - begin > k
        parts.append(hash_of(begin[longer], begin[longer] + k, sums) ^ np.uint64(k * 0x9E3779B9))
        rows.append(row[longer])
    key = np.concatenate(rows).astype(np.uint64) * np.uint64(BUCKETS) + (np.concatenate(parts) >> np.uint64(44))
    key = np.unique(key)
    row = (key // np.uint64(BUCKETS)).astype(np.int64)
    return (key % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(row, np.arange(n + 1)), np.diff(first)


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


@dataclass
class Model:
    weight: np.ndarray
    theta: np.ndarray

    def above(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(grade > k) for every text and threshold."""
        z = sums_by_text(self.weight[index], first)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.theta, -40, 40)))


def fit(index: np.ndarray, first: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """Penalised maximum likelihood by adaptive gradient steps; theta is a first value and positive steps up.

    Only features that occur are held meanwhile: the steps never move the weight of another one from 0.
    """
    n = len(grade)
    used, index = np.unique(index, return_inverse=True)
    size = np.diff(first)
    row = np.repeat(np.arange(n), size)
    weight, theta0, gaps = np.zeros(len(used)), 0.0, np.zeros(grades - 2)
    m, s = np.zeros(len(used)), np.zeros(len(used))
    mt, st = np.zeros(grades - 1), np.zeros(grades - 1)
    balance = np.where(grade > 0, n / (2 * max(1, (grade > 0).sum())), n / (2 * max(1, (grade == 0).sum())))
    for step in range(1, STEPS + 1):
        theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.bincount(row, weight[index], n)
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40)))
        full = np.column_stack([np.ones(n), above, np.zeros(n)])
        p = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-12)
        slope = np.column_stack([np.zeros(n), above * (1 - above), np.zeros(n)])
        up, down = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        dz = balance * (up - down) / p  # of the log-likelihood
        gw = np.bincount(index, dz[row], len(used)) - L2 * weight
        gt = np.zeros(grades - 1)
        np.add.at(gt, np.maximum(grade - 1, 0), np.where(grade > 0, -balance * up / p, 0))
        np.add.at(gt, np.minimum(grade, grades - 2), np.where(grade < grades - 1, balance * down / p, 0))
        g = np.concatenate([[gt.sum()], gt[::-1].cumsum()[::-1][1:] * np.exp(gaps)])
        m, s = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw**2
        mt, st = 0.9 * mt + 0.1 * g, 0.99 * st + 0.01 * g**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        weight += RATE * 0.2 * (m / a) / (np.sqrt(s / b) + 1e-3)
        move = RATE * (mt / a) / (np.sqrt(st / b) + 1e-3)
        theta0, gaps = theta0 + move[0], np.clip(gaps + move[1:], -5, 3)
    held = np.zeros(BUCKETS)
    held[used] = weight
    return Model(held, theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def graded(index: np.ndarray, first: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> Model | None:
    if not 0 < toxic.sum() < len(toxic):
        return None
    # only features tied to a kind beyond chance carry over to other texts
    row = np.repeat(np.arange(len(toxic)), np.diff(first))
    texts, hits = np.bincount(index, minlength=BUCKETS), np.bincount(index, toxic[row], BUCKETS)
    expected = texts * toxic.mean()
    common = (texts >= LEAST_TEXTS) & (np.abs(hits - expected) >= LEAST_DEVIATIONS * np.sqrt(expected + 1))
    keep = common[index]
    row = row[keep]
    index, first = index[keep], np.searchsorted(row, np.arange(len(toxic) + 1))
    two = fit(index, first, toxic.astype(np.int64), 2)
    density = sums_by_text(np.maximum(two.weight[index], 0), first) / np.sqrt(np.maximum(words, 1))
    edges = np.quantile(density[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic, 1 + np.searchsorted(edges, density), 0)
    return fit(index, first, grade, GRADES)


def training(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, folds: int, held: int) -> Model | None:
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    hashed = marks.where(fold("_id", folds) != held).withColumn("_h", F.xxhash64(F.lit("toxic"), "_id"))
    kept = [hashed.where(F.col("_y") == y).orderBy("_h", "_id").limit(most) for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    marks = F.broadcast(materialise(kept[0].union(kept[1]), "marks"))  # bounded by the two sample sizes
    # rows that repeat an id train once, by the one of the least hash, so that the sample's bound holds for rows too
    met = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(marks, "_id")
    rows = met.groupBy("_id", "_h", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("_h", "_y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                index, first, words = features(data, offsets)
                lists = [index[i:j].astype("<i4").tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(lists, pa.binary()), pa.array(words.astype(np.int64))], names=["h", "y", "x", "words"])

    got = sorted((tuple(r) for r in rows.mapInArrow(run, "h long, y int, x binary, words long").toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    if not got:
        return None
    lists = [np.frombuffer(r[2], dtype="<i4") for r in got]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return graded(np.concatenate(lists).astype(np.int64), first, np.array([r[3] for r in got]), np.array([r[1] == 1 for r in got]))


def score(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, severity (0 to GRADES - 1), p_toxic, grade, toxic for every row of docs.

    toxic: P(grade > 0) of a half or more; grade: the most likely one. Learns from rows outside fold `held`.
    """
    model = training(docs, labels, doc_id=doc_id, text=text, label=label, folds=folds, held=held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *judged(model, data, offsets)], names=["doc_id", "held_out", "severity", "p_toxic", "grade", "toxic"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, folds) == held).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, severity double, p_toxic double, grade int, toxic boolean")


def judged(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """severity, p_toxic, grade, toxic of each text."""
    n = len(offsets) - 1
    above = np.zeros((n, GRADES - 1))
    if model is not None:
        index, first, _ = features(data, offsets)
        above = model.above(index, first)
    full = np.column_stack([np.ones(n), above, np.zeros(n)])
    grade = (full[:, :-1] - full[:, 1:]).argmax(axis=1)
    return [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] >= 0.5)]


def keep_clean(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0) -> DataFrame:
    """docs without the rows judged toxic; all columns stay."""
    model = training(docs, labels, doc_id=doc_id, text=text, label=label, folds=folds, held=held)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [~np.asarray(judged(model, data, offsets)[3].to_numpy(zero_copy_only=False)) for _, _, data, offsets in text_slices(batch.column(at))]
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(run, docs.schema)
