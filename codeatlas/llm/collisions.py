"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Unit vectors are projected on many random directions. For a pair at the cosine threshold the projections differ
by a normal amount of known spread, so the share of query-centred windows that hold both is known too; pairs
whose count passes the level that such pairs miss once in 10,000 times are verified in double precision.
Counting over whole sorted projections would touch a constant share of all pairs, so projections are first read
in cells: a cell joins vectors whose other projections fall in the same windows, in one of several draws, and a
pair met in several draws is counted in the first alone. A cell larger than BLOCK is divided into pairs of
blocks; no task holds more than two blocks, and only counts and a spanning forest of the links leave it.

Vectors link only with others of an equal, non-null label and the same length. Null, empty and zero vectors and
those with null or non-finite components link with nothing: n_links 0 and a component of their own. Equal
vectors form a class that is compared once. A row that repeats a vec_id counts as another vector. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, materialise
from .components import components, rooted

DRAWS, WIDE, COUNTED, BLOCK = 16, 8, 24, 1024
#: Window of a counted projection, and width of a cell's, in deviations of a pair at the threshold.
WINDOW_DEV, CELL_DEV = 2.0, 8.0
MISS = 1e-4


@functools.cache
def directions(dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([41, dims])
    d = rng.standard_normal((DRAWS * WIDE + COUNTED, dims))
    return d / np.linalg.norm(d, axis=1, keepdims=True), rng.random(DRAWS * WIDE)


@functools.cache
def least_count() -> int:
    """The most collisions that a pair at the threshold misses with a chance of MISS at most."""
    p = math.erf(WINDOW_DEV / math.sqrt(2))
    below, level = 0.0, 0
    while True:
        below += math.comb(COUNTED, level) * p**level * (1 - p) ** (COUNTED - level)
        if below > MISS:
            return level
        level += 1


def spread(dims: int, cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine) / math.sqrt(dims)


def units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classed(vectors: DataFrame, vec_id: str, embedding: str, label: str, cosine: float) -> DataFrame:
    """vec_id, cls, raw, cells: cls is null for what links with nothing; cells are 64-bit ids, one a draw."""
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raws, cells = [], [], []
            for tag, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array([] if tag is None or not value or None in value else value, dtype=np.float64)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    names.append(None), raws.append(None), cells.append(None)
                    continue
                raw = (x + 0.0).tobytes()  # -0.0 equals 0.0
                unit = units([raw])[0]
                d, shift = directions(len(x))
                at = np.floor(d[: DRAWS * WIDE] @ unit / (CELL_DEV * spread(len(x), cosine)) + shift).astype(np.int64)
                group = f"{tag}\0{len(x)}\0".encode()
                names.append(hashlib.md5(group + raw).digest())
                raws.append(raw)
                cells.append(b"".join(hashlib.blake2b(group + bytes([t]) + at[t * WIDE : (t + 1) * WIDE].tobytes(), digest_size=8).digest() for t in range(DRAWS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(raws, pa.binary()), pa.array(cells, pa.binary())], names=["vec_id", "cls", "raw", "cells"])

    kind = source.schema["vec_id"].dataType.simpleString()
    return source.mapInArrow(run, f"vec_id {kind}, cls binary, raw binary, cells binary")


def groups(classes: DataFrame) -> DataFrame:
    """draw, cell, b1, b2, side, cls, mult, raw, cells: the rows of every pair of blocks of every shared cell."""
    keys = F.array(*[F.struct(F.lit(t).alias("draw"), F.substring("cells", 8 * t + 1, 8).alias("cell")) for t in range(DRAWS)])
    placed = classes.select("cls", F.explode(keys).alias("k")).select("cls", "k.*")
    sizes = placed.groupBy("draw", "cell").agg(F.count("*").alias("n")).where("n > 1").select("draw", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = placed.join(sizes, ["draw", "cell"]).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    spread_ = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = spread_.select("draw", "cell", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), F.col("mine").alias("side"), "cls")
    return pairs.join(classes, "cls")


def compare(rows: DataFrame, cosine: float) -> DataFrame:
    """a, b, n: (class, null, links) sums of linked vectors, and (class, class, 0) edges of a spanning forest."""

    def links(draw: int, b1: int, b2: int, side: np.ndarray, mult: np.ndarray, raw: list, cells: list) -> tuple[np.ndarray, np.ndarray]:
        """Adjacency of the new links, and the number of linked vectors of each row."""
        x = units(raw)
        d, _ = directions(x.shape[1])
        window = WINDOW_DEV * spread(x.shape[1], cosine)
        p = x @ d[DRAWS * WIDE :].T
        count = np.zeros((len(x), len(x)), dtype=np.uint8)
        for j in range(COUNTED):
            order = np.argsort(p[:, j])
            s = p[order, j]
            begin, end = np.searchsorted(s, s - window), np.searchsorted(s, s + window, side="right")
            for i, b, e in zip(order, begin, end, strict=True):
                count[i, order[b:e]] += 1
        near = count >= least_count()
        np.fill_diagonal(near, False)
        if b1 != b2:  # pairs inside a block belong to its own group
            near &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(near))
        c = np.frombuffer(b"".join(cells), dtype=np.uint64).reshape(len(x), DRAWS)
        fresh = ~(c[i, :draw] == c[j, :draw]).any(axis=1)
        i, j = i[fresh], j[fresh]
        ok = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 1 << 16):
            cut = slice(at, at + (1 << 16))
            ok[cut] = np.einsum("ij,ij->i", x[i[cut]], x[j[cut]]) >= cosine
        adj = np.zeros_like(near)
        adj[i[ok], j[ok]] = adj[j[ok], i[ok]] = True
        return adj, adj @ mult

    def forest_of(adj: np.ndarray) -> Iterator[tuple[int, int]]:
        seen = ~adj.any(axis=1)
        for root in range(len(adj)):
            if seen[root]:
                continue
            seen[root] = True
            front = np.array([root])
            while len(front):
                reach = adj[front]
                new = np.flatnonzero(reach.any(axis=0) & ~seen)
                for child, parent in zip(new, front[reach[:, new].argmax(axis=0)], strict=True):
                    yield parent, child
                seen[new] = True
                front = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["a", "b", "n"])
            for x in out:
                x.clear()
            return batch

        def close(key: tuple, members: list) -> None:
            if len(members) < 2:
                return
            side, cls, mult, raw, cells = zip(*members, strict=True)
            adj, n = links(key[0], key[2], key[3], np.array(side), np.array(mult, dtype=np.int64), raw, cells)
            for k in np.flatnonzero(n):
                out[0].append(cls[k]), out[1].append(None), out[2].append(int(n[k]))
            for a, b in forest_of(adj):
                out[0].append(cls[a]), out[1].append(cls[b]), out[2].append(0)

        now, members = None, []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(9)]
            for row in zip(*cols, strict=True):
                if row[:4] != now:
                    close(now, members)
                    now, members = row[:4], []
                    if len(out[0]) > 20_000:
                        yield flush()
                members.append(row[4:])
        close(now, members)
        yield flush()

    keys = ["draw", "cell", "b1", "b2"]
    sorted_ = rows.select(*keys, "side", "cls", "mult", "raw", "cells").repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(run, "a binary, b binary, n long")


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    rows = materialise(classed(vectors, vec_id, embedding, label, cosine), "vectors")
    classes = materialise(rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("mult"), F.min("raw").alias("raw"), F.min("cells").alias("cells")), "classes")
    found = materialise(compare(groups(classes.select("cls", "mult", "raw", "cells")), cosine), "links")
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    roots = components(found.where(F.col("b").isNotNull()).select(F.col("a").alias("u"), F.col("b").alias("v")))
    # only classes with a root, and the roots, have others in their component
    linked = rooted(roots).select(F.col("node").alias("cls"), "root").join(classes.select("cls", "first_id"), "cls")
    least = materialise(linked.groupBy("root").agg(F.min("first_id").alias("least")), "roots")
    known = looked_up(linked.select("cls", "root"), least, ["root"])
    named = classes.select("cls", "first_id", "mult").join(known, "cls", "left").join(counts, "cls", "left")
    full = named.select("cls", F.coalesce("least", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"))
    mine = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "cls").join(full, "cls", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), F.coalesce(F.col("vec_id") == mine, F.lit(False)).alias("kept"))
