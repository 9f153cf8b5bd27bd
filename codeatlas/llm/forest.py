"""Near-duplicate documents by a MinHash LSH forest.

Every text becomes the set of hashes of its distinct k-word shingles and a MinHash signature. Texts with equal
sets form a class. Each of several trees orders the classes by another run of signature values; classes that
share the first values form a region, and within it the nearest neighbours in the order are those with the
longest common prefix, so dense regions are read at greater depth than sparse ones. Neighbours whose signatures
agree become candidates; each is confirmed on the full shingle sets. Rounds repeat on what is still apart:
classes already joined collapse into runs, which brings other components side by side, until a round joins
nothing. These rounds only make components large early. A last pass then compares every two classes of a region
that are still in different components, all members of each, in pairs of blocks, so nothing hangs on the order.
A region is never gathered: tasks read ranges of the sorted order, or two blocks.

Null, empty and blank texts have no shingles and link with nothing. Exact copies and repeated rows share a
class. A null id never becomes a component id while the component has another. Long texts are shingled in parts, all
of them. An empty table gives an empty result; near_duplicates ignores extra columns, keep_one returns them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, free_name, looked_up, materialise, sided
from .components import extended, rooted
from .words import mix, shingle_sets, text_slices

TREES, STRIDE, DEPTH = 12, 5, 10
VALUES = (TREES - 1) * STRIDE + DEPTH
#: Neighbours read on each side of the sorted order in a round.
REACH = 6
#: Classes in a block of the last pass, about.
BLOCK = 256
#: A pair at the similarity threshold is missed by all trees, or by the signature test, this rarely at most.
MISS = 3e-4
_rng = np.random.default_rng(7)
SCALE = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def least_depth(similarity: float) -> int:
    """The deepest common prefix that pairs at the threshold reach in some tree, but for MISS of them."""
    fits = [r for r in range(1, STRIDE + 1) if (1 - similarity**r) ** TREES <= MISS]
    return max(fits, default=1)


def least_agreement(similarity: float) -> int:
    """Signature values that must agree: four and a half deviations below what the threshold predicts."""
    mean, dev = VALUES * similarity, math.sqrt(VALUES * similarity * (1 - similarity))
    return max(1, math.floor(mean - 4.5 * dev))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 1 << 13):
        out = np.minimum(out, mix(s[at : at + (1 << 13), None] * SCALE + SHIFT).min(axis=0))
    return (out >> np.uint64(32)).astype(">u4")


def class_id(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    a = np.add.reduce(mix(s + np.uint64(0x51ED270B)), dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA0761D6478BD642F)))
    return np.array([a, b], dtype=">u8").tobytes()


def signatures(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, md5 (of the text), n_shingles, cid, sig; cid and sig are null without words."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("md5"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                sets = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_id(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "md5", "n_shingles", "cid", "sig"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, md5 binary, n_shingles long, cid binary, sig binary")


def forest(classes: DataFrame, depth: int) -> DataFrame:
    """tree, key, cid, low: the classes that share a region with another one; low is the signature, 8 bits a value."""
    key = lambda t: F.substring("sig", STRIDE * 4 * t + 1, DEPTH * 4)
    region = lambda t: F.xxhash64(F.lit(t), F.substring("sig", STRIDE * 4 * t + 1, depth * 4))
    placed = classes.select("cid", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), region(t).alias("region")) for t in range(TREES)])).alias("p")).select("cid", "p.*")
    shared = placed.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    kept = placed.join(shared, "region", "left_semi").groupBy("cid").agg(F.collect_set("tree").alias("trees"))  # 12 at most

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, VALUES, 4)
            last = [x.tobytes() for x in np.ascontiguousarray(values[:, :, 3])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(last, pa.binary())], names=["cid", "sig", "trees", "low"])

    rows = classes.join(kept, "cid").select("cid", "sig", "trees").mapInArrow(low, "cid binary, sig binary, trees array<int>, low binary")
    keys = F.array(*[key(t) for t in range(TREES)])
    return rows.withColumn("keys", keys).select("cid", "low", "keys", F.explode("trees").alias("tree")).select("tree", F.get("keys", F.col("tree")).alias("key"), "cid", "low")


def neighbours(rows: DataFrame, depth: int, agreement: int, best_only: bool) -> DataFrame:
    """a, b, agree: neighbours of the sorted order in different components whose signatures agree.

    rows: tree, key, cid, low, root. A carry of REACH rows joins one batch to the next.
    """
    spread = rows.repartitionByRange("tree", "key", "cid").sortWithinPartitions("tree", "key", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree = batch.column(0).to_numpy()
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, DEPTH)
            cid = np.array(batch.column(2).to_pylist(), dtype=object)
            low = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(n, VALUES)
            root = np.array(batch.column(4).to_pylist(), dtype=object)
            # a run of one component shows its first and last rows alone; `finish` compares the inner ones
            same = (root[1:] == root[:-1]) & (tree[1:] == tree[:-1])
            inner = np.zeros(n, dtype=bool)
            inner[1:-1] = same[1:].astype(bool) & same[:-1].astype(bool)
            cols = [x[~inner] for x in (tree, key[:, :depth], cid, low, root)]
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            tree, key, cid, low, root = cols
            m = len(tree)
            i_all, j_all, agree_all = [], [], []
            for d in range(1, min(REACH, m - 1) + 1):
                i = np.arange(max(0, fresh - d), m - d)
                j = i + d
                near = (tree[i] == tree[j]) & (key[i] == key[j]).all(axis=1)
                i, j = i[near], j[near]
                apart = (root[i] != root[j]).astype(bool)
                i, j = i[apart], j[apart]
                agree = (low[i] == low[j]).sum(axis=1)
                ok = agree >= agreement
                i_all.append(i[ok]), j_all.append(j[ok]), agree_all.append(agree[ok])
            if i_all:
                i, j, agree = np.concatenate(i_all), np.concatenate(j_all), np.concatenate(agree_all)
                if best_only:  # the best of each row is enough while nothing is joined yet
                    order = np.lexsort((j, -agree, i))
                    i, j, agree = i[order], j[order], agree[order]
                    first = np.ones(len(i), dtype=bool)
                    first[1:] = i[1:] != i[:-1]
                    i, j, agree = i[first], j[first], agree[first]
                if len(i):
                    a, b = cid[i], cid[j]
                    swap = a > b
                    left, right = np.where(swap, b, a), np.where(swap, a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])
            held = [c[-REACH:] for c in cols]

    return spread.select("tree", "key", "cid", "low", "root").mapInArrow(run, "a binary, b binary, agree int")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """u, v: the pairs of classes whose full sets meet den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = [[s for _, _, data, offsets in text_slices(part.column(c)) for s in shingle_sets(data, offsets, k)] for c in (2, 3)]
                ok = []
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "u binary, v binary")


def picked(pairs: DataFrame, labels: DataFrame | None, first: bool) -> DataFrame:
    """The pairs a round confirms. First: each class's best, least and greatest neighbour. Later: all distinct ones."""
    if not first:
        return pairs.select("a", "b").distinct()
    both = pairs.select("a", "b", "agree", F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("a", "b", "agree", F.col("b").alias("node"), F.col("a").alias("other")))
    chosen = both.groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("x"), F.min(F.struct("other", "a", "b")).alias("y"), F.max(F.struct("other", "a", "b")).alias("z"))
    return chosen.select(F.explode(F.array(*[F.struct(F.col(f"{c}.a").alias("a"), F.col(f"{c}.b").alias("b")) for c in "xyz"])).alias("p")).select("p.*").distinct()


def region_blocks(marked: DataFrame, depth: int) -> DataFrame:
    """tree, region, lo, hi, mine, cid, root: each class once for every two blocks of its region that it is part of.

    Blocks of a component with more than BLOCK classes in a region hold it alone and don't meet each other; all
    other classes of the region share blocks. Regions of one component are left out.
    """
    region = F.xxhash64("tree", F.substring("key", 1, depth * 4))
    rows = marked.select("tree", region.alias("region"), "cid", "root")
    sizes = rows.groupBy("region", "root").agg(F.count("*").alias("n"))
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    big = F.col("n") > BLOCK
    plan = sizes.groupBy("region").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), parts(F.coalesce(F.sum(F.when(~big, F.col("n"))), F.lit(0))).alias("small"),
        F.collect_list(F.when(big, F.struct("root", parts(F.col("n")).alias("n")))).alias("big"),
    ).where("x <> y").drop("x", "y")
    plan = sided(materialise(plan, "blocks"))
    block = lambda root, i: F.xxhash64(root, i)
    count = lambda n: F.sequence(F.lit(0), n - 1)
    shared = F.when(F.col("small") > 0, F.transform(count(F.col("small")), lambda i: i.cast("long"))).otherwise(F.array().cast("array<long>"))
    others = F.filter("big", lambda b: b["root"] != F.col("root"))
    alone = F.flatten(F.transform(others, lambda b: F.transform(count(b["n"]), lambda i: block(b["root"], i))))
    own = F.get(F.filter("big", lambda b: b["root"] == F.col("root")), F.lit(0))["n"]
    salt = F.xxhash64(F.lit("block"), "cid")
    mine = F.when(own.isNotNull(), block(F.col("root"), F.pmod(salt, own).cast("int"))).otherwise(F.pmod(salt, F.col("small")))
    met = rows.join(plan, "region").select("tree", "region", "cid", "root", mine.alias("mine"), F.explode(F.concat(shared, alone)).alias("other"))
    return met.select("tree", "region", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "cid", "root")


def agreeing(tree: int, depth: int, agreement: int, sig: np.ndarray, root: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of x and y in different components whose signatures agree and which no earlier tree compares."""
    left, right = [], []
    whole = x is y
    for at, i in enumerate(x):
        js = y[at + 1 :] if whole else y
        js = js[root[js] != root[i]]
        same = sig[js] == sig[i]
        enough = same.sum(axis=1) >= agreement
        if not enough.any():
            continue
        js, same = js[enough], same[enough]
        # a region is a hash of the prefix
        ok = same[:, STRIDE * tree : STRIDE * tree + depth].all(axis=1)
        for t in range(tree):
            ok &= ~same[:, STRIDE * t : STRIDE * t + depth].all(axis=1)
        js = js[ok]
        left.append(np.full(len(js), i)), right.append(js)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j: pair by pair, or where pairs are many by products of incidences."""
    rows, cols = np.unique(i), np.unique(j)
    if len(i) <= 4 * (len(rows) + len(cols)):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    flat = [(np.repeat(np.arange(len(g)), [len(sets[k]) for k in g]), np.concatenate([sets[k] for k in g])) for g in (rows, cols)]
    common = np.intersect1d(flat[0][1], flat[1][1])
    out = np.zeros((len(rows), len(cols)), dtype=np.int64)
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        sides = []
        for g, (row, value) in zip((rows, cols), flat, strict=True):
            place = np.minimum(np.searchsorted(part, value), len(part) - 1)
            hit = part[place] == value
            side = np.zeros((len(g), len(part)), dtype=np.float32)
            side[row[hit], place[hit]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out[np.searchsorted(rows, i), np.searchsorted(cols, j)]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(key[:, a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def finish(marked: DataFrame, texts: DataFrame, depth: int, agreement: int, k: int, num: int, den: int) -> DataFrame:
    """u, v: links that join all components with a pair of classes that share a region, agree and are similar.

    Signatures alone tell first which classes have a pair; only these bring their texts.
    """
    keys = ["region", "lo", "hi"]
    kind = "region long, lo long, hi long, tree int, mine long, cid binary, root binary"

    def pairs_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), dtype=np.uint32).reshape(-1, VALUES)
        root = np.unique(np.array(group["root"].to_pylist(), dtype=object), return_inverse=True)[1]
        mine = group["mine"].to_numpy()
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        x = np.flatnonzero(mine == lo)
        return agreeing(group["tree"][0].as_py(), depth, agreement, sig, root, x, x if lo == hi else np.flatnonzero(mine == hi))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, len(keys)):
            i, j = pairs_of(group)
            if len(i):
                yield from group.drop_columns(["sig"]).take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, len(keys)):
            i, j = pairs_of(group)
            sets = [s for chunk in group["text"].chunks for _, _, data, offsets in text_slices(chunk) for s in shingle_sets(data, offsets, k)]
            size = np.array([len(s) for s in sets])
            # sets of too different sizes can't be similar
            fits = den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
            both = overlaps(sets, i, j)
            good = den * both >= num * (size[i] + size[j] - both)
            cid = group["cid"].to_pylist()
            up = {}
            u, v = [], []
            # links that close a circle tell nothing new
            for a, b in zip(i[good].tolist(), j[good].tolist(), strict=True):
                p, q = a, b
                while p in up:
                    p = up[p]
                while q in up:
                    q = up[q]
                if p != q:
                    up[p] = q
                    u.append(cid[a]), v.append(cid[b])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    named = [c.split()[0] for c in kind.split(", ")]
    dealt = lambda df, extra: df.select(*named, extra).repartition(*keys).sortWithinPartitions(*keys)
    met = region_blocks(marked, depth)
    near = materialise(dealt(met.join(texts.select("cid", "sig"), "cid"), "sig").mapInArrow(some, kind), "near")
    full = near.join(texts, "cid").select(*named, "sig", "text").repartition(*keys).sortWithinPartitions(*keys)
    return full.mapInArrow(links, "u binary, v binary")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, most_rounds: int = 12) -> DataFrame:
    """doc_id, md5, n_shingles, component (class id or null), component_id, kept for every row of docs.

    Texts link when den * |A and B| >= num * |A or B| over their distinct k-word shingles. most_rounds bounds the
    quick rounds alone; the last pass compares whatever they leave.
    """
    depth, agreement = least_depth(num / den), least_agreement(num / den)
    rows = materialise(signatures(docs, doc_id, text, k), "signatures")
    worded = rows.where(F.col("cid").isNotNull())
    classes = worded.groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.min("md5").alias("md5"), F.min("sig").alias("sig"))
    trees = materialise(forest(classes.select("cid", "sig"), depth), "forest")
    needed = trees.select("cid").distinct().join(classes.select("cid", "md5", "sig"), "cid")
    keyed = docs.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("md5"), F.col(text).alias("text"))
    texts = materialise(keyed.join(sided(materialise(needed, "needed")), "md5").dropDuplicates(["cid"]).select("cid", "sig", "text"), "texts")
    tried, labels = None, None

    def marked() -> DataFrame:
        if labels is None:
            return trees.withColumn("root", F.col("cid"))
        return trees.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    for turn in range(most_rounds):
        pairs = picked(neighbours(marked(), depth, agreement, turn == 0), labels, turn == 0)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        good = materialise(confirm(pairs, texts, k, num, den), "links")
        n = good.count()
        tried = pairs if tried is None else tried.union(pairs)
        if n:
            labels = extended(labels, good.select("u", "v"))
        elif turn:
            break
    rest = materialise(finish(marked(), texts, depth, agreement, k, num, den), "rest")
    if rest.count():
        labels = extended(labels, rest)
    drop_table(texts)
    if labels is None:
        named = classes.select("cid", F.col("cid").alias("component"), F.col("first_id").alias("component_id"))
    else:
        # only classes with a label, and the roots they name, have others in their component
        linked = rooted(labels).select(F.col("node").alias("cid"), F.col("root").alias("component")).join(classes.select("cid", "first_id"), "cid")
        least = materialise(linked.groupBy("component").agg(F.min("first_id").alias("least")), "least")
        known = looked_up(linked.select("cid", "component"), least, ["component"])
        named = classes.select("cid", "first_id").join(known, "cid", "left").select("cid", F.coalesce("component", "cid").alias("component"), F.coalesce("least", "first_id").alias("component_id"))
    out = rows.select("doc_id", "md5", "n_shingles", "cid").join(named, "cid", "left")
    mine: Column = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "md5", "n_shingles", "component", mine.alias("component_id"), F.coalesce(F.col("doc_id") == mine, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row left of every group of near copies: the least id, then the least text hash.

    Rows without words all stay. Of rows that repeat both id and text one stays.
    """
    found = materialise(near_duplicates(docs, doc_id=doc_id, text=text, **options).select("doc_id", "md5", "component"), "groups")
    linked = found.where(F.col("component").isNotNull())
    # nulls order first in structs, so a flag puts null ids last
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("md5").alias("m"))
    best = linked.groupBy("component").agg(F.min(order).alias("w"), F.count("*").alias("n")).where("n > 1")
    lost = linked.join(best, "component").where(order != F.col("w")).select(F.col("doc_id").alias("_i"), F.col("md5").alias("_m")).distinct()
    again = linked.groupBy("doc_id", "md5").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_i"), F.col("md5").alias("_m"))
    mark, name, same_text = (free_name(c, docs.columns) for c in ("mark", "name", "same_text"))
    keyed = docs.withColumn(mark, F.unhex(F.md5(F.col(text).cast("binary"))))
    ids = lambda df: sided(materialise(df.select(F.col("_i").alias(name), F.col("_m").alias(same_text)), "marks"))
    same = F.col(doc_id).eqNullSafe(F.col(name)) & (F.col(mark) == F.col(same_text))
    left = keyed.join(ids(lost), same, "left_anti")
    again = ids(again)
    single = left.join(again, same, "left_anti")
    repeated = left.join(again, same, "left_semi").dropDuplicates([doc_id, mark])
    return single.unionByName(repeated).select(*[f"`{c}`" for c in docs.columns])
