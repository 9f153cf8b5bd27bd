"""Language-model scoring by context-tree weighting over byte contexts.

A byte is coded as eight binary decisions. Every decision sees the contexts of the last 0 to DEPTH bytes; each
context of each binary node keeps a Krichevsky-Trofimov estimate, and the weights of context-tree weighting mix
the estimates of all depths. Counting, the bottom-up weights and the top-down mixture are joins and sums over
(context, node) rows, whose keys never hold more than 256 children, so nothing is gathered or broadcast; the
deepest level is worked in arrays, one shorter context at a time.

Texts are scored by blocks of rows: a block asks for the n-grams it holds, the model answers that block
alone, and its texts meet the answers in a sorted partition. Nothing grows with the vocabulary in one task but
the answers to one block.

The text is its words with A-Z lowered, one space between them, and one end byte (0); contexts before the start are 0. A context that no
training text has leaves its weight with the deepest one seen. A NUL byte in a text is coded like an end. Null texts
count as empty: one end token. Long texts are worked in arrays of eight bytes a byte of text. An empty table gives an
empty result; without training rows every byte has the probability of an unseen context. Extra columns are ignored.
Repeated rows count as often as they occur; rows with null ids belong to the fold of the text 'null'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fold, materialise
from .words import LOWER, SPACE, text_slices, word_hashes

#: Bytes of the longest context; a context and its byte must fit 56 bits.
DEPTH = 5
#: Rows whose n-grams are answered together: BLOCK_ROWS, or as many as have BLOCK_BYTES of the table's mean length. Texts
#: of more than LONG bytes are answered alone.
BLOCK_ROWS, BLOCK_BYTES, LONG = 8192, 28 << 20, 448 << 10
#: Rows of counts that are handed over at once.
HANDED = 1 << 16
#: Bytes of text worked on at once.
PIECE = 1 << 19
END = np.uint64(0x5BF03635F0A31B27)


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 0.5, by Stirling's series eight steps above x."""
    y = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - F.ln(product)


def log_kt(n0: Column, n1: Column) -> Column:
    """ln of the KT probability of a sequence with n0 zeros and n1 ones."""
    half = 0.5723649429247001  # ln Gamma(1/2)
    n0, n1 = n0.cast("double"), n1.cast("double")
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 2 * half - log_gamma(n0 + n1 + 1)


def one_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z lowered, white space between words as one space and none at the ends."""
    low = LOWER[data]
    inside = ~SPACE[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside[1:] & ~inside[:-1] & ~edge[1:-1]) + 1  # words after white space
    words = np.concatenate([[0], np.cumsum(inside)])
    later = words[begins] > words[offsets[np.searchsorted(offsets, begins, side="right") - 1]]  # not the first of a text
    kept = inside.copy()
    kept[begins[later] - 1] = True
    low[~inside] = 0x20
    return low[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def keys_of(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) keys of every position of every text with its end byte, and where each text begins."""
    data, offsets = one_space(data, offsets)
    lengths = np.diff(offsets) + 1 + depth
    begin = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=begin[1:])
    padded = np.zeros(begin[-1], dtype=np.uint8)
    place = np.ones(begin[-1], dtype=bool)
    for d in range(depth):
        place[begin[:-1] + d] = False
    place[begin[1:] - 1] = False
    padded[place] = data
    keys = np.zeros(len(padded), dtype=np.int64)
    for d in range(depth + 1):
        keys[d:] |= padded[: len(padded) - d].astype(np.int64) << (8 * d)
    real = np.ones(len(padded), dtype=bool)
    for d in range(depth):
        real[begin[:-1] + d] = False
    first = begin - depth * np.arange(len(begin))
    return keys[real], first


def blocks(docs: DataFrame, doc_id: str, text: str, folds: int, held: int) -> DataFrame:
    """block, doc_id, train, text. A block is a run of rows of a parquet file, without its long texts, or one of these.

    Both passes name it alike, however the scan is cut into tasks; a block that two tasks share is counted in two parts.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0))
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES * n // max(total, 1)))
    place = F.col("_metadata.row_index")
    where = F.xxhash64("_metadata.file_path", F.floor(place / rows), F.when(size > LONG, place))
    return docs.select(where.alias("block"), F.col(doc_id).alias("doc_id"), (fold(doc_id, folds) != held).alias("train"), F.col(text).alias("text"))


def count(rows: DataFrame, depth: int) -> DataFrame:
    """part (0 n-grams, 1 words), block, key, n: counts in training texts; 0 where only other texts have a key."""

    def merge(parts: list[tuple]) -> tuple:
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        out, where = np.unique(keys, return_inverse=True)
        return out, np.bincount(where, weights=n, minlength=len(out)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}

        def flush(which: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            all_keys, all_n = merge(held.pop(which))
            for k in range(0, len(all_keys), HANDED):
                keys, n = all_keys[k : k + HANDED], all_n[k : k + HANDED]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(which[0], pa.int8()), len(keys)), pa.array(np.full(len(keys), which[1])), pa.array(keys), pa.array(n)], names=["part", "block", "key", "n"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            train = batch.column(1).to_numpy(zero_copy_only=False)
            names = np.unique(block)
            for which in [w for w in held if w[1] not in names]:
                yield from flush(which)
            for name in names.tolist():
                mine = np.flatnonzero(block == name)
                for a, b, data, offsets in text_slices(batch.column(2).take(pa.array(mine)), PIECE):
                    learn = train[mine[a:b]]
                    keys, first = keys_of(data, offsets, depth)
                    words, at = word_hashes(data, offsets)
                    for part, values, sizes in ((0, keys, np.diff(first)), (1, words.view(np.int64), np.diff(at))):
                        values, weight = values, np.repeat(learn, sizes)
                        if part:  # one end a text
                            values, weight = np.append(values, np.full(b - a, END.view(np.int64))), np.append(weight, learn)
                        seen, n = np.unique(values[weight], return_counts=True)
                        other = np.setdiff1d(values[~weight], seen)
                        parts = held.setdefault((part, name), [])
                        parts.append((np.concatenate([seen, other]), np.concatenate([n, np.zeros(len(other), dtype=np.int64)])))
                        if len(parts) >= 10:
                            held[part, name] = [merge(parts)]
        for which in list(held):
            yield from flush(which)

    return rows.select("block", "train", "text").mapInArrow(run, "part tinyint, block long, key long, n long")


def kt_array(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log_kt on arrays."""

    def ln_gamma(x: np.ndarray) -> np.ndarray:
        y, product = x + 8, x.copy()
        for i in range(1, 8):
            product = product * (x + i)
        return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)

    return ln_gamma(n0 + 0.5) + ln_gamma(n1 + 0.5) - 2 * 0.5723649429247001 - ln_gamma(n0 + n1 + 1.0)


def nodes_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight binary nodes of each key's byte, numbered as in a heap, and the bits taken there."""
    byte = key & 255
    node = np.stack([(1 << k) | (byte >> (8 - k)) for k in range(8)], axis=1)
    return node, np.stack([(byte >> (7 - k)) & 1 for k in range(8)], axis=1)


def tallied(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, node) ids at full depth, zeros and ones there, and each key's place among them and its bits."""
    node, bit = nodes_of(key)
    ids, where = np.unique((key >> 8 << 8)[:, None] | node, return_inverse=True)
    where = where.reshape(node.shape)
    count = np.repeat(n, 8).astype(np.float64)
    zeros = np.bincount(where.ravel(), count * (bit.ravel() == 0), len(ids))
    ones = np.bincount(where.ravel(), count * (bit.ravel() == 1), len(ids))
    return ids, zeros, ones, where, bit


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables cut between values of the first column, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        cut = int(np.searchsorted(first, first[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != first[0]):
            head = [*held, batch.slice(0, cut)]
            rows += cut
            if rows >= 1 << 15:
                yield pa.Table.from_batches(head)
                held, rows = [batch.slice(cut)], batch.num_rows - cut
                continue
            held, rows = [*head, batch.slice(cut)], rows + batch.num_rows - cut
        else:
            held, rows = [*held, batch], rows + batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def leaves(grams: DataFrame, depth: int) -> DataFrame:
    """ctx, node, n0, n1, below one level above full depth, from key, n.

    The deepest level holds most contexts, and each only a few bytes; so it is worked in arrays, n-grams as they
    are, in tasks that hold all contexts of one shorter context at once (65,536 n-grams at most).
    """
    up = F.shiftright("key", 8).bitwiseAND((1 << (8 * (depth - 1))) - 1)
    rows = grams.select(up.alias("up"), "key", "n").repartition("up").sortWithinPartitions("up", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key, n = table.column(1).to_numpy(), table.column(2).to_numpy()
            ids, zeros, ones, _, _ = tallied(key, n)
            shorter = ids & ((1 << (8 * depth)) - 1)  # the context one byte shorter, and the node
            out, where = np.unique(shorter, return_inverse=True)
            total = lambda x: np.bincount(where, x, len(out))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(out >> 8), pa.array((out & 255).astype(np.int16)), pa.array(total(zeros).astype(np.int64)), pa.array(total(ones).astype(np.int64)), pa.array(total(kt_array(zeros, ones)))],
                names=["ctx", "node", "n0", "n1", "below"],
            )

    return rows.mapInArrow(run, "ctx long, node smallint, n0 long, n1 long, below double")


def weights(grams: DataFrame, depth: int) -> list[DataFrame]:
    """Tables of ctx, node, n0, n1, kt (ln), below (ln of the children's product) from one level up to the root."""
    kt = log_kt(F.col("n0"), F.col("n1"))
    tables = [materialise(leaves(grams, depth).withColumn("kt", kt), "ctw")]
    mine = F.greatest("kt", "below") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("below")))) - F.lit(float(np.log(2)))
    for d in range(depth - 2, -1, -1):
        suffix = F.col("ctx").bitwiseAND((1 << (8 * d)) - 1)
        up = tables[-1].select(suffix.alias("ctx"), "node", "n0", "n1", mine.alias("w")).groupBy("ctx", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("below"))
        tables.append(materialise(up.withColumn("kt", kt), "ctw"))
    return tables


def mixture(tables: list[DataFrame]) -> DataFrame:
    """ctx, node, sure, open, p1 one level above full depth.

    Going down, `sure` is what the contexts so far contribute to the probability of a one, `open` the weight they
    leave to deeper ones, and p1 the probability if none is deeper. Without training data nothing changes.
    """
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    share = F.lit(1.0) / (1.0 + F.exp(F.col("below") - F.col("kt")))
    root = tables[-1].select("ctx", "node", estimate.alias("p1"), share.alias("share"))
    state = root.select("ctx", "node", (F.col("share") * F.col("p1")).alias("sure"), (1 - F.col("share")).alias("open"), "p1")
    for d in range(1, len(tables)):
        parent = state.select(F.col("ctx").alias("up"), "node", "sure", "open", "p1")
        child = tables[len(tables) - 1 - d].select("ctx", "node", F.col("ctx").bitwiseAND((1 << (8 * (d - 1))) - 1).alias("up"), F.when((F.col("n0") + F.col("n1")) > 0, F.struct(estimate.alias("e"), share.alias("s"))).alias("x"))
        seen, e, s = F.col("x").isNotNull(), F.col("x.e"), F.col("x.s")
        state = child.join(parent, ["up", "node"]).select(
            "ctx",
            "node",
            F.when(seen, F.col("sure") + F.col("open") * s * e).otherwise(F.col("sure")).alias("sure"),
            F.when(seen, F.col("open") * (1 - s)).otherwise(F.col("open")).alias("open"),
            F.when(seen, F.col("sure") + F.col("open") * e).otherwise(F.col("p1")).alias("p1"),
        )
    return state


def byte_costs(grams: DataFrame, mixed: DataFrame, depth: int) -> DataFrame:
    """key, value: log10 probability of the byte after its context, at full depth where training texts have it."""
    up = F.shiftright("key", 8).bitwiseAND((1 << (8 * (depth - 1))) - 1)
    none = F.lit(None).cast("double")
    g = grams.select(up.alias("up"), F.lit(1).cast("tinyint").alias("side"), "key", "n", none.alias("sure"), none.alias("open"), none.alias("p1"))
    m = mixed.select(F.col("ctx").alias("up"), F.lit(0).cast("tinyint").alias("side"), F.shiftleft("ctx", 8).bitwiseOR(F.col("node").cast("long")).alias("key"), F.lit(0).cast("long").alias("n"), "sure", "open", "p1")
    met = g.unionByName(m).repartition("up").sortWithinPartitions("up", "side", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            side, key, n = (table.column(k).to_numpy() for k in (1, 2, 3))
            above, gram = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(gram):
                continue
            key, n, parent = key[gram], n[gram], key[above]
            order = np.argsort(parent)
            sure, open_, p1 = (table.column(k).to_numpy()[above][order] for k in (4, 5, 6))
            ids, zeros, ones, where, bit = tallied(key, n)
            at = np.searchsorted(parent[order], ids & ((1 << (8 * depth)) - 1))
            p = np.where(zeros + ones > 0, sure[at] + open_[at] * (ones + 0.5) / (zeros + ones + 1), p1[at])
            taken = np.where(bit == 1, p[where], 1 - p[where])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.log10(taken).sum(axis=1))], names=["key", "value"])

    return met.mapInArrow(run, "key long, value double")


def places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """np.searchsorted, with the keys taken in their order, so that neighbouring look-ups touch the same memory."""
    order = np.argsort(keys)
    at = np.empty(len(keys), dtype=np.int64)
    at[order] = np.searchsorted(table, keys[order])
    return at


def score_blocks(rows: DataFrame, answers: DataFrame, parts: int, depth: int) -> DataFrame:
    """Texts meet the answers of their block: sorted, so a task holds one block's answers and one batch of texts."""
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    a = answers.select("block", "part", "key", "value", "known", F.lit(None).cast(doc_type).alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(None).cast("string").alias("text"))
    t = rows.select("block", F.lit(2).cast("tinyint").alias("part"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("boolean").alias("known"), "doc_id", "train", "text")
    met = a.unionByName(t).repartition(parts, "block").sortWithinPartitions("block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, found = None, {}, {0: [], 1: []}
        for batch in batches:
            block, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1
            for cut in np.split(np.arange(len(block)), change):
                if not len(cut):
                    continue
                if block[cut[0]] != now:
                    now, tables, found = block[cut[0]], {}, {0: [], 1: []}
                piece, kind = batch.slice(int(cut[0]), len(cut)), int(part[cut[0]])
                if kind < 2:
                    found[kind].append((piece.column(2).to_numpy(), piece.column(3).to_numpy(), piece.column(4).to_numpy(zero_copy_only=False)))
                    continue
                for k in (0, 1):
                    if k not in tables:
                        cols = [np.concatenate(x) for x in zip(*found[k], strict=True)]
                        order = np.argsort(cols[0])
                        tables[k] = [c[order] for c in cols]
                        found[k] = []
                for i, j, data, offsets in text_slices(piece.column(7), PIECE):
                    keys, first = keys_of(data, offsets, depth)
                    table = tables[0]
                    at = places(table[0], keys)
                    if at.max(initial=-1) >= len(table[0]) or (table[0][at] != keys).any():
                        raise RuntimeError("a block has n-grams that were not counted: its file changed between the passes")
                    sums = np.concatenate([[0.0], np.cumsum(table[1][at])])
                    score = sums[first[1:]] - sums[first[:-1]]
                    words, begin = word_hashes(data, offsets)
                    table = tables[1]
                    at = places(table[0], words.view(np.int64))
                    sums = np.concatenate([[0.0], np.cumsum(table[1][at])])
                    seen = np.concatenate([[0], np.cumsum(table[2][at])])
                    end = np.searchsorted(table[0], END.view(np.int64))
                    size = np.diff(begin) + 1
                    base = sums[begin[1:]] - sums[begin[:-1]] + table[1][end]
                    known = seen[begin[1:]] - seen[begin[:-1]] + int(table[2][end])
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(5).slice(i, j - i), piece.column(6).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(np.diff(first).astype(np.int64))],
                        names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score", "n_bytes"],
                    )

    return met.mapInArrow(run, f"doc_id {doc_type}, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row.

    Learns from the rows outside fold `held` alone. Only rows of parquet files have places in them; what else docs
    may be is written as such a table first.
    """
    try:
        rows = blocks(docs, doc_id, text, folds, held)
        rows.schema  # noqa: B018 - resolves the columns
    except AnalysisException:
        rows = blocks(materialise(docs.select(doc_id, text), "ctwdocs"), doc_id, text, folds, held)
    counted = materialise(count(rows, depth), "grams")
    wanted = counted.select("part", "block", "key")
    grams = materialise(counted.where("part = 0").groupBy("key").agg(F.sum("n").alias("n")), "ngrams")
    words = materialise(counted.where("part = 1").groupBy("key").agg(F.sum("n").alias("n")), "vocabulary")
    total = words.agg(F.sum("n").alias("N"), F.sum((F.col("n") > 0).cast("long")).alias("V")).first()
    n, v = total.N or 0, total.V or 0
    tables = weights(grams, depth)
    costs = materialise(byte_costs(grams, mixture(tables), depth), "costs")
    for done in [*tables, grams]:
        drop_table(done)
    token = F.log10((F.col("n") + 1.0) / F.lit(float(n + v + 1)))
    model = costs.select(F.lit(0).cast("tinyint").alias("part"), "key", "value", F.lit(True).alias("known")).unionByName(words.select(F.lit(1).cast("tinyint").alias("part"), "key", token.alias("value"), (F.col("n") > 0).alias("known")))
    answers = wanted.join(model, ["part", "key"])
    parts = max(2 * counted.select("block").distinct().count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = score_blocks(rows, answers, parts, depth)
    return out.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
