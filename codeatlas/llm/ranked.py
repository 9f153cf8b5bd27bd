"""Ranked lexical search: every item's best documents by a saturating term weight.

Documents are dealt into shards of about SHARD_BYTES of text, where they lie: no text is shuffled. A shard's documents
are sorted by id and numbered, and each term gets one posting list, the numbers' differences and the frequencies as
variable-length bytes. The lists are written once; counts of documents and words over all shards give the weights.
Then each shard answers items document by document: a heap holds the next document of each of the item's lists, the
least is taken and scored, and a bounded heap keyed by score and id keeps the best. Lists whose greatest scores
together can't reach the worst of the best are not merged but looked up for documents that others name. The best of
all shards are merged by item.

Null and empty texts hold no terms and are never found, nor do they count. A null id comes after all others. Items
without terms, or whose terms no document holds, give no rows; rows that repeat an item's id and text are one item.
Rows that repeat a document are documents of their own, in the order of equal ids. Of equal scores the least id comes
first. Long texts are split in pieces. Items are worked in blocks of about BLOCK_TERMS terms, each against all shards. If the
items' terms are too many to be sent to every task, all terms are indexed. Without documents or items there are no
rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, is_small, looked_up, materialise

#: Bytes of text and documents of a shard, bytes of a text split at once, and terms of a block of items.
SHARD_BYTES, SHARD_DOCS, PIECE, BLOCK_TERMS = 16 << 20, 100_000, 1 << 20, 200_000
#: Fixed by the contract: what terms are made of, after A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_fold = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_between = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def frequencies(text: bytes) -> tuple[int, Counter]:
    """How many terms a text holds, and how often each."""
    counts: Counter = Counter()
    n = at = 0
    while at < len(text):
        stop = _between.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        terms = text[at:end].translate(_fold).split()
        counts.update(terms)
        n, at = n + len(terms), end
    return n, counts


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of values, seven bits each and the high bit where more follow, and how many each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > k)
        more = (size[rows] > k + 1).astype(np.uint8) << 7
        out[at[rows] + k] = ((values[rows] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(int((ends - begins).max(initial=-1)) + 1):
        rows = np.flatnonzero(ends - begins >= k)
        out[rows] |= (raw[begins[rows] + k] & 127).astype(np.int64) << (7 * k)
    return out


class Shard:
    """Documents as they are read, until they become posting lists."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.size = 0
        self.numbers: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, int]] = []

    def add(self, doc_id, text: bytes, wanted: frozenset | None) -> None:
        self.size += len(text)
        n, counts = frequencies(text)
        if not n:
            return
        held = counts.keys() & wanted if wanted is not None else counts.keys()
        terms = np.fromiter((self.numbers.setdefault(t, len(self.numbers)) for t in held), dtype=np.int32, count=len(held))
        self.parts.append((terms, np.fromiter((counts[t] for t in held), dtype=np.int64, count=len(held)), len(self.ids)))
        self.ids.append(doc_id)
        self.lengths.append(n)

    def rows(self, shard: int) -> Iterator[tuple]:
        """(shard, term, n, words, docs, tfs): a row of the documents' ids and lengths, whose term is null, then one a term."""
        if not self.ids:
            return
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        known = np.array([self.ids[i] for i in order if self.ids[i] is not None], dtype=np.int64)
        lengths = np.array([self.lengths[i] for i in order], dtype=np.int64)
        yield shard, None, len(order), int(lengths.sum()), packed(np.diff(known, prepend=0))[0].tobytes(), packed(lengths)[0].tobytes()
        if not self.numbers:
            return
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        term = np.concatenate([t for t, _, _ in self.parts])
        tf = np.concatenate([f for _, f, _ in self.parts])
        doc = np.repeat(place[[d for _, _, d in self.parts]], [len(t) for t, _, _ in self.parts])
        by = np.lexsort((doc, term))
        term, tf, doc = term[by], tf[by], doc[by]
        first = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]])
        gap = np.diff(doc, prepend=0)
        gap[first[:-1]] = doc[first[:-1]]
        (gaps, gap_size), (tfs, tf_size) = packed(gap), packed(tf)
        at, tf_at = np.concatenate([[0], np.cumsum(gap_size)]), np.concatenate([[0], np.cumsum(tf_size)])
        names = list(self.numbers)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield shard, names[term[a]].decode(), int(b - a), None, gaps[at[a] : at[b]].tobytes(), tfs[tf_at[a] : tf_at[b]].tobytes()


def index(docs: DataFrame, wanted: frozenset | None = None, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The posting lists of docs, as Shard.rows gives them, of the wanted terms (bytes) or of all; a written table.

    A shard's number is its task's and its own within the task, so a task that runs again writes the same shards.
    """
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("words", pa.int64()), ("docs", pa.binary()), ("tfs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = Shard()

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = list(shard.rows(number))
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 4096], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                shard.add(i, value.as_py() or b"", wanted)
                if shard.size >= shard_bytes or len(shard.ids) >= SHARD_DOCS:
                    yield from flushed()
                    number, shard = number + 1, Shard()
        yield from flushed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(rows.mapInArrow(run, "shard bigint, term string, n bigint, words bigint, docs binary, tfs binary"), "postings")


class Lists:
    """The posting lists of one shard as (numbers, scores, greatest score), made when an item first asks."""

    def __init__(self, ids: bytes, lengths: bytes, n_docs: int, n_words: int) -> None:
        each = unpacked(lengths).tolist()
        known = np.cumsum(unpacked(ids)).tolist()
        self.ids = known + [None] * (len(each) - len(known))
        self.norm = np.array([10 + 90 * n * n_docs // n_words for n in each], dtype=np.int64)
        self.raw: dict[str, tuple[bytes, bytes]] = {}
        self.made: dict[str, tuple[array, array, int]] = {}

    def of(self, term: str, weight: int) -> tuple[array, array, int] | None:
        if term not in self.made and term in self.raw:
            gaps, tfs = self.raw.pop(term)
            docs, tf = np.cumsum(unpacked(gaps)), unpacked(tfs)
            scores = weight * (1_000_000_000 * tf // (1000 * tf + 8 * self.norm[docs]))
            self.made[term] = array("q", docs.tobytes()), array("q", scores.tobytes()), int(scores.max())
        return self.made.get(term)


def search_shard(lists: Lists, terms: list[tuple[str, int]], best: list[tuple], most: int) -> None:
    """Merges an item's lists document by document into best, a heap of (score, whether the id is known, -id)."""
    found = [x for x in (lists.of(t, w) for t, w in terms) if x is not None]
    found.sort(key=lambda x: x[2])
    # upto[k]: what the k weakest lists can give together
    upto = [0]
    for x in found:
        upto.append(upto[-1] + x[2])
    least = best[0][0] if len(best) == most else 0
    # the weakest lists that can't fill a place by themselves are looked up, the others merged
    weak = 0
    while weak < len(found) and upto[weak + 1] < least:
        weak += 1
    at = [0] * len(found)
    heap = [(found[k][0][0], k) for k in range(weak, len(found))]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            k = heap[0][1]
            if k < weak:  # has become weak since, and is looked up from now on
                heapq.heappop(heap)
                continue
            docs, scores, _ = found[k]
            score += scores[at[k]]
            at[k] += 1
            if at[k] < len(docs):
                heapq.heapreplace(heap, (docs[at[k]], k))
            else:
                heapq.heappop(heap)
        for k in range(weak - 1, -1, -1):
            if score + upto[k + 1] < least:
                score = -1
                break
            docs, scores, _ = found[k]
            at[k] = bisect_left(docs, doc, at[k])
            if at[k] < len(docs) and docs[at[k]] == doc:
                score += scores[at[k]]
        if score > 0:
            name = lists.ids[doc]
            entry = (score, name is not None, -(name or 0))
            if len(best) < most:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == most and best[0][0] > least:
                least = best[0][0]
                while weak < len(found) and upto[weak + 1] < least:
                    weak += 1


def answers(postings: DataFrame, block: list[tuple[int, list[tuple[str, int]]]], totals: tuple[int, int], most: int) -> DataFrame:
    """item, doc_id, score: of every task's shards the best documents of each item. block: item, its terms and weights."""
    n_docs, n_words = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block]
        now, lists = None, None

        def finish() -> None:
            for (_, terms), heap in zip(block, best, strict=True):
                search_shard(lists, terms, heap, most)

        for batch in batches:
            for shard, term, docs, tfs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != now:
                    if lists:
                        finish()
                    now, lists = shard, Lists(docs, tfs, n_docs, n_words)  # the row without a term comes first
                else:
                    lists.raw[term] = docs, tfs
        if lists:
            finish()
        rows = [(item, -i if known else None, score) for (item, _), heap in zip(block, best, strict=True) for score, known, i in heap]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (item, doc, score)], names=["item", "doc_id", "score"])

    by_shard = postings.select("shard", "term", "docs", "tfs").repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return by_shard.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = 10, shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `most` best documents with a score above 0. Ids of documents are integers."""
    each = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    each = materialise(each.withColumn("item", F.monotonically_increasing_id()), "items")
    words = F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS, -1), "")
    asked = materialise(each.select("item", F.explode(F.array_distinct(words)).alias("term")), "asked")
    terms = materialise(asked.select("term").distinct(), "vocabulary")
    wanted = frozenset(r.term.encode() for r in terms.collect()) if is_small(terms) else None
    postings = index(docs, wanted, doc_id=doc_id, text=text, shard_bytes=shard_bytes)
    n_docs, n_words = postings.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = postings.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).alias("w")
    weighted = materialise(looked_up(asked, materialise(df.select("term", weight).where("w > 0"), "weights"), ["term"]), "weighted")
    count = max(1, -(-weighted.count() // block_terms))
    out = None
    for b in range(count):
        held: dict[int, list] = {}
        # about block_terms rows
        for r in weighted.where(F.pmod(F.xxhash64("item"), F.lit(count)) == b).toLocalIterator():
            held.setdefault(r.item, []).append((r.term, r.w))
        mine = postings
        if count > 1 or wanted is None:
            names = {t for block in held.values() for t, _ in block}
            few = docs.sparkSession.createDataFrame([(t,) for t in names], "term string")
            mine = postings.where("term is null").unionByName(looked_up(postings.where("term is not null"), few, ["term"], "left_semi").select(*postings.columns))
        found = materialise(answers(mine, sorted(held.items()), (n_docs, n_words), most), "answers")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    kind = docs.schema[doc_id].dataType
    return looked_up(top, each.select("item", "item_id"), ["item"]).select("item_id", "rank", F.col("doc_id").cast(kind).alias("doc_id"), "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (
  SELECT item, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS t FROM i
), total AS (
  SELECT count(*)::HUGEINT AS n_docs, sum(len(w))::HUGEINT AS n_words FROM d WHERE len(w) > 0
), m AS (
  SELECT r, doc_id, 100 - 90 + (90 * len(w) * n_docs) // n_words AS m FROM d, total WHERE len(w) > 0
), tf AS (
  SELECT r, t, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL
), wt AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total
), s AS (
  SELECT item, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL
), o AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o JOIN i USING (item) WHERE rank <= 10
"""
