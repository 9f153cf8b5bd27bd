"""Language identification by compression.

Each language gets raw-content zstandard dictionaries cut from its training texts. A text is encoded with every
dictionary, and the language whose dictionaries make it smallest wins; a narrow margin marks the row as
rejected, though the best guess is still given. Languages meet at equal sizes only: those with most training text
first, at the size they all have; the winner then meets the languages with less, its dictionary cut to theirs, and
gives way only to one clearly better. The training texts are a bounded sample, the least hashes of
each language, drawn by a bounded aggregate and never gathered whole.

Null texts and texts without letters are `und` with score 0. Without any training rows every text is `und`. Of equal
sizes the language first in order wins. Repeated rows get equal results, and each may be a training row. Long texts
are encoded whole. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold

#: Bounds of the training sample: documents a language, and characters a document. In the order of their hashes, as many
#: of them as fill a dictionary's bytes are used: texts of full length fill it at about 75.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 1500
DICTIONARY_BYTES, LEVEL = 110 * 1024, 8
#: Below this relative margin between the two smallest encodings a row is rejected.
NARROW = 0.02
#: A language with less training text than the winner so far takes its place by the lead NARROW, and with fewer
#: than LEAST_BYTES by the lead APART; below LEAST_BYTES a language that loses doesn't touch the margin.
LEAST_BYTES, APART = 4096, 0.1
#: Pieces of a long training text, spread evenly over it.
PIECES = 5
LETTER = regex.compile(r"\p{L}")
BETWEEN = regex.compile(r"[^\p{L}]+")


def pieces(text: str) -> Column:
    """A text of SAMPLE_CHARS characters at most as it is, else PIECES of it from its first to its last character."""
    each = SAMPLE_CHARS // PIECES
    starts = [(F.floor((F.length(text) - each) * i / (PIECES - 1)) + 1).cast("int") for i in range(PIECES)]
    return F.when(F.length(text) <= SAMPLE_CHARS, F.col(text)).otherwise(F.concat_ws(" ", *[F.substring(F.col(text), at, F.lit(each)) for at in starts]))


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, folds: int, held: int) -> dict[str, list[bytes]]:
    """Training texts of each language: bounded by SAMPLE_DOCS rows a language and SAMPLE_CHARS characters a row."""
    rows = docs.where((fold(doc_id, folds) != held) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    # rows are told apart by id and text, so repeated rows and null ids spread over the salts too
    h = F.xxhash64(F.lit("sample"), F.col(doc_id), F.col(text))
    hashed = rows.select(F.col(lang).alias("lang"), pieces(text).alias("text"), h.alias("h"))
    # two steps: the least of each salt, then the least of all, so that a hot language spreads over tasks
    salted = hashed.withColumn("salt", F.pmod("h", F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "text"))).where(F.col("r") <= SAMPLE_DOCS // 16)
    least = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= SAMPLE_DOCS)
    found: dict[str, list[bytes]] = {}
    for r in least.orderBy("lang", "r").select("lang", "text").toLocalIterator():
        found.setdefault(r.lang, []).append(letters(r.text))
    return found


def letters(text: str) -> bytes:
    """The letters of a text in lower case, other runs as one space: case, digits and junk say nothing of a language."""
    return BETWEEN.sub(" ", text.lower()).encode()


def dictionary(rows: list[bytes]) -> bytes:
    """Raw content of a language: its texts one after the other until DICTIONARY_BYTES are full."""
    return b"\n".join(rows)[:DICTIONARY_BYTES]


def level(content: bytes) -> int:
    """The size at which a language is compared: the greatest of DICTIONARY_BYTES and its halves that it reaches."""
    size = DICTIONARY_BYTES
    while size > 1 and size > len(content):
        size //= 2
    return size


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row. Learns from rows outside fold `held` alone."""
    raw = {name: dictionary(rows) for name, rows in sample(docs, doc_id, text, lang, folds, held).items() if any(rows)}
    sized: dict[int, list[str]] = {}
    for name in sorted(raw):
        sized.setdefault(level(raw[name]), []).append(name)
    levels = sorted(sized, reverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[tuple[str, int], zstandard.ZstdCompressor] = {}

        def encoded(name: str, size: int, data: bytes) -> int:
            if (name, size) not in coders:
                d = zstandard.ZstdCompressionDict(raw[name][:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                coders[name, size] = zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False)
            return len(coders[name, size].compress(data))

        def judge(data: bytes) -> tuple[str, float]:
            winner, margin = "und", 0.0
            for at, size in enumerate(levels):
                sizes = {n: encoded(n, size, data) for n in ([winner] if at else []) + sized[size]}
                order = sorted(sizes, key=lambda n: (sizes[n], n))
                best = order[0]
                second = sizes[order[1]] if len(order) > 1 else sizes[best] * 2
                lead = (second - sizes[best]) / max(second, 1.0)
                if not at:
                    winner, margin = best, lead
                elif best == winner:
                    margin = min(margin, lead) if size >= LEAST_BYTES else margin
                elif sizes[best] < (1 - (NARROW if size >= LEAST_BYTES else APART)) * sizes[winner]:
                    winner, margin = best, lead
                elif size >= LEAST_BYTES:
                    margin = 0.0
            return winner, margin

        for batch in batches:
            pred, score, rejected = [], [], []
            for value in batch.column(2):
                body = value.as_py()
                if not levels or not body or not LETTER.search(body):
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                name, margin = judge(letters(body))
                pred.append(name), score.append(min(1.0, 0.5 + 2 * margin)), rejected.append(margin < NARROW)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, folds) == held).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")
