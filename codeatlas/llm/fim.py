"""Fill-in-the-middle: a text is cut at two of its units, and its parts are put into another order between marks.

Units are lines. One pass over the bytes counts them and keeps a sparse index: the byte and code-point offsets after
every STRIDE units. A cut is then found by a binary search of the checkpoints and a short scan from the one before it,
so a text of any length costs one pass and an entry for STRIDE lines.

Null texts are empty. Empty texts, texts that hold a mark, and those that the rate leaves out stay plain, with null
lengths. Equal cuts give an empty middle. A null id draws as the text 'null'; repeated rows are cut alike. Long texts
are read in pieces of PIECE bytes; only a row's text and output are held whole. An empty table gives an empty result;
extra columns, whatever their names, are ignored by `transform`.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units between two checkpoints, and bytes that are counted at once.
STRIDE, PIECE = 64, 1 << 20
#: Fixed by the contract: the marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of outputs that are handed over at once.
SLICE = 4 << 20


class Checkpoints:
    """The units of a text: how many, and the offsets (bytes, code points) after every STRIDE of them."""

    def __init__(self, text: bytes, stride: int = STRIDE, piece: int = PIECE) -> None:
        self.text, self.stride = text, stride
        self.at_byte, self.at_char = [0], [0]
        units = chars = 0
        for start in range(0, len(text), piece):
            part = np.frombuffer(text, dtype=np.uint8, count=min(piece, len(text) - start), offset=start)
            ends = np.flatnonzero(part == 10)
            first = (-units - 1) % stride  # the unit of this piece that completes a stride
            kept = ends[first::stride] + 1
            leads = (part & 0xC0) != 0x80
            if len(kept):
                upto = np.add.reduceat(leads, np.concatenate([[0], kept[kept < len(part)]]), dtype=np.int64).cumsum()
                self.at_byte += (start + kept).tolist()
                self.at_char += (chars + upto[: len(kept)]).tolist()
            units += len(ends)
            chars += int(np.count_nonzero(leads))
        self.n = units + (len(text) > 0 and text[-1] != 10)
        self.chars = chars

    def after(self, unit: int) -> tuple[int, int]:
        """The byte and code-point offsets after `unit` units."""
        if unit >= self.n:
            return len(self.text), self.chars
        k = bisect_right(range(0, self.stride * len(self.at_byte), self.stride), unit) - 1
        begin = at = self.at_byte[k]
        for _ in range(unit - k * self.stride):
            at = self.text.index(b"\n", at) + 1
        return at, self.at_char[k] + code_points(self.text[begin:at])


def code_points(part: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(part, dtype=np.uint8) & 0xC0) != 0x80))


def draws(doc_id: str, seed: int, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the sha256 of `seed:id`, as numbers."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(count)]


def cut(text: bytes, h: tuple[int, int, int, int], rate: int, spm: int, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    index = Checkpoints(text)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return index.n, "plain", None, None, text
    one, two = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (a, chars_a), (b, chars_b) = index.after(one), index.after(two)
    before, hole, rest = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h[3] % 100 < spm:
        return index.n, "spm", chars_a, chars_b - chars_a, b"".join((s, rest, p, before, m, hole))
    return index.n, "psm", chars_a, chars_b - chars_a, b"".join((p, before, s, rest, m, hole))


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of docs.

    rate: the percentage of rows that are cut; spm: of these, the percentage whose suffix comes first.
    """
    raw = tuple(m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, rows = 0, 0, []
            numbers = zip(*[batch.column(k).to_pylist() for k in range(1, 5)], strict=True)
            for i, (value, h) in enumerate(zip(batch.column(5).cast(pa.large_binary()), numbers, strict=True)):
                rows.append(cut(value.as_py() or b"", h, rate, spm, raw))
                size += len(rows[-1][4])
                if size >= SLICE or i == batch.num_rows - 1:
                    n, form, first, middle, output = zip(*rows, strict=True)
                    arrays = [pa.array(n, pa.int64()), pa.array(form), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    start, size, rows = i + 1, 0, []

    rows = docs.select(F.col(doc_id).alias("doc_id"), *draws(doc_id, seed), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which an output was made; a text that holds marks is never cut, so each stands once."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.substring_index(output, second, 1)
        rest = F.substring(output, F.length(a) + len(second) + 1, F.length(output))
        b = F.substring_index(rest, m, 1)
        return F.substring(a, F.lit(len(first) + 1), F.length(a)), b, F.substring(rest, F.length(b) + len(m) + 1, F.length(rest))

    before, rest, hole = parts(p, s)
    rest2, before2, hole2 = parts(s, p)
    return F.when(form == "psm", F.concat(before, hole, rest)).when(form == "spm", F.concat(before2, hole2, rest2)).otherwise(output)


def digest(cuts: DataFrame) -> DataFrame:
    """transform's rows with the hashes of the output and of the text rebuilt from it, in place of the output."""
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS s FROM documents
), u AS (
  SELECT *, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS w, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM t
), v AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(w[1:a], '') AS before, array_to_string(w[a + 1:b], '') AS hole, array_to_string(w[b + 1:], '') AS rest FROM v
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(before) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(hole) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || before || '<S>' || rest || '<M>' || hole ELSE '<S>' || rest || '<P>' || before || '<M>' || hole END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""
