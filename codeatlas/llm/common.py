"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.exprs import UPPER
from codeatlas.functions.tables import drop_table, free_name, is_small, looked_up, settle, shuffled, sided, table

__all__ = ["ascii_lower", "drop_table", "fold", "free_name", "is_small", "looked_up", "materialise", "row_key", "shuffled", "sided", "table"]

SPACE_WORD = r"[^\x20\x09-\x0D]+"
materialise = settle


def ascii_lower(text: Column | str) -> Column:
    """Lower-cases A-Z and nothing else. Texts of ASCII alone take the faster built-in."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key counts as the text 'null'."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % parts


def row_key(doc_id: str, text: str) -> Column:
    """16 bytes equal only for rows with the same id and the same text, whose results are equal too."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit("-"))
    content = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws(":", name, content).cast("binary")))
