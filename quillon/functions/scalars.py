"""Coercions and text functions of the archive's records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_nul(c: Column) -> Column:
    """Text without NUL characters."""
    return F.replace(c, F.lit("\0"), F.lit(""))  # a search in bytes; translate() would make an object of each letter


def non_empty(c: Column) -> Column:
    """NULL for empty text."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first text that is neither NULL nor empty; else the last one as it is."""
    return F.coalesce(*[non_empty(c) for c in columns[:-1]], columns[-1])


def to_long(c: Column) -> Column:
    """An integer from text, NULL where it is none or out of range."""
    return F.trim(c).try_cast("bigint")


def to_int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def timestamp(c: Column) -> Column:
    """The wall clock of 'Sat Aug 01 01:59:54 +0000 2020' or of an ISO time; any offset is dropped, not applied, and the session's time zone has no part in it."""
    parts = r"^\w{3} (\w{3}) (\d{1,2}) (\d{2}:\d{2}:\d{2}) [+-]\d{4} (\d{4})$"
    # what matches has its parts at fixed places, one to the left if the day has one digit: the pattern is tried once
    short = F.when(F.substring(c, 10, 1) == " ", 1).otherwise(0)
    part = {1: F.substring(c, 5, 3), 2: F.substring(c, F.lit(9), 2 - short), 3: F.substring(c, 12 - short, F.lit(8)), 4: F.substring(c, 27 - short, F.lit(4))}.get
    # three letters for each month: the place of a month's name says which one it is
    at = F.position(part(1), F.lit("JanFebMarAprMayJunJulAugSepOctNovDec")) + 2
    month = F.when((at > 2) & (at % 3 == 0), F.lpad((at / 3).cast("int").cast("string"), 2, "0"))
    legacy = F.concat(part(4), F.lit("-"), month, F.lit("-"), F.lpad(part(2), 2, "0"), F.lit(" "), part(3))
    iso = F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.when(c.rlike(parts), legacy).when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).try_cast("timestamp_ntz")


def clean_source(c: Column) -> Column:
    """The text of a tag that the value begins with, else the value; empty becomes NULL."""
    tag = r"^<[^\n]*?>([^\n]*?)<[^\n]*?>"
    return non_empty(F.when(c.rlike(tag), F.regexp_extract(c, tag, 1)).otherwise(c))


def hashtag_id(c: Column) -> Column:
    """CRC-32 of the lower-case UTF-8 text."""
    return F.crc32(F.encode(F.lower(c), "UTF-8"))


def text_range(c: Column) -> tuple[Column, Column]:
    """The first two items of an array of at least two, as integers."""
    enough = F.size(c) >= 2
    return tuple(F.when(enough, to_int(F.try_element_at(c, F.lit(i)))) for i in (1, 2))


def trigrams(c: Column) -> Column:
    """The distinct three-character substrings of a text."""

    def grams(letters):
        n = F.size(letters)
        at = lambda i: F.concat(F.get(letters, i), F.get(letters, i + 1), F.get(letters, i + 2))
        return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 3), at))).otherwise(F.array().cast("array<string>"))

    # the text is split into letters once: as the only item of an array it is a variable of the lambda; substring() at each place would be a pass over the text for each
    return F.get(F.transform(F.array(F.filter(F.split(c, ""), lambda x: x != "")), grams), F.lit(0))


def round_half_up(c: Column, digits: int) -> Column:
    """Decimal rounding, halves away from zero."""
    return F.round(c.cast("decimal(38,10)"), digits)


def utf8_without_errors(c: Column) -> Column:
    """Text from bytes; sequences that aren't UTF-8 vanish. Replacement characters that are there already stay: they step aside while the broken sequences are replaced and removed."""
    text, mark, aside = c.cast("string"), "\ufffd", "\ufdd0\ufdd1\ufdd0"
    repaired = F.replace(F.translate(F.make_valid_utf8(F.replace(text, F.lit(mark), F.lit(aside))), mark, ""), F.lit(aside), F.lit(mark))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)
