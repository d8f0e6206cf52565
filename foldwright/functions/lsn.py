"""Log sequence numbers: three 64-bit parts, as text ``vlf:offset:slot`` in hex; a pair (commit, change) orders events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three parts of one to sixteen hex digits; a part of sixteen that starts with 8 to f would not fit a signed 64-bit integer.
PART = r"(?:[0-9a-f]{1,15}|[0-7][0-9a-f]{15})"
PATTERN = f"^{PART}:{PART}:{PART}$"
PARTS = ("vlf", "off", "slot")


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def is_valid(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(PATTERN), F.lit(False))


def parse(text: Column) -> Column:
    """Struct (vlf, off, slot) of longs; null where the text is no sequence number. Structs compare part by part."""
    parts = F.split(F.lower(text), ":")
    return F.when(is_valid(text), F.struct(*(F.conv(parts[i], 16, 10).cast("long").alias(p) for i, p in enumerate(PARTS))))


def parse_strict(text: Column) -> Column:
    """Like ``parse``, but an invalid text raises."""
    return F.when(is_valid(text), parse(text)).otherwise(F.raise_error(F.concat(F.lit("not a log sequence number: "), F.coalesce(text, F.lit("null")))))


def render(lsn: Column) -> Column:
    """Unpadded lower-case hex; not for comparing."""
    return F.concat_ws(":", *(F.lower(F.hex(lsn[p])) for p in PARTS))


def pair(commit: Column, change: Column) -> Column:
    """(commit, change); a blank change number, as snapshot rows have it, is the commit number."""
    commit_ = parse(commit)
    return F.struct(commit_.alias("commit"), F.coalesce(parse(blank_to_null(change)), F.when(blank_to_null(change).isNull(), commit_)).alias("change"))


def flat(lsn_pair: Column) -> list[Column]:
    """Six columns, in sort order."""
    return [lsn_pair[side][p].alias(f"{side}_{p}") for side in ("commit", "change") for p in PARTS]


def nested(prefix: str = "") -> Column:
    """The pair from the six columns."""
    return F.struct(*(F.struct(*(F.col(f"{prefix}{side}_{p}").alias(p) for p in PARTS)).alias(side) for side in ("commit", "change")))


#: The six columns in sort order.
COLUMNS = [f"{side}_{p}" for side in ("commit", "change") for p in PARTS]
