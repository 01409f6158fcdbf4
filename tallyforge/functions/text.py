"""Text helpers as column expressions, Unicode aware throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lines(x: Column) -> Column:
    """Lines of a text at every Unicode line boundary."""
    return F.split(x, r"\R|[\x1c-\x1e]")


def present(x: Column) -> Column:
    """Neither null nor empty; blanks count as present."""
    return F.coalesce(x, F.lit("")) != ""


def first_group(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def base64_flat(x: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(x), r"\s", "")
