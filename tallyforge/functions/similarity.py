"""Token similarity of names, 0 to 100, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present, strip

# Words that don't count in a company's name.
LEGAL_SUFFIXES = ("inc", "inc.", "corp", "corp.", "corporation", "llc", "ltd", "ltd.", "limited", "co", "co.", "company")


def name_tokens(x: Column) -> Column:
    """Distinct lower-case words without legal suffixes."""
    words = F.filter(F.split(F.lower(strip(x)), r"(?U)\s+"), lambda w: w != "")
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(s) for s in LEGAL_SUFFIXES])))


def name_keys(x: Column) -> Column:
    """What two names of a similarity over 0 have in common: one of their words, or the whole of a name without any."""
    words = name_tokens(x)
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.concat(F.lit("= "), F.lower(strip(x)))))


def token_similarity(a: Column, b: Column, a_tokens: Column | None = None, b_tokens: Column | None = None) -> Column:
    """Share of common words in percent; at least 70 where one name's words are all in the other.

    Token columns may be given where they are already at hand.
    """
    s, t = (name_tokens(a) if a_tokens is None else a_tokens), (name_tokens(b) if b_tokens is None else b_tokens)
    common = F.size(F.array_intersect(s, t))
    share = common / F.size(F.array_union(s, t))
    inside = common == F.least(F.size(s), F.size(t))
    whole = F.when(F.lower(strip(a)) == F.lower(strip(b)), F.lit(100)).otherwise(F.lit(0))
    worded = F.when(inside, F.least(F.lit(100.0), F.lit(70.0) + F.lit(30.0) * share)).otherwise(F.lit(100.0) * share).cast("int")
    return F.when(~present(a) | ~present(b), F.lit(0)).when((F.size(s) == 0) | (F.size(t) == 0), whole).otherwise(worded)
