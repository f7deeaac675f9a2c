"""Venues: whether two names can be of one, words cut short in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a name that abbreviations leave out.
LEFT_OUT = ["a", "an", "and", "de", "der", "des", "die", "for", "für", "in", "la", "of", "on", "the", "und"]


def venue_tokens(name: Column) -> Column:
    """Lower-case runs of letters and digits without LEFT_OUT; an ampersand is left out too."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(LEFT_OUT))


def _in_order(short: Column, long: Column) -> Column:
    """Whether each token of `short` starts a later token of `long`, or is started by it, in order (the first that fits is taken)."""
    fits = lambda a, b: F.startswith(a, b) | F.startswith(b, a)

    def step(at: Column, token: Column) -> Column:
        rest = F.slice(long, at + 1, F.greatest(F.size(long) - at, F.lit(0)))
        found = F.array_position(F.transform(rest, lambda x: fits(x, token)), F.lit(True)).cast("int")
        return F.when((at < 0) | (at >= F.size(long)) | (found == 0), F.lit(-1)).otherwise(at + found)

    return F.aggregate(short, F.lit(0), step) >= 0


def venue_relation(a: Column, b: Column) -> Column:
    """`equal`, `inconclusive` or `different`; null if a name has no token.

    Equal: the same tokens. Inconclusive, never equal: tokens that start each other in order, where the longer name may have more of
    them; or one token of the other's initials. All else is different.
    """
    x, y = venue_tokens(a), venue_tokens(b)
    few, many = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    pairs = F.forall(F.zip_with(few, many, lambda s, t: F.startswith(s, t) | F.startswith(t, s)), lambda ok: ok)
    initials = F.array_join(F.transform(many, lambda w: F.left(w, F.lit(1))), "")
    acronym = (F.size(few) == 1) & (F.size(many) >= 2) & (F.get(few, F.lit(0)) == initials)
    return F.when(F.size(few) == 0, None).when(x == y, "equal").when(F.when(F.size(x) == F.size(y), pairs).otherwise(_in_order(few, many)) | acronym, "inconclusive").otherwise("different")
