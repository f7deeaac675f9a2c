"""Text expressions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Words that carry no topic.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with"]
#: A sentence ends after ., ! or ? that white space follows.
SENTENCE_END = r"(?<=[.!?])\s+"


def word_tokens(text):
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def topic_tokens(text):
    """word_tokens without stop words and single characters."""
    return F.filter(word_tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def sentences(text):
    """Sentences in order, line breaks folded into spaces; empty ones go."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(flat, SENTENCE_END), lambda s: s != "")


def alpha_ratio(text):
    """Share of letters among the characters; 0 for an empty text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(F.length(text) > 0, letters / F.length(text)).otherwise(F.lit(0.0))


def doi_key(value):
    """Lower-case identifier without resolver address, `doi:` and slashes at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(value)), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", ""), r"^/+|/+$", "")


def issn(value):
    """The eight-character serial number if its check digit (modulo 11) holds, else null."""
    bare = F.upper(F.regexp_replace(value, r"[\s-]", ""))
    total = sum((F.substring(bare, i, 1).try_cast("int") * (9 - i) for i in range(1, 8)), F.lit(0))
    rest = F.pmod(-total, F.lit(11))
    check = F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string"))
    return F.when(bare.rlike("^[0-9]{7}[0-9X]$") & (F.substring(bare, 8, 1) == check), bare)


def page_range_end(value):
    """The end page of `123-8` written out (128); raised by a power of ten where it would come before the start."""
    first = F.regexp_extract(value, r"^(\d+)\s*[-–]\s*(\d+)$", 1)
    short = F.regexp_extract(value, r"^(\d+)\s*[-–]\s*(\d+)$", 2)
    unit = F.pow(F.lit(10), F.length(short)).cast("long")
    start, tail = first.try_cast("long"), short.try_cast("long")
    end = start - start % unit + tail
    return F.when(F.length(short) >= F.length(first), tail).otherwise(F.when(end < start, end + unit).otherwise(end))


def expand_numbers(value):
    """`1,3,5-8` as an array of ints; reversed ranges and those of 200 or more go."""
    bounds = lambda p: F.struct(F.substring_index(p, "-", 1).cast("int").alias("lo"), F.substring_index(p, "-", -1).cast("int").alias("hi"))
    good = F.transform(F.filter(F.split(F.regexp_replace(value, r"\s", ""), ","), lambda p: p.rlike(r"^\d{1,6}(-\d{1,6})?$")), bounds)
    near = F.filter(good, lambda b: (b["lo"] <= b["hi"]) & (b["hi"] - b["lo"] < 200))
    return F.flatten(F.transform(near, lambda b: F.sequence(b["lo"], b["hi"])))
