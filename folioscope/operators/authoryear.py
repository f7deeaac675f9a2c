"""Author-year citations: read from sentences, joined to an index of several keys an entry, narrowed in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bibliography import PARTICLES, YEAR

_FAMILY = PARTICLES + r"\p{Lu}[\p{L}'’-]+"
_NAMES = rf"{_FAMILY}(?:(?:, and |, & |, | and | & ){_FAMILY})*(?: et al\.?)?"
_ONE = rf"({_NAMES}),? ({YEAR})([a-z]?)"


def bare(name: Column) -> Column:
    """A name without blanks, hyphens and apostrophes, in lower case."""
    return F.regexp_replace(F.lower(name), r"[\s'’-]", "")


def citations(sentences: DataFrame) -> DataFrame:
    """(doc_id, claim_id, sentence) -> doc_id, claim_id, place, marker, surname, others, et_al, year, suffix.

    `Name (1999)` and `(Name, 1999a; Name and Name, 2000)`; place counts a sentence's citations from 0, those in
    parentheses after the others. Null sentences have none.
    """
    told = F.transform(F.regexp_extract_all("sentence", F.lit(rf"{_NAMES} \({YEAR}[a-z]?\)"), F.lit(0)), lambda m: F.regexp_replace(m, r" \((.*)\)$", ", $1"))
    pieces = F.flatten(F.transform(F.regexp_extract_all("sentence", F.lit(rf"\(([^()]*{YEAR}[a-z]?[^()]*)\)"), F.lit(1)), lambda m: F.split(m, r";\s*")))
    each = sentences.select("doc_id", "claim_id", F.posexplode(F.concat(told, F.filter(pieces, lambda p: p.rlike(rf"^{_ONE}$")))).alias("place", "marker"))
    names = F.regexp_extract("marker", rf"^{_ONE}$", 1)
    family = F.split(F.regexp_replace(names, r" et al\.?$", ""), r", and |, & |, | and | & ")
    return each.select("doc_id", "claim_id", "place", "marker", F.get(family, F.lit(0)).alias("surname"), F.slice(family, F.lit(2), F.greatest(F.size(family) - 1, F.lit(0))).alias("others"),
                       names.rlike(r" et al\.?$").alias("et_al"), F.regexp_extract("marker", rf"^{_ONE}$", 2).cast("int").alias("year"), F.regexp_extract("marker", rf"^{_ONE}$", 3).alias("suffix"))


def index(read: DataFrame) -> DataFrame:
    """Entries (doc_id, n, raw, authors, year) -> doc_id, n, key, year, suffix, n_authors, families: a row for each key of each entry.

    Keys: the first family name, the same without blanks and hyphens, and of an institution its initials. Entries whose authors no
    reader took are keyed by the name they start with. An entry without a name or a year has no key.
    """
    head = F.regexp_extract("raw", rf"^({PARTICLES}\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)*?)(?:, ?\p{{Lu}}\.| \p{{Lu}}{{1,3}}(?:,|\.)|\. \({YEAR})", 1)
    family = lambda a: F.regexp_replace(F.regexp_replace(F.trim(a), r",.*$", ""), r" \p{Lu}{1,3}$", "")
    families = F.when(F.size("authors") > 0, F.transform("authors", family)).otherwise(F.array(head))
    first = F.get(F.col("families"), F.lit(0))
    words = F.regexp_extract_all(first, F.lit(r"\b(\p{Lu})[\p{L}'’]*"), F.lit(1))
    keys = F.array(F.lower(first), bare(first), F.when(F.contains(first, F.lit(" ")) & (F.size(words) >= 2) & ~F.contains("raw", F.concat(first, F.lit(","))), F.lower(F.array_join(words, ""))))
    # Of an entry without a reader the only number like a year may be part of its identifier: a date in parentheses goes first.
    dated = F.regexp_extract("raw", rf"\(({YEAR})[a-z]?\)", 1).try_cast("int")
    year = F.when(F.size("authors") > 0, F.coalesce("year", dated)).otherwise(F.coalesce(dated, "year"))
    made = read.select("doc_id", "n", "raw", families.alias("families"), year.alias("year"), F.regexp_extract("raw", rf"\({YEAR}([a-z])\)", 1).alias("suffix")).where((first != "") & F.col("year").isNotNull())
    return made.select("doc_id", "n", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))).alias("key"), "year", "suffix", F.size("families").alias("n_authors"), F.transform("families", F.lower).alias("families"))


def match(cites: DataFrame, keys: DataFrame) -> DataFrame:
    """cites joined to their document's entries -> their columns, status (`unique`, `ambiguous`, `orphan`), n, candidates (sorted).

    The name as written decides; only if nothing answers to it is it tried without blanks and hyphens. A suffix must be an
    entry's. Of several entries those with all co-authors stay, if any; then one entry decides the citation if it alone has as
    many authors as the citation says (three at least for `et al.`), or else if it alone is by several, or one, as it says.
    """
    id_ = ["doc_id", "claim_id", "place"]
    wanted = cites.select(*id_, "others", "et_al", "year", "suffix", F.posexplode(F.array_distinct(F.array(F.lower("surname"), bare(F.col("surname"))))).alias("tier", "key"))
    entry = keys.select("doc_id", "key", "year", "n", F.col("suffix").alias("own"), "n_authors", "families")
    met = wanted.join(entry, ["doc_id", "key", "year"]).dropDuplicates([*id_, "tier", "n"])
    w = W.partitionBy(*id_)
    met = met.withColumn("least", F.min("tier").over(w)).where("tier = least and (suffix = '' or suffix = own)")
    some = lambda c: F.sum(c.cast("int")).over(w)
    size, others = F.size("others"), F.transform("others", F.lower)
    met = met.withColumns({"with_all": (size > 0) & (F.size(F.array_except(others, "families")) == 0), "several": F.col("n_authors") > 1})
    met = met.withColumns({"group": F.count(F.lit(1)).over(w), "named": some(F.col("with_all"))})
    met = met.withColumn("in", (F.col("named") == 0) | F.col("with_all"))
    right = F.when(F.col("et_al"), F.col("n_authors") >= 3).otherwise(F.col("n_authors") == 1 + size)
    met = met.withColumns({"strict": F.col("in") & right, "coarse": F.col("in") & (F.col("several") == (F.col("et_al") | (size > 0)))})
    met = met.withColumns({"n_strict": some(F.col("strict")), "n_coarse": some(F.col("coarse"))})
    settled = F.col("suffix") != ""
    pick = F.when((F.col("group") == 1) | (~settled & (F.col("named") == 1) & F.col("with_all")), True).when(settled | (F.col("named") == 1), False).when(F.col("n_strict") == 1, F.col("strict")).when(F.col("n_coarse") == 1, F.col("coarse")).otherwise(False)
    found = met.groupBy(*id_).agg(F.max(F.when(pick, F.col("n"))).alias("n"), F.array_sort(F.collect_list(F.when(F.col("in") | settled, F.col("n")))).alias("candidates"))
    out = cites.join(found, id_, "left")
    status = F.when(F.col("n").isNotNull(), "unique").when(F.size("candidates") > 0, "ambiguous").otherwise("orphan")
    return out.withColumns({"status": status, "candidates": F.coalesce(F.when(F.col("n").isNotNull(), F.array("n")).otherwise(F.col("candidates")), F.array().cast("array<int>"))})


def resolved(matched: DataFrame, chosen: DataFrame) -> DataFrame:
    """matched with the entries that a reader chose (doc_id, claim_id, place, choice): only for ambiguous ones, and only a candidate."""
    picks = chosen.groupBy("doc_id", "claim_id", "place").agg(F.min("choice").alias("choice"))
    out = matched.join(picks, ["doc_id", "claim_id", "place"], "left")
    takes = F.coalesce((F.col("status") == "ambiguous") & F.array_contains("candidates", F.col("choice")), F.lit(False))
    return out.withColumns({"n": F.when(takes, F.col("choice")).otherwise(F.col("n")), "status": F.when(takes, "chosen").otherwise(F.col("status"))}).drop("choice")
