"""Cited works against records: candidates, weighted evidence, vetoes, one decision a reference; records of one work merged.

Candidates share an identifier, or enough of the record's title. The second is found by a prefix filter: of a record whose
title must be met in all but m tokens, one of its m + 1 rarest tokens is met. Rare tokens first, so a common word joins
nothing unless a title has nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.forms import title_key, title_ordinals
from ..sources.tables import settle

#: Weights of the evidence, from where a venue counts, fewest tokens of a title that may match in part.
WEIGHTS = {"title": 0.45, "author": 0.25, "year": 0.15, "venue": 0.15}
VENUE, LEAST_TOKENS = 0.5, 4
#: Words that carry no title.
EMPTY_WORDS = ["a", "an", "the", "of", "and", "in", "on", "for", "to", "with"]
#: Share of a record's title tokens that makes it a candidate, scores from which it is taken or weak, least lead over another work,
#: title score under which an identifier belongs to another work.
CANDIDATE, TAKEN, WEAK, LEAD, OTHER_WORK = 0.75, 0.7, 0.5, 0.05, 0.2
#: How titles about another work start.
ABOUT = ["comment on", "reply to", "response to", "erratum", "correction", "corrigendum", "retraction"]


def tokens(title: Column) -> Column:
    return _words(title_key(title))


def folded(name: Column) -> Column:
    """A name in lower case, without marks of the common Latin letters and without what is no letter."""
    low = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžčćąęłńśźż", "aaaaaaceeeeiiiinoooooouuuuyyszccaelnszz")
    return F.regexp_replace(low, r"[^\p{L}]", "")


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables: small on disk, it would be sent out whole, and the driver holds it many times as large."""
    return df.hint("merge")


def candidates(refs: DataFrame, records: DataFrame) -> DataFrame:
    """(ref_id, rec_id) pairs that share an identifier or a prefix token; those of the second kind are still to be verified.

    n references and m records of one and the same title make n * m pairs, each of which has evidence of its own.
    """
    # Tokens go by their hashes: two of one hash only make pairs that are not verified.
    t = records.select("rec_id", F.size("tokens").alias("m"), F.explode("tokens").alias("t")).withColumn("t", F.xxhash64("t"))
    rarity = t.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy("rec_id").orderBy("c", "t")
    ranked = t.join(_dealt(rarity), "t").withColumn("i", F.row_number().over(order))
    prefix = ranked.where(F.col("i") <= F.col("m") - F.ceil(CANDIDATE * F.col("m")) + 1).select("rec_id", "t")
    by_title = refs.select("ref_id", F.explode("tokens").alias("t")).withColumn("t", F.xxhash64("t")).join(_dealt(prefix), "t").select("ref_id", "rec_id")
    by_doi = refs.where("doi is not null").select("ref_id", "doi").join(_dealt(records.where("doi is not null").select("rec_id", "doi")), "doi").select("ref_id", "rec_id")
    return by_title.union(by_doi).distinct()


def _words(key: Column) -> Column:
    """tokens of a title, from its key."""
    return F.array_except(F.split(F.coalesce(key, F.lit("")), " "), F.array(*[F.lit(w) for w in ["", *EMPTY_WORDS]]))


def _forms(df: DataFrame) -> DataFrame:
    """What pairs are compared by, made once for each row: key and ordinals of the title, whether it is about another work, the folded author, words of the container."""
    about = F.coalesce(F.lower("title").rlike(rf"^\W*(?:{'|'.join(ABOUT)})\b"), F.lit(False))
    return df.withColumns({"key": title_key(F.col("title")), "ordinals": title_ordinals(F.col("title")), "about": about, "author": folded(F.col("author")), "venue_words": F.when(F.col("container").isNotNull(), tokens(F.col("container"))), "doi": F.lower("doi")})


def profiles(refs: DataFrame, records: DataFrame) -> DataFrame:
    """Evidence of each candidate pair: title, author, year, venue, score, same_doi, veto (null if none).

    refs: ref_id, title, author, year, container, volume, pages, doi; records: rec_id and the same, and kind. A null on either side
    is no evidence and no conflict. Titles of fewer than LEAST_TOKENS tokens count only if equal; ordinals that differ make it 0.
    """
    carried = ("key", "ordinals", "about", "author", "year", "venue_words", "volume", "pages", "doi")
    # Made once: four steps read the records.
    refs, records = settle(_forms(refs).select("ref_id", *carried)), settle(_forms(records).select("rec_id", "kind", *carried))
    left = refs.select("ref_id", *[F.col(c).alias(f"a_{c}") for c in carried])
    right = records.select("rec_id", "kind", *[F.col(c).alias(f"b_{c}") for c in carried])
    named = lambda df: df.withColumn("tokens", _words(F.col("key")))
    p = candidates(named(refs), named(records)).join(_dealt(left), "ref_id").join(_dealt(right), "rec_id")
    # Tokens are made of keys again, as they would take more room on the way.
    p = p.withColumns({"a_tokens": _words(F.col("a_key")), "b_tokens": _words(F.col("b_key"))})
    p = p.withColumns({"na": F.size("a_tokens"), "nb": F.size("b_tokens"), "shared": F.size(F.array_intersect("a_tokens", "b_tokens")), "same_doi": F.coalesce(F.col("a_doi") == F.col("b_doi"), F.lit(False))})
    p = p.where(F.col("same_doi") | (F.col("shared") >= F.ceil(CANDIDATE * F.col("nb"))))
    same = F.col("a_key") == F.col("b_key")
    short = F.least("na", "nb") < LEAST_TOKENS
    number = (F.size("a_ordinals") + F.size("b_ordinals") > 0) & (F.col("a_ordinals") != F.col("b_ordinals"))
    title = F.when(number, 0.0).when(same, 1.0).when(short | (F.col("nb") == 0), 0.0).otherwise(F.round(F.col("shared") / F.col("nb"), 3))
    p = p.withColumn("title", F.coalesce(title, F.lit(0.0)))
    a, b = (F.coalesce(f"{side}_venue_words", F.array().cast("array<string>")) for side in "ab")
    venue = F.round(F.size(F.array_intersect(a, b)) / F.nullif(F.size(b), F.lit(0)), 3)
    p = p.withColumns({"author": F.coalesce((F.col("a_author") != "") & F.contains("b_author", "a_author"), F.lit(False)), "year": F.coalesce(F.col("a_year") == F.col("b_year"), F.lit(False)), "venue": F.coalesce(venue, F.lit(0.0)), "same": F.coalesce(same, F.lit(False)), "short": short})
    p = p.withColumn("score", F.round(WEIGHTS["title"] * F.col("title") + WEIGHTS["author"] * F.col("author").cast("int") + WEIGHTS["year"] * F.col("year").cast("int") + WEIGHTS["venue"] * (F.col("venue") >= VENUE).cast("int"), 3))
    return p.withColumn("veto", _veto()).select("ref_id", "rec_id", "title", "author", "year", "venue", "score", "same_doi", "veto", F.sha2("b_key", 256).alias("work"))


def _veto() -> Column:
    """The first rule by which a candidate can't be the cited work."""
    differs = lambda c: F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(False))
    venue = (F.col("venue") < VENUE) & F.col("a_venue_words").isNotNull() & F.col("b_venue_words").isNotNull()
    return (
        F.when(F.col("b_about") & ~F.col("a_about"), "about_another_work")
        .when((F.col("kind") == "dataset") & F.col("a_venue_words").isNotNull(), "dataset")
        .when(differs("volume") & differs("pages"), "volume_and_pages")
        .when(venue & differs("pages"), "container_and_pages")
        .when(venue & differs("volume"), "container_and_volume")
        .when(F.col("same") & F.col("short") & differs("year") & ~F.col("author"), "short_title_other_year")
    )


def decisions(refs: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each reference: status, rec_id, score, lead, candidates, vetoed, reasons (of vetoes, sorted), refutations, verdict.

    status: `identified` (its identifier's record is the work), `identifier_mismatch` (that record's title is another one's and no
    record is taken), `matched` (score TAKEN or more, LEAD over any other work), `ambiguous` (no such lead), `weak` or `not_found`.
    verdict: `confirmed`, `refuted` (a refutation and nothing taken) or `unproven`. Equal scores go by rec_id.
    """
    p = profiles(refs, records)
    w = W.partitionBy("ref_id")
    free = F.col("veto").isNull()
    p = p.withColumn("best", F.max(F.when(free, F.struct("score", "same_doi", (-F.col("rec_id")).alias("i"), "work"))).over(w))
    by = p.groupBy("ref_id").agg(
        F.max("best").alias("best"),
        F.max(F.when(free & (F.col("work") != F.col("best.work")), F.col("score"))).alias("next"),
        F.max(F.when(free & F.col("same_doi") & (F.col("title") >= WEAK), F.struct("score", (-F.col("rec_id")).alias("i")))).alias("own"),
        F.coalesce(F.bool_or(F.col("same_doi")), F.lit(False)).alias("known"),
        F.max(F.when(F.col("same_doi"), F.col("title"))).alias("own_title"),
        F.count(F.lit(1)).alias("candidates"),
        F.count("veto").alias("vetoed"),
        F.array_sort(F.collect_set("veto")).alias("reasons"),
    )
    out = refs.select("ref_id", "doi").join(_dealt(by), "ref_id", "left")
    lead = F.round(F.col("best.score") - F.coalesce("next", F.lit(0.0)), 3)
    mismatch = F.coalesce(F.col("known") & (F.col("own_title") < OTHER_WORK), F.lit(False))
    taken = (F.col("best.score") >= TAKEN) & (lead >= LEAD)
    status = F.when(F.col("own").isNotNull(), "identified").when(taken, "matched").when(mismatch, "identifier_mismatch").when(F.col("best.score") >= TAKEN, "ambiguous").when(F.col("best.score") >= WEAK, "weak").otherwise("not_found")
    refutations = F.filter(F.array(F.when(F.col("doi").isNotNull() & ~F.coalesce("known", F.lit(False)), "identifier_not_found"), F.when(mismatch, "identifier_targets_other_work")), lambda r: r.isNotNull())
    out = out.withColumns({"status": status, "refutations": refutations})
    good = F.col("status").isin("identified", "matched")
    # An own record by its identifier goes before a better score elsewhere.
    chosen = F.when(F.col("status") == "identified", -F.col("own.i")).when(good, -F.col("best.i"))
    verdict = F.when(good, "confirmed").when(F.size("refutations") > 0, "refuted").otherwise("unproven")
    score = F.when(F.col("status") == "identified", F.col("own.score")).otherwise(F.col("best.score"))
    zero = F.lit(0).cast("long")
    return out.select("ref_id", "status", chosen.alias("rec_id"), score.alias("score"), lead.alias("lead"), F.coalesce("candidates", zero).alias("candidates"), F.coalesce("vetoed", zero).alias("vetoed"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), "refutations", verdict.alias("verdict"))


def works(records: DataFrame, fields: list[str]) -> DataFrame:
    """Records of one work as one row: key, doi, year (least), years_apart, members, contested, and each field's first known value.

    records: rec_id, title, doi, year, fields. Records are of one work if their title keys are equal, their identifiers don't conflict and their
    years are at most one apart. So the records with an identifier make a work for each key and identifier; one without joins the only
    such work of its key within a year. Where several are near it is contested; these, and those near none, make works by runs of years.
    A record without a year joins the only identifier of its key; others of these are one work. Nothing is joined pair by pair: identifiers are counted for each key and year.
    """
    r = records.withColumns({"key": title_key(F.coalesce("title", F.lit(""))), "doi": F.lower("doi"), "year": F.col("year").cast("int")}).where("key <> ''")
    # Made once: three steps read them.
    r = settle(r.select("rec_id", "key", "doi", "year", *fields))
    owned = r.where("doi is not null").select("key", "doi", "year").distinct()
    near = owned.select("key", "doi", F.explode(F.when(F.col("year").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1, F.lit(None).cast("int")))).alias("y"))
    near = near.groupBy("key", F.col("y").alias("year")).agg(F.min("doi").alias("d0"), F.max("doi").alias("d1"))
    unknown = owned.where("year is null").groupBy("key").agg(F.min("doi").alias("u0"), F.max("doi").alias("u1"))
    loose = r.where("doi is null").withColumn("y", F.col("year"))
    near = near.select(F.col("key").alias("nk"), F.col("year").alias("ny"), "d0", "d1")
    met = loose.join(near, (F.col("key") == F.col("nk")) & F.col("y").eqNullSafe(F.col("ny")), "left").drop("nk").join(unknown, "key", "left")
    least, most = F.least("d0", "u0"), F.greatest("d1", "u1")
    met = met.withColumns({"contested": F.coalesce(least != most, F.lit(False)), "joined": F.when(least == most, least)})
    alone = met.where("joined is null")
    years = alone.where("year is not null").select("key", "year").distinct()
    w = W.partitionBy("key").orderBy("year")
    runs = years.withColumn("new", F.when(F.col("year") - F.lag("year").over(w) <= 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w)).select(F.col("key").alias("rk"), F.col("year").alias("ry"), "run")
    alone = alone.join(runs, (F.col("key") == F.col("rk")) & (F.col("year") == F.col("ry")), "left").drop("rk")
    columns = ["rec_id", "key", "year", *fields]
    member = lambda df, doi, run, contested: df.select(*columns, doi.alias("doi"), run.alias("run"), contested.alias("contested"))
    none = F.lit(0).cast("long")
    every = member(r.where("doi is not null"), F.col("doi"), none, F.lit(False)).union(member(met.where("joined is not null"), F.col("joined"), none, F.lit(False))).union(member(alone, F.lit(None).cast("string"), F.coalesce("run", none), F.col("contested")))
    known = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("rec_id"))).alias(f) for f in fields]
    out = every.groupBy("key", "doi", "run").agg(F.min("rec_id").alias("rec_id"), F.count(F.lit(1)).alias("members"), F.min("year").alias("year"), (F.max("year") - F.min("year")).alias("years_apart"), F.bool_or("contested").alias("contested"), *known)
    return out.drop("run")
