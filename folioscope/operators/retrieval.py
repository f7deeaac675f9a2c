"""Contexts under a budget: spans ranked within their document, packed with their neighbours, rebuilt and checked; looking up spans.

A catalogue is (doc_id, pos, start, finish, span_id, text) as of `texts.spans`: pos counts a document's spans from 0, without gaps.
Whole texts never travel with spans: contexts are put together from the spans chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import word_tokens
from ..sources.tables import settle
from .texts import SPAN_CHARS

#: Okapi's constants, and what stands between two ranges of a context.
K1, B, GAP = 1.5, 0.75, "\n\n"
#: Places after the point to which scores are rounded before they are ranked, so that the order of a sum decides nothing.
PLACES = 9


def marked(catalogue: DataFrame, queries: DataFrame) -> DataFrame:
    """The catalogue with `size` in characters, `len` in tokens, and `hits`, those of them that are in its document's query (doc_id, query)."""
    wanted = queries.select("doc_id", F.array_distinct(word_tokens(F.col("query"))).alias("q"))
    t = catalogue.join(wanted, "doc_id").withColumn("t", word_tokens(F.col("text")))
    return t.select(*catalogue.columns, F.length("text").alias("size"), F.size("t").alias("len"), F.filter("t", lambda w: F.array_contains("q", w)).alias("hits"))


def span_scores(spans: DataFrame) -> DataFrame:
    """(doc_id, pos, score) of the marked spans with a term of their document's query: Okapi weights among the document's spans."""
    size = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    hits = spans.select("doc_id", "pos", "len", F.explode("hits").alias("w"))
    tf = hits.groupBy("doc_id", "pos", "len", "w").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("doc_id", "w"))).join(size, "doc_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return tf.groupBy("doc_id", "pos").agg(F.round(F.sum(weight), PLACES).alias("score")).where("score > 0")


def _joined_length(chosen: Column, sizes: Column) -> Column:
    """Characters of a context of the spans at the places `chosen`, gaps between runs of neighbours included."""
    runs = F.size(F.filter(chosen, lambda p: ~F.array_contains(chosen, p - 1)))
    return F.aggregate(chosen, F.lit(0), lambda total, p: total + sizes[p]) + len(GAP) * F.greatest(runs - 1, F.lit(0))


def packed_spans(spans: DataFrame, budget: int, top_k: int = 6, neighbours: int = 1) -> DataFrame:
    """(doc_id, pos): the marked spans chosen. The top_k spans by score (then place) are taken in turn, each with `neighbours` spans on
    either side if the context then fits the budget, else alone if that fits, else not. At most top_k * (2 neighbours + 1) a document.
    """
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))
    seeds = span_scores(spans).withColumn("rank", rank).where(F.col("rank") <= top_k)
    around = seeds.select("doc_id", "rank", F.col("pos").alias("seed"), F.explode(F.sequence(F.col("pos") - neighbours, F.col("pos") + neighbours)).alias("pos"))
    held = around.join(spans.select("doc_id", "pos", "size"), ["doc_id", "pos"])
    by_seed = held.groupBy("doc_id", "rank", "seed").agg(F.collect_list("pos").alias("near"), F.collect_list(F.struct("pos", "size")).alias("sizes"))
    by_doc = by_seed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "seed", "near"))).alias("seeds"), F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("sizes")))).alias("sizes"))

    def take(chosen: Column, seed: Column) -> Column:
        wide, alone = F.array_union(chosen, seed["near"]), F.array_union(chosen, F.array(seed["seed"]))
        fits = lambda c: _joined_length(c, F.col("sizes")) <= budget
        return F.when(fits(wide), wide).when(fits(alone), alone).otherwise(chosen)

    chosen = F.aggregate("seeds", F.array().cast("array<int>"), take)
    return by_doc.select("doc_id", F.explode(chosen).alias("pos"))


def contexts(docs: DataFrame, catalogue: DataFrame, queries: DataFrame, budget: int, top_k: int = 6, neighbours: int = 1) -> DataFrame:
    """(doc_id, mode, status, ranges, chars, source_hash, context_hash, context): a row for each document with a text and a query.

    mode: `full_text` where the text fits the budget, else `extractive`. status: `ready`, or why there is no context: `empty_query`,
    `no_match` (no span has a term) or `over_budget` (no chosen span fits).
    """
    asked = queries.select("doc_id", (F.size(word_tokens(F.col("query"))) == 0).alias("empty"))
    texts = docs.where("text <> ''").join(asked, "doc_id").select("doc_id", F.when(F.length("text") <= budget, F.col("text")).alias("text"), F.length("text").alias("whole"), F.sha2("text", 256).alias("source_hash"), "empty")
    # Spans are cut and read once: five steps need them.
    long = settle(marked(catalogue.join(texts.where("text is null").select("doc_id"), "doc_id", "left_semi"), queries).select("doc_id", "pos", "start", "finish", "text", "size", "len", "hits"))
    spans = packed_spans(long, budget, top_k, neighbours).join(long.select("doc_id", "pos", "start", "finish", "text"), ["doc_id", "pos"])
    order = W.partitionBy("doc_id").orderBy("pos")
    spans = spans.withColumn("new", F.coalesce(F.col("start") != F.lag("finish").over(order), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    ranges = spans.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("finish").alias("finish"), F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))
    found = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "finish", "text"))).alias("r"))
    matched = long.where(F.size("hits") > 0).select("doc_id", F.lit(True).alias("matched")).distinct()
    out = texts.join(found, "doc_id", "left").join(matched, "doc_id", "left")
    full = F.col("text").isNotNull()
    context = F.when(full, F.col("text")).otherwise(F.array_join(F.transform("r", lambda x: x["text"]), GAP))
    status = F.when(full | F.col("r").isNotNull(), "ready").when(F.col("empty"), "empty_query").when(F.col("matched"), "over_budget").otherwise("no_match")
    bounds = F.when(full, F.array(F.struct(F.lit(0).alias("start"), F.col("whole").alias("finish")))).otherwise(F.transform("r", lambda x: F.struct(x["start"].alias("start"), x["finish"].alias("finish"))))
    out = out.withColumn("context", context)
    return out.select("doc_id", F.when(full, "full_text").otherwise("extractive").alias("mode"), status.alias("status"), bounds.alias("ranges"), F.length("context").alias("chars"), "source_hash", F.sha2("context", 256).alias("context_hash"), "context")


def context_faults(found: DataFrame, docs: DataFrame, budget: int) -> DataFrame:
    """(doc_id, fault): what is wrong with a context, rebuilt from its document's text once: `source`, `ranges` (out of order or bounds),
    `budget`, `content` or null."""
    t = docs.select("doc_id", F.col("text").alias("source"))
    ranges = F.col("ranges")
    ordered = F.forall(F.sequence(F.lit(1), F.size(ranges)), lambda i: (ranges[i - 1]["start"] >= F.when(i > 1, F.get(ranges, i - 2)["finish"]).otherwise(0)) & (ranges[i - 1]["finish"] > ranges[i - 1]["start"]) & (ranges[i - 1]["finish"] <= F.length("source")))
    again = F.array_join(F.transform(ranges, lambda r: F.substring(F.col("source"), r["start"] + 1, r["finish"] - r["start"])), GAP)
    met = found.where("status = 'ready'").join(t, "doc_id", "left").withColumns({"again": again, "ordered": ordered})
    fault = F.when(F.col("source").isNull() | (F.sha2("source", 256) != F.col("source_hash")), "source").when(~F.col("ordered"), "ranges").when(F.length("again") > budget, "budget").when((F.sha2("again", 256) != F.col("context_hash")) | (F.col("again") != F.col("context")), "content")
    return met.select("doc_id", fault.alias("fault"))


# ---------------------------------------------------------------- looking up spans


def visible_spans(catalogue: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk, pos, start, finish, text): what each chunk (doc_id, chunk, start, finish) shows of each span, clipped to it.

    An interval join by bins: a span, of at most SPAN_CHARS, lies in the bin of its start, and a chunk looks into the bins that it covers
    and the one before; so each pair meets once, and rows follow the chunks' length.
    """
    bin_ = lambda c: F.floor(c / SPAN_CHARS).cast("int")
    wide = chunks.where("finish > start").select("doc_id", "chunk", F.col("start").alias("a"), F.col("finish").alias("b"), F.explode(F.sequence(bin_(F.col("start")) - 1, bin_(F.col("finish") - 1))).alias("bin"))
    met = catalogue.withColumn("bin", bin_(F.col("start"))).join(wide, ["doc_id", "bin"]).where("start < b and finish > a")
    start, finish = F.greatest("start", "a"), F.least("finish", "b")
    return met.select("doc_id", "chunk", "pos", start.alias("start"), finish.alias("finish"), F.substring("text", start - F.col("start") + 1, finish - start).alias("text"))


def passages(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """(list_id, text, unknown): the spans named by (list_id, i, span_id) put together in the order of i; unknown counts ids that no span has."""
    met = wanted.join(catalogue.select("span_id", "text").dropDuplicates(["span_id"]), "span_id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("i", "text"))))
    return met.groupBy("list_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.count_if(F.col("text").isNull()).alias("unknown"))


def contiguous(selections: DataFrame) -> DataFrame:
    """(list_id, start, finish, fault): ranges (list_id, doc_id, start, finish) of one document that follow each other, as one range; else
    null with the fault `documents`, `gap` or `overlap`."""
    w = W.partitionBy("list_id").orderBy("start", "finish")
    before = F.lag("finish").over(w)
    marked = selections.withColumns({"gap": F.col("start") > before, "over": F.col("start") < before})
    by = marked.groupBy("list_id").agg(F.min("start").alias("a"), F.max("finish").alias("b"), F.countDistinct("doc_id").alias("d"), F.coalesce(F.bool_or("gap"), F.lit(False)).alias("gap"), F.coalesce(F.bool_or("over"), F.lit(False)).alias("over"))
    fault = F.when(F.col("d") > 1, "documents").when(F.col("over"), "overlap").when(F.col("gap"), "gap")
    return by.withColumn("fault", fault).select("list_id", F.when(F.col("fault").isNull(), F.col("a")).alias("start"), F.when(F.col("fault").isNull(), F.col("b")).alias("finish"), "fault")
