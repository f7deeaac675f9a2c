"""Documents to relations: sentences, chunks, quality flags, repeated lines, grounded passages, ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import alpha_ratio, sentences, topic_tokens, word_tokens
from ..sources.tables import settle

#: Okapi weights.
K1, B = 1.5, 0.75


def sentence_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence, context): each sentence with its neighbours, one on each side. Row-local: no shuffle."""
    s = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", "s", F.posexplode("s").alias("pos", "sentence")).select(
        "doc_id", "pos", "sentence", F.array_join(F.slice("s", F.greatest("pos", F.lit(1)), F.when(F.col("pos") > 0, 3).otherwise(2)), " ").alias("context")
    )


def chunk_windows(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, chunk, text): non-blank lines; those of more than `size` sentences as windows of that many."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.trim("t") != "")
    parts = lines.select("doc_id", "line", sentences(F.col("t")).alias("s")).where(F.size("s") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("s") - 1) / size).cast("int"))
    return parts.select("doc_id", "line", "s", F.explode(starts).alias("part")).select(
        "doc_id", "line", "part", F.array_join(F.slice("s", F.col("part") * size + 1, F.lit(size)), " ").alias("chunk")
    )


def quality_flags(docs: DataFrame) -> DataFrame:
    """Per document: characters, share of letters, words, non-blank lines, and flags for low share, long words and repeated lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    m = docs.select(
        "doc_id", F.length("text").alias("chars"), F.round(alpha_ratio(F.col("text")), 4).alias("alpha"),
        F.size(word_tokens(F.col("text"))).alias("tokens"), F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("distinct_lines"),
    )
    return m.withColumns({
        "low_alpha": F.col("alpha") < 0.55, "long_words": F.col("chars") > 10 * F.col("tokens"), "repeats": F.col("lines") - F.col("distinct_lines") >= 4,
        "usable": (F.col("chars") >= 200) & (F.col("alpha") >= 0.35) & (F.col("tokens") >= 50),
    })


def repeated_lines(docs: DataFrame, least: int = 2, min_chars: int = 8) -> DataFrame:
    """(doc_id, line, n): stripped lines of min_chars or more that a document has `least` times or more; counted map-side first."""
    lines = docs.select("doc_id", F.explode(F.transform(F.split("text", "\n"), F.trim)).alias("line")).where(F.length("line") >= min_chars)
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def strip_repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where only the first of equal stripped lines of 8 characters or more stays.

    Lines are sorted with their places inside the row; the first of each run of equal ones stays.
    """
    lines = F.split("text", "\n")
    shown = docs.select("doc_id", lines.alias("l"), F.transform(lines, F.trim).alias("t"))
    # Sorted by line and place, a line is the first of its kind where the one before differs.
    ordered = F.array_sort(F.transform("t", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    kept = shown.select("doc_id", "l", ordered.alias("o")).select("doc_id", "l", F.array_sort(F.transform(F.filter(F.zip_with("o", F.concat(F.array(F.lit(None).cast("struct<x:string,i:int>")), F.slice("o", 1, F.greatest(F.size("o") - 1, F.lit(0)))), lambda a, b: F.struct(a.alias("a"), ((F.length(a["x"]) < 8) | b.isNull() | (a["x"] != b["x"])).alias("first"))), lambda z: z["first"]), lambda z: z["a"]["i"])).alias("k"))
    return kept.select("doc_id", F.array_join(F.transform("k", lambda i: F.get("l", i)), "\n").alias("text"))


def hash_duplicates(docs: DataFrame) -> DataFrame:
    """(text_hash, copies, first_id) of texts that occur more than once; counted on the map side first."""
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def ground_exact(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id, start, finish, status): verbatim places of passages in documents, in characters, end exclusive.

    The second to sixth word of a passage must occur as a run of words wherever the passage does: an equality join on that
    run finds the candidates, and `locate` verifies them. Passages of three to six words are found by their second word;
    only those of one or two, which have no whole word inside, meet all documents. `ambiguous`: it occurs again.
    """
    items = passages.select("item_id", F.col("text").alias("passage"), F.split("text", r"\s+").alias("pw"))
    words = docs.select("doc_id", F.split("text", r"\s+").alias("w"))
    # A run's hash is enough here: `locate` decides.
    codes = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))
    keyed = items.where(F.size("pw") >= 7).select("item_id", "passage", F.xxhash64(*[F.get("pw", F.lit(k)) for k in range(1, 6)]).alias("code"))
    hits = words.where(F.size("w") >= 5).select("doc_id", F.explode(F.array_distinct(codes)).alias("code")).join(keyed, "code").select("doc_id", "item_id", "passage")
    short = items.where((F.size("pw") < 7) & (F.size("pw") > 2)).select("item_id", "passage", F.get("pw", F.lit(1)).alias("word"))
    inside = words.select("doc_id", F.explode(F.array_distinct("w")).alias("word")).join(short, "word").select("doc_id", "item_id", "passage")
    near = hits.union(inside).distinct().join(docs.select("doc_id", "text"), "doc_id")
    tiny = docs.select("doc_id", "text").join(items.where(F.size("pw") <= 2).select("item_id", "passage"), F.expr("contains(text, passage)"))
    both = near.select("doc_id", "item_id", "passage", "text").union(tiny.select("doc_id", "item_id", "passage", "text"))
    found = both.withColumn("at", F.expr("locate(passage, text)")).where("at > 0")
    return found.select("item_id", "doc_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("passage")).alias("finish"),
                        F.when(F.expr("locate(passage, text, at + 1) > 0"), "ambiguous").otherwise("unique").alias("status"))


def support_rollup(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Per document with at least one sentence: sentences, grounded passages and a badge."""
    counts = docs.select("doc_id", F.size(sentences(F.col("text"))).alias("sentences"))
    grounded = ground_exact(docs, passages).groupBy("doc_id").agg(F.count(F.lit(1)).alias("grounded"), F.sum((F.col("status") == "ambiguous").cast("long")).alias("ambiguous"))
    n = F.coalesce("grounded", F.lit(0))
    return counts.where("sentences > 0").join(grounded, "doc_id", "left").select(
        "doc_id", "sentences", n.alias("grounded"), F.coalesce("ambiguous", F.lit(0)).alias("ambiguous"),
        F.when(n == 0, "unsupported").when(F.coalesce("ambiguous", F.lit(0)) > 0, "ambiguous").otherwise("supported").alias("badge"),
    )


def document_frequency(docs: DataFrame) -> DataFrame:
    """(token, df): in how many documents each topic token occurs."""
    return docs.select(F.explode(F.array_distinct(topic_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query by Okapi weights; equal scores by id.

    Only tokens of queries and lengths leave the scan: they are joined before anything is grouped, each distinct token counts once.
    """
    wanted = queries.select("item_id", F.explode(F.array_distinct(topic_tokens(F.col("text")))).alias("token"))
    # A document's own row, under a token that no text has, carries its length; so texts are read once.
    own = F.array(F.lit(""))
    tokens = docs.select("doc_id", topic_tokens(F.col("text")).alias("t"))
    posted = tokens.select("doc_id", F.size("t").alias("len"), F.explode(F.coalesce(F.concat("t", own), own)).alias("token"))
    posted = posted.join(wanted.select("token").union(docs.sparkSession.createDataFrame([("",)], "token string")).distinct(), "token", "left_semi")
    every = settle(posted.groupBy("token", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf")))
    whole, tf = every.where("token = ''"), every.where("token <> ''")
    size = whole.agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum(F.when(F.col("len").isNotNull(), F.col("tf")))).alias("mean")).select(F.struct("n", "mean")).scalar()
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / size["mean"]))
    scored = tf.join(df, "token").select("token", "doc_id", weight.alias("w")).join(wanted, "token").groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", F.round("score", 3).alias("score"))
