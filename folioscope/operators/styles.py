"""Style of a bibliography: features of its entries, weighted into scores of seven styles, averaged and ranked for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: What an entry shows, as patterns.
FEATURES = {
    "dated": r"\((?:1[5-9]|20)[0-9]{2}[a-z]?\)",
    "year": r"\b(?:1[5-9]|20)[0-9]{2}\b",
    "dotted": r"\p{Lu}[\p{L}'’-]+, \p{Lu}\.",
    "letters": r"\p{Lu}[\p{L}'’-]+ \p{Lu}{1,3}[,.]",
    "first_name": r"^\p{Lu}[\p{L}'’-]+, \p{Lu}\p{Ll}+",
    "leading_initial": r"^\p{Lu}\.(?: \p{Lu}\.)* \p{Lu}\p{Ll}",
    "quoted": r'["“][^"”]{8,}["”]',
    "vol_label": r"(?i)\bvol\. ?[0-9]",
    "label": r"(?i)\b(?:vol|no)\. ?[0-9]",
    "labels": r"(?i)\bvol\. ?[0-9]+, no\. ?[0-9]+",
    "vol_issue": r"[0-9] ?\([0-9]+\)",
    "accessed": r"(?i)\baccessed\b",
    "doi_url": r"https?://(?:dx\.)?doi\.org/",
    "doi_mark": r"(?i)\bdoi: ?10\.",
}
#: Style, weight, the features that an entry must have, and those that it must not have.
WEIGHTS = [
    ("ama", 2.0, ["doi_mark"], []), ("ama", 0.5, ["letters", "vol_issue"], ["dotted"]), ("ama", 0.5, ["year"], ["dated"]),
    ("apa7", 3.0, ["dated"], []), ("apa7", 1.5, ["dotted"], []), ("apa7", 1.0, ["doi_url"], []), ("apa7", 0.5, ["vol_issue"], []),
    ("chicago", 2.0, ["first_name"], ["dated"]), ("chicago", 1.0, ["quoted"], []), ("chicago", 0.5, ["vol_issue"], []),
    ("chicago_nb", 2.5, ["first_name"], []), ("chicago_nb", 1.5, ["quoted"], []), ("chicago_nb", 1.0, ["label"], []), ("chicago_nb", 0.5, ["vol_issue"], []),
    ("ieee", 2.5, ["leading_initial"], []), ("ieee", 2.0, ["labels"], []), ("ieee", 1.0, ["quoted", "vol_label"], []), ("ieee", 0.5, ["doi_mark"], []),
    ("mla9", 3.0, ["label"], []), ("mla9", 1.0, ["first_name"], []), ("mla9", 0.5, ["quoted"], []), ("mla9", 0.5, ["accessed"], []),
    ("vancouver", 2.5, ["letters"], ["dotted"]), ("vancouver", 0.5, ["year"], ["dated"]), ("vancouver", 0.5, ["vol_issue"], []),
]
STYLES = sorted({w[0] for w in WEIGHTS})
#: How citations by number or by name and year change a style's mean: factor, addition, least mean for the addition.
BY_NUMBER = {**dict.fromkeys(["apa7", "chicago", "mla9"], (0.25, 0.0, 0.0)), **dict.fromkeys(["vancouver", "ama", "ieee"], (1.0, 1.0, 0.0)), "chicago_nb": (1.0, 1.5, 1.0)}
BY_NAME = dict.fromkeys(["vancouver", "ama", "ieee"], (0.25, 0.0, 0.0))
#: Least score and least lead for each confidence.
CONFIDENCE = [("high", 1.5, 0.6), ("medium", 0.8, 0.3)]


def entry_scores(raw: Column) -> dict[str, Column]:
    """Score of each style for one entry; 0 for a null one."""
    has = {f: F.coalesce(raw.rlike(p), F.lit(False)) for f, p in FEATURES.items()}
    out = {s: F.lit(0.0) for s in STYLES}
    for style, weight, needs, bars in WEIGHTS:
        holds = F.lit(True)
        for f in needs:
            holds = holds & has[f]
        for f in bars:
            holds = holds & ~has[f]
        out[style] = out[style] + F.when(holds, weight).otherwise(0.0)
    return out


def style_scores(entries: DataFrame) -> DataFrame:
    """entries (doc_id, mode, raw) -> (doc_id, style, score, rank): the mean over a document's entries, changed by how it cites.

    mode `numbered` counts as citing by number, `dated` by name and year; others change nothing. Equal scores go by the style's name.
    """
    by = entries.groupBy("doc_id", "mode").agg(*[F.round(F.avg(c), 3).alias(s) for s, c in entry_scores(F.col("raw")).items()])
    long = by.unpivot(["doc_id", "mode"], STYLES, "style", "mean")
    score = F.col("mean")
    for mode, changes in (("numbered", BY_NUMBER), ("dated", BY_NAME)):
        for style, (factor, more, least) in changes.items():
            score = F.when((F.col("mode") == mode) & (F.col("style") == style), F.round(F.col("mean") * factor + F.when(F.col("mean") >= least, more).otherwise(0.0), 3)).otherwise(score)
    ranked = long.withColumn("score", score)
    return ranked.select("doc_id", "style", "score", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "style")).alias("rank"))


def detected_styles(entries: DataFrame) -> DataFrame:
    """(doc_id, style, score, lead, confidence): the first style, its lead over the second, and how sure that is."""
    w = W.partitionBy("doc_id").orderBy("rank")
    led = style_scores(entries).withColumn("lead", F.round(F.col("score") - F.lead("score").over(w), 3)).where("rank = 1")
    sure = F.lit("low")
    for name, score, lead in reversed(CONFIDENCE):
        sure = F.when((F.col("score") >= score) & (F.col("lead") >= lead), name).otherwise(sure)
    return led.select("doc_id", "style", "score", "lead", sure.alias("confidence"))
