"""Styles of single entries and of bibliographies."""

from pyspark.sql import functions as F

from folioscope.operators import styles

SAMPLES = {
    "apa7": "Abel, A. B. (1990). Of goods. Things, 12(3), 4-9. https://doi.org/10.1000/a",
    "vancouver": "Abel AB, Baker C. Of goods. Things. 1990;12(3):4-9.",
    "ama": "Abel AB, Baker C. Of goods. Things. 1990;12(3):4-9. doi:10.1000/a",
    "chicago_nb": "Abel, Anna. “Of goods and chattels.” Things 12 (1990), no. 3.",
    "mla9": "Abel, Anna. Of goods and chattels. Things, vol. 12, 1990, pp. 4-9. Accessed 3 May 2001.",
    "ieee": 'A. Abel and B. Baker, "Of goods and chattels," Things, vol. 12, no. 3, pp. 4-9, 1990, doi: 10.1000/a.',
}


def test_scores_of_entries(spark):
    rows = spark.createDataFrame([(k, v) for k, v in SAMPLES.items()] + [("none", None)], "name string, raw string")
    got = {r.name: r.asDict() for r in rows.select("name", *[c.alias(s) for s, c in styles.entry_scores(F.col("raw")).items()]).collect()}
    assert (got["apa7"]["apa7"], got["vancouver"]["vancouver"], got["ieee"]["ieee"], got["mla9"]["mla9"]) == (6.0, 3.5, 6.0, 4.5)
    assert all(got["none"][s] == 0 for s in styles.STYLES)
    for name in ("apa7", "chicago_nb", "mla9", "ieee"):
        assert max(styles.STYLES, key=lambda s: got[name][s]) == name


def test_detection(spark):
    rows = [(1, "dated", SAMPLES["apa7"])] * 3 + [(2, "numbered", SAMPLES["vancouver"])] * 2 + [(3, "numbered", SAMPLES["ama"])] * 2 + [(4, "lines", "nothing of a kind")]
    found = spark.createDataFrame([(d, m, r) for d, m, r in rows], "doc_id long, mode string, raw string")
    got = {r.doc_id: (r.style, r.score, r.lead, r.confidence) for r in styles.detected_styles(found).collect()}
    assert got[1][:2] == ("apa7", 6.0) and got[1][3] == "high" and got[2][0] == "vancouver" and got[2][3] == "high"
    assert got[3] == ("vancouver", 4.5, 0.5, "medium")
    # Equal scores go by name, and are not sure.
    assert got[4] == ("ama", 0.0, 0.0, "low")
    assert styles.detected_styles(found.where("false")).count() == 0
