from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import documents as D
from folioscope.streaming.pacing import token_bucket_batch


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_page_ranges(spark):
    assert one(spark, "123-8", T.page_range_end) == 128
    assert one(spark, "198-3", T.page_range_end) == 203
    assert one(spark, "12-345", T.page_range_end) == 345
    assert one(spark, "abc", T.page_range_end) is None


def test_serial_numbers(spark):
    assert one(spark, "0378-5955", T.issn) == "03785955"
    assert one(spark, "0378-5954", T.issn) is None
    assert one(spark, None, T.issn) is None


def test_number_lists(spark):
    assert one(spark, "1,3,5-8", T.expand_numbers) == [1, 3, 5, 6, 7, 8]
    assert one(spark, "9-5,x,1-999", T.expand_numbers) == []


def test_identifiers(spark):
    assert one(spark, "https://doi.org/10.1000/ABC/", T.doi_key) == "10.1000/abc"


def test_sentences_and_windows(spark):
    df = spark.createDataFrame([(1, "One is. Two is!\nThree?"), (2, ""), (3, None)], "doc_id long, text string")
    rows = D.sentence_windows(df).orderBy("doc_id", "pos").collect()
    assert [r.sentence for r in rows] == ["One is.", "Two is!", "Three?"]
    assert [r.context for r in rows] == ["One is. Two is!", "One is. Two is! Three?", "Two is! Three?"]


def test_grounding_status(spark):
    passage = "zero one two three four five six seven"
    docs = spark.createDataFrame([(1, f"a {passage}. b"), (2, f"{passage} {passage}"), (3, "zero one two three four five"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, passage), (8, "one two")], "item_id long, text string")
    rows = {(r.item_id, r.doc_id): (r.start, r.status) for r in D.ground_exact(docs, items).collect()}
    assert rows[9, 1] == (2, "unique") and rows[9, 2] == (0, "ambiguous") and (9, 3) not in rows
    assert rows[8, 3] == (5, "unique")


def test_token_bucket(spark):
    df = spark.createDataFrame([(1, float(t), i) for i, t in enumerate([0, 0, 0, 5, 5])], "key long, t double, event_id long")
    rows = token_bucket_batch(df, 0.2, 2.0).orderBy("event_id").collect()
    assert [r.granted for r in rows] == [True, True, False, True, False]
