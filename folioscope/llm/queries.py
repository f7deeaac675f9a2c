"""The registered queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, langid, line_dedup, media, near_dup, passages, pii, secrets, suffix_dedup, urlfilter, whitening
from .common import table

BPE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, distance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance")


def op2_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each shared passage: of a document and the first or last that has it, or of a copy and its first."""
    return passages.shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_wav_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: sizes and digests of its WAV file, a digest of the fingerprint, and the time-coded pairs themselves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = media.media_features(media.text_to_media(docs).drop("text"))
    feature = F.concat_ws(":", "n_frames", "n_peaks", F.size("pairs"), F.sha2(F.array_join(F.col("pairs").cast("array<string>"), ","), 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "pairs")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: number and digest of its ids, and the digest of the text decoded from them."""
    return bpe_digest(table(spark, sf_dir, "documents"))


def bpe_digest(docs: DataFrame) -> DataFrame:
    coded = bpe.round_trip(docs.select("doc_id", "text"), BPE_VOCABULARY, drop=("text",))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its lines, and the numbers of those that go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = line_dedup.superfluous_lines(docs)
    sizes = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    places = F.coalesce(F.array_join(F.col("lines").cast("array<string>"), ","), F.lit(""))
    return sizes.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), places.alias("removed"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its predicted language and that language's posterior; learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out), PIECE_VOCABULARY)
    found = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, PIECE_VOCABULARY)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans, the random tokens included."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).drop("text")
    orders = F.transform("base_secrets", lambda s: s["ord"])
    counts = [(F.size(orders) - F.size(F.array_remove(orders, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base_secrets")), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its class (the least id of it)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.with_classes(docs).select("doc_id", "class_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans, those of the field included."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit(pii.labelled_table(spark))).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of the pages whose id is divisible by 50."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, pages.where("page_id % 50 = 0")).select("page_id", "host", "path", "rule", "verdict")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its bytes, those removed and in how many runs, and the digest of the others."""
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return cut.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each embedding and component: its whitened value, and what the component explains."""
    rows = whitening.quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitening.whiten(rows, whitening.fit(rows))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each anchor, positive and negative returned; labels of ids divisible by 7 are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_shared_passages, op3_wav_fingerprint, op4_bpe, op5_line_dedup, op6_language_id, op7_secrets, op8_near_dup, op9_pii, op10_url_filter, op11_suffix_dedup, op12_whitening, op13_hard_negatives)
}

_OP10 = r"""
WITH cut AS (
  SELECT page_id, url, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), canon AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN
    regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') ||
    coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)='))), '&'), ''), '') END AS c
  FROM parts
), rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, max(struct_pack(n := length(h || p), rule := h || p, v := v)) AS b
  FROM parts, rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id
), listed AS (SELECT DISTINCT c FROM canon WHERE page_id % 50 = 0 AND c IS NOT NULL)
SELECT canon.page_id, host, path, b.rule AS rule, coalesce(b.v, CASE WHEN listed.c IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM canon LEFT JOIN best USING (page_id) LEFT JOIN listed ON canon.c = listed.c
"""

_OP5 = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents
), filled AS (SELECT doc_id, p, line, list_filter(string_split(line, ' '), lambda w: w <> '') AS w FROM line WHERE trim(line) <> ''),
first AS (SELECT line, min(struct_pack(d := doc_id, p := p)) AS loc, any_value(w) AS w FROM filled GROUP BY line),
sets AS (
  SELECT row_number() OVER (ORDER BY loc) AS k, line, loc,
    CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM first
), tokens AS (SELECT k, len(s) AS n, unnest(s) AS t FROM sets),
counted AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
ranked AS (SELECT k, n, t, row_number() OVER (PARTITION BY k ORDER BY c, t) AS i FROM tokens JOIN counted USING (t)),
heads AS (SELECT * FROM ranked WHERE i <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.k AS a, b.k AS b FROM heads a JOIN heads b USING (t) WHERE a.k < b.k AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
near AS (SELECT DISTINCT b AS k FROM pairs JOIN sets x ON x.k = a JOIN sets y ON y.k = b WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (len(x.s) + len(y.s))),
gone AS (
  SELECT f.doc_id, f.p FROM filled f JOIN sets USING (line) LEFT JOIN near USING (k) WHERE near.k IS NOT NULL OR struct_pack(d := f.doc_id, p := f.p) <> loc
), cut AS (SELECT doc_id, count(*) AS n, string_agg(p::VARCHAR, ',' ORDER BY p) AS r FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(coalesce(text, ''), chr(10))), 1) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(r, '') AS removed FROM documents LEFT JOIN cut USING (doc_id)
"""

_OP13 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""

_OP11 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, unnest(range(1, octet_length(b) - 98)) AS p, b AS x FROM d WHERE octet_length(b) >= 100),
c AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_slice(x, p, p + 99) ORDER BY doc_id, p) AS i FROM w),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS was FROM c WHERE i > 1),
r AS (SELECT doc_id, p, sum(CASE WHEN was IS NULL OR p > was + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, k),
t AS (SELECT doc_id, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS i FROM s),
k AS (
  SELECT doc_id, sum(t.b - a)::BIGINT AS n, count(*) AS m, string_agg(hex(array_slice(d.b, z, a - 1)), '' ORDER BY a) || max(CASE WHEN i = 1 THEN hex(array_slice(d.b, t.b, octet_length(d.b))) ELSE '' END) AS x
  FROM t JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(m, 0) AS n_spans, sha256(CASE WHEN n IS NULL THEN b ELSE unhex(x) END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op11_suffix_dedup": _OP11, "op13_hard_negatives": _OP13, "op5_line_dedup": _OP5, "op10_url_filter": _OP10}
