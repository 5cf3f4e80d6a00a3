"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from . import language, privacy, secrets, toxicity
from .audit import MEASURES, filter_audit
from .decontaminate import decontaminate
from .neardup import near_duplicates
from .packing import pack, tokenize_pieces
from .records import round_trip
from .sharding import shard
from .topk import top_k
from .urls import filter_urls
from .whitening import whiten


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# DuckDB texts may hold any characters; a window is the list of its words.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS win FROM (
    SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM (SELECT item, w, least(13, len(w)) AS m FROM i WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, p, m, array_to_string(w[p : p + m - 1], ' ') AS win FROM (
    SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT DISTINCT r, p, dw.m, item FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, p, m FROM h)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN its USING (r)
"""


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, host, path, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS k
    FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

OP6_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS q, b.r AS c, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_sql() -> str:
    """Spans in DuckDB: the pieces between matches give the places, as in Spark; the model's table is a list."""
    counts = Counter((y, t[i : i + 2]) for t, y in secrets.sample_rows() for i in range(len(t) - 1))
    table, k = secrets.ratios(counts), len(secrets.ALPHABET)
    q = lambda p: p.replace("'", "''")
    patterns = zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.TOKEN), strict=True)
    hits = " UNION ALL ".join(f"SELECT r, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{q(p)}') AS hits, string_split_regex(t, '{q(p)}') AS gaps FROM d" for rank, (kind, p) in enumerate(patterns))
    ratio = f"list_sum(list_transform(range(1, length(hit)), lambda i: w[(instr('{secrets.ALPHABET}', substr(hit, i, 1)) - 1) * {k} + instr('{secrets.ALPHABET}', substr(hit, i + 1, 1))]))"
    names = "coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), tb AS (SELECT {table} AS w), m AS ({hits}),
e AS (SELECT r, kind, rank, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT r, kind, rank, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1 : i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda h: length(h))), 0) AS BIGINT) AS st FROM e),
f AS (SELECT r, kind, rank, hit, st, st + length(hit) AS en FROM s, tb WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '{q(secrets.ASSIGN)}', 2)) >= {secrets.ASSIGN_LEAST}
    WHEN 'markov' THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND {ratio} >= 400 * (length(hit) - 1) ELSE true END),
g AS (SELECT * FROM f WHERE kind <> 'markov' OR NOT EXISTS (SELECT 1 FROM f b WHERE b.r = f.r AND b.kind <> 'markov' AND b.st < f.en AND f.st < b.en)),
a AS (SELECT r, CAST(count(*) FILTER (WHERE kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE kind = 'access') AS BIGINT) AS n_access, CAST(count(*) FILTER (WHERE kind = 'hex') AS BIGINT) AS n_hex, {names} AS spans,
    coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) FILTER (WHERE kind <> 'markov'), '') AS base FROM g GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


#: Orders by recursion; a document's failures are letters, so a step is a comparison of letter sets.
OP13_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM t GROUP BY t),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t.t) - length(regexp_replace(t.t, '[A-Z]', '', 'g'))) > 5 * length(t.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t.t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN least IS NOT NULL AND (t.doc_id IS NULL OR t.doc_id > least) THEN 'E' ELSE '' END AS fails
    FROM t JOIN m ON t.t = m.t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM d GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
p AS (SELECT '' AS o UNION ALL SELECT o || f FROM p, f WHERE NOT contains(o, f)),
s AS (SELECT o AS filter_order, k AS step, substr(o, k, 1) AS f, substr(o, 1, k - 1) AS done FROM (SELECT o, unnest(range(1, 6)) AS k FROM p WHERE length(o) = 5)),
x AS (SELECT part, filter_order, step, f, n, good, bad, fails = f AS alone, contains(fails, f) AS hit, length(translate(fails, done, '')) < length(fails) AS gone FROM c, s),
y AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
    coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND hit), 0) AS toxic_lost FROM x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM y
"""


def packed_digest(docs: DataFrame) -> DataFrame:
    """Placed pieces with a digest of each piece's ids; the ids themselves need not travel with it."""
    pieces = tokenize_pieces(docs, tokenizer_file("byte_bpe_50k.json"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(read(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# The contract's rules.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train_on_documents(docs)).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def op7_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), exclude=language.held_out())
    found = toxicity.score(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"), secrets.train(secrets.default_samples(spark)))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in secrets.KINDS[:3]), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.scan(read(spark, sf_dir, "documents"), privacy.train(privacy.default_samples(spark)))
    base = F.filter("spans", lambda s: s["rank"] < len(privacy.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in privacy.BASE), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"), 4)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("part", "filter_order", "step", *MEASURES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_sharding": op2_sharding,
        "op3_url_filters": op3_url_filters,
        "op4_language_id": op4_language_id,
        "op5_decontamination": op5_decontamination,
        "op6_top_k": op6_top_k,
        "op7_binary_records": op7_binary_records,
        "op8_order_minhash": op8_order_minhash,
        "op9_toxicity": op9_toxicity,
        "op10_secret_scans": op10_secret_scans,
        "op11_personal_data": op11_personal_data,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": OP3_SQL,
        "op5_decontamination": OP5_SQL,
        "op6_top_k": OP6_SQL,
        "op10_secret_scans": op10_sql(),
        "op13_filter_audit": OP13_SQL,
    }
