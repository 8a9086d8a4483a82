"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.llm import bpe, decontaminate, html_extract, knn, pii, quality, sampling, secret_scan, simhash, spans, tokens, toxicity
from plansift.llm.common import shared_path, table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "similarity")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "findings", secret_scan.secrets().alias("secrets"))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size("secrets").cast("long").alias("n_secrets"), spans.written(F.col("secrets"), lambda s: F.lit("secret")).alias("spans"))


def _held_out(key: str, folds: int, at: int):
    return F.coalesce(sampling.fold(key, folds) == at, F.lit(False)).alias("held_out")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", _held_out("doc_id", 4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokens.offsets(tokens.read_tokens(spark, out))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(pii.BASE))
    found = found.select("doc_id", "spans", base.alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(spans.written(F.col("base"), lambda s: s["kind"]), 256).alias("base_sha256"), spans.written(F.col("spans"), lambda s: s["kind"]).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.score(docs, quality.learned(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", _held_out("doc_id", 3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_decontamination, op3_secrets, op4_toxicity, op5_top_k, op6_byte_bpe, op7_simhash, op8_token_files, op9_pii, op10_quality)}
ORACLE_SQL = {
    "op2_decontamination": r"""
        WITH iw AS (
            SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
        ), i AS (
            SELECT item_id, w, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS m FROM iw WHERE len(w) > 0
        ), ish AS (
            SELECT item_id, k, m, q, array_to_string(w[q + 1:q + k], ' ') AS s FROM (SELECT *, unnest(range(0, m)) AS q FROM i)
        ), d AS (
            SELECT doc_id, k, w, len(w) - k + 1 AS m FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), (SELECT DISTINCT k FROM i) WHERE len(w) >= k
        ), dsh AS (
            SELECT doc_id, k, m, p, array_to_string(w[p + 1:p + k], ' ') AS s FROM (SELECT *, unnest(range(0, m)) AS p FROM d)
        ), windows AS (
            SELECT DISTINCT doc_id, item_id, k, ish.m AS im, least(ish.m, dsh.m) AS wm, greatest(0, least(p - o, dsh.m - ish.m)) AS start FROM dsh JOIN (SELECT *, unnest([q, 0, m - 1]) AS o FROM ish) AS ish USING (k, s)
        ), inside AS (
            SELECT doc_id, item_id, start, wm, im, s, count(*) AS n FROM windows JOIN dsh USING (doc_id, k) WHERE p >= start AND p < start + wm GROUP BY ALL
        ), wanted AS (
            SELECT item_id, s, count(*) AS n FROM ish GROUP BY ALL
        ), scored AS (
            SELECT doc_id, item_id, start, sum(least(inside.n, wanted.n)) AS shared, any_value(wm) + any_value(im) AS total FROM inside JOIN wanted USING (item_id, s) GROUP BY ALL
        ), ranked AS (
            SELECT doc_id, item_id, start, CAST(shared AS DOUBLE) / CAST(total - shared AS DOUBLE) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / (total - shared) DESC, start) AS r FROM scored
        )
        SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, similarity FROM ranked WHERE r = 1 AND similarity >= 0.8""",
    "op9_pii": r"""
        WITH k(kind, no, p) AS (VALUES
            ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), ('card', 2, '[0-9](?:[ -]?[0-9])+'),
            ('phone', 3, '\+[0-9][ ().0-9-]+[0-9]'), ('iban', 4, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b'), ('ssn', 5, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')
        ), m AS (
            SELECT doc_id, coalesce(text, '') AS t, kind, no, regexp_extract_all(coalesce(text, ''), p) AS f, string_split_regex(coalesce(text, ''), p) AS g FROM documents, k
        ), e AS (
            SELECT doc_id, t, kind, no, f, g, unnest(f) AS s, unnest(range(1, len(f) + 1)) AS j FROM m WHERE len(f) > 0
        ), placed AS (
            SELECT doc_id, t, kind, no, s, CAST(list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS a,
                regexp_replace(s, '[^0-9]', '', 'g') AS digits, replace(s, ' ', '') AS plain
            FROM e
        ), fine AS (
            SELECT *, a + length(s) AS b FROM placed WHERE CASE kind
                WHEN 'email' THEN TRUE
                WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 256) > 255)) = 0
                WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ascii(substr(reverse(digits), i, 1)) - 48
                    ELSE 2 * (ascii(substr(reverse(digits), i, 1)) - 48) - CASE WHEN ascii(substr(reverse(digits), i, 1)) > 52 THEN 9 ELSE 0 END END)) % 10 = 0
                WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
                WHEN 'iban' THEN list_reduce(list_transform(string_split(substr(plain, 5) || substr(plain, 1, 4), ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
                    lambda x, y: CASE WHEN y < 10 THEN (x * 10 + y) % 97 ELSE (x * 100 + y) % 97 END) = 1
                ELSE NOT regexp_matches(s, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(substr(t, greatest(a - 39, 1), least(40, a)) || ' ' || substr(t, a + length(s) + 1, 40), '(?i)ssn|social|security|insurance|sozialversicherung') END
        ), d AS (
            SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
                string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) FILTER (no < 4) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) AS spans
            FROM fine GROUP BY doc_id
        )
        SELECT o.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents o LEFT JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id""",
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
