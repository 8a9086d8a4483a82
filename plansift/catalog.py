"""The registered queries of the drawing operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.functions import rules, text
from plansift.operators import benchmark, extract, geometry, merge, profile, rows
from plansift.plans import adapters, project
from plansift.sources import cache, engines, sinks, tiles
from plansift.streaming import watch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

ALL = ", ".join(adapters.LINEITEM)
RECORDS = f"""records AS (
    SELECT CAST(l_partkey % 7 AS VARCHAR) AS project_id, row_number() OVER (PARTITION BY l_partkey ORDER BY {ALL}) AS ordinal,
        CASE l_returnflag WHEN 'A' THEN 'PZT' WHEN 'N' THEN 'PROFIL' ELSE 'SZCZEGOL' END AS drawing_type,
        l_returnflag || (l_suppkey % 5) || '.pdf' AS base, l_linenumber - 1 AS page, l_linestatus || ' ' || l_linenumber AS raw_text,
        'D' || l_partkey AS key, CASE WHEN l_linenumber % 3 = 2 THEN 'kinetowa' END AS type,
        CASE WHEN l_orderkey % 2 = 0 THEN CAST(1000 + 200 * (l_suppkey % 2) AS INTEGER) END AS dn,
        CASE WHEN l_orderkey % 3 <> 0 THEN 100 + l_linenumber / 4 END AS g, CASE WHEN l_orderkey % 5 <> 0 THEN 97 + (l_suppkey % 4) / 4 END AS i,
        CASE WHEN l_linenumber % 4 = 0 THEN 3.0::DOUBLE END AS h, CASE WHEN l_suppkey % 3 = 0 THEN 'właz' END AS crown, l_linenumber % 3 AS n_transitions,
        CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS prio
    FROM lineitem
)"""
MERGED = f"""{RECORDS}, numbered AS (
    SELECT *, row_number() OVER k AS n FROM records WINDOW k AS (PARTITION BY project_id, key ORDER BY prio, ordinal)
), paired AS (
    SELECT *, n > 1 AND drawing_type = 'PROFIL' AND coalesce(g - i BETWEEN 0.35 AND 8, FALSE) AS pair, coalesce(h, round_even((g - i) * 100, 0) / 100) AS ph FROM numbered
), held AS (
    SELECT *,
        coalesce(last_value(CASE WHEN pair THEN g END IGNORE NULLS) OVER p, first_value(g IGNORE NULLS) OVER p) AS hg,
        coalesce(last_value(CASE WHEN pair THEN i END IGNORE NULLS) OVER p, first_value(i IGNORE NULLS) OVER p) AS hi,
        coalesce(last_value(CASE WHEN pair THEN ph END IGNORE NULLS) OVER p, first_value(h IGNORE NULLS) OVER p) AS hh,
        first_value(dn IGNORE NULLS) OVER p AS hdn
    FROM paired WINDOW p AS (PARTITION BY project_id, key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), issued AS (
    SELECT *, list_filter([
        CASE WHEN hdn <> dn THEN format('sprzeczne DN: {{}} / {{}}', hdn, dn) END,
        CASE WHEN NOT pair AND abs(hg - g) > 0.03 THEN format('sprzeczna rzędna góry: {{:.2f}} / {{:.2f}}', hg, g) END,
        CASE WHEN NOT pair AND abs(hi - i) > 0.03 THEN format('sprzeczna rzędna dna: {{:.2f}} / {{:.2f}}', hi, i) END,
        CASE WHEN NOT pair AND abs(hh - h) > 0.05 THEN format('sprzeczna wysokość: {{:.2f}} / {{:.2f}}', hh, h) END], lambda x: x IS NOT NULL) AS issues
    FROM held
), folded AS (
    SELECT project_id, key, max(n) AS n_records, flatten(list(issues ORDER BY n)) AS all_issues,
        arg_min(page, n) FILTER (page > 0) AS page, arg_min(type, n) FILTER (type IS NOT NULL) AS type, arg_min(crown, n) FILTER (crown IS NOT NULL) AS crown, arg_min(dn, n) FILTER (dn IS NOT NULL) AS dn,
        coalesce(arg_max(g, n) FILTER (pair), arg_min(g, n) FILTER (g IS NOT NULL)) AS g, coalesce(arg_max(i, n) FILTER (pair), arg_min(i, n) FILTER (i IS NOT NULL)) AS i,
        coalesce(arg_max(ph, n) FILTER (pair), arg_min(h, n) FILTER (h IS NOT NULL)) AS h0, max(rank) AS rank, list(raw_text ORDER BY n) AS raws, list('set/' || base ORDER BY n) AS sources, max(n_transitions) AS n_transitions
    FROM issued GROUP BY ALL
), texts AS (
    SELECT *, CASE WHEN len(all_issues) = 0 THEN '' ELSE list_reduce(all_issues, lambda a, x: CASE WHEN contains(lower(a), lower(x)) THEN a ELSE a || '; ' || x END) END AS validation_issues,
        list_reduce(raws, lambda a, x: CASE WHEN contains(lower(a), lower(x)) THEN a ELSE a || ' | ' || x END) AS raw_text,
        list_filter(sources, lambda x, k: list_position(sources, x) = k) AS source_documents,
        coalesce(h0, CASE WHEN round_even((g - i) * 100, 0) / 100 > 0 AND round_even((g - i) * 100, 0) / 100 < 30 THEN round_even((g - i) * 100, 0) / 100 END) AS h
    FROM folded
), merged AS (
    SELECT *, 1 + (dn IS NOT NULL)::INT + (g IS NOT NULL)::INT + (i IS NOT NULL)::INT + (h IS NOT NULL)::INT + (type IS NOT NULL)::INT + (crown IS NOT NULL)::INT + (n_transitions > 0)::INT AS fields FROM texts
), finished AS (
    SELECT *, CAST(round_even(fields * 100.0 / 8, 0) AS INTEGER) AS completeness,
        CASE WHEN len(source_documents) >= 2 AND round_even(fields * 100.0 / 8, 0) >= 70 AND validation_issues = '' THEN 'wysoka'
             WHEN n_records > 1 AND validation_issues <> '' THEN 'niska' ELSE ['niska', 'średnia', 'wysoka'][rank] END AS confidence,
        array_to_string(list_filter([CASE WHEN dn IS NULL THEN 'DN studni' END, CASE WHEN g IS NULL THEN 'rzędna góry' END, CASE WHEN i IS NULL THEN 'rzędna dna' END, CASE WHEN h IS NULL THEN 'wysokość' END,
            CASE WHEN type IS NULL THEN 'typ' END, CASE WHEN crown IS NULL THEN 'zwieńczenie' END, CASE WHEN n_transitions = 0 THEN 'przejścia szczelne' END], lambda x: x IS NOT NULL), ', ') AS missing
    FROM merged
)"""
POINTS = f"""points AS (
    SELECT CAST(l_orderkey % 10 AS VARCHAR) AS doc_id, CAST(l_orderkey AS INTEGER) AS page_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ALL}) AS INTEGER) AS idx,
        l_quantity * 10 AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS value, l_linenumber AS line, l_returnflag || l_linestatus AS text
    FROM lineitem
)"""
PAGES = """pages AS (
    SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey AS INTEGER) AS page_no, o_custkey, o_orderkey, o_orderstatus,
        CASE o_orderstatus WHEN 'F' THEN 'PROFIL sieci KANALIZACJI D' || (o_custkey % 120) || ' studnia DN1200 PVC200' WHEN 'O' THEN 'PZT KD0' || (o_orderkey % 30) || ' PP DN' || o_custkey ELSE o_orderpriority END AS text,
        CASE WHEN o_orderkey % 2 = 0 THEN 'vector' ELSE 'OCR/engine' END AS engine
    FROM orders
)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def merged(spark, sf_dir):
    return merge.merged_records(adapters.records(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) AS BIGINT) AS n_lines FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) > 0")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), "text")
    return extract.page_lines(pages).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || p_size || 'mm PVC' || p_size, '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zA-Z])', '\\1 \\2', 'g')) AS t FROM part")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "part").select("p_partkey", text.extracted(F.concat("p_name", F.col("p_size").cast("string"), F.lit("mm PYC"), F.col("p_size").cast("string"))).alias("t"))


@query(f"WITH {PAGES} SELECT page_no, CASE o_orderstatus WHEN 'F' THEN 'PROFIL' WHEN 'O' THEN 'PZT' ELSE 'NIEZNANY' END AS drawing_type, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 + (o_custkey BETWEEN 10 AND 9999)::INT ELSE 0 END AS candidates FROM pages")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.classified(adapters.pages(spark, sf_dir)).select("page_no", "drawing_type", "candidates")


@query("SELECT c_custkey, 'KD' || CAST(c_custkey AS VARCHAR) || '/' || CAST(c_custkey % 30 AS VARCHAR) AS identifier, c_custkey < 100 AND c_custkey % 30 < 20 AS likely FROM customer")
def identifier_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "customer").withColumn("_i", F.concat(F.lit(" kd"), F.lpad(F.col("c_custkey").cast("string"), 3, "0"), F.lit("/0"), (F.col("c_custkey") % 30).cast("string")))
    number = F.concat(F.lit("KD"), text.identifier_number(F.concat(F.lit("00"), F.col("c_custkey").cast("string"), F.lit("/0"), (F.col("c_custkey") % 30).cast("string"))))
    return rows.select("c_custkey", number.alias("identifier"), rules.likely_identifier(number).alias("likely"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR) AS number FROM customer")
def strip_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "customer").select("c_custkey", text.identifier_number(F.concat(F.regexp_extract("c_name", "#(.*)", 1), F.lit("-00"), F.col("c_nationkey").cast("string"))).alias("number"))


@query("SELECT p_partkey, 'D' || lpad(CAST(p_size AS VARCHAR), 6, '0') || '.' || lpad(CAST(p_partkey % 30 + 1 AS VARCHAR), 6, '0') AS k6, 'D' || lpad(CAST(p_size AS VARCHAR), 5, '0') AS k5 FROM part")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 30).cast("string"))
    return adapters.table(spark, sf_dir, "part").select("p_partkey", text.sort_key(name).alias("k6"), text.sort_key(name, sub=False, width=5).alias("k5"))


@query("SELECT s_suppkey, replace(upper(trim(s_name)), ' ', '') AS key, 'WP' || s_suppkey AS inlet, upper(replace(s_name, ' ', '')) AS loose, replace(lower(s_name), ' ', '') AS folded, CASE s_suppkey % 3 WHEN 0 THEN 'PE-HD' WHEN 1 THEN 'PVC' ELSE '' END AS material FROM supplier")
def key_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when(F.col("s_suppkey") % 3 == 0, "pehd").when(F.col("s_suppkey") % 3 == 1, " Pvc ")
    return adapters.table(spark, sf_dir, "supplier").select("s_suppkey", text.key_of(F.col("s_name")).alias("key"), text.inlet_key(F.col("s_suppkey").cast("string")).alias("inlet"), text.loose(F.col("s_name")).alias("loose"), text.folded(F.col("s_name")).alias("folded"), text.material(m).alias("material"))


@query(f"WITH {PAGES} SELECT doc_id, CASE WHEN bool_or(text LIKE 'PROFIL%') THEN 'PROFIL' WHEN bool_or(text LIKE 'PZT%') THEN 'PZT' ELSE 'NIEZNANY' END AS drawing_type FROM pages GROUP BY doc_id")
def classify_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engines.detected_types(adapters.pages(spark, sf_dir))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'PZT' WHEN n_regionkey = 1 THEN 'PROFIL' END AS t, CASE n_regionkey WHEN 0 THEN 'pzt profil ' WHEN 1 THEN 'Podłużne ' ELSE '' END || n_name || '.pdf' AS base FROM nation")
def classify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(r"c:\profil/"), F.when(F.col("n_regionkey") == 0, "pzt profil ").when(F.col("n_regionkey") == 1, "Podłużne ").otherwise(""), F.col("n_name"), F.lit(".pdf"))
    return adapters.table(spark, sf_dir, "nation").select("n_nationkey", rules.drawing_type_of_name(name).alias("t"), text.basename(name).alias("base"))


@query(f"WITH {PAGES} SELECT doc_id, bool_or(o_orderstatus <> 'P') AS useful, bool_or(o_orderstatus = 'F') AND NOT bool_or(o_orderstatus IN ('F', 'O')) AS needs_ocr FROM pages GROUP BY doc_id")
def needs_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engines.needs_profile_ocr(adapters.pages(spark, sf_dir))


@query(f"WITH {PAGES} SELECT page_no, o_orderstatus <> 'P' AS useful, o_orderstatus = 'F' AS says_profile, o_orderstatus <> 'P' AS engineering FROM pages")
def useful_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engines.page_flags(adapters.pages(spark, sf_dir)).select("page_no", "useful", "says_profile", "engineering")


@query(f"WITH {PAGES}, s AS (SELECT doc_id, engine, bool_or(o_orderstatus <> 'P') AS useful FROM pages GROUP BY ALL) SELECT doc_id, coalesce(min(CASE WHEN useful AND engine = 'vector' THEN 'vector' END), min(CASE WHEN useful THEN engine END), max_by(engine, engine <> 'vector')) AS engine FROM s GROUP BY doc_id")
def source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = spark.sql("SELECT * FROM VALUES ('vector', 0), ('OCR/engine', 1) AS r(engine, engine_rank)")
    return engines.chosen_engine(adapters.pages(spark, sf_dir), ranks)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) FILTER (trim(w) <> '') AS n, max(length(w)) * 6.0::DOUBLE AS widest FROM (SELECT doc_id, unnest(string_split(l, ' ')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY 1")
def usable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.usable(adapters.words(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("w").alias("widest"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 400 BETWEEN 20 AND 300 THEN (o_orderkey % 400)::DOUBLE + 0.25 * (o_orderkey % 400 < 300)::INT END AS level, (o_orderkey % 400)::DOUBLE AS number, o_orderkey % 50 = 0 AND o_orderkey BETWEEN 800 AND 4000 AS plausible, o_custkey IN (50, 63, 75, 90, 100, 110, 125, 800) OR o_custkey BETWEEN 150 AND 799 AS pipe FROM orders")
def decimal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 400
    token = F.concat(F.lit("("), n.cast("string"), F.when(n < 300, ",25").otherwise(",00"), F.lit(")"))
    mm = F.col("o_custkey").cast("int")
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", rules.elevation(token).alias("level"), rules.number_or_zero(F.concat(n.cast("string"), F.lit(",0"))).alias("number"), rules.plausible_manhole_diameter(F.col("o_orderkey")).alias("plausible"), rules.keeps_ocr_pipe(F.lit("PVC"), mm, F.lit(True)).alias("pipe"))


@query(f"WITH {PAGES} SELECT doc_id, page_no, CASE WHEN o_orderstatus = 'F' THEN 'D' || (o_custkey % 120) ELSE 'KD' || (o_orderkey % 30) END AS identifier FROM pages WHERE (o_orderstatus = 'F' AND o_custkey % 120 < 100) OR o_orderstatus = 'O'")
def regex_extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.manholes(extract.page_lines(adapters.pages(spark, sf_dir))).select("doc_id", "page_no", "identifier")


@query(f"WITH {PAGES} SELECT page_no, CASE WHEN o_orderstatus = 'F' THEN 'kinetowa' END AS type, CASE WHEN o_orderstatus = 'F' THEN 4.5::DOUBLE END AS height_m, CASE WHEN o_orderstatus = 'F' THEN 'właz żeliwny' END AS crown, CASE WHEN o_orderstatus = 'F' THEN 1200 WHEN o_orderstatus = 'O' AND o_custkey BETWEEN 800 AND 4000 AND o_custkey % 50 = 0 THEN CAST(o_custkey AS INTEGER) END AS diameter_mm FROM pages")
def typed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.pages(spark, sf_dir).withColumn("text", F.when(F.col("text").startswith("PROFIL"), F.concat("text", F.lit(" Kinetowa wys. całk. 4,5 m, właz żeliwny, dalej"))).otherwise(F.col("text")))
    return rows.select("page_no", *[c.alias(n) for n, c in extract.described("text").items()])


@query(f"WITH {PAGES} SELECT doc_id, page_no, 'PVC' AS material, 200 AS diameter_mm, 1 AS quantity FROM pages WHERE o_orderstatus = 'F' UNION ALL SELECT doc_id, page_no, 'PP', CAST(left(CAST(o_custkey AS VARCHAR), 4) AS INTEGER), 1 FROM pages WHERE o_orderstatus = 'O' AND o_custkey BETWEEN 20 AND 9999")
def transitions_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.transitions(adapters.pages(spark, sf_dir), "text", ["doc_id", "page_no"]).withColumn("quantity", F.col("quantity").cast("int"))


@query("SELECT o_orderkey, 'D' || (o_orderkey % 99 + 1) AS identifier, 60.5::DOUBLE + o_custkey % 3 AS ground_m, 58.25::DOUBLE AS invert_m FROM orders")
def text_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "orders").select(F.lit("d").alias("doc_id"), F.col("o_orderkey").alias("page_no"), F.format_string("d %d 50,00 52,00 D%d 58,25 %d,50", F.col("o_orderkey") % 99 + 1, F.col("o_orderkey") % 99 + 1, F.col("o_custkey") % 3 + 60).alias("text"))
    return extract.text_elevations(rows).select(F.col("page_no").alias("o_orderkey"), "identifier", "ground_m", "invert_m")


@query(f"WITH {RECORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY project_id, dn, upper(type), replace(raw_text, ' ', '') ORDER BY prio, ordinal, key) AS n FROM records) SELECT project_id, dn AS diameter_mm, type AS material, raw_text FROM o WHERE n = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipes = adapters.records(spark, sf_dir).withColumn("material", F.nullif(F.col("type"), F.lit("")))
    return merge.distinct_pipes(pipes).select("project_id", "diameter_mm", "material", "raw_text")


@query(f"WITH {MERGED} SELECT project_id, key AS identifier, CAST(page AS INTEGER) AS page, type, crown, dn AS diameter_mm, raw_text, source_documents FROM finished")
def ordered_coalesce_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("project_id", "identifier", F.col("page").cast("int").alias("page"), "type", "crown", "diameter_mm", "raw_text", "source_documents")


@query(f"WITH {MERGED} SELECT project_id, key AS identifier, validation_issues, n_records FROM finished")
def conflict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("project_id", "identifier", "validation_issues", F.col("n_records").cast("long").alias("n_records"))


@query(f"WITH {MERGED} SELECT project_id, key AS identifier, g AS ground_m, i AS invert_m, h AS height_m FROM finished")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("project_id", "identifier", "ground_m", "invert_m", "height_m")


@query(f"WITH {MERGED} SELECT project_id, key AS identifier, completeness, missing FROM finished")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("project_id", "identifier", "completeness", "missing")


@query(f"WITH {MERGED} SELECT project_id, key AS identifier, confidence FROM finished")
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("project_id", "identifier", "confidence")


@query(f"WITH {RECORDS}, s AS (SELECT *, coalesce(2 * (dn IS NOT NULL)::INT, 0) + CASE WHEN g IS NOT NULL AND i IS NOT NULL AND h IS NOT NULL THEN 3 WHEN h IS NOT NULL THEN 1 ELSE 0 END + 2 * (type IS NOT NULL)::INT + (crown IS NOT NULL)::INT + 2 * (n_transitions > 0)::INT AS points FROM records) SELECT project_id, key, ordinal, CAST(points AS INTEGER) AS points, CASE WHEN points >= 5 THEN 'wysoka' WHEN points >= 2 THEN 'średnia' ELSE 'niska' END AS confidence FROM s")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = rules.confidence_points(*[F.col(c) for c in ("diameter_mm", "ground_m", "invert_m", "height_m", "type", "crown", "n_transitions")])
    return adapters.records(spark, sf_dir).select("project_id", text.key_of(F.col("identifier")).alias("key"), "ordinal", points.alias("points"), rules.confidence(points).alias("confidence"))


GATED = f"""{RECORDS}, kept AS (SELECT * REPLACE (CASE WHEN drawing_type = 'PZT' AND CAST(substr(key, 2) AS BIGINT) % 3 = 0 THEN 'SZCZEGOL' ELSE drawing_type END AS drawing_type) FROM records),
plan AS (SELECT project_id, count(DISTINCT key) AS n FROM kept WHERE drawing_type = 'PZT' GROUP BY 1),
ids AS (SELECT project_id, key, bool_or(drawing_type = 'PZT') AS on_plan, count(DISTINCT CASE WHEN drawing_type = 'PROFIL' THEN base END) AS profiles FROM kept GROUP BY ALL)"""


@query(f"WITH {GATED} SELECT project_id, key, count(*) AS n FROM kept LEFT JOIN plan USING (project_id) JOIN ids USING (project_id, key) WHERE coalesce(plan.n, 0) < 6 OR drawing_type = 'PZT' OR on_plan OR profiles >= 2 OR (dn IS NOT NULL)::INT + (g IS NOT NULL AND i IS NOT NULL)::INT + (type IS NOT NULL OR crown IS NOT NULL)::INT + (n_transitions > 0)::INT >= 2 GROUP BY ALL")
def inventory_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = adapters.records(spark, sf_dir).withColumn("drawing_type", F.expr("CASE WHEN drawing_type = 'PZT' AND cast(substr(identifier, 3) AS long) % 3 = 0 THEN 'SZCZEGOL' ELSE drawing_type END"))
    return merge.inventory_gate(rows_).groupBy("project_id", text.key_of(F.col("identifier")).alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS} SELECT project_id, key, CAST(sum(page) AS BIGINT) AS total, CAST(max(page) AS BIGINT) AS most FROM records GROUP BY ALL")
def transition_sum_vs_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = adapters.records(spark, sf_dir).select("project_id", text.key_of(F.col("identifier")).alias("key"), F.lit("pehd").alias("material"), F.lit(200).alias("diameter_mm"), F.col("page").cast("long").alias("quantity"))
    both = [merge.merged_transitions(rows_, ["project_id", "key"], how).select("project_id", "key", F.col("quantity").alias(n)) for how, n in (("sum", "total"), ("max", "most"))]
    return both[0].join(both[1], ["project_id", "key"])


@query(f"WITH {RECORDS} SELECT project_id, 'WP' || key AS identifier, ['niska', 'średnia', 'wysoka'][max(rank)] AS confidence, count(DISTINCT base) AS n_sources FROM records GROUP BY ALL")
def inlet_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged_inlets(adapters.records(spark, sf_dir)).select("project_id", "identifier", "confidence", F.size("source_documents").cast("long").alias("n_sources"))


@query(f"WITH {RECORDS}, f AS (SELECT key, drawing_type, min(prio * 1000000 + ordinal) FILTER (drawing_type <> 'SZCZEGOL' OR CAST(substr(key, 2) AS BIGINT) % 2 = 0) AS o FROM records GROUP BY ALL) SELECT key, CASE count(o) WHEN 0 THEN 'NIEZNANY' WHEN 1 THEN any_value(drawing_type) FILTER (o IS NOT NULL) ELSE 'ZESTAW: ' || string_agg(drawing_type, ' + ' ORDER BY o) FILTER (o IS NOT NULL) END AS drawing_type FROM f GROUP BY key")
def set_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = adapters.records(spark, sf_dir).withColumn("key", text.key_of(F.col("identifier")))
    unknown = (F.col("drawing_type") == "SZCZEGOL") & (F.substring("key", 2, 20).cast("long") % 2 == 1)
    return merge.set_type(rows_.withColumn("drawing_type", F.when(unknown, "NIEZNANY").otherwise(F.col("drawing_type"))), "key")


@query(f"WITH {MERGED} SELECT project_id, count(*) AS total, count(*) FILTER (completeness >= 70) AS mostly_complete, count(*) FILTER (completeness = 100) AS complete, count(*) FILTER (validation_issues <> '') AS with_issues FROM finished GROUP BY 1")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.summary(merged(spark, sf_dir), ["project_id"])


@query(f"WITH {MERGED} SELECT project_id, key AS identifier, type, dn AS diameter_mm, CASE WHEN g IS NOT NULL THEN format('{{:.2f}}', g) END AS ground, completeness || '%' AS completeness, array_to_string(source_documents, ' | ') AS sources, 'D' || lpad(substr(key, 2), 6, '0') || '.000000' AS sort_key FROM finished")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export_manholes(merged(spark, sf_dir)).select("project_id", "identifier", "type", "diameter_mm", "ground", "completeness", "sources", "sort_key")


#: Every second expected identifier is in no drawing.
EXPECTED = "SELECT concat(CASE WHEN p_partkey % 2 = 0 THEN 'D' ELSE 'X' END, p_partkey) AS id, 1000 AS dn, cast(3.0 AS DOUBLE) AS height, 'kinetowa' AS type, 'właz' AS crown FROM {0}"
COMPARED = f"""{MERGED}, expected AS ({EXPECTED.format('part')}), b AS (
    SELECT id, key IS NOT NULL AS found, coalesce(a.dn = e.dn, FALSE) AS dn_ok, coalesce(abs(a.h - e.height) <= 0.05, FALSE) AS height_ok, coalesce(a.type = e.type, FALSE) AS type_ok, coalesce(a.crown = e.crown, FALSE) AS crown_ok
    FROM expected e LEFT JOIN finished a ON a.key = e.id)"""


def _expected(spark, sf_dir):
    return adapters.table(spark, sf_dir, "part").selectExpr("concat(CASE WHEN p_partkey % 2 = 0 THEN 'D' ELSE 'X' END, p_partkey) AS id", "1000 AS dn", "3D AS height", "'kinetowa' AS type", "'właz' AS crown")


def _actual(spark, sf_dir):
    return merged(spark, sf_dir).withColumn("ordinal", F.lit(1))


@query(f"WITH {COMPARED} SELECT * FROM b")
def left_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.compared(_actual(spark, sf_dir), _expected(spark, sf_dir))


@query(f"WITH {COMPARED} SELECT key AS id, 'extra' AS side FROM finished WHERE key NOT IN (SELECT id FROM expected) UNION ALL SELECT id, 'missing' FROM b WHERE NOT found")
def anti_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e = _actual(spark, sf_dir), _expected(spark, sf_dir)
    return benchmark.extras(a, e).withColumn("side", F.lit("extra")).unionByName(benchmark.lacking(a, e).withColumn("side", F.lit("missing")))


@query(f"WITH {COMPARED}, s AS (SELECT count(*) AS total, count(*) FILTER (found) AS found, count(*) FILTER (dn_ok) AS dn, count(*) FILTER (height_ok) AS height, count(*) FILTER (type_ok) AS type, count(*) FILTER (crown_ok) AS crown FROM b) SELECT total, found, dn, height, type, crown, (SELECT count(*) FROM finished WHERE key NOT IN (SELECT id FROM expected)) AS extras, CAST(round_even(100.0 * (dn + height + type + crown) / (4 * total), 0) AS INTEGER) AS fields_percent FROM s")
def benchmark_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.score(_actual(spark, sf_dir), _expected(spark, sf_dir)).select("total", "found", "dn", "height", "type", "crown", "extras", "fields_percent")


NEAR = f"WITH {POINTS}, p AS (SELECT a.doc_id, a.page_no, a.idx, b.idx AS r_idx, 6 * abs(a.y - b.y) + abs(a.x - b.x) AS cost FROM points a JOIN points b USING (doc_id, page_no) WHERE a.idx <> b.idx AND abs(a.x - b.x) <= 120 AND abs(a.y - b.y) <= 30)"


@query(f"{NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, idx ORDER BY cost, r_idx) AS n FROM p) SELECT page_no, idx, r_idx FROM r WHERE n = 1")
def nearest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir)
    pairs = geometry.near_join(p, p, 120.0, 30.0, lx="x", ly="y", rx="x", ry="y").where("idx <> r_idx")
    return geometry.nearest(pairs, [*geometry.PAGE, "idx"], 6 * F.abs(F.col("y") - F.col("r_y")) + F.abs(F.col("x") - F.col("r_x")), ["r_idx"]).select("page_no", "idx", "r_idx")


@query(f"WITH {POINTS}, p AS (SELECT a.page_no, a.idx, count(*) AS n, sum(b.line) AS total FROM points a JOIN points b USING (doc_id, page_no) WHERE abs(a.x - b.x) <= 150 AND abs(a.y - b.y) <= 150 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 150 GROUP BY ALL) SELECT page_no, idx, n, CAST(total AS BIGINT) AS total FROM p")
def radius_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir)
    pairs = geometry.near_join(p, p, 150.0, 150.0, lx="x", ly="y", rx="x", ry="y")
    d = F.sqrt((F.col("x") - F.col("r_x")) * (F.col("x") - F.col("r_x")) + (F.col("y") - F.col("r_y")) * (F.col("y") - F.col("r_y")))
    return pairs.where(d <= 150).groupBy("page_no", "idx").agg(F.count("*").alias("n"), F.sum("r_line").cast("long").alias("total"))


@query(f"WITH {POINTS}, w AS (SELECT *, max(x) OVER g - min(x) OVER g AS width, count(*) OVER g AS n, lag(x) OVER o AS before, lead(x) OVER o AS after FROM points WINDOW g AS (PARTITION BY doc_id, page_no), o AS (PARTITION BY doc_id, page_no ORDER BY x, idx)), e AS (SELECT *, CASE WHEN n = 1 THEN greatest(140.0::DOUBLE, 0.65::DOUBLE * width) ELSE greatest(45.0::DOUBLE, 0.04::DOUBLE * width) END AS edge FROM w) SELECT page_no, idx, coalesce((before + x) / 2, x - edge) AS \"left\", coalesce((after + x) / 2, x + edge) AS \"right\" FROM e")
def neighbour_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.neighbour_midpoints(adapters.points(spark, sf_dir)).select("page_no", "idx", "left", "right")


@query(f"WITH {POINTS}, g AS (SELECT doc_id, page_no, lead(x) OVER (PARTITION BY doc_id, page_no ORDER BY x) - x AS gap FROM points), m AS (SELECT page_no, list_sort(list(gap) FILTER (gap > 1)) AS l FROM g GROUP BY ALL), t AS (SELECT page_no, coalesce(l[len(l) // 2 + 1], 80.0::DOUBLE) AS gap FROM m) SELECT page_no, gap, least(greatest(0.34::DOUBLE * gap, 16.0::DOUBLE), 55.0::DOUBLE) AS tolerance FROM t")
def gap_median_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.gap_tolerance(adapters.points(spark, sf_dir)).select("page_no", "gap", "tolerance")


@query(f"WITH {POINTS}, s AS (SELECT doc_id, page_no, abs(line - lag(line) OVER (PARTITION BY doc_id, page_no ORDER BY x, idx)) AS s FROM points) SELECT page_no, count(*) FILTER (s = 1) AS links, CAST(coalesce(sum(s), 0) AS BIGINT) AS roughness FROM s GROUP BY doc_id, page_no")
def sequential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sequential_links(adapters.points(spark, sf_dir), "line", ["x", "idx"]).select("page_no", "links", F.col("roughness").cast("long").alias("roughness"))


@query(f"WITH {POINTS}, l AS (SELECT page_no, list_sort(list(y)) AS v FROM points GROUP BY doc_id, page_no) SELECT page_no, v[len(v) // 2 + 1] AS middle FROM l")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.points(spark, sf_dir).groupBy("doc_id", "page_no").agg(rows.upper_median(F.collect_list("y")).alias("middle")).select("page_no", "middle")


@query(f"WITH {POINTS}, c AS (SELECT doc_id, page_no, line, count(*) AS n FROM points GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, abs(line - 3), line) AS k, n / sum(n) OVER (PARTITION BY doc_id, page_no) AS share FROM c) SELECT page_no, line, n, CAST(share AS DOUBLE) AS share FROM r WHERE k = 1")
def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.dominant(adapters.points(spark, sf_dir), geometry.PAGE, "line", toward=3).select("page_no", "line", "n", "share")


@query(f"""WITH {POINTS}, b AS (SELECT *, line AS band FROM points), near AS (
    SELECT a.doc_id, a.page_no, a.idx, b.band, b.value, abs(b.x - a.x) AS dx, row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.idx, b.band ORDER BY abs(b.x - a.x), b.idx) AS n
    FROM points a JOIN b USING (doc_id, page_no) WHERE abs(b.x - a.x) <= 120
), one AS (SELECT * FROM near WHERE n = 1), pairs AS (
    SELECT g.doc_id, g.page_no, g.band AS ground_band, i.band AS invert_band, count(*) AS hits, sum(g.dx + i.dx) AS misalignment
    FROM one g JOIN one i USING (doc_id, page_no, idx) WHERE g.band <> i.band AND g.value - i.value BETWEEN 0.35 AND 8 GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY hits DESC, misalignment, ground_band, invert_band) AS n FROM pairs WHERE hits >= 2)
SELECT page_no, ground_band, invert_band, hits, misalignment FROM r WHERE n = 1""")
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir)
    found = rows.band_pairs(p.withColumn("tolerance", F.lit(120.0)), p.withColumn("band", F.col("line")))
    return found.select("page_no", "ground_band", "invert_band", "hits", "misalignment")


@query(f"""WITH RECURSIVE {POINTS}, o AS (SELECT doc_id, page_no, x, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY x) AS n FROM points), c AS (
    SELECT doc_id, page_no, n, x AS mean, 1 AS size, 0 AS band FROM o WHERE n = 1
    UNION ALL
    SELECT o.doc_id, o.page_no, o.n, CASE WHEN abs(c.mean - o.x) <= 60 THEN (c.mean * c.size + o.x) / (c.size + 1) ELSE o.x END, CASE WHEN abs(c.mean - o.x) <= 60 THEN c.size + 1 ELSE 1 END, CASE WHEN abs(c.mean - o.x) <= 60 THEN c.band ELSE c.band + 1 END
    FROM c JOIN o ON o.doc_id = c.doc_id AND o.page_no = c.page_no AND o.n = c.n + 1
) SELECT doc_id, page_no, band, round(arg_max(mean, n), 6) AS mean, max(size) AS size FROM c GROUP BY doc_id, page_no, band""")
def band_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.banded(adapters.points(spark, sf_dir), "x", F.lit(60.0)).withColumn("mean", F.round("mean", 6))


TRIPLES = f"""{POINTS}, v AS (SELECT doc_id, page_no, CASE WHEN line % 3 = 0 THEN 'depth' ELSE 'level' END AS kind, line AS band, min(value) AS value FROM points GROUP BY ALL), t AS (
    SELECT g.doc_id, g.page_no, g.band AS g_band, i.band AS i_band, d.band AS d_band, abs(g.value - i.value - d.value) AS residual FROM v g JOIN v i USING (doc_id, page_no) JOIN v d USING (doc_id, page_no)
    WHERE g.kind = 'level' AND i.kind = 'level' AND d.kind = 'depth' AND g.value > i.value AND g.band <> i.band
), r AS (SELECT *, 70 - 180 * residual - 0.5 AS score, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY residual, g_band, i_band, d_band) AS n FROM t WHERE residual <= 0.28)"""


@query(f"WITH {TRIPLES} SELECT page_no, g_band, i_band, d_band, CAST(1 AS BIGINT) AS hits, round(CAST(score AS DOUBLE), 6) AS score FROM r WHERE n = 1")
def band_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir).withColumns({"kind": F.when(F.col("line") % 3 == 0, "depth").otherwise("level"), "band": F.col("line"), "dx": F.lit(1.0), "idx": F.lit(1)})
    found = rows.band_triples(p.groupBy(*geometry.PAGE, "idx", "kind", "band").agg(F.min("value").alias("value"), F.min("dx").alias("dx")))
    return found.select("page_no", "g_band", "i_band", "d_band", "hits", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {POINTS}, e AS (
    SELECT a.page_no, a.line AS anchor, a.idx AS a, b.idx AS b, 1.5 * abs(a.x - b.x) + 5 * abs(a.y - b.y) AS cost FROM points a JOIN points b USING (doc_id, page_no) WHERE a.idx < b.idx AND abs(a.x - b.x) <= 200 AND abs(a.y - b.y) <= 100
), o AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY cost, anchor, a, b) AS n FROM e WHERE cost <= 260), s AS (
    SELECT page_no, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS anchors, CAST([] AS BIGINT[]) AS numbers, FALSE AS taken, CAST(NULL AS BIGINT) AS anchor, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS cost FROM (SELECT DISTINCT page_no FROM o)
    UNION ALL
    SELECT o.page_no, o.n, CASE WHEN free THEN list_append(s.anchors, o.anchor) ELSE s.anchors END, CASE WHEN free THEN list_concat(s.numbers, [o.a, o.b]) ELSE s.numbers END, free, o.anchor, o.a, o.b, o.cost
    FROM s JOIN (SELECT * FROM o) AS o ON o.page_no = s.page_no AND o.n = s.n + 1, LATERAL (SELECT NOT list_contains(s.anchors, o.anchor) AND NOT list_contains(s.numbers, o.a) AND NOT list_contains(s.numbers, o.b) AS free)
) SELECT page_no, anchor, a, b, round(cost, 6) AS cost FROM s WHERE taken""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir)
    pairs = geometry.near_join(p, p, 200.0, 100.0, lx="x", ly="y", rx="x", ry="y").where("idx < r_idx")
    edges = pairs.select(*geometry.PAGE, F.col("line").cast("long").alias("anchor"), F.col("idx").cast("long").alias("a"), F.col("r_idx").cast("long").alias("b"), (1.5 * F.abs(F.col("x") - F.col("r_x")) + 5 * F.abs(F.col("y") - F.col("r_y"))).alias("cost"))
    return rows.greedy_matches(edges, 260.0).select("page_no", "anchor", "a", "b", F.round("cost", 6).alias("cost"))


@query(f"""WITH RECURSIVE {POINTS}, o AS (
    SELECT page_no, text, idx, x + 2 AS cx, y + 1 AS cy, row_number() OVER (PARTITION BY page_no, text ORDER BY (line <> 1), value DESC, idx) AS n FROM points
), s AS (
    SELECT page_no, text, n, idx, TRUE AS kept, [{{'x': cx, 'y': cy}}] AS l FROM o WHERE n = 1
    UNION ALL
    SELECT o.page_no, o.text, o.n, o.idx, fresh, CASE WHEN fresh THEN list_append(s.l, {{'x': o.cx, 'y': o.cy}}) ELSE s.l END
    FROM s JOIN o ON o.page_no = s.page_no AND o.text = s.text AND o.n = s.n + 1, LATERAL (SELECT len(list_filter(s.l, lambda k: abs(k.x - o.cx) <= 16 AND abs(k.y - o.cy) <= 12)) = 0 AS fresh)
) SELECT page_no, idx, text FROM s WHERE kept""")
def nms_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir).withColumns({"key": text.dedup_text(F.col("text")), "confidence": F.col("value"), "important": F.col("line") == 1})
    return rows.without_repeats(p).select("page_no", "idx", "text")


@query(f"""WITH RECURSIVE {POINTS}, o AS (SELECT page_no, idx, text, x, y, y + 1 AS middle, row_number() OVER (PARTITION BY page_no ORDER BY y, x, idx) AS n FROM points), s AS (
    SELECT page_no, n, 1 AS place, [{{'s': middle, 'n': 1, 'y': y}}] AS l, idx, text, x, y FROM o WHERE n = 1
    UNION ALL
    SELECT o.page_no, o.n, coalesce(hit, len(s.l) + 1), CASE WHEN hit IS NULL THEN list_append(s.l, {{'s': o.middle, 'n': 1, 'y': o.y}}) ELSE list_concat(list_append(s.l[:hit - 1], {{'s': s.l[hit].s + o.middle, 'n': s.l[hit].n + 1, 'y': s.l[hit].y + o.y}}), s.l[hit + 1:]) END, o.idx, o.text, o.x, o.y
    FROM s JOIN o ON o.page_no = s.page_no AND o.n = s.n + 1, LATERAL (SELECT CAST(nullif(list_position(list_transform(s.l, lambda k: abs(k.s / k.n - o.middle) <= 3), TRUE), 0) AS INTEGER) AS hit)
), lines AS (SELECT page_no, place, avg(y) AS mean, string_agg(text, ' ' ORDER BY x, y, idx) AS line FROM s GROUP BY ALL)
SELECT page_no, string_agg(line, chr(10) ORDER BY mean, place) AS text FROM lines GROUP BY page_no""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.reading_order(adapters.points(spark, sf_dir)).select("page_no", "text")


@query(f"""WITH {POINTS}, near AS (
    SELECT a.page_no, a.idx, b.idx AS place, b.value + 50 AS value, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM points a JOIN points b USING (doc_id, page_no) WHERE abs(a.x - b.x) <= 150 AND abs(a.y - b.y) <= 60
), four AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_no, idx ORDER BY distance, abs(dx), place) AS n FROM near) WHERE n <= 4), pairs AS (
    SELECT p.page_no, p.idx, greatest(p.value, q.value) AS ground_m, least(p.value, q.value) AS invert_m, row_number() OVER (PARTITION BY p.page_no, p.idx ORDER BY round(p.distance + q.distance + 2 * least(abs(p.dx - q.dx), abs(p.dy - q.dy)), 9), p.n, q.n) AS r
    FROM four p JOIN four q USING (page_no, idx) WHERE p.n < q.n AND abs(p.value - q.value) BETWEEN 0.2 AND 15
) SELECT page_no, idx, ground_m, invert_m FROM pairs WHERE r = 1""")
def top4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir)
    return geometry.local_pairs(p, p.withColumn("value", F.col("value") + 50), 150.0, 60.0).select("page_no", "idx", "ground_m", "invert_m")


@query(f"""WITH {POINTS}, a AS (SELECT * FROM points WHERE line % 3 = 1), d AS (
    SELECT p.page_no, p.idx, a.idx AS anchor_idx, abs(p.x + 2 - a.x) AS dx, abs(p.y - 1 - a.y) AS dy, sqrt((p.x + 2 - a.x) * (p.x + 2 - a.x) + (p.y - 1 - a.y) * (p.y - 1 - a.y)) AS distance FROM points p JOIN a USING (doc_id, page_no)
), o AS (SELECT x.*, (SELECT min(y.distance) FROM d y WHERE y.page_no = x.page_no AND y.idx = x.idx AND y.anchor_idx <> x.anchor_idx) AS other FROM d x)
SELECT page_no, anchor_idx, idx, round(distance, 6) AS distance FROM o WHERE dx <= 200 AND dy <= 80 AND (other IS NULL OR distance <= 1.18 * other OR distance <= 48)""")
def owner_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir)
    return geometry.owned_words(p, p.where("line % 3 = 1"), reach_x=200.0, reach_y=80.0).select("page_no", "anchor_idx", "idx", F.round("distance", 6).alias("distance"))


@query("SELECT doc_id, w[1] AS first_word, len(w) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents) WHERE len(w) > 0")
def chars_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole; those without words have no row."""
    docs = adapters.table(spark, sf_dir, "documents")
    glyphs = docs.select(F.col("doc_id"), F.lit(1).alias("page_no"), F.posexplode(F.split("text", "")).alias("idx", "char")).where("char <> ''")
    glyphs = glyphs.withColumns({"left": F.col("idx") * 5.0, "right": F.col("idx") * 5.0 + 4, "top": F.lit(10.0), "bottom": F.lit(0.0)})
    found = rows.chars_to_words(glyphs)
    return found.groupBy("doc_id").agg(F.min_by("text", "idx").alias("first_word"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT s_suppkey, 1000 + s_suppkey * 70 AS width, 900 + s_suppkey * 41 AS height FROM supplier),
x AS (SELECT DISTINCT s_suppkey, least(s, greatest(width - 1700, 0)) AS tile_x FROM p, LATERAL (SELECT unnest(range(0, width, 1520)) AS s)),
y AS (SELECT DISTINCT s_suppkey, least(s, greatest(height - 1700, 0)) AS tile_y FROM p, LATERAL (SELECT unnest(range(0, height, 1520)) AS s))
SELECT s_suppkey, tile_x, tile_y, least(1700, width) AS tile_w, least(1700, height) AS tile_h FROM p JOIN x USING (s_suppkey) JOIN y USING (s_suppkey)""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "1000 + s_suppkey * 70 AS width", "900 + s_suppkey * 41 AS height")
    return tiles.tiles(pages).select("s_suppkey", "tile_x", "tile_y", "tile_w", "tile_h")


@query(f"WITH {POINTS} SELECT page_no, idx, CASE line % 3 WHEN 0 THEN y WHEN 1 THEN 1000 - y - 2 ELSE x END AS bx, CASE line % 3 WHEN 0 THEN 800 - x - 4 WHEN 1 THEN x ELSE y END AS by_, CASE WHEN line % 3 < 2 THEN 2.0::DOUBLE ELSE 4.0::DOUBLE END AS bw FROM points")
def rotate_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("line") % 3 == 0, 90).when(F.col("line") % 3 == 1, 270).otherwise(0)
    box = tiles.rotated_back(turned, *[F.col(c) for c in "xywh"], F.lit(1000.0), F.lit(800.0))
    return adapters.points(spark, sf_dir).select("page_no", "idx", box.alias("b")).select("page_no", "idx", F.col("b.x").alias("bx"), F.col("b.y").alias("by_"), F.col("b.w").alias("bw"))


@query("SELECT doc_id, upper(sha256(text)) AS hash, min(doc_id) OVER (PARTITION BY text) % 6 = 0 AS hit FROM documents")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, copies too, in a cache of all contents: of another engine, an old version with broken JSON, or to be hit."""
    docs = adapters.table(spark, sf_dir, "documents")
    first = F.col("first")
    body = F.when(first % 2 == 0, F.lit('{"version": "1", "pages": [{"number": 1, "text": "a", "items": []}]}')).otherwise(F.lit('{"version": "0", "pages": []'))
    known = docs.groupBy(cache.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first"))
    known = known.select(F.when(first % 3 == 0, "engine").otherwise("another").alias("identity"), "hash", body.alias("body"))
    return cache.lookup(docs.select("doc_id", F.col("text").alias("content")), known, "engine", "1").select("doc_id", "hash", F.col("document").isNotNull().alias("hit"))


@query("SELECT event_id, CAST(user_id % 9 AS INTEGER) AS number, event_type AS text, CAST(event_id % 3 AS INTEGER) AS items, CASE WHEN event_id % 3 > 0 THEN round(value, 4) END AS x FROM events")
def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a cached document of one page, written as JSON and read again."""
    item = F.struct(F.lit("w").alias("text"), F.round("value", 4).alias("x"), *[F.lit(0.0).alias(c) for c in "ywh"])
    page = F.struct((F.col("user_id") % 9).cast("int").alias("number"), F.col("event_type").alias("text"), F.array_repeat(item, (F.col("event_id") % 3).cast("int")).alias("items"))
    written = adapters.table(spark, sf_dir, "events").select("event_id", cache.entry(F.struct(F.lit("1").alias("version"), F.array(page).alias("pages"))).alias("body"))
    first = F.from_json("body", cache.DOCUMENT)["pages"][0]
    return written.select("event_id", first["number"].alias("number"), first["text"].alias("text"), F.size(first["items"]).alias("items"), F.try_element_at(first["items"], F.lit(1))["x"].alias("x"))


@query("SELECT p_partkey, CASE WHEN p_size > 26 THEN chr(CAST(64 + (p_size - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (p_size - 1) % 26 AS INTEGER)) || p_partkey AS address FROM part")
def cell_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "part").select("p_partkey", text.cell_address(F.col("p_size"), F.col("p_partkey")).alias("address"))


NODES = "WITH k AS (SELECT unnest([1, 2, 3, 4]) AS k), n AS (SELECT CAST(c_custkey AS INTEGER) AS page_no, k, 60 + c_custkey % 5 + (5 - k) * 0.25::DOUBLE AS g, 2 + c_custkey % 3 * 0.25::DOUBLE AS h, c_custkey FROM customer, k)"


@query(f"{NODES} SELECT page_no, 'D' || k AS identifier, g AS ground_m, g - h AS invert_m, h AS height_m, CASE WHEN c_custkey % 2 = 0 THEN 1200 END AS diameter_mm, 3 AS evidence FROM n")
def profile_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = adapters.drawn_words(spark, sf_dir)
    anchors = geometry.exact_labels(words, profile=True)
    texts = words.select(*geometry.PAGE, F.lit("PROFIL").alias("text")).distinct()
    return profile.profile_nodes(anchors, words, texts).select("page_no", "identifier", "ground_m", "invert_m", "height_m", "diameter_mm", "evidence")


@query(f"{NODES} SELECT page_no, 'D' || k AS identifier FROM n UNION ALL SELECT DISTINCT page_no, 'KD' || (c_custkey % 90 + 1) FROM n")
def spatial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = adapters.drawn_words(spark, sf_dir)
    return geometry.exact_labels(words, profile=False).unionByName(geometry.split_labels(words)).select("page_no", "identifier")


@query("SELECT CAST(c_custkey AS INTEGER) AS page_no, 'PVC' AS material, 200 AS diameter_mm, 1 AS quantity, 'WP' || (c_custkey % 50) AS inlet, 126.47::DOUBLE AS stitched FROM customer")
def spatial_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = adapters.drawn_words(spark, sf_dir)
    pipes = geometry.local_materials(words).select("page_no", "material", "diameter_mm", F.col("quantity").cast("int").alias("quantity"))
    inlets = geometry.word_inlets(words).select("page_no", F.col("identifier").alias("inlet"))
    whole = geometry.stitched_words(words).where("x = 4800").select("page_no", rules.elevation(F.col("text")).alias("stitched"))
    return pipes.join(inlets, "page_no").join(whole, "page_no")


@query(f"{NODES} SELECT page_no, 'D' || k AS identifier, 4 + 5 * (c_custkey % 2 = 0)::INT AS score FROM n")
def evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = adapters.drawn_words(spark, sf_dir)
    return geometry.evidence(words, geometry.exact_labels(words, profile=True)).select("page_no", "identifier", "score")


@query(f"WITH {POINTS} SELECT page_no, count(*) AS kept, CAST(sum(idx) AS BIGINT) AS which FROM points WHERE line % 4 <> 0 AND idx % 3 <> 0 GROUP BY page_no")
def usable_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir)
    empty = lambda c: F.when(F.col("idx") % 3 == 0, 0.0).otherwise(F.col(c))
    p = p.withColumns({"text": F.when(F.col("line") % 4 == 0, " ").otherwise(F.col("text")), **{c: empty(c) for c in "xywh"}})
    return geometry.usable(p).groupBy("page_no").agg(F.count("*").alias("kept"), F.sum("idx").cast("long").alias("which"))
