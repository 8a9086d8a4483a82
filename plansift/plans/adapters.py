"""Ordinary tables in the shapes of the operators' inputs, so that these can be run and checked over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansift.sources.shared import spread, table

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as records of drawings: a part is an object, its rows are its mentions in the order of all columns."""
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*LINEITEM)).cast("long"))
    return rows.selectExpr(
        "cast(l_partkey % 7 AS string) AS project_id",
        "cast(l_orderkey AS string) AS doc_id",
        "ordinal",
        "CASE l_returnflag WHEN 'A' THEN 'PZT' WHEN 'N' THEN 'PROFIL' ELSE 'SZCZEGOL' END AS drawing_type",
        "concat('set/', l_returnflag, l_suppkey % 5, '.pdf') AS source_document",
        "l_linenumber - 1 AS page",
        "concat(l_linestatus, ' ', l_linenumber) AS raw_text",
        "concat('d ', l_partkey) AS identifier",
        "CASE l_linenumber % 3 WHEN 1 THEN '' WHEN 2 THEN 'kinetowa' END AS type",
        "CASE WHEN l_orderkey % 2 = 0 THEN cast(1000 + 200 * (l_suppkey % 2) AS int) END AS diameter_mm",
        "CASE WHEN l_orderkey % 3 <> 0 THEN 100 + l_linenumber / 4D END AS ground_m",
        "CASE WHEN l_orderkey % 5 <> 0 THEN 97 + (l_suppkey % 4) / 4D END AS invert_m",
        "CASE WHEN l_linenumber % 4 = 0 THEN 3D END AS height_m",
        "CASE WHEN l_suppkey % 3 = 0 THEN 'właz' END AS crown",
        "CASE l_linenumber % 3 WHEN 0 THEN 'niska' WHEN 1 THEN 'średnia' ELSE 'wysoka' END AS confidence",
        "'' AS validation_issues",
        "cast(l_linenumber % 3 AS int) AS n_transitions",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points of a page (an order): x, y, a box of 4 by 2, and a value."""
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINEITEM)))
    return rows.selectExpr("cast(l_orderkey % 10 AS string) AS doc_id", "cast(l_orderkey AS int) AS page_no", "idx", "l_quantity * 10 AS x", "l_extendedprice / 1000 AS y", "4D AS w", "2D AS h", "l_discount * 100 AS value", "l_linenumber AS line", "concat(l_returnflag, l_linestatus) AS text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as word boxes: 40 apart on lines 14 apart."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "text"))
    return rows.selectExpr("doc_id", "1 AS page_no", "line_no * 100000 + word_no AS idx", "text", "word_no * 40D AS x", "line_no * 14D AS y", "length(text) * 6D AS w", "10D AS h")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as pages of drawings' text: a customer's orders are one document."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey AS string) AS doc_id",
        "cast(o_orderkey AS int) AS page_no",
        "CASE o_orderstatus WHEN 'F' THEN concat('PROFIL sieci KANALIZACJI D', o_custkey % 120, ' studnia DN1200 PVC200') WHEN 'O' THEN concat('PZT KD0', o_orderkey % 30, ' PP DN', o_custkey) ELSE o_orderpriority END AS text",
        "cast(NULL AS string) AS raw_text",
        "cast(NULL AS string) AS ordered_text",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'vector' ELSE 'OCR/engine' END AS engine",
    )


def drawn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as profile drawings: four nodes in columns with ground, invert and (every second page) diameter, and some loose labels."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey"))
    box = lambda text, x, y, w="28D", h="10D": f"named_struct('text', {text}, 'x', {x}, 'y', {y}, 'w', {w}, 'h', {h})"
    ground = "(60 + c_custkey % 5 + (5 - k) * 0.25D)"
    level = lambda v: f"replace(format_string('%.2f', {v}), '.', ',')"
    columns = [box("concat('D', k)", "95D + 100 * k", "500D", "10D"), box(level(ground), "90D + 100 * k", "400D"), box(level(f"({ground} - 2 - c_custkey % 3 * 0.25D)"), "90D + 100 * k", "350D"), box("CASE WHEN c_custkey % 2 = 0 THEN 'DN1200' ELSE 'x' END", "90D + 100 * k", "250D")]
    loose = [box("'KD'", "1800D", "500D", "15D", "20D"), box("concat('0', c_custkey % 90 + 1)", "1815D", "498D", "20D", "14D"), box("'PVC'", "2800D", "800D", "20D"), box("'DN200'", "2825D", "800D", "20D"), box("concat('wp', c_custkey % 50)", "3800D", "800D", "20D"), box("'1'", "4800D", "900D", "4D", "8D"), box("'26,47'", "4806D", "900D", "20D", "8D")]
    rows = c.selectExpr("c_custkey", f"concat(flatten(transform(sequence(1, 4), k -> array({', '.join(columns)}))), array({', '.join(loose)})) AS b")
    rows = rows.select("c_custkey", F.posexplode("b").alias("idx", "b"))
    return rows.selectExpr("cast(c_custkey % 10 AS string) AS doc_id", "cast(c_custkey AS int) AS page_no", "idx", "b.text", "b.x", "b.y", "b.w", "b.h")


def noted_pages(spark: SparkSession, sf_dir: str, *texts: str, engine: str = "vector") -> DataFrame:
    """orders as pages whose text is one of the given SQL expressions of the order's columns, in turn by its key; with n, its number."""
    pick = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts))
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey AS string) AS doc_id", "cast(o_orderkey AS int) AS page_no", f"CASE o_orderkey % {len(texts)} {pick} END AS text", "cast(NULL AS string) AS raw_text", "cast(NULL AS string) AS ordered_text", f"'{engine}' AS engine",
    )


def sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """customer as whole drawings, in turn by key: a plan with a split and a whole label, a profile with depths, one without, and a page
    read by OCR with a label and a lone number. Pages and words."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey AS c", "cast(c_custkey AS string) AS doc_id", "cast(c_custkey AS int) AS page_no", "c_custkey % 4 AS kind", "100 + c_custkey % 30 AS g")
    names = "CASE kind WHEN 0 THEN '[[DRAWING:PZT]]' WHEN 3 THEN 'S95' ELSE '[[DRAWING:PROFIL]] RZĘDNE DNA PRZEWODU' END"
    pages_ = c.selectExpr("doc_id", "page_no", f"{names} AS text", "cast(NULL AS string) AS raw_text", "cast(NULL AS string) AS ordered_text", "CASE kind WHEN 3 THEN 'OCR/engine' ELSE 'vector' END AS engine")
    box = lambda text, x, y, w="28D", h="10D": f"named_struct('text', {text}, 'x', {x}, 'y', {y}, 'w', {w}, 'h', {h})"
    level = lambda v: f"replace(format_string('%.2f', cast({v} AS double)), '.', ',')"
    plan = [box("'D'", "100D", "100D", "8D"), box("cast(c % 9 + 1 AS string)", "109D", "100D", "12D"), box(level("g + 0.55"), "92D", "126D", "44D"), box(level("g - 1.5"), "92D", "146D", "44D"),
            box("concat('KD', c % 8 + 1)", "600D", "100D", "24D"), box(level("g + 0.25"), "590D", "126D", "44D"), box(level("g - 3"), "590D", "146D", "44D"), box("'PVC160'", "600D", "170D", "40D")]
    column = lambda name: [box(f"concat('{name}', k)", "95D + 100 * k", "500D", "10D"), box(level("g - 0.25 * k"), "90D + 100 * k", "320D"), box(level("g - 0.25 * k - 1 - 0.25 * (k % 3)"), "90D + 100 * k", "270D")]
    deep = [*column("KD"), box(level("1 + 0.25 * (k % 3)"), "90D + 100 * k", "200D"), box("'DN1200'", "90D + 100 * k", "150D")]
    noise = [box("concat('S', 30 + c % 50)", "1300D", "900D", "20D"), box("'25,50'", "1500D", "40D")]
    read = [box("concat('S0', c % 8 + 1)", "100D", "100D", "20D"), box(level("g + 0.85"), "105D", "120D", "30D"), box(level("g - 0.5"), "105D", "138D", "30D"), box("'S95'", "900D", "900D", "20D")]
    columns = lambda parts: f"flatten(transform(sequence(1, 4), k -> array({', '.join(parts)})))"
    boxes = f"CASE kind WHEN 0 THEN array({', '.join(plan)}) WHEN 1 THEN {columns(deep)} WHEN 2 THEN concat({columns(column('D'))}, array({', '.join(noise)})) ELSE array({', '.join(read)}) END"
    words_ = c.selectExpr("doc_id", "page_no", f"{boxes} AS b").select("doc_id", "page_no", F.posexplode("b").alias("idx", "b"))
    return pages_, words_.selectExpr("doc_id", "page_no", "idx", "b.text", "b.x", "b.y", "b.w", "b.h")


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as pages of single characters: names with blanks between the words, or, for every second part, with gaps alone."""
    rows = table(spark, sf_dir, "part").selectExpr("cast(p_partkey % 10 AS string) AS doc_id", "cast(p_partkey AS int) AS page_no", "concat_ws(' ', p_name, p_brand, p_type) AS t")
    rows = rows.select("doc_id", "page_no", F.posexplode(F.split("t", "")).alias("idx", "char")).where("char <> ''")
    rows = rows.selectExpr("*", "cast(idx * 6 AS int) AS left", "cast(idx * 6 + 5 AS int) AS right", "cast(100 + idx % 2 AS int) AS top", "cast(110 + idx % 2 AS int) AS bottom")
    return rows.where("page_no % 2 = 0 OR char <> ' '")
