"""Pages that arrive as files, classified as they come. The batch operators are the same; only reading and writing differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plansift import model
from plansift.functions import rules
from plansift.operators import extract


def pages(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(model.PAGES).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def classified(stream: DataFrame) -> DataFrame:
    """Each page with its own drawing type and number of candidates; stateless."""
    t = F.concat_ws("\n", "text", "raw_text", "ordered_text")
    return stream.select("doc_id", "page_no", rules.drawing_type(t).alias("drawing_type"), F.regexp_count(t, F.lit(rules.CANDIDATE)).alias("candidates"))


def write_identifiers(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's identifiers to Parquet; a batch run again after a failure replaces its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        extract.manholes(extract.page_lines(rows)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
