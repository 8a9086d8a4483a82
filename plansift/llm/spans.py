"""Matches of patterns with their places, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,found:string>"


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df plus a column for each name: array<struct<start, end, found>> of the pattern's leftmost matches, code points, end exclusive.

    patterns: name -> (pattern that never matches nothing, condition without which a text has no match; cheap). The texts between
    matches come from a second pass, over texts with matches alone, and their lengths give the places. Three projections, so
    that no pass is run twice.
    """
    none = F.array().cast("array<string>")
    df = df.select("*", *[F.when(needs, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_m_{n}") for n, (p, needs) in patterns.items()])
    df = df.select("*", *[F.when(F.size(f"_m_{n}") > 0, F.split(text, p, -1)).alias(f"_g_{n}") for n, (p, _) in patterns.items()])
    return df.select("*", *[_places(F.col(f"_m_{n}"), F.col(f"_g_{n}")).alias(n) for n in patterns]).drop(*[f"_{k}_{n}" for k in "mg" for n in patterns])


def _places(found: Column, gaps: Column) -> Column:
    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["found"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found")))).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda f, g: F.struct(f.alias("found"), g.alias("gap")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, first, step)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def before(text: str, span: Column, n: int) -> Column:
    """The n code points before a span, or as many as there are."""
    at = F.greatest(span["start"] - n, F.lit(0))
    return F.substring(F.col(text), at + 1, span["start"] - at)


def after(text: str, span: Column, n: int) -> Column:
    return F.substring(F.col(text), span["end"] + 1, F.lit(n))


def written(spans: Column, kind) -> Column:
    """kind:start:end of each span, comma-joined. kind: from a span to its name."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))))
