"""Parsing of model replies with string and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = "struct<window_index:int,is_anomaly:string,confidence:string,reasoning:string,evidence_cited:array<string>>"
WINDOW_SCHEMA = f"results array<{_ITEM}>, anomalies array<struct<start:int,end:int,confidence:string>>"
RANGE_SCHEMA = "anomalies array<struct<start:int,end:int>>"


def candidates(reply: Column) -> list[Column]:
    """The texts that may be the JSON: all of it, a fenced block, from the first brace to the last."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return [reply, fenced, braced]


def parse_windows(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``verdicts`` (validated window verdicts) and ``parse_error``.

    A reply in the form of ranges becomes a verdict on window 0 with the
    greatest confidence; an item without one counts as 0.5.
    """
    def usable(text: Column) -> Column:
        parsed = F.from_json(text, WINDOW_SCHEMA, {"mode": "PERMISSIVE"})
        return F.when(parsed["results"].isNotNull() | parsed["anomalies"].isNotNull(), parsed)

    parsed = F.coalesce(*[usable(c) for c in candidates(F.col(reply))])
    number = lambda c, other: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(other))))
    truth = lambda c: F.coalesce(F.lower(c).isin("true", "1", "yes"), F.lit(False))
    item = lambda x: F.struct(
        F.coalesce(x["window_index"], F.lit(0)).alias("window_index"), truth(x["is_anomaly"]).alias("is_anomaly"), number(x["confidence"], 0.0).alias("confidence"),
        F.coalesce(x["reasoning"], F.lit("")).alias("reasoning"), F.coalesce(x["evidence_cited"], F.array().cast("array<string>")).alias("evidence_cited"),
    )
    whole = F.array(F.struct(
        F.lit(0).alias("window_index"), (F.size(F.col("p.anomalies")) > 0).alias("is_anomaly"),
        F.coalesce(F.array_max(F.transform("p.anomalies", lambda a: number(a["confidence"], 0.5))), F.lit(0.0)).alias("confidence"), F.lit("").alias("reasoning"), F.array().cast("array<string>").alias("evidence_cited"),
    ))
    out = replies.withColumn("p", parsed)
    verdicts = F.when(F.col("p.results").isNotNull(), F.transform("p.results", item)).when(F.col("p.anomalies").isNotNull(), whole)
    empty = F.array().cast("array<struct<window_index:int,is_anomaly:boolean,confidence:double,reasoning:string,evidence_cited:array<string>>>")
    return out.withColumns({"verdicts": F.coalesce(verdicts, empty), "parse_error": F.col("p").isNull()}).drop("p")


def confidences(windows: DataFrame, parsed: DataFrame) -> DataFrame:
    """The confidence that each window is anomalous; 0 where the reply says nothing, or that it is normal."""
    v = parsed.select("series_id", F.explode("verdicts").alias("v")).select("series_id", F.col("v.window_index").alias("win"), F.when(F.col("v.is_anomaly"), F.col("v.confidence")).otherwise(0.0).alias("c"))
    best = v.groupBy("series_id", "win").agg(F.max("c").alias("c"))
    return windows.select("series_id", "win").join(best, ["series_id", "win"], "left").select("series_id", "win", F.coalesce("c", F.lit(0.0)).alias("confidence"))


def parse_ranges(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``ranges``, half-open: an empty range gets one point, one that ends before it begins is dropped."""
    text = F.col(reply)
    bare = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    tries = [F.from_json(c, RANGE_SCHEMA)["anomalies"] for c in candidates(text)] + [F.from_json(c, "array<struct<start:int,end:int>>") for c in (text, bare)]
    whole = lambda a: F.when(F.size(F.filter(a, lambda r: r["start"].isNotNull() & r["end"].isNotNull())) == F.size(a), a)
    found = F.coalesce(*[whole(t) for t in tries], F.array().cast("array<struct<start:int,end:int>>"))
    kept = F.filter(found, lambda r: r["start"] <= r["end"])
    shaped = F.transform(kept, lambda r: F.struct(r["start"].alias("start"), F.when(r["start"] == r["end"], r["end"] + 1).otherwise(r["end"]).alias("end")))
    return replies.withColumn("ranges", shaped)


def range_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("series_id", F.explode("ranges").alias("r")).select("series_id", F.col("r.start").alias("seg_start"), F.col("r.end").alias("seg_end"))
