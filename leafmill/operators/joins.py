"""Joins beyond equality, without cross joins or unbounded groups: as-of, interval and band joins by bucketed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: list[str], bucket: str = "1 day") -> DataFrame:
    """left with the columns of the last row of right at or before its time; nulls where there is none.

    Both sides are put in one order per (key, bucket). Rows of a bucket look back inside it; what a bucket starts with is the last row of
    an earlier bucket, found in a table with one row per bucket. A hot key is thus spread over its buckets. Ties of right go to the row
    with the largest taken values.
    """
    t = lambda c: F.window(F.col(c), bucket)["start"]
    r = right.filter(F.col(right_time).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.struct(*take).alias("_v"))
    r = r.groupBy("_k", "_t").agg(F.max("_v").alias("_v")).withColumn("_b", t("_t"))
    lasts = r.groupBy("_k", "_b").agg(F.max_by("_v", "_t").alias("_last"), F.max("_t").alias("_last_t"))
    l = left.withColumn("_k", F.col(key)).withColumn("_b", t(left_time)).withColumn("_row", F.struct(*left.columns))  # noqa: E741
    # Buckets that hold only left rows must also know what came before them.
    buckets = l.select("_k", "_b").distinct().join(lasts, ["_k", "_b"], "full_outer")
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select("_k", "_b", "_carry")
    both = l.select("_k", "_b", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), "_row", F.lit(None).cast(r.schema["_v"].dataType).alias("_v"))
    both = both.unionByName(r.select("_k", "_b", "_t", F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "_v"))
    inside = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_here", F.last("_v", ignorenulls=True).over(inside)).filter("_side = 1")
    out = seen.join(carried, ["_k", "_b"], "left").withColumn("_got", F.coalesce("_here", "_carry"))
    return out.select("_row.*", *(F.col(f"_got.{c}").alias(c) for c in take))


def intervals(points: DataFrame, spans: DataFrame, key: str, at: Column, begin: Column, end: Column, width: int) -> DataFrame:
    """Pairs of points and spans of one key with begin <= at < end, all whole numbers.

    Spans are laid on every bucket of `width` they touch, points on their own; the pair is tested once, in the point's bucket.
    """
    p = points.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / width))
    s = spans.withColumn("_begin", begin).withColumn("_end", end).filter("_begin < _end")
    s = s.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_begin") / width), F.floor((F.col("_end") - 1) / width))))
    return p.join(s, [key, "_bucket"]).filter((F.col("_at") >= F.col("_begin")) & (F.col("_at") < F.col("_end"))).drop("_at", "_bucket", "_begin", "_end")


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """key, session_start, session_end, events: runs of events with less than the gap between them; session windows merge partial sums."""
    grouped = events.groupBy(key, F.session_window(time, f"{gap_seconds} seconds").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
