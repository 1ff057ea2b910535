"""Problem 8: mixing sources to target weights along a time-varying curriculum.

Sizes are tokens of the public vocabulary. The mix is as large as the shares allow exactly: the smallest, over the sources that
have tokens, of max_repeats * tokens / share; sources without tokens give their share to the others in proportion (both shares are
reported). Each source has a piecewise linear weight schedule over training time 0..1. Its integral is the source's cumulative
demand; a record at cumulative token c of its source gets the time at which the demand reaches c, and the mix is range-sorted by it.

A source is read in epochs, each in another pseudo-random order of its records, and no record comes twice in an epoch, so it
is used max_repeats times at most. Running token sums are made in two levels, over the buckets of an order key and within them, so a
source may hold any part of the rows.

Defined results: records without tokens (null, empty) are never used; a null source is no target; a null, negative or zero share or
cap counts as none; target rows of one source are added up; ties of the order key are broken by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from leafmill.session import materialize

SEED = 20
#: How far the default curriculum tilts: weights move linearly from share * (1 - g) to share * (1 + g), |g| <= RAMP, larger sources first.
RAMP = 0.5
#: Rows of one source and epoch that a bucket holds on average.
BUCKET_ROWS = 20_000


def sized(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of the records of target sources, written once. The target table is small and fixed; its size decides the join."""
    rows = documents.filter(F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "source", "text")
    rows = rows.join(targets.filter(F.col("target_share") > 0).select("source").distinct(), "source", "left_semi")
    return materialize(token_counts(rows, "doc_id", "source", folder=folder, name=name).filter("n_tokens > 0"), "sizes")


def demands(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: share, max_repeats, records, available tokens, mix_share (renormalised) and demand in tokens."""
    goals = (
        targets.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull())
        .groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("available_tokens"))
    rows = goals.join(have, "source", "left").na.fill(0, ["records", "available_tokens"])
    usable = F.when(F.col("available_tokens") > 0, F.col("target_share"))
    all_sources = Window.partitionBy(F.lit(1))  # one row per target source: a fixed small table
    rows = rows.withColumn("mix_share", F.coalesce(usable / F.sum(usable).over(all_sources), F.lit(0.0)))
    cap = F.when(F.col("mix_share") > 0, F.col("max_repeats") * F.col("available_tokens") / F.col("mix_share"))
    return rows.withColumn("mix_tokens", F.min(cap).over(all_sources)).withColumn("demand", F.col("mix_share") * F.col("mix_tokens"))


def default_schedule(demand: DataFrame, ramp: float = RAMP) -> DataFrame:
    """source, knots array<struct<t,w>>: linear from share * (1 - g) to share * (1 + g); the weights add up to 1 at every time."""
    everything = Window.partitionBy(F.lit(1))
    x = -F.col("mix_share")  # larger sources first
    rows = demand.withColumn("_x", x - F.sum(F.col("mix_share") * x).over(everything))
    rows = rows.withColumn("_g", F.coalesce(ramp * F.col("_x") / F.nullif(F.max(F.abs("_x")).over(everything), F.lit(0.0)), F.lit(0.0)))
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), w.alias("w"))
    return rows.select("source", F.array(knot(0.0, F.col("mix_share") * (1 - F.col("_g"))), knot(1.0, F.col("mix_share") * (1 + F.col("_g")))).alias("knots"))


def _segments(knots: Column) -> Column:
    """Integrated schedule: per segment its start, length, weights at both ends and the integral before it."""
    parts = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.get(knots, i - 1)["t"].alias("t0"), (F.get(knots, i)["t"] - F.get(knots, i - 1)["t"]).alias("dt"),
            F.get(knots, i - 1)["w"].alias("w0"), F.get(knots, i)["w"].alias("w1"),
        ),
    )
    zero = F.array().cast("array<struct<t0:double,dt:double,w0:double,w1:double,before:double>>")

    def add(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        before = F.coalesce(last["before"] + last["dt"] * (last["w0"] + last["w1"]) / 2, F.lit(0.0))
        return F.concat(acc, F.array(F.struct(s["t0"].alias("t0"), s["dt"].alias("dt"), s["w0"].alias("w0"), s["w1"].alias("w1"), before.alias("before"))))

    return F.aggregate(parts, zero, add)


def time_of(segments: Column, part: Column) -> Column:
    """Time at which the schedule's integral reaches the given part (0..1) of its whole: the quadratic of the segment, solved."""
    whole = F.element_at(segments, -1)
    area = part * (whole["before"] + whole["dt"] * (whole["w0"] + whole["w1"]) / 2)
    s = F.element_at(F.filter(segments, lambda x: (x["before"] <= area) | (x["before"] == 0)), -1)
    a, b, c = (s["w1"] - s["w0"]) / (2 * s["dt"]), s["w0"], area - s["before"]
    root = F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * a * c))
    # The form that stays exact as the slope nears 0.
    return s["t0"] + F.least(s["dt"], F.coalesce(2 * c / F.nullif(b + root, F.lit(0.0)), F.lit(0.0)))


def mix(sizes: DataFrame, targets: DataFrame, schedule: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, copy_no (from 1), n_tokens, position (0..1), range-sorted by position."""
    demand = materialize(demands(sizes, targets), "demand")
    plan = demand.filter("demand > 0").join(default_schedule(demand) if schedule is None else schedule, "source")
    plan = plan.withColumn("segments", _segments(F.col("knots"))).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("records") / BUCKET_ROWS)).cast("long"))
    epochs = F.least(F.col("max_repeats").cast("long"), F.ceil(F.col("demand") / F.col("available_tokens") - 1e-9))
    rows = sizes.join(plan.select("source", "demand", "available_tokens", "buckets", epochs.alias("epochs")), "source")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("copy_no"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "copy_no", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("key", 20), F.col("buckets")))
    heads = rows.groupBy("source", "copy_no", "bucket").agg(F.sum("n_tokens").alias("_sum"), F.first("available_tokens").alias("available_tokens"))
    # Rows here are buckets, thousands of records each.
    over = Window.partitionBy("source", "copy_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("source", "copy_no", "bucket", (F.coalesce(F.sum("_sum").over(over), F.lit(0)) + (F.col("copy_no") - 1) * F.col("available_tokens")).alias("offset"))
    inside = Window.partitionBy("source", "copy_no", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(heads, ["source", "copy_no", "bucket"])
    middle = F.col("offset") + F.col("_inner") + F.col("n_tokens") / 2
    placed = placed.withColumn("_part", middle / F.col("demand")).filter("_part < 1").join(plan.select("source", "segments"), "source")
    placed = placed.withColumn("position", time_of(F.col("segments"), F.col("_part")))
    return placed.select("doc_id", "source", "copy_no", "n_tokens", "position").orderBy("position", "source", "doc_id", "copy_no")


def report(sizes: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per target source: target and actual share, tokens used and available, records used and the most copies of one record."""
    used = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy_no").cast("int").alias("most_copies")
    )
    rows = demands(sizes, targets).join(used, "source", "left").na.fill(0, ["tokens", "uses", "most_copies"])
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))
    return rows.select("source", "target_share", F.round("mix_share", 6).alias("mix_share"), F.round(share, 6).alias("actual_share"), "tokens", "available_tokens", "records", "uses", "max_repeats", "most_copies")
