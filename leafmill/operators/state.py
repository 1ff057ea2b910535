"""Incremental state as tables: upserts, staleness by hashes, error resolution, summaries. Every function maps tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: each column's last value that is not null, as COALESCE(new, old) over the events leaves it.

    max_by with a filter combines on the map side, so a key with many events costs one row per task and no window.
    """
    by = F.struct(*order)
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in rest), F.count(F.lit(1)).alias("versions"))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer join of two tables of one schema, new values before old ones."""
    rest = [c for c in old.columns if c != key]
    o = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in rest))
    return o.join(new, key, "full_outer").select(key, *(F.coalesce(F.col(c), F.col(f"_o_{c}")).alias(c) for c in rest))


def stale(artifacts: DataFrame, manifests: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """Artifacts to make again: no manifest, or one with another hash. A null hash never counts as the same."""
    return artifacts.join(manifests.select(*keys, hash_col).distinct(), [*keys, hash_col], "left_anti")


def stage_done(stages: DataFrame, wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Stages that are completed with the wanted hash and whose outputs all exist.

    stages: stage, status, input_hash; wanted: stage, input_hash, output; files: output.
    """
    missing = wanted.join(files.select("output").distinct(), "output", "left_anti").select("stage").distinct()
    good = stages.filter("status = 'completed'").join(wanted.select("stage", "input_hash").distinct(), ["stage", "input_hash"], "left_semi")
    return good.join(missing, "stage", "left_anti").select("stage").distinct()


def error_status(errors: DataFrame, stages: DataFrame) -> DataFrame:
    """errors with active: not followed by a completion of their stage. errors: stage, created_at; stages: stage, finished_at."""
    done = stages.groupBy("stage").agg(F.max("finished_at").alias("_done"))
    return errors.join(done, "stage", "left").withColumn("active", F.col("_done").isNull() | (F.col("created_at") > F.col("_done"))).drop("_done")


def unchanged_since(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """keys, versions, changed: whether the last version of a key differs from the first, by hash."""
    h = F.sha2(value, 256)
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("versions"), F.min_by(h, F.struct(*order)).alias("_first"), F.max_by(h, F.struct(*order)).alias("_last"))
    return out.select(*keys, "versions", (~F.col("_first").eqNullSafe(F.col("_last"))).alias("changed"))


def retry_numbers(attempts: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """attempts with attempt_no and given_up: failed for the last permitted time. Attempts of one key are few by contract (most)."""
    numbered = attempts.withColumn("attempt_no", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return numbered.withColumn("given_up", (F.col("attempt_no") > most) & (F.col("status") == "failed"))


def summary(rows: DataFrame, key: str, states: list[str], at: str) -> DataFrame:
    """key, total, a count per state, last_at."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in states), F.max(at).alias("last_at"))


def listed(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that equal every value that is given; a None asks nothing. The filters reach the scan."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def with_copies(rows: DataFrame, content: str) -> DataFrame:
    """rows with same_content: how many have the same content hash, as a partial aggregate joined back; a null hash is content of its own kind."""
    n = rows.groupBy(F.col(content).alias("_c")).agg(F.count(F.lit(1)).alias("same_content"))
    return rows.join(n, F.col(content).eqNullSafe(F.col("_c"))).drop("_c")


def chained_hash(upstream: Column, *settings: Column) -> Column:
    """SHA-256 of the upstream hash and the settings; nulls count as empty."""
    return F.sha2(F.concat_ws("␟", *(F.coalesce(c, F.lit("")) for c in (upstream, *settings))), 256)


def reset_failed(rows: DataFrame) -> DataFrame:
    """rows with failed ones pending again and their retries at 0."""
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    return rows.withColumns({"retries": F.when(failed, 0).otherwise(F.col("retries")), "status": F.when(failed, "pending").otherwise(F.col("status"))})
