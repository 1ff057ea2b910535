"""Choosing content for a given length: scores, trimming, padding and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.sequence import numbered, running_sum

# Seconds, and priority, of each kind of scene; the rank of an importance.
SECONDS = {"cover": 12.0, "section_intro": 14.0, "deadline_timeline": 28.0, "penalty_table": 28.0, "checklist": 26.0, "risk_warning": 24.0, "do_dont": 22.0, "recap_card": 18.0, "paragraph_card": 22.0, "source_crop": 22.0, "key_number": 18.0, "source_visual_explainer": 26.0, "figure_explainer": 28.0, "comparison_visual_card": 28.0, "process_visual_card": 28.0, "source_table_explainer": 28.0, "source_screenshot_explainer": 28.0}
PRIORITY = {"cover": 100, "recap_card": 95, "deadline_timeline": 90, "penalty_table": 88, "risk_warning": 85, "checklist": 80, "key_number": 75, "do_dont": 70, "source_visual_explainer": 86, "figure_explainer": 84, "comparison_visual_card": 83, "process_visual_card": 82, "source_table_explainer": 82, "source_screenshot_explainer": 82, "source_crop": 60, "section_intro": 55, "paragraph_card": 40}
IMPORTANCE = {"high": 3, "medium": 2, "low": 1}
OTHER_SECONDS, OTHER_PRIORITY, EXTRA_SECONDS = 22.0, 30, 18.0
KEPT_KINDS = ["cover", "recap_card"]


def _lookup(key: Column, table: dict, other) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(other))


def scene_seconds(kind: Column, own: Column) -> Column:
    """A scene's own estimate where it has one, else that of its kind."""
    return F.when(own > 0, own).otherwise(_lookup(F.coalesce(kind, F.lit("paragraph_card")), SECONDS, OTHER_SECONDS))


def scene_score(kind: Column, importance: Column, facts: Column, spans: Column) -> Column:
    base = _lookup(F.lower(F.coalesce(kind, F.lit("paragraph_card"))), PRIORITY, OTHER_PRIORITY)
    score = base + 5 * _lookup(F.lower(F.coalesce(importance, F.lit(""))), IMPORTANCE, 0) + F.least(F.lit(10), 2 * facts)
    return (score + F.when(spans > 0, 5).otherwise(0)).cast("int")


def trimmed(scenes: DataFrame, group: str, most: float, least_rows: int = 3) -> DataFrame:
    """Scenes that stay when the lowest scores go until a group is within its length, or down to least_rows.

    The loop "drop the lowest while too long" has a closed form over the order of dropping: row k goes if what is left after the rows
    before it is still too long and too many. scenes: group, seq, seconds, score, kind. The running sums are made block by block.
    """
    totals = scenes.groupBy(group).agg(F.sum("seconds").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    open_kinds = scenes.filter(~F.coalesce(F.lower("kind"), F.lit("")).isin(KEPT_KINDS))
    sums = running_sum(open_kinds, [group], ["score", "seq"], F.col("seconds"), "_gone")
    sums = running_sum(sums, [group], ["score", "seq"], F.lit(1), "_dropped")
    gone = sums.join(totals, group).filter((F.col("_total") - F.col("_gone") > most) & (F.col("_rows") - F.col("_dropped") > least_rows)).select(group, "seq")
    return scenes.join(gone, [group, "seq"], "left_anti")


def padding(items: DataFrame, totals: DataFrame, group: str, least: float, goal: float, extra: float = EXTRA_SECONDS) -> DataFrame:
    """group, slot, seq, item: extra cards for groups that are too short, in rounds over the scenes by score, until the goal is reached.

    items: group, seq, score, capacity; totals: group, total. A slot's number alone says whether the goal is reached before it, so only
    as many rounds are laid out as the gap has room for.
    """
    short = totals.filter(F.col("total") < least).select(group, "total", F.ceil((goal - F.col("total")) / extra).cast("int").alias("_room"))
    rows = items.filter("capacity > 0").join(short, group)
    slots = rows.select(group, "seq", "score", "_room", F.explode(F.sequence(F.lit(0), F.least(F.col("capacity"), F.col("_room")) - 1)).alias("item"))
    order = Window.partitionBy(group).orderBy("item", F.col("score").desc(), "seq")
    return slots.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= F.col("_room")).select(group, "slot", "seq", "item")


def inserted(scenes: DataFrame, slots: DataFrame, group: str) -> DataFrame:
    """group, seq, item, place: scenes (item -1) and behind each its extra cards, numbered anew block by block. scenes: group, seq; slots: group, seq, item."""
    rows = scenes.select(group, "seq", F.lit(-1).alias("item")).unionByName(slots.select(group, "seq", "item"))
    return numbered(rows, group, ["seq", "item"], "place")


def selection_report(scenes: DataFrame, slots: DataFrame, group: str, least: float, extra: float = EXTRA_SECONDS) -> DataFrame:
    """group, base_scenes, expansions, capacity, seconds, under_target. scenes: group, seconds, capacity; slots: group."""
    base = scenes.groupBy(group).agg(F.count(F.lit(1)).alias("base_scenes"), F.sum("capacity").cast("long").alias("capacity"), F.sum("seconds").alias("_s"))
    rows = base.join(slots.groupBy(group).agg(F.count(F.lit(1)).alias("expansions")), group, "left").na.fill(0, ["expansions"])
    rows = rows.withColumn("seconds", F.col("_s") + extra * F.col("expansions"))
    return rows.select(group, "base_scenes", "expansions", "capacity", "seconds", (F.col("seconds") < least).alias("under_target"))


def timeline(scenes: DataFrame, group: str, order: str, seconds: str) -> DataFrame:
    """scenes with start_sec: the sum of what comes before in the group."""
    return running_sum(scenes, [group], order, F.coalesce(seconds, F.lit(0)), "start_sec")


def cue_times(scenes: DataFrame, *keys: str) -> DataFrame:
    """keys, cue_no, cue, begin_sec, end_sec: the cues of a scene share its time evenly. scenes: keys, start_sec, seconds, cues."""
    slot = F.col("seconds") / F.greatest(F.size("cues"), F.lit(1))
    rows = scenes.withColumn("_slot", slot).select(*keys, "start_sec", "_slot", F.posexplode("cues").alias("cue_no", "cue"))
    return rows.select(*keys, "cue_no", "cue", (F.col("start_sec") + F.col("cue_no") * F.col("_slot")).alias("begin_sec"), (F.col("start_sec") + (F.col("cue_no") + 1) * F.col("_slot")).alias("end_sec"))
