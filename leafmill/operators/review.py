"""Review of scenes and sources: asset rules, layout rules, coverage, length, and visual metrics.

Rules are data (operators.quality.Rule). What a rule needs beside its row is joined first, each by one equi-join: which of its files exist,
how many pages of its source are cited. Defined results: a null flag, size or ratio breaks no rule that compares it; an empty table has
no findings; repeated scenes are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.numeric import rounded
from leafmill.operators.ground import EVIDENCE_KINDS
from leafmill.operators.quality import Rule

# Kinds led by a source picture, kinds that need none, words of decorative pictures, and the limits of the rules.
VISUAL_FIRST_KINDS = ["source_visual_explainer", "figure_explainer", "comparison_visual_card", "process_visual_card", "source_table_explainer", "source_screenshot_explainer"]
OPENING_KINDS = ["cover", "section_intro", "recap_card"]
DECORATIVE_WORDS = ["stamp", "seal", "logo", "印章", "圖章", "標誌"]
LEAST_WIDTH, LEAST_HEIGHT, MOST_ROWS, MOST_ITEMS = 800, 450, 6, 8
MOST_OVERLAP, LEAST_SCREEN_CHARS, ASPECT_LOW, ASPECT_HIGH = 0.72, 16, 0.68, 1.9
LEAST_COVERAGE_PCT, LENGTH_OFF_PCT, REVIEW_OFF_PCT, VERBATIM_PCT = 40.0, 8.0, 12.0, 25.0


def with_existing(rows: DataFrame, files: DataFrame, **paths: str) -> DataFrame:
    """rows with a boolean column <name> for each name=path column: whether the path is among files.path. Null and empty paths do not exist."""
    there = files.select("path").filter("path IS NOT NULL").distinct()
    for name, column in paths.items():
        rows = rows.join(there.select(F.col("path").alias(column), F.lit(True).alias(name)), column, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def asset_rules(verbatim_pct: float = VERBATIM_PCT) -> list[Rule]:
    """Over scenes: status, pages (cited), audio_there, subtitle, subtitle_there, visual_there, visual_type, source_there, verbatim (share)."""
    c, one = F.col, F.lit(1.0)
    failed = F.coalesce(c("status") == "failed", F.lit(False))
    blank = F.coalesce(F.length("subtitle") == 0, F.lit(True))
    live = lambda broken: ~failed & broken
    return [
        Rule("scene_failed", "error", failed, one),
        Rule("missing_source_pages", "error", live(F.coalesce(c("pages"), F.lit(0)) == 0), one),
        Rule("missing_audio", "error", live(~c("audio_there")), one),
        Rule("missing_subtitle", "warning", live(blank), one),
        Rule("missing_subtitle_file", "warning", live(~blank & ~c("subtitle_there")), one),
        Rule("missing_visual", "error", live(~c("visual_there")), one),
        Rule("missing_visual_source", "warning", live((c("visual_type") == "pdf_image") & ~c("source_there")), one),
        Rule("verbatim_overlap", "warning", live(c("verbatim") * 100 > verbatim_pct), rounded(c("verbatim") * 100, 1)),
    ]


def layout_rules(allow_generated: bool = False) -> list[Rule]:
    """Over scenes: scene_kind, visual_type, path, visual_there, width, height, payload_rows, prompt, spans, overlap, screen_chars, role, anchored."""
    c, one = F.col, F.lit(1.0)
    drawn = F.coalesce(F.length("path") > 0, F.lit(False))
    kind = F.coalesce("scene_kind", F.lit(""))
    words = F.lower(F.coalesce("prompt", F.lit(""))).rlike("|".join(DECORATIVE_WORDS))
    aspect = c("width") / F.greatest(F.lit(1), c("height"))
    first = kind.isin(VISUAL_FIRST_KINDS)
    return [
        Rule("generated_image_leak", "error", (c("visual_type") == "generated_image") & F.lit(not allow_generated), one),
        Rule("missing_visual", "error", drawn & ~c("visual_there"), one),
        Rule("low_res_card", "warning", drawn & c("visual_there") & ((c("width") < LEAST_WIDTH) | (c("height") < LEAST_HEIGHT)), c("width")),
        Rule("no_visual_path", "error", ~drawn, one),
        Rule("table_too_dense", "warning", (kind == "penalty_table") & (c("payload_rows") > MOST_ROWS), c("payload_rows")),
        Rule("checklist_too_long", "warning", (kind == "checklist") & (c("payload_rows") > MOST_ITEMS), c("payload_rows")),
        Rule("decorative_visual_risk", "warning", words & c("visual_type").isin("generated_image", "pdf_image") & (c("spans") == 0), one),
        Rule("missing_evidence", "error", kind.isin(EVIDENCE_KINDS) & (c("spans") == 0), one),
        Rule("narration_screen_overlap_too_high", "warning", first & (c("overlap") >= MOST_OVERLAP) & (c("screen_chars") >= LEAST_SCREEN_CHARS), c("overlap")),
        Rule("full_page_tiny_screenshot", "warning", first & (c("role") == "source_page_crop") & c("anchored") & ((aspect < ASPECT_LOW) | (aspect > ASPECT_HIGH)), rounded(aspect, 3)),
    ]


def scene_metrics(scenes: DataFrame, group: str, overlap: Column | None = None) -> DataFrame:
    """group and its counts: scenes, rendered, failed, with evidence, factual, generated, visual-first, with a source picture, text only; seconds, coverage and mean overlap.

    scenes: group, scene_kind, status, spans, visual_type, anchored, seconds, overlap. One aggregation with partial sums.
    """
    kind, anchored = F.coalesce("scene_kind", F.lit("")), F.coalesce("anchored", F.lit(False))
    first, live = kind.isin(VISUAL_FIRST_KINDS), F.col("status") == "rendered"
    out = scenes.groupBy(group).agg(
        F.count(F.lit(1)).alias("scenes"), F.count_if(live).alias("rendered"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("spans") > 0).alias("scenes_with_evidence"),
        F.count_if(kind.isin(EVIDENCE_KINDS)).alias("factual_scenes"), F.count_if(F.col("visual_type") == "generated_image").alias("generated_images"), F.count_if(first).alias("visual_first"),
        F.count_if(first & anchored).alias("source_visual"), F.count_if(~anchored & ~kind.isin(OPENING_KINDS)).alias("text_only"),
        F.sum(F.coalesce("seconds", F.lit(0.0))).alias("seconds"), F.sum(F.when(live, F.coalesce("seconds", F.lit(0.0))).otherwise(0.0)).alias("rendered_seconds"),
        F.coalesce(rounded(F.avg(F.when(first, F.col("overlap") if overlap is None else overlap)), 3), F.lit(0.0)).alias("mean_overlap"),
    )
    return out.withColumn("anchor_coverage", rounded(F.col("source_visual") / F.greatest(F.lit(1), F.col("visual_first")), 3))


def off_target_pct(seconds: Column, target: Column) -> Column:
    """Distance from a positive target in percent; null without one."""
    return F.when(target > 0, F.abs(seconds - target) / target * 100)


def source_rules() -> list[Rule]:
    """Over scene_metrics with pages_cited, page_count, target_seconds, visual_rich, useful_visuals."""
    c = F.col
    coverage = 100.0 * c("pages_cited") / F.greatest(F.lit(1), F.coalesce(c("page_count"), F.lit(1)))
    review, final = off_target_pct(c("seconds"), c("target_seconds")), off_target_pct(c("rendered_seconds"), c("target_seconds"))
    rich = F.coalesce(c("visual_rich"), F.lit(False)) & (c("scenes") > 0)
    return [
        Rule("low_source_coverage", "warning", coverage < LEAST_COVERAGE_PCT, rounded(coverage, 1)),
        Rule("duration_off_target", "warning", review > REVIEW_OFF_PCT, rounded(review, 1)),
        Rule("final_duration_off_target", "warning", (c("rendered_seconds") > 0) & (final > LENGTH_OFF_PCT), rounded(final, 1)),
        Rule("image_rich_but_few_source_visuals", "warning", rich & (c("source_visual") < F.greatest(F.lit(1), F.floor(c("scenes") / 3))), c("source_visual")),
        Rule("image_rich_but_mostly_text_cards", "warning", rich & (c("text_only") > c("source_visual")), c("text_only")),
        Rule("source_visuals_available_but_unused", "warning", (c("useful_visuals") > 0) & (c("source_visual") == 0), c("useful_visuals")),
    ]
