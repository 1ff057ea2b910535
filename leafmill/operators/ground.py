"""Grounding: do quotations stand on the pages they cite, and is every claim backed by one?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import grounding_form, quote_match_ratio

# Kinds of scenes that need evidence, kinds without sources, labels of facts that must be backed, and the threshold.
EVIDENCE_KINDS = ["deadline_timeline", "penalty_table", "checklist", "risk_warning", "do_dont", "key_number", "source_crop"]
SOURCELESS_KINDS = ["cover", "recap_card"]
FACTUAL_LABELS = ["期限", "百分比", "金額", "Deadline", "日期", "數量"]
LEAST_RATIO = 0.55


def page_forms(pages: DataFrame, *keys: str) -> DataFrame:
    """keys, form: the comparison form of each page, made once and not per quotation."""
    return pages.select(*keys, grounding_form(F.coalesce("text", F.lit(""))).alias("form"))


def grounded(quotes: DataFrame, forms: DataFrame, on: list[str], quote: str = "quote", name: str = "ratio") -> DataFrame:
    """quotes with the share of each that stands on its page; null where the page is not there."""
    q = quotes.withColumn("_q", grounding_form(F.col(quote)))
    joined = q.join(forms.withColumn("_there", F.lit(True)), on, "left")
    return joined.withColumn(name, F.when(F.col("_there"), quote_match_ratio(F.col("_q"), F.col("form")))).drop("_q", "form", "_there")


def is_factual(label: Column, importance: Column) -> Column:
    named = label.rlike("|".join(FACTUAL_LABELS))
    return F.coalesce((F.length(label) > 0) & (named | importance.isin("high", "medium")), F.lit(False))


def issues(scenes: DataFrame, evidence: DataFrame, facts: DataFrame, pages: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """scene_id, rule_no, idx, code, page: one row per broken rule.

    scenes: scene_id, scene_kind, source_pages; evidence: scene_id, idx, page, quote; facts: scene_id, idx, label, importance,
    evidence_index; pages: page, text. Each rule is a filter or an anti-join; they meet in one union.
    """
    s = scenes.select("scene_id", F.lower(F.coalesce("scene_kind", F.lit(""))).alias("kind"), F.coalesce("source_pages", F.array().cast("array<int>")).alias("source_pages"))
    known = pages.select("page").distinct()
    counts = evidence.groupBy("scene_id").agg(F.count(F.lit(1)).alias("spans"))
    s = s.join(counts, "scene_id", "left").na.fill(0, ["spans"])
    free = F.col("kind").isin(SOURCELESS_KINDS)

    def out(df, rule, code, idx=F.lit(0), page=F.lit(None)):
        return df.select("scene_id", F.lit(rule).alias("rule_no"), idx.cast("int").alias("idx"), F.lit(code).alias("code"), page.cast("int").alias("page"))

    cited = s.filter(~free).select("scene_id", F.posexplode("source_pages").alias("idx", "page"))
    spans = evidence.select("scene_id", "idx", "page", "quote")
    checked = grounded(spans, page_forms(pages, "page"), ["page"])
    backed = facts.filter(is_factual(F.col("label"), F.col("importance"))).join(s.select("scene_id", "spans"), "scene_id")
    linked = F.col("evidence_index").isNotNull()
    parts = [
        out(s.filter((F.col("kind") != "") & ~free & (F.size("source_pages") == 0)), 1, "no_source_pages"),
        out(cited.join(known, "page", "left_anti"), 2, "bad_source_page", F.col("idx"), F.col("page")),
        out(s.filter(F.col("kind").isin(EVIDENCE_KINDS) & (F.col("spans") == 0)), 3, "missing_evidence"),
        out(spans.join(known, "page", "left_anti"), 4, "bad_page", F.col("idx"), F.col("page")),
        out(checked.filter(F.col("ratio") < least), 5, "quote_mismatch", F.col("idx"), F.col("page")),
        out(backed.filter(~linked & (F.col("spans") == 0)), 6, "fact_without_evidence", F.col("idx")),
        out(backed.filter(linked & ((F.col("evidence_index") < 0) | (F.col("evidence_index") >= F.col("spans")))), 7, "evidence_index_out_of_range", F.col("idx")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def repaired(scenes: DataFrame, evidence: DataFrame, facts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of repair by the issues that were found.

    A scene loses its evidence on pages that are unknown or on which a quotation of it does not stand, with it the facts that point beyond
    what is left; a factual scene without evidence goes. Indices are not moved up, as in the original procedure: a fact that stays may
    point at another span.
    """
    bad = found.filter(F.col("code").isin("bad_page", "quote_mismatch") & F.col("page").isNotNull()).select("scene_id", "page").distinct()
    kept = evidence.join(bad, ["scene_id", "page"], "left_anti")
    counts = kept.groupBy("scene_id").agg(F.count(F.lit(1)).alias("spans"))
    touched = bad.select("scene_id").distinct().withColumn("_touched", F.lit(True))
    checked = facts.join(touched, "scene_id", "left").join(counts, "scene_id", "left").na.fill(0, ["spans"])
    facts_kept = checked.filter(F.col("_touched").isNull() | F.col("evidence_index").isNull() | (F.col("evidence_index") < F.col("spans"))).drop("spans", "_touched")
    bare = scenes.join(counts, "scene_id", "left_anti").filter(F.lower("scene_kind").isin(EVIDENCE_KINDS)).select("scene_id").distinct()
    return scenes.join(bare, "scene_id", "left_anti"), kept.join(bare, "scene_id", "left_anti"), facts_kept.join(bare, "scene_id", "left_anti")


def repair_rounds(scenes: DataFrame, evidence: DataFrame, facts: DataFrame, pages: DataFrame, rounds: int = 1, least: float = LEAST_RATIO) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scenes, evidence, facts, issues that are left) after at most so many rounds of checking and repair. Whoever needs grounded scenes raises if issues are left."""
    from leafmill.session import materialize

    tables, left = (scenes, evidence, facts), materialize(issues(scenes, evidence, facts, pages, least), "issues")
    for _ in range(rounds):
        if left.isEmpty():
            break
        tables = tuple(materialize(t, "repaired") for t in repaired(*tables, left))
        left = materialize(issues(*tables, pages, least), "issues")
    return (*tables, left)


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def keeps_values(rewrite: Column, values: Column) -> Column:
    """Whether every non-empty value of a list stands in the rewrite."""
    return F.forall(F.coalesce(values, F.array().cast("array<string>")), lambda v: (F.length(v) == 0) | F.contains(rewrite, v))
