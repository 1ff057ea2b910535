"""Wording of cards: headlines, labels and narrations of items, storyboards by kind, and what is left to render.

Lists of a card are short by the operator that made them (six items at most), so they are gathered inside the card's row. Defined results:
null texts count as empty; a card without items gets its fixed sentence; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import first_named, joined_text, page_runs, stable_hash, strip

# Groups of things to do by their words, labels of compared pictures by theirs, and storyboards by kind of document.
CHECKLIST_GROUPS = [
    ("付款", ["付款", "繳付", "繳納", "訂金", "尾款", "全額費"]),
    ("名單 / 艙房", ["名單", "分房", "艙房", "更改", "更動", "改名"]),
    ("護照 / 簽證", ["護照", "簽證", "登船", "入境"]),
    ("保險 / 健康", ["保險", "疾病", "醫師", "適航", "投保", "服藥"]),
]
OTHER_GROUP = "確認事項"
COMPARISON_LABELS = [("淺景深", ["淺"]), ("深景深", ["深"]), ("高設定", ["高"]), ("低設定", ["低"]), ("偏冷", ["冷"]), ("偏暖", ["暖"]), ("Before", ["before"]), ("After", ["after"])]
STORYBOARDS = {
    "contract": ["cover", "section_intro", "deadline_timeline", "penalty_table", "checklist", "risk_warning", "do_dont", "key_number", "recap_card"],
    "form": ["cover", "section_intro", "checklist", "deadline_timeline", "do_dont", "risk_warning", "recap_card"],
    "paper": ["cover", "section_intro", "paragraph_card", "paragraph_card", "paragraph_card", "checklist", "recap_card"],
    "manual": ["cover", "section_intro", "checklist", "risk_warning", "do_dont", "paragraph_card", "recap_card"],
    "report": ["cover", "section_intro", "key_number", "key_number", "risk_warning", "checklist", "recap_card"],
    "policy": ["cover", "section_intro", "checklist", "risk_warning", "deadline_timeline", "do_dont", "recap_card"],
    "slides": ["cover", "section_intro", "paragraph_card", "paragraph_card", "checklist", "recap_card"],
    "unknown": ["cover", "section_intro", "paragraph_card", "checklist", "recap_card"],
}
VISUAL_STORYBOARD = ["cover", "section_intro", "source_visual_explainer", "figure_explainer", "process_visual_card", "comparison_visual_card", "source_table_explainer", "source_screenshot_explainer", "checklist", "recap_card"]
TEXT_KINDS, TAUGHT_KINDS = ["contract", "form", "policy"], ["manual", "slides"]


def _filled(*parts: Column) -> Column:
    """The first part that is not empty, trimmed; empty if none is."""
    return strip(F.coalesce(*(F.when(F.length(p) > 0, p) for p in parts), F.lit("")))


def short_headline(text: Column, most: int = 18) -> Column:
    return F.substring(F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" ")), 1, most)


def item_focus(condition: Column, text: Column, value: Column, fallback: str, most: int = 36) -> Column:
    """Condition and value, else the value, else the condition, the text or a fallback."""
    c, v = strip(F.coalesce(condition, F.lit(""))), F.coalesce(value, F.lit(""))
    both = F.when((F.length(c) > 0) & (F.length(v) > 0), F.concat(c, F.lit(" → "), v)).when(F.length(v) > 0, v)
    return F.substring(F.coalesce(both, _filled(c, text, F.lit(fallback))), 1, most)


def checklist_group(text: Column) -> Column:
    return first_named(text, CHECKLIST_GROUPS, OTHER_GROUP)


def comparison_label(text: Column, fallback: str) -> Column:
    return first_named(text, COMPARISON_LABELS, fallback)


def item_narration(kind: Column, text: Column, value: Column, condition: Column) -> Column:
    """The sentence of a card that shows one item only."""
    or_else = lambda c, other: F.coalesce(F.when(F.length(c) > 0, c), F.lit(other))
    penalty = F.concat(F.lit("罰則細節："), or_else(condition, "這個情境"), F.lit("，文件列出的費用或比例是 "), or_else(value, "文件列出的費用"), F.lit("。請確認自己的取消或變更時間是否落在這一列。"))
    risk = F.concat(F.lit("這是一項需要單獨記住的風險："), F.substring(or_else(text, "這項風險"), 1, 100), F.lit("。處理前請回到來源頁確認完整條件。"))
    todo = F.concat(F.lit("應辦事項，"), checklist_group(text), F.lit("："), F.substring(or_else(text, "這項應辦事項"), 1, 100), F.lit("。這張卡只列這一件事，方便你逐項核對。"))
    date = F.concat(F.lit("時程細節："), or_else(value, "這個期限"), F.lit("。它對應的來源脈絡是："), F.substring(or_else(text, "文件中的期限條件"), 1, 100), F.lit("。請避免只記日期而忽略條件。"))
    return F.when(kind == "penalty_table", penalty).when(kind == "risk_warning", risk).when(kind == "checklist", todo).when(kind == "deadline_timeline", date)


def narrations(items: DataFrame, group: str) -> DataFrame:
    """group, scene_kind, narration: the spoken text of each card from its first items.

    items: group, scene_kind, slot, ordinal, text, value, condition, label. An item's part is cut before it is gathered; what lies beyond the
    items that a card speaks of is filtered out first.
    """
    spoken = F.when(F.col("scene_kind").isin("deadline_timeline", "checklist"), 4).when(F.col("scene_kind") == "key_number", 1).otherwise(3)
    text, value, condition, label = (F.coalesce(c, F.lit("")) for c in ("text", "value", "condition", "label"))
    part = (
        F.when(F.col("scene_kind") == "deadline_timeline", F.concat(value, F.lit("（"), F.substring(text, 1, 24), F.lit("）")))
        .when(F.col("scene_kind") == "penalty_table", F.concat(F.substring(condition, 1, 24), F.substring(value, 1, 16)))
        .when(F.col("scene_kind") == "checklist", F.substring(text, 1, 24)).when(F.col("scene_kind") == "risk_warning", F.substring(text, 1, 30)).when(F.col("scene_kind") == "do_dont", F.substring(text, 1, 18))
        .when(F.col("scene_kind") == "key_number", F.concat(F.lit("這份文件最重要的數字之一是 "), value, F.lit("，它代表的是 "), F.substring(label, 1, 16), F.lit("。完整脈絡可見："), F.substring(text, 1, 40), F.lit("。")))
    )
    rows = items.filter(F.col("ordinal") <= spoken).withColumn("_part", part).filter(F.col("_part").isNotNull())
    listed = rows.groupBy(group, "scene_kind").agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("slot") == "dont", 1).otherwise(0).alias("second"), "ordinal", "_part"))).alias("l"))
    parts = lambda second, by: F.array_join(F.transform(F.filter("l", lambda x: x["second"] == second), lambda x: x["_part"]), by)
    do, dont = parts(0, "、"), parts(1, "、")
    both = F.array_join(F.array_compact(F.array(F.when(F.length(do) > 0, F.concat(F.lit("應該做："), do)), F.when(F.length(dont) > 0, F.concat(F.lit("不要做："), dont)))), "；")
    said = (
        F.when(F.col("scene_kind") == "deadline_timeline", F.concat(F.lit("請先記住這幾個關鍵時程："), parts(0, "、"), F.lit("。錯過的話會影響後續權益。")))
        .when(F.col("scene_kind") == "penalty_table", F.concat(F.lit("重點罰則如下："), parts(0, "；"), F.lit("。請務必比對自己的情境再決定行動。")))
        .when(F.col("scene_kind") == "checklist", F.concat(F.lit("請依序確認以下應辦事項："), parts(0, "、"), F.lit("。")))
        .when(F.col("scene_kind") == "risk_warning", F.concat(F.lit("需要特別注意的風險："), parts(0, "；"), F.lit("。")))
        .when(F.col("scene_kind") == "do_dont", F.concat(both, F.lit("。"))).otherwise(parts(0, ""))
    )
    return listed.select(group, "scene_kind", said.alias("narration"))


def storyboard_of(kind: Column, visual_rich: Column, boards: dict[str, list[str]] | None = None) -> Column:
    """The kinds of scenes of a document; documents rich in pictures have their own. Kinds without a board take that of unknown ones."""
    boards = boards or STORYBOARDS
    of = lambda names: F.array(*map(F.lit, names))
    by_kind = F.create_map(*(x for k, names in boards.items() for x in (F.lit(k), of(names))))
    return F.when(F.coalesce(visual_rich, F.lit(False)), of(VISUAL_STORYBOARD)).otherwise(F.coalesce(F.try_element_at(by_kind, kind), of(boards["unknown"])))


def visual_flags(kind: Column, score: Column, visuals: Column, tutorial: Column) -> tuple[Column, Column]:
    """(rich in pictures, a visual tutorial)."""
    rich = F.coalesce((score >= 3.0) & (visuals >= 2) & ~kind.isin(TEXT_KINDS), F.lit(False))
    return rich, rich & (kind.isin(TAUGHT_KINDS) | F.coalesce(tutorial >= 2, F.lit(False)))


def shown_items(items: DataFrame) -> DataFrame:
    """Items that fit a card: six events and table rows, four of anything else. items: scene_kind, ordinal."""
    return items.filter(F.col("ordinal") <= F.when(F.col("scene_kind").isin("deadline_timeline", "penalty_table"), 6).otherwise(4))


def union_boxes(boxes: DataFrame, *keys: str) -> DataFrame:
    """keys, x0, y0, x1, y1: the smallest box around all boxes of a key; null boxes count nothing."""
    b = boxes.filter(F.col("bbox").isNotNull()).groupBy(*keys)
    return b.agg(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))


def with_issues(scenes: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """scenes with their sorted distinct issue codes, an empty list for those without. A scene has as many codes as there are rules at most."""
    codes = issues.groupBy(key).agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return scenes.join(codes, key, "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def to_render(scenes: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Scenes that failed or have no segment. scenes: key, status; segments: key."""
    gone = scenes.join(segments.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    return gone.filter(F.coalesce(F.col("status") == "failed", F.lit(False)) | F.col("_there").isNull()).drop("_there")


def screen_text(on_screen: Column, plan_lines: list[Column], payload_words: list[Column], payload_lists: list[Column]) -> Column:
    """All that a screen shows, as lines without empty ones: its own text, headline, callouts and labels of the plan, then words and lists of the layout.

    plan_lines and payload_lists: columns of strings or of arrays of strings, in the order of reading; payload_words: strings.
    """
    as_list = lambda c: F.coalesce(c.cast("array<string>"), F.array().cast("array<string>"))
    return joined_text(F.array(on_screen), *map(as_list, plan_lines), F.array(*payload_words) if payload_words else F.array().cast("array<string>"), *map(as_list, payload_lists))


def anchor_of(candidate_path: Column, page: Column, role: Column, caption: Column, why: Column) -> Column:
    """A figure as the anchor of a scene."""
    return F.struct(candidate_path.alias("path"), page.alias("page"), role.alias("visual_role"), caption.alias("caption"), why.alias("why"))


def promoted(scenes: DataFrame, document: str, *settings: str) -> DataFrame:
    """Script scenes as scenes to be made: default references and prompt, a hash of what goes in, pending.

    scenes: scene_id, title, source_pages, source_refs, narration, visual_hint, visual_type, anchor_path. An empty list of references gives
    one from the pages; settings (a voice, a rate) are part of the hash.
    """
    ref = F.concat(F.lit(f"{document} p."), page_runs(F.col("source_pages")))
    refs = F.when(F.size("source_refs") > 0, F.col("source_refs")).otherwise(F.array(ref))
    hashed = stable_hash(F.lit("scene"), F.coalesce("narration", F.lit("")), F.coalesce("visual_type", F.lit("")), F.array_sort("source_pages"), *map(F.lit, settings))
    path = F.when(F.length("anchor_path") > 0, F.array("anchor_path")).otherwise(F.array().cast("array<string>"))
    prompt = F.coalesce(F.when(F.length("visual_hint") > 0, F.col("visual_hint")), F.col("title"))
    return scenes.select("scene_id", "title", "source_pages", refs.alias("source_refs"), "narration", prompt.alias("visual_prompt"), "visual_type", path.alias("visual_source_paths"), hashed.alias("input_hash"), F.lit("pending").alias("status"))


def chapter_facts(chapters: DataFrame, facts: DataFrame) -> DataFrame:
    """chapters with how many pages they cover and how many facts stand on them, 0 where there are none. chapters: src_id, chapter_no, first_page, last_page; facts: src_id, page."""
    pages = chapters.filter(F.col("first_page") <= F.col("last_page")).select("src_id", "chapter_no", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    counted = pages.join(facts.groupBy("src_id", "page").agg(F.count(F.lit(1)).alias("_f")), ["src_id", "page"], "left")
    sums = counted.groupBy("src_id", "chapter_no").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("_f", F.lit(0))).alias("facts"))
    return chapters.join(sums, ["src_id", "chapter_no"], "left").na.fill(0, ["pages", "facts"])


def refined_kind(kind: Column, answer: Column, known: list[str]) -> Column:
    """A model's answer where it is one of the known kinds, else the kind that was found."""
    named = F.lower(strip(F.coalesce(answer, F.lit(""))))
    return F.when(named.isin(known), named).otherwise(kind)
