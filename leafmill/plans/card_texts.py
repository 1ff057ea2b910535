"""Queries of the card wording operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import cards, quality, review, storyboard
from leafmill.operators.extract import facts
from leafmill.plans import documents as docs
from leafmill.plans import reviews
from leafmill.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


_GROUP = "CASE WHEN regexp_matches(text, '付款|繳付|繳納|訂金|尾款|全額費') THEN '付款' WHEN regexp_matches(text, '名單|分房|艙房|更改|更動|改名') THEN '名單 / 艙房' WHEN regexp_matches(text, '護照|簽證|登船|入境') THEN '護照 / 簽證' WHEN regexp_matches(text, '保險|疾病|醫師|適航|投保|服藥') THEN '保險 / 健康' ELSE '確認事項' END"
_STRIPPED = lambda x: docs.sql_strip(x)


@query(docs.ITEMS_SQL + f""" SELECT src_id, scene_kind, slot, ordinal, substring(replace({_STRIPPED('text')}, chr(10), ' '), 1, 18) AS headline,
    substring(CASE WHEN {_STRIPPED('condition')} <> '' AND value <> '' THEN {_STRIPPED('condition')} || ' → ' || value WHEN value <> '' THEN value WHEN {_STRIPPED('condition')} <> '' THEN {_STRIPPED('condition')} WHEN text <> '' THEN {_STRIPPED('text')} ELSE '重點' END, 1, 36) AS focus,
    CASE scene_kind WHEN 'penalty_table' THEN '罰則細節：' || coalesce(nullif(condition, ''), '這個情境') || '，文件列出的費用或比例是 ' || coalesce(nullif(value, ''), '文件列出的費用') || '。請確認自己的取消或變更時間是否落在這一列。'
        WHEN 'risk_warning' THEN '這是一項需要單獨記住的風險：' || substring(coalesce(nullif(text, ''), '這項風險'), 1, 100) || '。處理前請回到來源頁確認完整條件。' WHEN 'checklist' THEN '應辦事項，' || {_GROUP} || '：' || substring(coalesce(nullif(text, ''), '這項應辦事項'), 1, 100) || '。這張卡只列這一件事，方便你逐項核對。'
        WHEN 'deadline_timeline' THEN '時程細節：' || coalesce(nullif(value, ''), '這個期限') || '。它對應的來源脈絡是：' || substring(coalesce(nullif(text, ''), '文件中的期限條件'), 1, 100) || '。請避免只記日期而忽略條件。' END AS narration
    FROM it WHERE ordinal <= CASE WHEN scene_kind IN ('deadline_timeline', 'penalty_table') THEN 6 ELSE 4 END""")
def item_texts(spark, d):
    """What the card of a single item says, for the items that fit a card."""
    c = F.col
    items = cards.shown_items(docs._items(spark, d))
    return items.select("src_id", "scene_kind", "slot", "ordinal", cards.short_headline(c("text")).alias("headline"), cards.item_focus(c("condition"), c("text"), c("value"), "重點").alias("focus"), cards.item_narration(c("scene_kind"), c("text"), c("value"), c("condition")).alias("narration"))


@query(docs.ITEMS_SQL + """, lb AS (SELECT page_id, value, arg_min(label, struct_pack(a := pattern_no, b := start)) AS label FROM f0 GROUP BY 1, 2), pt AS (SELECT it.src_id, it.scene_kind, it.slot, it.ordinal, CASE it.scene_kind WHEN 'deadline_timeline' THEN it.value || '（' || substring(it.text, 1, 24) || '）' WHEN 'penalty_table' THEN substring(it.condition, 1, 24) || substring(it.value, 1, 16) WHEN 'checklist' THEN substring(it.text, 1, 24) WHEN 'risk_warning' THEN substring(it.text, 1, 30) WHEN 'do_dont' THEN substring(it.text, 1, 18)
        WHEN 'key_number' THEN '這份文件最重要的數字之一是 ' || it.value || '，它代表的是 ' || substring(coalesce(lb.label, ''), 1, 16) || '。完整脈絡可見：' || substring(it.text, 1, 40) || '。' END AS part
        FROM it LEFT JOIN lb ON lb.page_id = it.page_id AND lb.value = it.value AND it.value <> '' WHERE ordinal <= CASE WHEN scene_kind IN ('deadline_timeline', 'checklist') THEN 4 WHEN scene_kind = 'key_number' THEN 1 ELSE 3 END),
    jn AS (SELECT src_id, scene_kind, string_agg(part, '、' ORDER BY ordinal) FILTER (WHERE slot <> 'dont') AS a, string_agg(part, '；' ORDER BY ordinal) AS b, string_agg(part, '、' ORDER BY ordinal) FILTER (WHERE slot = 'dont') AS dont FROM pt GROUP BY 1, 2)
    SELECT src_id, scene_kind, CASE scene_kind WHEN 'deadline_timeline' THEN '請先記住這幾個關鍵時程：' || a || '。錯過的話會影響後續權益。' WHEN 'penalty_table' THEN '重點罰則如下：' || b || '。請務必比對自己的情境再決定行動。' WHEN 'checklist' THEN '請依序確認以下應辦事項：' || a || '。' WHEN 'risk_warning' THEN '需要特別注意的風險：' || b || '。'
        WHEN 'do_dont' THEN concat_ws('；', '應該做：' || nullif(a, ''), '不要做：' || nullif(dont, '')) || '。' ELSE b END AS narration FROM jn""")
def card_narrations(spark, d):
    """What each card of a source says about its first items."""
    items = docs._items(spark, d)
    labelled = storyboard.first_facts(items, facts(table(spark, d, "pdf_pages"), "page_id")).select("src_id", "scene_kind", "slot", "ordinal", "label")
    return cards.narrations(items.join(labelled, ["src_id", "scene_kind", "slot", "ordinal"], "left"), "src_id")


@query("SELECT image_id, CASE WHEN contains(t, '淺') THEN '淺景深' WHEN contains(t, '深') THEN '深景深' WHEN contains(t, '高') THEN '高設定' WHEN contains(t, '低') THEN '低設定' WHEN contains(t, '冷') THEN '偏冷' WHEN contains(t, '暖') THEN '偏暖' WHEN contains(t, 'before') THEN 'Before' WHEN contains(t, 'after') THEN 'After' ELSE '左邊' END AS label FROM (SELECT image_id, lower(coalesce(caption_hint, '')) AS t FROM pdf_images)")
def comparison_labels(spark, d):
    return table(spark, d, "pdf_images").select("image_id", cards.comparison_label(F.col("caption_hint"), "左邊").alias("label"))


_BOARDS = {"contract": "cover|section_intro|deadline_timeline|penalty_table|checklist|risk_warning|do_dont|key_number|recap_card", "form": "cover|section_intro|checklist|deadline_timeline|do_dont|risk_warning|recap_card", "paper": "cover|section_intro|paragraph_card|paragraph_card|paragraph_card|checklist|recap_card", "manual": "cover|section_intro|checklist|risk_warning|do_dont|paragraph_card|recap_card", "report": "cover|section_intro|key_number|key_number|risk_warning|checklist|recap_card", "policy": "cover|section_intro|checklist|risk_warning|deadline_timeline|do_dont|recap_card", "slides": "cover|section_intro|paragraph_card|paragraph_card|checklist|recap_card"}


@query("SELECT doc_id, rich, tutorial, CASE WHEN rich THEN 'cover|section_intro|source_visual_explainer|figure_explainer|process_visual_card|comparison_visual_card|source_table_explainer|source_screenshot_explainer|checklist|recap_card' " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in _BOARDS.items()) + """ ELSE 'cover|section_intro|paragraph_card|checklist|recap_card' END AS scenes
    FROM (SELECT *, rich AND (kind IN ('manual', 'slides') OR doc_id % 4 >= 2) AS tutorial FROM (SELECT doc_id, coalesce(doc_kind, 'unknown') AS kind, doc_id % 6 >= 3 AND doc_id % 5 >= 2 AND coalesce(doc_kind, 'unknown') NOT IN ('contract', 'form', 'policy') AS rich FROM documents))""")
def document_storyboards(spark, d):
    i, kind = F.col("doc_id"), F.coalesce("doc_kind", F.lit("unknown"))
    rich, tutorial = cards.visual_flags(kind, (i % 6).cast("double"), i % 5, i % 4)
    return table(spark, d, "documents").select("doc_id", rich.alias("rich"), tutorial.alias("tutorial"), F.array_join(cards.storyboard_of(kind, rich), "|").alias("scenes"))


@query("SELECT src_id, page, min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1 FROM pdf_images WHERE bbox IS NOT NULL GROUP BY 1, 2")
def figure_areas(spark, d):
    """The smallest box around all figures of a page."""
    return cards.union_boxes(table(spark, d, "pdf_images"), "src_id", "page")


@query(f"WITH i AS ({reviews.ORACLES['scene_review']}), g AS (SELECT scene_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM i GROUP BY 1) SELECT image_id AS scene_id, coalesce(codes, '') AS codes FROM pdf_images LEFT JOIN g ON g.scene_id = image_id")
def scene_issue_lists(spark, d):
    """Every scene with the codes of its findings."""
    scenes = reviews.image_scenes(spark, d)
    files = table(spark, d, "pdf_images").filter("page % 6 <> 5").select("path")
    found = quality.broken_rules(review.with_existing(scenes, files, visual_there="path"), ["scene_id"], review.layout_rules())
    return cards.with_issues(scenes.select("scene_id"), found, "scene_id").select("scene_id", F.array_join("codes", ",").alias("codes"))


@query("SELECT image_id AS scene_id FROM pdf_images WHERE coalesce(page % 7 = 0, false) OR page IS NULL OR page % 8 = 1")
def scenes_to_render(spark, d):
    """Failed scenes, and those whose segment is not there: the ones of every eighth page."""
    segments = table(spark, d, "pdf_images").filter("page % 8 <> 1").select(F.col("image_id").alias("scene_id"))
    return cards.to_render(reviews.image_scenes(spark, d), segments, "scene_id").select("scene_id")


@query("""SELECT doc_id, concat_ws(chr(10), nullif(source, ''), nullif(doc_kind, ''), nullif(lang, ''), nullif(source, '')) AS screen FROM documents""")
def screen_texts(spark, d):
    """What screens show, from the columns of documents in the places of their parts."""
    c = F.col
    shown = cards.screen_text(c("source"), [F.array(c("doc_kind"))], [c("lang"), F.lit("")], [F.array(c("source"), F.lit(None).cast("string"))])
    return table(spark, d, "documents").select("doc_id", shown.alias("screen"))


@query("""SELECT chunk_key AS scene_id, CASE WHEN chunk_key % 3 = 0 THEN 'given' ELSE 'doc p.' || start_page || CASE WHEN end_page > start_page THEN '-' || end_page ELSE '' END END AS ref, CASE WHEN chunk_key % 2 = 0 THEN 'hint' ELSE chunk_id END AS visual_prompt, CASE WHEN chunk_key % 5 = 0 THEN 0 ELSE 1 END::INTEGER AS paths,
    sha256('{"v":"scene"}␟{"v":"' || chunk_id || '"}␟{"v":"card"}␟{"v":' || replace(range(start_page, end_page + 1)::VARCHAR, ', ', ',') || '}␟{"v":"voice"}') AS input_hash, 'pending' AS status FROM pdf_chunks WHERE start_page <= end_page""")
def promoted_scenes(spark, d):
    i = F.col("chunk_key")
    rows = table(spark, d, "pdf_chunks").filter("start_page <= end_page").select(
        i.alias("scene_id"), F.col("chunk_id").alias("title"), F.sequence("start_page", "end_page").alias("source_pages"), F.when(i % 3 == 0, F.array(F.lit("given"))).otherwise(F.array().cast("array<string>")).alias("source_refs"),
        F.col("chunk_id").alias("narration"), F.when(i % 2 == 0, "hint").alias("visual_hint"), F.lit("card").alias("visual_type"), F.when(i % 5 != 0, "a.png").alias("anchor_path"),
    )
    made = cards.promoted(rows, "doc", "voice")
    return made.select("scene_id", F.array_join("source_refs", ",").alias("ref"), "visual_prompt", F.size("visual_source_paths").alias("paths"), "input_hash", "status")


@query(docs.OUTLINE_SQL + """, pg AS (SELECT src_id, chapter_no, unnest(range(first_page, last_page + 1)) AS page FROM ol), hf AS (SELECT src_id, page, sum(len(headings)) AS f FROM pdf_pages WHERE len(headings) > 0 GROUP BY 1, 2)
    SELECT ol.src_id, ol.chapter_no, coalesce(n, 0)::BIGINT AS pages, coalesce(f, 0)::BIGINT AS facts FROM ol LEFT JOIN (SELECT pg.src_id, pg.chapter_no, count(*) AS n, sum(coalesce(f, 0)) AS f FROM pg LEFT JOIN hf ON hf.src_id = pg.src_id AND hf.page = pg.page GROUP BY 1, 2) q ON q.src_id = ol.src_id AND q.chapter_no = ol.chapter_no""")
def chapter_fact_counts(spark, d):
    """Headings on the pages of each chapter of the outline."""
    chapters = storyboard.outline(table(spark, d, "pdf_chunks"), 6.0).select("src_id", "chapter_no", "first_page", "last_page")
    heads = table(spark, d, "pdf_pages").select("src_id", "page", F.explode("headings"))
    return cards.chapter_facts(chapters, heads).select("src_id", "chapter_no", "pages", "facts")


@query("SELECT doc_id, CASE WHEN lower(trim(source)) IN ('contract', 'report') THEN lower(trim(source)) WHEN doc_id % 2 = 0 THEN 'report' ELSE coalesce(doc_kind, 'unknown') END AS kind FROM documents")
def refined_kinds(spark, d):
    """Kinds after an answer; every second document gets one that is known."""
    answer = F.when(F.col("doc_id") % 2 == 0, " Report ").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", cards.refined_kind(F.coalesce("doc_kind", F.lit("unknown")), answer, ["contract", "report"]).alias("kind"))
