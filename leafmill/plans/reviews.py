"""Queries of the review, expansion and selection operators over scenes derived from pages and images, and their DuckDB SQL.

The scenes stand in for made ones: their states, paths and sizes come from the rows' own columns by fixed arithmetic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import numeric
from leafmill.operators import budget, extract, figures, ground, quality, review, state, storyboard
from leafmill.operators.sequence import numbered
from leafmill.plans import documents as docs
from leafmill.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


KIND_OF = ["penalty_table", "checklist", "cover", "source_visual_explainer", "figure_explainer"]
_KIND_SQL = "(['penalty_table', 'checklist', 'cover', 'source_visual_explainer', 'figure_explainer'])[(coalesce(page, 0) % 5 + 1)::INTEGER]"
IMAGE_SCENES = f"""WITH sc AS (SELECT image_id AS scene_id, src_id, page, {_KIND_SQL} AS scene_kind, CASE page % 4 WHEN 0 THEN 'generated_image' WHEN 1 THEN 'pdf_image' ELSE 'sketchbook_card' END AS visual_type, path, page % 6 <> 5 AS visual_there,
    width, height, page % 11 AS payload_rows, caption_hint AS prompt, CASE WHEN caption_hint IS NULL THEN 0 ELSE 1 END AS spans, (pixel_count % 100) / 100.0::DOUBLE AS overlap, length(coalesce(caption_hint, '')) AS screen_chars,
    CASE WHEN page % 2 = 0 THEN 'source_page_crop' ELSE 'source_photo' END AS role, page % 3 <> 0 AS anchored, CASE page % 7 WHEN 0 THEN 'failed' WHEN 3 THEN 'pending' ELSE 'rendered' END AS status, 20.0::DOUBLE + page % 9 AS seconds FROM pdf_images)"""


def image_scenes(spark, d):
    p = F.col("page")
    kind = F.get(F.array(*map(F.lit, KIND_OF)), (F.coalesce(p, F.lit(0)) % 5).cast("int"))
    i = table(spark, d, "pdf_images")
    return i.select(
        F.col("image_id").alias("scene_id"), "src_id", "page", kind.alias("scene_kind"), F.when(p % 4 == 0, "generated_image").when(p % 4 == 1, "pdf_image").otherwise("sketchbook_card").alias("visual_type"), "path", "width", "height",
        (p % 11).alias("payload_rows"), F.col("caption_hint").alias("prompt"), F.when(F.col("caption_hint").isNull(), 0).otherwise(1).alias("spans"), (F.col("pixel_count") % 100 / 100.0).alias("overlap"),
        F.length(F.coalesce("caption_hint", F.lit(""))).alias("screen_chars"), F.when(p % 2 == 0, "source_page_crop").otherwise("source_photo").alias("role"), (p % 3 != 0).alias("anchored"),
        F.when(p % 7 == 0, "failed").when(p % 7 == 3, "pending").otherwise("rendered").alias("status"), (F.lit(20.0) + p % 9).alias("seconds"),
    )


@query(f"""{IMAGE_SCENES}, e AS (SELECT DISTINCT path FROM pdf_images WHERE page % 6 <> 5 AND path IS NOT NULL), s AS (SELECT sc.* EXCLUDE (visual_there), e.path IS NOT NULL AS visual_there, coalesce(length(sc.path) > 0, false) AS drawn, width / greatest(1, height)::DOUBLE AS aspect,
        scene_kind IN ('source_visual_explainer', 'figure_explainer') AS vf FROM sc LEFT JOIN e ON e.path = sc.path)
    SELECT scene_id, 'generated_image_leak' AS code, 'error' AS severity, 1.0::DOUBLE AS measure FROM s WHERE visual_type = 'generated_image'
    UNION ALL SELECT scene_id, 'missing_visual', 'error', 1.0 FROM s WHERE drawn AND NOT visual_there UNION ALL SELECT scene_id, 'low_res_card', 'warning', width FROM s WHERE drawn AND visual_there AND (width < 800 OR height < 450)
    UNION ALL SELECT scene_id, 'no_visual_path', 'error', 1.0 FROM s WHERE NOT drawn UNION ALL SELECT scene_id, 'table_too_dense', 'warning', payload_rows FROM s WHERE scene_kind = 'penalty_table' AND payload_rows > 6
    UNION ALL SELECT scene_id, 'checklist_too_long', 'warning', payload_rows FROM s WHERE scene_kind = 'checklist' AND payload_rows > 8
    UNION ALL SELECT scene_id, 'decorative_visual_risk', 'warning', 1.0 FROM s WHERE regexp_matches(lower(coalesce(prompt, '')), 'stamp|seal|logo|印章|圖章|標誌') AND visual_type IN ('generated_image', 'pdf_image') AND spans = 0
    UNION ALL SELECT scene_id, 'missing_evidence', 'error', 1.0 FROM s WHERE scene_kind IN ('penalty_table', 'checklist') AND spans = 0
    UNION ALL SELECT scene_id, 'narration_screen_overlap_too_high', 'warning', overlap FROM s WHERE vf AND overlap >= 0.72 AND screen_chars >= 16
    UNION ALL SELECT scene_id, 'full_page_tiny_screenshot', 'warning', round(aspect, 3) FROM s WHERE vf AND role = 'source_page_crop' AND anchored AND (aspect < 0.68 OR aspect > 1.9)""")
def scene_review(spark, d):
    """Layout rules over cards; the cards on every sixth page are gone from disk."""
    files = table(spark, d, "pdf_images").filter("page % 6 <> 5").select("path")
    rows = review.with_existing(image_scenes(spark, d), files, visual_there="path")
    return quality.broken_rules(rows, ["scene_id"], review.layout_rules())


_ASSETS = """WITH sc AS (SELECT page_id AS scene_id, CASE WHEN page_id % 17 = 0 THEN 'failed' ELSE 'rendered' END AS status, CASE WHEN page_id % 19 = 0 THEN 0 ELSE 1 END AS pages, page_id % 7 <> 0 AND page_id % 23 <> 0 AS audio_there,
    CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'sub/' || page_id END AS subtitle, page_id % 9 > 1 AND page_id % 29 <> 0 AS subtitle_there, page_id % 31 <> 0 AS visual_there, CASE WHEN page_id % 2 = 0 THEN 'pdf_image' END AS visual_type, page_id % 5 <> 0 AS source_there, text_area_ratio AS verbatim FROM pdf_pages)"""


@query(_ASSETS + """, l AS (SELECT * FROM sc WHERE status <> 'failed') SELECT scene_id, 'scene_failed' AS code, 'error' AS severity, 1.0::DOUBLE AS measure FROM sc WHERE status = 'failed'
    UNION ALL SELECT scene_id, 'missing_source_pages', 'error', 1.0 FROM l WHERE pages = 0 UNION ALL SELECT scene_id, 'missing_audio', 'error', 1.0 FROM l WHERE NOT audio_there
    UNION ALL SELECT scene_id, 'missing_subtitle', 'warning', 1.0 FROM l WHERE coalesce(subtitle, '') = '' UNION ALL SELECT scene_id, 'missing_subtitle_file', 'warning', 1.0 FROM l WHERE coalesce(subtitle, '') <> '' AND NOT subtitle_there
    UNION ALL SELECT scene_id, 'missing_visual', 'error', 1.0 FROM l WHERE NOT visual_there UNION ALL SELECT scene_id, 'missing_visual_source', 'warning', 1.0 FROM l WHERE visual_type = 'pdf_image' AND NOT source_there
    UNION ALL SELECT scene_id, 'verbatim_overlap', 'warning', round(verbatim * 100, 1) FROM l WHERE verbatim * 100 > 25""")
def scene_assets(spark, d):
    """Asset rules: paths of sounds, subtitles, cards and crops against the files that are there."""
    i = F.col("page_id")
    named = lambda kind: F.concat(F.lit(kind + "/"), i.cast("string"))
    pages = table(spark, d, "pdf_pages")
    rows = pages.select(
        i.alias("scene_id"), F.when(i % 17 == 0, "failed").otherwise("rendered").alias("status"), F.when(i % 19 == 0, 0).otherwise(1).alias("pages"), F.when(i % 7 != 0, named("audio")).alias("audio"),
        F.when(i % 9 == 0, F.lit(None).cast("string")).when(i % 9 == 1, "").otherwise(named("sub")).alias("subtitle"), named("card").alias("card"), named("crop").alias("crop"), F.when(i % 2 == 0, "pdf_image").alias("visual_type"), F.col("text_area_ratio").alias("verbatim"),
    )
    there = F.array(F.when(i % 23 != 0, named("audio")), F.when(i % 29 != 0, named("sub")), F.when(i % 31 != 0, named("card")), F.when(i % 5 != 0, named("crop")))
    files = pages.select(F.explode(there).alias("path"))
    rows = review.with_existing(rows, files, audio_there="audio", subtitle_there="subtitle", visual_there="card", source_there="crop")
    return quality.broken_rules(rows, ["scene_id"], review.asset_rules())


METRICS = IMAGE_SCENES + """, m AS (SELECT src_id, count(*)::BIGINT AS scenes, count(*) FILTER (WHERE status = 'rendered')::BIGINT AS rendered, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed, count(*) FILTER (WHERE spans > 0)::BIGINT AS scenes_with_evidence, count(*) FILTER (WHERE scene_kind IN ('penalty_table', 'checklist'))::BIGINT AS factual_scenes,
    count(*) FILTER (WHERE visual_type = 'generated_image')::BIGINT AS generated_images, count(*) FILTER (WHERE scene_kind IN ('source_visual_explainer', 'figure_explainer'))::BIGINT AS visual_first, count(*) FILTER (WHERE scene_kind IN ('source_visual_explainer', 'figure_explainer') AND coalesce(anchored, false))::BIGINT AS source_visual,
    count(*) FILTER (WHERE NOT coalesce(anchored, false) AND scene_kind <> 'cover')::BIGINT AS text_only, sum(coalesce(seconds, 0)) AS seconds, sum(CASE WHEN status = 'rendered' THEN coalesce(seconds, 0) ELSE 0 END) AS rendered_seconds,
    coalesce(round(avg(overlap) FILTER (WHERE scene_kind IN ('source_visual_explainer', 'figure_explainer')), 3), 0) AS mean_overlap FROM sc GROUP BY src_id), mm AS (SELECT *, round(source_visual / greatest(1, visual_first)::DOUBLE, 3) AS anchor_coverage FROM m)"""


@query(METRICS + " SELECT * FROM mm")
def scene_metrics(spark, d):
    return review.scene_metrics(image_scenes(spark, d), "src_id")


@query(METRICS + """, z AS (SELECT mm.*, (SELECT count(DISTINCT page) FROM sc WHERE sc.src_id = mm.src_id) AS pages_cited, q.page_count, q.image_count FROM mm LEFT JOIN (SELECT src_id, max(page_count) AS page_count, max(image_count) AS image_count FROM pdf_sources GROUP BY 1) q ON q.src_id = mm.src_id),
    r AS (SELECT *, 100.0::DOUBLE * pages_cited / greatest(1, coalesce(page_count, 1)) AS cov, abs(seconds - 120) / 120.0::DOUBLE * 100 AS off, abs(rendered_seconds - 120) / 120.0::DOUBLE * 100 AS foff, coalesce(image_count > 2, false) AND scenes > 0 AS rich FROM z)
    SELECT src_id, 'low_source_coverage' AS code, 'warning' AS severity, round(cov, 1) AS measure FROM r WHERE cov < 40 UNION ALL SELECT src_id, 'duration_off_target', 'warning', round(off, 1) FROM r WHERE off > 12 UNION ALL SELECT src_id, 'final_duration_off_target', 'warning', round(foff, 1) FROM r WHERE rendered_seconds > 0 AND foff > 8
    UNION ALL SELECT src_id, 'image_rich_but_few_source_visuals', 'warning', source_visual FROM r WHERE rich AND source_visual < greatest(1, scenes // 3) UNION ALL SELECT src_id, 'image_rich_but_mostly_text_cards', 'warning', text_only FROM r WHERE rich AND text_only > source_visual
    UNION ALL SELECT src_id, 'source_visuals_available_but_unused', 'warning', image_count FROM r WHERE image_count > 0 AND source_visual = 0""")
def source_review(spark, d):
    """Rules over whole sources, for a target of two minutes."""
    scenes = image_scenes(spark, d)
    cited = scenes.groupBy("src_id").agg(F.count_distinct("page").alias("pages_cited"))
    sources = table(spark, d, "pdf_sources").groupBy("src_id").agg(F.max("page_count").alias("page_count"), F.max("image_count").alias("useful_visuals"))
    rows = review.scene_metrics(scenes, "src_id").join(cited, "src_id").join(sources, "src_id", "left")
    rows = rows.withColumn("target_seconds", F.lit(120.0)).withColumn("visual_rich", F.col("useful_visuals") > 2)
    return quality.broken_rules(rows, ["src_id"], review.source_rules())


_TOPICS = docs.INVENTORY_SQL + f", tc AS ({docs._TOPIC})"


@query(_TOPICS.replace("WITH p AS", "WITH RECURSIVE p AS", 1) + """, wk AS (SELECT src_id, 0::BIGINT AS rank, []::INTEGER[] AS pages, []::VARCHAR[] AS topics, 0 AS n, false AS take FROM (SELECT DISTINCT src_id FROM tc)
    UNION ALL SELECT src_id, rank, CASE WHEN take THEN list_append(pages, page) ELSE pages END, CASE WHEN take THEN list_append(topics, topic) ELSE topics END, n + take::INTEGER, take FROM (SELECT tc.src_id, tc.rank, tc.page, tc.topic, wk.pages, wk.topics, wk.n,
        wk.n < 6 AND NOT list_contains(wk.pages, tc.page) AND (NOT list_contains(wk.topics, tc.topic) OR wk.n < 3) AS take FROM wk JOIN tc ON tc.src_id = wk.src_id AND tc.rank = wk.rank + 1)),
    al AS (SELECT src_id, rank, row_number() OVER (PARTITION BY src_id ORDER BY NOT take, rank) AS place FROM wk WHERE rank > 0) SELECT src_id, rank, place::INTEGER AS place FROM al WHERE place <= 6""")
def visual_selection(spark, d):
    """The walk over figures: one of a page, topics once from half of the places on, and the first others where places stay free."""
    return figures.selected_visuals(docs._topics(spark, d), 6).select("src_id", "rank", "place")


@query(docs.INVENTORY_SQL + """ SELECT image_id, CASE WHEN visual_role = 'source_table' THEN 'source_table_explainer' WHEN visual_role = 'source_screenshot' THEN 'source_screenshot_explainer' WHEN regexp_matches(blob, '步驟|流程|三部曲|設定|調整|workflow|step') THEN 'process_visual_card' WHEN visual_role IN ('source_diagram', 'source_chart') THEN 'figure_explainer' ELSE 'source_visual_explainer' END AS scene_kind,
    array_to_string(list_filter(CASE visual_role WHEN 'source_table' THEN ['先看欄位', '找關鍵列'] WHEN 'source_screenshot' THEN ['看按鈕位置', '留意設定值'] WHEN 'source_chart' THEN ['看分布方向', '找異常區段'] WHEN 'source_diagram' THEN ['先看流程', '再看因果'] ELSE ['觀察主體', '注意差異'] END
        || [CASE WHEN regexp_matches(blob, '光圈|景深') THEN '景深變化' END, CASE WHEN contains(blob, '快門') THEN '動作感' END, CASE WHEN regexp_matches(blob, 'iso|感光度') THEN '雜訊與亮度' END, CASE WHEN contains(blob, '白平衡') THEN '色溫偏移' END], lambda x: x IS NOT NULL)[1:4], '|') AS callouts FROM u""")
def visual_scene_kinds(spark, d):
    """What kind of scene a figure makes, and what its screen calls out."""
    inv = figures.inventory(table(spark, d, "pdf_images"), table(spark, d, "pdf_pages"), keep=("blob",))
    return inv.select("image_id", figures.scene_kind_of(F.col("visual_role"), F.col("blob")).alias("scene_kind"), F.array_join(figures.callouts_of(F.col("visual_role"), F.col("blob")), "|").alias("callouts"))


@query(docs.SCENES_SQL + """, t AS (SELECT src_id, sum(seconds) AS total, count(*) AS n FROM sd GROUP BY 1), s AS (SELECT src_id, seq, score, ceil((300 - total) / 18)::INTEGER AS room, least(facts, 8) AS cap FROM sd JOIN t USING (src_id) WHERE total < 240 AND facts > 0), e AS (SELECT src_id, seq, score, room, unnest(range(0, cap)) AS item FROM s),
    r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY item, score DESC, seq) <= room), a AS (SELECT src_id, seq, -1 AS item FROM sd UNION ALL SELECT src_id, seq, item FROM r)
    SELECT src_id, seq, item::INTEGER AS item, row_number() OVER (PARTITION BY src_id ORDER BY seq, item)::BIGINT AS place FROM a""")
def scenes_with_expansions(spark, d):
    """Scenes and, behind each, the extra cards that its source has room for, numbered anew."""
    s = docs._scenes(spark, d)
    totals = s.groupBy("src_id").agg(F.sum("seconds").alias("total"))
    slots = budget.padding(s.withColumn("capacity", F.least(F.col("facts"), F.lit(8))), totals, "src_id", 240.0, 300.0)
    return budget.inserted(s.select("src_id", "seq"), slots, "src_id")


@query(docs.SCENES_SQL + """, t AS (SELECT src_id, sum(seconds) AS total, count(*) AS n, sum(least(facts, 8)) AS capacity FROM sd GROUP BY 1), s AS (SELECT src_id, seq, score, ceil((300 - total) / 18)::INTEGER AS room, least(facts, 8) AS cap FROM sd JOIN t USING (src_id) WHERE total < 240 AND facts > 0), e AS (SELECT src_id, seq, score, room, unnest(range(0, cap)) AS item FROM s),
    r AS (SELECT src_id, count(*) AS k FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY item, score DESC, seq) <= room) GROUP BY 1)
    SELECT src_id, n::BIGINT AS base_scenes, coalesce(k, 0)::BIGINT AS expansions, capacity::BIGINT AS capacity, total + 18 * coalesce(k, 0) AS seconds, total + 18 * coalesce(k, 0) < 240 AS under_target FROM t LEFT JOIN r USING (src_id)""")
def selection_report(spark, d):
    s = docs._scenes(spark, d).withColumn("capacity", F.least(F.col("facts"), F.lit(8)))
    totals = s.groupBy("src_id").agg(F.sum("seconds").alias("total"))
    return budget.selection_report(s, budget.padding(s, totals, "src_id", 240.0, 300.0), "src_id", 240.0)


@query(docs.ITEMS_SQL + """, x AS (SELECT it.src_id, it.scene_kind, it.slot, it.ordinal, it.page_id, it.value, f0.label, f0.quote, row_number() OVER (PARTITION BY it.src_id, it.scene_kind, it.slot, it.ordinal ORDER BY f0.pattern_no, f0.start) AS k FROM it LEFT JOIN f0 ON f0.page_id = it.page_id AND f0.value = it.value WHERE it.value <> '')
    SELECT src_id, scene_kind, slot, ordinal, page_id, value, label, quote FROM x WHERE k = 1""")
def item_evidence(spark, d):
    """Items of cards with the first fact of their page that has their value; items without one stay."""
    facts = extract.facts(table(spark, d, "pdf_pages"), "page_id")
    return storyboard.first_facts(docs._items(spark, d), facts)


_EXPECTED = {
    "contract": ["期限|出發前|天內|天以上|deadline", "全額訂|30%|50%|75%|100%", r"nt\$|新台幣|新臺幣|金額|3,000", "護照|簽證|資料|名單", "拒絕登船|拒絕入境|不予退款|恕不退還|概不負責", "保險|疾病|適航證明|醫師", "不可抗力|行程|變更|無退費義務", "個人資料|蒐集|處理|利用|傳輸"],
    "form": ["姓名|身分證|護照|簽名|日期", "附件|資料|證明|護照|簽證", "期限|前|內"],
    "policy": ["適用|範圍|對象", "應|須|不得|必須", "違反|罰|風險|責任"],
    "paper": ["problem|目標|問題|研究", "method|方法|模型|實驗", "result|結果|%|提升", "limit|限制|未來"],
    "manual": ["前置|準備|需求", "步驟|操作|安裝|設定", "警告|注意|請勿|不得", "故障|排除|問題"],
    "report": ["摘要|summary|重點", "%|金額|指標|成長|下降", "風險|risk", "建議|recommend"],
    "slides": ["章節|section|重點", "takeaway|重點|回顧"],
}
_TYPES = {
    "contract": ["deadlines", "penalty_tiers", "fees_or_money", "required_documents", "no_refund_or_boarding_risk", "insurance_or_health", "force_majeure_or_itinerary_change", "personal_data"],
    "form": ["required_fields", "required_documents", "deadlines"], "policy": ["scope", "obligations", "penalties_or_risks"], "paper": ["problem_or_goal", "method", "results", "limitations"],
    "manual": ["prerequisites", "steps", "warnings", "troubleshooting"], "report": ["summary", "metrics", "risks", "recommendations"], "slides": ["sections", "takeaways"],
}


@query("SELECT doc_id, doc_kind, fact FROM documents d JOIN (VALUES " + ", ".join(f"('{k}', '{t}', '{w}')" for k, words in _EXPECTED.items() for t, w in zip(_TYPES[k], words, strict=True)) + ") v(kind, fact, words) ON v.kind = d.doc_kind WHERE NOT regexp_matches(lower(coalesce(text, '')), words)")
def missing_fact_types(spark, d):
    """What a document of its kind should name and does not."""
    rows = quality.expected_terms(table(spark, d, "documents"), "doc_id", "doc_kind", "text", quality.EXPECTED_FACTS)
    return rows.select("doc_id", "doc_kind", F.explode("missing").alias("fact"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 9 + 1) * 60.0 ELSE CASE doc_id % 3 WHEN 0 THEN 120.0 WHEN 1 THEN 300.0 ELSE 600.0 END END::DOUBLE AS target, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 9 + 1) * 54.0 ELSE CASE doc_id % 3 WHEN 0 THEN 90.0 WHEN 1 THEN 240.0 ELSE 480.0 END END::DOUBLE AS least,
    floor(CASE WHEN doc_id % 4 = 0 THEN (doc_id % 9 + 1) * 66.0 ELSE CASE doc_id % 3 WHEN 0 THEN 150.0 WHEN 1 THEN 360.0 ELSE 720.0 END END + 0.5)::DOUBLE AS most FROM documents""")
def length_windows(spark, d):
    i = F.col("doc_id")
    depth = F.get(F.array(F.lit("brief"), F.lit("standard"), F.lit("deep")), (i % 3).cast("int"))
    w = numeric.length_window(depth, F.when(i % 4 == 0, (i % 9 + 1).cast("string")))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", "w.target", "w.least", F.floor(F.col("w.most") + 0.5).cast("double").alias("most"))


_AUTO = {"contract": (1.4, 0.75, 3600), "policy": (1.4, 0.75, 3600), "form": (1.4, 0.75, 3600), "paper": (2.0, 0.55, 5000), "manual": (1.8, 0.5, 5200), "report": (2.0, 0.6, 4600), "slides": (1.5, 0.28, 6500)}
_auto = lambda i, other: "CASE lower(coalesce(doc_kind, '')) " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in _AUTO.items()) + f" ELSE {other} END::DOUBLE"


@query(f"SELECT doc_id, round_even(greatest(5.0, least(10.0, {_auto(0, 1.8)} + (doc_id % 12 + 1) * {_auto(1, 0.45)} + length(coalesce(text, '')) / {_auto(2, 5600)})) * 2, 0)::DOUBLE / 2 AS minutes FROM documents")
def automatic_minutes(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", numeric.auto_minutes(F.col("doc_kind"), F.col("doc_id") % 12 + 1, F.length(F.coalesce("text", F.lit(""))), F.lit("deep")).alias("minutes"))


# ---------------------------------------------------------------- grounding of scenes

def _claims(spark, d):
    """Scenes made of chunks, which cite the page of their own number, with evidence and facts; every fifth quotes something else."""
    i = F.col("chunk_key")
    pages = table(spark, d, "pdf_pages").select(F.col("page_id").alias("page"), "text")
    kind = F.get(F.array(*map(F.lit, ("cover", "checklist", "risk_warning", "paragraph_card"))), (i % 4).cast("int"))
    cited = F.when(i % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i, i + F.when(i % 7 == 0, 1_000_000_000).otherwise(0)))
    scenes = table(spark, d, "pdf_chunks").select(i.alias("scene_id"), kind.alias("scene_kind"), cited.alias("source_pages"))
    spans = scenes.filter("scene_id % 3 = 0").select("scene_id", F.lit(0).alias("idx"), F.when(F.col("scene_id") % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("scene_id")).alias("page"))
    quote = F.when(F.col("scene_id") % 5 == 0, "※ 完全不同的一句話 ※").otherwise(F.coalesce(F.substring("text", 1, 40), F.lit("")))
    spans = spans.join(pages, "page", "left").select("scene_id", "idx", "page", quote.alias("quote"))
    two = F.array(F.struct(F.lit(0).alias("idx"), F.lit(None).cast("int").alias("evidence_index")), F.struct(F.lit(1).alias("idx"), F.lit(9).alias("evidence_index")))
    facts = scenes.filter("scene_id % 2 = 0").select("scene_id", F.explode(two).alias("f")).select("scene_id", "f.idx", F.lit("期限").alias("label"), F.lit("high").alias("importance"), "f.evidence_index")
    return scenes, spans, facts, pages


_QUOTE = docs.FORM % "substring(p.text, 1, 40)"
_G = f"""WITH k AS (SELECT page_id AS page, text FROM pdf_pages), s AS (SELECT chunk_key AS scene_id, CASE chunk_key % 4 WHEN 0 THEN 'cover' WHEN 1 THEN 'checklist' WHEN 2 THEN 'risk_warning' ELSE 'paragraph_card' END AS kind, CASE WHEN chunk_key % 5 = 0 THEN []::BIGINT[] ELSE [chunk_key, chunk_key + CASE WHEN chunk_key % 7 = 0 THEN 1000000000 ELSE 0 END] END AS pages FROM pdf_chunks),
    n AS (SELECT scene_id, CASE WHEN scene_id % 2 = 0 THEN -1 ELSE scene_id END AS page FROM s WHERE scene_id % 3 = 0), f AS (SELECT scene_id, scene_id % 3 = 0 AS backed FROM s WHERE scene_id % 2 = 0)"""


@query(_G + f""", c AS (SELECT scene_id, unnest(range(0, len(pages))) AS idx, unnest(pages) AS page FROM s WHERE kind <> 'cover')
    SELECT scene_id, 1 AS rule_no, 0 AS idx, 'no_source_pages' AS code FROM s WHERE kind <> 'cover' AND len(pages) = 0 UNION ALL SELECT scene_id, 2, idx::INTEGER, 'bad_source_page' FROM c WHERE page NOT IN (SELECT page FROM k)
    UNION ALL SELECT scene_id, 3, 0, 'missing_evidence' FROM s WHERE kind IN ('checklist', 'risk_warning') AND scene_id NOT IN (SELECT scene_id FROM n) UNION ALL SELECT scene_id, 4, 0, 'bad_page' FROM n WHERE page NOT IN (SELECT page FROM k)
    UNION ALL SELECT scene_id, 5, 0, 'quote_mismatch' FROM n JOIN k p ON p.page = n.page WHERE scene_id % 5 = 0 OR coalesce(length({_QUOTE}), 0) = 0
    UNION ALL SELECT scene_id, 6, 0, 'fact_without_evidence' FROM f WHERE NOT backed UNION ALL SELECT scene_id, 7, 1, 'evidence_index_out_of_range' FROM f""")
def grounding_issues(spark, d):
    """All rules of grounding."""
    return ground.issues(*_claims(spark, d)).select("scene_id", "rule_no", "idx", "code")


@query(_G + f""", b AS (SELECT n.scene_id FROM n LEFT JOIN k p ON p.page = n.page WHERE p.page IS NULL OR scene_id % 5 = 0 OR coalesce(length({_QUOTE}), 0) = 0), e AS (SELECT scene_id FROM n WHERE scene_id NOT IN (SELECT scene_id FROM b))
    SELECT scene_id, (scene_id IN (SELECT scene_id FROM e))::BIGINT AS spans, (CASE WHEN scene_id % 2 = 1 THEN 0 WHEN scene_id IN (SELECT scene_id FROM b) THEN 1 ELSE 2 END)::BIGINT AS facts FROM s WHERE NOT (kind IN ('checklist', 'risk_warning') AND scene_id NOT IN (SELECT scene_id FROM e))""")
def grounding_repair(spark, d):
    """What one round of repair leaves of each scene."""
    scenes, spans, facts, _ = ground.repair_rounds(*_claims(spark, d))
    n = lambda df, name: df.groupBy("scene_id").agg(F.count(F.lit(1)).alias(name))
    return scenes.select("scene_id").join(n(spans, "spans"), "scene_id", "left").join(n(facts, "facts"), "scene_id", "left").na.fill(0, ["spans", "facts"])


@query("""SELECT doc_id, greatest(1, round_even((doc_id % 50 + 1) * 20 / 60.0::DOUBLE, 0))::INTEGER AS scenes, greatest(40, round_even((doc_id % 50 + 1) * 20 / greatest(1, round_even((doc_id % 50 + 1) * 20 / 60.0::DOUBLE, 0)) / 60.0::DOUBLE * 240, 0))::INTEGER AS chars FROM documents""")
def scene_lengths(spark, d):
    """How many scenes a length takes, and of how many characters."""
    chars, scenes = numeric.chars_per_scene((F.col("doc_id") % 50 + 1) * 20.0)
    return table(spark, d, "documents").select("doc_id", scenes.alias("scenes"), chars.alias("chars"))


@query("""SELECT i.image_id, greatest(0.0, bbox.x0 - 12) AS x0, greatest(0.0, bbox.y0 - 12) AS y0, least(p.w, bbox.x1 + 12) AS x1, least(p.h, bbox.y1 + 12 * 1.4::DOUBLE) AS y1 FROM pdf_images i JOIN (SELECT src_id, page, max(width) AS w, max(height) AS h FROM pdf_pages GROUP BY 1, 2) p ON p.src_id = i.src_id AND p.page = i.page WHERE bbox IS NOT NULL AND p.w IS NOT NULL AND p.h IS NOT NULL""")
def crop_boxes(spark, d):
    """Figures with a margin, clipped to their page."""
    sizes = table(spark, d, "pdf_pages").groupBy("src_id", "page").agg(F.max("width").alias("w"), F.max("height").alias("h")).filter("w IS NOT NULL AND h IS NOT NULL")
    rows = table(spark, d, "pdf_images").filter("bbox IS NOT NULL").join(sizes, ["src_id", "page"])
    return rows.select("image_id", numeric.expanded_box(F.col("bbox"), F.col("w"), F.col("h"), 12.0).alias("b")).select("image_id", "b.*")


@query("""WITH b AS (SELECT a.image_id, o.image_id AS other, o.bbox AS bb, o.caption_hint AS t FROM pdf_images a JOIN pdf_images o ON o.src_id = a.src_id AND o.page = a.page AND o.image_id <> a.image_id WHERE o.bbox.y0 >= a.bbox.y1 AND o.bbox.y0 - a.bbox.y1 <= 80 AND greatest(0.0, least(o.bbox.x1, a.bbox.x1) - greatest(o.bbox.x0, a.bbox.x0)) / greatest(1.0, a.bbox.x1 - a.bbox.x0) >= 0.25 AND length(trim(coalesce(o.caption_hint, o.sha256))) > 0)
    SELECT image_id, substring(string_agg(trim(coalesce(t, (SELECT sha256 FROM pdf_images q WHERE q.image_id = b.other))), ' ' ORDER BY bb.y0, trim(coalesce(t, (SELECT sha256 FROM pdf_images q WHERE q.image_id = b.other)))), 1, 200) AS caption FROM b GROUP BY 1""")
def texts_below_figures(spark, d):
    """What stands under each figure; the other figures of the page serve as blocks, by their caption or hash."""
    i = table(spark, d, "pdf_images").filter("bbox IS NOT NULL")
    images = i.select("image_id", F.col("src_id").alias("doc_id"), "page", "bbox")
    blocks = i.select(F.col("src_id").alias("doc_id"), "page", "bbox", F.coalesce("caption_hint", "sha256").alias("text"))
    return figures.captions_below(images, blocks)


# ---------------------------------------------------------------- state


@query("""SELECT event_type AS stage, count(*)::BIGINT AS total, count(*) FILTER (WHERE value > 95)::BIGINT AS completed, count(*) FILTER (WHERE value < 5)::BIGINT AS failed, max(ts) AS last_at FROM events GROUP BY 1""")
def status_summary(spark, d):
    """Counts of each stage by the state of its rows."""
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") > 95, "completed").when(F.col("value") < 5, "failed").otherwise("running").alias("status"), "ts")
    return state.summary(e, "stage", ["completed", "failed"], "ts")


@query("SELECT image_id AS artifact, src_id, sha256, count(*) OVER (PARTITION BY sha256)::BIGINT AS same_content FROM pdf_images WHERE width >= 400 AND page = 2")
def artifact_listing(spark, d):
    """Artifacts that meet the filters which are given, each with the number of listed ones of the same content."""
    rows = table(spark, d, "pdf_images").withColumnRenamed("image_id", "artifact")
    listed = state.listed(rows, {"page": 2, "project": None}).filter("width >= 400")
    return state.with_copies(listed, "sha256").select("artifact", "src_id", "sha256", "same_content")


@query("""SELECT chunk_key, sha256(coalesce(sha256(text), '') || '␟' || coalesce(spec_id::VARCHAR, '')) AS input_hash FROM pdf_chunks""")
def chained_hashes(spark, d):
    """The hash of a stage's input: that of what the stage before made, and the settings."""
    c = table(spark, d, "pdf_chunks")
    return c.select("chunk_key", state.chained_hash(F.sha2("text", 256), F.col("spec_id").cast("string")).alias("input_hash"))


@query("SELECT event_id, CASE WHEN value < 5 THEN 'pending' WHEN value > 95 THEN 'completed' ELSE 'running' END AS status, CASE WHEN value < 5 THEN 0 ELSE (event_id % 3)::INTEGER END AS retries FROM events")
def reset_failures(spark, d):
    """Failed rows set back to pending with no retries; all others as they are."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") > 95, "completed").when(F.col("value") < 5, "failed").otherwise("running").alias("status"), (F.col("event_id") % 3).cast("int").alias("retries"))
    return state.reset_failed(e)
