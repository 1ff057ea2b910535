"""Figures of documents: inventory, captions, and matching to passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.numeric import area_ratio, clamp
from leafmill.functions.text import strip, word_tokens
from leafmill.operators.classify import DECORATIVE_ROLES, DECORATIVE_TERMS, ROLE_TERMS, figure_role, holds_any


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per (src_id, page): the read that came last. max_by combines on the map side, so a hot page costs one row per task."""
    rest = [c for c in pages.columns if c not in ("src_id", "page")]
    last = F.max_by(F.struct(*rest), F.struct("ingested_at", "page_id")).alias("r")
    return pages.groupBy("src_id", "page").agg(last).select("src_id", "page", "r.*")


def first_heading(headings: Column, text: Column) -> Column:
    """The first heading that is not blank, else the first line of 4 to 80 characters, cut to 80."""
    named = F.try_element_at(F.filter(F.transform(headings, strip), lambda h: F.length(h) > 0), F.lit(1))
    line = F.try_element_at(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x).between(4, 80)), F.lit(1))
    return F.substring(F.coalesce(named, line), 1, 80)


def nearby_text(text: Column, caption: Column) -> Column:
    """The page as one line: around the caption where it stands in the text, else its beginning; 300 characters at most."""
    clean = F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > 0), " ")
    at = F.position(caption, clean)
    begin = F.greatest(at - 121, F.lit(0))
    near = F.substring(strip(F.substring(clean, begin + 1, at - 1 - begin + F.length(caption) + 160)), 1, 300)
    return F.when((F.length(caption) > 0) & (at > 0), near).otherwise(F.substring(clean, 1, 300))


def is_decorative(role: Column, area: Column, repeated: Column, at_edge: Column, blob: Column) -> Column:
    return role.isin(DECORATIVE_ROLES) | (holds_any(blob, DECORATIVE_TERMS) & (area < 0.12)) | (repeated & (area < 0.08)) | at_edge


def salience(role: Column, area: Column, pixels: Column, caption: Column, heading: Column, repeated: Column, decorative: Column) -> Column:
    add = lambda cond, points: F.when(cond, points).otherwise(0.0)
    score = F.least(F.lit(4.0), area * 12.0) + F.least(F.lit(2.0), pixels / 500000.0) + add(F.length(caption) > 0, 0.8) + add(F.length(heading) > 0, 0.4)
    score += add(role.isin([r for r, _ in ROLE_TERMS]), 1.0) + add(role == "source_page_crop", 0.5) - add(repeated, 0.8) - add(decorative, 3.0)
    return F.greatest(F.lit(0.0), score)


def inventory(images: DataFrame, pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Images with the role, use and salience that the page around them gives. Images without a page are left out.

    A logo repeats on many pages: its count is a partial aggregate joined back, not a window over the copies. Only pages with an image are
    put in order of their reads, so the texts of the others are never shuffled.
    """
    p = latest_pages(pages.join(images.select("src_id", "page").distinct(), ["src_id", "page"], "left_semi")).select("src_id", "page", F.coalesce("text", F.lit("")).alias("_text"), F.coalesce("headings", F.array().cast("array<string>")).alias("_headings"), F.col("width").alias("_pw"), F.col("height").alias("_ph"))
    copies = images.groupBy("src_id", "sha256").agg(F.count(F.lit(1)).alias("copies"))
    rows = images.filter(F.col("pixel_count").isNotNull()).join(copies, ["src_id", "sha256"]).join(p, ["src_id", "page"])
    caption, repeated = F.coalesce("caption_hint", F.lit("")), F.col("copies") > 2
    area = area_ratio(F.col("bbox"), F.col("_pw"), F.col("_ph"))
    rows = rows.select("image_id", "src_id", "page", "pixel_count", "bbox", "_pw", "_ph", caption.alias("caption"), repeated.alias("repeated"), area.alias("area"), first_heading(F.col("_headings"), F.col("_text")).alias("heading"), nearby_text(F.col("_text"), caption).alias("nearby"))
    b = F.col("bbox")
    sized = b.isNotNull() & (F.col("_pw") != 0) & (F.col("_ph") != 0)
    blob = F.lower(F.concat_ws(" ", "caption", F.coalesce("heading", F.lit("")), "nearby"))
    small = F.coalesce(sized & ((b["x1"] - b["x0"]) < F.col("_pw") * 0.25) & ((b["y1"] - b["y0"]) < F.col("_ph") * 0.18), F.lit(False))
    edge = F.coalesce(sized & (F.col("area") < 0.05) & ((b["y1"] < F.col("_ph") * 0.18) | (b["y0"] > F.col("_ph") * 0.82)) & ((b["x1"] - b["x0"]) < F.col("_pw") * 0.35), F.lit(False))
    rows = rows.withColumn("blob", blob).withColumn("visual_role", figure_role(F.col("blob"), F.col("area"), F.col("repeated"), small))
    rows = rows.withColumn("is_decorative", is_decorative(F.col("visual_role"), F.col("area"), F.col("repeated"), edge, F.col("blob")))
    useful = ~F.col("is_decorative") & ~F.col("visual_role").isin(DECORATIVE_ROLES) & ((F.col("area") >= 0.045) | (F.col("pixel_count") >= 90000) | (F.length("caption") > 0))
    rows = rows.withColumn("likely_useful", useful)
    score = salience(F.col("visual_role"), F.col("area"), F.col("pixel_count"), F.col("caption"), F.coalesce("heading", F.lit("")), F.col("repeated"), F.col("is_decorative"))
    return rows.withColumn("salience_milli", F.floor(score * 1000 + 0.5).cast("long")).select("image_id", "src_id", "page", "pixel_count", "caption", "visual_role", "is_decorative", "likely_useful", "repeated", "salience_milli", F.floor(F.col("area") * 10000 + 0.5).cast("long").alias("area_e4"), *keep)


def page_candidates(pages: DataFrame, useful: DataFrame, most: int = 60) -> DataFrame:
    """Whole pages worth showing where no useful image is: sparse slides and image-heavy pages, the best `most` of each source.

    A top-k report: the rank is limited within each task before the shuffle.
    """
    p = latest_pages(pages).join(useful.select("src_id", "page").distinct(), ["src_id", "page"], "left_anti")
    image, text = F.coalesce("image_area_ratio", F.lit(0.0)), F.coalesce("text_area_ratio", F.lit(0.0))
    headed = F.coalesce(F.size("headings"), F.lit(0)) > 0
    sparse = (F.coalesce("cjk_char_count", F.lit(0)) < 450) & (headed | (image > 0.12))
    p = p.filter((image >= 0.18) | (sparse & (text < 0.55)))
    score = F.least(F.lit(4.0), image * 9.0) + F.when(sparse, 1.0).otherwise(0.0) + F.when(headed, 0.5).otherwise(0.0)
    low = F.lower(F.coalesce("text", F.lit("")))
    role = F.lit("source_page_crop")
    for name, terms in reversed(ROLE_TERMS[:4]):
        role = F.when(holds_any(low, terms), name).otherwise(role)
    p = p.select("src_id", "page", role.alias("visual_role"), F.floor(score * 1000 + 0.5).cast("long").alias("salience_milli"))
    best = Window.partitionBy("src_id").orderBy(F.col("salience_milli").desc(), "page")
    return p.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def captions_below(images: DataFrame, blocks: DataFrame, gap: float = 80.0, most: int = 200) -> DataFrame:
    """image_id, caption: text blocks under an image, near enough and overlapping a quarter of its width, from top to bottom.

    images: image_id, doc_id, page, bbox; blocks: doc_id, page, bbox, text. The join is on the page, the geometry a predicate on top.
    """
    b = blocks.select("doc_id", "page", F.col("bbox").alias("bb"), strip(F.col("text")).alias("_t"))
    pairs = images.select("image_id", "doc_id", "page", F.col("bbox").alias("ib")).join(b, ["doc_id", "page"])
    wide = F.greatest(F.lit(1.0), F.col("ib.x1") - F.col("ib.x0"))
    lap = F.greatest(F.lit(0.0), F.least("bb.x1", "ib.x1") - F.greatest("bb.x0", "ib.x0"))
    near = (F.col("bb.y0") >= F.col("ib.y1")) & (F.col("bb.y0") - F.col("ib.y1") <= gap) & (lap / wide >= 0.25) & (F.length("_t") > 0)
    listed = pairs.filter(near).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("bb.y0").alias("y"), F.col("_t").alias("t")))).alias("l"))
    return listed.select("image_id", F.substring(F.array_join(F.transform("l", lambda x: x["t"]), " "), 1, most).alias("caption"))


def figure_scores(passages: DataFrame, images: DataFrame) -> DataFrame:
    """passage_id, image_id, score_milli for the figures on a passage's pages and one page to either side.

    passages: passage_id, src_id, start_page, end_page, words. The band becomes an equi-join: a passage is sent to each page of its own
    and to its two neighbours.
    """
    p = passages.filter(F.col("start_page") <= F.col("end_page")).select("passage_id", "src_id", "start_page", "words", F.explode(F.sequence(F.col("start_page") - 1, F.col("end_page") + 1)).alias("page"))
    i = images.select("src_id", "page", "image_id", "pixel_count", word_tokens(F.coalesce("caption_hint", F.lit(""))).alias("_tokens"))
    pairs = p.join(i, ["src_id", "page"])
    away = F.abs(F.col("page") - F.col("start_page"))
    near = F.when(away == 0, 5.0).when(away == 1, 2.5).when(away == 2, 1.0).otherwise(0.0)
    shared = F.size(F.array_intersect("words", "_tokens"))
    score = near + F.least(F.lit(3.0), shared * 0.6) + clamp((F.col("pixel_count") - 40000) / 600000.0, 0.0, 2.0)
    return pairs.select("passage_id", "src_id", "image_id", F.floor(score * 1000 + 0.5).cast("long").alias("score_milli"))


def best_figures(scored: DataFrame, least_milli: int = 3000) -> DataFrame:
    """The best figure of each passage, from a least score on; ties go to the smaller image id."""
    fit = scored.filter(F.col("score_milli") >= least_milli)
    best = F.min_by(F.struct("image_id", "score_milli"), F.struct((-F.col("score_milli")).alias("s"), "image_id"))
    return fit.groupBy("passage_id").agg(best.alias("b")).select("passage_id", "b.image_id", "b.score_milli")


def spread_figures(scored: DataFrame, least_milli: int = 3000, penalty_milli: int = 700) -> DataFrame:
    """passage_id, image_id: greedy assignment in passage order, each use of a figure costing its next users a penalty.

    What a passage chooses depends on earlier passages only through the figures they share. In each round every passage chooses with the
    uses that earlier passages would make by their last choices; passages whose earlier rivals no longer change are settled, at least one
    of every chain of rivals in a round, so this ends. Once a round changes nothing, the choices are those of the sequential procedure. Rows are (passage, figure) pairs of neighbouring pages; a
    figure is near a few passages only, so the window over it is short.
    """
    from leafmill.session import materialize

    pairs = materialize(scored, "figure-pairs")
    choice = None
    while True:
        if choice is None:
            used = pairs.withColumn("uses", F.lit(0))
        else:
            marked = pairs.join(choice.withColumn("_c", F.lit(1)), ["passage_id", "image_id"], "left")
            before = Window.partitionBy("image_id").orderBy("passage_id").rowsBetween(Window.unboundedPreceding, -1)
            used = marked.withColumn("uses", F.coalesce(F.sum(F.coalesce("_c", F.lit(0))).over(before), F.lit(0))).drop("_c")
        now = used.withColumn("score_milli", F.col("score_milli") - F.lit(penalty_milli) * F.col("uses"))
        chosen = materialize(best_figures(now, least_milli).select("passage_id", "image_id"), "figure-choice")
        if choice is not None and chosen.join(choice, ["passage_id", "image_id"], "left_anti").isEmpty() and choice.join(chosen, ["passage_id", "image_id"], "left_anti").isEmpty():
            return chosen
        choice = chosen


# Words of a procedure, and what the screen calls out by role and by words.
PROCEDURE_WORDS = ["步驟", "流程", "三部曲", "設定", "調整", "workflow", "step"]
CALLOUTS = {"source_table": ["先看欄位", "找關鍵列"], "source_screenshot": ["看按鈕位置", "留意設定值"], "source_chart": ["看分布方向", "找異常區段"], "source_diagram": ["先看流程", "再看因果"]}
OTHER_CALLOUTS = ["觀察主體", "注意差異"]
WORD_CALLOUTS = [(["光圈", "景深"], "景深變化"), (["快門"], "動作感"), (["iso", "感光度"], "雜訊與亮度"), (["白平衡"], "色溫偏移")]


def scene_kind_of(role: Column, blob: Column) -> Column:
    """The kind of scene that a figure makes; blob: what stands around it, in lower case."""
    kind = F.when(role == "source_table", "source_table_explainer").when(role == "source_screenshot", "source_screenshot_explainer")
    return kind.when(holds_any(blob, PROCEDURE_WORDS), "process_visual_card").when(role.isin("source_diagram", "source_chart"), "figure_explainer").otherwise("source_visual_explainer")


def callouts_of(role: Column, blob: Column, most: int = 4) -> Column:
    """What the screen calls out, by role and then by words around the figure."""
    words = lambda w: F.array(*map(F.lit, w))
    by_role = F.lit(None).cast("array<string>")
    for name, told in CALLOUTS.items():
        by_role = F.when(role == name, words(told)).otherwise(by_role)
    more = F.array_compact(F.array(*(F.when(holds_any(blob, w), told) for w, told in WORD_CALLOUTS)))
    return F.slice(F.concat(F.coalesce(by_role, words(OTHER_CALLOUTS)), more), 1, most)


def selected_visuals(candidates: DataFrame, desired: int) -> DataFrame:
    """src_id, rank, page, topic, place: figures in the order of rank, one of a page, of new topics only once half of the places are taken;
    places that stay free go to the first of the others.

    candidates: src_id, rank (from 1, by page), page, topic. The first half are the first figures of the first pages. From then on a choice
    rules out others by page and by topic, so each further place is one round: the least rank of each source that nothing chosen rules
    out, by a partial aggregate. The chosen of a source are `desired` at most and travel as arrays.
    """
    from leafmill.session import materialize

    rows = materialize(candidates.select("src_id", "rank", "page", "topic"), "visual-candidates")
    half = desired // 2
    firsts = rows.groupBy("src_id", "page").agg(F.min("rank").alias("rank"))
    early = firsts.withColumn("_p", F.row_number().over(Window.partitionBy("src_id").orderBy("rank"))).filter(F.col("_p") <= half).select("src_id", "rank")
    chosen = materialize(rows.join(early, ["src_id", "rank"]), "visual-chosen")
    for _ in range(desired - half):
        taken = chosen.groupBy("src_id").agg(F.collect_set("page").alias("_pages"), F.collect_set("topic").alias("_topics"), F.count(F.lit(1)).alias("_n"))
        open_ = rows.join(taken.filter(F.col("_n") >= half), "src_id").filter(~F.array_contains("_pages", F.col("page")) & ~F.array_contains("_topics", F.col("topic")))
        more = materialize(open_.groupBy("src_id").agg(F.min_by(F.struct("rank", "page", "topic"), "rank").alias("c")).select("src_id", "c.*"), "visual-chosen")
        if more.isEmpty():
            break
        chosen = chosen.unionByName(more)
    marked = rows.join(chosen.select("src_id", "rank", F.lit(0).alias("_late")), ["src_id", "rank"], "left").na.fill(1, ["_late"])
    order = Window.partitionBy("src_id").orderBy("_late", "rank")
    return marked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= desired).select("src_id", "rank", "page", "topic", "place")


def source_path(crop: Column, image: Column, page_render: Column) -> Column:
    """The first path of a candidate that is not empty."""
    return F.coalesce(*(F.when(F.length(c) > 0, c) for c in (crop, image, page_render)))


def source_quote(text: Column, heading: Column, caption: Column, most: int = 160) -> Column:
    """What a figure is quoted by: its caption or heading where the page holds it, else the first line of 8 to 160 characters."""
    held = [F.when((F.length(c) > 0) & F.contains(text, c), c) for c in (caption, heading)]
    line = F.try_element_at(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x).between(8, most)), F.lit(1))
    return F.substring(F.coalesce(*held, line), 1, most)
