"""From facts and chunks to an ordered set of scenes: grouped items, outlines, cards and a recap.

Everything that the sequential procedure decides by what it has seen so far is written by its closed form over ranks, so no group is
walked through in one task: "first k" is a ranked filter, "first of its kind" a minimum per kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import short_context, strip
from leafmill.operators.sequence import numbered, page_islands

# Labels and words by which items are put in scenes.
TIMELINE_LABELS, NUMBER_LABELS, SHARE_LABELS = ["期限", "Deadline", "日期"], ["百分比", "金額", "數量"], ["百分比", "金額"]
OBLIGATION = "應 需 須 必須 務必 請 提供 繳交 繳付 繳納 攜帶 投保 檢查 遵守 簽名 護照 簽證 資料 shall must".split()
PENALTY = "違約 解約 賠償 退款 退還 取消 取消費 罰款 費用 手續費 變更 更改 更動 不予退款 無退費 penalty refund".split()
PROHIBITED, WANTED = "不得 禁止 勿 請勿 無法更動 恕無法".split(), "應 需 須 必須 請 務必".split()
RISK = "風險 警告 注意 禁止 不得 拒絕登船 拒絕入境 概不負責 恕不退還 不予退款 無退費 退款 退費義務 不可抗力 政府命令 停泊港 不負任何退款 額外費 交通安排 住宿 自付費用 無法更動 更動 保險 疾病 醫療 適航證明 醫師 健康 warning caution".split()
RISK_WEIGHTS = (
    (100, "拒絕登船 拒絕入境 不予退款 恕不退還 額外費 交通安排 住宿".split()), (90, "不可抗力 政府命令 停泊港 必要的變更 不負任何退款 無退費義務 退費義務".split()),
    (70, "保險 疾病 醫療 適航證明 醫師 健康 自付費用".split()), (40, "無法更動 更動 概不負責".split()), (-60, "個人資料 蒐集 處理 傳輸 利用".split()),
)


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def risk_score(sentence: Column) -> Column:
    """Sum of the weights of the word groups that a sentence names; each group counts once."""
    return sum((F.when(_any(sentence, words), weight).otherwise(0) for weight, words in RISK_WEIGHTS[1:]), F.when(_any(sentence, RISK_WEIGHTS[0][1]), RISK_WEIGHTS[0][0]).otherwise(0))


def scene_items(facts: DataFrame, sentences: DataFrame, conditions: DataFrame, group: str, most: int = 6) -> DataFrame:
    """group, scene_kind, slot, ordinal, page_id, text, value, condition: the first items of each kind of scene.

    facts: group, page_id, pattern_no, start, label, value, quote, near (PENALTY words around it); sentences: group, page_id, sentence_no, sentence; conditions: group,
    page_id, sentence_no, condition, value, sentence. A rank is limited within each task before the shuffle.
    """
    none = F.lit("")

    def ranked(rows, kind, slot, order, text, value=none, condition=none):
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        kept = rows.withColumn("ordinal", rank).filter(F.col("ordinal") <= most)
        return kept.select(group, F.lit(kind).alias("scene_kind"), F.lit(slot).alias("slot"), "ordinal", "page_id", text.alias("text"), value.alias("value"), condition.alias("condition"))

    place = ["page_id", "pattern_no", "start"]
    context = short_context(F.col("quote"), F.col("value"))
    said = ["page_id", "sentence_no"]
    short = F.substring("sentence", 1, 60)
    label = F.col("label")
    duties = facts.filter(_any(F.col("quote"), OBLIGATION))
    enough = duties.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select(group)
    # With fewer than three dated duties, sentences that state one follow.
    listed = duties.select(group, F.lit(0).alias("part"), *place, context.alias("text"), "value")
    told = sentences.filter(_any(F.col("sentence"), OBLIGATION)).join(enough, group, "left_anti")
    listed = listed.unionByName(told.select(group, F.lit(1).alias("part"), "page_id", F.col("sentence_no").cast("int").alias("pattern_no"), F.lit(0).alias("start"), short.alias("text"), none.alias("value")))
    rows = conditions.select(group, F.lit(0).alias("part"), "page_id", F.col("sentence_no").cast("int").alias("pattern_no"), F.lit(0).alias("start"), "condition", "value", F.col("sentence").alias("text"))
    shares = facts.filter(label.isin(SHARE_LABELS) & (_any(F.col("quote"), PENALTY) | F.col("near")))
    rows = rows.unionByName(shares.select(group, F.lit(1).alias("part"), *place, context.alias("condition"), "value", F.col("quote").alias("text")))
    first = F.min_by(F.struct("part", "pattern_no", "start", "text"), F.struct("part", "pattern_no", "start"))
    rows = rows.groupBy(group, "page_id", "condition", "value").agg(first.alias("f")).select(group, "page_id", "condition", "value", "f.*")
    bad = _any(F.col("sentence"), PROHIBITED)
    parts = [
        ranked(facts.filter(label.isin(TIMELINE_LABELS)), "deadline_timeline", "events", place, context, F.col("value")),
        ranked(facts.filter(label.isin(NUMBER_LABELS)), "key_number", "items", place, context, F.col("value")),
        ranked(listed, "checklist", "items", ["part", *place], F.col("text"), F.col("value")),
        ranked(rows, "penalty_table", "rows", ["part", *place], F.col("text"), F.col("value"), F.col("condition")),
        ranked(sentences.filter(_any(F.col("sentence"), RISK)).withColumn("_s", risk_score(F.col("sentence"))), "risk_warning", "items", [F.col("_s").desc(), *said], F.substring("sentence", 1, 140)),
        ranked(sentences.filter(bad), "do_dont", "dont", said, short),
        ranked(sentences.filter(~bad & _any(F.col("sentence"), WANTED)), "do_dont", "do", said, short),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def title_of(text: Column, headings: Column) -> Column:
    """The first heading that is not blank, else the first line of 4 to 60 characters, cut to 40; null if there is neither."""
    named = F.try_element_at(F.filter(F.transform(headings, strip), lambda h: F.length(h) > 0), F.lit(1))
    line = F.try_element_at(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x).between(4, 60)), F.lit(1))
    return F.substring(F.coalesce(named, line), 1, 40)


def key_points(text: Column, most: int = 3) -> Column:
    """The first lines of 8 characters or more, cut after 。 and to 80 characters."""
    lines = F.transform(F.split(F.replace(text, F.lit("。"), F.lit("。\n")), "\n"), strip)
    return F.transform(F.slice(F.filter(lines, lambda x: F.length(x) >= 8), 1, most), lambda x: F.substring(x, 1, 80))


def outline(chunks: DataFrame, minutes: float) -> DataFrame:
    """src_id, chapter_no, title, first_page, last_page, points: chunks in equal runs, as many as the length has room for.

    A title is the first heading of any chunk of the run, else the first line of the first that has one.
    """
    desired = max(1, round(max(1.0, minutes) / 1.5))
    # A chunk that was written twice counts once.
    c = chunks.groupBy("src_id", "chunk_id").agg(F.min_by(F.struct("chunk_key", "start_page", "end_page", "text", "headings"), "chunk_key").alias("c")).select("src_id", "c.*")
    c = numbered(c, "src_id", ["chunk_key"], "_no")
    sizes = c.groupBy("src_id").agg(F.count(F.lit(1)).alias("_n"))
    run = F.ceil(F.col("_n") / F.least(F.lit(desired), F.col("_n")))
    c = c.join(sizes, "src_id").withColumn("chapter_no", (F.floor((F.col("_no") - 1) / run) + 1).cast("int"))
    t = F.coalesce("text", F.lit(""))
    empty = F.array().cast("array<string>")
    c = c.select("src_id", "chapter_no", "_no", "start_page", "end_page", title_of(F.lit(""), F.coalesce("headings", empty)).alias("_h"), title_of(t, empty).alias("_l"), key_points(t).alias("_p"))
    first = lambda col: F.min_by(col, F.when(F.col(col).isNotNull(), F.col("_no")))
    heads = c.groupBy("src_id", "chapter_no").agg(F.coalesce(first("_h"), first("_l")).alias("title"), F.min_by("start_page", "_no").alias("first_page"), F.max_by("end_page", "_no").alias("last_page"))
    points = c.select("src_id", "chapter_no", "_no", F.posexplode("_p").alias("_i", "point"))
    rank = F.row_number().over(Window.partitionBy("src_id", "chapter_no").orderBy("_no", "_i"))
    points = points.withColumn("_r", rank).filter("_r <= 3").groupBy("src_id", "chapter_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "point"))), lambda x: x["point"]).alias("points"))
    rows = heads.join(points, ["src_id", "chapter_no"], "left")
    fallback = F.concat(F.lit("第 "), F.col("chapter_no").cast("string"), F.lit(" 段重點"))
    return rows.select("src_id", "chapter_no", F.coalesce("title", fallback).alias("title"), "first_page", "last_page", F.coalesce("points", empty).alias("points"))


def topic_anchors(candidates: DataFrame, desired: int) -> DataFrame:
    """src_id, page: the pages of the first candidates, of new topics only once half of the places are taken.

    candidates: src_id, rank (by page, salience, id), page, topic. The walk "take all up to half, then only unseen topics" takes a
    candidate if its rank is within the half, or if no candidate of its topic comes before it; of those the first `desired`.
    """
    half = desired // 2
    firsts = candidates.groupBy("src_id", "topic").agg(F.min("rank").alias("rank")).select("src_id", "rank", F.lit(True).alias("_first"))
    c = candidates.join(firsts, ["src_id", "rank"], "left").filter((F.col("rank") <= half) | F.col("_first"))
    place = F.row_number().over(Window.partitionBy("src_id").orderBy("rank"))
    return c.withColumn("_p", place).filter(F.col("_p") <= desired).select("src_id", "page").distinct()


def recap_items(scenes: DataFrame, group: str, left_out: list[str], most: int = 5) -> DataFrame:
    """group, ordinal, text, page_id: the first distinct titles, what follows the last middle dot of each, cut to 24 characters."""
    bullet = strip(F.substring_index("title", "·", -1))
    t = scenes.filter(~F.coalesce("scene_kind", F.lit("")).isin(left_out)).select(group, "seq", "page_id", bullet.alias("b")).filter(F.length("b") > 0)
    t = t.groupBy(group, "b").agg(F.min("seq").alias("seq"), F.min_by("page_id", "seq").alias("page_id"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("seq"))
    return t.withColumn("ordinal", rank).filter(F.col("ordinal") <= most).select(group, "ordinal", F.substring("b", 1, 24).alias("text"), "page_id")


def storyboard(chapters: DataFrame, items: DataFrame, group: str, kinds: list[str]) -> DataFrame:
    """group, part, chapter_no, kind_no, scene_kind, items: a cover, each chapter's opening, a card per kind with items, and a recap."""
    docs = chapters.select(group).distinct()
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("scene_kind")).cast("int")
    cards = items.groupBy(group, "scene_kind").agg(F.count(F.lit(1)).alias("items")).withColumn("kind_no", order).filter("kind_no > 0")
    row = lambda df, part, chapter, no, kind, n: df.select(group, F.lit(part).alias("part"), chapter.alias("chapter_no"), no.alias("kind_no"), kind.alias("scene_kind"), n.cast("long").alias("items"))
    zero = F.lit(0)
    return (
        row(docs, 0, zero, zero, F.lit("cover"), zero).unionByName(row(chapters, 1, F.col("chapter_no"), zero, F.lit("section_intro"), F.size("points")))
        .unionByName(row(cards, 2, zero, F.col("kind_no"), F.col("scene_kind"), F.col("items"))).unionByName(row(docs, 3, zero, zero, F.lit("recap_card"), zero))
    )


def every_kth(rows: DataFrame, group: str, order: str, minutes: float = 8.0, seconds: float = 60.0) -> DataFrame:
    """Rows after which a recap is put in: every k-th of a group, not the first."""
    k = max(1, round(minutes * 60.0 / seconds))
    placed = numbered(rows, group, [order], "_no").withColumn("_no", F.col("_no") - 1)
    return placed.filter((F.col("_no") > 0) & (F.col("_no") % k == 0)).drop("_no")


# Words that set two pictures against each other.
CONTRAST = "比較 對比 before after 淺 深 高 低 冷 暖".split()


def comparison_pairs(candidates: DataFrame, group: str, words: list[str] = CONTRAST) -> DataFrame:
    """group, left_id, right_id: neighbouring candidates, two pages apart at most, whose texts name a contrast; each is used once.

    The walk "pair with the next and go on behind it" pairs every second place of a run of pairable neighbours; runs are found by
    anti-joins. candidates: group, idx (from 1, without gaps), id, page, blob.
    """
    right = candidates.select(group, (F.col("idx") - 1).alias("idx"), F.col("id").alias("right_id"), F.col("page").alias("_rp"), F.col("blob").alias("_rb"))
    near = candidates.join(right, [group, "idx"]).filter((F.col("_rp") - F.col("page") <= 2) & _any(F.concat_ws(" ", "blob", "_rb"), words))
    runs = page_islands(near.select(group, "idx"), group, "idx")
    starts = runs.select(group, F.explode(F.sequence("first", "last", F.lit(2).cast("long"))).alias("idx"))
    return near.join(starts, [group, "idx"]).select(group, F.col("id").alias("left_id"), "right_id")


def first_facts(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Items that have a value, with label and quote of the first fact of their page with that value; null where there is none.

    items: src_id, scene_kind, slot, ordinal, page_id, value; facts: page_id, pattern_no, start, value, label, quote. First by pattern and
    place, as a partial aggregate before the join.
    """
    first = facts.groupBy("page_id", "value").agg(F.min_by(F.struct("label", "quote"), F.struct("pattern_no", "start")).alias("f"))
    return items.filter(F.length("value") > 0).join(first, ["page_id", "value"], "left").select("src_id", "scene_kind", "slot", "ordinal", "page_id", "value", "f.label", "f.quote")
