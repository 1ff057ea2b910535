"""Classification of documents by weighted lexicons and counts, and of figures by ordered terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import count_words

# The lexicon of each kind, in the order that breaks ties. A word may stand in two lists and counts in both.
LEXICON = {
    "contract": "甲方 乙方 丙方 雙方 簽署 簽訂 簽約 本合約 本契約 本協議 條款 違約 違約金 賠償 解約 終止 授權 授權範圍 費用 付款 預付 尾款 保證金 押金 訂金 取消費用 取消者 退費 不予退款 概不負責 旅客 郵輪 護照 簽證 agreement contract shall hereby obligation warranty indemnif".split(),
    "form": [*"申請書 申請表 請填寫 請勾選 個人資料 姓名 身分證 護照 簽名 蓋章 日期 聯絡電話 電子郵件 地址 □ ☐ form".split(), "please fill", "tick"],
    "paper": [*"abstract introduction method methods methodology experiment experiments result results discussion conclusion references".split(), "related work", *"ablation 摘要 緒論 方法 實驗 結果 結論 參考文獻".split()],
    "manual": "步驟 安裝 設定 啟動 操作 故障 排除 注意事項 注意 警告 前置作業 前置條件 操作說明 使用說明 保固 install setup step guide troubleshoot warning caution".split(),
    "report": [*"摘要 本季 本年 年度 指標 趨勢 成長 分析 建議 風險 績效 報告 市場".split(), "executive summary", *"kpi quarter annual forecast performance trend".split()],
    "policy": [*"政策 辦法 規範 條例 守則 適用範圍 適用對象 本辦法 本規範 本守則 違反 policy compliance".split(), "applies to", *"regulation 防疫措施 公告 個人資料保護".split()],
}
# Terms of tutorials, and patterns of deadlines, shares and amounts that are counted.
TUTORIAL_TERMS = "步驟 技巧 設定 模式 範例 實戰 如何 操作 練習 示意 對比 比較 畫面 截圖 光圈 快門 iso 感光度 曝光 景深 直方圖 白平衡 對焦 測光 鏡頭 camera photo tutorial workflow example screenshot".split()
_D, _S = r"\p{Nd}", r"[\s\x0B\p{Z}]"
COUNTED = {
    "deadlines": (f"{_D}+{_S}*(天|日)內", f"{_D}+{_S}*(個月|月)內", f"{_D}+{_S}*個?(工作天|工作日)", f"於{_S}*{_D}+{_S}*(天|日|月)", f"(?i:within|no later than){_S}+{_D}+{_S}+(?i:days|day|weeks|week|months|month)"),
    "shares": (f"{_D}{{1,3}}{_S}*%|百分之[一二三四五六七八九十百零〇{_D}]+",),
    "amounts": (f"(NT\\$|US\\$|USD|TWD|新台幣|台幣|美元|歐元|港幣){_S}*[{_D},]+|{_D}{{1,3}}(,{_D}{{3}})+{_S}*(元|圓|塊)",),
}
# Terms by which the role of a figure is told, tried in this order.
ROLE_TERMS = (
    ("source_table", "表 table 欄 列 row column".split()),
    ("source_screenshot", "截圖 畫面 介面 選單 按鈕 menu button screenshot panel".split()),
    ("source_chart", "圖表 直方圖 histogram chart curve graph 色階".split()),
    ("source_diagram", "流程 步驟 示意 diagram 三角 結構 原理".split()),
    ("source_photo", "相片 照片 攝影 範例 實戰 photo image example".split()),
)
DECORATIVE_TERMS = "logo 標誌 版權 copyright 印章 圖章 seal stamp 簽名 signature".split()
DECORATIVE_ROLES = ["decorative", "logo", "seal", "signature"]


def text_signals(pages: DataFrame, key: str, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Per document: hits of each lexicon, of the counted patterns and tutorial terms. Counted per page, summed with partial sums."""
    lexicon = LEXICON if lexicon is None else lexicon
    low, text = F.lower(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))
    counts = {f"hits_{k}": count_words(F.col("_low"), w) for k, w in lexicon.items()}
    counts |= {k: sum((F.regexp_count(F.col("_text"), F.lit(p)) for p in ps[1:]), F.regexp_count(F.col("_text"), F.lit(ps[0]))) for k, ps in COUNTED.items()}
    counts["tutorial"] = count_words(F.col("_low"), TUTORIAL_TERMS)
    rows = pages.select(key, low.alias("_low"), text.alias("_text"), "cjk_char_count", "headings")
    rows = rows.select(key, *(c.alias(n) for n, c in counts.items()), "cjk_char_count", F.coalesce(F.size("headings"), F.lit(0)).alias("_headings"))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("cjk_char_count", F.lit(0))).alias("cjk_chars"), F.sum(F.greatest(F.col("_headings"), F.lit(0))).alias("heading_count"), *(F.sum(n).alias(n) for n in counts)
    )


def visual_rich_score(useful, decorative, large, pages, images_per_page, cjk_per_page, tutorial, headings_per_page) -> Column:
    """Sum of thresholds that tell documents that live by their figures; 0 at least."""
    per_page, large_share = useful / pages, large / pages
    add = lambda cond, points: F.when(cond, points).otherwise(0.0)
    score = add(useful >= 3, 1.0) + add(per_page >= 0.20, 1.5) + add(per_page >= 0.45, 1.0) + add(large_share >= 0.18, 1.5) + add(large_share >= 0.40, 1.0)
    score += add(images_per_page >= 0.45, 0.8) + add((cjk_per_page < 550) & ((per_page >= 0.15) | (headings_per_page >= 0.6)), 0.8) + add(tutorial >= 4, 0.8) + add(tutorial >= 10, 0.8)
    return F.greatest(F.lit(0.0), score - add((decorative > useful) & (useful < 3), 1.5))


def document_scores(signals: DataFrame) -> DataFrame:
    """Signals with score_<kind>: hits by the root of the page count, with the bonuses of each kind."""
    root = F.greatest(F.lit(1.0), F.sqrt(F.col("pages").cast("double")))
    add = lambda cond, points: F.when(cond, points).otherwise(0.0)
    cjk, heads, images = (F.col(c) / F.col("pages") for c in ("cjk_chars", "heading_count", "image_count"))
    rich = visual_rich_score(F.col("useful"), F.col("decorative"), F.col("large_pages"), F.col("pages"), images, cjk, F.col("tutorial"), heads)
    rows = signals.withColumn("visual_rich_score", F.round(rich, 3))
    for kind in LEXICON:
        rows = rows.withColumn(f"score_{kind}", F.col(f"hits_{kind}") / root)
    rows = rows.withColumn("score_slides", F.when((heads < 0.5) & (images < 0.3), 0.0).otherwise(add(cjk < 250, 2.0) + add(heads >= 0.7, 1.5) + add(images >= 0.4, 1.0)))
    rows = rows.withColumn("score_contract", F.col("score_contract") + (add(F.col("deadlines") >= 3, 1.5) + add(F.col("amounts") >= 2, 1.0) + add(F.col("shares") >= 3, 0.8)))
    free = (F.col("score_contract") < 2.0) & (F.col("score_form") < 2.0) & (F.col("score_policy") < 2.0)
    taught = F.least(F.lit(3.0), F.col("tutorial") / F.greatest(F.lit(2.0), F.sqrt(F.col("pages").cast("double"))) * 0.8)
    rows = rows.withColumn("score_manual", F.col("score_manual") + F.when(free, taught + add((F.col("visual_rich_score") >= 3.0) & (F.col("tutorial") >= 2), 1.5)).otherwise(0.0))
    rows = rows.withColumn("score_slides", F.col("score_slides") + F.when(free & (F.col("visual_rich_score") >= 3.0) & (cjk < 300), 1.0).otherwise(0.0))
    rows = rows.withColumn("score_report", F.col("score_report") + add((F.col("score_contract") < 1.0) & (F.col("shares") + F.col("amounts") >= 5), 1.5))
    return rows.withColumn("score_paper", F.when(F.col("hits_paper") < 2, F.col("score_paper") * 0.6).otherwise(F.col("score_paper")))


def document_kinds(scored: DataFrame, key: str) -> DataFrame:
    """key, doc_kind, confidence_milli: the best score, and its lead over the runner-up in thousandths of it. Ties: the lexicon's order.

    The scores of one document are a short list inside its row; no window is needed to rank them.
    """
    kinds = [*LEXICON, "slides"]
    ranked = F.array_sort(F.array(*(F.struct((-F.col(f"score_{k}")).alias("minus"), F.lit(i).alias("no"), F.lit(k).alias("kind")) for i, k in enumerate(kinds))))
    rows = scored.withColumn("_r", ranked)
    top, second = -F.get("_r", F.lit(0))["minus"], -F.get("_r", F.lit(1))["minus"]
    none = top <= 0
    lead = F.when(none, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top - second) / top)) * 1000 + 0.5))
    return rows.select(key, F.when(none, F.lit("unknown")).otherwise(F.get("_r", F.lit(0))["kind"]).alias("doc_kind"), lead.cast("long").alias("confidence_milli"), "visual_rich_score", "useful", *(f"hits_{k}" for k in LEXICON))


def holds_any(blob: Column, terms: list[str]) -> Column:
    """Whether a lower-case text holds one of the terms."""
    return blob.rlike("|".join(t.lower() for t in terms))


def figure_role(blob: Column, area: Column, repeated: Column, small: Column) -> Column:
    """Role of a figure by an ordered cascade over the lower-case text around it. small: well below page size."""
    role = F.when(holds_any(blob, ["簽名", "signature"]), "signature").when(holds_any(blob, ["印章", "圖章", "seal", "stamp"]), "seal")
    role = role.when(holds_any(blob, ["logo", "標誌"]) & (area < 0.12), "logo").when(repeated & (area < 0.06), "decorative")
    for name, terms in ROLE_TERMS:
        role = role.when(holds_any(blob, terms), name)
    return role.when(area >= 0.16, "source_photo").when(small, "decorative").otherwise("unknown")
