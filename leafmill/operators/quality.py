"""Quality rules as data: each is a predicate and a measure; one pass evaluates all of a group, one generator emits the issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """code, severity, the condition under which a row breaks it, and the number it reports."""

    code: str
    severity: str
    broken: Column
    measure: Column


def broken_rules(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """keys, code, severity, measure: a row per broken rule. The rules are a literal array, so the input is read once."""
    listed = F.array(*(F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.when(F.coalesce(r.broken, F.lit(False)), r.measure.cast("double")).alias("measure"), F.coalesce(r.broken, F.lit(False)).alias("b")) for r in rules))
    return rows.select(*keys, F.explode(F.filter(listed, lambda r: r["b"])).alias("r")).select(*keys, "r.code", "r.severity", "r.measure")


def page_quality(pages: DataFrame, group: str) -> DataFrame:
    """Per group: pages, and how many are empty, from text recognition or both text and image free; the share of empty ones."""
    source = F.coalesce("text_source", F.lit(""))
    return pages.groupBy(group).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(source == "empty").alias("empty_pages"), F.count_if(source == "ocr").alias("ocr_pages"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("blank_pages"),
    )


def page_rules(most_empty: float = 0.2) -> list[Rule]:
    """Rules over page_quality; 20 % empty pages and more are reported as many."""
    c = F.col
    return [
        Rule("empty_pdf_pages", "warning", c("empty_pages") > 0, c("empty_pages")),
        Rule("ocr_pages", "info", c("ocr_pages") > 0, c("ocr_pages")),
        Rule("many_empty_pages", "error", c("empty_pages") >= most_empty * c("pages"), c("empty_pages")),
        Rule("blank_text_with_source", "warning", c("blank_pages") > c("empty_pages"), c("blank_pages") - c("empty_pages")),
    ]


# What a document of each kind is expected to name, and the words that name it.
EXPECTED_FACTS = {
    "contract": {
        "deadlines": ["期限", "出發前", "天內", "天以上", "deadline"], "penalty_tiers": ["全額訂", "30%", "50%", "75%", "100%"], "fees_or_money": [r"nt\$", "新台幣", "新臺幣", "金額", "3,000"], "required_documents": ["護照", "簽證", "資料", "名單"],
        "no_refund_or_boarding_risk": ["拒絕登船", "拒絕入境", "不予退款", "恕不退還", "概不負責"], "insurance_or_health": ["保險", "疾病", "適航證明", "醫師"], "force_majeure_or_itinerary_change": ["不可抗力", "行程", "變更", "無退費義務"], "personal_data": ["個人資料", "蒐集", "處理", "利用", "傳輸"],
    },
    "form": {"required_fields": ["姓名", "身分證", "護照", "簽名", "日期"], "required_documents": ["附件", "資料", "證明", "護照", "簽證"], "deadlines": ["期限", "前", "內"]},
    "policy": {"scope": ["適用", "範圍", "對象"], "obligations": ["應", "須", "不得", "必須"], "penalties_or_risks": ["違反", "罰", "風險", "責任"]},
    "paper": {"problem_or_goal": ["problem", "目標", "問題", "研究"], "method": ["method", "方法", "模型", "實驗"], "results": ["result", "結果", "%", "提升"], "limitations": ["limit", "限制", "未來"]},
    "manual": {"prerequisites": ["前置", "準備", "需求"], "steps": ["步驟", "操作", "安裝", "設定"], "warnings": ["警告", "注意", "請勿", "不得"], "troubleshooting": ["故障", "排除", "問題"]},
    "report": {"summary": ["摘要", "summary", "重點"], "metrics": ["%", "金額", "指標", "成長", "下降"], "risks": ["風險", "risk"], "recommendations": ["建議", "recommend"]},
    "slides": {"sections": ["章節", "section", "重點"], "takeaways": ["takeaway", "重點", "回顧"]},
}


def expected_terms(blobs: DataFrame, key: str, kind: str, blob: str, needles: dict[str, dict[str, list[str]]]) -> DataFrame:
    """key, kind, found, missing: which of the expected facts of its kind a text names. needles: kind -> fact -> words."""
    listed = F.create_map(*(x for k, facts in needles.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(f).alias("fact"), F.lit("|".join(w)).alias("words")) for f, w in facts.items())))))
    rows = blobs.select(key, kind, F.lower(F.coalesce(F.col(blob), F.lit(""))).alias("_b"), F.try_element_at(listed, F.col(kind)).alias("_n")).filter("_n IS NOT NULL")
    named = lambda want: F.transform(F.filter("_n", lambda n: F.rlike(F.col("_b"), n["words"]) == want), lambda n: n["fact"])
    return rows.select(key, kind, named(True).alias("found"), named(False).alias("missing"))
