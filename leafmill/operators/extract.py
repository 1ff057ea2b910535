"""Facts in text: typed matches with their place, value and the sentence part around them.

The pattern table is a parameter. One projection applies all patterns to a row and flattens the matches, so a table is scanned once and
nothing is shuffled. Every match, however many a text has, becomes a row; two patterns that hit the same span give one row, of the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import WS, first_match, near_any, short_context, split_sentences, surrounding_quote, trim_quote


@dataclass(frozen=True)
class Pattern:
    """A kind of fact: group 1 of the expression is its value. The expression must not match an empty text."""

    kind: str
    expression: str
    label: str
    importance: str


_D, _S = r"\p{Nd}", WS + "*"
_DAYS = f"(?:天|日)"
_TAIL = "(?:以上|以內|內|前)?"
# The patterns of facts, most specific first.
PATTERNS = (
    Pattern("deadline_range", f"((?:出發|開始|旅遊開始)?前{_S}{_D}+{_S}(?:-|~|–|—|至){_S}{_D}+{_S}{_DAYS}{_TAIL})", "期限", "high"),
    Pattern("deadline_threshold", f"((?:出發|開始|旅遊開始)?前{_S}{_D}+{_S}{_DAYS}(?:（含{_S}{_D}+{_S}{_DAYS}內）)?{_TAIL})", "期限", "high"),
    Pattern("deadline", f"(?:於|在|限|應於)?{_S}({_D}+{_S}(?:天|日|個月|月|年|工作天|工作日)){_S}(?:內|前|以內)", "期限", "high"),
    Pattern("deadline", f"(?i:within|no later than){WS}+({_D}+{WS}+(?i:days|day|weeks|week|months|month|years|year))", "Deadline", "high"),
    Pattern("deadline_cjk", "([零〇一二兩三四五六七八九十百千萬]+(?:天|日|個月|月|年))(?:內|前|以內)", "期限", "high"),
    Pattern("absolute_date", f"({_D}{{4}}{_S}年{_S}{_D}{{1,2}}{_S}月{_S}{_D}{{1,2}}{_S}日)", "日期", "medium"),
    Pattern("absolute_date", f"({_D}{{4}}-{_D}{{2}}-{_D}{{2}})", "日期", "medium"),
    Pattern("percent", f"({_D}{{1,3}}(?:\\.{_D}+)?{_S}%)", "百分比", "high"),
    Pattern("percent_cjk", f"(百分之[一二三四五六七八九十百零〇{_D}]+)", "百分比", "high"),
    Pattern("money", f"((?:NT\\$|US\\$|USD|TWD|新台幣|新臺幣|台幣|臺幣|美金|美元|歐元|港幣|人民幣|NTD){_S}[{_D},]+(?:\\.{_D}+)?(?:{_S}(?:元|圓))?)", "金額", "high"),
    Pattern("money_plain", f"({_D}{{1,3}}(?:,{_D}{{3}})+{_S}(?:元|圓|塊))", "金額", "high"),
    Pattern("count", f"({_D}+{_S}(?:人|件|份|名|張|筆|次|期|頁))", "數量", "medium"),
)


def _spans(text: Column, no: int, p: Pattern) -> Column:
    """array<struct<no,start,match,value>> of all matches: the gaps between them give their places."""
    gaps, hits = F.split(text, p.expression, -1), F.regexp_extract_all(text, F.lit(p.expression), F.lit(0))
    # Where the group is the whole pattern, its matches are the values.
    values = hits if _whole_group(p.expression) else F.regexp_extract_all(text, F.lit(p.expression), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<no:int,start:int,match:string,value:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        one = F.struct(F.lit(no).alias("no"), start.cast("int").alias("start"), x["hit"].alias("match"), x["value"].alias("value"))
        return F.struct((start + F.length(x["hit"])).cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # The last gap has no match behind it; zip only as far as there are matches.
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    # Most patterns are not in most texts: one search decides whether a text is split.
    return F.when(text.rlike(p.expression), F.aggregate(zipped, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<no:int,start:int,match:string,value:string>>"))


def _whole_group(expression: str) -> bool:
    """Whether the first group spans the whole expression."""
    depth = 0
    for i, c in enumerate(expression):
        if c in "()" and expression[i - 1 : i] != "\\":
            depth += 1 if c == "(" else -1
            if depth == 0:
                return i == len(expression) - 1 and expression.startswith("(") and not expression.startswith("(?")
    return False


def facts(rows: DataFrame, *keys: str, text: str = "text", patterns: tuple[Pattern, ...] = PATTERNS, near: list[str] | None = None) -> DataFrame:
    """keys, pattern_no, kind, label, importance, start, value, quote for every fact of every row, in the order of the patterns.

    With `near`, also whether one of these words stands around the value's first place in the text.
    """
    t = F.col(text)
    every = F.flatten(F.array(*(_spans(t, k, p) for k, p in enumerate(patterns))))
    same = lambda x, y: (x["start"] == y["start"]) & (F.length(x["match"]) == F.length(y["match"]))
    fresh = F.filter("_spans", lambda x: ~F.exists("_spans", lambda y: (y["no"] < x["no"]) & same(x, y)))
    found = rows.filter(t.isNotNull()).select(*keys, t.alias("_text"), every.alias("_spans"))
    # Values and quotations are made inside the row, so the filter on them is not evaluated a second time.
    told = F.transform(fresh, lambda s: F.struct(s["no"].alias("no"), s["start"].alias("start"), trim_quote(s["value"], 40).alias("value"), surrounding_quote(F.col("_text"), s["start"], s["match"]).alias("quote")))
    if near:
        told = F.transform(told, lambda s: s.withField("near", near_any(F.col("_text"), s["value"], near)))
    found = found.select(*keys, F.explode(F.filter(told, lambda s: (F.length(s["value"]) > 0) & (F.length(s["quote"]) > 0))).alias("s"))
    about = F.element_at(F.array(*(F.struct(F.lit(p.kind).alias("kind"), F.lit(p.label).alias("label"), F.lit(p.importance).alias("importance")) for p in patterns)), F.col("s.no") + 1)
    out = found.select(*keys, F.col("s.no").alias("pattern_no"), about.alias("p"), F.col("s.start").alias("start"), F.col("s.value").alias("value"), F.col("s.quote").alias("quote"), *([F.col("s.near").alias("near")] if near else []))
    out = out.select(*keys, "pattern_no", "p.kind", "p.label", "p.importance", "start", "value", "quote", *(["near"] if near else []))
    return out


def sentences(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, sentence_no (from 0), sentence."""
    return rows.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(split_sentences(F.col(text))).alias("sentence_no", "sentence"))


def keyword_sentences(rows: DataFrame, *keys: str, words: list[str], most: int = 140) -> DataFrame:
    """Sentences that hold one of the words, cut to `most` characters: a semi-join written as one alternation."""
    alternation = "|".join(_literal(w) for w in words)
    return sentences(rows, *keys).filter(F.col("sentence").rlike(alternation)).withColumn("sentence", F.substring("sentence", 1, most))


def _literal(word: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in word)


def condition_rows(rows: DataFrame, *keys: str, words: list[str], conditions: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Sentences with a keyword that state both a condition and a value: keys, sentence_no, condition, value, sentence."""
    found = sentences(rows, *keys).filter(F.col("sentence").rlike("|".join(map(_literal, words))))
    found = found.withColumn("condition", first_match(conditions, F.col("sentence"))).withColumn("value", first_match(values, F.col("sentence")))
    found = found.filter((F.length("condition") > 0) & (F.length("value") > 0))
    return found.select(*keys, "sentence_no", trim_quote(F.col("condition"), 52).alias("condition"), trim_quote(F.col("value"), 28).alias("value"), trim_quote(F.col("sentence"), 160).alias("sentence"))


def contexts(found: DataFrame) -> DataFrame:
    """Facts with the short context of their value."""
    return found.withColumn("context", short_context(F.col("quote"), F.col("value")))
