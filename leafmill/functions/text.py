"""Text functions as Column expressions. They stay inside the JVM; only Unicode composition, which Spark lacks, goes through Arrow.

Patterns are written so that Java's and RE2's engines read them alike: digits as \\p{Nd} and white space as WS, both the full
Unicode classes. Defined results: null in, null out; an empty text gives empty lists and zero counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space in the sense of Unicode, with the ASCII separators that text tools count as well; inside and as a class.
WS_IN = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WS = f"[{WS_IN}]"
#: The same characters one by one, for trimming without a pattern.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# The blocks that count as CJK characters.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{3134F}\x{F900}-\x{FAFF}"
# Sentence marks, and marks that are trimmed from the ends of a quotation.
SENTENCE_MARKS = "。．.!?！？；;"
TRIMMED_MARKS = "，。、；：,.;:!?！？\n\r\t"
# How headings look.
HEADINGS = (r"^第[一二三四五六七八九十百千零〇\p{Nd}]+[章節篇課]", r"^(?i:chapter|section|part)" + WS + r"+\p{Nd}+", r"^\p{Nd}+(\.\p{Nd}+){0,3}" + WS + r"+[^" + WS_IN + "]")
#: Only texts with one of these can change under canonical composition.
MAY_COMPOSE = r"[\x{0300}-\x{036F}\x{0340}\x{0341}\x{0374}\x{037E}\x{0387}\x{0591}-\x{05C7}\x{0610}-\x{065F}\x{0900}-\x{0DFF}\x{0F00}-\x{0FFF}\x{1000}-\x{11FF}\x{1B00}-\x{1C7F}\x{1E00}-\x{20FF}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{302A}-\x{302F}\x{3099}\x{309A}\x{A66F}-\x{ABFF}\x{AC00}-\x{D7FF}\x{F900}-\x{FB4F}\x{FE20}-\x{FE2F}\x{10000}-\x{1FFFF}\x{2F800}-\x{2FA1F}]"


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Canonical composition. Texts that cannot change pass the Python boundary as nulls."""
    needs = F.coalesce(text.rlike(MAY_COMPOSE), F.lit(False))
    return F.when(needs, _composed(F.when(needs, text))).otherwise(text)


def cjk_char_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{CJK}]"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def normalise_text(text: Column) -> Column:
    """Composed, blanks collapsed, at most one empty line in a row, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(nfc(text), r"[ \t\r\f\x0B]+", " "), "\n{3,}", "\n\n"))


def looks_like_heading(line: Column) -> Column:
    s = strip(line)
    return (F.length(s) > 0) & (F.length(s) <= 60) & s.rlike("|".join(f"(?:{p})" for p in HEADINGS))


def extract_headings(text: Column, max_lines: int = 200) -> Column:
    return F.transform(F.filter(F.slice(F.split(text, "\n"), 1, max_lines), looks_like_heading), strip)


def split_sentences(text: Column) -> Column:
    """Lines joined without a space, cut after sentence marks, trimmed, without empty ones. Decimals are cut, too."""
    flat = F.regexp_replace(strip(text), f"{WS}*\n{WS}*", "")
    return F.filter(F.transform(F.split(flat, f"(?<=[{SENTENCE_MARKS}]){WS}*"), strip), lambda s: F.length(s) > 0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_quote(text: Column, most: int = 80) -> Column:
    """Without white space and marks at the ends, cut to `most` characters and without marks at the cut."""
    marks = F.lit(TRIMMED_MARKS)
    return bound(strip(F.btrim(strip(text), marks)), lambda s: F.when(F.length(s) <= most, s).otherwise(F.rtrim(F.substring(s, 1, most), marks)))


def surrounding_quote(text: Column, start: Column, match: Column, window: int = 60) -> Column:
    """The match with what stands around it in its sentence, `window` characters to either side at most. start counts from 0."""
    left = F.substring(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)))
    right = F.substring(text, start + F.length(match) + 1, F.lit(window))
    return trim_quote(F.concat(F.regexp_replace(left, f"(?s)^.*[{SENTENCE_MARKS}]", ""), match, F.regexp_extract(right, f"^([^{SENTENCE_MARKS}]*[{SENTENCE_MARKS}]?)", 1)))


def short_context(quote: Column, anchor: Column, most: int = 60) -> Column:
    """The quote near the anchor: 20 characters before and 30 after its first occurrence."""
    at = F.locate(anchor, quote) if isinstance(anchor, str) else F.expr("0") + F.position(anchor, quote)
    begin = F.greatest(at - 21, F.lit(0))
    near = F.substring(quote, begin + 1, at - 1 - begin + F.length(anchor) + 30)
    return F.when((F.length(anchor) > 0) & (at > 0), trim_quote(near, most)).otherwise(trim_quote(quote, most))


def first_match(patterns: tuple[str, ...], text: Column) -> Column:
    """Group 1 of the first pattern that matches, else an empty text."""
    return F.coalesce(*(F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in patterns), F.lit(""))


def word_tokens(text: Column) -> Column:
    """Distinct runs of letters, figures and underscores of two or more characters, in lower case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda t: F.length(t) >= 2))


def overlap_share(screen: Column, spoken: Column) -> Column:
    """Share of the tokens of one list that stand in the other; 0 if either is empty."""
    n = F.size(screen)
    return F.when((n > 0) & (F.size(spoken) > 0), F.size(F.array_intersect(screen, spoken)) / n).otherwise(0.0)


def overlap_tokens(text: Column) -> Column:
    """Tokens for comparing narration with a screen: words, and pairs and triples of CJK characters.

    Consecutive Latin words are glued until a CJK character ends them, and the CJK sequence ignores the words between.
    The glue depends on what stood before, so this runs per value in Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _overlap_tokens(x))

    return tokens(text)


_TOKEN = re.compile("[A-Za-z0-9_]+|[㐀-鿿]")


def _overlap_tokens(text: str) -> list[str]:
    found: dict[str, None] = {}
    glued, cjk = "", []
    for token in [*_TOKEN.findall(unicodedata.normalize("NFKC", text).lower()), None]:
        if token is None or "㐀" <= token <= "鿿":
            if len(glued) >= 2:
                found[glued] = None
            glued = ""
            if token:
                cjk.append(token)
        else:
            glued += token
    grams = cjk if len(cjk) <= 3 else ["".join(cjk[i : i + n]) for n in (2, 3) for i in range(len(cjk) - n + 1)]
    return [*found, *dict.fromkeys(grams)]


def grounding_form(text: Column) -> Column:
    """Composed, without white space, full-width and curly marks as ASCII: the form in which quotations are compared."""
    return F.translate(F.regexp_replace(nfc(text), f"{WS}+", ""), "‘’“”，。！？：；／（）", "''\"\",.!?:;/()")


def quote_match_ratio(quote: Column, page: Column) -> Column:
    """The largest share of a quotation that stands in the page, both in grounding form: 1, or one of the steps below, or 0."""
    n = F.length(quote)
    steps = (1.0, 0.9, 0.75, 0.6, 0.45, 0.3)  # fixed values
    size = lambda share: F.floor(n * share).cast("int")

    def hit(share):
        s = size(share)
        starts = F.sequence(F.lit(0), n - s, F.greatest(F.lit(1), F.floor(s / 4).cast("int")))
        return (s >= 6) & F.exists(starts, lambda i: F.contains(page, F.substring(quote, i + 1, s)))

    ratio = F.when(F.contains(page, quote), 1.0)
    for share in steps[1:]:
        ratio = ratio.when(hit(share), size(share) / n)
    return F.when((n > 0) & (F.length(page) > 0), ratio.otherwise(0.0)).otherwise(0.0)


def overlap_of(candidate: str | None, source: str | None, window: int) -> float:
    """The share of one text; see verbatim_overlap. Runs of the source are looked up by their hash and compared where it is met."""
    n = len(candidate or "")
    if n < window or not source:
        return 0.0
    met = {hash(source[i : i + window]) for i in range(len(source) - window + 1)}
    at = hits = 0
    while at <= n - window:
        run = candidate[at : at + window]
        if hash(run) in met and run in source:
            hits += window
            at += window
        else:
            at += 1
    return min(1.0, hits / n)


def verbatim_overlap(candidate: Column, source: Column, window: int = 30) -> Column:
    """Share of a text covered by runs of `window` characters that stand in the source; a hit jumps over its run, a miss by one. 0 for a null text.

    The jumps depend on what was found before, so this is a walk, in Arrow batches; it takes time in proportion to both texts.
    """

    @F.pandas_udf("double")
    def share(c: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([overlap_of(x, y, window) for x, y in zip(c, s, strict=True)], dtype="float64")

    return share(candidate, source)


def subtitle_cues(text: Column, most: int = 22) -> Column:
    """Cuts after a mark or line end, or at `most` characters; trimmed, without empty ones."""
    ends = "。．.!?！？\n"
    pattern = f"[^{ends}]{{0,{most - 1}}}[{ends}]|[^{ends}]{{{most}}}|[^{ends}]+"
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), strip), lambda s: F.length(s) > 0)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; rounding carries into the seconds only."""
    t = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(t)
    ms = F.round((t - whole) * 1000).cast("int")
    s = (whole % 60).cast("int") + F.when(ms == 1000, 1).otherwise(0)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600).cast("int"), F.floor((t % 3600) / 60).cast("int"), s, F.when(ms == 1000, 0).otherwise(ms))


def ass_time(seconds: Column) -> Column:
    t = F.greatest(seconds, F.lit(0.0))
    return F.format_string("%d:%02d:%05.2f", F.floor(t / 3600).cast("int"), F.floor((t % 3600) / 60).cast("int"), t % 60)


def speech_pieces(text: Column, most: int = 80) -> Column:
    """Pieces of at most `most` characters for a speech engine: sentences, else clauses, else cuts; then packed again greedily."""
    cut = lambda marks: f"(?<=[{marks}]){WS}*"
    clean = F.regexp_replace(strip(text), f"{WS}+", " ")
    hard = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{most}}}"), F.lit(0)), strip)
    clause = lambda s: F.flatten(F.transform(F.filter(F.transform(F.split(s, cut("，、,：:")), strip), lambda c: F.length(c) > 0), hard))
    sentences = F.filter(F.transform(F.split(clean, cut("。！？!?；;")), strip), lambda s: F.length(s) > 0)
    pieces = F.filter(F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(clause(s)))), lambda p: F.length(p) > 0)

    def pack(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(last, p)
        fits = last.isNotNull() & (F.length(joined) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(pieces, F.array().cast("array<string>"), pack)


# Chinese figures and places.
_FIGURES, _PLACES = "零一二三四五六七八九", ((10**4, "萬"), (1000, "千"), (100, "百"), (10, "十"))


def number_zh(n: int) -> str:
    """A number below 10^8 in Chinese figures, larger ones figure by figure."""
    if n < 0:
        return "負" + number_zh(-n)
    if n >= 10**8:
        return "".join(_FIGURES[int(c)] for c in str(n))
    if n < 10:
        return _FIGURES[n]
    size, name = next((s, p) for s, p in _PLACES if n >= s)
    high, rest = divmod(n, size)
    head = "" if size == 10 and high == 1 else number_zh(high)
    gap = "零" if rest and size > 10 and rest < size // 10 else ""
    return head + name + (gap + number_zh(rest) if rest else "")


# What is read out, in this order: pattern and how its groups are spoken.
_SPOKEN = (
    (re.compile(r"(?:NT\$|NTD\s*)\s*([0-9][0-9,]*)\s*(?:元)?", re.I), lambda m: f"新臺幣{number_zh(int(m[1].replace(',', '')))}元"),
    (re.compile(r"([0-9][0-9,]*)\s*元"), lambda m: f"{number_zh(int(m[1].replace(',', '')))}元"),
    (re.compile(r"(\d{1,3})\s*[%％]"), lambda m: f"百分之{number_zh(int(m[1]))}"),
    (re.compile(r"(\d{1,3})\s*[-~～－–—]\s*(\d{1,3})\s*天"), lambda m: f"{number_zh(int(m[1]))}到{number_zh(int(m[2]))}天"),
    (re.compile(r"(\d{1,3})\s*天"), lambda m: f"{number_zh(int(m[1]))}天"),
    (re.compile(r"\b((?:19|20)\d{2})\b"), lambda m: "".join(_FIGURES[int(c)] for c in m[1])),
    (re.compile(r"\b(MSC|FIT)\b"), lambda m: " ".join(m[1])),
)


def spoken_text(text: Column) -> Column:
    """Amounts, percentages, day ranges, years and acronyms as they are read out. Callback substitution needs Python, in Arrow batches."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        def one(x):
            for pattern, speak in _SPOKEN if x is not None else ():
                x = pattern.sub(speak, x)
            return x

        return s.map(one)

    return read(text)


def page_runs(pages: Column) -> Column:
    """A set of page numbers as "1-3,5". The list is one row's own, so its runs are found inside the row."""
    p = F.array_sort(F.array_distinct(pages))
    firsts = F.filter(p, lambda x: ~F.array_contains(p, x - 1))
    lasts = F.filter(p, lambda x: ~F.array_contains(p, x + 1))
    return F.array_join(F.zip_with(firsts, lasts, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))), ",")


def stable_hash(*parts: Column) -> Column:
    """SHA-256 over the JSON of each part, joined by a symbol that JSON does not use."""
    return F.sha2(F.concat_ws("␟", *(F.to_json(F.struct(p.alias("v"))) for p in parts)), 256)


def count_words(text: Column, words: list[str]) -> Column:
    """Sum over the words of their non-overlapping occurrences in a lower-case text; each word counts on its own."""
    # Bytes are known without a walk through the text, characters are not.
    counted = [((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(w)))) / len(w.encode())).cast("int") for w in words]
    return sum(counted[1:], counted[0]) if counted else F.lit(0)


def near_any(text: Column, anchor: Column, words: list[str], around: int = 40) -> Column:
    """Whether one of the words stands within so many characters of the anchor's first occurrence; false without one."""
    at = F.position(anchor, text)
    begin = F.greatest(at - 1 - around, F.lit(0))
    window = F.substring(text, begin + 1, at - 1 - begin + F.length(anchor) + around)
    return F.coalesce((F.length(anchor) > 0) & (at > 0) & window.rlike("|".join(words)), F.lit(False))


def joined_text(*parts: Column) -> Column:
    """Texts and lists of texts as lines, without empty ones: array columns and string columns, in order."""
    return F.array_join(F.filter(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)), lambda x: F.length(x) > 0), "\n")


def first_named(text: Column, table: list[tuple[str, list[str]]], other: str) -> Column:
    """The first name whose words a text holds, in any letter case."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, words in table:
        hit = low.rlike("|".join(w.lower() for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other) if out is not None else F.lit(other)


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, long words broken."""
    import textwrap

    @F.pandas_udf("array<string>")
    def wrap(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else textwrap.wrap(x, width, break_long_words=True))

    return wrap(text)
