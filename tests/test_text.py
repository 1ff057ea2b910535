"""Text functions against plain Python written from their definitions."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from leafmill.functions import numeric, text


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[1] for r in df.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()]


RNG = random.Random(7)
ALPHABET = "ab 甲乙。．.!?，、；:\n\t3５%元天年é　"
TEXTS = [None, "", " ", "\n\n\n", "é", "3.5 公尺", "甲" * 205, *("".join(RNG.choice(ALPHABET) for _ in range(RNG.randrange(1, 140))) for _ in range(150))]


def clean(t):
    t = unicodedata.normalize("NFC", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\r\f\v]+", " ", t)).strip()


def sentences(t):
    flat = re.sub(r"\s*\n\s*", "", t.strip())
    return [s.strip() for s in re.split(r"(?<=[。．.!?！？；;])\s*", flat) if s.strip()]


def cues(t, most=22):
    out, cur = [], ""
    for c in t:
        cur += c
        if c in "。．.!?！？\n" or len(cur) >= most:
            out, cur = out + [cur.strip()], ""
    return [c for c in [*out, cur.strip()] if c]


def pieces(t, most=80):
    t = re.sub(r"\s+", " ", t.strip())
    parts = []
    for s in (x.strip() for x in re.split(r"(?<=[。！？!?；;])\s*", t)):
        if s and len(s) <= most:
            parts.append(s)
        elif s:
            for c in (x.strip() for x in re.split(r"(?<=[，、,：:])\s*", s)):
                while len(c) > most:
                    parts.append(c[:most].strip())
                    c = c[most:]
                if c.strip():
                    parts.append(c.strip())
    out = []
    for p in parts:
        if out and len(out[-1]) + len(p) <= most:
            out[-1] += p
        else:
            out.append(p)
    return out


@pytest.mark.parametrize(
    ("make", "plain"),
    [
        (text.normalise_text, clean),
        (text.split_sentences, sentences),
        (text.subtitle_cues, cues),
        (text.speech_pieces, pieces),
        (text.cjk_char_count, lambda t: sum("一" <= c <= "鿿" for c in t)),
        (lambda c: text.trim_quote(c, 20), lambda t: trim(t, 20)),
    ],
)
def test_function_equals_plain_python(spark, make, plain):
    got = column(spark, TEXTS, make)
    assert got == [None if t is None else plain(t) for t in TEXTS]


def trim(t, most):
    bad = "，。、；：,.;:!?！？\n\r\t"
    t = t.strip().strip(bad).strip()
    return t if len(t) <= most else t[:most].rstrip(bad)


def test_composition_of_marked_letters(spark):
    values = ["é", "が", "Å", "豈", "plain", None]
    assert column(spark, values, text.nfc) == [None if v is None else unicodedata.normalize("NFC", v) for v in values]


def test_verbatim_overlap_jumps_over_hits(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        source = "".join(rng.choice("abc") for _ in range(200))
        cut = rng.randrange(0, 100)
        rows.append((source[cut : cut + rng.randrange(0, 80)] + "".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))), source))

    def plain(candidate, source, window=10):
        if len(candidate) < window:
            return 0.0
        i = hit = 0
        while i <= len(candidate) - window:
            if candidate[i : i + window] in source:
                hit, i = hit + window, i + window
            else:
                i += 1
        return min(1.0, hit / len(candidate))

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, s string")
    got = [r[0] for r in df.orderBy("i").select(text.verbatim_overlap(F.col("c"), F.col("s"), 10)).collect()]
    assert got == pytest.approx([plain(*r) for r in rows])


def test_quote_ratio_finds_the_largest_step(spark):
    page = "出發前四十五天通知旅客並辦理退費手續完成後不得異議"
    quotes = [page, page[:20] + "※" + page[21:], "※" * 10, page[:6], "", "前四"]
    df = spark.createDataFrame([(i, q, page) for i, q in enumerate(quotes)], "i int, q string, p string")
    got = [r[0] for r in df.orderBy("i").select(text.quote_match_ratio(F.col("q"), F.col("p"))).collect()]
    assert got[0] == 1.0 and 0.3 <= got[1] < 1.0 and got[2] == 0.0 and got[3] == 1.0 and got[4] == 0.0 and got[5] == 1.0


def test_overlap_tokens_glue_words_and_pair_characters(spark):
    got = column(spark, ["ISO 感光度", "ab cd", "甲乙丙丁", "", None], text.overlap_tokens)
    assert got[0] == ["iso", "感", "光", "度"]
    assert got[1] == ["abcd"]
    assert got[2] == ["甲乙", "乙丙", "丙丁", "甲乙丙", "乙丙丁"]
    assert got[3] == [] and got[4] is None


@pytest.mark.parametrize(
    ("given", "said"),
    [("NT$3,000 元", "新臺幣三千元"), ("共 1,205 元", "共 一千二百零五元"), ("30%", "百分之三十"), ("44~31 天", "四十四到三十一天"), ("15 天", "十五天"), ("於 2024 年", "於 二零二四 年"), ("MSC 郵輪", "M S C 郵輪"), ("100,010元", "十萬零十元")],
)
def test_spoken_text(spark, given, said):
    assert column(spark, [given], text.spoken_text) == [said]


def test_numbers_in_words():
    assert [text.number_zh(n) for n in (0, 10, 11, 20, 105, 110, 1001, 10000, 100000000)] == ["零", "十", "十一", "二十", "一百零五", "一百十", "一千零一", "一萬", "一零零零零零零零零"]


def test_page_runs_and_times(spark):
    df = spark.createDataFrame([([3, 1, 2, 5, 5],), ([],), ([7],)], "p array<int>")
    assert [r[0] for r in df.select(text.page_runs(F.col("p"))).collect()] == ["1-3,5", "", "7"]
    assert column(spark, [-1.0, 3661.5, 0.9996], text.srt_time, "double") == ["00:00:00,000", "01:01:01,500", "00:00:01,000"]
    assert column(spark, [3661.25], text.ass_time, "double") == ["1:01:01.25"]


def test_target_minutes_and_boxes(spark):
    df = spark.createDataFrame([(22000, 10, 2, None), (10**7, 10, 2, "7.5"), (220, 400, 20, None)], "c long, p int, h int, o string")
    got = [r[0] for r in df.select(numeric.target_minutes(F.col("c"), F.col("p"), F.col("h"), override=F.col("o"))).collect()]
    assert got == [10.0, 7.5, 45.0]
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(50.0).alias("y1"))
    row = spark.range(1).select(numeric.area_ratio(box, F.lit(100.0), F.lit(100.0)), numeric.area_ratio(box, F.lit(0.0), F.lit(1.0)), numeric.expanded_box(box, F.lit(60.0), F.lit(60.0), 20.0)["y1"]).first()
    assert tuple(row) == (0.25, 0.0, 60.0)


def test_lengths_by_depth_and_kind(spark):
    df = spark.createDataFrame([("deep", None), (None, "5"), ("odd", "auto"), ("brief", "-1")], "d string, m string")
    got = [tuple(r[0]) for r in df.select(numeric.length_window(F.col("d"), F.col("m"))).collect()]
    assert got == [(600.0, 480.0, 720.0), (300.0, 270.0, pytest.approx(330.0)), (300.0, 240.0, 360.0), (120.0, 90.0, 150.0)]
    df = spark.createDataFrame([("contract", 3, 1800, "standard"), (None, 0, 0, None), ("slides", 100, 0, "brief")], "k string, p int, c long, d string")
    assert [r[0] for r in df.select(numeric.auto_minutes(*map(F.col, "kpcd"))).collect()] == [4.0, 2.5, 3.0]


def test_small_text_helpers(spark):
    df = spark.createDataFrame([("前文違約金為30%以內", "30%"), ("x" * 60 + "30%" + "y" * 60 + "違約", "30%"), (None, "30%"), ("30%", "")], "t string, a string")
    assert [r[0] for r in df.select(text.near_any(F.col("t"), F.col("a"), ["違約"])).collect()] == [True, False, False, False]
    assert spark.range(1).select(text.joined_text(F.array(F.lit("a"), F.lit("")), F.lit(None).cast("array<string>"), F.array(F.lit("b")))).first()[0] == "a\nb"
    assert column(spark, ["Before and AFTER", "x", None], lambda c: text.first_named(c, [("pair", ["after"]), ("other", ["x"])], "none")) == ["pair", "other", "none"]
    assert column(spark, ["abcdefgh ij", None], lambda c: text.wrapped(c, 4)) == [["abcd", "efgh", "ij"], None]
