import random
import re

import pytest

from leafmill.llm import lookalike, split

SPECS = "spec_id int, max_chars int, overlap_chars int"
CHUNK = "chunk_key long, src_id long, chunk_id string, start_page int, end_page int, text string, spec_id int, max_chars string"
PAGE = "page_id long, src_id long, page int, text string, headings array<string>"


def texts():
    rng = random.Random(1)
    marks = "甲乙丙é. 。，\n\n ́x"
    return ["", "甲" * 70, "a" * 300, "短", *("".join(rng.choice(marks) for _ in range(rng.randrange(1, 400))) for _ in range(60))]


@pytest.fixture(scope="module")
def cut(spark):
    data = [(i, 1, f"c{i}", 1, 2, t, [None, 1, 2, 9][i % 4], "x") for i, t in enumerate(texts())] + [(999, 1, "n", 1, 2, None, 1, "x")]
    chunks = spark.createDataFrame(data, CHUNK)
    specs = spark.createDataFrame([(1, 50, 10), (2, 40, 60)], SPECS)
    pages = spark.createDataFrame([(1, 1, 1, "x", [])], PAGE)
    return {d[0]: d for d in data}, split.split_pieces(chunks, specs, pages).collect(), split.oversized(chunks, specs).collect()


def test_pieces_stay_within_the_limit_and_share_the_overlap(cut):
    data, pieces, _ = cut
    by = {}
    for p in sorted(pieces, key=lambda p: (p["chunk_key"], p["piece_no"])):
        by.setdefault(p["chunk_key"], []).append(p)
    for key, (_, _, _, _, _, text, spec, _) in data.items():
        limit, lap = {None: (50, 10), 1: (50, 10), 2: (40, 39), 9: (None, 0)}[spec]
        got = by.get(key, [])
        if not text:
            assert not got
            continue
        assert got[0]["text"] == text[: len(got[0]["text"])]
        for a, b in zip(got, got[1:], strict=False):
            end = a["start_char"] + len(a["text"])
            assert b["start_char"] == max(0, end - lap)
            assert text[b["start_char"] :].startswith(b["text"])
        assert got[-1]["start_char"] + len(got[-1]["text"]) == len(text)
        assert limit is None or all(len(p["text"]) <= limit for p in got)


def test_cases_are_the_texts_over_the_limit(cut):
    data, _, cases = cut
    want = {}
    for key, (_, _, _, _, _, text, spec, _) in data.items():
        limit = {None: 50, 1: 50, 2: 40, 9: None}[spec]
        if text and limit and len(text) > limit:
            want[key] = "forced" if any(len(r) > limit for r in re.split(r"[\s.。，]+", text)) else "plain"
    assert {c["chunk_key"]: c["case_kind"] for c in cases} == want


def test_pieces_name_the_pages_they_cover(spark):
    pages = [(1, 1, 1, "甲" * 30 + "。", []), (2, 1, 2, None, []), (3, 1, 3, "乙" * 30 + "。", []), (4, 1, 3, "other read", [])]
    text = "\n\n".join([pages[0][3], "", pages[2][3]])
    chunks = spark.createDataFrame([(1, 1, "c", 1, 3, text, 1, "x")], CHUNK)
    got = split.split_pieces(chunks, spark.createDataFrame([(1, 36, 0)], SPECS), spark.createDataFrame(pages, PAGE)).orderBy("piece_no").collect()
    assert [(p["start_page"], p["end_page"]) for p in got] == [(1, 1), (3, 3)]


def test_empty_tables(spark):
    chunks, specs, pages = spark.createDataFrame([], CHUNK), spark.createDataFrame([], SPECS), spark.createDataFrame([], PAGE)
    assert split.split_pieces(chunks, specs, pages).count() == split.oversized(chunks, specs).count() == 0
    assert lookalike.identical_pairs(pages).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ａｂ１", "Ab1", True), ("café", "café", True), ("a​b", "ab", True), ("a b", "a b", True), ("раураl", "paypal", True), ("ﬁn", "fin", True), ("⾒", "見", True), ("參", "參", True), ("a  \n", "a\n", True),
        ("x2", "x²", False), ("R", "r", False), ("4", "④", False), ("a b", "a  b", False), ("a\nb", "a b", False), ("1", "2", False),
    ],
)
def test_look_of_texts(a, b, same):
    assert (lookalike.look(a) == lookalike.look(b)) is same
    if same:
        assert lookalike.fold(a) == lookalike.fold(b)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    forms = ["abc 1", "ａbc 1", "аbc 1", "abc​ 1", "ABC 1", "abc ²", "", "  ", None, "​", "x" * 5000, "x" * 4999 + "ｘ"]
    heads = [None, [], ["h"], ["ｈ"], ["H"], [None]]
    data = [(i, rng.randrange(3), 1, rng.choice(forms), rng.choice(heads)) for i in range(120)]
    key = lambda r: (lookalike.look(r[3]), tuple(lookalike.look(h or "") for h in r[4] or ()))
    raw = lambda r: (r[3], tuple(h or "" for h in r[4] or ()))
    rows = [r for r in data if r[3] and lookalike.look(r[3]).strip()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and key(a) == key(b) and raw(a) != raw(b)}
    got = lookalike.identical_pairs(spark.createDataFrame(data, PAGE)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_normalised_columns_keep_nulls(spark):
    df = spark.createDataFrame([(1, 1, 1, None, None), (2, 1, 1, "Ａ", None), (3, 1, 1, "Ａ", None)], PAGE)
    got = {r["page_id"]: (r["text_look"], r["text_fold"]) for r in lookalike.normalised(df, "text").collect()}
    assert got == {1: (None, None), 2: ("A", "a"), 3: ("A", "a")}


def test_headings_are_normalised_and_classes_count_links(spark):
    df = spark.createDataFrame([(1, 1, 1, "Ａ１", ["Ｘ", None]), (2, 1, 1, "A1", ["X", None]), (3, 1, 1, "A1", ["X", None]), (4, 1, 1, None, None), (5, 1, 1, "b", []), (6, 1, 1, "a1", ["X", None])], PAGE)
    got = {r["page_id"]: (r["headings_look"], r["headings_fold"]) for r in lookalike.normalised(df, "text", "headings").collect()}
    assert got[1] == (["X", None], ["x", None]) == got[2] and got[4] == (None, None) and got[5] == ([], [])
    rows = {r["page_id"]: (r["class_id"], r["variants"], r["links"]) for r in lookalike.look_classes(df).collect()}
    assert rows == {1: (1, 2, 2), 2: (1, 2, 1), 3: (1, 2, 1), 5: (5, 1, 0), 6: (6, 1, 0)}
    assert lookalike.look_classes(df.limit(0)).count() == 0 and lookalike.normalised(df.limit(0), "headings").count() == 0
