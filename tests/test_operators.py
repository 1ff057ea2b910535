"""Operators against sequential procedures, on small tables with nulls, ties, repeats and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import budget, classify, extract, figures, ground, joins, quality, sequence, state
from leafmill.plans import providers
from leafmill.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_facts_of_cancellation_tiers(spark):
    page = "旅客於出發前 45 天以上通知者，退還 80%。出發前44~31天者賠償 30 %；另收 NT$3,000 元。契約於2024年5月1日生效，共 12 件。"
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x")], "page_id long, text string, value string")
    found = extract.facts(df, "page_id").orderBy("pattern_no", "start").collect()
    kinds = {(r["kind"], r["value"]) for r in found}
    assert {("deadline_range", "出發前44~31天"), ("percent", "80%"), ("percent", "30 %"), ("money", "NT$3,000 元"), ("absolute_date", "2024年5月1日"), ("count", "12 件")} <= kinds
    assert all(r["value"] in page and page[r["start"] :].startswith(r["value"][:1]) or r["kind"] == "deadline" for r in found)
    assert all(len(r["quote"]) <= 80 for r in found)
    assert {r["page_id"] for r in found} == {1}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_packing_equals_the_loop(spark, block):
    rng = random.Random(11)
    groups = {g: [(p, rng.choice([0, 0, 5, 40, 90, 130, 400])) for p in sorted(rng.sample(range(1, 90), rng.randrange(1, 40)))] for g in range(12)}
    want = []
    for g, pages in groups.items():
        held, no, empty = 0, 1, True
        for p, n in pages:
            if held + n > 120 and not empty:
                held, no = 0, no + 1
            held, empty = held + n, False
            want.append((g, p, no))
    df = spark.createDataFrame([(g, p, n) for g, v in groups.items() for p, n in v], "src_id long, page int, size int")
    assert rows(sequence.pack(df, "src_id", "page", "size", 120, block)) == sorted(want)
    assert sequence.pack(df.limit(0), "src_id", "page", "size", 120).count() == 0


def test_running_sums_over_blocks(spark):
    rng = random.Random(5)
    data = [(g, o, rng.randrange(10)) for g in range(3) for o in range(50)]
    got = {(r["g"], r["o"]): r["before"] for r in sequence.running_sum(spark.createDataFrame(data, "g int, o int, v int"), ["g"], "o", F.col("v"), "before", 7).collect()}
    for g in range(3):
        total = 0
        for gg, o, v in sorted(data):
            if gg == g:
                assert got[(g, o)] == total
                total += v


def test_islands_and_ids(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 4), (2, None), (2, 7)], "g int, p int")
    assert rows(sequence.page_islands(df, "g", "p")) == [(1, 1, 2), (1, 4, 4), (2, 7, 7)]
    ids = spark.createDataFrame([(1, 1, "ch_005"), (1, 2, "intro"), (2, 1, "ch_002"), (2, 2, "x")], "g int, o int, raw string")
    got = {(r["g"], r["o"]): r["canonical_id"] for r in sequence.canonical_ids(ids, "g", "o", "raw").collect()}
    assert got == {(1, 1): "ch_005", (1, 2): "ch_002", (2, 1): "ch_001", (2, 2): "ch_002"}


def test_trimming_equals_the_loop(spark):
    rng = random.Random(2)
    scenes = [(g, i, float(rng.choice([12, 18, 22, 28])), rng.choice([40, 55, 85, 90]), rng.choice(["cover", "paragraph_card", "checklist", None])) for g in range(15) for i in range(rng.randrange(1, 14))]
    want = []
    for g in range(15):
        keep = [s for s in scenes if s[0] == g]
        while sum(s[2] for s in keep) > 100 and len(keep) > 3:
            open_ = [s for s in keep if (s[4] or "") not in ("cover", "recap_card")]
            if not open_:
                break
            keep.remove(min(open_, key=lambda s: (s[3], s[1])))
        want += [(s[0], s[1]) for s in keep]
    df = spark.createDataFrame(scenes, "g int, seq int, seconds double, score int, kind string")
    assert rows(budget.trimmed(df, "g", 100.0).select("g", "seq")) == sorted(want)


def test_assignment_equals_the_sequential_procedure(spark):
    rng = random.Random(9)
    pairs = [(p, f"i{i}", rng.choice([3000, 3100, 4200, 5600])) for p in range(40) for i in range(max(0, p // 4 - 1), p // 4 + 3) if rng.random() < 0.7]
    uses, want = {}, []
    for p in range(40):
        scored = [(-(s - 700 * uses.get(i, 0)), i) for q, i, s in pairs if q == p and s - 700 * uses.get(i, 0) >= 3000]
        if scored:
            _, best = min(scored)
            uses[best] = uses.get(best, 0) + 1
            want.append((p, best))
    df = spark.createDataFrame([(p, 1, i, s) for p, i, s in pairs], "passage_id long, src_id long, image_id string, score_milli long")
    assert rows(figures.spread_figures(df)) == sorted(want)


def test_a_long_chain_of_rivals_is_settled(spark):
    """Each passage's choice hangs on the one before it: far more rounds than a dozen."""
    pairs = [(p, f"i{p + k:03d}", 4000 - 100 * k) for p in range(25) for k in range(2)]
    pairs = [(p, i, s if (p, i) != (0, "i000") else 2000) for p, i, s in pairs]
    uses, want = {}, []
    for p in range(25):
        scored = [(-(s - 700 * uses.get(i, 0)), i) for q, i, s in pairs if q == p and s - 700 * uses.get(i, 0) >= 3000]
        if scored:
            _, best = min(scored)
            uses[best] = uses.get(best, 0) + 1
            want.append((p, best))
    assert len({i for _, i in want}) == 25
    df = spark.createDataFrame([(p, 1, i, s) for p, i, s in pairs], "passage_id long, src_id long, image_id string, score_milli long")
    assert rows(figures.spread_figures(df)) == sorted(want)


def test_grounding_issues_and_repair(spark):
    pages = spark.createDataFrame([(3, "違約金為總價百分之三十，應於45天內通知。"), (4, None)], "page int, text string")
    scenes = spark.createDataFrame([("a", "penalty_table", [3]), ("b", "penalty_table", [9]), ("c", "cover", []), ("d", "checklist", None), ("e", None, [])], "scene_id string, scene_kind string, source_pages array<int>")
    evidence = spark.createDataFrame([("a", 0, 3, "應於45天內通知"), ("a", 1, 3, "完全不同的一句話在這裡"), ("b", 0, 9, "x")], "scene_id string, idx int, page int, quote string")
    facts = spark.createDataFrame([("a", 0, "期限", "high", 0), ("a", 1, "期限", "high", 7), ("d", 0, "金額", "low", None), ("d", 1, "其他", "low", None)], "scene_id string, idx int, label string, importance string, evidence_index int")
    found = {(r["scene_id"], r["code"]) for r in ground.issues(scenes, evidence, facts, pages).collect()}
    assert found == {("b", "bad_source_page"), ("b", "bad_page"), ("a", "quote_mismatch"), ("d", "no_source_pages"), ("d", "missing_evidence"), ("d", "fact_without_evidence"), ("a", "evidence_index_out_of_range")}
    s, e, f, left = ground.repair_rounds(scenes, evidence, facts, pages)
    # Both quotations of a stand on the page that does not hold the second, so both go and a with them.
    assert {r["scene_id"] for r in s.collect()} == {"c", "e"} and e.count() == 0 and f.count() == 0 and left.count() == 0
    more = evidence.filter("idx <> 1").union(spark.createDataFrame([("a", 1, 4, "完全不同的一句話在這裡")], evidence.schema))
    s, e, f, left = ground.repair_rounds(scenes, more, facts, pages)
    assert {r["scene_id"] for r in s.collect()} == {"a", "c", "e"} and rows(e.select("scene_id", "idx")) == [("a", 0)] and rows(f.select("scene_id", "idx")) == [("a", 0)] and left.count() == 0
    assert ground.repair_rounds(scenes, evidence, facts, pages, rounds=0)[3].count() > 0
    assert ground.issues(scenes.limit(0), evidence.limit(0), facts.limit(0), pages).count() == 0
    values = spark.createDataFrame([("共45天與30%", ["45天", ""]), ("共45天", ["30%"]), ("x", None)], "r string, v array<string>")
    assert [r[0] for r in values.select(ground.keeps_values(F.col("r"), F.col("v"))).collect()] == [True, False, True]


def test_captions_below_figures(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    images = spark.createDataFrame([("i", 1, 1, (100.0, 100.0, 400.0, 325.0))], f"image_id string, doc_id int, page int, bbox {box}")
    blocks = spark.createDataFrame([(1, 1, (100.0, 360.0, 390.0, 380.0), " 圖一 "), (1, 1, (100.0, 340.0, 390.0, 350.0), "圖"), (1, 1, (390.0, 340.0, 600.0, 350.0), "旁"), (1, 1, (100.0, 500.0, 390.0, 510.0), "遠"), (1, 2, (100.0, 340.0, 390.0, 350.0), "x")], f"doc_id int, page int, bbox {box}, text string")
    assert rows(figures.captions_below(images, blocks)) == [("i", "圖 圖一")]


def test_state_operators(spark):
    e = spark.createDataFrame([(1, "a", None, 1), (1, None, 5, 2), (2, "b", None, 1)], "k int, x string, y int, at int")
    assert rows(state.upserted(e, "k", ["at"]).select("k", "x", "y", "versions")) == [(1, "a", 5, 2), (2, "b", None, 1)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(state.merged(old, new, "k")) == [(1, "a"), (2, "b"), (3, "c")]
    art, man = spark.createDataFrame([(1, "h"), (2, "h"), (3, None)], "k int, h string"), spark.createDataFrame([(1, "h"), (2, "x"), (3, None)], "k int, h string")
    assert rows(state.stale(art, man, ["k"], "h").select("k")) == [(2,), (3,)]
    stages = spark.createDataFrame([("s", "completed", "h"), ("t", "completed", "h"), ("u", "failed", "h")], "stage string, status string, input_hash string")
    wanted = spark.createDataFrame([("s", "h", "f1"), ("t", "h", "f2"), ("u", "h", "f1")], "stage string, input_hash string, output string")
    assert rows(state.stage_done(stages, wanted, spark.createDataFrame([("f1",)], "output string"))) == [("s",)]


def test_asof_join_with_ties_and_gaps(spark):
    left = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate([("a", "2024-01-01 00:00:00"), ("a", "2024-01-05 12:00:00"), ("b", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:01")])], "i int, k string, t string").withColumn("t", F.to_timestamp("t"))
    right = spark.createDataFrame([("a", "2024-01-02 00:00:00", 1), ("a", "2024-01-02 00:00:00", 2), ("a", "2024-01-04 00:00:00", 3), (None, "2024-01-01 00:00:00", 9)], "k string, u string, v int").withColumn("u", F.to_timestamp("u"))
    got = {r["i"]: r["v"] for r in joins.asof(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {0: None, 1: 3, 2: None, 3: 2}


def test_classification_and_quality(spark):
    pages = spark.createDataFrame([(1, "甲方與乙方簽訂本合約，違約應賠償。", 16, ["第1章"]), (2, None, None, None), (2, "", 0, [])], "d int, text string, cjk_char_count int, headings array<string>")
    s = classify.text_signals(pages, "d").withColumns({c: F.lit(0) for c in ("image_count", "useful", "decorative", "large_pages")})
    got = {r["d"]: (r["doc_kind"], r["confidence_milli"]) for r in classify.document_kinds(classify.document_scores(s), "d").collect()}
    assert got[1][0] == "contract" and got[1][1] > 0 and got[2] == ("unknown", 0)
    probes = spark.createDataFrame([("a", 3.0, 9000, 900, 0.0), ("b", 12.0, 100, 900, 0.01), ("c", 8.0, 9000, 900, 0.0)], "name string, seconds double, peak int, rms int, clipped double")
    assert {(r["name"], r["code"]) for r in files.voice_issues(probes).collect()} == {("a", "bad_length"), ("b", "long"), ("b", "quiet"), ("b", "clipped")}
    q = quality.page_quality(spark.createDataFrame([(1, "x", "text"), (1, None, "empty"), (2, "y", None)], "d int, text string, text_source string"), "d")
    assert {(r["d"], r["code"]) for r in quality.broken_rules(q, ["d"], quality.page_rules()).collect()} == {(1, "empty_pdf_pages"), (1, "many_empty_pages")}


def test_sources_sinks_and_providers(spark, tmp_path):
    df = spark.createDataFrame([("abc", "abcdef"), ("a", "abc"), ("", ""), (None, None)], "t string, o string")
    t, s = files.page_text(F.col("t"), F.col("o"), 3)
    assert [tuple(r) for r in df.select(t, s).collect()] == [("abc", "text"), ("abc", "ocr"), ("", "empty"), ("", "empty")]
    assert files.merged_settings({"a": {"x": 1, "y": [1]}, "b": 1}, {"a": {"y": [2]}, "b": {"z": 1}}) == {"a": {"x": 1, "y": [2]}, "b": {"z": 1}}
    files.write_json(df, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "t string, extra int", {"extra": 4}).filter("t = 'abc'").first()["extra"] == 4
    cues = spark.createDataFrame([("f", 0, "甲", 0.0, 1.5), ("f", 1, "乙", 1.5, 3.0)], "g string, cue_no int, cue string, begin_sec double, end_sec double")
    assert files.srt_lines(cues, "g").first()["srt"] == "1\n00:00:00,000 --> 00:00:01,500\n甲\n\n2\n00:00:01,500 --> 00:00:03,000\n乙\n\n"
    made = providers.applied(df.select("t"), "t", "answer", "echo", prefix="p:").filter("t = 'abc'").first()["answer"]
    assert made.startswith("p:") and len(made) == 10
    with pytest.raises(ValueError, match="unknown provider"):
        providers.provider("none")
    answers = spark.createDataFrame([('{"a": 1}',), ('text {"a": 2} more',), ("none",)], "s string")
    got = [r[0] for r in answers.select(providers.parsed_json(F.col("s"), "a int")).collect()]
    assert got[0]["a"] == 1 and got[1]["a"] == 2 and (got[2] is None or got[2]["a"] is None)


def test_selection_of_visuals_equals_the_walk(spark):
    rng = random.Random(6)
    data = []
    for src in range(12):
        pages = sorted(rng.randrange(1, 9) for _ in range(rng.randrange(1, 20)))
        data += [(src, k + 1, p, rng.choice("abcd"), "x") for k, p in enumerate(pages)]
    df = spark.createDataFrame(data, "src_id int, rank long, page int, topic string, place string")
    for desired in (4, 7):
        want = []
        for src in range(12):
            mine, chosen = [d for d in data if d[0] == src], []
            for d in mine:
                if len(chosen) < desired and d[2] not in {c[2] for c in chosen} and (d[3] not in {c[3] for c in chosen} or len(chosen) < desired // 2):
                    chosen.append(d)
            rest = [d for d in mine if d not in chosen][: desired - len(chosen)]
            want += [(src, d[1]) for d in chosen + rest]
        assert rows(figures.selected_visuals(df, desired).select("src_id", "rank")) == sorted(want)
    assert figures.selected_visuals(df.limit(0), 4).count() == 0


def test_review_of_odd_scenes(spark):
    from leafmill.operators import cards, review

    files_ = spark.createDataFrame([("a",), (None,), ("a",)], "path string")
    scenes = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "gone"), (4, "gone")], "scene_id int, card string")
    assert rows(review.with_existing(scenes, files_, there="card").select("scene_id", "there")) == [(1, True), (2, False), (3, False), (4, False), (4, False)]
    s = "scene_id int, status string, pages int, audio_there boolean, subtitle string, subtitle_there boolean, visual_there boolean, visual_type string, source_there boolean, verbatim double"
    odd = spark.createDataFrame([(1, None, None, False, None, False, False, None, False, None), (2, "failed", None, False, None, False, False, None, False, 1.0), (3, "rendered", 1, True, "x", True, True, "pdf_image", True, 0.2)], s)
    got = {(r["scene_id"], r["code"]) for r in quality.broken_rules(odd, ["scene_id"], review.asset_rules()).collect()}
    assert got == {(1, "missing_source_pages"), (1, "missing_audio"), (1, "missing_subtitle"), (1, "missing_visual"), (2, "scene_failed")}
    assert rows(cards.with_issues(scenes.select("scene_id").distinct(), spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "scene_id int, code string"), "scene_id")) == [(1, ["a", "b"]), (2, []), (3, []), (4, [])]
    assert quality.broken_rules(odd.limit(0), ["scene_id"], review.asset_rules()).count() == 0


def test_retries_are_bounded(spark):
    tries = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "failed"), ("a", 3, "failed"), ("b", 1, "completed"), ("c", 1, None)], "k string, at int, status string")
    got = {(r["k"], r["attempt_no"]): r["given_up"] for r in state.retry_numbers(tries, "k", "at", 2).collect()}
    assert got[("a", 3)] and not got[("a", 2)] and not got[("b", 1)] and not got[("c", 1)]
    assert rows(state.reset_failed(tries.withColumn("retries", F.lit(4))).select("k", "at", "status", "retries"))[0] == ("a", 1, "pending", 0)
    assert rows(state.listed(tries, {"k": "a", "status": None}).select("at")) == [(1,), (2,), (3,)]


def test_trimming_orders_large_sequence_numbers(spark):
    """seq beyond 32 bits must not reach into the score."""
    scenes = spark.createDataFrame([(1, 2**40, 60.0, 1, "x"), (1, 1, 60.0, 2, "x"), (1, 2, 60.0, 3, "x"), (1, 3, 60.0, 4, "x")], "g int, seq long, seconds double, score int, kind string")
    assert rows(budget.trimmed(scenes, "g", 200.0).select("seq")) == [(1,), (2,), (3,)]
