"""Nulls in any column, very long texts, repeated rows and clashing column names, for every operator at once."""

from leafmill.llm import encoding, lookalike, mixing, noise, residue, sentences, split, subject, tokens

LONG = "The file was kept. " * 4000 + "甲乙。" * 4000


def test_odd_rows(spark):
    S = spark.createDataFrame
    texts = [None, "", " \n ", LONG, LONG, "- 3 -\nShort line\n‐", "\x00", "¬", "​"]
    pages = S([(i if i % 3 else None, i if i % 2 else None, None if i == 5 else 3, t, [None, "h"] if i == 3 else None, "x", "x", 1) for i, t in enumerate(texts)], "page_id long, src_id long, page int, text string, headings array<string>, kind string, key string, n int")
    chunks = S([(i, None, None, None if i % 2 else 1, 2, t, None, "x") for i, t in enumerate(texts)], "chunk_key long, src_id long, chunk_id string, start_page int, end_page int, text string, spec_id int, bodies string")
    docs = S([(i if i else None, t, None if i % 2 else "s", "x", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, line string, copy_no string")
    specs = S([(1, 1200, 120), (1, 1200, 120), (None, None, None)], "spec_id int, max_chars int, overlap_chars int")
    assert {p["chunk_key"] for p in split.split_pieces(chunks, specs, pages).collect()} == {2, 3, 4, 5, 6, 7, 8}
    assert split.oversized(chunks, specs).count() == 2
    assert lookalike.identical_pairs(pages).count() == 0
    rows = encoding.repaired(pages).collect()
    assert len(rows) == len(texts) and sum(r["text"] == LONG for r in rows) == 2
    assert {r["kind"] for r in noise.noisy_lines(pages).collect()} <= {"furniture", "hyphen", "misread"}
    lists = sentences.learn(pages)
    items = S([("page", 4), ("chunk", 3), ("chunk", 0), (None, None), ("page", 4)], "item_kind string, item_id long")
    found = sentences.units(sentences.items(items, pages, chunks), lists).groupBy("item_kind", "item_id").count().collect()
    counts = {(r["item_kind"], r["item_id"]): r["count"] for r in found}
    assert set(counts) == {("page", 4), ("chunk", 3)} and counts["page", 4] == counts["chunk", 3] >= 4000
    assert tokens.token_ids(docs).count() == len(texts)
    targets = S([("s", 1.0, 1), ("s", 1.0, 2), (None, None, None)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(mixing.sized(docs, targets), targets)
    assert mixed.count() == mixed.select("doc_id", "copy_no").distinct().count()
    assert residue.residue_ids(docs).count() == 0
    labels = S([(1, "a", None), (None, "a", None), (1, None, None)], "src_id long, subject string, annotator string")
    profiles = subject.subject_profiles(pages.select("src_id"), pages, chunks, labels, S([("a", None), ("b", None)], "subject string, note string"))
    assert {r["src_id"] for r in subject.subjects(profiles).collect()} <= {1, 3, 5, 7}
