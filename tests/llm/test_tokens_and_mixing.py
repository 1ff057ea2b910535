import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import mixing, tokens

DOC = "doc_id long, text string, source string, n_tokens string"


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    t.encode_special_tokens = True
    return t


def odd_texts():
    rng = random.Random(8)
    parts = ["the", " The", "'s", "'re", "  ", "\n\n", "\t", " ", "甲乙", "。", "é", "é", "🙂", "👩‍🔬", "<|endoftext|>", "12345", "²", "ไทย", "हिन्दी", "​", "\r\n", "x" * 30, "\x1c", "ﬁ", "½"]
    return [None, "", " ", *parts, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)), "word " * 3000, "甲" * 5000]


def test_ids_equal_the_library_and_decode(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], DOC)
    ids = tokens.token_ids(df)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    lib = library()
    for i, t in enumerate(texts):
        assert got[i] == (lib.encode(t, add_special_tokens=False).ids if t else []), repr(t)[:80]
    back = {r["doc_id"]: r["text"] for r in tokens.decoded(ids).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, "doc_id").collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_merging_leaves_each_token_of_the_vocabulary_whole():
    """What allows cutting words: a token's own bytes merge back to it, and no token spans a cut."""
    import json
    from pathlib import Path

    e = tokens.WordEncoder()
    vocab = json.loads(Path(tokens.TOKENIZERS, tokens.VOCABULARY).read_text(encoding="utf-8"))["model"]["vocab"]
    byte_of = {c: b for b, c in tokens._shown_bytes().items()}
    some = random.Random(2).sample([t for t in vocab if all(c in byte_of for c in t)], 3000)
    raw = [bytes(byte_of[c] for c in t) for t in some]
    long = [r for r in raw if len(r) > 1]
    e._merge(long)
    assert all(e.parts[r] == (vocab[t],) for t, r in zip(some, raw, strict=True) if len(r) > 1)


def test_memo_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PARTS", 3)
    e = tokens.WordEncoder()
    offsets, ids = tokens.encode_texts(["one two three four five", "one two six"], e)
    lib = library()
    assert ids[: offsets[1]].tolist() == lib.encode("one two three four five", add_special_tokens=False).ids
    assert ids[offsets[1] :].tolist() == lib.encode("one two six", add_special_tokens=False).ids


TARGETS = [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 4), ("gone", 0.1, 2), (None, 0.2, 1), ("zero", 0.0, 5)]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 40)), s, "x") for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 25 + ["other"] * 50)]
    docs += [(5000, None, "a", "x"), (5001, "", "b", "x"), (5002, "text", None, "x")]
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    sizes = mixing.sized(spark.createDataFrame(docs, DOC), targets)
    out = mixing.mix(sizes, targets)
    return sizes.collect(), out.collect(), mixing.report(sizes, targets, out).collect()


def test_shares_are_met_and_repeats_capped(mixed):
    sizes, rows, report = mixed
    total = sum(r["n_tokens"] for r in rows)
    by = {r["source"]: r for r in report}
    for source, share, cap in (("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 4)):
        mine = [r for r in rows if r["source"] == source]
        assert sum(r["n_tokens"] for r in mine) / total == pytest.approx(share / 0.9, abs=0.01)
        uses = {}
        for r in mine:
            uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        assert max(uses.values()) <= cap and by[source]["most_copies"] <= cap
        assert len({(r["doc_id"], r["copy_no"]) for r in mine}) == len(mine)
        assert by[source]["actual_share"] == pytest.approx(sum(r["n_tokens"] for r in mine) / total, abs=1e-5)
    assert by["gone"]["tokens"] == 0 and {r["source"] for r in rows} == {"a", "b", "c"}
    # The mix is as large as the shares allow: one source is used up to its cap.
    assert max(by[s]["tokens"] / (by[s]["max_repeats"] * by[s]["available_tokens"]) for s in "abc") > 0.97


def test_positions_follow_the_curriculum(mixed):
    _, rows, _ = mixed
    positions = [r["position"] for r in rows]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    early = [r["n_tokens"] for r in rows if r["source"] == "a" and r["position"] < 0.5]
    late = [r["n_tokens"] for r in rows if r["source"] == "a" and r["position"] >= 0.5]
    assert sum(early) > 1.1 * sum(late)  # the largest source is tilted to the beginning


def test_time_inverts_the_integral_of_any_schedule(spark):
    knots = [(0.0, 0.2), (0.3, 0.6), (0.7, 0.0), (1.0, 0.5)]

    def area(t):
        done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            if t <= t0:
                break
            x = min(t, t1)
            w = w0 + (w1 - w0) * (x - t0) / (t1 - t0)
            done += (x - t0) * (w0 + w) / 2
        return done

    df = spark.createDataFrame([(knots, p / 50) for p in range(51)], "knots array<struct<t:double,w:double>>, p double")
    for r in df.select("p", mixing.time_of(mixing._segments(F.col("knots")), F.col("p")).alias("t")).collect():
        assert area(r["t"]) / area(1.0) == pytest.approx(r["p"], abs=1e-6)


def test_mixing_of_empty_tables(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    sizes = mixing.sized(spark.createDataFrame([], DOC), targets)
    assert mixing.mix(sizes, targets).count() == 0
    assert {r["tokens"] for r in mixing.report(sizes, targets, mixing.mix(sizes, targets)).collect()} == {0}
