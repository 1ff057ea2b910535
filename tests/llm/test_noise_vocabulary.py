"""Which words may be meant does not depend on the size of the corpus."""

from leafmill.llm import noise


def test_rare_words_are_candidates_in_a_large_corpus(spark):
    words = spark.createDataFrame([("the", 500_000_000), ("spectrometer", 6), ("spectr0meter", 1)], "a string, n long")
    queries = words.filter("n = 1")
    found = {(r["a"], r["meant"]) for r in noise.word_candidates(words, queries).collect()}
    assert found == {("spectr0meter", "spectrometer")}
    # Also from several tries.
    assert {(r["a"], r["meant"]) for r in noise.word_candidates(words, queries, trie_words=1).collect()} == found


def test_words_misread_in_several_places_and_short_ones(spark):
    meant = ["commission", "opinion", "motion", "region", "million", "version", "session", "of"]
    once = ["c0mmission", "opini0n", "m0tion", "comm1ssion", "op1nion", "reg1on"]
    many = {"c0mm1ss10n": "commission", "m0t10n": "motion", "0p1n10n": "opinion", "0f": "of", "m1ll10n": "million"}
    words = spark.createDataFrame([(w, 900) for w in meant] + [(w, 1) for w in [*once, *many]], "a string, n long")
    found = {r["a"]: r["meant"] for r in noise.misread_words(words).collect()}
    assert {a: found.get(a) for a in many} == many
    assert set(found) == {*once, *many}


def test_codes_with_letters_are_words_and_numbers_are_not():
    assert noise._is_word("c0mm1ss10n") and noise._is_word("a" * 60) and not noise._is_word("12345")


def test_page_numbers_far_to_the_right():
    assert [(i, flags) for i, flags, _ in noise.furniture_marks(["The text of the page goes on.", " " * 60 + "- 12 -"], 12, set())][0] == (1, noise.CERTAIN)
