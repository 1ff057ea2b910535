"""Long stretches without a place to cut, against the public library."""

import random
import time

import pytest

from leafmill.llm import tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder()


RNG = random.Random(4)
CASES = {
    "one sign": "=" * 200_000,
    "one letter": "a" * 200_001,
    "two letters": "ab" * 100_000,
    "random letters": "".join(RNG.choice("etaoinshrdlu") for _ in range(200_000)),
    "beyond 16 bits": "x" + "the" * 30_000 + "y",
    "Han": "".join(chr(RNG.randrange(0x4E00, 0x6000)) for _ in range(60_000)),
    "emoji": "👩‍🚀" * 5_000,
}


@pytest.mark.parametrize("name", CASES)
def test_long_runs_equal_the_library(encoder, library, name):
    began = time.time()
    _, ids = tokens.encode_texts([CASES[name]], encoder)
    assert time.time() - began < 20
    assert ids.tolist() == library.encode(CASES[name], add_special_tokens=False).ids


def test_places_where_no_token_lies_across_change_nothing(encoder, library):
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice("aeiou=-_ß漢字ก") for _ in range(rng.randrange(1, 90)))
        assert tokens.encode_texts([word], encoder)[1].tolist() == library.encode(word, add_special_tokens=False).ids


def test_leftmost_alone_where_a_merge_is_not_safe():
    """A made-up vocabulary in which what a merge makes takes part in an earlier one."""
    import pandas as pd

    encoder = tokens.WordEncoder.__new__(tokens.WordEncoder)
    import duckdb

    encoder.db, encoder.parts, encoder.byte_id = duckdb.connect(), {}, __import__("numpy").arange(256, dtype="int32")
    a, x = ord("a"), ord("x")
    # (a, a) > 300 at rank 2, but 300 and x make 301 at rank 1.
    pairs = pd.DataFrame([(300, x, 1, 301, True), (a, a, 2, 300, False)], columns=["lft", "rgt", "rank", "merged", "safe"])  # noqa: F841
    encoder.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
    encoder._merge([b"aaxaa", b"aaaax"])
    assert encoder.parts == {b"aaxaa": (301, 300), b"aaaax": (300, 301)}
