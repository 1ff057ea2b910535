"""The model of wrong decodings is counted over all pages, whatever their number, order and partitions."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import zstandard

from leafmill.llm import encoding, language

PAGES = "page_id long, text string"
EN = ["The clerk of the office noted the figures.", "Nothing else was changed by the clerk – so the note says.", "The note on page {} names the annex of the report."]


def pages(n, phrase, at):
    rng = random.Random(2)
    return [(i, phrase if i in at else "\n".join(rng.choice(EN).format(rng.randrange(1, 999)) for _ in range(3))) for i in range(n)]


def test_words_of_few_pages_reach_the_dictionary(spark):
    """The phrase stands on pages that a hash of the ids took for none of a sample of 4,000."""
    from pyspark.sql import functions as F

    ids = spark.range(12_000).filter(F.pmod(F.xxhash64("id"), F.lit(3)) != 0).limit(40)
    at = {r["id"] for r in ids.collect()}
    model = encoding.fit(spark.createDataFrame(pages(12_000, "Das Grüßfräulein prüfte für die Brückenwärter die Schlüsselhäuser.", at), PAGES))
    assert "Brückenwärter".encode() in model.raw["de"] and "the clerk".encode() in model.raw["en"].lower()


def test_model_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(pages(500, "Näheres über die Prüfgröße steht im Abschnitt für Düngemittel.", set(range(0, 500, 7))), PAGES)
    one, other = (encoding.fit(x) for x in (df.coalesce(1), df.orderBy("text").repartition(7)))
    assert one.raw == other.raw and one.regular == other.regular and set(one.raw) == {"de", "en"}
    empty = encoding.fit(df.limit(0))
    assert empty.raw == {} and empty.judge().repair("Ã¼ber")[0] == "Ã¼ber"


def test_pairs_and_bytes_are_those_of_the_texts():
    texts = ["租賃條款由Dr. Kadrin保管，\n必要時得展延3日。", "租賃條款", "der Vermerk gilt\nder Vermerk", "", "\n"]
    got = {tuple(r[:4]): r[4] for out in encoding._counted(iter([pd.DataFrame({"text": texts})])) for r in out.itertuples(index=False)}
    wide = "".join(texts[:2]).count("條款")
    assert got["pair", "zh", "條", "款"] == wide == 2 and got["pair", "zh", "Dr", "."] == 1 and got["pair", "zh", " Kadrin", "保"] == 1
    assert ("pair", "zh", "，", "必") not in got and got["pair", "de", "der", " Vermerk"] == 2 and ("pair", "de", " gilt", "der") not in got
    octets = Counter("".join(texts[:2]).encode())
    assert all(got["octet", "zh", chr(b), ""] == octets[b] for b in range(256))
    assert [len(x) for x in encoding._portions(iter(["ab", "c", "", "def"]), 3)] == [2, 2]


def test_dictionaries_are_read_by_zstandard():
    """As whole dictionaries with their codes, not as plain content; texts come back, and known ones are short."""
    octets = np.bincount(np.frombuffer(("the lazy dog of the office " * 300).encode(), dtype=np.uint8), minlength=256)
    raw = encoding._dictionary([("the", " office", 50), (" the", " lazy", 40), (" lazy", " dog", 30)], octets)
    assert zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT).dict_id() == 1
    squeeze = zstandard.ZstdCompressor(dict_data=encoding._precomputed(raw), compression_params=encoding._PARAMS)
    back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw), format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    for text in ("the lazy dog of the office", "qzvx öäü 租賃條款", "", "\0\xff" * 400):
        assert back.decompress(squeeze.compress(text.encode()), max_output_size=5000).decode() == text
    plain = zstandard.ZstdCompressor(compression_params=encoding._PARAMS)
    assert len(squeeze.compress(b"the lazy dog of the office")) < len(plain.compress(b"the lazy dog of the office")) - 10
    # As many pairs as there is room for; bytes in equal shares cannot be coded shorter, and do not fail.
    many = [(f"w{i}", f" x{i}", 9) for i in range(20_000)]
    assert 30_000 < len(encoding._dictionary(many, octets)) < encoding.DICTIONARY_BYTES + 1024
    assert encoding._dictionary(many[:2], np.full(256, 7)).endswith(b"w0 x0")


def test_languages_of_many_texts():
    texts = ["", ".", "a", "Der Vermerk gilt", "租賃 lease", "ひらがな漢字", "ก", "हिन्दी", "étage à côté", "\U00020000", "12", "la carga según el muelle"]
    assert language.languages(texts) == [language.language(t) for t in texts] and language.languages([]) == []
