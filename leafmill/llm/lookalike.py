"""Problem 5: one consistent form for text that looks the same.

Two forms are made of every distinct value:

    fold  the compatibility normalisation composed form (NFKC) with full case folding, mapped white space and without
          default-ignorable characters and look-alike letters: the blocking key, blind to more than a reader is;
    look  the same with all that a reader can see kept: letter case, raised and circled figures, full-width punctuation.

Texts whose fold and look agree look the same. Defined results: null stays null in both forms; blank texts are never part
of a pair; a null list of headings counts as an empty one; white space at line ends cannot be seen and is dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import materialize

# Letters of other scripts drawn like Latin ones, each written above the letter it looks like.
LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТУХԌаеіјосрѕухһԁԛԝѵӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳօ"
LOOKALIKE_INTO = "ABESIJKMHOPCTYXGaeijocpsyxhdqwvlABEZHIKMNOPTYXocjo"
# Default-ignorable code points (Unicode's property of that name), as ranges.
IGNORABLE = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
# Spaces of other widths and hyphens drawn like the plain ones.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f"
HYPHENS = "\u2010\u2011"
#: Compatibility kinds that change nothing visible when taken apart into one character, and ligatures of letters.
UNSEEN_KINDS = {"<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}


@cache
def visible_table() -> dict[int, str | None]:
    """Map of code points to what they look like, derived from the Unicode data by rule."""
    table: dict[int, str | None] = {}
    for cp in range(0x110000):
        kind, _, rest = unicodedata.decomposition(chr(cp)).partition(" ")
        if not kind.startswith("<"):
            continue
        into = "".join(chr(int(x, 16)) for x in rest.split())
        letters = all(unicodedata.category(c)[0] in "LN" for c in into)
        if kind in ("<wide>", "<narrow>") and letters and unicodedata.category(chr(cp))[0] in "LN":
            table[cp] = into
        elif kind in UNSEEN_KINDS and (len(into) == 1 and unicodedata.category(chr(cp))[0] != "Z" or 0xFB00 <= cp <= 0xFB4F):
            table[cp] = into
    table |= {ord(a): b for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_INTO, strict=True)}
    table |= {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS}
    table |= {cp: None for low, high in IGNORABLE for cp in range(low, high + 1)}
    return table


@cache
def _special() -> re.Pattern[str]:
    """Finds the characters that the table changes; most texts hold none, and then nothing is rebuilt."""
    points = sorted(visible_table())
    ranges, start = [], points[0]
    for a, b in zip(points, [*points[1:], -1], strict=True):
        if b != a + 1:
            ranges.append((start, a))
            start = b
    return re.compile("[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges) + "]")


_LINE_END = re.compile(r"[ \t\r]+(?=\n|\Z)")


def look(text: str) -> str:
    """The form in which texts that a reader cannot tell apart are equal."""
    if not text.isascii():
        table = visible_table()
        text = unicodedata.normalize("NFC", _special().sub(lambda m: table[ord(m[0])] or "", text))
    if " \n" in text or "\t\n" in text or "\r" in text or text[-1:] in (" ", "\t"):
        text = _LINE_END.sub("", text)
    return text


def fold(text: str) -> str:
    """NFKC with full case folding over the look of a text; equal for all texts of equal look, and for more."""
    return fold_look(look(text))


def fold_look(text: str) -> str:
    """fold of a text that already has its look."""
    if text.isascii():
        return text.casefold()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def normalised(df: DataFrame, *columns: str) -> DataFrame:
    """df with <column>_look and <column>_fold, strings or arrays of strings like the column, made once per distinct value of an Arrow batch.

    A null value stays null, also inside an array; an empty array stays empty.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}

    def udf_of(kind: str):
        @F.pandas_udf(f"look {kind}, fold {kind}")
        def both(s: pd.Series) -> pd.DataFrame:
            if kind == "string":
                codes, values = pd.factorize(s)
                seen = [look(v) for v in values]
                made = pd.DataFrame({"look": [*seen, None], "fold": [*map(fold_look, seen), None]}, dtype=object)
                return made.iloc[codes].set_axis(s.index)
            known: dict[str | None, tuple] = {None: (None, None)}
            for v in {v for x in s if x is not None for v in x if v is not None}:
                known[v] = (seen := look(v)), fold_look(seen)
            of = lambda x, k: None if x is None else [known[v][k] for v in x]
            return pd.DataFrame({"look": [of(x, 0) for x in s], "fold": [of(x, 1) for x in s]}, index=s.index)

        return both

    for c in columns:
        df = df.withColumn(f"_{c}", udf_of(kinds[c])(F.col(c)))
    return df.select(*(c for c in df.columns if c not in {f"_{x}" for x in columns}), *(F.col(f"_{c}.{k}").alias(f"{c}_{k}") for c in columns for k in ("look", "fold")))


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out, seen = [], {}
        for page_id, text, headings in zip(pdf["page_id"], pdf["text"], pdf["headings"], strict=True):
            heads = () if headings is None else tuple("" if h is None else h for h in headings)
            if (found := seen.get((text, heads))) is None:
                seen[(text, heads)] = found = _key(text, heads)
            if found:
                out.append((page_id, *found))
        yield pd.DataFrame(out, columns=["page_id", "fold_key", "look_key", "raw_key"])


def _key(text: str, heads: tuple[str, ...]) -> tuple[bytes, bytes, bytes] | tuple[()]:
    seen = look(text)
    if not seen.strip():
        return ()
    parts = [(x, seen, fold_look(seen)) for x, seen in ((text, seen), *((h, look(h)) for h in heads))]
    raw, looks, folds = ("\x1f".join(p[k] for p in parts) for k in (0, 1, 2))
    return tuple(xxhash.xxh3_128_digest(x) for x in (folds, looks, raw))


def _look_keys(pages: DataFrame) -> DataFrame:
    """page_id, fold_key, look_key, raw_key of the pages with text, written once."""
    rows = pages.filter((F.length(F.trim("text")) > 0) & F.col("page_id").isNotNull()).select("page_id", "text", "headings")
    return materialize(rows.mapInPandas(_keys, "page_id long, fold_key binary, look_key binary, raw_key binary"), "look-keys")


def look_classes(pages: DataFrame) -> DataFrame:
    """One row per page with text: page_id, class_id (the least page_id that looks the same), variants (different texts in the class) and
    links (pages that look the same and differ in a code point). Linear in the pages, whatever the size of a class."""
    keys = _look_keys(pages)
    copies = keys.groupBy("fold_key", "look_key", "raw_key").agg(F.count(F.lit(1)).alias("_same"), F.min("page_id").alias("_first"))
    classes = copies.groupBy("fold_key", "look_key").agg(F.sum("_same").alias("_all"), F.count(F.lit(1)).alias("variants"), F.min("_first").alias("class_id"))
    rows = keys.join(copies.drop("_first"), ["fold_key", "look_key", "raw_key"]).join(classes, ["fold_key", "look_key"])
    return rows.select("page_id", "class_id", "variants", (F.col("_all") - F.col("_same")).alias("links"))


def identical_pairs(pages: DataFrame) -> DataFrame:
    """(page_id_a, page_id_b): all pairs of pages that look the same and differ in at least one code point.

    Blocking by fold_key, the exact check by look_key. Only keys with several variants go on, and each pair of variants is
    joined by an equi-join on the variant, so rows of one text are never compared with each other. The pairs are what is asked for; where
    a class has very many copies, look_classes says the same in one row per page.
    """
    keys = _look_keys(pages)
    variants = keys.groupBy("fold_key", "look_key", "raw_key").agg(F.count(F.lit(1)).alias("n"))
    many = variants.groupBy("fold_key", "look_key").agg(F.collect_list("raw_key").alias("raws")).filter(F.size("raws") > 1)
    first = many.select("raws", F.explode("raws").alias("raw_a"))
    two = first.select("raw_a", F.explode("raws").alias("raw_b")).filter(F.col("raw_a") < F.col("raw_b"))
    a, b = (keys.select(F.col("raw_key").alias(f"raw_{x}"), F.col("page_id").alias(f"id_{x}")) for x in "ab")
    pairs = two.join(a, "raw_a").join(b, "raw_b")
    return pairs.select(F.least("id_a", "id_b").alias("page_id_a"), F.greatest("id_a", "id_b").alias("page_id_b"))
