"""Problem 4: noise in text from scanned pages: page furniture, divided words, misrecognised characters.

Vocabulary. One pass over all pages counts words (scripts with spaces) and, for scripts without, characters in three context
windows. Candidates for a rare word come from intersecting its Levenshtein automaton, with edges for merges and splits besides, with a
trie over the vocabulary: no candidate is missed. One edit is tried freely; the confusions it teaches are then tried in one place for
every two characters. A letter more or less at the end of a word is taken for inflection; meant words with figures and single letters
stay out. For scripts without spaces the word is the window and the edge is the substitution of its character. Which confusions a scan makes is learnt: a confusion counts once it is seen in
several words or contexts that are otherwise firm. Context ranks the candidates: a reading stands against one that is many times more
frequent in the same surroundings.

A second pass looks the learnt misreadings up again. What it may look up is shipped as a bitmap of bounded size, and the hits are joined
exactly, so nothing that grows with the corpus is broadcast or collected.

Defined results: null and blank texts have no cases; every row of pdf_pages is judged on its own, duplicates included; lines that look
garbled by a wrong encoding are never called misread; furniture lines are nothing else.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.encoding import _ANY_SEQUENCE, MARKS
from leafmill.llm.lookalike import look
from leafmill.session import cores_of, materialize

#: A reading is doubted where another is this many times as frequent; firm contexts are met so often at least, at any size of the corpus.
RATIO, FIRM_RATIO, FIRM_LEAST = 6, 20, 30
#: Share of a character's firm contexts, by their size, in which a misreading of it must show.
BREADTH = 0.15
#: Distinct words in which a confusion of letters must be seen.
CONFUSION_WORDS = 3
#: Vocabulary words that one trie holds; a larger vocabulary is cut into several tries, and every query goes to each.
TRIE_WORDS = 200_000
#: Misreadings keep company: a confusion counts if this share of the pages that show it show another one, too.
COMPANY = 0.4
#: Bits of the bitmap of keys that the second pass looks up: so many for a key, as a power of two between these (16 MB at most). A fuller
#: bitmap lets more rows through to the exact join and changes no result.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 256, 1 << 23, 1 << 27

_CJK = "぀-ゟ゠-ヿ㐀-䶿一-鿿"
#: Scripts without spaces between words: their characters are looked at in windows.
_HAS_WINDOWS = re.compile(f"[{_CJK}ก-๛]")
_HAS_CJK = re.compile(f"[{_CJK}]")
_LETTER = r"[0-9A-Za-zª-ɏḀ-ỿऀ-ॣ०-ॿ]"
_WORD = re.compile(rf"{_LETTER}+(?:[!|$€£@§'’\-‐]{_LETTER}+)*")
_DIVIDED = re.compile(rf"((?:(?![{_CJK}])[^\W\d_])[^\s¬\xad]*?)([-‐¬\xad])[ \t]*$")
#: The rest of a divided word; a figure or sign may stand for its first letter.
_FIRST = re.compile(r"^(?:[^\W_]|[!|$€£@§](?=[a-zß-ÿ]))[^\s]*?(?=[\s,.;:!?)»”\"]|$)")
_DIGITS = re.compile(r"\d+")
_HASH_A, _CONTEXT, _CENTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFF0000), np.uint64(0xFFFF)
#: Windows: places of the context characters relative to the one looked at.
WINDOWS = ((-2, -1, 1, 2), (1, 2, 3), (-3, -2, -1))

# ---------------------------------------------------------------- furniture

_AS_DIGITS = str.maketrans("OoIlSBZ|", "00115821")
_ROMAN = re.compile(r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_NUM = r"[\dOoIlSBZ|]{1,5}"
# How page numbers are set, in the corpus's languages.
_PAGE_NUMBER = re.compile(
    rf"[-–—·•]\s*{_NUM}|{_NUM}\s*[-–—·•]|[-–—·•\[(~ ]{{1,3}}\s*{_NUM}\s*[-–—·•\])~ ]{{1,3}}|{_NUM}\s*/\s*{_NUM}|(?:p|pp|P|S|s|Pg|pg)\s?\.\s?{_NUM}|(?i:pages?|seite|página|pagina|pág\.?|page no\.?|blatt|folio|หน้า|पृष्ठ|頁|页|第)\s*{_NUM}(?:\s*(?:/|of|von|de|sur)\s*{_NUM})?|第?\s*{_NUM}\s*(?:頁|页|ページ)"
)
_BARE = re.compile(_NUM)
_NUMBERED = re.compile(rf"(?P<head>.*?\D)(?:\s*[|·•–—/]\s*|\s*[.…‧·]{{2,}}\s*|\s{{2,}}|\t+)(?P<no>{_NUM})")
_NUMBERED_FIRST = re.compile(rf"(?P<no>{_NUM})(?:\s*[|·•–—/]\s*|\s*[.…‧·]{{2,}}\s*|\s{{2,}}|\t+)(?P<head>\D.*)")
_SENTENCE_ENDS = frozenset(".．。!！?？।;；:：,，、…」』”\"）)}｡")
_NUMBER_LIKE = re.compile(r"[\dOoIlSBZ|]|^[ivxlc]+$")
_SENTENCE_INSIDE = re.compile(r"[。！？।]|[.!?] [A-ZÀ-Þ]|[，、；]")
#: Scripts in which sentences may end without a mark.
_MARKED_VOWELS = re.compile("[\u0900-\u0dff\u0e00-\u0eff]")
_LISTED = re.compile(r"[–—•·□▪■*○●◦\-]\s|[(（]?\d|第\s?\d|[A-Za-z]+ \d+\b")
#: Characters, runs of white space as one, that no page number of _PAGE_NUMBER exceeds; filled lines at the top and at the bottom of a page among which running headers and footers stand.
PAGE_NUMBER_CHARS, EDGE_LINES = 24, 3
CERTAIN, HEADER, WITH_NUMBER, CAPITALS, TITLE = 1, 2, 4, 8, 16


_AS_NUMBER = frozenset("0123456789OoIlSBZ|")


def _numbered(line: str) -> re.Match[str] | None:
    """A header with a page number after or before it."""
    return (_NUMBERED.fullmatch(line) if line[-1] in _AS_NUMBER else None) or (_NUMBERED_FIRST.fullmatch(line) if line[0] in _AS_NUMBER else None)


def header_key(line: str) -> str:
    """What stays the same in a running header: without page number, separators and letter case."""
    m = _numbered(line)
    return re.sub(r"\s+", " ", (m["head"] if m else line)).strip(" |·•–—/.…‧\t").casefold()


def furniture_marks(lines: list[str], page: int | None, headings: set[str]) -> Iterator[tuple[int, int, str]]:
    """(index, flags, header key) of the lines that are page numbers, or may be running headers."""
    n, certain = len(lines), set()
    stripped = [x.strip() for x in lines]
    top = next((i for i in range(n) if stripped[i]), n)
    bottom = next((i for i in range(n - 1, -1, -1) if stripped[i]), -1)
    for i, line in enumerate(stripped):
        if len(line) > PAGE_NUMBER_CHARS:
            if "  " not in line and "\t" not in line:
                continue
            line = " ".join(line.split())
            if len(line) > PAGE_NUMBER_CHARS:
                continue
        if not line or not _NUMBER_LIKE.search(line):
            continue
        if _BARE.fullmatch(line):
            if any(c.isdigit() for c in line) and (i in (top, bottom) or page is not None and line.translate(_AS_DIGITS) == str(page)):
                certain.add(i)
        elif _PAGE_NUMBER.fullmatch(line):
            certain.add(i)
        elif len(line) <= 8 and line.islower() and _ROMAN.fullmatch(line) and (not any(stripped[: max(0, i - 1)]) or not any(stripped[i + 2 :])):
            certain.add(i)
    for i in sorted(certain):
        yield i, CERTAIN, ""

    def filled(places) -> list[int]:
        found = []
        for i in places:
            if stripped[i] and i not in certain:
                found.append(i)
                if len(found) == EDGE_LINES:
                    break
        return found

    head, foot = filled(range(n)), filled(range(n - 1, -1, -1))
    edges = {i: k for k, i in enumerate(foot)}
    edges |= {i: min(k, edges.get(i, k)) for k, i in enumerate(head)}
    many = len({*head, *foot}) > 2
    widest = None
    for i, edge in edges.items():
        line = stripped[i]
        if len(line) > 80 or line in headings:
            continue
        m = _numbered(line)
        numbered = m is not None and page is not None and m["no"].translate(_AS_DIGITS) == str(page)
        if not numbered and (edge > 1 or len(line) > 60 or line[-1] in _SENTENCE_ENDS or _LISTED.match(line) or _SENTENCE_INSIDE.search(line)):
            continue
        if key := header_key(line):
            plain = not any(c.isdigit() for c in line)
            capital = plain and line.isupper() and len(line) >= 6
            title = plain and edge == 0 and many and len(line) <= 40
            if title:
                if widest is None:
                    widest = max((len(x) for i, x in enumerate(lines) if i not in certain), default=0)
                title = len(line) <= 0.7 * widest and not _MARKED_VOWELS.search(line) and not _garbled(line)
            yield i, HEADER | WITH_NUMBER * numbered | CAPITALS * capital | TITLE * title, key


# ---------------------------------------------------------------- text to keys


_LINE_MARK = re.compile("[-\u2010\u00ac\xad][ \t\r]*\n")
_SOFT_END = re.compile("\xad(?=[ \t\r]*\n)")


_SIGNS = re.compile(r"[\d!|$€£@§]")


def _is_word(token: str) -> bool:
    """Not a number: with two figures or signs at most, or a letter among them."""
    return len(found := _SIGNS.findall(token)) <= 2 or len(found) < len(token)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _context_keys(points: np.ndarray, at: np.ndarray, window: tuple[int, ...], shape: int) -> np.ndarray:
    """64-bit hashes of the context of each place."""
    key = np.full(len(at), np.uint64(shape + 1))
    for offset in window:
        key = (key ^ points[at + offset]) * _HASH_A
        key ^= key >> np.uint64(29)
    return key


def _gram_keys(context: np.ndarray, center: np.ndarray) -> np.ndarray:
    """48 bits of the context's hash and the 16 bits of the character, so that sorting the keys sorts both."""
    return ((context & _CONTEXT) | (center & _CENTER)).view(np.int64)


#: Every sequence of a wrong encoding begins with one of these: Latin capitals and letters from Â on, and what other codecs show for them.
_LEADS = re.compile("[\ufffd\x80-\x9f\u00ac\u00c2-\u00f4\u0192\u2248\u221a\u0152-\u0153\u0178\u2013\u2014\u2020-\u2021\u00b7\u201a\u201e\u2030\u2500-\u259f\u0393-\u03c6\u207f\u2219\u221e\u2229\u2261-\u2265\u2310\u2320\u2321\u00b1]")


def _garbled(line: str) -> bool:
    return not line.isascii() and _LEADS.search(line) is not None and (MARKS.search(line) is not None or _ANY_SEQUENCE.search(line) is not None)


class PageReader:
    """Splits one page into what both passes need."""

    def __init__(self, text: str, page: int | None, headings) -> None:
        # Normalised line by line, so line numbers stay those of the text.
        seen = text if text.isascii() else look(_SOFT_END.sub("¬", text) if "\xad" in text else text)
        self.lines = seen.split("\n")
        self.garbled = {i for i, x in enumerate(text.split("\n")) if _garbled(x)} if _garbled(text) else set()
        self._divided: list[tuple[int, int, str, str, str]] | None = None
        self.marks = list(furniture_marks(self.lines, page, {h.strip() for h in headings if h} if headings is not None else set()))
        self.skip = {i for i, flags, _ in self.marks if flags & (CERTAIN | WITH_NUMBER)}

    def divided(self) -> list[tuple[int, int, str, str, str]]:
        """(line, line of the rest, left part, right part, mark) of the words that are divided at a line end."""
        if self._divided is None:
            self._divided = list(self._find_divided())
        return self._divided

    def _find_divided(self) -> Iterator[tuple[int, int, str, str, str]]:
        n = len(self.lines)
        for i, x in enumerate(self.lines):
            if not x or x.rstrip()[-1:] not in ("-", "‐", "¬", "\xad") or i in self.skip or i in self.garbled or not (m := _DIVIDED.search(x)):
                continue
            j = i + 1
            while j < n and j in self.skip:
                j += 1
            right = _FIRST.match(self.lines[j].lstrip()) if j < n else None
            left = m[1].lstrip("“‘\"'«„(¿¡")
            if right and (right[0][0].islower() or left.isupper() and right[0].isupper() or not right[0][0].isalpha() and right[0][1:3].islower()):
                yield i, j, left, right[0], m[2]

    def joined(self) -> list[tuple[int, int, str, int]]:
        """The divided words, joined: (line, line of the rest, word, length of the left part)."""
        return [(i, j, left + right, len(left)) for i, j, left, right, _ in self.divided()]

    def whole_words(self) -> list[str]:
        """All words of the page but the halves of divided ones."""
        kept = self.lines
        if self.skip or self.garbled or self.divided():
            kept = [x if i not in self.skip and i not in self.garbled else "" for i, x in enumerate(self.lines)]
            for i, j, left, right, _ in self.divided():
                kept[i] = kept[i].rstrip()[: -len(left) - 1]
                kept[j] = kept[j].lstrip()[len(right) :]
        return _WORD.findall("\n".join(kept))

    def words_by_line(self) -> Iterator[tuple[int, str]]:
        """(line, word) of the same words."""
        cut = {i: left for i, _, left, _, _ in self.divided()}, {j: right for _, j, _, right, _ in self.divided()}
        for i, x in enumerate(self.lines):
            if i in self.skip or i in self.garbled or not x:
                continue
            if i in cut[0]:
                x = x.rstrip()[: -len(cut[0][i]) - 1]
            if i in cut[1]:
                x = x.lstrip()[len(cut[1][i]) :]
            for w in _WORD.findall(x):
                yield i, w

    def flow(self) -> str | None:
        """The lines run together as a reader reads them, without furniture, runs of figures as one; None without a script that is looked at in windows."""
        drop = self.skip | self.garbled
        text = "".join([x.strip() or "\n" for i, x in enumerate(self.lines) if i not in drop]) if drop else "".join([x.strip() or "\n" for x in self.lines])
        return f"\n\n\n{_DIGITS.sub('0', text)}\n\n\n" if _HAS_WINDOWS.search(text) else None

    def owners(self) -> list[int]:
        """The line of every character of flow()."""
        owner = [0, 0, 0]
        before = ""
        for i, x in enumerate(self.lines):
            if i in self.skip or i in self.garbled:
                continue
            made = x.strip() or "\n"
            cut = _DIGITS.sub("0", made)
            # A run of figures that goes on over the line end counts as one.
            owner += [i] * (len(cut) - (bool(before[-1:].isdigit()) and made[0].isdigit()))
            before = made
        return [*owner, *([len(self.lines) - 1] * 3)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """Places of gram keys in a bitmap of `size` bits, a power of two; their low bits are a character, so they are mixed once more."""
    return ((keys.view(np.uint64) * _HASH_A) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _in_windows(points: np.ndarray) -> np.ndarray:
    return (points >= 0x0E01) & (points <= 0x0E5B) | (points >= 0x3041) & (points <= 0x30FF) | (points >= 0x3400) & (points <= 0x4DBF) | (points >= 0x4E00) & (points <= 0x9FFF)


COLUMNS = "kind string, key long, x int, n long, page_id long, line_no int, src_id long, flags int, a string, b string"


_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in COLUMNS.split(", ")]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pdf = batch.to_pandas()
        words: Counter[str] = Counter()
        texts, out = [], []
        for page_id, src_id, page, headings, text in zip(pdf["page_id"], pdf["src_id"], pdf["page"], pdf["headings"], pdf["text"], strict=True):
            page, src_id = (None if v is None or v != v else int(v) for v in (page, src_id))
            reader = PageReader(text, page, headings)
            out += [("f", 0, page or 0, 1, page_id, i + 1, src_id, flags, key, None) for i, flags, key in reader.marks]
            out += [("y", 0, 0, 1, page_id, i + 1, src_id, int(mark in "¬\xad"), left, right) for i, _, left, right, mark in reader.divided()]
            words.update(reader.whole_words())
            words.update(w for _, _, w, _ in reader.joined())
            if (made := reader.flow()) is not None:
                texts.append(made)
        folded: Counter[str] = Counter()
        for w, n in words.items():
            if _is_word(w):
                folded[w.casefold()] += n
        out += [("w", _hash(w), 0, n, None, None, None, None, w, None) for w, n in folded.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)
        if texts:
            points = _points("".join(texts))
            inner = np.flatnonzero(_in_windows(points))
            inner = inner[(inner >= 3) & (inner < len(points) - 3)]
            for shape, window in enumerate(WINDOWS):
                grams, n = np.unique(_gram_keys(_context_keys(points, inner, window, shape), points[inner]), return_counts=True)
                size, bits = len(grams), grams.view(np.uint64)
                given = {"kind": pa.repeat("g", size), "key": pa.array((bits & _CONTEXT).view(np.int64)), "x": pa.array((bits & _CENTER).astype(np.int32)), "n": pa.array(n), "flags": pa.repeat(pa.scalar(shape, pa.int32()), size)}
                yield pa.RecordBatch.from_arrays([given.get(name, pa.nulls(size, t)) for name, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


# ---------------------------------------------------------------- words: trie and automaton


class Trie:
    """A vocabulary trie; nodes are dicts. The whole words beside it answer what is left after the last edit."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})

    def within(self, word: str, allowed: dict[str, set[str]] | None = None, edits: int = 1) -> Iterator[tuple[str, tuple[tuple[int, str, str], ...]]]:
        """(vocabulary word, edits as (place, read, meant)) for all that the automaton of the word accepts with one to `edits` edits.

        Edges: a character read for another, one read where none is meant, one meant that was not read (these three make it the Levenshtein
        automaton), two read for one (a merge undone), one read for two (a split undone); with `allowed` only the confusions it lists, the
        empty string standing for no character.
        """
        yield from self._walk(self.root, "", word, 0, edits, (), allowed)

    def _walk(self, node: dict, meant: str, word: str, at: int, left: int, done: tuple, allowed) -> Iterator[tuple[str, tuple]]:
        words, n, free = self.words, len(word), allowed is None
        for i in range(at, n + 1):
            one, two = word[i : i + 1], word[i : i + 2]
            here, tail_one, tail_two = word[i:], word[i + 1 :], word[i + 2 :]
            head = meant + word[at:i]
            before = word[i - 1] if i > at else ""
            for_one, for_two, for_none = (None, None, None) if free else (allowed.get(one, ()), allowed.get(two, ()), allowed.get("", ()))
            ways = []
            # In a run of equal letters the first place stands for all.
            if one and one != before and (free or "" in for_one):
                ways.append(("", node, i + 1, tail_one, one))
            for c, child in node.items():
                if c != one:
                    if one and (free or c in for_one):
                        ways.append((c, child, i + 1, tail_one, one))
                    if len(two) == 2 and c != two[1] and (free or c in for_two):
                        ways.append((c, child, i + 2, tail_two, two))
                    if one and (tail_one or free):
                        ways += [(c + d, grand, i + 1, tail_one, one) for d, grand in child.items() if d != one and (free or c + d in for_one)]
                if c != before and (free or c in for_none):
                    ways.append((c, child, i, here, ""))
            for into, reached, rest, tail, read in ways:
                found = head + into + tail
                if found in words and found != word:
                    yield found, (*done, (i, read, into))
                if left > 1:
                    yield from self._walk(reached, head + into, word, rest, left - 1, (*done, (i, read, into)), allowed)
            node = node.get(one)
            if node is None:
                return


FOUND = "a string, n long, meant string, meant_n long, place int, read string, into string, edits int"


def _vocabulary(words: DataFrame, trie_words: int, shortest: int = 3) -> tuple[DataFrame, int, int]:
    """Words that may be meant, the number of tries they need, and the count of the most frequent."""
    most = words.agg(F.max("n")).first()[0]
    # The least count is that of the evidence, whatever the size of the corpus; the tries carry the vocabulary.
    vocabulary = words.filter((F.col("n") >= RATIO) & (F.length("a") >= shortest) & ~F.col("a").rlike(r"[\d!|$€£@§]")).select("a", "n")
    return vocabulary, max(1, -(-vocabulary.count() // trie_words)), most or 0


def word_candidates(words: DataFrame, queries: DataFrame, allowed: dict[str, set[str]] | None = None, edits: int | None = 1, trie_words: int = TRIE_WORDS, shortest: int = 3) -> DataFrame:
    """a (the reading), n, meant, meant_n, place, read, into, edits: all vocabulary words that the automaton of a doubtful word reaches.

    edits: the most of a word; None: one for every two characters, rounded up. words, queries: a, n. Each trie holds a shard of the vocabulary; its size is bounded by trie_words, and every query meets every shard.
    """
    spark = words.sparkSession
    vocabulary, shards, _ = _vocabulary(words, trie_words, shortest)
    queries = queries.repartition(max(4, 2 * cores_of(spark)), "a")
    found = None
    for shard in range(shards):
        part = vocabulary.filter(F.pmod(F.xxhash64("a"), F.lit(shards)) == shard).toPandas()
        counts = spark.sparkContext.broadcast(dict(zip(part["a"], part["n"].astype(int), strict=True)))

        def search(batches: Iterator[pd.DataFrame], counts=counts) -> Iterator[pd.DataFrame]:
            known = counts.value
            trie = Trie(known)
            for pdf in batches:
                out = []
                for a, n in zip(pdf["a"], pdf["n"], strict=True):
                    for v, steps in trie.within(a, allowed, edits or (len(a) + 1) // 2):
                        if known[v] >= RATIO * n:
                            out += [(a, n, v, known[v], place, read, into, len(steps)) for place, read, into in steps]
                yield pd.DataFrame(out, columns=["a", "n", "meant", "meant_n", "place", "read", "into", "edits"])

        # Written before the next shard comes to the driver, so one shard at a time is held and broadcast.
        part_found = materialize(queries.mapInPandas(search, FOUND), "word-candidates")
        counts.destroy()
        found = part_found if found is None else found.unionByName(part_found)
    return found


def misread_words(words: DataFrame) -> DataFrame:
    """a (folded reading), meant, place: readings that the learnt confusions explain, each with its likeliest word."""
    _, _, most = _vocabulary(words, TRIE_WORDS)
    # Only a word that something may outnumber can be doubted.
    queries = words.filter((F.length("a") >= 2) & (F.col("n") * RATIO <= most)).select("a", "n")
    # An edit reads two characters at most and no meant word holds a figure or sign, so three of them are never one edit.
    signs = F.length("a") - F.length(F.regexp_replace("a", r"[\d!|$€£@§]", ""))
    single = word_candidates(words, queries.filter((F.length("a") >= 3) & (signs <= 2)))
    # A letter more or less at either end of a word is how words are inflected, a hyphen more or less how they are compounded: neither tells
    # anything. A letter inside a word may be a misreading.
    plain = (F.length("read") == 0) | (F.length("into") == 0)
    inside = (F.col("place") > 0) & (F.col("place") + F.length("read") < F.length("a")) & ~F.concat("read", "into").rlike(r"['’\-‐]")
    single = single.filter(~plain | inside)
    # A confusion: seen in several words; a figure or sign inside a word speaks for itself.
    learnt = single.groupBy("read", "into").agg(F.count_distinct("a").alias("words"), F.count_distinct("meant").alias("meanings"))
    least = F.when(F.col("read").rlike(r"[\d!|$€£@§]"), 2).otherwise(CONFUSION_WORDS)
    learnt = learnt.filter((F.col("words") >= least) & (F.col("meanings") >= least)).select("read", "into", "words")
    learnt = materialize(learnt, "confusions")
    # A word may be misread in several places, and short ones too; the learnt confusions, pairs of one or two letters each, prune that search.
    allowed: dict[str, set[str]] = defaultdict(set)
    for r in learnt.select("read", "into").toLocalIterator():
        allowed[r["read"]].add(r["into"])
    rest = queries.join(single.join(learnt, ["read", "into"], "left_semi").select("a").distinct(), "a", "left_anti")
    found = single.unionByName(word_candidates(words, rest, dict(allowed), None, shortest=2))
    explained = found.join(learnt, ["read", "into"]).groupBy("a", "n", "meant", "meant_n", "edits").agg(
        F.count_distinct("place").alias("got"), F.min("place").alias("place"), F.min("words").alias("words"), F.min(F.concat_ws(">", "read", "into")).alias("pair")
    )
    explained = explained.filter("got >= edits")  # more where several ways lead to the same word
    best = Window.partitionBy("a").orderBy(F.col("edits"), F.col("words").desc(), F.col("meant_n").desc(), "meant")
    return explained.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("a", "meant", "place", "pair")


def misread_grams(grams: DataFrame) -> DataFrame:
    """key (context), x, meant: readings of a character in a context, explained by a learnt confusion.

    grams: key, x, n, flags (window). A context holds as many rows as characters stand in it, so its window is small.
    """
    tops = materialize(grams.groupBy("key").agg(F.max(F.struct("n", "x")).alias("top"), F.count(F.lit(1)).alias("readings"), F.sum("n").alias("all_n")).filter(f"top.n >= {RATIO}"), "gram-tops")
    # Contexts with one reading only hold nothing to compare.
    pairs = grams.join(tops.filter("readings > 1"), "key").filter((F.col("x") != F.col("top.x")) & (F.col("top.n") >= RATIO * F.col("n")))
    pairs = pairs.select("key", "flags", "x", "n", F.col("top.x").alias("meant"), F.col("top.n").alias("meant_n"), "all_n")
    pairs = materialize(pairs, "gram-pairs")
    # Firm evidence: frequent contexts in which hardly anything but the two characters is ever read.
    clear = pairs.filter((F.col("meant_n") >= FIRM_LEAST) & (F.col("meant_n") >= FIRM_RATIO * F.col("n")) & (F.col("meant_n") + F.col("n") >= 0.93 * F.col("all_n")))
    learnt = clear.groupBy("x", "meant").agg(F.sum("meant_n").alias("shown_n"), F.count(F.lit(1)).alias("contexts"), F.count_distinct("flags").alias("shapes"))
    # A misreading hits a character wherever it stands: it shows in the contexts that make up a good part of the character's firm ones. Another
    # word that fits a few contexts as well does not. Both are shares, so more text makes neither easier to reach.
    everywhere = tops.filter(F.col("top.n") >= FIRM_LEAST).groupBy(F.col("top.x").alias("meant")).agg(F.sum("top.n").alias("firm_n"))
    learnt = learnt.filter("contexts >= 3 AND shapes >= 2").join(everywhere, "meant").filter(F.col("shown_n") >= BREADTH * F.col("firm_n")).select("x", "meant", "contexts")
    # A character that is often put for one character is not also put for others: keep its strongest meaning, and near ones.
    strongest = Window.partitionBy("x")
    learnt = learnt.withColumn("_m", F.max("contexts").over(strongest)).filter("contexts * 4 >= _m").select("x", "meant")
    return pairs.join(learnt, ["x", "meant"]).select("key", "x", "meant").distinct()


# ---------------------------------------------------------------- second pass


def _second_pass(bits: bytes, centers: list[int]):
    n_bits = 8 * len(bits)
    bitmap = np.frombuffer(bits, dtype=np.uint8)
    wanted = np.zeros(max([*centers, 0]) + 2, dtype=bool)
    wanted[centers] = True
    finds = re.compile("[" + "".join(map(re.escape, map(chr, centers))) + "]") if centers else None

    known: dict[str, int] = {}

    def holds(h: int) -> bool:
        return bool(bits[(h % n_bits) >> 3] >> (h & 7) & 1)

    def key_of(w: str) -> int:
        """The key of a word that the bitmap holds, else 0."""
        key = known.get(w)
        if key is None:
            if len(known) > 200_000:
                known.clear()
            h = _hash(w.casefold())
            key = known[w] = h if holds(h) and _is_word(w) else 0
        return key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, flows = [], []
            for page_id, page, headings, text in zip(pdf["page_id"], pdf["page"], pdf["headings"], pdf["text"], strict=True):
                centered = finds is not None and finds.search(text) is not None
                if not centered and not _LINE_MARK.search(text) and not any(map(key_of, set(_WORD.findall(text if text.isascii() else look(text))))):
                    continue  # no divided word, no word and no character to look up
                reader = PageReader(text, None if page is None or page != page else int(page), headings)
                hits = {w for w in set(reader.whole_words()) if key_of(w)}
                if hits:
                    out += [(page_id, i + 1, i + 1, 0, "w", _hash(w.casefold()), 0) for i, w in reader.words_by_line() if w in hits]
                for i, j, w, size in reader.joined():
                    h = _hash(w.casefold())
                    if holds(h):
                        out.append((page_id, i + 1, j + 1, size, "w", h, 0))
                if centered and (made := reader.flow()) is not None:
                    flows.append((page_id, reader, made))
            if flows:
                # The windows of all pages of the batch at once; the line ends around each page keep them apart.
                points = _points("".join(made for _, _, made in flows))
                begins = np.cumsum([0, *(len(made) for _, _, made in flows)])
                at = np.flatnonzero(wanted[np.minimum(points, np.uint64(len(wanted) - 1))])
                at = at[(at >= 3) & (at < len(points) - 3)]
                owners: dict[int, list[int]] = {}
                for shape, window in enumerate(WINDOWS):
                    context = _context_keys(points, at, window, shape)
                    place = _bits(_gram_keys(context, points[at]), n_bits)
                    hit = np.flatnonzero(bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    pages = np.searchsorted(begins, at[hit], side="right") - 1
                    for k, a, c, x in zip(pages.tolist(), (at[hit] - begins[pages]).tolist(), (context[hit] & _CONTEXT).view(np.int64).tolist(), points[at[hit]].tolist(), strict=True):
                        page_id, reader, _ = flows[k]
                        if k not in owners:
                            owners[k] = reader.owners()
                        line = owners[k][a] + 1
                        out.append((page_id, line, line, 0, "g", c, x))
            yield pd.DataFrame(out, columns=["page_id", "line_no", "rest_line", "split", "kind", "key", "x"])

    return run


@F.pandas_udf(T.LongType())
def _key_of_word(a: pd.Series) -> pd.Series:
    return a.map(_hash)


def _bitmap(words: DataFrame, grams: DataFrame) -> bytes:
    """The bitmap of the keys of words (key) and grams (key, x): words of 64 bits, made per partition and merged; only those that are not empty come to the driver."""
    keys = words.count() + grams.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * keys).bit_length()))

    def packed(bits: np.ndarray) -> pd.DataFrame:
        bits = np.unique(bits)
        at, first = np.unique(bits >> 6, return_index=True)
        held = np.left_shift(np.uint64(1), (bits & 63).astype(np.uint64))
        return pd.DataFrame({"word": at.astype(np.int32), "bits": np.bitwise_or.reduceat(held, first).view(np.int64) if len(at) else held.view(np.int64)})

    def of_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield packed(pdf["key"].to_numpy(np.int64) % size)

    def of_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield packed(_bits(_gram_keys(pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["x"].to_numpy().astype(np.uint64)), size))

    rows = words.select("key").mapInPandas(of_words, "word int, bits long").unionByName(grams.select("key", "x").mapInPandas(of_grams, "word int, bits long"))
    merged = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    made = np.zeros(size // 64, dtype=np.int64)
    made[merged["word"].to_numpy()] = merged["bits"].to_numpy()
    return made.tobytes()


def furniture_lines(first: DataFrame) -> DataFrame:
    """(page_id, line_no) of page numbers and running headers; first: the rows of the first pass."""
    rows = first.filter("kind = 'f'").select("page_id", "line_no", "src_id", "flags", F.col("a").alias("key"), F.col("x").alias("page"))
    certain = rows.filter(F.col("flags").bitwiseAND(CERTAIN | WITH_NUMBER | CAPITALS | TITLE) > 0).select("page_id", "line_no")
    heads = rows.filter(F.length("key") > 0)
    pages = heads.groupBy("src_id").agg(F.approx_count_distinct("page", 0.02).alias("src_pages"))
    keys = heads.groupBy("src_id", "key").agg(
        F.count_distinct("page").alias("on"), F.max(F.col("flags").bitwiseAND(WITH_NUMBER | CAPITALS | TITLE)).alias("strong")
    )
    keys = keys.join(pages, "src_id").filter((F.col("strong") > 0) | (F.col("on") >= F.greatest(F.lit(2), F.col("src_pages") * 0.05))).select("src_id", "key")
    keys = materialize(keys, "header-keys")
    same = heads.join(keys, ["src_id", "key"], "left_semi").select("page_id", "line_no")
    # A header with a misread character shares at least one half with the header of its source.
    rest = heads.join(keys, ["src_id", "key"], "left_anti").filter(F.length("key") >= 4)

    def halves(df, name):
        half = F.expr("array(concat('<', left(key, int(length(key) / 2))), concat('>', substring(key, int(length(key) / 2) + 1)))")
        return df.withColumn("half", F.explode(half)).withColumnRenamed("key", name)

    # Each reading once, however many pages of a source show it.
    near = halves(rest.select("src_id", "key").distinct(), "key").join(halves(keys.filter(F.length("key") >= 4), "header"), ["src_id", "half"])
    near = near.filter(F.levenshtein("key", "header") <= F.greatest(F.lit(1), F.floor(F.length("header") / 8))).select("src_id", "key").distinct()
    near = rest.join(near, ["src_id", "key"], "left_semi").select("page_id", "line_no")
    return certain.unionByName(same).unionByName(near).distinct()


def divided_lines(first: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, line_no) of the lines whose last word is divided by a mark that goes when they are joined.

    A hyphen stays where the compound is the likelier word: it is met more often than the joined one, or both its parts are words
    and the joined one is none.
    """
    rows = first.filter("kind = 'y'").select("page_id", "line_no", "flags", F.lower("a").alias("lft"), F.lower("b").alias("rgt"))
    soft, hard = rows.filter("flags = 1"), rows.filter("flags = 0")
    pairs = hard.select("lft", "rgt").distinct()
    asked = pairs.select("lft", "rgt", F.explode(F.array(F.concat("lft", "rgt"), F.concat_ws("-", "lft", "rgt"), F.regexp_extract("lft", r"([^\-‐]*)$", 1), F.col("rgt"))).alias("a"))
    met = asked.distinct().join(words, "a", "left").na.fill(0, ["n"])
    counts = met.groupBy("lft", "rgt").agg(
        F.max(F.when(F.col("a") == F.concat("lft", "rgt"), F.col("n"))).alias("joined"),
        F.max(F.when(F.col("a") == F.concat_ws("-", "lft", "rgt"), F.col("n"))).alias("compound"),
        F.max(F.when(F.col("a") == F.regexp_extract("lft", r"([^\-‐]*)$", 1), F.col("n"))).alias("left_n"),
        F.max(F.when(F.col("a") == F.col("rgt"), F.col("n"))).alias("right_n"),
    )
    # The joined form was counted from these very places, so once is no evidence.
    kept = (F.col("compound") > 0) & (F.col("compound") * 3 >= F.col("joined")) | (F.col("joined") <= 1) & (F.col("left_n") >= 5) & (F.col("right_n") >= 5)
    goes = hard.join(counts.filter(~kept).select("lft", "rgt"), ["lft", "rgt"], "left_semi")
    return soft.select("page_id", "line_no").unionByName(goes.select("page_id", "line_no"))


class Analysis:
    """Both passes over the pages; every table it holds is written in the shared folder."""

    def __init__(self, pages: DataFrame):
        rows = pages.filter((F.length(F.trim("text")) > 0) & F.col("page_id").isNotNull()).select("page_id", "src_id", "page", "headings", "text")
        self.first = materialize(rows.mapInArrow(_first_pass, COLUMNS), "noise-first")
        self.words = materialize(self.first.filter("kind = 'w'").groupBy("a").agg(F.sum("n").alias("n")), "words")
        grams = materialize(self.first.filter("kind = 'g'").groupBy("key", "x", "flags").agg(F.sum("n").alias("n")), "grams")
        self.bad_words = materialize(misread_words(self.words).withColumn("key", _key_of_word("a")), "misread-words")
        self.bad_grams = materialize(misread_grams(grams), "misread-grams")
        bits = _bitmap(self.bad_words, self.bad_grams)
        # Characters that stand for others: a subset of the scripts' characters, whatever the size of the corpus.
        centers = sorted(r["x"] for r in self.bad_grams.select("x").distinct().toLocalIterator())
        hits = rows.select("page_id", "page", "headings", "text").mapInPandas(_second_pass(bits, centers), "page_id long, line_no int, rest_line int, split int, kind string, key long, x int")
        self.hits = materialize(hits, "noise-hits")
        self.furniture = materialize(furniture_lines(self.first), "furniture")

    def misread(self) -> DataFrame:
        """page_id, line_no, reading, meant of the misreadings whose confusion keeps company with others on its pages."""
        words = self.hits.filter("kind = 'w'").join(self.bad_words, "key").select(
            "page_id", F.when((F.col("split") > 0) & (F.col("place") >= F.col("split")), F.col("rest_line")).otherwise(F.col("line_no")).alias("line_no"), F.col("a").alias("reading"), "meant", "pair"
        )
        grams = self.hits.filter("kind = 'g'").join(self.bad_grams, ["key", "x"])
        shown = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        grams = grams.select("page_id", "line_no", shown("x").alias("reading"), shown("meant").alias("meant")).withColumn("pair", F.concat_ws(">", "reading", "meant"))
        found = words.unionByName(grams).distinct()
        shown_on = found.select("page_id", "pair").distinct()
        crowd = shown_on.groupBy("page_id").agg(F.count(F.lit(1)).alias("pairs"))
        company = shown_on.join(crowd, "page_id").groupBy("pair").agg(F.avg(F.when(F.col("pairs") > 1, 1.0).otherwise(0.0)).alias("share"))
        told = company.filter((F.col("share") >= COMPANY) | F.col("pair").rlike(r"^[^>]*[\d!|$€£@§]")).select("pair")
        return found.join(told, "pair").select("page_id", "line_no", "reading", "meant")

    def lines(self) -> DataFrame:
        """(page_id, line_no, kind) of all cases."""
        cases = divided_lines(self.first, self.words).withColumn("kind", F.lit("hyphen")).unionByName(self.misread().select("page_id", "line_no").withColumn("kind", F.lit("misread")))
        cases = cases.distinct().join(self.furniture, ["page_id", "line_no"], "left_anti")
        return cases.unionByName(self.furniture.withColumn("kind", F.lit("furniture")))


def noisy_lines(pages: DataFrame) -> DataFrame:
    return Analysis(pages).lines()


def repaired_pages(pages: DataFrame) -> DataFrame:
    """page_id, text as continuous paragraphs: furniture removed, divided words joined, misreadings replaced, lines reflowed."""
    found = Analysis(pages)
    marks = found.furniture.select("page_id", F.struct("line_no", F.lit("furniture").alias("kind"), F.lit("").alias("reading"), F.lit("").alias("meant")).alias("m"))
    cases = divided_lines(found.first, found.words)
    marks = marks.unionByName(cases.select("page_id", F.struct("line_no", F.lit("hyphen").alias("kind"), F.lit("").alias("reading"), F.lit("").alias("meant")).alias("m")))
    marks = marks.unionByName(found.misread().select("page_id", F.struct("line_no", F.lit("misread").alias("kind"), "reading", "meant").alias("m")))
    rows = pages.select("page_id", "text").join(marks.groupBy("page_id").agg(F.sort_array(F.collect_set("m")).alias("marks")), "page_id", "left")

    @F.pandas_udf("string")
    def reflow(text: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else _reflowed(t, m) for t, m in zip(text, marks, strict=True)], dtype=object)

    return rows.select("page_id", reflow("text", "marks").alias("text"))


def _reflowed(text: str, marks) -> str:
    by: dict[int, list] = defaultdict(list)
    for m in marks if marks is not None else ():
        by[m["line_no"]].append(m)
    out, glue = [], ""
    for no, line in enumerate(text.split("\n"), 1):
        kinds = {m["kind"] for m in by[no]}
        if "furniture" in kinds:
            continue
        line = line.strip()
        for m in by[no]:
            if m["kind"] == "misread":
                line = re.sub(re.escape(m["reading"]), lambda x, m=m: m["meant"].capitalize() if x[0][:1].isupper() else m["meant"], line, flags=re.I)
        if not line:
            out.append("\n\n")
            glue = ""
            continue
        if "hyphen" in kinds:
            line = line.rstrip("-‐¬\xad ")
        out += [glue, line]
        glue = "" if "hyphen" in kinds or _HAS_CJK.match(line[-1:]) or line[-1:] in "，。、；：！？」』）" else " " if not line.endswith(("-", "‐")) else ""
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()
