"""Problem 6: text that was decoded with the wrong character encoding.

Every candidate decoding of a suspect line (the wrong codec undone, the right one applied) is compressed with zstandard under a dictionary
of each language it may be in, and the BEAM shortest are undone further, for chains of up to MAX_STEPS. The chain of minimum description
length wins: compressed size plus the cost of its steps and of what stays lost. A line that no chain shortens is left unchanged; it still counts as garbled where it
holds marks that only wrong decoding leaves (replacement characters, C1 controls).

The regular characters of each script and the dictionary of each language are counted over all pages: a dictionary holds the pairs of
neighbouring pieces (words, or characters of scripts without spaces) that save most by their count, and codes single bytes by theirs. Only sums
decide, so neither order nor partitions of the pages matter. Pages that show what wrong decoding leaves teach neither. Every page is then judged
against the model.

Defined results: null and empty texts are never garbled and stay as they are; each row is judged on its own.
"""

from __future__ import annotations

import re
import struct
from codecs import charmap_encode
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.language import WORDS, languages
from leafmill.llm.lookalike import look, visible_table

#: Bytes of each dictionary; and what a reference to it takes, which a pair has to be longer than.
DICTIONARY_BYTES, REFERENCE_BYTES = 32_768, 3
#: Description cost in bytes: of a step of the chain, of each character that stays lost, and the least gain for a change.
STEP_COST, LOST_COST, LEAST_GAIN, MAX_STEPS = 3, 6, 1, 3
#: Decodings that a step hands on to the next one.
BEAM = 4
#: No compressed text is shorter, in bytes.
LEAST_BYTES = 3
#: A character is regular for the corpus if this share of a script's clean pages holds it.
REGULAR_SHARE = 0.004

# Codecs that texts get wrongly decoded with, and codecs that they were written in.
SINGLE_WRONG = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "iso8859_15", "cp874", "koi8_r", "iso8859_7")
MULTI = ("gb18030", "cp950", "cp932", "cp949", "euc_jp")
SINGLE_RIGHT = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")


def _ranges(chars) -> str:
    """The inside of a character class, with runs as ranges; a class of single characters beyond the BMP would be searched one by one."""
    runs: list[list[int]] = []
    for p in sorted(map(ord, chars)):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" if z > a else re.escape(chr(a)) for a, z in runs)


@cache
def _byte_table(codec: str) -> dict[int, int]:
    """Character to byte of a single-byte codec; bytes without a character stand as C1 controls, as lenient decoders leave them."""
    table = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            pass
    return {b: b for b in range(0x80, 0xA0) if b not in table.values() or codec == "cp1252"} | ({b: b for b in range(0x80, 0xA0)} if codec == "cp1252" else {}) | table


def _utf8_pairs(codec: str) -> str:
    """Pattern of a UTF-8 sequence as the codec shows it: a lead character and as many continuation characters as it asks for."""
    shown = {b: chr(c) for c, b in _byte_table(codec).items()}
    of = lambda a, z: "[" + "".join(re.escape(shown[b]) for b in range(a, z + 1) if b in shown) + "]"
    cont = of(0x80, 0xBF)
    # Two-byte leads: Latin, Greek, Cyrillic and Arabic; the others are quotation marks in some codecs and would hit clean text.
    two = "[" + "".join(re.escape(shown[b]) for b in (0xC2, 0xC3, 0xC4, 0xC5, 0xCE, 0xCF, 0xD0, 0xD1, 0xD8, 0xD9) if b in shown) + "]"
    return f"{two}{cont}|{of(0xE0, 0xEF)}{cont}{{2}}|{of(0xF0, 0xF4)}{cont}{{3}}"


#: UTF-8 seen through the commonest single-byte codecs.
SEQUENCES = {codec: re.compile(_utf8_pairs(codec)) for codec in ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1254")}
_COMMON = ("cp1252", "cp437", "mac_roman", "cp850")
_SEQUENCE = "|".join(SEQUENCES[k].pattern for k in _COMMON)
_LEADS = _ranges({chr(c) for k in _COMMON for c, b in _byte_table(k).items() if b >= 0xC2})
#: Box drawing, private use, and letters and signs inside a word of another script.
_span = lambda *pairs: "".join(f"{chr(a)}-{chr(z)}" for a, z in pairs)
_BOXES, _OTHER_SCRIPT = _span((0x2500, 0x259F), (0xE000, 0xF8FF)), _span((0x370, 0x52F), (0xE00, 0xE5B))
_SIGNS = _span((0xA2, 0xAA), (0xAC, 0xAC), (0xAE, 0xB4), (0xB6, 0xB6), (0xB8, 0xBA), (0xBC, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2C6, 0x2DD), (0x201A, 0x201A), (0x201E, 0x201E), (0x2020, 0x2022), (0x2030, 0x2030), (0x2122, 0x2122))
_ODD = f"[{_BOXES}]|(?<=[A-Za-z])[{_OTHER_SCRIPT}](?=[a-z])|(?<=[a-z])[{_SIGNS}](?=[a-z])"
_ODD_LEADS = _BOXES + _OTHER_SCRIPT + _SIGNS
# What a match begins with is asked first, for most characters begin none.
_ANY_SEQUENCE = re.compile(f"(?=[{_LEADS}])(?:{_SEQUENCE})")
ODD = re.compile(f"(?=[{_ODD_LEADS}])(?:{_ODD})")
_EITHER = re.compile(f"(?=[{_LEADS}{_ODD_LEADS}])(?:{_SEQUENCE}|{_ODD})")
#: What only wrong decoding leaves.
MARKS = re.compile("[�\x80-\x84\x86-\x9f]")
_SCRIPTS = tuple((k, re.compile(f"[{p}]")) for k, p in (("th", "ก-๛"), ("hi", "ऀ-ॿ"), ("ja", "ぁ-ヿ"), ("zh", "一-鿿")))
#: Characters that only multi-byte codecs hold.
_WIDE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef\U00010000-\U0010ffff]")


def _utf8_behind(line: str) -> bool:
    """Whether a line is valid UTF-8, seen through one of the commonest codecs."""
    for codec in _COMMON:
        table = _byte_table(codec)
        raw = bytes(table.get(ord(c), 0xFF) for c in line)
        try:
            if len(raw.decode()) < len(raw):
                return True
        except UnicodeDecodeError:
            pass
    return False


def _clean(text: str) -> bool:
    """Whether a page shows nothing that wrong decoding leaves; only such pages teach."""
    if text.isascii() or not MARKS.search(text) and not _EITHER.search(text):
        return True
    return not MARKS.search(text) and not ODD.search(text) and not any(_utf8_behind(x) for x in text.split("\n") if _ANY_SEQUENCE.search(x))


class Model:
    """Per-language dictionaries and the regular characters; small, made on the driver, shipped with the tasks."""

    def __init__(self, held: dict[str, dict[str, int]], octets: dict[str, np.ndarray], pairs: dict[str, list[tuple[str, str, int]]]):
        """held: per script, how many clean pages hold each character, and under "" how many there are; per language, octets: the counts of the
        256 bytes; pairs: (piece, next piece, count), best first, DICTIONARY_BYTES of them at most."""
        regular = {chr(c) for c in range(0x20, 0x7F)} | {"\n", "\r", "\t"}
        for script, counts in held.items():
            # Several languages share the Latin script, each with letters of its own.
            least = max(2, REGULAR_SHARE * counts[""] / (len(WORDS) if script == "latin" else 1))
            regular |= {c for c, n in counts.items() if c and n >= least}
        self.regular = "".join(sorted(regular))
        self.raw = {lang: _dictionary(rows, octets[lang]) for lang, rows in sorted(pairs.items())}

    def judge(self) -> Judge:
        return Judge(self.raw, self.regular)


def _chains(pairs: list[tuple[str, str, int]]) -> list[str]:
    """Texts that hold every pair once, each begun with the best pair left and carried on with the best that follows."""
    after: dict[str, list[str]] = defaultdict(list)
    for first, then, _ in reversed(pairs):
        after[first].append(then)
    made = []
    for first, _, _ in pairs:
        if after[first]:
            chain, at = [first], first
            while follows := after.get(at):
                at = follows.pop()
                chain.append(at)
            made.append("".join(chain))
    return made


def _dictionary(pairs: list[tuple[str, str, int]], octets: np.ndarray) -> bytes:
    """A zstandard dictionary of as many of the pairs, best first, as it has room for; the best stand last, where references are shortest."""
    size = lambda n: sum(len(x.encode()) + 1 for x in _chains(pairs[:n]))
    low, high = 0, len(pairs)
    while low < high:  # the most pairs that fit
        n = (low + high + 1) // 2
        low, high = (n, high) if size(n) <= DICTIONARY_BYTES else (low, n - 1)
    content = "\n".join(reversed(_chains(pairs[:low]))).encode().rjust(8)
    head = _literal_code(octets)
    if head is None:
        return content
    return b"\x37\xa4\x30\xec\x01\x00\x00\x00" + head + b"".join(map(_norms, _CODES)) + struct.pack("<3I", 1, 4, 8) + content


# Shares of the codes of offsets (those of 32 kB most), match lengths (short ones) and literal lengths (none or few), as 64, 128 and 64 parts.
_CODES = ((6, [1] * 9 + [6] * 7 + [1] * 13), (7, [4] + [7] * 12 + [1] * 40), (6, [14, 9, 5, 4] + [1] * 32))


def _norms(code: tuple[int, list[int]]) -> bytes:
    """The description of a code without empty symbols in the format of zstandard (RFC 8878, 4.1.1)."""
    log, norm = code
    out, at = log - 5, 4
    left, threshold, bits = (1 << log) + 1, 1 << log, log + 1
    for n in norm:
        most = 2 * threshold - 1 - left
        left -= n
        value = n + 1
        if value >= threshold:
            value += most
        out |= value << at
        at += bits - (value < most)
        while left < threshold:
            bits, threshold = bits - 1, threshold >> 1
    return out.to_bytes((at + 7) // 8, "little")


def _literal_code(octets: np.ndarray) -> bytes | None:
    """The description of the Huffman code of bytes that occur so often: taken from a block of such bytes, which zstandard codes by it. None where coding does not pay."""
    share = 1 + np.floor(octets * (60_000 / max(1, octets.sum()))).astype(np.int64)
    block = np.random.default_rng(0).permutation(np.repeat(np.arange(256, dtype=np.uint8), share)).tobytes()
    params = zstandard.ZstdCompressionParameters(window_log=17, min_match=7, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    made = zstandard.ZstdCompressor(compression_params=params).compress(block)
    literals = made[2 + 3 :]  # behind the headers of the frame and of its block
    if made[2] >> 1 & 3 != 2 or literals[0] & 3 != 2:
        return None
    tree = literals[{0: 3, 1: 3, 2: 4, 3: 5}[literals[0] >> 2 & 3] :]
    return tree[: 1 + (tree[0] if tree[0] < 128 else (tree[0] - 126) // 2)]


class Judge:
    """Judges lines; lives in a Python worker."""

    def __init__(self, raw: dict[str, bytes], regular: str):
        self.squeeze = {k: zstandard.ZstdCompressor(dict_data=_precomputed(v), compression_params=_PARAMS) for k, v in raw.items()}
        known = set(regular) | {chr(c) for c in visible_table() if not 0xFF66 <= c <= 0xFF9F}
        self.irregular = re.compile(f"[^{_ranges(c for c in known if c != '\ufffd' and not '\x80' <= c <= '\x9f')}]")
        self.latin = [k for k in ("en", "de", "fr", "es") if k in self.squeeze]

    def suspect(self, text: str) -> bool:
        """Whether a text or line goes to the search; a text without one suspect line is clean."""
        return not text.isascii() and (self.irregular.search(text) is not None or _EITHER.search(text) is not None)

    def _languages(self, text: str) -> list[str]:
        scripts = [k for k, p in _SCRIPTS if k in self.squeeze and p.search(text)]
        return scripts or self.latin or list(self.squeeze)[:1]

    def packed(self, text: str) -> int:
        """Bytes of the shortest description of a text under any language that its script allows."""
        raw = text.encode("utf-8", "replace")
        return min((len(self.squeeze[k].compress(raw)) for k in self._languages(text)), default=len(raw))

    def size(self, text: str) -> int:
        """Its description, and the cost of the characters in it that are lost."""
        return self.packed(text) + LOST_COST * len(MARKS.findall(text))

    def candidates(self, line: str, room: float) -> Iterator[tuple[str, str, int]]:
        """(step, decoding, characters lost) of all ways to undo one wrong decoding that lose `room` characters at most; equal decodings come once, by the first step that gives them.

        Characters are lost where the wrong codec does not hold them or the right one cannot read them; replacement characters are lost for good.
        """
        seen = {line}
        text = line.replace("\ufffd", "")
        bare = len(line) - len(text)
        ways: dict[bytes, tuple[str, tuple[str, ...], int]] = {}  # equal bytes are decoded once
        if not _WIDE.search(text):
            for wrong in SINGLE_WRONG:
                try:
                    ways.setdefault(charmap_encode(text, "strict", _byte_table(wrong))[0], (wrong, ("utf-8", *MULTI, *SINGLE_RIGHT), bare))
                except UnicodeEncodeError:
                    pass
        else:
            for wrong in MULTI:
                raw = text.encode(wrong, "ignore")
                ways.setdefault(raw, (wrong, ("utf-8", *MULTI, "cp1252"), bare + len(text) - len(raw.decode(wrong, "ignore"))))
        for raw, (wrong, rights, gone) in ways.items():
            if gone > room:
                continue
            for right in rights:
                if right != wrong and (made := raw.decode(right, "replace")) not in seen and gone + made.count("\ufffd") <= room:
                    seen.add(made)
                    yield f"{wrong}>{right}", made, gone

    def repair(self, line: str) -> tuple[str, str, bool]:
        """(best text, chain, garbled) of a line by minimum description length over the chains of up to MAX_STEPS steps.

        All decodings of a step are compressed; the BEAM shortest descriptions that still hold something suspect are carried on, whether
        or not they are shorter than the line itself. What is lost stays lost and every step costs, so a decoding whose losses and steps
        alone cost as much as the best description so far is cut off.
        """
        if not self.suspect(line):
            return line, "", False
        best, chain, least = line, "", self.size(line)
        # Look-alike letters and odd spaces explain a line without any decoding; a chain has to be shorter than that, too.
        if (seen := look(line)) != line:
            least = min(least, self.size(seen) + STEP_COST)
        least -= LEAST_GAIN
        front, reached = [(0, line, "", 0)], {line}
        for step in range(1, MAX_STEPS + 1):
            found = []
            for _, text, way, lost in front:
                for name, made, gone in self.candidates(text, (least - LEAST_BYTES - STEP_COST * step) / LOST_COST - lost):
                    if made not in reached:
                        reached.add(made)
                        found.append((self.size(made) + STEP_COST * step + LOST_COST * (lost + gone), made, f"{way} {name}".strip(), lost + gone))
            found.sort()
            if found and found[0][0] <= least:
                least, best, chain, _ = found[0]
                least -= 1e-9  # a later chain has to be shorter
            front = []
            for node in found:
                if self.suspect(node[1]):
                    front.append(node)
                    if len(front) == BEAM:
                        break
        return best, chain, bool(chain) or MARKS.search(line) is not None


_PARAMS = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def _precomputed(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(compression_params=_PARAMS)
    return d


_LETTERS = tuple((k, frozenset(map(chr, r))) for k, r in (("ja", range(0x3041, 0x3100)), ("th", range(0x0E01, 0x0E5C)), ("hi", range(0x0900, 0x0980))))


def _script(chars: set[str]) -> str:
    """Whose statistics a page adds to."""
    for script, held in _LETTERS:
        if not held.isdisjoint(chars):
            return script
    return "zh" if _WIDE.search("".join(chars)) else "latin"


#: Languages written without spaces, whose pieces are characters; and where their letters begin.
_WORDLESS, _FIRST_WIDE = ("zh", "ja", "th"), 0x0E00
#: Pieces of other texts: a word with the space before it, any other character. And a word amid wordless text, with the character after it.
_PIECES, _WORD_AMID = re.compile(r" ?[^\W_]+|[\W_]"), re.compile("( ?[A-Za-z0-9À-ɏ]{2,}+)([^\n])")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _pairs(lang: str, texts: list[str]) -> tuple[list[str], list[str], list[int]]:
    """Pieces, the piece after each in its line, and how often they stand so."""
    pairs: Counter = Counter()
    if lang not in _WORDLESS:
        for text in texts:
            pairs.update(pairwise(_PIECES.findall(text)))
        rows = [(a, b, n) for (a, b), n in pairs.items() if a != "\n" and b != "\n"]
        return [a for a, _, _ in rows], [b for _, b, _ in rows], [n for _, _, n in rows]
    for text in texts:
        pairs.update(_WORD_AMID.findall(text))
    points = _points("\n".join(texts))
    first, then = points[:-1], points[1:]
    wide = ((first >= _FIRST_WIDE) | (then >= _FIRST_WIDE)) & (first != 10) & (then != 10)
    keys, n = np.unique(first[wide].astype(np.uint64) << np.uint64(21) | then[wide], return_counts=True)
    return [*map(chr, (keys >> np.uint64(21)).tolist()), *(a for a, _ in pairs)], [*map(chr, (keys & np.uint64(0x1FFFFF)).tolist()), *(b for _, b in pairs)], [*n.tolist(), *pairs.values()]


def _portions(texts: Iterator[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """The texts in lists of about so many characters, all of them."""
    part, room = [], most
    for text in texts:
        part.append(text)
        room -= len(text)
        if room <= 0:
            yield part
            part, room = [], most
    if part:
        yield part


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind, whose, a, b, n over the clean pages, in portions: "held", a script, a character and how many pages hold it (a = "" for the pages
    themselves); "octet", a language, a byte as a character and how often it stands there; "pair", a language, a piece and the next one."""
    for clean in _portions(text for pdf in batches for text in pdf["text"] if _clean(text)):
        groups: dict[str, list[str]] = defaultdict(list)
        pages: dict[str, list[str]] = defaultdict(list)
        for text, lang in zip(clean, languages(clean), strict=True):
            chars = set(text)
            groups[_script(chars)].append("".join(chars - {"\0"}))
            pages[lang].append(text)
        out = []
        for script, held in groups.items():
            points, n = np.unique(_points("".join(held)), return_counts=True)
            out.append(pd.DataFrame({"kind": "held", "whose": script, "a": ["", *map(chr, points.tolist())], "b": "", "n": [len(held), *n.tolist()]}))
        for lang, texts in pages.items():
            if lang != "und":
                octets = np.bincount(np.frombuffer("".join(texts).encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
                out.append(pd.DataFrame({"kind": "octet", "whose": lang, "a": [chr(c) for c in range(256)], "b": "", "n": octets.tolist()}))
                first, then, n = _pairs(lang, texts)
                out.append(pd.DataFrame({"kind": "pair", "whose": lang, "a": first, "b": then, "n": n}))
        yield from out


def fit(pages: DataFrame) -> Model:
    """The model, from counts over all pages. To the driver come a row per script and character, which Unicode bounds, 256 per language, and the
    best DICTIONARY_BYTES pairs of a language: a dictionary cannot hold more, for each takes a byte at least."""
    rows = pages.filter(F.length("text") > 0).select("text")
    counts = rows.mapInPandas(_counted, "kind string, whose string, a string, b string, n long").groupBy("kind", "whose", "a", "b").agg(F.sum("n").alias("n"))
    # What a reference in its place saves, wherever a pair stands; one that stands once would save nothing.
    counts = counts.withColumn("saves", F.when(F.col("kind") == "pair", F.col("n") * (F.octet_length("a") + F.octet_length("b") - REFERENCE_BYTES))).filter("kind <> 'pair' OR n > 1 AND saves > 0")
    best = (F.col("saves").desc(), "a", "b")
    # In two steps, for one task need not see all pairs of a language.
    for part in (F.pmod(F.xxhash64("a", "b"), F.lit(64)), F.lit(0)):
        place = F.row_number().over(Window.partitionBy("kind", "whose", part).orderBy(*best))
        counts = counts.withColumn("place", place).filter(f"kind <> 'pair' OR place <= {DICTIONARY_BYTES}")
    held: dict[str, dict[str, int]] = defaultdict(dict)
    octets: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(256, dtype=np.int64))
    pairs: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
    for kind, whose, a, b, n in counts.select("kind", "whose", "a", "b", "n", "place").toPandas().sort_values("place")[["kind", "whose", "a", "b", "n"]].itertuples(index=False):
        if kind == "held":
            held[whose][a] = int(n)
        elif kind == "octet":
            octets[whose][ord(a)] = n
        else:
            pairs[whose].append((a, b, int(n)))
    return Model(held, octets, pairs)


@cache
def _judge(key: bytes) -> Judge:
    import pickle

    return Judge(*pickle.loads(key))


def repaired(pages: DataFrame, model: Model | None = None, changed_only: bool = False) -> DataFrame:
    """page_id, text (restored where possible), garbled, lines_garbled, chains. One pass, no shuffle.

    changed_only leaves out clean pages and their texts, which then never come back from the Python worker.
    """
    import pickle

    model = model or fit(pages)
    key = pickle.dumps((model.raw, model.regular))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _judge(key)
        for pdf in batches:
            out = []
            for page_id, text in zip(pdf["page_id"], pdf["text"], strict=True):
                if not text or not judge.suspect(text):
                    if not changed_only:
                        out.append((page_id, text, False, 0, []))
                    continue
                done = [judge.repair(x) for x in text.split("\n")]
                n = sum(g for _, _, g in done)
                if n or not changed_only:
                    out.append((page_id, "\n".join(x for x, _, _ in done), n > 0, n, sorted({c for _, c, _ in done if c})))
            yield pd.DataFrame(out, columns=["page_id", "text", "garbled", "lines_garbled", "chains"]).astype({"page_id": "Int64"})

    rows = pages.select("page_id", "text")
    return rows.mapInPandas(run, "page_id long, text string, garbled boolean, lines_garbled int, chains array<string>")


def garbled_ids(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id) of the pages that were decoded wrongly in at least one line."""
    rows = pages.filter(F.length("text") > 0)
    return repaired(rows, model or fit(pages), changed_only=True).filter("garbled").select("page_id")
