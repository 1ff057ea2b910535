"""Problem 7: encoding with a public byte-level BPE vocabulary, by DuckDB's recursive queries inside the Spark tasks.

Per partition the distinct words of the texts become token-position rows; each step of a recursive query joins the neighbouring
tokens with the merge table and contracts every word's pair of least rank from the left, until no word has a pair left; an ordered
aggregation gives the ids. The recursion is keyed by place and so holds the live tokens only. Words are cut beforehand where no token
of the vocabulary can span: no merge crosses such a place, so the parts are encoded on their own, and few distinct parts remain.
Known parts are kept per Python worker, up to MEMO_PARTS.

Defined results: null and empty text give an empty list; strings that look like special tokens are ordinary text; any text
decodes to itself, but for lone surrogates, which Parquet cannot hold.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import shared_dir

#: The folder of the public tokenizers; a parameter of every function here, never copied into the repository.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pre-tokenizer's pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words and parts that a Python worker remembers; beyond it the memo starts anew.
MEMO_PARTS = 300_000
#: Bytes from which a part is looked through for tokens that lie across its places.
LONG_PART = 48

#: Rows of one recursive query: parts are taken together up to so many bytes.
QUERY_BYTES = 200_000

# The recursion is keyed by place, so it holds the live tokens only; a place that went into its left neighbour holds -1. Each round looks at
# the words that the last one changed (step) and takes their pair of least rank: from the left, each place once. All places of the pair are
# taken at once where no merge of what it makes comes before it in rank (safe), else the leftmost alone.
MERGE_QUERY = """
WITH RECURSIVE step(word, pos, token) USING KEY (word, pos) AS (
    SELECT word, pos, token FROM symbols
    UNION
    SELECT word, unnest([pos, next_pos]), unnest([merged, -1]) FROM (
        SELECT word, pos, next_pos, merged, safe, idx, row_number() OVER (PARTITION BY word, idx - nth ORDER BY idx) AS place, nth
        FROM (
            SELECT word, pos, next_pos, idx, merged, safe, row_number() OVER (PARTITION BY word ORDER BY idx) AS nth
            FROM (
                SELECT s.*, m.merged, m.safe, m.rank, min(m.rank) OVER (PARTITION BY s.word) AS least
                FROM (
                    SELECT word, pos, token, lead(token) OVER w AS next_token, lead(pos) OVER w AS next_pos, row_number() OVER w AS idx
                    FROM recurring.step WHERE token >= 0 AND word IN (SELECT word FROM step) WINDOW w AS (PARTITION BY word ORDER BY pos)
                ) s JOIN merges m ON m.lft = s.token AND m.rgt = s.next_token
            ) WHERE rank = least
        )
    ) WHERE place % 2 = 1 AND (safe OR nth = 1)
)
SELECT word, list(token ORDER BY pos) AS ids FROM step WHERE token >= 0 GROUP BY word
"""


class WordEncoder:
    """Encodes words with one vocabulary; holds the merge table in a DuckDB connection of its own."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY, spill: str = ""):
        """spill: a folder in which a query may make one of its own to spill to; without one it may not."""
        import ahocorasick
        import duckdb  # only where words are encoded, not on the driver

        model = json.loads(Path(folder, name).read_text(encoding="utf-8"))["model"]
        vocab, shown = model["vocab"], _shown_bytes()
        byte_of = {c: b for b, c in shown.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int32)
        self.join = np.zeros(65536, dtype=bool)  # byte pairs that stand next to each other in some token
        self.spans = ahocorasick.Automaton()  # tokens of several bytes, a character for each
        for token in vocab:
            plain = "".join(chr(byte_of[c]) for c in token if c in byte_of)
            raw = np.array(list(map(ord, plain)), dtype=np.int64)
            self.join[raw[:-1] * 256 + raw[1:]] = True
            if len(plain) > 1:
                self.spans.add_word(plain, len(plain))
        self.spans.make_automaton()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": "false", "temp_directory": spill and f"{spill}/spill-{uuid.uuid4().hex}"})
        first_use: dict[str, int] = {}
        for k, pair in enumerate(merges):
            for x in pair:
                first_use.setdefault(x, k)
        pairs = pd.DataFrame([(vocab[a], vocab[b], k, vocab[a + b], first_use.get(a + b, k) >= k) for k, (a, b) in enumerate(merges)], columns=["lft", "rgt", "rank", "merged", "safe"])  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT lft::INTEGER AS lft, rgt::INTEGER AS rgt, rank::INTEGER AS rank, merged::INTEGER AS merged, safe FROM pairs")
        self.words: dict[str, tuple[int, ...]] = {}
        self.parts: dict[bytes, tuple[int, ...]] = {}

    def _merge(self, parts: list[bytes]) -> None:
        """Adds the ids of parts to the memo by the recursive query."""
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        starts = np.cumsum(sizes) - sizes
        symbols = pd.DataFrame({"word": np.repeat(np.arange(len(parts)), sizes), "pos": np.arange(len(raw)) - np.repeat(starts, sizes), "token": self.byte_id[raw]})  # noqa: F841
        # A run that cannot be cut is merged as a whole, however long; it needs some 400 bytes of memory for each of its own.
        self.db.execute(f"SET memory_limit = '{max(400, 400 * len(raw) // 1_000_000)}MB'")
        for word, ids in self.db.execute(MERGE_QUERY).fetchall():
            self.parts[parts[word]] = tuple(ids)

    def _parts(self, raw: bytes) -> list[bytes]:
        """A word, cut where no token can span: its two bytes stand together in none, or, in what stays long, no token of the text lies across."""
        codes = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
        places = [0, *(np.flatnonzero(~self.join[codes[:-1] * 256 + codes[1:]]) + 1).tolist(), len(raw)]
        parts = []
        for a, b in pairwise(places):
            if b - a <= LONG_PART:
                parts.append(raw[a:b])
                continue
            across = np.zeros(b - a + 1, dtype=np.int64)  # tokens that begin to lie across a place, less those that end to
            for end, size in self.spans.iter(raw[a:b].decode("latin-1")):
                across[end - size + 2] += 1
                across[end + 1] -= 1
            inner = np.flatnonzero(np.cumsum(across)[1 : b - a] == 0) + 1
            parts += [raw[a + i : a + j] for i, j in pairwise([0, *inner.tolist(), b - a])]
        return parts

    def learn(self, words: set[str]) -> None:
        """Makes the ids of new words known."""
        if len(self.words) + len(words) > MEMO_PARTS:
            self.words, self.parts = {}, {}
        cut: dict[str, list[bytes]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                cut[w] = [raw]
                continue
            cut[w] = self._parts(raw)
        fresh = sorted({p for parts in cut.values() for p in parts if p not in self.parts})
        self.parts |= {p: (int(self.byte_id[p[0]]),) for p in fresh if len(p) == 1}
        held: list[bytes] = []
        room = QUERY_BYTES
        for p in (p for p in fresh if len(p) > 1):
            if held and len(p) > room:
                self._merge(held)
                held, room = [], QUERY_BYTES
            held.append(p)
            room -= len(p)
        if held:
            self._merge(held)
        for w, parts in cut.items():
            self.words[w] = tuple(chain.from_iterable(map(self.parts.__getitem__, parts)))


def _shown_bytes() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: its own where that is printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


@cache
def worker_encoder(folder: str, name: str, spill: str = "") -> WordEncoder:
    """One encoder per Python worker process; workers are reused between tasks."""
    return WordEncoder(folder, name, spill)


def spill_folder(spark: SparkSession) -> str:
    """The session's shared folder where it is a mounted one, else none: queries then stay in memory."""
    at = urlparse(shared_dir(spark))
    return at.path if at.scheme in ("", "file") else ""


_split = regex.compile(PATTERN).findall


def encode_texts(texts: list[str | None], encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids): the ids of all texts behind one another."""
    words = [_split(t) if t else [] for t in texts]
    fresh = set(chain.from_iterable(words)) - encoder.words.keys()
    if fresh:
        known = set(chain.from_iterable(words)) - fresh if len(encoder.words) + len(fresh) > MEMO_PARTS else set()
        encoder.learn(fresh | known)
    ids = [list(chain.from_iterable(map(encoder.words.__getitem__, w))) for w in words]
    offsets = np.zeros(len(texts) + 1, dtype=np.int32)
    np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)), out=offsets[1:])
    return offsets, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))


def token_ids(documents: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) for every row; no shuffle, one pass, memory bounded by an Arrow batch."""
    kind, spill = documents.schema[key].dataType.simpleString(), spill_folder(documents.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(folder, name, spill)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                offsets, ids = encode_texts(part.column(1).to_pylist(), encoder)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    return documents.select(key, "text").mapInArrow(encode, f"{key} {kind}, ids array<int>")


def token_counts(documents: DataFrame, *keep: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """The kept columns and n_tokens of every row, by the same encoder; the ids never leave the Python worker."""
    spill = spill_folder(documents.sparkSession)
    fields = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(folder, name, spill)
        sizes: dict[str, int] = {}
        for batch in batches:
            words = [_split(t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            if fresh := set(chain.from_iterable(words)) - sizes.keys():
                if len(sizes) > MEMO_PARTS:
                    sizes.clear()
                    fresh = set(chain.from_iterable(words))
                if unknown := fresh - encoder.words.keys():
                    encoder.learn(unknown | (fresh if len(encoder.words) + len(unknown) > MEMO_PARTS else set()))
                sizes |= {w: len(encoder.words[w]) for w in fresh}
            n = pa.array([sum(map(sizes.__getitem__, w)) for w in words], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    return documents.select(*keep, "text").mapInArrow(count, f"{fields}, n_tokens long")


def decoded(ids: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """ids back to text, for checking round trips."""
    model = json.loads(Path(folder, name).read_text(encoding="utf-8"))["model"]
    byte_of = {c: b for b, c in _shown_bytes().items()}
    raw = {i: bytes(byte_of[c] for c in t if c in byte_of) for t, i in model["vocab"].items()}

    @F.pandas_udf("string")
    def back(s: pd.Series) -> pd.Series:
        return s.map(lambda x: b"".join(raw[i] for i in x).decode("utf-8", "replace"))

    return ids.withColumn("text", back("ids"))
