"""Problem 3: subject areas of each source.

Complement naive Bayes is trained on the labelled sources, whose sentences share the labels, and refined by expectation-maximisation over
the sentences of all pages, labelled or not: each pass scores every sentence, and its expected counts make the next model. Shares of the
confident sentences add up to a profile of each source, and a logistic calibration of each area on the labelled sources turns each share into
an independent posterior. An area is assigned from a posterior of one half on; the most probable one always, two at most.

Features are hashed into a block of fixed size per language, which bounds the model for any corpus; it holds the rows of the features that
were seen. The complement of an area is taken within the language: few labels in one language do not tilt it.

Defined results: sources without text, or whose sentences say nothing about any area, get no row; null and empty texts count nothing;
repeated labels count once per annotator row; labels outside subject_areas are ignored; a source ingested several times is one source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.language import LANGUAGES, language
from leafmill.llm.lookalike import look
from leafmill.session import materialize

#: Hashed features of one language; the model has len(LANGUAGES) * FEATURES rows at most and a column per area.
FEATURES = 1 << 18
#: Bound of the labelled sources that the classifier is fitted on; beyond it those with the smallest hash are taken.
LABELLED_SOURCES = 20_000
SMOOTHING, ITERATIONS, LABEL_TRUST, CONFIDENT = 0.05, 3, 0.9, 0.75
#: How firmly an area's own calibration is drawn to that of all areas, in observations.
AREA_FIRMNESS = 10.0

_CJK_RUN = re.compile("[぀-ヿ㐀-鿿]+")
_WORDS = re.compile(r"[a-zà-ɏ]{3,}")
_DEVA = re.compile("[ऀ-ॿ]{2,}")
_THAI = re.compile("[ก-๛]+")
_SENTENCES = re.compile(r"[.!?。！？।．｡;；]+[\s”’»」』\"')）]*|\n\s*\n")
_MARKS_LINE = re.compile("[�\x80-\x9f]")


def sentence_features(sentence: str, lang: str) -> list[str]:
    """Words of scripts with spaces, pairs of characters of the others."""
    if lang in ("zh", "ja"):
        return [run[i : i + 2] for run in _CJK_RUN.findall(sentence) for i in range(len(run) - 1)]
    if lang == "th":
        return [run[i : i + 4] for run in _THAI.findall(sentence) for i in range(0, len(run) - 3)]
    if lang == "hi":
        return _DEVA.findall(sentence)
    return _WORDS.findall(sentence)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """src_id, ids (hashed features of all sentences behind one another), sizes (features per sentence)."""
    known: dict[tuple[int, str], int] = {}
    index = {k: i for i, k in enumerate(LANGUAGES)}
    for pdf in batches:
        out = []
        for src_id, text in zip(pdf["src_id"], pdf["text"], strict=True):
            if _MARKS_LINE.search(text):
                text = "\n".join(x for x in text.split("\n") if not _MARKS_LINE.search(x))
            ids, sizes = [], []
            for block in look(text).lower().split("\n\n"):
                block_lang = language(block)
                if block_lang == "und":
                    continue
                base = index[block_lang]
                flat = block.replace("\n", "" if block_lang in ("zh", "ja") else " ")
                for sentence in _SENTENCES.split(flat) if block_lang != "th" else flat.split(" "):
                    if not sentence:
                        continue
                    n = 0
                    for f in set(sentence_features(sentence, block_lang)):
                        k = known.get((base, f))
                        if k is None:
                            if len(known) > 500_000:
                                known.clear()
                            k = known[(base, f)] = base * FEATURES + xxhash.xxh3_64_intdigest(f) % FEATURES
                        ids.append(k)
                        n += 1
                    if n:
                        sizes.append(n)
            if sizes:
                out.append((src_id, ids, sizes))
        yield pd.DataFrame(out, columns=["src_id", "ids", "sizes"])


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all sentences, the beginning of each sentence, and the page of each sentence."""
    ids = np.concatenate(pdf["ids"].to_numpy()).astype(np.int64)
    sizes = np.concatenate(pdf["sizes"].to_numpy()).astype(np.int64)
    page = np.repeat(np.arange(len(pdf)), pdf["sizes"].map(len))
    return ids, np.cumsum(sizes) - sizes, page


class Model:
    """Complement weights, seen features by areas; row 0 is that of features never seen, which say nothing."""

    def __init__(self, features: np.ndarray, counts: np.ndarray):
        """features: sorted ids; counts: a row for each of them."""
        self.features = features
        self.weights = np.zeros((len(features) + 1, counts.shape[1]), dtype=np.float32)
        for k in range(len(LANGUAGES)):  # language by language, so that the driver holds one block at a time
            begin, end = np.searchsorted(features, (k * FEATURES, (k + 1) * FEATURES))
            if begin == end:
                continue
            block = counts[begin:end].astype(np.float64)
            complement = SMOOTHING + block.sum(axis=1, keepdims=True) - block
            weights = np.log(complement) - np.log(complement.sum(axis=0, keepdims=True))
            # Features that say the same about all areas cancel out.
            self.weights[begin + 1 : end + 1] = weights.mean(axis=1, keepdims=True) - weights
        self._rows: np.ndarray | None = None

    def rows(self, ids: np.ndarray) -> np.ndarray:
        if self._rows is None:  # made in the worker, not shipped
            self._rows = np.zeros(len(LANGUAGES) * FEATURES, dtype=np.int32)
            self._rows[self.features] = np.arange(1, len(self.features) + 1, dtype=np.int32)
        return self._rows[ids]

    def posteriors(self, ids: np.ndarray, begins: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
        score = np.add.reduceat(self.weights[self.rows(ids)], begins, axis=0).astype(np.float64)
        if prior is not None:
            score += np.log(prior)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


def _expected(rows: DataFrame, labels: dict[int, list[int]], areas: int, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """(features seen, their expected counts by area): one pass, partial sums per task; packed cells come back."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((labels, model))
    size = len(LANGUAGES) * FEATURES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, m = shared.value
        row, seen, total = np.full(size, -1, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros((0, areas))
        for pdf in batches:
            if m is None:
                pdf = pdf[pdf["src_id"].isin(known)]
            if not len(pdf):
                continue
            ids, begins, page = _flat(pdf)
            prior = np.full((len(pdf), areas), 1.0 / areas)
            for k, src in enumerate(pdf["src_id"]):
                if src in known:
                    prior[k] = (1 - LABEL_TRUST) / areas
                    prior[k, known[src]] += LABEL_TRUST / len(known[src])
            p = prior[page] if m is None else m.posteriors(ids, begins, prior[page])
            if m is not None:
                p = p * (p.max(axis=1, keepdims=True) >= 0.5)  # sentences that say nothing teach nothing
            of = np.repeat(np.arange(len(begins)), np.diff([*begins, len(ids)]))
            fresh = np.unique(ids[row[ids] < 0])
            row[fresh] = np.arange(len(seen), len(seen) + len(fresh), dtype=np.int32)
            seen = np.concatenate([seen, fresh])
            total = np.concatenate([total, np.zeros((len(fresh), areas))])
            at = row[ids]
            for c in range(areas):
                total[:, c] += np.bincount(at, weights=p[of, c], minlength=len(seen))
        at, area = np.nonzero(total)
        yield pd.DataFrame({"cell": (seen[at] * areas + area).astype(np.int32), "n": total[at, area]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"cells": [pdf["cell"].to_numpy(np.int32).tobytes()], "n": [pdf["n"].to_numpy(np.float32).tobytes()]})

    summed = rows.mapInPandas(run, "cell int, n double").groupBy("cell").agg(F.sum("n").cast("float").alias("n"))
    packed = summed.mapInPandas(pack, "cells binary, n binary").collect()
    shared.destroy()
    cells = np.frombuffer(b"".join(r["cells"] for r in packed), dtype=np.int32)
    features, at = np.unique(cells // areas, return_inverse=True)
    counts = np.zeros((len(features), areas), dtype=np.float32)
    counts[at, cells % areas] = np.frombuffer(b"".join(r["n"] for r in packed), dtype=np.float32)
    return features, counts


def _profiles(rows: DataFrame, model: Model, areas: int) -> DataFrame:
    """src_id, sentences, share (array by area): shares of the confident sentences."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"s{c}" for c in range(areas)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            ids, begins, page = _flat(pdf)
            p = shared.value.posteriors(ids, begins)
            sure = (p.max(axis=1) >= CONFIDENT)[:, None] * p
            sums = np.zeros((len(pdf), areas))
            np.add.at(sums, page, sure)
            out = pd.DataFrame(sums, columns=names)
            out.insert(0, "src_id", pdf["src_id"].to_numpy())
            yield out.groupby("src_id", as_index=False).sum()

    schema = "src_id long, " + ", ".join(f"{n} double" for n in names)
    sums = rows.mapInPandas(run, schema).groupBy("src_id").agg(*(F.sum(n).alias(n) for n in names))
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return sums.withColumn("sentences", total).filter("sentences > 0").select("src_id", "sentences", F.array(*(F.col(n) / F.col("sentences") for n in names)).alias("share"))


def _logistic(x: np.ndarray, y: np.ndarray, begin: np.ndarray, firmness: float) -> np.ndarray:
    """Slope and offset by Newton's method, drawn to `begin` as firmly as so many observations; labels that the fit calls all but impossible are
    left out of the next of four rounds, for a few are wrong."""
    a, keep = begin.copy(), np.ones(len(x), dtype=bool)
    for _ in range(4):
        features, target = np.stack([x[keep], np.ones(keep.sum())]), y[keep]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ features, -30, 30)))
            grad = features @ (target - p) - firmness * (a - begin) / np.array([100.0, 4.0])
            step = np.linalg.solve((features * (p * (1 - p))) @ features.T + np.diag(firmness / np.array([100.0, 4.0])) + 1e-6 * np.eye(2), grad)
            a = a + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        keep = np.abs(y - 1 / (1 + np.exp(-np.clip(a[0] * x + a[1], -30, 30)))) < 0.9
    return a


def _calibrated(shares: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Slope and offset of each area: a fit of its own, drawn to the one of all areas together as far as its labels are few."""
    begin = np.array([20.0, -4.0])
    if not len(shares):
        return np.tile(begin, (truth.shape[1], 1))
    shared = _logistic(shares.ravel(), truth.ravel(), begin, 0.1)
    return np.stack([_logistic(shares[:, k], truth[:, k], shared, AREA_FIRMNESS) for k in range(truth.shape[1])])


def _blocks(rows: DataFrame) -> DataFrame:
    """src_id, text, block: the parts between empty lines, and their hash."""
    parts = rows.filter(F.col("src_id").isNotNull() & (F.length("text") > 0)).select("src_id", F.explode(F.split("text", r"\n[ \t\r]*\n")).alias("text"))
    parts = parts.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).filter(F.length("text") > 0)
    return parts.withColumn("block", F.xxhash64("text"))


def subject_profiles(sources: DataFrame, pages: DataFrame, chunks: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """src_id, subject, share, posterior for every source with text and every area."""
    names = [r["subject"] for r in areas.select("subject").distinct().orderBy("subject").collect()]  # a fixed table of a few rows
    ids = sources.select("src_id").distinct()
    texts = pages.filter((F.length(F.trim("text")) > 0) & F.col("src_id").isNotNull()).select("src_id", "text")
    # Chunks repeat the text of pages. All are read, and what no page of the source holds speaks as well.
    own = _blocks(chunks).join(_blocks(texts).select("src_id", "block"), ["src_id", "block"], "left_anti").select("src_id", "text")
    rows = materialize(texts.unionByName(own).mapInPandas(_features, "src_id long, ids array<int>, sizes array<int>"), "subject-features")
    position = {n: k for k, n in enumerate(names)}
    given = labels.filter(F.col("subject").isin(names)).groupBy("src_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("src_id")).limit(LABELLED_SOURCES)
    known = {r["src_id"]: sorted(position[s] for s in r["subjects"]) for r in given.collect()}
    model = Model(*_expected(rows, known, len(names), None))
    for _ in range(ITERATIONS):
        model = Model(*_expected(rows, known, len(names), model))
    found = materialize(_profiles(rows, model, len(names)), "subject-shares")
    fit = found.join(given.select("src_id"), "src_id", "left_semi").select("src_id", "share").toPandas().sort_values("src_id")
    truth = np.zeros((len(fit), len(names)))
    for k, s in enumerate(fit["src_id"]):
        truth[k, known[s]] = 1
    lines = _calibrated(np.stack(fit["share"]) if len(fit) else np.zeros((0, len(names))), truth)
    rows = found.join(ids, "src_id", "left_semi").select("src_id", F.posexplode("share").alias("k", "share"))
    of_area = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    odds = of_area(lines[:, 0].tolist()) * F.col("share") + of_area(lines[:, 1].tolist())
    return rows.select("src_id", of_area(names).alias("subject"), "share", (1 / (1 + F.exp(-odds))).alias("posterior"))


def subjects(profiles: DataFrame, most: int = 2) -> DataFrame:
    """(src_id, subject): the most probable area of each source, and the second if its posterior is one half or more."""
    ranked = profiles.groupBy("src_id").agg(F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("posterior", "share", "subject")))), 1, most).alias("top"))
    one = ranked.select("src_id", F.posexplode("top").alias("rank", "t"))
    return one.filter((F.col("rank") == 0) | (F.col("t.posterior") >= 0.5)).select("src_id", F.col("t.subject").alias("subject"))
