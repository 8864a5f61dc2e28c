"""Language ID by rank-order profiles: a document's most frequent character n-grams are compared to each language's by out-of-place distance.

N-grams of one to three characters come from lower-cased runs of letters, each with a blank before and after; they never span two runs. A profile is the TOP most frequent n-grams by falling count, then by code. The distance sums over a document's profile how far each n-gram stands from its rank in the language's profile, TOP where it is missing there; the nearest language wins, the first by name in a tie. The score is one less the distance over its greatest value.

Counts for the language profiles cover every training text: each task counts its batches, and the counts are combined before and after the shuffle. What reaches the driver is TOP rows a language.

Defined results: a null text, or one without letters, is `und` with score 0; so is everything if nothing could be learned. A null doc_id is neither learned from nor held out. Repeated rows count each time. An empty table gives an empty result. Columns other than doc_id, text and lang play no part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from echolith.llm.shared import values

#: N-grams in a profile.
TOP = 300
#: N-grams of a language counted at a time in training, which bounds memory.
AT_ONCE = 1 << 21
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    is_letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool)
    return np.where(is_letter, points, 32).astype(np.int64)


def ngrams(text: str | None) -> np.ndarray:
    """The n-grams of a text as longs: 21 bits a character."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.concatenate([[32], _letters()[points], [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 32]
    return np.concatenate([c[c != 32], two, three])


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The codes (in rising order) with the largest counts, ties by code."""
    if len(codes) > size:  # a stable sort of what can be among them
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def counted(lang: str) -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(by.pop(lang)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

        for lang, text in zip(values(b.column("lang")), values(b.column("text"))):
            by.setdefault(lang, []).append(ngrams(text))
            held[lang] = held.get(lang, 0) + len(by[lang][-1])
            if held[lang] > AT_ONCE:
                held[lang] = 0
                yield counted(lang)
        yield from [counted(lang) for lang in list(by)]


def profiles(labelled: DataFrame, size: int = TOP) -> dict[str, list[int]]:
    """The profile of each language of the rows (lang, text)."""
    counts = labelled.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["code"])
    return out


class Ranks:
    """Language profiles as a table of ranks."""

    def __init__(self, by_lang: dict[str, list[int]], size: int = TOP):
        self.langs, self.size = sorted(by_lang), size
        self.codes = np.unique(np.array([c for p in by_lang.values() for c in p], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        own = top(*np.unique(grams, return_counts=True), self.size)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)  # the last row: in no profile
        rank = self.rank[at]
        off = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        j = int(np.argmin(off))
        return self.langs[j], 1.0 - float(off[j]) / (self.size * len(own))


def _predict(by_lang: dict[str, list[int]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(by_lang, size)
        for b in batches:
            found = [ranks.predict(t) for t in values(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = 4, held: int = 2, size: int = TOP) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score. Profiles are learned from rows with a language whose crc32(doc_id) mod folds is not held."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    learned = profiles(docs.where(F.col("lang").isNotNull() & (fold != held)).select("lang", "text"), size)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(_predict(learned, size), "doc_id long, held_out boolean, lang_pred string, score double")


#: Least score of a recognised document where too few labelled documents can tell: of a length class, or of all.
LEAST_SCORE = 0.3
#: Documents that a length class needs, bins of its scores, and shares of texts and of noise that may lie on the wrong side of the bounds between which its least score is.
CLASS_LEAST, BINS, ASIDE = 50, 1000, 0.001


def length_class(text: str | None) -> int:
    """Texts of about equal length: the bits of the number of characters."""
    return len(text or "").bit_length()


def noise(text: str | None, letters: np.ndarray, rng: np.random.Generator) -> str:
    """The text with each letter redrawn from letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).copy()
    there = _letters()[points] != 32
    points[there] = rng.choice(letters, int(there.sum()))
    return points.tobytes().decode("utf-32-le")


def _histogram(by_lang: dict[str, list[int]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, rng = Ranks(by_lang, size), np.random.default_rng(size)
        letters = ranks.codes[ranks.codes < 1 << 21].astype(np.uint32)
        seen: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for text in values(b.column("text")):
                tag, score = ranks.predict(text)
                if tag == UNKNOWN or not len(letters):
                    continue
                for kind, x in ((0, score), (1, ranks.predict(noise(text, letters, rng))[1])):
                    n = seen.setdefault((length_class(text), kind), np.zeros(BINS + 1, np.int64))
                    n[int(x * BINS)] += 1
        rows = [(size_class, kind, i, n[i]) for (size_class, kind), n in seen.items() for i in np.flatnonzero(n).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["class", "kind", "bin", "n"])

    return run


def least_scores(labelled: DataFrame, by_lang: dict[str, list[int]], size: int = TOP) -> dict[int, float]:
    """The least score of a recognised text by length class, from all rows (text): half-way between the scores that all but ASIDE of the noise (the same texts with letters redrawn) stays under and all but ASIDE of the texts reach. Not above the latter. Classes of fewer than CLASS_LEAST rows are left out. The driver gets a row a class and bin."""
    rows = labelled.select("text").mapInArrow(_histogram(by_lang, size), "class int, kind int, bin int, n long").groupBy("class", "kind", "bin").agg(F.sum("n").alias("n")).collect()
    seen: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        seen.setdefault((r["class"], r["kind"]), np.zeros(BINS + 1, np.int64))[r["bin"]] = r["n"]
    out = {}
    for (k, kind), n in seen.items():
        if kind == 0 and n.sum() >= CLASS_LEAST:
            below, noisy = np.cumsum(n) / n.sum(), np.cumsum(seen[k, 1]) / n.sum()
            texts, other = int(np.argmax(below > ASIDE)), int(np.argmax(noisy >= 1 - ASIDE)) + 1
            out[k] = min((texts + other) / 2, texts) / BINS
    return out


def _rejects(by_lang: dict[str, list[int]], size: int, least: dict[int, float]):
    other = min(least.values(), default=LEAST_SCORE)

    @pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        ranks = Ranks(by_lang, size)
        return pd.Series([tag == UNKNOWN or score < least.get(length_class(t), other) for t in texts for tag, score in [ranks.predict(t)]], dtype=bool)

    return rejected


def drop_unrecognised(docs: DataFrame, least: float | None = None, size: int = TOP) -> DataFrame:
    """docs without those whose language is unknown or whose score is under the least of their length class; all columns kept. Profiles and least scores are learned from all rows with a language; a class with too few takes the smallest of the others. A number for least holds for all classes instead."""
    labelled = docs.where("lang is not null").select("lang", F.col("text").cast("string"))
    learned = profiles(labelled, size)
    bounds = least_scores(labelled, learned, size) if least is None else {0: least}
    return docs.where(~_rejects(learned, size, bounds)("text"))
