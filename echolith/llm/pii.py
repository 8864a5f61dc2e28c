"""Information-theoretic sanitisation of personal data.

Base spans (e-mail, IP address, payment card, phone) are the protected entities. The corpus tells how strongly other terms reveal them. All probabilities are shares of documents: p(e) of those that hold the entity, p(t) of those that hold the term, p(e, t) of those that hold both, anywhere in their text. The information of an entity is IC(e) = -log2 p(e), that a term gives about it is PMI(e; t) = log2(p(e, t) / (p(e) p(t))), and the term discloses it if PMI / IC reaches DISCLOSE. Terms are put to that test if they stand within WINDOW words of the entity in at least SUPPORT documents: a single document is no evidence of co-occurrence, as all its rare words occur with all its entities. A disclosing term becomes a span wherever it occurs, in documents without the entity too: it is generalised to its shape, and removed if it reaches REMOVE.

The first pass over the texts counts entities, words and terms near entities, combined within each task before anything shuffles. The second finds every place of the candidate terms, told by a Bloom filter of at most 2**FILTER_LOG2 bits; what it lets through wrongly falls out in the join with the terms. All else joins these tables on hash keys. A pair with more documents of the term than n_e**DISCLOSE * D**(1 - DISCLOSE) can't reach DISCLOSE and is left out beforehand.

Defined results: a null text counts as empty and has no spans. Repeated rows are documents of their own, whatever their doc_id. An empty table gives an empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from echolith.llm.shared import shared_table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
BEFORE_AT = re.compile(rf"[^{LOCAL}]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+")
#: Words on either side of an entity that are its context; documents in which a term must stand near it; share of an entity's information that discloses it, and that has the term removed.
WINDOW, SUPPORT, DISCLOSE, REMOVE = 10, 2, 0.7, 0.95
#: Words and pairs that a task counts before it hands the counts on; texts read at a time.
HELD, BATCH = 300_000, 500
#: Bits of the filter for each term, the most bits (16 MB), and bits of a slice of it.
BITS_A_TERM, FILTER_LOG2, SLICE_LOG2 = 16, 27, 18


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at  # the run of allowed characters before the sign, after the last match
        while start > done and not BEFORE_AT.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def entity(kind: str, text: str) -> str:
    """What makes two spans the same entity."""
    return f"{kind}:{text.lower() if kind == 'email' else re.sub(r'[^0-9.]' if kind == 'ip' else r'[^0-9]', '', text)}"


class Outside:
    """Tells whether a stretch of a text touches none of the spans."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __call__(self, a: int, b: int) -> bool:
        at = bisect_right(self.starts, b - 1) - 1
        return at < 0 or self.ends[at] <= a


def context(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, str]]:
    """(entity, term) of the words within WINDOW of each span, outside all spans."""
    outside = Outside(spans)
    for kind, a, b in spans:
        back = 64 * WINDOW
        while True:  # look back far enough for WINDOW words that are whole
            start = max(0, a - back)
            before = [m for m in WORD.finditer(text, start, a) if not start or m.start() > start][-WINDOW:]
            if not start or len(before) == WINDOW:
                break
            back *= 4
        after = [m for m, _ in zip(WORD.finditer(text, b), range(WINDOW))]
        for m in (*before, *after):
            if outside(m.start(), m.end()):
                yield entity(kind, text[a:b]), m[0].lower()


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text))}


#: Rows of the first pass. what: docs, near (a term near an entity), entity or word; n counts documents.
COUNTED = "what string, entity string, term string, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(n: Counter) -> pa.RecordBatch:
        what, entities, terms = zip(*n) if n else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(entities, pa.string()), pa.array(terms, pa.string()), pa.array(list(n.values()), pa.int64())], ["what", "entity", "term", "n"])

    words: Counter = Counter()
    other: Counter = Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            text = text or ""
            other["docs", None, None] += 1
            words.update(terms_of(text))
            if spans := find(text):
                other.update(("near", *x) for x in set(context(text, spans)))
                other.update(("entity", e, None) for e in {entity(k, text[x:y]) for k, x, y in spans})
            if len(words) > HELD:
                yield made(Counter({("word", None, w): n for w, n in words.items()}))
                words = Counter()
            if len(other) > HELD:
                yield made(other)
                other = Counter()
    yield made(Counter({("word", None, w): n for w, n in words.items()}))
    yield made(other)


def _candidates(texts: DataFrame) -> tuple[DataFrame, int]:
    """(entity, term, n_e, n_t) of the pairs that may disclose, and the number of documents."""
    seen = shared_table(texts.mapInArrow(_count, COUNTED).groupBy("what", "entity", "term").agg(F.sum("n").alias("n")), "pii-counts")
    docs = seen.where("what = 'docs'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = seen.where((F.col("what") == "near") & (F.col("n") >= SUPPORT)).select("entity", "term")
    entities = seen.where((F.col("what") == "entity") & (F.col("n") >= SUPPORT)).select("entity", F.col("n").alias("n_e"))
    words = seen.where((F.col("what") == "word") & (F.col("n") >= SUPPORT)).select("term", F.col("n").alias("n_t"))
    most = F.pow("n_e", F.lit(DISCLOSE)) * float(max(docs, 1)) ** (1 - DISCLOSE) * (1 + 1e-9)
    pairs = near.join(entities, "entity").join(words, "term").where((F.col("n_t") <= most) & (F.col("n_e") < docs))
    return shared_table(pairs, "pii-candidates"), docs


def _bits(term: str, log2: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(term)
    return h & (1 << log2) - 1, h >> 32 & (1 << log2) - 1


def _filter(terms: DataFrame) -> np.ndarray:
    """The Bloom filter of the terms, as bytes. The driver gets one row a slice."""
    n = terms.count()
    log2 = min(max(SLICE_LOG2, (n * BITS_A_TERM).bit_length()), FILTER_LOG2)
    size = 1 << SLICE_LOG2

    def merged(slices: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array([x.tobytes() for x in slices.values()], pa.binary())], ["slice", "bits"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            for term in b.column("term").to_pylist():
                for bit in _bits(term, log2):
                    part = slices.setdefault(bit >> SLICE_LOG2, np.zeros(size // 8, np.uint8))
                    part[(bit & size - 1) >> 3] |= 1 << (bit & 7)
        yield merged(slices)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(*(c.to_pylist() for c in b.columns)):
                slices[k] = slices.get(k, 0) | np.frombuffer(x, np.uint8)
        yield merged(slices)

    out = np.zeros((1 << log2) // 8, np.uint8)
    for r in terms.mapInArrow(own, "slice int, bits binary").repartition("slice").mapInArrow(joined, "slice int, bits binary").collect():
        out[r["slice"] * size // 8 : (r["slice"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


PLACES = "row long, doc_id long, key string, spans string, entities array<string>, hits array<struct<term:string,start:int,end:int>>"


def _places(bits: bytes):
    """Each document with its base spans, its entities, and the places of terms that the filter lets through."""
    log2 = (len(bits) * 8).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known = TaskContext.get().partitionId() << 40, {}

        def passes(term: str) -> bool:
            found = known.get(term)
            if found is None:
                if len(known) > HELD:
                    known.clear()
                found = known[term] = all(bits[x >> 3] >> (x & 7) & 1 for x in _bits(term, log2))
            return found

        for whole in batches:
            for first in range(0, len(whole), BATCH):
                rows = []
                for doc_id, text in zip(*(whole.slice(first, BATCH).column(c).to_pylist() for c in ("doc_id", "text"))):
                    text = text or ""
                    spans, hits, entities = find(text), [], None
                    if some := {t for t in terms_of(text) if passes(t)}:
                        outside = Outside(spans)
                        hits = [(t, m.start(), m.end()) for m in WORD.finditer(text) if (t := m[0].lower()) in some and outside(m.start(), m.end())]
                        entities = sorted({entity(k, text[x:y]) for k, x, y in spans})
                    rows.append((row, doc_id, hashlib.md5(text.encode()).hexdigest(), ",".join(f"{k}:{x}:{y}" for k, x, y in spans), entities, hits))
                    row += 1
                ids, docs, keys, spans, entities, hits = zip(*rows)
                places = [x for h in hits for x in h]
                terms, starts, ends = zip(*places) if places else ((), (), ())
                structs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["term", "start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(keys), pa.array(spans), pa.array(entities, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, hits)]).astype(np.int32)), structs)],
                    ["row", "doc_id", "key", "spans", "entities", "hits"],
                )

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, spans of the base, terms): key is a hash of the text, terms an array of (start, end, removed)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pairs, n = _candidates(texts.select("text"))
    bits = _filter(pairs.select("term").distinct()).tobytes()
    seen = shared_table(texts.mapInArrow(_places(bits), PLACES), "pii-places")
    places = seen.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    held = seen.where(F.size("hits") > 0).select("row", F.explode("entities").alias("entity"))
    both = places.select("row", "term").distinct().join(pairs, "term").join(held, ["row", "entity"]).groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("both"))
    d = F.lit(float(max(n, 1)))
    share = F.log2(F.col("both") * d / (F.col("n_e") * F.col("n_t"))) / F.log2(d / F.col("n_e"))
    terms = both.select("term", share.alias("share")).groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= DISCLOSE)
    hits = places.join(shared_table(terms, "pii-disclosing"), "term").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", (F.col("share") >= REMOVE).alias("removed")))).alias("terms"))
    return seen.select("row", "doc_id", "key", "spans").join(shared_table(hits, "pii-terms"), "row", "left")


def _count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of base spans by kind, their digest, all spans (the base, then kind term), and the disclosing terms with what becomes of them."""
    df = _rows(docs)
    spans = F.when(F.col("spans") == "", F.array().cast("array<string>")).otherwise(F.split("spans", ","))
    terms = F.coalesce(F.col("terms"), F.array().cast("array<struct<start:int,end:int,removed:boolean>>"))
    named = F.transform(terms, lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string")))
    return df.select(
        "doc_id", *(_count_of(spans, k).alias(f"n_{k}") for k in KINDS),
        F.sha2("spans", 256).alias("base_sha256"), F.array_join(F.concat(spans, named), ",").alias("spans"), terms.alias("terms"),
    )


def _sanitised(text: str, base: str, terms: list) -> str:
    parts = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (s.split(":") for s in base.split(",") if s)]
    for t in terms:
        word = text[t["start"] : t["end"]]
        parts.append((t["start"], t["end"], "" if t["removed"] else "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"))
    out, at = [], 0
    for a, b, new in sorted(parts):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]])


@pandas_udf(StringType())
def _cleaned(texts: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([_sanitised(t or "", b or "", x if x is not None else []) for t, b, x in zip(texts, base, terms)], dtype=object)


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for every row, entities replaced by their kind and disclosing terms generalised or removed. Texts meet their spans by a hash of the text, so doc_id may be null or repeated; texts without spans are the same again."""
    found = _rows(docs).where("spans <> '' or terms is not null").dropDuplicates(["key"]).select("key", F.col("spans").alias("base"), "terms")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    joined = rows.join(found, "key", "left")
    same = joined.where("base is null").select("doc_id", "text")
    return same.unionByName(joined.where("base is not null").select("doc_id", _cleaned("text", "base", "terms").alias("text")))
