"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as their words: lower-case runs of letters and digits, joined by single spaces. An item of m such characters may occur with up to k = floor(ERRORS * m) edits. It is split into k + 1 pieces, of which an occurrence holds at least one unchanged: an Aho-Corasick automaton finds every piece hit in every whole text, and Myers' bit-parallel distance verifies the window around each hit. An occurrence begins and ends where words do: its distance is that of the item to the closest stretch of whole words, so no item is found inside a word.

The items are the query set. They come in blocks of about BLOCK_CHARS characters, each a pass over the documents. If there are several, a block's matches are written to the shared folder before the next block is read, so neither driver nor task holds more of the benchmark than a block (an item is never split).

Defined results: null and empty texts match nothing; an item without words matches nothing. Equal items each give their own match, as do repeated rows. A null doc_id or item_id is carried as null. Columns other than doc_id, text, item_id play no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from echolith.llm.shared import shared_table, values

#: Edits allowed per character of an item, and characters of items matched in one pass.
ERRORS, BLOCK_CHARS = 0.08, 4_000_000
WORD = re.compile(r"[^\W_]+")
#: For ASCII texts, the same words by table: letters and digits stay, all else becomes a space.
ASCII = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
MATCHES = "doc_id long, item_id long, distance int, start int, end int"


def plain(text: str | None) -> str:
    """The words of a text, as they are compared."""
    text = (text or "").lower()
    return " ".join(text.translate(ASCII).split() if text.isascii() else WORD.findall(text))


def budget(item: str, errors: float = ERRORS) -> int:
    """Edits allowed for a plain item."""
    return int(errors * len(item))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def chains(count: int) -> list[list[tuple[int, int]]]:
    """For each of count pieces, the ranges of pieces that hold it in a tree of halves, from the smallest up, without the whole. If the range of n pieces has at most n - 1 edits, so has one of its halves of its own size: a hit can be checked upwards and given up early without losing an occurrence."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(count)]
    todo = [(0, count)]
    while todo:
        a, b = todo.pop()
        if 1 < b - a < count:
            for i in range(a, b):
                out[i].insert(0, (a, b))
        if b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least distance, end) of the pattern to any stretch of text; the first end that reaches it."""
    m, peq = len(pattern), defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def from_start(pattern: str, text: str) -> list[int]:
    """The distance of the pattern to each beginning of text, from the empty one on."""
    m, peq = len(pattern), defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, [m]
    for c in text:
        eq = peq.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full | 1, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


def closest(pattern: str, text: str, first: int, last: int, end: int, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of whole words closest to pattern that starts from first to last and ends by end, if within most; ties to the first start, then end."""
    best = None
    for s in range(first, last + 1):
        if s < len(text) and text[s] != " " and (not s or text[s - 1] == " "):
            for size, d in enumerate(from_start(pattern, text[s : min(end, s + len(pattern) + most)])):
                e = s + size
                if size and d <= most and (e == len(text) or text[e] == " ") and text[e - 1] != " " and (best is None or d < best[0]):
                    best = d, s, e
    return best


class Matcher:
    """The automaton of a block of items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int | None, str]], errors: float = ERRORS):
        self.items = [(i, p, budget(p, errors)) for i, p in ((i, plain(t)) for i, t in items) if p]
        where = defaultdict(list)
        for n, (_, p, k) in enumerate(self.items):
            parts = pieces(p, k)
            for (at, piece), above in zip(parts, chains(k + 1)):
                larger = [(parts[a][0], "".join(x for _, x in parts[a:b]), b - a - 1) for a, b in above]
                where[piece].append((n, at, larger))
        self.found = ahocorasick.Automaton()
        for piece, places in where.items():
            self.found.add_word(piece, (len(piece), places))
        self.found.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, start, end) of the closest occurrence of each item that occurs; start and end are code points of the text."""
        words = plain(text)
        at = defaultdict(set)
        if words and self.items:
            for end, (size, places) in self.found.iter(words):
                for n, offset, larger in places:
                    start = end + 1 - size - offset
                    if start not in at[n] and (start >= 0 and words.startswith(self.items[n][1], start) or all(myers(x, words[max(0, start + o - e) : start + o + len(x) + e])[0] <= e for o, x, e in larger)):
                        at[n].add(start)
        out = []
        for n, starts in sorted(at.items()):
            item, p, k = self.items[n]
            best, until = None, -1
            for s in sorted(starts):  # an occurrence whose piece is unchanged starts within k of s
                if s <= until:
                    continue
                until = s + k  # one window serves these
                if s >= 0 and words.startswith(p, s) and (not s or words[s - 1] == " ") and (s + len(p) == len(words) or words[s + len(p)] == " "):
                    best = 0, s, s + len(p)
                    break
                a, b = max(0, s - k), min(len(words), s + 2 * k + len(p) + k)
                if k and myers(p, words[a:b])[0] <= (best[0] - 1 if best else k):
                    best = min(filter(None, (best, closest(p, words, a, s + 2 * k, b, k))), default=None)
            if best:
                out.append((item, best[0], *self._original(text, *best[1:])))
        return out

    @staticmethod
    def _original(text: str, first: int, last: int) -> tuple[int, int]:
        """Code points of the original words that the stretch touches (lower-casing may change a word's length, so whole words are reported)."""
        at, start, end = 0, None, 0
        for m in re.finditer(r"[^\W_]+", text):
            size = len(plain(m[0]))
            if at + size > first and start is None:
                start = m.start()
            if at < last:
                end = m.end()
            at += size + 1
        return start or 0, end


def _match(items: list[tuple[int | None, str]], errors: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(items, errors)
        for b in batches:
            rows = [(d, *x) for d, t in zip(values(b.column("doc_id")), values(b.column("text"))) for x in m.matches(t)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "start", "end"])

    return run


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Callable[[int], list[tuple[int | None, str]]]]:
    """How many blocks the items make, and a function that reads one of them."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return blocks, lambda i: [tuple(r) for r in items.where(own == i).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that occurs in it: doc_id, item_id, distance, start, end."""
    blocks, read = _blocks(benchmark, block_chars)
    docs, out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None
    for i in range(blocks):
        found = docs.mapInArrow(_match(read(i), errors), MATCHES)
        found = found if blocks == 1 else shared_table(found, "matches")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(items: list[tuple[int | None, str]], errors: float):
    made: list[Matcher] = []

    @pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Matcher(items, errors))
        return pd.Series([not made[0].matches(t) for t in texts], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows in whose text an item of the benchmark occurs; all columns kept. Each row is judged by its own text, whatever its doc_id, and nothing shuffles."""
    blocks, read = _blocks(benchmark, block_chars)
    for i in range(blocks):
        docs = docs.where(_clean(read(i), errors)("text"))
        docs = docs if blocks == 1 else shared_table(docs, "clean")
    return docs
