"""SentencePiece encoding and decoding with seeded merge-dropout.

A BPE model in SentencePiece's format is applied by its own rules: a blank goes before the text, blanks become U+2581, and the best-scoring neighbouring pieces merge, the leftmost first in a tie, until none can; characters without a piece become bytes. With dropout, each candidate merge (a stretch of a chunk, split at a place) is skipped for good if a hash keyed by seed, chunk, doc_id, the chunk's place in the document, and stretch falls under the rate. A chunk is a run of blanks and what follows up to the next blank. So segmentations vary from place to place, are the same again for the same seed, and decode to the text they came from.

The agendas of all chunks of a stretch of text advance together in numpy, one merge a round; chunks longer than LONG use a heap. Both give the same pieces. A distinct chunk is first merged without dropout, its merges noted: where a place skips none of these, they are the best candidates there too and its pieces are the same; everywhere else the agenda runs for that place. The model is read on the driver from a path that is a parameter, and its tables, bounded by the vocabulary, go to the tasks. Tokenizers are never trained here.

Defined results: a null text counts as empty and gives no pieces. A U+2581 in the text is kept apart from blanks by encoding it as bytes. A null doc_id is keyed as 0; rows that repeat are encoded alike. Texts of any length are encoded whole, STRETCH characters at a time. An empty table gives an empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 7
#: Characters encoded together; longest chunk that is not left to the heap.
STRETCH, LONG = 1 << 19, 40
SPACE = "▁"
CHUNK = re.compile(r" *[^ ]+| +")
_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit words (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix1(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M
    return x ^ x >> 31


class Vocabulary:
    """The tables of a model. Characters that occur in pieces without being one get ids from size on."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = np.array([next(i for i in range(self.size) if sp.is_byte(i) and pieces[i] == f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.text = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(self.bytes.tolist()):
            self.text[i] = bytes([b])
        ids = {pieces[i]: i for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError("a piece goes on after a blank: chunks would not be apart")
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            ids[c] = self.size + sum(i >= self.size for i in ids.values())
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                if p[:cut] in ids and p[cut:] in ids:
                    pairs[ids[p[:cut]] << 32 | ids[p[cut:]]] = i
        self.rank = np.array([place.get(sp.get_score(i), len(order)) for i in range(self.size)], np.int64)
        bits = max(8, (8 * len(pairs)).bit_length())
        self.shift, self.keys, self.values = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for key, i in pairs.items():
            at = (key * 0x9E3779B97F4A7C15 & _M) >> (64 - bits)
            while self.keys[at] >= 0:
                at = at + 1 & (1 << bits) - 1
            self.keys[at], self.values[at] = key, i

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        out = np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = at[todo] + 1 & len(self.keys) - 1
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.seed = vocabulary, seed
        self.skip = min(int(dropout * 2**32), 2**32)

    def _skips(self, key: np.ndarray, *parts: np.ndarray) -> np.ndarray:
        for part in parts:
            key = _mix(key + part.astype(np.uint64))
        return (key >> np.uint64(32)) < np.uint64(self.skip)

    def _skipped(self, key: int | None, start: int, mid: int, end: int) -> bool:
        if key is None or not self.skip:
            return False
        h = key
        for part in (start, mid, end):
            h = _mix1(h + part & _M)
        return h >> 32 < self.skip

    def agenda(self, chunk: str, key: int | None) -> list[int]:
        """The pieces of one chunk by a heap of candidates; characters without a piece stay negative: ~code point."""
        v = self.v
        ids = [int(v.char[ord(SPACE if c == " " else c)]) if c != SPACE else -1 for c in chunk]
        ids = [~ord(c) if i < 0 else i for c, i in zip(chunk, ids)]
        n = len(ids)
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def consider(a: int, b: int) -> None:
            if a < 0 or b >= n or ids[a] < 0 or ids[b] < 0:
                return
            key_ = ids[a] << 32 | ids[b]
            at = (key_ * 0x9E3779B97F4A7C15 & _M) >> int(v.shift)
            while v.keys[at] >= 0:
                if v.keys[at] == key_:
                    piece = int(v.values[at])
                    heapq.heappush(heap, (int(v.rank[piece]), a, b, ends[b], piece))
                    return
                at = at + 1 & len(v.keys) - 1

        for i in range(n - 1):
            consider(i, i + 1)
        while heap:
            _, a, b, end, piece = heapq.heappop(heap)
            if after[a] != b or ends[b] != end or ends[a] != b or ids[a] is None or ids[b] is None or self._skipped(key, a, b, end):
                continue
            ids[a], ends[a], after[a] = piece, end, after[b]
            ids[b] = None
            if after[a] < n:
                before[after[a]] = a
            consider(before[a], a)
            consider(a, after[a])
        return [i for i in ids if i is not None]

    def _keys(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(c.encode(), self.seed & _M) for c in chunks), np.uint64, len(chunks))

    def segment(self, chunks: list[str], keys: np.ndarray | None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all chunks in order, offsets). Without keys nothing is skipped. seen gets all merges (chunk, start, mid, end) of chunks up to LONG."""
        v, blank = self.v, int(self.v.char[ord(SPACE)])
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        short = np.flatnonzero(sizes <= LONG)
        points = np.frombuffer("".join(chunks[i] for i in short.tolist()).encode("utf-32-le"), np.uint32).astype(np.int32)
        sid = np.where(points == ord(SPACE), np.int32(-1), v.char[points])
        sid[points == 32] = blank
        sid = np.where(sid < 0, ~points, sid)  # a character without a piece
        word = np.repeat(short.astype(np.int32), sizes[short])
        first = np.cumsum(sizes[short]) - sizes[short]
        start = (np.arange(len(sid)) - np.repeat(first, sizes[short])).astype(np.int32)
        end = start + 1
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (word, start, piece)

        def pairs(i: np.ndarray) -> np.ndarray:
            """Merged pieces of neighbouring pairs, or -1 for those that can't merge or are skipped."""
            out = v.merged(sid[i], sid[i + 1])
            if keys is not None and self.skip:
                at = np.flatnonzero(out >= 0)
                own = i[at]
                out[at[self._skips(keys[word[own]], start[own], start[own + 1], end[own + 1])]] = -1
            return out

        merge = np.full(len(sid), -1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(sid) else np.zeros(0, np.int64)
        merge[inner] = pairs(inner)
        never = np.int32((1 << 31) - 1)  # ranks are bounded by the vocabulary, starts by LONG
        order = np.where(merge >= 0, v.rank[merge] * 64 + start, never).astype(np.int32)
        while len(sid):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(order, heads)
            counts = np.diff(np.append(heads, len(sid)))
            live = np.repeat(best < never, counts)
            if not live.all():
                ended, live = np.flatnonzero(~live), np.flatnonzero(live)
                done.append((word[ended], start[ended], sid[ended]))
                sid, word, start, end, merge, order = (x.take(live) for x in (sid, word, start, end, merge, order))
                best, counts = best[best < never], counts[best < never]
                if not len(sid):
                    break
            at = np.flatnonzero(order == np.repeat(best, counts))  # one in each word: its place is part of the order
            if seen is not None:
                seen.append((word[at], start[at], start[at + 1], end[at + 1]))
            sid[at], end[at] = merge[at], end[at + 1]
            keep = np.ones(len(sid), bool)
            keep[at + 1] = False
            kept = np.flatnonzero(keep)
            sid, word, start, end, merge, order = (x.take(kept) for x in (sid, word, start, end, merge, order))
            at -= np.arange(len(at))  # each merge before this one took a place
            fresh = np.concatenate([at[at > 0] - 1, at])
            fresh = fresh[fresh + 1 < len(sid)]
            merge[at] = -1
            fresh = fresh[word[fresh] == word[fresh + 1]]
            merge[fresh] = pairs(fresh)
            touched = np.concatenate([at, fresh])
            order[touched] = np.where(merge[touched] >= 0, v.rank[merge[touched]] * 64 + start[touched], never)
        for i in np.flatnonzero(sizes > LONG).tolist():
            ids = np.array(self.agenda(chunks[i], None if keys is None else int(keys[i])), np.int64)
            done.append((np.full(len(ids), i), np.arange(len(ids)), ids))
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(chunks) + 1, np.int64)
        word, start, sid = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(word.astype(np.int64) << 32 | start, kind="stable")
        return self._with_bytes(word[by], sid[by], len(chunks))

    def _with_bytes(self, word: np.ndarray, sid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        odd = np.flatnonzero((sid < 0) | (sid >= self.v.size))
        if len(odd):
            back = {int(i): c for c, i in enumerate(self.v.char.tolist()) if i >= self.v.size} if (sid[odd] >= 0).any() else {}
            parts = [self.v.bytes[np.frombuffer(chr(~x if x < 0 else back[x]).encode(), np.uint8)] for x in sid[odd].tolist()]
            times = np.ones(len(sid), np.int64)
            times[odd] = [len(p) for p in parts]
            where = np.repeat(np.isin(np.arange(len(sid)), odd), times)
            sid, word = np.repeat(sid, times), np.repeat(word, times)
            sid[where] = np.concatenate(parts)
        return sid.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])

    def _varies(self, names: list[str], codes: np.ndarray, keys: np.ndarray, seen: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Places of the chunks (by code) that skip one of the merges seen without dropout, or are too long to tell."""
        word, *parts = (np.concatenate(x) for x in zip(*seen)) if seen else (np.zeros(0, np.int32),) * 4
        by = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(names))
        firsts = np.cumsum(counts) - counts
        times = counts[codes]
        ends = np.cumsum(times)
        at = by[np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[codes] - ends + times, times)]
        skips = self._skips(np.repeat(keys, times), *(x[at] for x in parts))
        skipped = np.concatenate([[0], np.cumsum(skips)])
        long = np.fromiter((len(n) > LONG for n in names), bool, len(names))
        return np.flatnonzero((skipped[ends] > skipped[ends - times]) | long[codes])

    def encode(self, rows: list[tuple[int | None, str | None]]) -> list[np.ndarray]:
        """The pieces of each (doc_id, text)."""
        out: list[list[np.ndarray]] = [[] for _ in rows]
        held: list[tuple[int, int, int, list[str]]] = []  # row, doc_id, place of the first chunk, chunks
        size = 0
        for i, (doc_id, text) in enumerate(rows):
            place = 0
            for stretch in _stretches(f" {text}" if text else ""):
                chunks = CHUNK.findall(stretch)
                held.append((i, doc_id or 0, place, chunks))
                place += len(chunks)
                size += len(stretch)
                if size >= STRETCH:
                    self._flush(held, out)
                    held, size = [], 0
        self._flush(held, out)
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.int32) for x in out]

    def _flush(self, held: list[tuple[int, int, int, list[str]]], out: list[list[np.ndarray]]) -> None:
        if not held:
            return
        known = pa.array([c for *_, chunks in held for c in chunks], pa.string()).dictionary_encode()
        codes, names = known.indices.to_numpy().astype(np.int64), known.dictionary.to_pylist()
        counts = [len(chunks) for *_, chunks in held]
        docs = np.repeat(np.array([d & _M for _, d, _, _ in held], np.uint64), counts)
        places = np.concatenate([np.arange(p, p + n) for (_, _, p, _), n in zip(held, counts)]).astype(np.uint64)
        own = self._keys(names)[codes] if self.skip else None
        seen: list[tuple[np.ndarray, ...]] = []
        pieces, offsets = self.segment(names, None, seen)
        starts, sizes = offsets[codes], np.diff(offsets)[codes]
        if self.skip:
            keys = _mix(own + _mix(_mix(docs + np.uint64(self.seed & _M)) + places))
            varies = self._varies(names, codes, keys, seen)
            more, others = self.segment([names[k] for k in codes[varies].tolist()], keys[varies])
            starts[varies], sizes[varies] = len(pieces) + others[:-1], np.diff(others)
            pieces = np.concatenate([pieces, more])
        ends = np.cumsum(sizes)
        flat = pieces[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        for (i, *_), a, b in zip(held, bounds.tolist(), bounds[1:].tolist()):
            out[i].append(flat[a:b])


def _stretches(text: str) -> Iterator[str]:
    """A text in stretches of about STRETCH characters that end between chunks."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        while 0 < end < len(text) and not (text[end] == " " and text[end - 1] != " "):
            end = text.find(" ", end + (text[end] == " "))
            end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of pieces."""
    text = b"".join(map(vocabulary.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:]


def _encode(vocabulary: Vocabulary, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, dropout, seed)
        for whole in batches:
            for first in range(0, len(whole), 500):
                b = whole.slice(first, 500)
                texts = b.column("text").to_pylist()
                ids = encoder.encode(list(zip(b.column("doc_id").to_pylist(), texts)))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                same = [decode(x, vocabulary) == (t or "") for x, t in zip(ids, texts)]
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(same), column], ["doc_id", "n_pieces", "lossless", "ids"])

    return run


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, lossless (whether the pieces decode to the text), ids."""
    run = _encode(Vocabulary(model), dropout, seed)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, lossless boolean, ids array<int>")


def decoded(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    vocabulary = Vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(np.array(x or [], np.int64), vocabulary) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
