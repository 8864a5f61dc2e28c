"""Byte-level BPE encoding and decoding by finite-state machines.

Encoding: the merges of a rank file are compiled into a transducer from bytes to tokens. It rests on one property of merging by lowest rank, leftmost first: a row of tokens is the encoding of its bytes if and only if each two neighbours are the encoding of theirs. So a nondeterministic transducer that walks the trie of tokens and may start the next token wherever the last one may be followed by it has one successful path for each text. It is determinised lazily: a state of the deterministic one is the set of paths still open, each with the tokens that it would add; what all of them begin with is emitted, so a token comes out as soon as the bytes read (the lookahead, bounded by the longest token) leave no other choice. A step that isn't known yet is made a state's when it is met OFTEN; until then the nondeterministic transducer goes through the rest of the chunk, depth first, from what was emitted. Up to STATES states are kept, then they are met anew. A chunk that is a token as a whole is that token even where merges don't lead to it, as in the tokenizers' library.

Decoding: an incremental UTF-8 machine takes tokens one at a time. Its state is the unfinished character's bytes; a step (state, token) gives text and the next state and is kept as well. Bytes that can't go on give U+FFFD, one for each longest beginning of a character, as Python's replacing decoder does.

The text is first cut by the tokenizer's pattern; chunks met before take their tokens from a bounded memo. The rank file is read on the driver from a path that is a parameter, and goes to the tasks (about 1 MB); a Python worker keeps its machines from task to task. Tokenizers are never trained here.

Defined results: a null text counts as empty and has no tokens; null ids decode to an empty text, an id without a token to U+FFFD. Texts of any length are read whole, chunk by chunk, each chunk in time linear in its bytes. Rows that repeat, and ties, have no effect: each row is encoded by itself. An empty table gives an empty result. Columns other than doc_id and text (for decoding: ids) play no part.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.llm.shared import values

#: The rank file that the queries use, and the pattern that cuts texts before merging (fixed value of that file).
RANKS = os.path.join("/opt/tokenizers", "byte_bpe_multi_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that became letters or digits after version 16 of Unicode: the tokenizers' library takes them for neither (fixed values).
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: Letters, digits and blanks of Latin-1, inside a set: texts of these characters alone are cut by the standard library, which is faster (fixed values).
LATIN = ("A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", " \\t-\\r\\x85\\xa0")
#: Most states, pairs of neighbours and chunks that a Python worker keeps (chunks twice as many, the older half to be forgotten), and the longest chunk kept, in characters.
STATES, PAIRS, CHUNKS, CHUNK = 1 << 17, 1 << 18, 1 << 18, 64
#: Characters that the pattern is matched on at once, and how many chunks at their end may still change with what follows.
WINDOW, OPEN = 1 << 16, 3
#: Tokens in a batch of results.
AT_ONCE = 1 << 19
_PATHS, _END, _START = -1, -2, -1
#: A step is kept when it is met so often; until then a state counts under _MET + byte, and the rest of the chunk is searched.
OFTEN, _MET = 4, 256
_NONE = 1 << 62
#: A path's place holds its last token above so many bits and its trie node in them.
_BITS = 32
_NODE = (1 << _BITS) - 1


def ranks_of(blob: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file's lines."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines()) if token}


class Transducer:
    """Bytes of a chunk to tokens. A state is a dictionary from bytes to (tokens emitted, next state); _PATHS has its open paths one after the other (tokens not emitted yet, place: last token and trie node), _END what is emitted if the chunk ends there."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a single byte has no rank")
        self.most = states
        self.token = dict(zip(ranks.values(), ranks))
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.merges: dict[int, int] = {}  # by left << 32 | right
        self.child: dict[int, int] = {}  # by node << 8 | byte
        self.ends, self.inner = [_START], [True]  # for each node of the trie: its token, and whether it has children
        for token, rank in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                below = self.child.setdefault(node << 8 | b, len(self.ends))
                if below == len(self.ends):
                    self.ends.append(_START)
                    self.inner.append(False)
                node = below
            self.ends[node] = rank
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merges[left << 32 | right] = rank
        self.pairs: dict[int, bool] = {}
        self.courses: dict[int, tuple[list[int], list[int], list[int]]] = {}
        self.states: dict[tuple, dict] = {}
        self._forget()

    def _forget(self) -> None:
        for state in self.states.values():
            state.clear()  # states lead to each other: without this they would wait for the garbage collector
        self.states.clear()
        self.start = self._state(((), _START << _BITS))

    def course(self, token: int) -> tuple[list[int], list[int], list[int]]:
        """How a token's bytes merge: the rank of each merge, and before it the first and the last part. After the merges comes a rank above all others, with the parts that are left."""
        known = self.courses.get(token)
        if known is None:
            get, parts, known = self.merges.get, [self.single[b] for b in self.token[token]], ([], [], [])
            while True:
                rank, i = min(((get(a << 32 | b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(_NONE, 0))
                for list_, value in zip(known, (rank, parts[0], parts[-1])):
                    list_.append(value)
                if rank == _NONE:
                    break
                parts[i : i + 2] = [rank]
            self.courses[token] = known
        return known

    def follows(self, last: int, token: int) -> bool:
        """Whether token can come after last, or first: whether merging keeps them apart. Their merges go on side by side, the lower rank first (of equal ones the left), and the pair at the border must never come before both."""
        key = last << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            right, firsts, _ = self.course(token)
            known = firsts[-1] == token
            if known and last != _START:
                left, _, lasts = self.course(last)
                known, i, j, get = lasts[-1] == last, 0, 0, self.merges.get
                while known:
                    border = get(lasts[i] << 32 | firsts[j], _NONE)
                    known = border == _NONE or border >= left[i] or border > right[j]
                    if left[i] > right[j]:
                        j += 1
                    elif left[i] < _NONE:
                        i += 1
                    else:
                        break
            self.pairs[key] = known
        return known

    def _state(self, paths: tuple) -> dict:
        state = self.states.get(paths)
        if state is None:
            state = self.states[paths] = {_PATHS: paths}
        return state

    def step(self, state: dict, byte: int) -> tuple[tuple[int, ...], dict]:
        """What a state emits on a byte and where it goes; kept in the state."""
        child, ends, inner = self.child.get, self.ends, self.inner
        waits, places, paths = [], [], state[_PATHS]
        whole = None  # on the one path on which a token ends here: what waits, and the token
        for i in range(0, len(paths), 2):
            place = paths[i + 1]
            node = child((place & _NODE) << 8 | byte)
            if node is None:
                continue
            token, last = ends[node], place >> _BITS
            if token != _START and whole is None and self.follows(last, token):
                whole = paths[i] + (token,), token
            elif token != _START and last == _START:  # merges don't lead to the token, but it may be the chunk
                waits.append(paths[i])
                places.append(last << _BITS | node)
                continue
            if inner[node]:
                waits.append(paths[i])
                places.append(last << _BITS | node)
        waits.append(whole[0])
        places.append(whole[1] << _BITS)
        sure = waits[0]  # what all paths begin with
        for waiting in waits:
            n = min(len(sure), len(waiting))
            while sure[:n] != waiting[:n]:
                n -= 1
            sure = sure[:n]
            if not sure:
                break
        if sure:
            waits = [waiting[len(sure) :] for waiting in waits]
        if len(self.states) >= self.most:
            self._forget()
            return sure, self._state(tuple(chain.from_iterable(zip(waits, places))))
        found = state[byte] = (sure, self._state(tuple(chain.from_iterable(zip(waits, places)))))
        return found

    def end(self, state: dict) -> tuple[int, ...]:
        """What is emitted after the last byte."""
        if _END not in state:
            paths = state[_PATHS]
            token = self.ends[paths[1] & _NODE]
            # the path on which a token ends is the last one, at the trie's root
            state[_END] = (token,) if paths[1] >> _BITS == _START and token != _START else paths[-2]
        return state[_END]

    def search(self, last: int, chunk: bytes, at: int) -> list[int]:
        """The tokens of a chunk from a place on, after last: the nondeterministic transducer depth first, longest tokens first. Ways that were found to lead nowhere are not taken again."""
        child, ends, follows, size = self.child.get, self.ends, self.follows, len(chunk)

        def next_tokens(at: int) -> list[tuple[int, int]]:
            found, node = [], 0
            for i in range(at, size):
                node = child(node << 8 | chunk[i])
                if node is None:
                    break
                if ends[node] != _START:
                    found.append((ends[node], i + 1))
            return found

        open_, tokens, stops, dead = [next_tokens(at)], [last], [at], set()
        if last == _START and open_[0] and open_[0][-1][1] == size:
            return [open_[0][-1][0]]  # the chunk is a token
        while True:
            if not open_[-1]:  # whatever comes after this token leads nowhere
                open_.pop()
                dead.add((tokens.pop(), stops.pop()))
                continue
            token, stop = open_[-1].pop()
            if follows(tokens[-1], token) and (token, stop) not in dead:
                tokens.append(token)
                if stop == size:
                    return tokens[1:]
                stops.append(stop)
                open_.append(next_tokens(stop))

    def encode(self, chunk: bytes) -> list[int]:
        state, out, done = self.start, [], 0
        for byte in chunk:
            step = state.get(byte)
            if step is None:
                met = state.get(_MET + byte, 0) + 1
                if met < OFTEN:  # not worth a state yet
                    state[_MET + byte] = met
                    return out + self.search(out[-1] if out else _START, chunk, done)
                step = self.step(state, byte)
            emitted, state = step
            if emitted:
                out += emitted
                for token in emitted:
                    done += len(self.token[token])
        out += self.end(state)
        return out


class _Chunks(dict):
    """Tokens of the chunks met lately, as the bytes of 32-bit numbers. When it is full, the chunks in it become the older ones, and the older ones are forgotten."""

    def __init__(self, machine: Transducer):
        self.machine, self.older = machine, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk) or array("i", self.machine.encode(chunk.encode())).tobytes()
        if len(chunk) <= CHUNK:
            if len(self) >= CHUNKS:
                self.older = self.copy()
                self.clear()
            self[chunk] = found
        return found


class Encoder:
    """Texts to tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in NEWER.split())
        older = pattern
        for kind in ("L", "N"):  # inside a negated set, a newer code point is one more that isn't of the kind
            older = older.replace(rf"[^\s\p{{L}}\p{{N}}]", "(?:OTHER)").replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{newer}]]")
        older = older.replace("(?:OTHER)", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]")
        self.plain, self.older = regex.compile(pattern), regex.compile(older, regex.V1)
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(LATIN)}]")
        for kind, own in zip((r"\p{L}", r"\p{N}", r"\s"), LATIN):
            latin = latin.replace(kind, f"[{own}]")
        self.latin = re.compile(latin.replace(r"\S", f"[^{LATIN[2]}]"))
        self.newer = {chr(c) for first, _, last in (part.partition("-") for part in NEWER.split()) for c in range(int(first, 16), int(last or first, 16) + 1)}
        self.tokens = _Chunks(Transducer(ranks))

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The pattern's chunks, in order, a window of the text at a time."""
        try:
            text.encode("latin-1")
            found = self.latin
        except UnicodeEncodeError:
            found = self.plain if self.newer.isdisjoint(text) else self.older
        at, size = 0, WINDOW
        while at < len(text):
            part = found.findall(text, at, at + size)
            if at + size < len(text):
                part = part[:-OPEN]
                if not part:  # a chunk longer than the window
                    size *= 2
                    continue
            yield part
            at, size = at + sum(map(len, part)), WINDOW

    def packed(self, text: str | None) -> bytes:
        """The tokens of a text as the bytes of 32-bit numbers."""
        return b"".join(chain.from_iterable(map(self.tokens.__getitem__, part) for part in self.chunks(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


#: What may come next in a character: least and largest byte, and the step after it (none: the character is whole).
_TAILS = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def _lead(byte: int) -> int | None:
    """The step after a character's first byte; None if no character begins with it."""
    if byte < 0x80:
        return 0
    special = {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}.get(byte)
    return special or (1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF1 <= byte <= 0xF3 else None)


class Decoder:
    """Tokens to text, in pieces of any size."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = dict(zip(ranks.values(), ranks))
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        listed = [self.token.get(i) for i in range(max(self.token) + 1)]
        self.bytes = np.frombuffer(b"".join(t or b"" for t in listed), np.uint8)
        self.ends = np.cumsum([0, *(len(t or b"") for t in listed)])
        self.whole = np.array([t is not None and self.run(b"", t) == (t.decode("utf-8", "replace"), b"") and "\ufffd" not in t.decode("utf-8", "replace") for t in listed])  # characters from end to end

    @staticmethod
    def run(held: bytes, more: bytes) -> tuple[str, bytes]:
        """The text of held (the beginning of a character) and more bytes, and what is held after them."""
        out, at = [], 0
        if held:
            at = _lead(held[0])
            for b in held[1:]:
                at = _TAILS[at][2]
        for b in more:
            if at:
                low, high, after = _TAILS[at]
                if low <= b <= high:
                    held, at = held + bytes([b]), after
                    if not at:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
            at = _lead(b)
            held = bytes([b]) if at else b""
            if not at:
                out.append("�" if at is None else chr(b))
                at = 0
        return "".join(out), held

    def _text(self, ids: np.ndarray) -> str:
        """The text of tokens that are whole characters."""
        sizes = self.ends[ids + 1] - self.ends[ids]
        before = np.cumsum(sizes) - sizes
        return self.bytes[np.repeat(self.ends[ids] - before, sizes) + np.arange(int(sizes.sum()))].tobytes().decode()

    def feed(self, held: bytes, ids) -> tuple[str, bytes]:
        """The text that ids add after held, and what is held then. Between characters, tokens that are whole characters leave the machine where it is and need no steps."""
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < len(self.whole))
        odd = np.flatnonzero(~(known & self.whole[np.where(known, ids, 0)])).tolist()
        out, at = [], 0
        for place in [*odd, len(ids)]:
            while held and at < place:  # a character's rest can't come: the machine says so
                text, held = self.step(held, int(ids[at]))
                out.append(text)
                at += 1
            for first in range(at, place, 1 << 16):
                out.append(self._text(ids[first : min(first + (1 << 16), place)]))
            if place < len(ids):
                text, held = self.step(held, int(ids[place]))
                out.append(text)
            at = place + 1
        return "".join(out), held

    def step(self, held: bytes, i: int) -> tuple[str, bytes]:
        found = self.steps.get((held, i))
        if found is None:
            if len(self.steps) >= PAIRS:
                self.steps.clear()
            found = self.steps[held, i] = self.run(held, self.token[i]) if i in self.token else ("\ufffd" * (1 + bool(held)), b"")
        return found

    def decode(self, ids) -> str:
        text, held = self.feed(b"", ids)
        return text + "�" * bool(held)


@contextmanager
def _uncollected():
    """Without the garbage collector, which would look through all states again and again: what the machines make is freed by its counts."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_MACHINES: dict[tuple, tuple[Encoder, Decoder]] = {}


def machines(blob: bytes, pattern: str = PATTERN) -> tuple[Encoder, Decoder]:
    """The machines of a rank file's content, made once in a process."""
    key = (hashlib.sha256(blob).digest(), pattern)
    if key not in _MACHINES:
        _MACHINES.clear()
        ranks = ranks_of(blob)
        _MACHINES[key] = Encoder(ranks, pattern), Decoder(ranks)
    return _MACHINES[key]


def _lists(rows: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(row) // 4 for row in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))]))


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """One row per row of docs: doc_id, ids."""
    blob = _read(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = machines(blob, pattern)
        for b in batches:
            rows, first, held = [], 0, 0
            for text in values(b.column("text")):
                with _uncollected():
                    rows.append(encoder.packed(text))
                held += len(rows[-1]) // 4
                if held >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(rows)), _lists(rows)], ["doc_id", "ids"])
                    first, rows, held = first + len(rows), [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(rows)), _lists(rows)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids, text): rows (doc_id, ids) with the text of their ids."""
    blob = _read(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = machines(blob)
        for b in batches:
            for first in range(0, len(b), 200):
                part = b.slice(first, 200)
                lists = part.column("ids")
                ids, ends = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
                texts = [decoder.decode(ids[a:z]) for a, z in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids, text)."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))
