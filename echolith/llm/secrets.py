"""Secret scan with a recursive decoding worklist.

Three kinds of secrets are found in the text itself (the base) and again in every layer that can be unwrapped from it: URL escapes, Unicode and character-reference escapes, base64 runs, and compressed bytes inside those. Layers go on a worklist until none is new; a layer whose text was seen before at the same stretch of the original is dropped, which ends cycles. Escapes of escapes are unwrapped one level at a time for STEPS levels, each a layer, and from there to the innermost text in one pass, so that a text of n characters costs time and memory of the order of n however deep it nests (levels in between differ from that text in unfinished escapes only). Each layer carries, for every character, the stretch of the original text that it came from, so that a secret found at any depth is reported by its span in the original, in code points, end exclusive.

Defined results: a null text counts as empty and has no spans. Rows that repeat are scanned alike. An empty table gives an empty result. Columns other than doc_id and text play no part. Base64 is read from each of its four alignments, also over line breaks; what does not decode to a text whole is searched for stretches of text and for compressed streams. Bytes that unpack to more than UNPACKED bytes are read in pieces that overlap by OVERLAP bytes, which bounds a task's memory; a compressed stream inside such a stream is read through it, whole. A very long text is scanned whole. Compressed streams within streams cost what they unpack to.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.llm.shared import values

#: Kinds, in the order of reports.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Shortest base64 run that is tried; share of printable characters that makes bytes a text.
BASE64_LEAST, PRINTABLE = 16, 0.95
UNPACKED, OVERLAP, READ = 1 << 26, 1 << 16, 1 << 12
#: Levels of escapes that are unwrapped one by one.
STEPS = 4
#: Base64 that goes on after a line break.
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++")
#: Stretches of printable UTF-8 as long as what the shortest base64 run holds; where a compressed stream may begin.
STRETCH = re.compile(rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}+")
PACKED = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda\x3f\x7d\xbb\xf9]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\u\{0*([0-9a-fA-F]{1,6})\}|\\U([0-9a-fA-F]{8})|\\x([0-9a-fA-F]{2})|&#0*([0-9]{1,7});|&#[xX]0*([0-9a-fA-F]{1,6});")


def _table(chars: str) -> bytes:
    return bytes(1 if chr(i) in chars else 0 for i in range(256))


IS_HEX = _table("0123456789abcdef")
IS_BASE64 = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")


def _runs(narrow: bytes, table: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least so many of the table's characters; narrow has a byte for each code point."""
    marked, ones, at = narrow.translate(table), b"\1" * least, 0
    while (a := marked.find(ones, at)) >= 0:
        b = marked.find(b"\0", a)
        at = b = len(marked) if b < 0 else b
        yield a, b


def _narrow(text: str) -> bytes:
    return text.encode("latin-1", "replace")


def find(text: str, narrow: bytes | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the text itself, by start, then kind."""
    narrow = _narrow(text) if narrow is None else narrow
    out = [("hex", a, b) for a, b in _runs(narrow, IS_HEX, HEX_LEAST)]
    if (b"=" in narrow or b":" in narrow) and any(n in low for low in (narrow.lower(),) for n in NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in narrow:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Layer:
    """A text unwrapped from the original; starts and ends give each character's stretch of the original."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, path: tuple[str, ...] = ()):
        self.text, self.starts, self.ends, self.path = text, starts, ends, path

    def original(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def replaced(self, parts: list[tuple[int, int, str]], how: str) -> Layer:
        """The layer with stretches (start, end, text) replaced; a replacement's characters share its stretch."""
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in parts:
            s, e = self.original(a, b)
            texts += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), s)]
            ends += [self.ends[at:a], np.full(len(new), e)]
            at = b
        return Layer("".join([*texts, self.text[at:]]), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]), (*self.path, how))


def _char(m: re.Match) -> str:
    high, low, *codes = m.groups()
    if high:
        return chr(0x10000 + ((int(high, 16) & 0x3FF) << 10) + (int(low, 16) & 0x3FF))
    code = next(int(c, 10 if i == 4 else 16) for i, c in enumerate(codes) if c is not None)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _url(layer: Layer) -> Iterator[Layer]:
    parts = []
    for m in URL.finditer(layer.text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            size = 3 * len(c.encode("utf-8", "surrogateescape"))
            parts.append((at, at + size, c if not 0xDC80 <= ord(c) <= 0xDCFF else "�"))
            at += size
    if parts:
        yield layer.replaced(parts, "url")


def _unicode(layer: Layer) -> Iterator[Layer]:
    if parts := [(m.start(), m.end(), _char(m)) for m in UNICODE.finditer(layer.text)]:
        yield layer.replaced(parts, "unicode")


HEX = frozenset(map(ord, "0123456789abcdefABCDEF"))
#: Codes from here on stand for single bytes of UTF-8.
BYTE = 0x110000


def _escape(codes: list[int]) -> tuple[int, int] | None:
    """(code points that it takes, code) of the escape that codes end with."""
    last = codes[-1]
    if last in HEX:
        for mark, digits, size in ((0x25, 2, 3), (0x78, 2, 4), (0x75, 4, 6), (0x55, 8, 10)):  # %.. \x.. \u.... \U........
            if len(codes) >= size and codes[-digits - 1] == mark and (mark == 0x25 or codes[-size] == 0x5C) and all(c in HEX for c in codes[-digits:]):
                code = int("".join(map(chr, codes[-digits:])), 16)
                return size, code + BYTE if mark == 0x25 and code > 0x7F else code if code < BYTE else 0xFFFD
    elif last in (0x7D, 0x3B):  # } of \u{...}, ; of &#...; and &#x...;
        at = len(codes) - 1
        while at and codes[at - 1] in HEX:
            at -= 1
        digits, before = "".join(map(chr, codes[at:-1])), codes[max(0, at - 3) : at]
        base, opened = (16, before == [0x5C, 0x75, 0x7B]) if last == 0x7D else (16, True) if before in ([0x26, 0x23, 0x78], [0x26, 0x23, 0x58]) else (10, before[-2:] == [0x26, 0x23] and digits.isdigit())
        if digits and opened and len(digits.lstrip("0")) <= (7 if base == 10 else 6):
            code = int(digits.lstrip("0") or "0", base)
            return len(codes) - at + (2 if base == 10 else 3), code if code < BYTE else 0xFFFD
    return None


def _innermost(layer: Layer) -> Layer:
    """The layer with every escape unwrapped, those that unwrapping makes as well, in one pass: what is put on the stack may complete an escape, whose result may complete another."""
    codes, starts, ends = [], [], []
    for code, start, end in zip(map(ord, layer.text), layer.starts.tolist(), layer.ends.tolist()):
        codes.append(code)
        starts.append(start)
        ends.append(end)
        while (found := _escape(codes)) is not None:
            size, new = found
            codes[-size:] = [new]
            del starts[len(codes) :], ends[len(codes) - 1 :]
            ends.append(end)
            if 0xDC00 <= new < 0xE000 and len(codes) > 1 and 0xD800 <= codes[-2] < 0xDC00:
                codes[-2:] = [0x10000 + ((codes[-2] & 0x3FF) << 10) + (new & 0x3FF)]
                del starts[-1], ends[-2]
    text, first, last, at = [], [], [], 0
    while at < len(codes):
        if codes[at] < BYTE:
            text.append("�" if 0xD800 <= codes[at] < 0xE000 else chr(codes[at]))
            first.append(starts[at])
            last.append(ends[at])
            at += 1
            continue
        to = at
        while to < len(codes) and codes[to] >= BYTE:
            to += 1
        for c in bytes(x - BYTE for x in codes[at:to]).decode("utf-8", "surrogateescape"):
            size = len(c.encode("utf-8", "surrogateescape"))
            text.append("�" if 0xDC80 <= ord(c) <= 0xDCFF else c)
            first.append(starts[at])
            last.append(ends[at + size - 1])
            at += size
    return Layer("".join(text), np.array(first, np.int64), np.array(last, np.int64), (*layer.path, "nested"))


def _escapes(layer: Layer, narrow: bytes) -> Iterator[Layer]:
    """The layer with its escapes unwrapped: one level of either kind, or past STEPS levels all that is left."""
    if not (b"%" in narrow or b"\\" in narrow or b"&#" in narrow) or layer.path[-1:] == ("nested",):
        return
    if len(layer.path) >= STEPS and {"url", "unicode"}.issuperset(layer.path[-STEPS:]):
        yield _innermost(layer)
    else:
        yield from _url(layer)
        yield from _unicode(layer)


class _Unpacked(io.RawIOBase):
    """What is unpacked from the compressed stream that a reader stands at. A stream that breaks off raises EOFError."""

    def __init__(self, source: io.BufferedReader, made):
        self.source, self.made = source, made

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        d, size = self.made, len(into)
        if isinstance(d, zstandard.ZstdDecompressionReader):
            out = d.read(size)
        else:
            zipped = not hasattr(d, "needs_input")
            out = b"" if d.eof else d.decompress(d.unconsumed_tail, size) if zipped else b""
            while not out and not d.eof:
                data = self.source.read1(READ) if zipped or d.needs_input else b""
                if not data and (zipped or d.needs_input):
                    raise EOFError
                out = d.decompress(data, size)
        into[: len(out)] = out
        return len(out)


def _opened(source: io.BufferedReader) -> tuple[str, io.BufferedReader] | None:
    """(format, reader of what it holds) if a reader stands at a compressed stream."""
    head = source.peek(6)[:6]
    if head[:2] == b"\x1f\x8b":
        name, made = "gzip", zlib.decompressobj(31)
    elif head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        name, made = "zlib", zlib.decompressobj(15)
    elif head[:3] == b"BZh":
        name, made = "bz2", bz2.BZ2Decompressor()
    elif head == b"\xfd7zXZ\x00":
        name, made = "xz", lzma.LZMADecompressor()
    elif head[:4] == b"\x28\xb5\x2f\xfd":
        name, made = "zstd", zstandard.ZstdDecompressor().stream_reader(source, closefd=False)
    else:
        return None
    return name, io.BufferedReader(_Unpacked(source, made), READ)


BROKEN = (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError)


def _whole(piece: bytes) -> bytes:
    """A piece of a longer text without the broken characters at its ends."""
    first = next((i for i in range(min(4, len(piece))) if piece[i] & 0xC0 != 0x80), 0)
    last = next((i for i in range(1, min(4, len(piece)) + 1) if piece[-i] & 0xC0 != 0x80), 0)
    size = {0xC: 2, 0xD: 2, 0xE: 3, 0xF: 4}.get(piece[-last] >> 4, 1) if last else 0
    return piece[first : len(piece) - last if last < size else len(piece)]


def _piece(source: io.BufferedReader) -> bytes:
    """The next UNPACKED bytes, fewer at the end."""
    parts, left = [], UNPACKED
    while left and (part := source.read(min(left, READ))):
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def _streams(data: bytes, start: int, path: tuple[str, ...], inner: dict[bytes, int]) -> Iterator[tuple[str, tuple[str, ...]]]:
    """(text, path) of what is unpacked from the compressed stream at a place of data, and from streams within it: whole, or in overlapping pieces if it is long. Of a stream that breaks off, pieces before its last. inner has the digests of what streams within streams of data held, with their outermost stream's end: a place in such a stream that holds the same again is one of them."""
    todo, seen, place, end = [(data, start, 1, path)], set(), start, 0
    while todo:
        data, start, times, path = todo.pop()
        source = first = io.BufferedReader(io.BytesIO(data), READ)
        source.seek(start)
        try:
            for _ in range(times):
                if (made := _opened(source)) is None:
                    break
                name, source = made
            if made is None:
                continue
            out = _piece(source)
            own = hashlib.blake2b(out, digest_size=16).digest()
            if own in seen:
                continue
            if seen:
                inner[own] = max(inner.get(own, 0), end)
            elif place < inner.get(own, 0):
                return
            elif len(out) < UNPACKED and hasattr(source.raw.made, "unused_data"):
                end = first.tell() - len(source.raw.made.unused_data)
            seen.add(own)
            if len(out) < UNPACKED:
                if (text := _as_text(out)) is not None:
                    yield text, (*path, name)
                else:
                    todo.append((out, 0, 1, (*path, name)))
                continue
            if _as_text(_whole(out)) is None:
                todo.append((data, start, times + 1, (*path, name)))
            while out:
                if (text := _as_text(_whole(out))) is not None:
                    yield text, (*path, name)
                more = _piece(source)
                out = out[-OVERLAP:] + more if more else b""
        except BROKEN:
            continue


def _as_text(data: bytes) -> str | None:
    """Bytes as a text, if they are UTF-8 and nearly all printable."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if text.isprintable():
        return text or None
    good = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if text and good >= PRINTABLE * len(text) else None


def _base64(layer: Layer, narrow: bytes) -> Iterator[Layer]:
    places = [(np.arange(a, b), b) for a, b in _runs(narrow, IS_BASE64, BASE64_LEAST)]
    if b"\n" in narrow:
        for m in WRAPPED.finditer(narrow):
            at = m.start() + np.flatnonzero(np.frombuffer(m[0].translate(IS_BASE64), np.uint8))
            if len(at) >= BASE64_LEAST:
                places.append((at, m.end()))
    for at, b in places:
        end = b + len(re.match(rb"={0,2}", narrow[b : b + 2])[0])
        chars = np.frombuffer(narrow, np.uint8)[at].tobytes().translate(bytes.maketrans(b"-_", b"+/"))
        for skip in range(4):
            inner: dict[bytes, int] = {}
            run = chars[skip:]
            run = run[:-1] if len(run) % 4 == 1 else run
            data = base64.b64decode(run + b"=" * (-len(run) % 4))
            text = _as_text(data) if not skip else None
            found = [(0, text)] if text is not None else [(m.start(), m[0].decode()) for m in STRETCH.finditer(data)]
            for place, text in found:  # byte j came from characters 4j/3 on
                sizes = place + np.cumsum([0, *(len(c.encode()) for c in text)])
                first, last = skip + sizes[:-1] * 4 // 3, np.minimum(skip + -(-sizes[1:] * 4 // 3), len(at))
                yield Layer(text, layer.starts[at[first]], layer.ends[at[last - 1]], (*layer.path, "base64"))
            for m in PACKED.finditer(data):
                a = int(at[skip + m.start() * 4 // 3])
                for text, path in _streams(data, m.start(), (*layer.path, "base64"), inner):
                    s, e = layer.original(a, end)
                    yield Layer(text, np.broadcast_to(np.int64(s), len(text)), np.broadcast_to(np.int64(e), len(text)), path)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """(base spans, spans that decoding adds with the path of layers)."""
    text = text or ""
    narrow = _narrow(text)
    base = find(text, narrow)
    todo = [Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))] if _may_unwrap(narrow) else []
    seen, known, added = {_own(todo[0])} if todo else set(), set(base), []
    while todo:
        layer = todo.pop()
        narrow = _narrow(layer.text)
        for new in _escapes(layer, narrow):
            todo += _fresh(new, seen)
        for new in _base64(layer, narrow):
            todo += _fresh(new, seen)
        if layer.path:
            for kind, a, b in find(layer.text, narrow):
                span = (kind, *layer.original(a, b))
                if span not in known:
                    known.add(span)
                    added.append((*span, "/".join(layer.path)))
    return base, sorted(added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _own(layer: Layer) -> tuple[bytes, int, int]:
    """What tells a layer from others: its text's digest and its stretch of the original."""
    return hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *(layer.original(0, len(layer.text)) if layer.text else (0, 0))


def _fresh(layer: Layer, seen: set[tuple[bytes, int, int]]) -> list[Layer]:
    own = _own(layer)
    if own in seen:
        return []
    seen.add(own)
    return [layer]


def _may_unwrap(narrow: bytes) -> bool:
    """Whether a layer may be in the text at all: an escape sign or a run that is long enough."""
    return b"%" in narrow or b"\\" in narrow or b"&#" in narrow or b"\1" * BASE64_LEAST in narrow.translate(IS_BASE64) or b"\n" in narrow and WRAPPED.search(narrow) is not None


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, t in zip(b.column("doc_id").to_pylist(), values(b.column("text"))):
            base, added = scan(t)
            n = [sum(k == kind for k, *_ in base) for kind in KINDS]
            every = sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            rows.append((d, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), ",".join(x[3] for x in added)))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 4 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of base spans by kind, their digest, all spans, and the layers of those that decoding added."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SCHEMA)
