"""Byte-level BPE against the tokenizers' library, plain merging and exact round trips."""

import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echolith.llm import byte_bpe, queries
from echolith.llm.byte_bpe import Decoder, Encoder, Transducer, ranks_of

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SINGLE = {bytes([b]): b for b in range(256)}


def small(*tokens: bytes) -> dict[bytes, int]:
    return SINGLE | {t: 256 + i for i, t in enumerate(tokens)}


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        blob = f.read()
    assert ranks_of(blob) == {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    return ranks_of(blob)


@pytest.fixture(scope="module")
def pair(ranks):
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    return Encoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged(ranks, piece):
    """The encoding of a few bytes by the merges themselves, lowest rank first, the leftmost of several."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), max_size=14, unique=True), st.text("abc", max_size=24))
def test_transducer_equals_merging(tokens, text):
    """Any ranks, also such as merges never lead to, or out of order."""
    found = small(*(t.encode() for t in tokens))
    machine, piece = Transducer(found), text.encode()
    if piece:
        want = [found[piece]] if piece in found else merged(found, piece)
        assert [machine.encode(piece) for _ in range(6)] == [want] * 6  # searched first, then by states
        assert machine.search(-1, piece, 0) == want
        for a in found:
            for b in found:
                if a[0] > 96 and b[0] > 96 and len(a + b) < 8 and max(a + b) < 100:
                    assert machine.follows(found[a], found[b]) == (merged(found, a + b) == [found[a], found[b]])
        assert want == tiktoken.Encoding("s", pat_str=r"[abc]+", mergeable_ranks=found, special_tokens={}).encode_ordinary(text)


def test_tokens_come_after_bounded_lookahead():
    machine = Transducer(small(b"ab", b"abc", b"cd", b"abcd"[1:3]))
    state, late, deepest = machine.start, 0, 0
    for b in b"abcdabcxabab" * 50:
        emitted, state = state.get(b) or machine.step(state, b)
        late += 1 - sum(len(machine.token[t]) for t in emitted)
        deepest = max(deepest, late)
    assert deepest <= 2 * max(map(len, machine.token.values()))


def test_states_are_forgotten_not_results(ranks):
    machine, plain = Transducer(ranks, states=20), Transducer(ranks)
    rng = random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choice("abcdefgh thing") for _ in range(30)).encode()
        assert machine.encode(piece) == plain.encode(piece) and len(machine.states) <= 20


def test_random_texts_equal_the_library(pair):
    encoder, library = pair
    rng, alphabet = random.Random(7), [chr(c) for c in range(9, 127)] + list("éßñ中文字\U0001f600‍ \x85ⅷ²'") * 2
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [c * n for c in (" ", "\n", "a", "=", "'", "é", "中", "\U0001f600", "it's ", "'re") for n in (1, 2, 3, 127, 128, 129, 1000)]
    texts += ["".join(chr(rng.choice([*range(256)])) for _ in range(200)) for _ in range(200)]
    texts += ["a՘b", "1\U0001246f2", "!\U00033400!", "x" * 70_000 + " 's", "don't" * 40_000, " " * 70_000 + "x", "", "\x00"]
    for t in texts:
        assert encoder.encode(t) == library.encode_ordinary(t), t[:50]


def test_windows_cut_where_the_pattern_does(pair, monkeypatch):
    encoder, library = pair
    rng = random.Random(9)
    text = "".join(rng.choice(["we're", " it's", "  ", "\n\n", " a", "12", "'", "' r", "ve", "...", "ß"]) for _ in range(4000))
    for window in (4, 5, 7, 64):
        monkeypatch.setattr(byte_bpe, "WINDOW", window)
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_decoder_equals_the_replacing_decoder():
    rng, decoder = random.Random(1), Decoder(SINGLE | {b"\xe4\xb8": 300, b"\xad\xe4": 301, b"\xf0\x9f": 302})
    pool = [0x41, 0x80, 0xBF, 0xC2, 0xC0, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE4, 0xB8, 0xAD, 0xF1, 300, 301, 302]
    for _ in range(5000):
        ids = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        whole = b"".join(decoder.token[i] for i in ids).decode("utf-8", "replace")
        assert decoder.decode(ids) == whole
        cut = rng.randint(0, len(ids))
        first, held = decoder.feed(b"", ids[:cut])
        rest, held = decoder.feed(held, ids[cut:])
        assert first + rest + "�" * bool(held) == whole
    assert decoder.decode([0xE4, 999, 0x41]) == "��A"


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (None, "don't"), (5, "\U0001f600 ▁ ü\x00"), (6, "word " * 60_000), (7, "x" * 300_000)]


def test_odd_tables_round_trip(spark, pair):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"ids": F.lit("x"), "n_tokens": F.lit(1), "lang": F.lit(None).cast("string")})
    rows = byte_bpe.decoded(byte_bpe.encode(docs, PATH), PATH)
    got = sorted(((r["doc_id"] or 0, r["text"], len(r["ids"])) for r in rows.collect()))
    assert got == sorted((d or 0, t or "", len(pair[1].encode_ordinary(t or ""))) for d, t in ODD)
    assert byte_bpe.digests(byte_bpe.decoded(byte_bpe.encode(docs.where("false")))).count() == 0
    assert [r["text"] for r in byte_bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [""]


def test_query_equals_the_library(spark, pair):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in queries.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = pair[1].encode_ordinary(r["text"] or "")
        own = got[r["doc_id"]]
        assert (own["n_tokens"], own["ids_sha256"], own["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(r["text"] or ""))
