"""Texts are counted and tokenised some bytes at a time, whatever batches they came in."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echolith.llm import lm

TEXTS = ["", "  ", "a b a", None, "A\tb\n\n c \x0b x", "é Ünï É", "x" * 100 + " y", "\xa0 nb\xa0sp", " lead trail ", "zz zz zz q"] * 20


class Task:
    get = staticmethod(lambda: Task)
    partitionId = staticmethod(lambda: 3)


def batches(size):
    n = len(TEXTS)
    whole = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([False] * n), pa.array([True] * n), pa.array(range(n), pa.int64()), pa.array(TEXTS, pa.string())], ["doc_id", "held_out", "learn", "h", "text"])
    return [whole.slice(i, size) for i in range(0, n, size)]


def counted(size):
    out = Counter()
    for b in lm._counted(iter(batches(size))):
        out.update(dict(zip(b.column("word").to_pylist(), b.column("c").to_pylist())))
    return out


@pytest.mark.parametrize("chars", [1, 60, 1 << 23])
@pytest.mark.parametrize("learned", [0, 4, 99])
def test_rows_and_counts_are_those_of_each_text_alone(monkeypatch, chars, learned):
    monkeypatch.setattr(lm, "CHARS", chars)
    monkeypatch.setattr(lm, "TaskContext", Task)
    want = Counter(w for t in TEXTS for w in [*lm.words(t), lm.END])
    assert counted(1) == counted(7) == counted(len(TEXTS)) == want
    head = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:learned]
    lex = lm.Lexicon(head, sum(want.values()) if learned else 0, len(want) if learned else 0)
    for size in (1, 7, len(TEXTS)):
        rows = [r for b in lm._tokenise(lex)(iter(batches(size))) for r in b.to_pylist()]
        assert [r["row"] for r in rows] == [(3 << 40) + i for i in range(len(TEXTS))] and [r["doc_id"] for r in rows] == list(range(len(TEXTS)))
        for r, text in zip(rows, TEXTS):
            own = [*lm.words(text), lm.END]
            assert np.frombuffer(r["ids"], np.uint16).tolist() == [lex.id.get(w, 1) if w in lex.count else 1 for w in own]
            assert {t["word"]: t["n"] for t in r["tail"]} == Counter(w for w in own if w not in lex.count)
            assert r["n_tokens"] == len(own) and r["known"] == sum(w in lex.count for w in own)
            assert r["base"] == pytest.approx(sum(np.log10((lex.count[w] + lm.SMOOTH) / lex.z) for w in own if w in lex.count))


def test_small_batches_are_looked_up_together(monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", Task)
    made = list(lm._tokenise(lm.Lexicon([(b"a", 3), (lm.END, 2)], 5, 2))(iter(batches(1))))
    assert len(made) == 1 and len(made[0]) == len(TEXTS)
