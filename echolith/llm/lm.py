"""Language-model scoring by a gated recurrent network with a class-factored output.

Words are counted over all training documents; the WORDS most frequent are the network's vocabulary, in CLASSES classes of neighbouring frequency, and P(word) = P(class | state) P(word | class, state). Any other word is the network's unknown word times its share of the counts that the vocabulary leaves over, so the model is a distribution over all words, unseen ones included.

Texts are tokenised once, into a table of ids. Training: a start is fitted on a bounded sample (the WARM documents with the least hash), then documents are dealt by hash to shards of about SHARD tokens; each shard trains on all its documents by truncated backpropagation in numpy, from the same parameters, which are then averaged by the tokens that each shard learned from, summed in slices over a shuffle, and go on to the next of ROUNDS. The result depends on the documents alone, not on how the input is split or batched. Scoring runs every document through the network whole: its state is carried from window to window and reset at its first token.

The HEAD most frequent words of at most WORD_BYTES bytes go to the tasks (a bounded table); counts of all others are joined by word, so the tables of words and of counts grow with the corpus without passing through the driver.

Defined results: a null text counts as empty: one token, the end. A null doc_id is neither held out nor learned from. Without training documents base_score is 0 and the score is that of the untrained network. Rows that repeat are scored each. An empty table gives an empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from copy import copy
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.llm.shared import shared_table

#: Words of the network's vocabulary, its classes, its state and embedding sizes.
WORDS, CLASSES, STATE, EMBED = 4096, 64, 16, 16
#: Words whose counts go to every task, and the longest of them in bytes.
HEAD, WORD_BYTES = 1 << 18, 64
#: Documents that fit the start, and passes over them.
WARM, WARM_PASSES = 2000, 3
#: Tokens of a shard, and in how many rounds the shards' parameters are averaged.
SHARD, ROUNDS = 1 << 21, 2
#: Tokens that run side by side; bytes of texts tokenised at a time.
GROUP, CHARS = 1 << 21, 1 << 23
#: Least and most steps of a training window and of a scoring window; most lanes that run side by side; tokens of an update at least; rows of logits made at a time.
STEPS, SCORE_STEPS, LANES, UPDATE, ROWS = (24, 256), (32, 2048), 768, 4096, 2048
WARM_RATE, RATE, SEED = 0.01, 0.003, 11
#: The end of a text as a word: no word holds a blank.
END = b" "
#: Words that a task counts before it hands the counts on; parameters summed in one row.
HELD, SLICE = 1 << 20, 4096
SMOOTH = 0.1


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode().lower().split()


def fold(doc_id: Column, folds: int = 10) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(rows, their words, where each row's words end), some CHARS of texts at a time, whatever the size of batches."""

    def made(rows: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, pa.Array, np.ndarray]:
        b = pa.concat_batches(rows) if len(rows) > 1 else rows[0]
        texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(b.column("text"), "")))
        split = pc.ascii_split_whitespace(texts)
        lengths = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return b, pc.filter(split.flatten(), pc.not_equal(split.flatten(), "")).cast(pa.binary()), np.cumsum(lengths)

    held, size = [], 0
    for b in batches:
        ends, first = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while first < len(b):
            before = ends[first - 1] if first else 0
            end = int(np.searchsorted(ends, before + CHARS - size, side="right"))
            if end == first and not held:
                end += 1  # a text of more than CHARS is a piece
            if end > first:
                held.append(b.slice(first, end - first))
                size += int(ends[end - 1] - before)
                first = end
            if first < len(b) or size >= CHARS:
                yield made(held)
                held, size = [], 0
    if held:
        yield made(held)


def _coded(column: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """A column's pieces: (rows, their distinct words, the place of each word among these, where each row's words end)."""
    for b, found, ends in _pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])])):
        coded = found.dictionary_encode()
        yield len(b), coded.dictionary.to_pylist(), coded.indices.to_numpy(), ends


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        one = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return pa.RecordBatch.from_arrays([one.column("word").combine_chunks(), one.column("c_sum").combine_chunks()], ["word", "c"])

    held = []
    for b, found, _ in _pieces(batches):
        own = found.value_counts()
        held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([own.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([own.field("counts"), pa.array([len(b)], pa.int64())])], ["word", "c"]))
        if sum(map(len, held)) > HELD:
            yield made()
            held = []
    if held:
        yield made()


def counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows' whole texts, the end among them."""
    return texts.select(F.col("text").cast("string")).mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """The head of the counts and the network's vocabulary: the end (0), the unknown word (1), then words by falling count, in classes of about equal sums of square roots of counts."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, kinds: int, size: int = WORDS):
        self.count = dict(head)
        self.z = total + SMOOTH * (kinds + 1)
        vocabulary = [w for w, _ in head if w != END][: size - 2]
        known = sum(self.count.get(w, 0) + SMOOTH for w in (END, *vocabulary) if w in self.count)
        self.rest = max(self.z - known, SMOOTH)  # what the unknown word shares out
        unknown = max(total - sum(self.count.get(w, 0) for w in (END, *vocabulary)), 1)
        self.id = {END: 0} | {w: i + 2 for i, w in enumerate(vocabulary)}
        self.size = len(vocabulary) + 2
        root = np.sqrt([self.count.get(END, 0) + 1.0, unknown, *(self.count[w] for w in vocabulary)])
        self.cls = (np.cumsum(root) - root) * min(CLASSES, self.size) // root.sum()
        self.cls = np.unique(self.cls, return_inverse=True)[1].astype(np.uint8)
        self.bounds = np.searchsorted(self.cls, np.arange(int(self.cls[-1]) + 2))

    def bare(self) -> Lexicon:
        """Without the words, which the network's tasks need not read."""
        out = copy(self)
        out.count, out.id = {}, {}
        return out


def shapes(lex: Lexicon) -> dict[str, tuple[int, ...]]:
    """Each row of wc and ww ends with its bias."""
    classes = len(lex.bounds) - 1
    return {"embed": (lex.size + 1, EMBED), "wx": (EMBED, 3 * STATE), "wh": (STATE, 3 * STATE), "b": (3 * STATE,), "wc": (classes, STATE + 1), "ww": (lex.size, STATE + 1)}


def fresh_parameters(lex: Lexicon) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    p = {k: (rng.standard_normal(s) * 0.2 * (len(s) > 1)).astype(np.float32) for k, s in shapes(lex).items()}
    p["wc"][:, -1] = p["ww"][:, -1] = 0
    return p


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def _shaped(flat: np.ndarray, lex: Lexicon) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(lex).items():
        n = int(np.prod(s))
        out[k], at = flat[at : at + n].astype(np.float32).reshape(s), at + n
    return out


class Lanes:
    """Documents (arrays of ids) side by side: each lane is a row of whole documents, the longest lane first. Nothing is filled up, so a long document costs no more than its own tokens."""

    def __init__(self, docs: list[np.ndarray], edge: int, most: int = LANES):
        sizes = np.array([len(d) for d in docs])
        heap, dealt = [(0, k) for k in range(min(most, len(docs)))], [[] for _ in range(min(most, len(docs)))]
        for i in np.argsort(-sizes, kind="stable").tolist():
            size, k = heap[0]
            heapq.heapreplace(heap, (size + int(sizes[i]), k))
            dealt[k].append(i)
        dealt.sort(key=lambda own: -sizes[own].sum())
        order = [i for own in dealt for i in own]
        self.lengths = np.array([sizes[own].sum() for own in dealt])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = np.concatenate([docs[i] for i in order]).astype(np.int32)
        self.owner = np.repeat(order, sizes[order])
        self.first = np.zeros(len(self.ids), bool)
        self.first[np.cumsum(sizes[order]) - sizes[order]] = True
        self.before = np.concatenate([[edge], self.ids[:-1]]).astype(np.int32)
        self.before[self.first] = edge  # the input before a first token

    def windows(self, least: int, most: int):
        """(places in ids, whether there is one) by (step, lane), lanes that have ended left out; one window after the other. The fewer lanes are left the more steps a window has, from least to most."""
        a, end = 0, int(self.lengths[0])
        while a < end:
            live = int((self.lengths > a).sum())
            steps = min(max(LANES * least // live, least), most, end - a)
            at = np.arange(a, a + steps)[:, None]
            yield self.starts[:live] + np.minimum(at, self.lengths[:live] - 1), at < self.lengths[:live]
            a += steps


class Network:
    """Arrays within a window are (step, unit, lane), so that every gate is one stretch of memory."""

    def __init__(self, lex: Lexicon, p: dict[str, np.ndarray]):
        self.lex, self.p = lex, {k: v.copy() for k, v in p.items()}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.updates, self.held, self.held_count = 0, {}, 0

    def _states(self, before: np.ndarray, first: np.ndarray, h: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """The state after each input of a window (step, lane). A trace gets what the way back needs. Half arguments turn the sigmoids into tanh."""
        p, n, (steps, lanes) = self.p, STATE, before.shape
        half = np.repeat(np.array([0.5, 0.5, 1], p["b"].dtype), n)
        gates = np.ascontiguousarray((((p["embed"] @ p["wx"] + p["b"]) * half)[before]).transpose(0, 2, 1))
        wh = np.ascontiguousarray((p["wh"] * half).T)
        out = np.empty((steps, n, lanes), gates.dtype)
        kept = 1 if trace is None else steps
        was, hu, cs = (np.empty((kept, size, lanes), gates.dtype) for size in (n, 3 * n, n))
        for t, new in enumerate(first.any(axis=1).tolist()):
            k = t % kept
            np.copyto(was[k], h)
            if new:
                was[k][:, first[t]] = 0
            u, c, g = np.matmul(wh, was[k], out=hu[k]), cs[k], gates[t]
            zr = u[: 2 * n]
            zr += g[: 2 * n]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[n:], u[2 * n :], out=c)
            c += g[2 * n :]
            np.tanh(c, out=c)
            h = np.subtract(was[k], c, out=out[t])
            h *= zr[:n]
            h += c
        if trace is not None:
            trace |= {"h": was, "hu": hu, "c": cs, "first": first}
        return out

    @staticmethod
    def _choice(x: np.ndarray, w: np.ndarray, at: np.ndarray, back: np.ndarray | None, dw: np.ndarray | None) -> np.ndarray:
        """Log probability of each choice (a row of w); x ends with a 1. What its negative sum sends back is added to back and dw."""
        out = np.empty(len(x), x.dtype)
        wide = np.abs(w).sum(axis=1).max() > 80  # states lie within -1 and 1: else no exponential overflows
        for a in range(0, len(x), ROWS):  # a block of logits stays in the cache
            part, wt = x[a : a + ROWS], np.ascontiguousarray(w.T)
            e = part @ wt
            if wide:
                e -= e.max(axis=1, keepdims=True)
            one = np.arange(len(part)) * len(w) + at[a : a + ROWS]
            chosen = e.ravel()[one]
            np.exp(e, out=e)
            sums = e @ np.ones(len(w), w.dtype)
            out[a : a + ROWS] = chosen - np.log(sums)
            if back is not None:
                e.ravel()[one] -= sums
                scale = 1 / sums[:, None]
                back[a : a + ROWS] += (e @ w[:, :-1]) * scale
                dw += e.T @ (part * scale)
        return out

    def _output(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target; with grads, also what its negative sum sends back to the states."""
        p, lex = self.p, self.lex
        order = np.argsort(cls := lex.cls[target], kind="stable")
        x = np.ones((len(h), STATE + 1), h.dtype)
        x[:, :-1], target, cls = h[order], target[order], cls[order]
        ends = np.searchsorted(cls, np.arange(len(lex.bounds)))
        back = dc = None
        if grads is not None:
            back = np.zeros((len(h), STATE), h.dtype)
            grads |= {"wc": np.zeros_like(p["wc"]), "ww": np.zeros_like(p["ww"])}
            dc = grads["wc"]
        logp = self._choice(x, p["wc"], cls, back, dc)
        for k in np.flatnonzero(np.diff(ends)).tolist():
            (lo, hi), own = lex.bounds[k : k + 2].tolist(), slice(ends[k], ends[k + 1])
            if hi - lo > 1:
                logp[own] += self._choice(x[own], p["ww"][lo:hi], target[own] - lo, None if back is None else back[own], None if back is None else grads["ww"][lo:hi])
        out = np.empty_like(logp)
        out[order] = logp
        if back is None:
            return out, None
        sent = np.empty_like(back)
        sent[order] = back
        return out, sent

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document (an array of ids)."""
        out = np.zeros(len(docs))
        if docs:
            lanes, h = Lanes(docs, self.lex.size), None
            for at, there in lanes.windows(*SCORE_STEPS):
                h = np.zeros((STATE, at.shape[1]), self.p["b"].dtype) if h is None else h[:, : at.shape[1]]
                states = self._states(lanes.before[at], lanes.first[at] & there, h)
                h, there = states[-1], there.ravel()
                at, states = at.ravel()[there], states.transpose(0, 2, 1).reshape(-1, STATE)[there]
                logp, _ = self._output(states, lanes.ids[at])
                out += np.bincount(lanes.owner[at], logp.astype(np.float64), len(docs))
        return out

    def train(self, docs: list[np.ndarray], rate: float) -> int:
        """One pass of truncated backpropagation over the documents; the number of tokens."""
        lanes, tokens, h, n, p = Lanes(docs, self.lex.size), 0, None, STATE, self.p
        for at, there in lanes.windows(*STEPS):
            h = np.zeros((n, at.shape[1]), p["b"].dtype) if h is None else h[:, : at.shape[1]]
            trace: dict[str, np.ndarray] = {}
            before = lanes.before[at]
            states = self._states(before, lanes.first[at] & there, h, trace)
            h, flat_there = states[-1].copy(), there.ravel()
            g: dict[str, np.ndarray] = {}
            back = np.zeros((at.size, n), states.dtype)
            back[flat_there] = self._output(states.transpose(0, 2, 1).reshape(-1, n)[flat_there], lanes.ids[at.ravel()[flat_there]], g)[1]
            self._way_back(trace, before, np.ascontiguousarray(back.reshape(*at.shape, n).transpose(0, 2, 1)), g)
            tokens += (count := int(there.sum()))
            self._hold(g, count, rate)
        self._hold({}, 0, rate, last=True)
        return tokens

    def _way_back(self, trace: dict, before: np.ndarray, back: np.ndarray, g: dict[str, np.ndarray]) -> None:
        """Gradients of the recurrent part over one window."""
        p, n = self.p, STATE
        first = trace["first"]
        into = np.empty_like(trace["hu"])  # gradients of the gates
        through = np.empty_like(into)  # and of what the state gives them
        dh = np.zeros_like(back[0])
        new = first.any(axis=1).tolist()
        for t in range(len(before) - 1, -1, -1):
            was, c, (z, r, u), own, sent = trace["h"][t], trace["c"][t], trace["hu"][t].reshape(3, n, -1), into[t], through[t]
            dh += back[t]
            dz = np.multiply(dh, z, out=own[:n])  # dh z; also what goes straight on
            dc = np.subtract(dh, dz, out=own[2 * n :])
            dh, keep = dz.copy(), dh
            dc *= 1 - c * c
            dz *= 1 - z
            dz *= was - c
            dr = np.multiply(dc, r, out=sent[2 * n :])
            dr = np.multiply(dr, u, out=own[n : 2 * n])
            dr *= 1 - r
            sent[: 2 * n] = own[: 2 * n]
            dh += np.matmul(p["wh"], sent, out=keep)
            if new[t]:
                dh[:, first[t]] = 0
        was = trace["h"]
        g["wh"] = np.matmul(was, through.transpose(0, 2, 1)).sum(axis=0)
        ids = before.ravel()
        by = np.argsort(ids.astype(np.uint16), kind="stable")
        heads = np.flatnonzero(np.diff(ids[by], prepend=-1))
        inputs = ids[by[heads]]
        summed = np.add.reduceat(into.transpose(0, 2, 1).reshape(-1, 3 * n)[by], heads, axis=0)
        g["b"] = summed.sum(axis=0)
        g["wx"] = p["embed"][inputs].T @ summed
        g["embed"] = np.zeros_like(p["embed"])
        g["embed"][inputs] = summed @ p["wx"].T

    def _hold(self, g: dict[str, np.ndarray], count: int, rate: float, last: bool = False) -> None:
        """Gradients of windows with few tokens are added up before an update."""
        if self.held:
            for k, x in g.items():
                self.held[k] += x
        else:
            self.held = g
        self.held_count += count
        if self.held_count >= (1 if last else UPDATE):
            self._update(self.held, self.held_count, rate)
            self.held, self.held_count = {}, 0

    def _update(self, g: dict[str, np.ndarray], count: int, rate: float) -> None:
        """Adam on the mean gradient."""
        self.updates += 1
        scale = rate * np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates)
        for k, x in g.items():
            x = np.clip(x / count, -1, 1)
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def _groups(rows: Iterator, tokens: int = GROUP) -> Iterator[list]:
    """Lists of rows (..., ids) of so many tokens at least but for the last, whatever batches they came in."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[-1])
        if n >= tokens:
            yield held
            held, n = [], 0
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for *own, ids in zip(*(c.to_pylist() for c in b.columns)):
            yield *own, np.frombuffer(ids, np.uint16)


def _train(lex: Lexicon, start: np.ndarray, passes: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(_rows(batches), lambda row: row[0]):
            net, tokens = Network(lex, _shaped(start, lex)), 0
            for group in _groups(own):
                for _ in range(passes):
                    tokens += net.train([ids for *_, ids in group], rate)
            flat = _flat(net.p).astype(np.float64) * tokens
            parts = [flat[a : a + SLICE].tobytes() for a in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(tokens)] * len(parts)), pa.array(parts, pa.binary())], ["slice", "tokens", "sums"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, tokens, sums) added up by slice; a task holds its own slices' sums alone."""
    tokens: Counter = Counter()
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, n, x in zip(*(c.to_pylist() for c in b.columns)):
            tokens[k] += n
            sums[k] = sums.get(k, 0) + np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([tokens[k] for k in sums], pa.float64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "tokens", "sums"])


def _trained(rows: DataFrame, shards: int, lex: Lexicon, start: np.ndarray, passes: int, rate: float) -> np.ndarray:
    """The parameters that the shards of rows (h, ids) reach from start, averaged by tokens; start itself if there are no rows. Rows are dealt and ordered by their hash h, so neither the split of the input nor the size of batches plays a part, nor into how many tasks Spark deals the shards: a task trains each of its shards by itself. The driver gets one row a slice."""
    kind = "slice int, tokens double, sums binary"
    dealt = rows.select(F.pmod(F.hash("h"), F.lit(shards)).alias("shard"), "h", "ids")
    dealt = dealt.repartition(4 * shards, "shard").sortWithinPartitions("shard", "h", "ids")  # more tasks than shards: few tasks get two
    made = dealt.mapInArrow(_train(lex.bare(), start, passes, rate), kind)
    sums = made.repartition("slice").mapInArrow(_summed, kind).collect()
    return np.concatenate([np.frombuffer(r["sums"]) / r["tokens"] for r in sorted(sums)]).astype(np.float32) if sums else start


TOKENISED = "row long, doc_id long, held_out boolean, learn boolean, h long, n_tokens long, known long, base double, share double, tail array<struct<word:binary,n:long>>, ids binary"


def _tokenise(lex: Lexicon):
    """What the head of the counts says of each text, its words of the tail, and the network's ids of its tokens, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        head = pa.array(list(lex.count), pa.binary())
        logs = np.log10(np.array(list(lex.count.values()), float) + SMOOTH)
        code = np.array([1, *(lex.id.get(w, 1) for w in lex.count)], np.uint16)
        value = np.concatenate([[[0.0, 0.0]], np.stack([logs - np.log10(lex.z), np.where(code[1:] == 1, logs - np.log10(lex.rest), 0.0)], axis=1)])
        last = pc.fill_null(pc.index_in(pa.array([END], pa.binary()), value_set=head), -1)[0].as_py() + 1
        for b, found, ends in _pieces(batches):
            places = pc.fill_null(pc.index_in(found, value_set=head), -1).to_numpy() + 1  # 0: in the tail
            at = np.insert(places, ends, last)
            stops = ends + np.arange(1, len(b) + 1)
            starts = np.concatenate([[0], stops[:-1]])
            sums = np.add.reduceat(value[at], starts, axis=0)
            known = np.add.reduceat(at > 0, starts, dtype=np.int64)
            # each row's different words of the tail, the end among them if nothing was learned
            rare = pc.filter(found, pa.array(places == 0)).dictionary_encode()
            owner = np.searchsorted(ends, np.flatnonzero(places == 0), side="right")
            kinds, codes = rare.dictionary, rare.indices.to_numpy()
            if not last:
                kinds, codes, owner = pa.concat_arrays([kinds, pa.array([END], pa.binary())]), np.append(codes, np.full(len(b), len(kinds))), np.append(owner, np.arange(len(b)))
            pairs, times = np.unique(owner.astype(np.int64) << 32 | codes, return_counts=True)
            cuts = np.searchsorted(pairs >> 32, np.arange(len(b) + 1))
            tails = pa.StructArray.from_arrays([kinds.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(times, pa.int64())], ["word", "n"])
            tail = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), tails)
            ids = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.concatenate([[0], 2 * stops]).astype(np.int32)), pa.py_buffer(code[at])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(b))), *(b.column(c) for c in ("doc_id", "held_out", "learn", "h")), pa.array(stops - starts, pa.int64()), pa.array(known), pa.array(sums[:, 0]), pa.array(sums[:, 1]), tail, ids],
                ["row", "doc_id", "held_out", "learn", "h", "n_tokens", "known", "base", "share", "tail", "ids"],
            )
            row += len(b)

    return run


def _score(lex: Lexicon, parameters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(lex, _shaped(parameters, lex))
        for group in _groups(_rows(batches)):
            logp = net.score([ids for *_, ids in group]) / np.log(10)
            columns = list(zip(*group))[:-1]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array(logp)], [x.split()[0] for x in SCORED.split(", ")])

    return run


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, share double, network double"


def score(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Documents whose crc32(doc_id) mod folds is held are not learned from."""
    learn = F.coalesce(fold(F.col("doc_id"), folds) != held, F.lit(False))
    text = F.col("text").cast("string")
    counted = shared_table(counts(docs.where(learn).select(text.alias("text"))), "lm-counts")
    total, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counted.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.col("word") == END, F.desc("c"), "word").limit(HEAD - 1)
    head = [(bytes(r[0]), r[1]) for r in head.unionByName(counted.where(F.col("word") == END)).distinct().collect()]
    lex = Lexicon(sorted(head, key=lambda x: (-x[1], x[0])), total, kinds)

    rows = docs.select(
        F.col("doc_id").cast("long"), (~learn & F.col("doc_id").isNotNull()).alias("held_out"), learn.alias("learn"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"), text.alias("text")
    )
    made = shared_table(rows.mapInArrow(_tokenise(lex), TOKENISED), "lm-tokens")
    train = made.where("learn")
    least = train.select("h").orderBy("h").limit(WARM).agg(F.max("h")).first()[0]  # hashes alone are sorted
    parameters = _trained(train.where(F.col("h") <= F.lit(least)), 1, lex, _flat(fresh_parameters(lex)), WARM_PASSES, WARM_RATE)
    shards = -(-total // (ROUNDS * SHARD)) or 1
    for i in range(ROUNDS):
        parameters = _trained(train.where(F.pmod("h", F.lit(ROUNDS)) == i), shards, lex, parameters, 1, RATE)

    tail = made.where(F.size("tail") > 0).select("row", F.explode("tail").alias("t")).select("row", "t.*")
    seen = tail.join(counted, "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    logs = F.log10(F.col("c") + SMOOTH)
    sums = seen.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * (logs - float(np.log10(lex.z)))).alias("tail_base"),
        F.sum(F.col("n") * (logs - float(np.log10(lex.rest)))).alias("tail_share"),
    )
    zero, known = F.lit(0.0), [x.split()[0] for x in SCORED.split(", ")][:-1]
    scored = made.select(*known, "ids").mapInArrow(_score(lex.bare(), parameters), SCORED)
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"), (F.col("network") + F.col("share") + F.coalesce("tail_share", zero)).alias("score"),
    )
