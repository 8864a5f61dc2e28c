"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits.

Links are found by pigeonhole: the 64 bits are cut into six blocks, so two fingerprints that differ in at most three bits agree on three whole blocks. Each distinct fingerprint is dealt once for each of the 20 choices of three blocks, fingerprints that share such a key meet in one sorted run, and a run yields only the edges of a spanning forest of its links, each checked by Hamming distance. A run longer than LIMIT is not compared but dealt again by finer keys (three of six blocks of the bits that are left, then one of four), so no bucket is compared whole beyond that size and no link is lost.

Defined results: null and empty texts have no words and the fingerprint zero, which links like any other. Fewer than three words make one shingle. Equal texts have equal fingerprints and one component. A null doc_id counts as larger than any other; a component of such rows alone has a null id. An empty table gives an empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.llm.exact_dedup import own_hash
from echolith.llm.shared import connected_components, shared_table, values

#: Words in a shingle; seed of the hash; most differing bits of a link.
WORDS, SEED, DISTANCE = 3, 42, 3
#: Longest run of fingerprints with one key that is compared directly.
LIMIT = 2048
#: Shingles hashed at a time, which bounds memory for long texts.
AT_ONCE = 1 << 14
#: For near copies in general: words in a shingle, fingerprint longs, and the least Jaccard similarity of two texts' sets of shingles that links them.
WIDE_WORDS, LONGS, SIMILAR = 5, 4, 0.8
#: Most differing bits (of 256) of a candidate. At SIMILAR 0.1515 of the bits differ on average (39), up to 0.19 (48) between very short texts.
WIDE_DISTANCE = 64
#: Blocks of bits by which fingerprints meet: of BLOCK_BITS bits, and one more for each doubling from RUN * 2**BLOCK_BITS fingerprints on, so that a run stays near RUN fingerprints; as many blocks as leave a pair that differs in DIFFERING of its bits apart with a chance of at most MISS.
BLOCK_BITS, RUN, DIFFERING, MISS = 16, 256, 0.1515, 0.0005
#: Longs of an odd sketch: the parity of a set's shingles in each of so many times 64 slots.
SKETCH_LONGS = 8
#: Fingerprints of a group of candidates from which on its blocks after the first split yield no further pairs within it.
LARGE = 64
#: Rows up to so far apart in a run are compared at once, to find the runs that hold candidates.
NEAR_ROWS = 1024


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text: a bit is set if more than half of the shingle hashes have it."""
    return int(wide_fingerprint(text, words, 1)[0])


def _mixed(h: np.ndarray, longs: int) -> np.ndarray:
    """Each hash and further ones mixed from it, side by side."""
    out = [h]
    for i in range(1, longs):
        x = h + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def _shingles(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, AT_ONCE at a time."""
    tokens = (text or "").encode().lower().split()  # on bytes: only A-Z, only the blanks of ASCII
    if not tokens:
        return
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    for first in range(0, n, AT_ONCE):
        yield np.fromiter((digest(joined[a:b], SEED) for (a, b), _ in zip(spans, range(min(AT_ONCE, n - first)))), np.uint64)


def _voted(parts: Iterator[np.ndarray], longs: int) -> np.ndarray:
    counts, n = np.zeros(64 * longs, np.int64), 0
    for h in parts:
        counts += np.unpackbits(_mixed(h, longs).view(np.uint8).reshape(-1, 8 * longs), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def wide_fingerprint(text: str | None, words: int, longs: int) -> np.ndarray:
    """The SimHash of a text in so many unsigned longs, of which the first is that of fingerprint()."""
    return _voted(_shingles(text, words), longs)


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles of WIDE_WORDS words, each once, in rising order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, WIDE_WORDS)]))


def set_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in LONGS longs: repeats within a text don't count, as they don't in the similarity."""
    return _voted((shingles[a : a + AT_ONCE] for a in range(0, len(shingles), AT_ONCE)), LONGS)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """A set's size and odd sketch, as longs. Each slot in which two sketches differ holds at least one shingle that only one of the sets has."""
    slots = np.bincount((shingles % np.uint64(64 * SKETCH_LONGS)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.concatenate([np.array([len(shingles)], np.int64), np.packbits(slots.astype(np.uint8), bitorder="little").view(np.int64)])


def may_be_similar(sketches: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of the sketched sets can have a Jaccard similarity of SIMILAR with own: never false for one that has it."""
    total, differ = sketches[:, 0] + own[0], np.bitwise_count((sketches[:, 1:] ^ own[1:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return total - differ >= SIMILAR * (total + differ)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in values(b.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the unsigned fingerprint's bits as a long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _blocks(mask: int, count: int) -> list[int]:
    """The set bits of mask, cut into so many blocks of nearly equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(bits), count)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_masks() -> list[list[list[int]]]:
    """For each level and each mask of the level before (by number): the masks that extend it. A pair within DISTANCE agrees on one of them if it agrees on the mask before."""
    levels, before = [], [0]
    for count, agree in ((6, 3), (6, 3), (4, 1)):
        levels.append([[m | sum(c) for c in combinations(_blocks(~m & (1 << 64) - 1, count), agree)] for m in before])
        before = [m for ms in levels[-1] for m in ms]
    return levels


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each fingerprint to the first one of its component among prints (distinct)."""
    if len(prints) == 2:
        return [(int(prints[1]), int(prints[0]))] if int(prints[0] ^ prints[1]).bit_count() <= DISTANCE else []
    left, edges = prints, []
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= DISTANCE
            if near.any():
                front += list(left[near])
                edges += [(int(x), int(root)) for x in left[near]]
                left = left[~near]
    return edges


def _runs(limit: int | None):
    """From rows (id, key, fp) sorted by key: edges of each run, and the rows themselves of runs longer than limit. At most limit rows and a batch are held."""

    def made(edges: list[tuple[int, int]], hot: list[np.ndarray]) -> pa.RecordBatch:
        e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        h = np.concatenate(hot) if hot else np.zeros((0, 3), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([False, True], [len(e), len(h)])), *(pa.array(np.concatenate([x, y])) for x, y in zip((e[:, 0], e[:, 1], np.zeros(len(e), np.int64)), (h[:, 2], h[:, 1], h[:, 0])))],
            ["hot", "a", "b", "id"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, hot_key = np.zeros((0, 3), np.int64), None
        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            edges, hot = [], []
            if hot_key is not None:  # the run that was too long goes on
                more = int(np.argmax(rows[:, 1] != hot_key)) if (rows[:, 1] != hot_key).any() else len(rows)
                hot, rows, hot_key = [rows[:more]], rows[more:], hot_key if more == len(rows) else None
            rows = np.concatenate([kept, rows])
            cuts = np.flatnonzero(rows[1:, 1] != rows[:-1, 1]) + 1 if len(rows) else np.zeros(0, np.int64)
            bounds = np.concatenate([[0], cuts])
            for first, end in zip(bounds[:-1][np.diff(bounds) > 1].tolist(), bounds[1:][np.diff(bounds) > 1].tolist()):
                if limit and end - first > limit:
                    hot.append(rows[first:end])
                else:
                    edges += _forest(np.ascontiguousarray(rows[first:end, 2]).view(np.uint64))
            kept = rows[bounds[-1] :] if len(rows) else rows
            if limit and len(kept) > limit:
                hot, hot_key, kept = [*hot, kept], int(kept[0, 1]), kept[:0]
            yield made(edges, hot)
        yield made(_forest(np.ascontiguousarray(kept[:, 2]).view(np.uint64)) if len(kept) > 1 else [], [])

    return run


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that have the same components as all links within DISTANCE."""
    rows, edges = prints.select(F.lit(0).alias("id"), F.lit(0).cast("long").alias("key"), "fp"), []
    for level, masks in enumerate(key_masks()):
        width = len(masks[0])
        table = F.array(*(F.array(*(F.lit(_signed(m)) for m in ms)) for ms in masks))
        own = F.element_at(table, F.col("id") + 1) if level else table[0]
        dealt = rows.select("id", "key", "fp", F.posexplode(own).alias("i", "m")).select(
            (F.col("id") * width + F.col("i")).cast("long").alias("id"), F.xxhash64("key", "i", F.col("m").bitwiseAND(F.col("fp"))).alias("key"), "fp"
        )
        last = level == 2
        found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(None if last else LIMIT), "hot boolean, a long, b long, id long")
        found = shared_table(found, f"links-{level}")
        edges.append(found.where("not hot").select("a", "b"))
        hot = found.where("hot")
        if last or hot.isEmpty():
            break
        rows = hot.select(F.col("id").cast("int"), F.col("b").alias("key"), F.col("a").alias("fp"))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    marked = shared_table(fingerprints(docs), "fingerprints")
    prints = shared_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")  # copies count once
    roots = connected_components(links(prints))
    linked = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = linked.where("root <> fp").groupBy("root").agg(F.min("least").alias("other"))
    own = prints.select(F.col("fp").alias("root"), F.col("least").alias("own"))
    ids = shared_table(own.join(ids, "root", "left").select("root", F.coalesce(F.least("own", "other"), "own").alias("component_id")), "component-ids")
    ids = shared_table(linked.join(ids, "root").select("fp", "component_id"), "components")
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def block_bits(prints: int = 0) -> np.ndarray:
    """The bits of each block for so many fingerprints: fixed shuffles of all bits, each cut into blocks."""
    rng, total = np.random.default_rng(SEED), 64 * LONGS
    size = min(max(BLOCK_BITS, ceil(log2(max(prints, 1) / RUN))), 40)
    count = ceil(log(MISS) / log(1 - (1 - DIFFERING) ** size))
    splits = [rng.permutation(total)[: total // size * size].reshape(-1, size) for _ in range(-(-count // (total // size)))]
    return np.concatenate(splits)


def _wide_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [set_fingerprint(shingle_set(t)).tobytes() for t in values(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("own"), pa.array(prints, pa.binary())], ["doc_id", "own", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, len(whole), 100):
            sets = [shingle_set(t) for t in whole.slice(first, 100).column("text").to_pylist()]
            prints = [set_fingerprint(x).tobytes() for x in sets]
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["fp", "shingles"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [(set_fingerprint(x).tobytes(), odd_sketch(x).tobytes()) for x in map(shingle_set, values(b.column("text")))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.binary()) for i in (0, 1)], ["fp", "sketch"])


_PRINT = [f"f{i}" for i in range(LONGS)]
_SKETCH = ["size", *(f"s{i}" for i in range(SKETCH_LONGS))]


def _deal(bits: np.ndarray):
    """A row (key, id, label, f0, ...) for each block of each fingerprint, with its sketch if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits.shape[1], dtype=np.int64)
        for whole in batches:
            for first in range(0, len(whole), 1000):
                b = whole.slice(first, 1000)
                prints = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(len(b), 8 * LONGS)
                own = np.unpackbits(prints, axis=1, bitorder="little")
                keys = np.stack([own[:, block].astype(np.int64) @ weights + (i << bits.shape[1]) for i, block in enumerate(bits)], axis=1)
                parts, names = [b.column("id").to_numpy(), b.column("label").to_numpy(), prints.view(np.int64)], ["id", "label", *_PRINT]
                if "sketch" in b.schema.names:
                    parts.append(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.int64).reshape(len(b), -1))
                    names += _SKETCH
                rest = np.repeat(np.column_stack(parts), len(bits), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.ascontiguousarray(c)) for c in rest.T)], ["key", *names])

    return run


def _forest_edges(ids: np.ndarray, labels: np.ndarray, prints: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a run's candidates, each fingerprint with one that it is near to, less what labels (those of one are joined already) or the run's other edges join."""
    over: dict[int, int] = {}  # from a label to one that it is joined to

    def top(x: int) -> int:
        while x in over:
            x = over[x]
        return x

    while len(ids) > 1:
        front, ids, labels, prints = [(ids[0], labels[0], prints[0])], ids[1:], labels[1:], prints[1:]
        while front and len(ids):
            i, label, own = front.pop()
            near = np.bitwise_count(prints ^ own).sum(axis=1) <= WIDE_DISTANCE
            if near.any():
                front += list(zip(ids[near], labels[near], prints[near]))
                mine = top(int(label))
                for x, other in zip(ids[near].tolist(), labels[near].tolist()):
                    if (other := top(other)) != mine:
                        over[other] = mine
                        yield x, int(i)
                ids, labels, prints = ids[~near], labels[~near], prints[~near]


def _all_edges(ids: np.ndarray, labels: np.ndarray, prints: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """All of a run's candidates between different labels whose sketches don't rule them out."""
    for k in range(len(ids) - 1):
        near = k + 1 + np.flatnonzero((np.bitwise_count(prints[k + 1 :] ^ prints[k]).sum(axis=1) <= WIDE_DISTANCE) & (labels[k + 1 :] != labels[k]))
        yield from ((int(x), int(ids[k])) for x in ids[near[may_be_similar(sketches[near], sketches[k])]])


def _with_candidates(keys: np.ndarray, labels: np.ndarray, prints: np.ndarray) -> set[int]:
    """Keys of the runs that hold a candidate between different labels, or are too long to tell at once."""
    left, found = np.flatnonzero(keys[1:] == keys[:-1]), []
    for k in range(1, NEAR_ROWS + 1):
        apart = left[labels[left] != labels[left + k]]
        near = np.bitwise_count(prints[apart] ^ prints[apart + k]).sum(axis=1) <= WIDE_DISTANCE
        found.append(keys[apart[near]])
        left = left[left + k + 1 < len(keys)]
        left = left[keys[left] == keys[left + k + 1]]
        if not len(left):
            break
    return set(np.concatenate([*found, keys[left]]).tolist())


def _wide_runs(edges_of, columns: int):
    """From rows (key, id, label, f0, ..., sketch) sorted by key: candidates (a, b) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, columns), np.int64)
        for b in _ended(batches):
            edges: list[tuple[int, int]] = []
            if b is not None:
                held = np.concatenate([held, np.column_stack([c.to_numpy() for c in b.columns])])
            cut = len(held) if b is None or not len(held) else int(np.searchsorted(held[:, 0], held[-1, 0]))
            done, held = held[:cut], held[cut:]
            keys, labels, prints, sketches = done[:, 0].copy(), done[:, 2].copy(), done[:, 3 : 3 + LONGS].copy().view(np.uint64), done[:, 3 + LONGS :]
            for key in sorted(_with_candidates(keys, labels, prints)):
                own = slice(*np.searchsorted(keys, [key, key + 1]))
                edges += edges_of(done[own, 1], labels[own], prints[own], sketches[own])
            e = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _candidates(prints: DataFrame, edges_of, name: str, bits: np.ndarray) -> DataFrame:
    """Distinct pairs (a, b) of rows (id, label, fp, and sketch if edges_of asks for it) that share a block and lie within WIDE_DISTANCE."""
    columns = ["key", "id", "label", *_PRINT, *(_SKETCH if "sketch" in prints.columns else [])]
    dealt = prints.mapInArrow(_deal(bits), ", ".join(f"{c} long" for c in columns))
    pairs = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_runs(edges_of, len(columns)), "a long, b long")
    return shared_table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)


def _texts(some: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of the rows with the doc_ids (least) of some fingerprints."""
    asked = some.select("least").distinct()
    return rows.join(asked, rows["doc_id"].eqNullSafe(asked["least"]), "left_semi").select("text")


def _verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The pairs whose texts' sets of shingles have a Jaccard similarity of SIMILAR at least. A set is made only for texts in pairs."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    some = shared_table(prints.join(ids, "id", "left_semi").select("id", "fp", "least"), f"{name}-some")
    made = _texts(some, rows).mapInArrow(_sets, "fp binary, shingles array<long>")
    sets = shared_table(made.join(some.select("id", "fp"), "fp").dropDuplicates(["id"]).select("id", "shingles"), f"{name}-sets")
    a, b = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    n_a, n_b, both = F.size("set_a"), F.size("set_b"), F.size(F.array_intersect("set_a", "set_b"))
    return shared_table(pairs.join(a, "a").join(b, "b").select("a", "b", (both >= SIMILAR * (n_a + n_b - both)).alias("similar")), name).where("similar").select("a", "b")


def _labelled(prints: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """prints with the component of each id over edges as a column."""
    return prints.drop(label).join(connected_components(edges).select(F.col("node").alias("id"), F.col("root").alias(label)), "id", "left").withColumn(label, F.coalesce(label, "id"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, own) for every row, own the hash of all its columns, and (fp, root): the group of each fingerprint.

    Wide fingerprints only find candidates: they are split into blocks several times over, and those that share a block meet in one sorted run, which yields a spanning forest of its candidates. The first split's candidates are joined into groups before the other splits are dealt, whose runs yield nothing within a group of LARGE or more: its pairs grow with its size times the blocks of one split. These are verified by the sets themselves. A group of candidates that verified links don't join whole is dealt once more, and there all candidates between different components are verified, but for those that odd sketches of their sets rule out: the sketches' differing bits are a lower bound of the shingles that the sets don't share, so no pair at SIMILAR goes, and in a large group in which most texts lie just under SIMILAR few pairs are left. A pair at SIMILAR becomes a candidate with probability over 0.999, between very short texts 0.97. A run is held by one task (56 bytes a distinct fingerprint); blocks get longer as fingerprints get more, so that runs don't.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), own_hash(docs).alias("own"))
    marked = shared_table(rows.mapInArrow(_wide_fingerprints, "doc_id long, own long, fp binary"), "wide")
    prints = shared_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "wide-prints")
    bits = block_bits(prints.count())
    whole = 64 * LONGS // bits.shape[1]  # blocks that hold every bit once
    first = _candidates(prints.select("id", F.col("id").alias("label"), "fp"), _forest_edges, "wide-first", bits[:whole])
    met = shared_table(_labelled(prints.select("id", "fp"), first, "label"), "wide-met")
    large = met.groupBy("label").count().where(F.col("count") >= LARGE).select("label", F.lit(True).alias("large"))
    met = met.join(large, "label", "left").select("id", F.when(F.col("large"), F.col("label")).otherwise(F.col("id")).alias("label"), "fp")
    pairs = first.unionByName(_candidates(met, _forest_edges, "wide-pairs", bits[whole:])).distinct()
    links = _verified(pairs, prints, rows, "wide-links")
    groups = shared_table(_labelled(_labelled(prints, links, "label"), pairs, "wide_group"), "wide-groups")
    torn = groups.groupBy("wide_group").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("wide_group")
    again = shared_table(groups.join(torn, "wide_group", "left_semi").select("id", "label", "fp", "least"), "wide-again")
    sketches = _texts(again, rows).mapInArrow(_sketches, "fp binary, sketch binary").dropDuplicates(["fp"])
    again = shared_table(again.select("id", "label", "fp").join(sketches, "fp").select("id", "label", "fp", "sketch"), "wide-sketches")
    more = _verified(_candidates(again, _all_edges, "wide-more", bits), prints, rows, "wide-more-links")
    return marked, shared_table(_labelled(prints, links.unionByName(more), "root").select("fp", "root"), "wide-linked")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id) for every row: keep_id is the smallest doc_id of its group of near copies, linked where the sets of five-word shingles have a Jaccard similarity of SIMILAR or more. A null doc_id counts as larger than any other."""
    marked, linked = _grouped(docs)
    keep = linked.join(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp").groupBy("root").agg(F.min("least").alias("keep_id"))
    ids = shared_table(linked.join(keep, "root").select("fp", "keep_id"), "wide-keep")
    return marked.join(ids, "fp").select("doc_id", "keep_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, all columns kept: the one with the smallest doc_id (null last), then the least hash of all columns; of rows that are equal in all columns one."""
    marked, linked = _grouped(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")
    best = marked.groupBy("fp").agg(F.min(order).alias("best"), F.count("*").alias("rows"))
    best = shared_table(linked.join(best, "fp"), "wide-best")
    winners = best.groupBy("root").agg(F.min("best").alias("best"), F.sum("rows").alias("rows")).where("rows > 1")
    groups = shared_table(best.select("fp", "root").join(winners, "root").select("fp", F.col("best.own").alias("stays")), "wide-stays")
    in_groups = marked.join(groups, "fp")
    gone = in_groups.where("own <> stays").select("doc_id", "own").distinct()
    again = shared_table(in_groups.where("own = stays").groupBy("doc_id", "own").count().where("count > 1"), "wide-repeated")
    rows = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_own": own_hash(docs)})

    def same(other: DataFrame) -> Column:
        return rows["_id"].eqNullSafe(other["doc_id"]) & (rows["_own"] == other["own"])

    out = rows.join(gone, same(gone), "left_anti")
    if not again.isEmpty():  # rows that are equal in all columns
        out = out.join(again, same(again), "left_anti").unionByName(rows.join(again, same(again), "left_semi").dropDuplicates(["_id", "_own"]))
    return out.drop("_id", "_own")
