"""Hard negatives by one-dimensional distance keys: exact searches of the largest inner products.

Vectors become whole numbers and get one more coordinate, sqrt(M2 - |x|^2) with M2 the largest squared length, so that all end on one sphere; with a zero there for an anchor, the nearest vectors are those of the largest inner product. A few pivots are fitted on a bounded sample. Every vector is stored under the key (nearest pivot, distance to it), sorted, in cells of at most CELL rows that follow each other in that order. What lies within a radius R of an anchor has, for each pivot, a distance within R of the anchor's own: an interval of keys. A round scans, for each block of anchors with alike keys, the cells of its intervals that no earlier round has scanned (the annuli beyond the last radius); an anchor is done as soon as its last wanted row is nearer than its radius, which then bounds all that was not scanned, or nothing wanted can lie further out. Otherwise the radius grows to the last wanted row found, or doubles. So results are exact whatever the pivots, cells and radii are; they only decide how much is scanned.

Positives are searched first, then for all positives of an anchor together the negatives under each one's score. Cells and anchors meet in groups of one cell and at most BLOCKS blocks; a group holds no more, however many rows look alike.

Defined results: a row with a null vec_id or label, a null or empty vector, or an entry that is null, non-finite or of 2**17 or more in size takes no part, nor does one whose vector's length isn't the most frequent (of equally frequent ones the longest). Rows that repeat are rows of their own, told apart by their place in the index; equal scores go by vec_id. An anchor without positives, and a positive without negatives in the wanted interval (always so if its score is below zero), give no rows. An empty table gives an empty result. Columns other than vec_id, embedding and label play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolith.llm.shared import shared_table

#: x becomes floor(SCALE * x).
SCALE = 256
#: Every so manyth vec_id is an anchor; wanted positives and negatives; the share (of 100) of the positive's score that a negative has at least.
ANCHORS, POSITIVES, NEGATIVES, LEAST = 100, 5, 5, 80
#: Pivots, the rows (those with the least hash) that they are fitted on, and rounds of fitting.
PIVOTS, SAMPLE, FITTING = 64, 8192, 8
#: Most rows in a cell, anchors in a block, blocks that meet a cell in one group, and anchors whose scores are found at once.
CELL, BLOCK, BLOCKS, AT_ONCE = 4096, 256, 64, 256
#: The first search for negatives goes down to this share of the positive's score.
FIRST_SHARE = 0.95
_LARGE = 1 << 17


@dataclass(frozen=True)
class Pivots:
    """Pivots with their last coordinate, and the largest squared length of a vector."""

    at: np.ndarray
    longest: int

    def distances(self, x: np.ndarray, stored: bool) -> np.ndarray:
        """From each vector to each pivot; stored vectors have their last coordinate, anchors a zero there."""
        x = x.astype(float)
        last = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0)) * stored
        return np.sqrt(np.maximum(((np.column_stack([x, last])[:, None, :] - self.at[None]) ** 2).sum(axis=2), 0))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x, norm) of the rows that take part: whole numbers and their squared length."""
    fits = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < _LARGE))  # NaN is larger than any number
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fits & (F.size("embedding") > 0))
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("int")).alias("x"))
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (top["d"] if top else 0))
    return rows.withColumn("norm", F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v.cast("long")))


def fitted(sample: np.ndarray, longest: int, count: int = PIVOTS) -> Pivots:
    """Pivots by a few rounds of nearest centres over a sample, started evenly over the sample's rows."""
    full = np.column_stack([sample, np.sqrt(np.maximum(longest - (sample * sample).sum(axis=1), 0))])
    at = full[np.linspace(0, len(full) - 1, min(count, len(full))).astype(int)]
    for _ in range(FITTING):
        nearest = ((full * full).sum(1)[:, None] - 2 * full @ at.T + (at * at).sum(1)).argmin(axis=1)
        at = np.array([full[nearest == k].mean(axis=0) if (nearest == k).any() else at[k] for k in range(len(at))])
    return Pivots(at, longest)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _keyed(pivots: Pivots, stored: bool):
    """Rows with their pivot and the distance to it (for anchors: to all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 1000):
                b = whole.slice(first, 1000)
                d = pivots.distances(_vectors(b.column("x")), stored)
                nearest = d.argmin(axis=1)
                more = [pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])]
                names = [*b.schema.names, "pivot", "distance"]
                if not stored:
                    more.append(pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel())))
                    names.append("distances")
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names)

    return run


def _numbered(rows: DataFrame, size: int, name: str) -> DataFrame:
    """rows in order of (pivot, distance), with place, unique, and group: runs of that order of at most size rows with one pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, group, held, last = TaskContext.get().partitionId(), 0, -1, 0, None
        for b in batches:
            groups = np.empty(len(b), np.int64)
            for i, pivot in enumerate(b.column("pivot").to_pylist()):
                if pivot != last or held == size:
                    group, held, last = group + 1, 0, pivot
                groups[i], held = task << 32 | group, held + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((task << 40) + done + np.arange(len(b))), pa.array(groups)], [*b.schema.names, "place", name])
            done += len(b)

    order = ["pivot", "distance", "vec_id"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", place long, {name} long"
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


@dataclass(frozen=True)
class Index:
    """Stored rows (vec_id, label, x, pivot, distance, place, cell), their cells (cell, pivot, low, high), pivots, and a radius that usually holds an anchor's positives."""

    rows: DataFrame
    cells: DataFrame
    pivots: Pivots
    radius: float


def _usual_radius(sample: np.ndarray, labels: np.ndarray, longest: int) -> float:
    """The median distance, over some of the sample, to the last wanted positive within the sample."""
    some, found = range(0, len(sample), max(1, len(sample) // 256)), []
    for i in some:
        near = np.sort(sample[(labels == labels[i]) & (np.arange(len(sample)) != i)] @ sample[i])[::-1]
        if len(near) >= POSITIVES:
            found.append(np.sqrt(max(sample[i] @ sample[i] + longest - 2 * near[POSITIVES - 1], 0)))
    return float(np.median(found)) if found else float(np.sqrt(longest))


def index(vectors: DataFrame) -> Index | None:
    """The rows of vectors (vec_id, label, x, norm), keyed, sorted and cut into cells; None without rows."""
    rows = shared_table(vectors, "negatives-rows")
    longest = rows.agg(F.max("norm").alias("norm")).first()["norm"]
    if longest is None:
        return None
    some = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).select("label", "x").collect()
    sample = np.array([r["x"] for r in some], float)
    pivots = fitted(sample, longest)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    keyed = rows.mapInArrow(_keyed(pivots, True), f"{kind}, pivot int, distance double")
    stored = shared_table(_numbered(keyed, CELL, "cell"), "negatives-index")
    cells = stored.groupBy("cell", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    return Index(stored, shared_table(cells, "negatives-cells"), pivots, _usual_radius(sample, np.array([r["label"] for r in some]), longest))


def anchors(found: Index, every: int = ANCHORS) -> DataFrame:
    """The index's rows that are anchors: (anchor, anchor_id, label, x, norm, distances, block)."""
    rows = found.rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "x", "norm", F.col("place").alias("anchor"))
    keyed = rows.mapInArrow(_keyed(found.pivots, False), "vec_id long, label long, x array<int>, norm long, anchor long, pivot int, distance double, distances array<double>")
    return shared_table(_numbered(keyed, BLOCK, "block").drop("place", "pivot", "distance").withColumnRenamed("vec_id", "anchor_id"), "negatives-anchors")


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first count scores, falling, ties by ids; ids must be in rising order."""
    if len(scores) > count:
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        keep = np.flatnonzero(scores >= least)
        return keep[np.argsort(-scores[keep], kind="stable")[:count]]
    return np.argsort(-scores, kind="stable")


def _scanned(longest: int):
    """What one cell holds for some blocks of anchors: per anchor its best rows of the same label, or, where it has positives, the best rows of other labels within each one's interval of scores."""

    def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if longest < 1 << 53:  # every product and sum is exact
            return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
        return q.astype(np.int64) @ x.T.astype(np.int64)

    def run(cell: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if len(cell) and len(asked):
            cell = cell.sort_by([("vec_id", "ascending"), ("place", "ascending")]).combine_chunks()
            x, ids, places, labels = _vectors(cell.column("x").combine_chunks()), *(cell.column(c).to_numpy() for c in ("vec_id", "place", "label"))
            for first in range(0, len(asked), AT_ONCE):
                part = asked.slice(first, AT_ONCE).combine_chunks()
                found = scores(_vectors(part.column("x").combine_chunks()), x)
                for anchor, label, positives, own in zip(part.column("anchor").to_pylist(), part.column("label").to_pylist(), part.column("positives").to_pylist(), found):
                    if positives is None:
                        fits = np.flatnonzero((labels == label) & (places != anchor))
                        out += [(anchor, -1, int(places[k]), int(ids[k]), int(own[k])) for k in fits[_best(own[fits], ids[fits], POSITIVES)]]
                        continue
                    other = labels != label
                    for p in positives:
                        fits = np.flatnonzero(other & (own <= p["score"]) & (100 * own >= LEAST * p["score"]))
                        out += [(anchor, p["place"], int(places[k]), int(ids[k]), int(own[k])) for k in fits[_best(own[fits], ids[fits], NEGATIVES)]]
        columns = np.array(out, np.int64).reshape(-1, 5).T
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], names=["anchor", "positive", "place", "vec_id", "score"])

    return run


_FOUND = "anchor long, positive long, place long, vec_id long, score long"


def _radius(norm: Column, level: Column, longest: int) -> Column:
    """The distance within which every row of at least that score lies, and a little more than rounding can hide."""
    return F.sqrt(F.greatest(norm + longest - 2 * level, F.lit(0))) * (1 + 1e-9) + 1e-6


def _best_of(found: DataFrame, count: int) -> DataFrame:
    """The first count rows for each (anchor, positive), numbered from 1."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _search(found: Index, asked: DataFrame, count: int, name: str, next_level) -> DataFrame:
    """(anchor, positive, place, vec_id, score, rank) for anchors (with positives, or null, and level: the score down to which everything is scanned first). next_level(state, best) gives (anchor, level) of those that aren't done."""
    spark, longest = found.rows.sparkSession, found.pivots.longest
    levels = shared_table(asked.select("anchor", "level"), f"{name}-levels")
    asked = asked.drop("level")
    best = spark.createDataFrame([], _FOUND + ", rank int")
    done = spark.createDataFrame([], "block long, pivot int, low double, high double")
    while not levels.isEmpty():
        active = asked.join(levels, "anchor")
        radius = _radius(F.col("norm"), F.col("level"), longest)
        reach = active.select("block", F.posexplode("distances").alias("pivot", "d"), radius.alias("r")).groupBy("block", "pivot").agg(F.min(F.col("d") - F.col("r")).alias("low"), F.max(F.col("d") + F.col("r")).alias("high"))
        before = done.select("block", "pivot", F.col("low").alias("old_low"), F.col("high").alias("old_high"))
        reach = shared_table(reach.join(before, ["block", "pivot"], "left"), f"{name}-reach")
        cells = found.cells.withColumnsRenamed({"low": "cell_low", "high": "cell_high"})
        meets = lambda low, high: (F.col("cell_low") <= F.col(high)) & (F.col("cell_high") >= F.col(low))
        pairs = reach.join(cells, "pivot").where(meets("low", "high") & ~F.coalesce(meets("old_low", "old_high"), F.lit(False)))
        part = F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("block")) - 1) / BLOCKS)  # so many blocks meet a cell together
        pairs = shared_table(pairs.select("cell", "block", part.alias("part")), f"{name}-pairs")
        needed = pairs.select(F.col("cell").alias("cell"), F.col("part").alias("part")).distinct()
        stored = found.rows.select("cell", "vec_id", "label", "x", "place").join(needed, "cell")
        wanted = pairs.join(active.select("block", "anchor", "label", "x", "positives"), "block").drop("block")
        more = stored.groupBy("cell", "part").cogroup(wanted.groupBy("cell", "part")).applyInArrow(_scanned(longest), _FOUND)
        best = shared_table(_best_of(best.drop("rank").unionByName(more), count), f"{name}-best")
        done = reach.select("block", "pivot", F.least("low", "old_low").alias("low"), F.greatest("high", "old_high").alias("high")).unionByName(
            done.join(reach, ["block", "pivot"], "left_anti")
        )
        levels = shared_table(next_level(active, best), f"{name}-levels")
    return best


def positives(found: Index, asked: DataFrame) -> DataFrame:
    """(anchor, place, vec_id, score, rank): the rows of an anchor's label with the largest scores."""
    longest = found.pivots.longest

    def next_level(state: DataFrame, best: DataFrame) -> DataFrame:
        last = best.groupBy("anchor").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        state = state.select("anchor", "norm", "level").join(last, "anchor", "left")
        radius = _radius(F.col("norm"), F.col("level"), longest)
        further = F.floor((F.col("norm") + longest - 4 * radius * radius) / 2)
        everything = radius > F.sqrt("norm") + float(np.sqrt(longest)) + 1
        enough = F.coalesce("n", F.lit(0)) >= POSITIVES
        goes_on = F.when(enough, F.col("last") < F.col("level")).otherwise(~everything)
        return state.where(goes_on).select("anchor", F.when(enough, F.col("last")).otherwise(further).alias("level"))

    level = F.floor((F.col("norm") + longest - found.radius**2) / 2)
    asked = asked.withColumns({"level": level, "positives": F.lit(None).cast("array<struct<place:long,score:long>>")})
    return _search(found, asked, POSITIVES, "positives", next_level).drop("positive")


def negatives(found: Index, asked: DataFrame, near: DataFrame) -> DataFrame:
    """(anchor, positive, place, vec_id, score, rank): for each anchor and positive (near: anchor, place, score) the rows of other labels with the largest scores in the positive's interval."""
    near = near.where("score >= 0")  # below zero the interval is empty
    least = F.ceil(F.col("p.score") * LEAST / 100)
    own = near.groupBy("anchor").agg(F.collect_list(F.struct("place", "score")).alias("positives"), F.floor(F.min("score") * FIRST_SHARE).alias("level"))  # at most POSITIVES each

    def next_level(state: DataFrame, best: DataFrame) -> DataFrame:
        last = best.groupBy("anchor", F.col("positive").alias("place")).agg(F.count("*").alias("n"), F.min("score").alias("last"))
        each = state.select("anchor", "level", F.explode("positives").alias("p")).select("anchor", "level", "p.place", least.alias("least")).join(last, ["anchor", "place"], "left")
        enough = F.coalesce("n", F.lit(0)) >= NEGATIVES
        open_ = each.where((F.col("level") > F.col("least")) & (~enough | (F.col("last") < F.col("level"))))
        return open_.groupBy("anchor").agg(F.min(F.when(enough, F.col("last")).otherwise(F.col("least"))).alias("level"))

    return _search(found, asked.join(own, "anchor"), NEGATIVES, "negatives", next_level)


def mine(vectors: DataFrame, every: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label)."""
    found = index(prepared(vectors))
    if found is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked = anchors(found, every)
    near = positives(found, asked)
    hard = negatives(found, asked, near)
    names = near.select("anchor", F.col("place").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(names, ["anchor", "positive"]).join(asked.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
