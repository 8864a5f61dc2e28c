"""Exact deduplication: a two-pass Bloom filter finds hashes that may repeat, and only their rows shuffle.

Built-in DataFrame functions only. Two texts are equal if they are the same once blanks (U+0020, U+0009 to U+000D) are deleted.

Defined results: a null text counts as empty, and all empty texts form one group. Of a group, the row with the most code points in its original text stays, then the smallest doc_id (a null doc_id sorts first). Rows that repeat both doc_id and text are all counted and share one fate in exact_copies. drop_exact_copies leaves one row of each group: the one that exact_copies keeps, of several such that with the least hash of all columns, of rows that are equal in all columns any. An empty table gives an empty result. Columns other than doc_id and text play no part in what is a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.llm.shared import shared_table

#: Blanks that equality ignores.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits set by each hash, all in one 64-bit block.
BITS = 3
#: The filter has the power of two of blocks that gives each hash BITS_A_ROW bits or up to twice as many, however many rows come, so the share of hashes that it takes for repeated stays the same.
BITS_A_ROW = 12
#: A filter of up to 2**BROADCAST_LOG2 rows of two longs is broadcast (about 11 to 22 million documents); a larger one meets the hashes in a shuffle by block, and rows with texts in a shuffle by key.
BROADCAST_LOG2 = 21


def normalised(text: Column) -> Column:
    """The text without blanks; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def blocks_log2(rows: int) -> int:
    """Log2 of the number of 64-bit blocks for so many rows."""
    return max(6, (max(rows, 1) * BITS_A_ROW // 64).bit_length())


def _probe(df: DataFrame, log2: int) -> DataFrame:
    """df with _block and _bits, the filter block of each key and its bits there."""
    h = F.xxhash64("key")
    bits = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int") for i in range(BITS)]
    return df.withColumns({"_block": F.shiftrightunsigned(h, 64 - log2), "_bits": F.array_distinct(F.array(*bits))})


def repeated_filter(keys: DataFrame, log2: int) -> DataFrame:
    """First pass: (_block, _mask), the bits that at least two keys set. Counts are combined before they shuffle."""
    hits = _probe(keys.select("key"), log2).select("_block", F.explode("_bits").alias("bit"))
    return (
        hits.groupBy("_block", "bit").agg(F.count("*").alias("n")).where("n >= 2")
        .groupBy("_block").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("_mask"))
    )


def may_repeat(df: DataFrame, seen_twice: DataFrame, log2: int) -> DataFrame:
    """Second pass: df with _maybe, false if the key surely occurs once. The filter has at most 2**log2 rows; it is broadcast up to 2**BROADCAST_LOG2."""
    out = _probe(df, log2).join(F.broadcast(seen_twice) if log2 <= BROADCAST_LOG2 else seen_twice, "_block", "left")
    mask = F.coalesce("_mask", F.lit(0).cast("long"))
    bit_set = F.forall("_bits", lambda b: F.call_function("shiftright", mask, b).bitwiseAND(1) == 1)
    return out.withColumn("_maybe", bit_set).drop("_block", "_bits", "_mask")


def _key() -> Column:
    return F.unhex(F.sha2(normalised(F.col("text")), 256))


def own_hash(docs: DataFrame) -> Column:
    """A hash of all columns, told apart from one another where they are null."""
    return F.xxhash64(F.struct("*"), *(F.col(f"`{c}`").isNull() for c in docs.columns))


def _decided(keys: DataFrame, *last: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The rows (doc_id, n, key, and the columns last) with _maybe, the best row of each group of those that may repeat, the filter and its size. Ties go by the columns last."""
    keys = shared_table(keys, "dedup-keys")
    log2 = blocks_log2(keys.count())
    seen_twice = shared_table(repeated_filter(keys, log2), "dedup-filter")
    marked = may_repeat(keys, seen_twice, log2)
    best = F.min(F.struct((-F.col("n")).alias("n"), "doc_id", *last))
    groups = marked.where("_maybe").groupBy("key").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = shared_table(groups.select("key", F.col("best.doc_id").alias("keep_id"), "group_size", *(f"best.{c}" for c in last)), "dedup-groups")
    return marked, groups, seen_twice, log2


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    marked, groups, _, _ = _decided(docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), _key().alias("key")))
    alone = marked.where("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "key")
    shared = marked.where("_maybe").join(groups, "key").select("doc_id", "keep_id", "group_size", "key")
    out = alone.unionByName(shared)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("key")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept. Rows that surely don't repeat pass without a shuffle; of the others only those that stay are joined, by key and the hash of all columns."""
    own = own_hash(docs)
    _, groups, seen_twice, log2 = _decided(docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), _key().alias("key"), own.alias("own")), "own")
    rows = docs.select(F.struct("*").alias("row"), _key().alias("key"), own.alias("own"))
    marked = may_repeat(rows, seen_twice, log2) if log2 <= BROADCAST_LOG2 else rows.withColumn("_maybe", F.lit(True))
    once = marked.where("_maybe").join(groups.select("key", "own"), ["key", "own"], "left_semi").dropDuplicates(["key"])
    alone = marked.where("not _maybe").select("row.*")
    if log2 > BROADCAST_LOG2:  # keys that the groups leave out occur once
        alone = rows.join(groups.select("key"), "key", "left_anti").select("row.*")
    return alone.unionByName(once.select("row.*"))
