"""Reproducible shuffling and sharding by a permutation of global row numbers.

Rows are numbered in the order of their keys. A Feistel network permutes the numbers of the
next even power of two, and a number that leaves the range is permuted again until it is
back (cycle walking), which leaves a permutation of the range itself. The permuted number
gives the shard (its remainder) and the slot (its quotient); both are computable from the
row number alone, and the row number from both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import Scratch

ROUNDS = 6
KEY = 20240229
#: Fixed values of the round function: an odd multiplier and a step between round keys.
FACTOR, STEP = 2654435761, 40503
_WORD = (1 << 31) - 1


def _round_key(key: int, i: int) -> int:
    return (key + i * STEP * FACTOR) & _WORD


def _scrambled(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    """The round function: 31-bit products, of which the upper bits count."""
    x = ((x ^ key) & _WORD) * FACTOR & ((1 << 62) - 1)
    x = ((x >> 15) & _WORD) * FACTOR & ((1 << 62) - 1)
    return (x >> 13) & mask


def half_bits(n: int) -> int:
    """Bits of each half of the network over ``n`` numbers."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, key: int, rounds: range) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for i in rounds:
        left, right = right, left ^ _scrambled(right, _round_key(key, i), mask)
    return (left << half) | right


def _inverse(x: np.ndarray, half: int, key: int, rounds: range) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for i in reversed(rounds):
        left, right = right ^ _scrambled(left, _round_key(key, i), mask), left
    return (left << half) | right


def _walk(x: np.ndarray, n: int, key: int, step) -> np.ndarray:
    half = half_bits(n)
    if half > 31:
        raise ValueError("row numbers of 62 bits at most")
    out = step(x.astype(np.int64), half, key, range(ROUNDS))
    while (far := out >= n).any():
        out[far] = step(out[far], half, key, range(ROUNDS))
    return out


def permuted(rows: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Where each of the row numbers 0 to n - 1 goes."""
    return _walk(rows, n, key, _network)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, key: int = KEY) -> np.ndarray:
    """The row numbers that lie at the slots of the shards."""
    return _walk(np.asarray(slot) * shards + np.asarray(shard), n, key, _inverse)


def numbered(df: DataFrame, order: list[Column], scratch: Scratch) -> tuple[DataFrame, int]:
    """``df`` with a column ``row``, 0 to n - 1 in the given order, and n.

    Sorted ranges are written with their place; their sizes, one per range, are added up. Rows
    that are equal in ``order`` are spread over ranges at random, so no value is too common:
    their numbers are theirs in any order, and if they differ, ``order`` has to tell them apart.
    """
    names = [f"__k{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True))).withColumn("__any", F.rand(7))
    ranged = keyed.repartitionByRange(*names, "__any").sortWithinPartitions(*names, "__any")
    place = F.monotonically_increasing_id()
    written = scratch.write(ranged.select(*df.columns, place.alias("__place")))
    part = F.shiftright("__place", 33)
    sizes = written.groupBy(part.alias("__part")).agg(F.count("*").alias("size")).orderBy("__part").collect()  # one per range
    before, total = [], 0
    for r in sizes:
        before.append((r["__part"], total))
        total += r["size"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before or [(0, 0)], "__part long, __before long"))
    inside = F.col("__place").bitwiseAND((1 << 33) - 1)
    out = written.withColumn("__part", part).join(starts, "__part").withColumn("row", F.col("__before") + inside)
    return out.select(*df.columns, "row"), total


def with_shards(df: DataFrame, n: int, shards: int, key: int = KEY) -> DataFrame:
    """``df``, whose column ``row`` has row numbers below ``n``, with shard and slot."""
    fields = df.schema.fields
    at = df.columns.index("row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = permuted(batch.column(at).to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((to % shards).astype(np.int32)), pa.array(to // shards)],
                names=[*(f.name for f in fields), "shard", "slot"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "shard int, slot long"])
    return df.mapInArrow(place, schema)


def shard(docs: DataFrame, shards: int = 40, key: int = KEY) -> DataFrame:
    """(doc_id, size, text_crc32, row, shard, slot) for every row of ``docs`` (doc_id, text).

    Shards differ by one row at most and each has the slots 0, 1, ... without a gap. The order
    behind the row numbers is by id (nulls first), then by length, checksum and hash of the
    text, so the result depends on the rows alone; rows equal in all of these change places
    without notice. ``size`` is the text's UTF-8 bytes and 16 more; a null text has none.
    Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("digest"),
    )
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("digest")]
    rows, n = numbered(own, order, Scratch(docs.sparkSession))
    return with_shards(rows.drop("digest"), n, shards, key)
