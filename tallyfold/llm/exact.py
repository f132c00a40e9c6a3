"""Exact duplicates by two passes over a Bloom filter; only rows that may be repeated are shuffled.

The first pass sets the filter's bits: a row has ``PROBES`` places in one block of the filter,
and a bit is set where two rows or more have a place. Copies of a text share all their places,
so a row one of whose places is not set has a text of its own. The second pass tests every
row against the filter, which all executors hold, and lets the rows with such a text straight
through. The others are grouped by the digest of their text, and that decides: a bit set by
chance costs a row's shuffle and changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.groups import with_groups
from tallyfold.llm.scratch import Scratch
from tallyfold.llm.words import SPACES

#: Fixed value: the bits of one of Spark's bitmaps, of which a block of the filter is one.
BLOCK = 32768
#: Places of a row in its block, and bits of the filter for each row, while the filter may grow.
PROBES, BITS_PER_ROW = 2, 16
#: Bytes that a filter has at most, as every executor holds it.
MAX_FILTER = 64 << 20
#: What ``exact_duplicates`` adds to the columns it keeps.
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text with one space for each run of white space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def filter_blocks(rows: int, most: int = MAX_FILTER) -> int:
    """Blocks of the filter over so many rows, 0 where a filter of ``most`` bytes would be too full to tell rows apart."""
    largest = max(1, most * 8 // BLOCK)
    if rows * PROBES > largest * BLOCK:
        return 0
    return min(largest, max(1, -(-rows * BITS_PER_ROW // BLOCK)))


def _places(digest: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a digest and its different places there."""
    spread = F.xxhash64(digest, F.lit(1))
    first = spread.bitwiseAND(BLOCK - 1)
    places = [first]
    for i in range(1, PROBES):
        places.append((first + 1 + F.pmod(F.shiftright(spread, 15 * i), F.lit(BLOCK - 1))) % BLOCK)
    return F.pmod(F.xxhash64(digest), F.lit(blocks)), places


def bloom_filter(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the filter over the column ``digest``, with a bit where two rows or more have a place."""
    block, places = _places(F.col("digest"), blocks)
    taken = rows.select(block.alias("block"), F.explode(F.array(*places)).alias("place"))
    shared = taken.groupBy("block", "place").agg(F.count("*").alias("n")).where("n > 1")
    return shared.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1


def tested(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with a column ``repeated``: false where the filter knows that the row's digest is its own."""
    block, places = _places(F.col("digest"), blocks)
    met = rows.withColumn("block", block).join(F.broadcast(bloom), "block", "left")
    hit = F.lit(True)
    for place in places:
        hit = hit & _is_set(F.col("bits"), place)
    return met.withColumn("repeated", F.col("bits").isNotNull() & hit).drop("block", "bits")


def exact_duplicates(docs: DataFrame, keep: Sequence[str] = ("doc_id",), most: int = MAX_FILTER) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (doc_id, text), with keep_id, group_size, kept and text_sha256.

    Texts are equal when they are the same after ``normalised``; a null text equals the empty
    one and those of white space only become a single space. Of equal texts the row with the
    smallest doc_id is ``kept`` and gives ``keep_id``; null ids come last, and of rows with the
    same id one is kept, whichever was stored first. ``group_size`` counts rows. Columns of
    ``docs`` are named as they like; a kept one that is called as an added one gives way to it.
    An empty table gives no rows. ``most`` bounds the filter: beyond the rows that it can tell
    apart all rows are grouped by digest, without a filter.
    """
    scratch = Scratch(docs.sparkSession)
    carried = F.struct(*[F.col(f"`{c}`") for c in keep if c not in ADDED], F.lit(0).alias("__end"))
    facts = scratch.write(
        docs.select(
            F.col("doc_id").alias("id"),
            F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("place"),
            carried.alias("row"),
        )
    )
    total = facts.count()
    blocks = filter_blocks(total, most)
    if blocks:
        bloom = scratch.write(bloom_filter(facts, blocks))
        known = tested(facts, bloom, blocks)
        alone = known.where("NOT repeated").drop("repeated")
        repeated = scratch.write(known.where("repeated").drop("repeated"))
    else:
        alone, repeated = facts.limit(0), facts
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first")
    groups = scratch.write(repeated.groupBy("digest").agg(first, F.count("*").alias("size")))
    grouped = with_groups(repeated, groups, "digest", "size", repeated.count())
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    straight = alone.select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    of_groups = grouped.select(
        "row",
        F.col("first.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("place") == F.col("first.place")).alias("kept"),
        digest,
    )
    return straight.unionByName(of_groups).select("row.*", *ADDED).drop("__end")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, see ``exact_duplicates``; its columns as they are."""
    held = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__held"))
    return exact_duplicates(held, keep=["__held"]).where("kept").select("__held.*")
