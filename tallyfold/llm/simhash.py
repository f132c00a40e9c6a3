"""Near-duplicates by SimHash, joined in a grid of segment popcounts.

A fingerprint of 64 bits maps to 32 popcounts, one for each segment of two bits. Flipping
one bit moves one popcount by one, so the Manhattan distance of two such points never
exceeds the number of differing bits. Points within distance d of each other agree on all
coordinates of at least ``BLOCKS - d`` of ``BLOCKS`` blocks; the grid has a unit cell for
each choice of so many blocks and each value of their coordinates, and only points that
share a cell are compared: first by Manhattan distance, then by their bits.

Popcounts are kept as thermometers (0: 00, 1: 01, 2: 11), whose differing bits count the
Manhattan distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.components import components
from tallyfold.llm.names import by_place
from tallyfold.llm.scratch import Scratch

SEED = 42
BLOCKS = 8
#: Shingles hashed at a time, so that memory does not grow with a text's shingles.
CHUNK = 1 << 15
#: Cells up to this size are compared pair by pair, in one go for all cells of a batch.
SMALL_CELL = 16
#: Fingerprints of one cell that a task holds at once; of larger cells, every two blocks meet in a task.
CELL_BLOCK = 1 << 15
_EVEN = 0x5555555555555555


def fingerprint(data: bytes | None, width: int) -> int:
    """Majority bits of the hashes of all shingles, repeats included; 0 without words."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    starts, ends = (ends - sizes)[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = 4, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with a column ``name``: the fingerprint of each text as a signed long."""
    fields = docs.schema.fields
    at = docs.columns.index(text)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py(), width) for t in texts], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found)], names=[*(f"c{i}" for i in range(len(fields))), "fp"]
            )

    plain = docs.toDF(*(f"c{i}" for i in range(len(fields))))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "fp long"])
    return plain.mapInArrow(prints, schema).toDF(*(f.name for f in fields), name)


def _thermometers(f: np.ndarray) -> np.ndarray:
    half, even = f >> np.uint64(1), np.uint64(_EVEN)
    return ((f | half) & even) | (((f & half) & even) << np.uint64(1))


def thermometers(f: Column) -> Column:
    """The popcount embedding of a fingerprint column, as thermometers of two bits."""
    half, even = F.shiftrightunsigned(f, 1), F.lit(_EVEN)
    return f.bitwiseOR(half).bitwiseAND(even).bitwiseOR(F.shiftleft(f.bitwiseAND(half).bitwiseAND(even), 1))


def _near(one: np.ndarray, other: np.ndarray, distance: int) -> np.ndarray:
    """Whether fingerprints are near: the Manhattan distance of the embeddings first, then the bits."""
    near = np.bitwise_count(_thermometers(one) ^ _thermometers(other)) <= distance
    near[near] = np.bitwise_count((one ^ other)[near]) <= distance
    return near


def _reach(f: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is near, a spanning tree for each cluster: no more links than members."""
    left = f
    while left.size:
        queue, left = [left[:1]], left[1:]
        while queue and left.size:
            for hub in queue.pop():
                near = _near(left, np.broadcast_to(hub, left.shape), distance)
                if near.any():
                    yield np.full(near.sum(), hub), left[near]
                    queue.append(left[near])
                    left = left[~near]


def _cell_links(cells: np.ndarray, f: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within each run of equal ``cells``."""
    edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    found = []
    c, g = cells[small], f[small]
    for step in range(1, SMALL_CELL):
        same = c[step:] == c[:-step]
        if not same.any():
            break
        one, other = g[:-step][same], g[step:][same]
        near = _near(one, other, distance)
        found.append((one[near], other[near]))
    for k in np.flatnonzero(sizes > SMALL_CELL):
        found += _reach(f[edges[k] : edges[k + 1]], distance)
    return found


def _links_of_sorted(distance: int):
    """Reads rows (cell, fp) sorted by cell; gives the links within cells."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def batch_of(upto: int) -> pa.RecordBatch:
            found = _cell_links(cells[:upto], f[:upto], distance) or [(f[:0], f[:0])]
            ends = (pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays(list(ends), names=["a", "b"])

        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            f = np.concatenate([f, batch.column(1).to_numpy().view(np.uint64)])
            others = np.flatnonzero(cells != cells[-1])
            if others.size:  # the last cell may go on in the next batch
                yield batch_of(upto := int(others[-1]) + 1)
                cells, f = cells[upto:], f[upto:]
        if cells.size:
            yield batch_of(cells.size)

    return links


def near_links(prints: DataFrame, distance: int, scratch: Scratch, cell_block: int = CELL_BLOCK) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp``: near ones, and enough of them to connect all that are near.

    Rows are as many as grid cells per fingerprint, whatever the size of a group; a cell of
    n members gives fewer than n links. Cells over ``cell_block`` are split into blocks, and
    every two blocks meet in a task of their own.
    """
    choices = [sum(0xFF << 8 * b for b in c) for c in combinations(range(BLOCKS), BLOCKS - distance)]
    signed = [c - (c >> 63 << 64) for c in choices]
    cells = prints.select("fp", thermometers(F.col("fp")).alias("u")).select(
        "fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("u").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))).alias("cell")
    )
    if prints.limit(cell_block + 1).count() > cell_block:
        crowded = scratch.write(cells.groupBy("cell").count().where(F.col("count") > cell_block))
        if not crowded.isEmpty():
            blocks = F.ceil(F.col("count") / cell_block).cast("int")
            split = cells.join(crowded, "cell").withColumn("block", F.pmod(F.hash("fp"), blocks))
            split = split.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
            pair = F.xxhash64("cell", F.least("block", "with"), F.greatest("block", "with"))
            cells = cells.join(crowded, "cell", "left_anti").unionByName(split.select("fp", pair.alias("cell")))
    dealt = cells.select("cell", "fp").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_links_of_sorted(distance), "a long, b long").distinct()


def duplicate_groups(prints: DataFrame, distance: int, scratch: Scratch, doc_id: str = "doc_id") -> DataFrame:
    """(fp, root, component_id, first) for each distinct fingerprint of ``prints`` (doc_id, fp).

    ``prints`` is a written table, whose rows are counted. ``root`` names the group, ``component_id`` is its smallest id (ids that are null count
    last) and ``first`` the pair (fp, id) of the one row that stands for the group.
    """
    one = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "fp"))
    distinct = scratch.write(prints.groupBy("fp").agg(one.alias("first")), prints.count())
    linked = components(near_links(distinct.select("fp"), distance, scratch), scratch, distinct.count())
    rooted = distinct.join(linked, distinct.fp == linked.vertex, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", F.col("first.id").alias("component_id"), "first")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents whose fingerprints differ in ``distance`` bits or fewer are linked;
    ``component_id`` is the smallest id a document reaches, itself included. A null or empty
    text has fingerprint 0 and is linked like any other; rows without an id get the group's
    smallest id, or null when none of the group has one. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width).drop("text"))
    groups = duplicate_groups(prints, distance, scratch)
    return prints.join(groups.select("fp", "component_id"), "fp").select(F.col("doc_id").alias(doc_id), "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns.

    It is the row with the group's smallest id; of rows that share that id and its
    fingerprint, any one. Columns are named as they like.
    """
    names = docs.columns
    places = (f"c{names.index(c)}" for c in (doc_id, text))
    return _kept(by_place(docs), width, distance, *places).toDF(*names)


def _kept(docs: DataFrame, width: int, distance: int, doc_id: str, text: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    prints = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width).drop("text")
    prints = scratch.write(prints)
    groups = duplicate_groups(prints, distance, scratch)
    first = groups.where(F.col("fp") == F.col("root")).select(F.col("first.id").alias("__id"), F.col("first.fp").alias("__fp"))
    first = scratch.write(first, prints.count())
    marked = with_fingerprints(docs, width, text, "__own")
    kept = marked.join(first, (F.col(doc_id).eqNullSafe(F.col("__id"))) & (F.col("__own") == F.col("__fp")), "left_semi")
    return kept.dropDuplicates([doc_id, "__own"]).drop("__own")
