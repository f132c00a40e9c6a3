"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes are put into buckets by their first q bytes. A bucket is refined by sorting its
suffixes on the bucket identifiers found further on, at an offset equal to the length sorted
so far; identifiers made in one round are used by the next, until ``length`` bytes count.
Suffixes that then share a bucket start with the same ``length`` bytes.

Three steps make that fit many machines.

*Anchors.* Of the q-grams in each window of ``length`` bytes the one with the least
identifier is the window's anchor. Equal windows have equal anchors at equal offsets, so only
anchors are shuffled, about one in 85 positions, each with the run of windows it stands for.

*Classes.* The identifier of all bytes that an anchor's windows cover, made from those of its
q-grams, names its class. A class with several members repeats as a whole: all its windows do.
From here on one member stands for the class, so groups of copies shrink to one row.

*Refinement.* Buckets that still hold different classes get the bytes of one member each, and
these are refined exactly, from 8 bytes up, by ranks instead of hashes. Many buckets share a
task; a bucket over ``bucket_rows`` classes is not gathered, its windows are counted by
Spark's aggregation instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import Scratch

#: Bytes of a first bucket. A power of two, as identifiers double from one byte.
Q = 32
#: Bytes of text worked on at a time; windows are carried over from one piece to the next.
PIECE = 1 << 17
#: Classes of one bucket that a task refines at once.
BUCKET_ROWS = 1 << 14
#: Bytes that a task refines at once, in whole buckets.
REFINE_BYTES = 1 << 21

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose low and high bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(32))) * _STEP[62]
    return x ^ (x >> np.uint64(29))


def _doubled(ids: np.ndarray, level: int) -> np.ndarray:
    """Identifiers of twice as many bytes, from those here and those at the offset of the bytes counted so far."""
    size = 1 << level
    if len(ids) <= size:
        return ids[:0]
    return _mixed(ids[:-size] * _STEP[level] + ids[size:])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - width + size], keys[width - size :]) if width > size else keys


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(bucket, class, position, first window, last window) of each anchor in ``data`` (at least ``length`` bytes).

    A class covers the windows' bytes and where the anchor lies in them.
    """
    ids = [_BYTE[data]]
    for level in range(Q.bit_length() - 1):
        ids.append(_doubled(ids[-1], level))
    grams = ids[-1]
    n = len(data) - length + 1
    low = np.uint64((1 << 21) - 1)
    at = np.arange(len(grams), dtype=np.uint64)
    chosen = (_least((grams & ~low) | at, length - Q + 1) & low).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    first, last = edges, np.r_[edges[1:], n] - 1
    where = chosen[first]
    # all bytes from first to last + length: q-grams side by side, the last one flush with the end
    size = last - first + length
    whole = _mixed(grams[first] ^ (where - first).astype(np.uint64))
    for k in range(1, (2 * length) // Q + 1):
        offset = np.minimum(k * Q, size - Q)
        whole = _mixed(whole * _STEP[32] + grams[first + offset] + size.astype(np.uint64))
    return grams[where], whole, where, first, last


def _pieces(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces that hold each window once."""
    for at in range(0, len(data) - length + 1, PIECE):
        yield at, data[at : at + PIECE + length - 1]


def _anchor_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "class", "row", "first", "last"]

        def batch_of(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            bucket, whole, row, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                    pa.array(row),
                    pa.array(first, pa.int64()),
                    pa.array((last - first).astype(np.int32)),
                ],
                names=[*names[:4], "more"],
            )

        for batch in batches:
            found, held = [], 0
            for row, text in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.empty(0, np.uint8)
                for at, piece in _pieces(data, length):
                    bucket, whole, _, first, last = anchors(piece, length)
                    found.append((bucket, whole, np.full(len(first), row), first + at, last + at))
                    held += len(first)
                if held > 1 << 16:
                    yield batch_of(found)
                    found, held = [], 0
            if found:
                yield batch_of(found)

    return rows


def refine(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers of the ``length`` bytes from each of the positions ``valid`` in ``data``.

    Bucket-pointer refinement, exact: buckets of 8 bytes first, then of 16, 32, ... by sorting
    on pairs of bucket numbers, the position's own and that of the position further on.
    """
    words = np.zeros(len(data), np.uint64)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(data)]
    number, size = np.unique(words, return_inverse=True)[1], 8
    while size < length:
        step = min(size, length - size)
        later = np.r_[number[step:], np.zeros(step, number.dtype)]
        number, size = np.unique((number.astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64), return_inverse=True)[1], size + step
    return number[valid]


def _repeats_of_sorted(length: int):
    """Reads rows (bucket, row, first, more, sure, bytes) sorted by bucket; gives (row, first, more) of repeated windows."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def refined(table: pa.Table) -> pa.RecordBatch:
            more = table["more"].to_numpy().astype(np.int64)
            data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
            starts = np.cumsum(more + length) - (more + length)
            owner = np.repeat(np.arange(len(more)), more + 1)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
            _, number, times = np.unique(refine(data, starts[owner] + inside, length), return_inverse=True, return_counts=True)
            again = times[number] > 1
            edge = np.flatnonzero(again & np.r_[True, ~again[:-1] | (owner[1:] != owner[:-1])])
            end = np.flatnonzero(again & np.r_[~again[1:] | (owner[1:] != owner[:-1]), True])
            who = owner[edge]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(table["row"].to_numpy()[who]),
                    pa.array(table["first"].to_numpy()[who] + inside[edge]),
                    pa.array((inside[end] - inside[edge]).astype(np.int32)),
                ],
                names=["row", "first", "more"],
            )

        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t["bytes"].nbytes for t in held) >= REFINE_BYTES:
                table = pa.concat_tables(held)
                bucket = table["bucket"].to_numpy()
                open_at = int(np.argmax(bucket == bucket[-1]))  # the last bucket may go on in the next batch
                if open_at:
                    yield refined(table.slice(0, open_at).combine_chunks())
                held = [table.slice(open_at)]
        if held and sum(map(len, held)):
            yield refined(pa.concat_tables(held).combine_chunks())

    return repeats


def _bytes_of_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (row, data, asked); gives one row for each asked class, with its bytes."""
    for batch in batches:
        for row, data, asked in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            found, whole = asked.as_py(), data.as_buffer()
            for at in range(0, len(found), 4096):
                part = found[at : at + 4096]
                spans = [whole.slice(a["first"], a["size"]).to_pybytes() for a in part]
                arrays = [pa.array([a[n] for a in part], t) for n, t in (("bucket", pa.int64()), ("first", pa.int64()), ("more", pa.int32()), ("classes", pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [arrays[0], pa.array([row.as_py()] * len(part), pa.int64()), *arrays[1:], pa.array(spans, pa.binary())],
                    names=["bucket", "row", "first", "more", "classes", "bytes"],
                )


def _windows_of(length: int):
    """Each window of crowded buckets by a digest of its bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [
                    (hashlib.md5(b[k : k + length]).digest(), row, first + k)
                    for row, first, more, b in zip(*(part.column(n).to_pylist() for n in ("row", "first", "more", "bytes")), strict=True)
                    for k in range(more + 1)
                ]
                digest, row, first = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()), pa.array(row, pa.int64()), pa.array(first, pa.int64())], names=["window", "row", "first"]
                )

    return windows


def repeated_windows(rows: DataFrame, length: int, scratch: Scratch, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(row, first, more): the windows from ``first`` to ``first + more`` of a row occur elsewhere too.

    ``rows``: a written table (row long, data binary).
    """
    found = scratch.write(
        rows.mapInArrow(_anchor_rows(length), "bucket long, class long, row long, first long, more int").where("bucket is not null")
    )
    classes = found.groupBy("bucket", "class").agg(
        F.count("*").alias("members"), F.min(F.struct("row", "first", "more")).alias("one")
    )
    buckets = classes.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("members").alias("suffixes"), F.min("members").alias("fewest"))
    shared = scratch.write(
        classes.join(buckets.where("suffixes > 1").drop("suffixes"), "bucket").select("bucket", "class", "members", "classes", "fewest", "one.*")
    )
    # classes with several members repeat as a whole
    whole = found.join(shared.where("members > 1").select("bucket", "class"), ["bucket", "class"], "left_semi")
    whole = scratch.write(whole.select("row", "first", "more"))
    scratch.drop(found)
    # different classes of one bucket: compared by the bytes of one member each, unless all repeat anyway
    asked = shared.where("classes > 1 and fewest = 1").groupBy("row").agg(
        F.collect_list(F.struct("bucket", "first", "more", "classes", (F.col("more") + length).alias("size"))).alias("asked")
    )
    texts = rows.join(asked, "row").select("row", "data", "asked")
    spans = scratch.write(
        texts.mapInArrow(_bytes_of_classes, "bucket long, row long, first long, more int, classes long, bytes binary")
    )
    scratch.drop(shared)
    dealt = spans.where(F.col("classes") <= bucket_rows).repartition("bucket").sortWithinPartitions("bucket")
    parts = dealt.mapInArrow(_repeats_of_sorted(length), "row long, first long, more int")
    crowded = spans.where(F.col("classes") > bucket_rows)
    if not crowded.isEmpty():
        windows = crowded.mapInArrow(_windows_of(length), "window binary, row long, first long")
        again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        several = windows.join(again, "window").select("row", "first", F.lit(0).alias("more"))
        parts = parts.unionByName(several)
    return whole.unionByName(parts)


def _cut(data: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the windows of ``spans``, the bytes removed and the runs they form."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for first, more in sorted(spans):
        if first > end:
            if end >= 0:
                removed += end - at
                at = end
            kept.append(data[at:first])
            at, runs = first, runs + 1
        end = max(end, first + more + length)
    if end >= 0:
        removed += end - at
        at = end
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def without_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the
    same text or another, is removed; ``kept`` (binary) is the rest, which may cut through a
    character. A null text is an empty one; texts shorter than ``length`` stay as they are.
    Rows are told apart by their place, so ids may be null or repeat. Other columns are not read.
    """
    if length < 2 * Q:
        raise ValueError(f"strings of less than {2 * Q} bytes have no anchors here")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data"),
        )
    )
    spans = repeated_windows(rows.select("row", "data"), length, scratch, bucket_rows).groupBy("row").agg(
        F.collect_list(F.struct("first", "more")).alias("spans")
    )
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for data, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found.append((len(data), *_cut(data, [(s["first"], s["more"]) for s in spans or ()], length)))
                size, kept, removed, runs = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    marked = rows.join(spans, "row", "left").select("doc_id", "data", "spans")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    return marked.mapInArrow(cut, schema).withColumnRenamed("doc_id", doc_id)
