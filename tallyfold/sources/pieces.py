"""Files whose records do not end where lines do, read by many tasks a file.

Spark's text reader deals a file out in byte ranges, cut into pieces at one character: a line
break for CSV, a closing brace for JSON. Whether that character ends a record depends on all
that comes before it: it may stand inside quotes, or close something inside a record. So the
file is gone over twice. The first time each task works out what its range does to the state
of a reader, whichever state the range starts in; a running composition of these effects, a
few numbers for each range, gives the state that every range starts in. The second time each
task cuts its range into records. A record that goes over the edge of a range comes in parts,
which are put together; ranges without such an edge are not read again for that.

Most pieces are plain, a record each: whole batches of them are told by Arrow's own functions.
Lines of CSV are gone over in batches whether they are plain or not.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.errors import InvalidDataset

# Executors need not have this package: what runs there is sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ranges whose starts are sent to the tasks together; more become reads of their own.
RANGES = 1 << 16
#: Bytes of a range at least; ``spark.sql.files.maxPartitionBytes`` is the most.
LEAST_RANGE = 1 << 20

_WHOLE, _HEAD, _TAIL = 0, 1, 2


@dataclass(frozen=True)
class Start:
    """Where a range starts: byte, reader's state, and the file it is of."""

    offset: int
    state: tuple[int, ...]
    size: int
    path: str


class JsonEffect:
    """What a range does to (inside a string, depth of braces and brackets)."""

    first = (0, 0)

    def __init__(self, start: bool):
        self.odd, self.outside, self.total = 0, 0, 0
        self.head = None

    def feed(self, values: pa.Array) -> None:
        bare, plain = _json_plain(values, r"^[ \t\r\n]*,?[ \t\r\n]*\{[^\[\]{]*$")
        for sign, bracket in ((1, "{"), (1, "["), (-1, "]")):
            self.total += sign * (pc.sum(pc.count_substring(bare, bracket)).as_py() or 0)
        self.total -= len(values)  # a piece ends at a closing brace
        i = 0
        odd_ones = np.flatnonzero(~plain)
        while i < len(values):
            if not self.odd:
                after = odd_ones[np.searchsorted(odd_ones, i) :]
                if not len(after):
                    break
                i = int(after[0])
            self.odd, net = _json_step(bare[i].as_py(), self.odd)
            self.outside += net
            i += 1

    def effect(self) -> list[int]:
        return [self.odd, self.outside, self.total]

    @staticmethod
    def after(state: tuple[int, ...], effect: list[int]) -> tuple[int, ...]:
        """The state after a range; quoted and unquoted text change places if it starts inside quotes."""
        inside, depth = state
        odd, outside, total = effect
        return inside ^ odd, depth + (total - outside if inside else outside)

    @staticmethod
    def check(state: tuple[int, ...], ended: bool, path: str, size: int) -> None:
        inside, depth = state
        if inside or depth + (not ended) != 0:  # the last piece was counted as one that ends at a brace
            raise InvalidDataset(f"{path} is cut off, or no array of records: it ends at byte {size} inside a value")


def _json_plain(values: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """The pieces without what is escaped, and which of them are a flat record each."""
    bare = values
    if pc.any(pc.match_substring(values, "\\")).as_py():
        bare = pc.replace_substring_regex(values, r"(?s)\\.", "")
    even = pc.equal(pc.bit_wise_and(pc.count_substring(bare, '"'), 1), 0)
    return bare, pc.and_(even, pc.match_substring_regex(bare, pattern)).to_numpy(zero_copy_only=False)


def _json_step(bare: str, odd: int) -> tuple[int, int]:
    """The state after a piece and its closing brace, and by how much it opens more than it closes outside strings."""
    parts = bare.split('"')
    net = sum(p.count("{") + p.count("[") - p.count("]") for p in parts[odd::2])
    odd ^= (len(parts) - 1) & 1
    return odd, net - (not odd)


_SPACE = " \t\r\n"


class JsonRecords:
    """The records of a range of a file that holds one array of objects."""

    def __init__(self, start: Start, whole: bool = True):
        self.start, self.offset = start, start.offset
        self.inside, self.depth = start.state
        self.open: list[str] | None = None  # the record that is begun
        self.begun_here = True
        self.first = start.offset == 0  # of the array
        if not self.first and (self.inside or self.depth > 1):
            self.open, self.begun_here = [], False

    def feed(self, values: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        bare, plain = _json_plain(values, r"^[ \t\r\n]*,[ \t\r\n]*\{[^\[\]{]*$")
        ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        odd_ones, base, i = np.flatnonzero(~plain), self.offset, 0
        while i < len(values):
            if self.open is None and not self.first and self.depth == 1:
                after = odd_ones[np.searchsorted(odd_ones, i) :]
                upto = int(after[0]) if len(after) else len(values)
                if upto > i:
                    whole = pc.replace_substring_regex(values.slice(i, upto - i), r"^[ \t\r\n]*,[ \t\r\n]*", "", max_replacements=1)
                    yield _WHOLE, pc.binary_join_element_wise(whole, "}", "")
                    i = upto
                    continue
            self.offset = base + (int(ends[i - 1]) if i else 0)
            yield from self._piece(values[i].as_py(), bare[i].as_py(), base + int(ends[i]))
            i += 1
        self.offset = base + (int(ends[-1]) if len(ends) else 0)

    def _piece(self, text: str, bare: str, end: int) -> Iterator[tuple[int, pa.Array]]:
        last = end > self.start.size  # without a closing brace
        if self.open is None:
            # Between records nothing is escaped or quoted, so both texts lose the same beginning.
            text, bare = text.lstrip(_SPACE), bare.lstrip(_SPACE)
            if self.first:
                if not text and last:
                    return
                if not text.startswith("["):
                    self._fail("an array of records should begin")
                text, bare, self.depth = text[1:].lstrip(_SPACE), bare[1:].lstrip(_SPACE), 1
            elif self.depth == 1 and text.startswith(","):
                text, bare = text[1:].lstrip(_SPACE), bare[1:].lstrip(_SPACE)
                if not text.startswith("{"):
                    self._fail("a record should follow the comma")
            elif self.depth == 1 and not text.startswith("]"):
                self._fail("a comma or the end of the array should follow")
            if self.depth == 1 and text.startswith("]"):
                text, self.depth, self.first = text[1:].strip(_SPACE), 0, False
                if not text and last:
                    return
            if self.depth == 0:
                if text or not last:
                    self._fail("nothing should follow the array")
                return
            if not text.startswith("{"):
                self._fail("a record should begin")
            self.open, self.begun_here, self.first = [], True, False
        self.inside, net = _json_step(bare, self.inside)
        self.depth += net
        if last:
            self._fail("the file is cut off")
        self.open.append(text + "}")
        if not self.inside and self.depth <= 1:
            if self.depth < 1:
                self._fail("a record closes more than it opens")
            yield (_WHOLE if self.begun_here else _HEAD), pa.array(["".join(self.open)])
            self.open = None

    def close(self) -> Iterator[tuple[int, pa.Array]]:
        if self.open is not None:
            yield (_TAIL if self.begun_here else _HEAD), pa.array(["".join(self.open)])

    def _fail(self, what: str) -> None:
        raise InvalidDataset(f"{self.start.path} is no array of records: {what} at byte {self.offset} or after it")


#: A line that begins and ends outside quotes.
_CSV_PLAIN = r'^(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*\r?$'
#: What ``ends_inside`` says of a line, told of many at once: from outside quotes to outside, and from inside.
_CSV_CLOSED = r'"(?:[^",][^,]*)?'
_CSV_FIELDS = rf'(?:,(?:[^",][^,]*|"(?:[^"]|"")*{_CSV_CLOSED})?)*$'
_CSV_STAYS = rf'^(?:[^",][^,]*|"(?:[^"]|"")*{_CSV_CLOSED})?{_CSV_FIELDS}'
_CSV_LEAVES = rf'^(?:[^"]|"")*{_CSV_CLOSED}{_CSV_FIELDS}'


def ends_inside(line: str, inside: int) -> int:
    """Whether a line of CSV ends inside a quoted field, given whether it begins inside one."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return 1
            if line.startswith('""', quote):
                at = quote + 2
                continue
        elif line.startswith('"', at):
            inside, at = 1, at + 1
            continue
        else:
            quote = at
        comma = line.find(",", quote)
        if comma < 0:
            return 0
        inside, at = 0, comma + 1


def _csv_states(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(known, free): each line ends in the state known ^ (free & s) if the first begins in s.

    A line without quotes changes nothing. Another one leads both states to one, after which
    nothing is free, or has them change places.
    """
    quoted = pc.match_substring(values, '"')
    lines = values.filter(quoted).cast(pa.binary())  # in text, no expression matches bytes that are not UTF-8
    outside, inside = (~pc.match_substring_regex(lines, p).to_numpy(zero_copy_only=False) for p in (_CSV_STAYS, _CSV_LEAVES))
    swaps = np.concatenate([[0], np.cumsum(outside & ~inside)])
    last = np.maximum.accumulate(np.concatenate([[0], np.where(outside == inside, np.arange(1, len(lines) + 1), 0)]))
    led = np.concatenate([[False], outside])[last]
    known, free = led ^ (swaps - swaps[last]) & 1, (last == 0).astype(np.int64)
    at = np.cumsum(quoted.to_numpy(zero_copy_only=False))  # quoted lines so far
    return known[at], free[at]


def _csv_texts(texts: pa.Array) -> pa.Array:
    """Records without the carriage return that their line ended with, and without empty ones."""
    if pc.any(pc.ends_with(texts, "\r\r")).as_py():
        plain = pc.and_not(pc.match_substring_regex(texts, _CSV_PLAIN), pc.match_substring(texts, "\n"))
        texts = pc.if_else(plain, pc.utf8_rtrim(texts, "\r"), pc.replace_substring_regex(texts, "\r$", ""))
    else:
        texts = pc.utf8_rtrim(texts, "\r")
    return texts.filter(pc.not_equal(pc.utf8_trim_whitespace(texts), ""))


class CsvEffect:
    """What a range does to (inside a quoted field), and the header if it holds one."""

    first = (0,)

    def __init__(self, start: bool):
        self.ends = [0, 1]
        self.lines: list[str] | None = [] if start else None
        self.head: str | None = None

    def feed(self, values: pa.Array) -> None:
        if self.lines is not None:
            inside = 0
            for line in values:
                self.lines.append(line.as_py())
                inside = ends_inside(self.lines[-1], inside)
                if not inside and "".join(self.lines).strip():
                    self.head, self.lines = "\n".join(self.lines).strip("\r\n"), None
                    break
        if len(values):
            known, free = _csv_states(values)
            self.ends = [int(known[-1] ^ free[-1] & s) for s in self.ends]

    def effect(self) -> list[int]:
        return self.ends

    @staticmethod
    def after(state: tuple[int, ...], effect: list[int]) -> tuple[int, ...]:
        return (effect[state[0]],)

    @staticmethod
    def check(state: tuple[int, ...], ended: bool, path: str, size: int) -> None:
        if state[0]:
            raise InvalidDataset(f"{path} is cut off: it ends at byte {size} inside quotes")


class CsvRecords:
    """The records of a range, without the file's header and without empty lines.

    Those of a batch of lines leave together. Without ``whole``, only the parts of records that go over an edge do.
    """

    def __init__(self, start: Start, whole: bool = True):
        (self.inside,) = start.state
        self.open: list[str] | None = [] if self.inside else None
        self.begun_here = not self.inside
        self.header = start.offset == 0
        self.whole = whole

    def feed(self, values: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        if not len(values):
            return
        values.validate(full=True)  # text that is not UTF-8 fails
        known, free = _csv_states(values)
        inside = known ^ free & self.inside
        self.inside = int(inside[-1])
        ends = np.flatnonzero(inside == 0) + 1
        if len(ends):
            yield from self._ended(values, ends)
        rest = values.slice(int(ends[-1]) if len(ends) else 0)
        if len(rest):
            if self.open is None:
                self.open, self.begun_here = [], True
            self.open.append("\n".join(rest.to_pylist()))

    def _ended(self, values: pa.Array, ends: np.ndarray) -> Iterator[tuple[int, pa.Array]]:
        """The records that end before the lines ``ends``; of records begun elsewhere alone unless ``whole``."""
        first, self.open = self.open, None
        if not self.whole:
            if self.begun_here:
                return
            ends = ends[:1]
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, values), pa.scalar("\n", values.type))
        if first is not None:
            text = pa.array(["\n".join([*first, texts[0].as_py()])], texts.type)
            if self.begun_here:
                texts = pa.concat_arrays([text, texts[1:]])
            else:
                yield _HEAD, pc.replace_substring_regex(text, "\r$", "")
                texts, self.begun_here = texts[1:], True
        while self.header and len(texts):
            self.header, texts = not texts[0].as_py().strip(), texts[1:]
        yield _WHOLE, _csv_texts(texts)

    def close(self) -> Iterator[tuple[int, pa.Array]]:
        if self.open is not None:
            yield (_TAIL if self.begun_here else _HEAD), pa.array(["\n".join(self.open) + "\n"])


@dataclass(frozen=True)
class Format:
    """``delimiter`` ends every piece; ``open_state`` tells of a state whether a record is begun in it."""

    delimiter: str
    effect: type
    records: type
    open_state: Callable[[tuple[int, ...]], bool]


JSON = Format("}", JsonEffect, JsonRecords, lambda state: bool(state[0]) or state[1] > 1)
CSV = Format("\n", CsvEffect, CsvRecords, lambda state: bool(state[0]))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.Array, list]]:
    """The pieces of a batch by range: (file, start), the pieces, and the values of further columns."""
    files, blocks = (batch.column(i).to_numpy() for i in (1, 2))
    edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
    for a, b in pairwise([0, *(int(e) for e in edges), len(files)]):
        if b > a:
            yield (int(files[a]), int(blocks[a])), batch.column(0).slice(a, b - a), [c[a] for c in batch.columns[3:]]


def _fixed_ranges(spark: SparkSession, size: int) -> SparkSession:
    """A session like ``spark`` whose reads cut files at multiples of ``size`` bytes, whatever they read with them.

    A read's byte ranges follow the settings of the session it was made in, the total of its
    files and the cores at hand; both times a file is read they have to be the same.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    own.conf.unset("spark.sql.files.maxPartitionNum")
    return own


def _read(
    spark: SparkSession, path: str | list[str], delimiter: str, files: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """(value, file, block, further columns that Spark takes from the folders' names), and the latter's names.

    Only of ``files`` if they are given.
    """
    text = spark.read.option("lineSep", delimiter).text(path)
    further = text.columns[1:]
    if files is not None:
        text = text.where(F.col("_metadata.file_path").isin(files))
    file = F.xxhash64("_metadata.file_path").alias("file")
    return text.select("value", file, F.col("_metadata.file_block_start").alias("block"), *[F.col(f"`{c}`") for c in further]), further


@dataclass
class Scan:
    """The ranges of some files and the state that each starts in; ``heads`` has the first record of each CSV file."""

    spark: SparkSession
    ranged: SparkSession
    format: Format
    path: str | list[str]
    paths: dict[int, str]
    starts: dict[tuple[int, int], Start]
    heads: dict[str, str]

    def records(self, paths: list[str] | None = None) -> DataFrame:
        """(text, further columns): a row for each record of the files ``paths``, of all by default."""
        wanted = set(self.paths.values() if paths is None else paths)
        groups: list[dict[tuple[int, int], Start]] = [{}]
        for key, start in self.starts.items():  # in the order of files
            if start.path in wanted:
                if start.offset == 0 and len(groups[-1]) >= RANGES:
                    groups.append({})
                groups[-1][key] = start
        out = None
        for starts in groups:
            own = self._records(starts)
            out = own if out is None else out.unionByName(own)
        # No rows, and no task, but it makes the result a frame of the caller's session.
        none = self.spark.range(1).select([F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema]).limit(0)
        return none.unionByName(out)

    def _records(self, starts: dict[tuple[int, int], Start]) -> DataFrame:
        whole, further = self._cut(starts, list(starts.values()), whole=True)
        edges = [s for s in starts.values() if s.offset and self.format.open_state(s.state)]
        if not edges:
            return whole
        parts, _ = self._cut(starts, edges, whole=False)
        # At most two parts for each range; a record's own parts are put together in one task.
        number = F.expr("count_if(kind = 2) OVER (PARTITION BY file ORDER BY block, kind)")
        numbered = parts.withColumn("number", number)
        cells = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
        rest = [F.first(f"`{c}`").alias(c) for c in further]
        joined = numbered.groupBy("file", "number").agg(F.array_join(F.transform(cells, lambda c: c["text"]), "").alias("text"), *rest)
        return whole.unionByName(joined.select("text", *further))

    def _cut(self, starts: dict[tuple[int, int], Start], some: list[Start], whole: bool) -> tuple[DataFrame, list[str]]:
        """The files of ``some`` ranges cut into records, or of others into the parts that lie in one range."""
        files = list(dict.fromkeys(s.path for s in some))
        lines, further = _read(self.ranged, self.path, self.format.delimiter, None if len(files) == len(self.paths) else files)
        reader = self.format.records
        names = ([] if whole else ["file", "block", "kind"]) + ["text", *further]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None

            def rows(found, key, extra):
                for kind, texts in found:
                    n = len(texts)
                    if not n or whole != (kind == _WHOLE):
                        continue
                    keys = [] if whole else [*(pa.array(np.full(n, k)) for k in key), pa.array(np.full(n, kind, np.int32))]
                    more = [pa.array([e.as_py()] * n, e.type) for e in extra]
                    yield pa.RecordBatch.from_arrays([*keys, texts.cast(pa.string()), *more], names=names)

            for batch in batches:
                for key, values, extra in _slices(batch):
                    if now is None or now[1] != key:
                        if now is not None:
                            yield from rows(now[0].close(), *now[1:])
                        now = (reader(starts[key], whole), key, extra)
                    yield from rows(now[0].feed(values), key, extra)
            if now is not None:
                yield from rows(now[0].close(), *now[1:])

        types = {f.name: f.dataType.simpleString() for f in lines.schema}
        schema = ", ".join([*([] if whole else ["file long, block long, kind int"]), "text string", *(f"`{c}` {types[c]}" for c in further)])
        return lines.mapInArrow(cut, schema), further


def scan(spark: SparkSession, path: str | list[str], format: Format, range_bytes: int | None = None) -> Scan:
    """Goes over the files once and works out the state that each range, of ``range_bytes`` bytes, starts in.

    The driver gets one row a file and one a range, as Spark's own planning has. A file that
    ends inside a value fails here.
    """
    listed = spark.read.format("binaryFile").load(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    )
    files = {r["file"]: (r["path"], r["size"]) for r in listed.collect()}
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    even = sum(size for _, size in files.values()) // (2 * spark.sparkContext.defaultParallelism)
    ranged = _fixed_ranges(spark, range_bytes or min(most, max(LEAST_RANGE, even)))
    lines, _ = _read(ranged, path, format.delimiter)
    effect = format.effect

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = None, 0

        def row():
            own, (file, block) = now
            return pa.RecordBatch.from_pylist([{"file": file, "block": block, "bytes": size, "effect": own.effect(), "head": own.head}], schema=arrow)

        arrow = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("bytes", pa.int64()), ("effect", pa.list_(pa.int64())), ("head", pa.string())])
        for batch in batches:
            for key, values, _ in _slices(batch):
                if now is None or now[1] != key:
                    if now is not None:
                        yield row()
                    now, size = (effect(key[1] == 0), key), 0
                now[0].feed(values)
                size += (pc.sum(pc.binary_length(values)).as_py() or 0) + len(values)
        if now is not None:
            yield row()

    found: dict[int, list] = {}
    for r in lines.select("value", "file", "block").mapInArrow(summarise, "file long, block long, bytes long, effect array<long>, head string").collect():
        found.setdefault(r["file"], []).append(r)
    starts, heads = {}, {}
    for file, (name, size) in sorted(files.items(), key=lambda f: f[1]):
        offset, state = 0, format.effect.first
        for r in sorted(found.get(file, []), key=lambda r: r["block"]):
            starts[file, r["block"]] = Start(offset, state, size, name)
            offset, state = offset + r["bytes"], format.effect.after(state, r["effect"])
            if r["head"] is not None:
                heads[name] = r["head"]
        if offset not in (size, size + 1) and size:
            raise InvalidDataset(f"{name} has {size} bytes, of which {offset} were read: compressed files cannot be read in ranges")
        if size:
            format.effect.check(state, offset == size, name, size)
    return Scan(spark, ranged, format, path, {f: p for f, (p, _) in files.items()}, starts, heads)
