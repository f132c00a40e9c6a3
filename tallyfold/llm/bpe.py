"""Byte-pair encoding by an automaton over tokens.

The automaton reads a word's tokens. Its state is the token read last, and from it there is
an arc for every token that may stand next in a correct encoding; every word has exactly one
path. It is built merge by merge. Before the first merge each base symbol may follow any
other. The gadget of a merge (u, v) of rank r adds the token uv and

* bans v after u, as the two would have been merged,
* lets uv be followed by what could follow v so far (a copy of v's row of arcs),
* lets uv follow what u can follow (a copy of u's column of arcs).

The whole table has a cell for each two tokens. So the tables that are compiled hold, for each
token, the two that it was merged from and the rank; an arc is looked up by undoing the
copies, gadget by gadget, down to a ban or to base symbols, and is then kept.

Encoding reads a word from the left. For each of its prefixes there is one last token that an
arc leads to; the last one's path is the encoding. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose encoding a worker remembers, and arcs that it keeps. Workers outlive their tasks, so a
#: word is kept as the bytes of its ids: what they hold takes memory from the stages that follow.
WORDS_KEPT = 1 << 19
ARCS_KEPT = 1 << 20
#: Words encoded at a time, so that memory does not grow with a text's tokens.
CHUNK = 1 << 16


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [shown[b] for b in range(256)]


class Automaton:
    """Arcs between the tokens of a word-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.ids, self.suffix = vocabulary, suffix
        self.labels = {i: token for token, i in vocabulary.items()}
        #: rank and halves of each merged token; a token comes from one merge
        self.made: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (u, v) in enumerate(merges):
            pair, uv = (vocabulary[u], vocabulary[v]), vocabulary[u + v]
            self.rank.setdefault(pair, rank)
            self.made.setdefault(uv, (rank, *pair))
        labels = {t.removesuffix(suffix) for t in vocabulary}
        self.prefixes = {label[:n] for label in labels for n in range(1, len(label) + 1)}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.dead: set[int] = set()  # tokens no arc leads to, as their halves never meet
        for uv, (rank, u, v) in self.made.items():
            if u in self.dead or v in self.dead or not self._allowed(u, v, rank):
                self.dead.add(uv)

    def arc(self, one: int, other: int) -> bool:
        """Whether ``other`` may follow ``one``."""
        known = self.arcs.get((one, other))
        if known is None:
            known = self._allowed(one, other, len(self.rank))
            if len(self.arcs) < ARCS_KEPT:
                self.arcs[one, other] = known
        return known

    def _allowed(self, one: int, other: int, before: int) -> bool:
        """Whether there is that arc when ``before`` merges have been made."""
        never, base = len(self.rank), (-1, 0, 0)
        while True:
            if self.rank.get((one, other), never) < before:
                return False
            (r1, _, tail), (r2, head, _) = self.made.get(one, base), self.made.get(other, base)
            if r1 < 0 and r2 < 0:
                return True
            if r1 > r2:  # the row was copied before the ban of that merge,
                one, before = tail, r1
            else:  # the column after it
                other, before = head, r2 + 1

    def path(self, symbols: str) -> list[int]:
        """Token ids of one word, given as byte symbols without the suffix."""
        n = len(symbols)
        ids, prefixes, suffix, dead = self.ids, self.prefixes, self.suffix, self.dead
        last: list[tuple[int, int] | None] = [(-1, 0)] + [None] * n  # for each prefix: its last token, and where that starts
        for start in range(n):
            if last[start] is None:
                continue
            before = last[start][0]
            for end in range(start + 1, n + 1):
                label = symbols[start:end]
                if label not in prefixes:
                    break
                token = ids.get(label if end < n else label + suffix)
                if token is not None and last[end] is None and token not in dead and (start == 0 or self.arc(before, token)):
                    last[end] = (token, start)
        path, at = [], n
        while at:
            if last[at] is None:
                raise ValueError("a symbol is not in the vocabulary")
            token, at = last[at]
            path.append(token)
        return path[::-1]


class WordTokenizer:
    """A tokenizer file with NFC, lower case, words by pattern, byte symbols and an end-of-word suffix."""

    def __init__(self, file: str):
        spec = json.loads(Path(file).read_text())
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = _byte_symbols()
        #: labels and ids in writing, of special tokens too; the type that holds an id
        self.named = {i: t for t, i in self.special.items()} | self.automaton.labels
        self.numbers = {i: str(i) for i in self.named}
        self.kind = "H" if max(self.named) < 1 << 16 else "I"
        self.kept: dict[str, bytes] = {}

    def words(self, text: str) -> Iterator[str]:
        """Pre-split words; special tokens stand for themselves."""
        for piece in self.cut.split(text) if any(s in text for s in self.special) else (text,):
            if piece in self.special:
                yield piece
            else:
                yield from self.word.findall(_lower(piece))

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return self.automaton.path("".join([self.symbols[b] for b in word.encode()]))

    def entry(self, word: str) -> bytes:
        """The ids of a word's tokens."""
        found = array(self.kind, self.ids(word)).tobytes()
        if len(self.kept) < WORDS_KEPT:
            self.kept[word] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, as a tokenizer without a decoder gives them: joined by spaces."""
        return " ".join(map(self.named.__getitem__, ids))

    def text_of(self, ids: list[int]) -> str:
        """Lower-case words again, a space after each: the round trip of the words."""
        specials = {i: t for t, i in self.special.items()}
        back = {s: b for b, s in enumerate(self.symbols)}
        labels = "".join(self.automaton.labels.get(i) or specials[i] + self.automaton.suffix for i in ids)
        return " ".join(
            w if w in self.special else bytes(back[c] for c in w).decode(errors="replace")
            for w in labels.split(self.automaton.suffix)[:-1]
        )

    def id_chunks(self, text: str) -> Iterator[np.ndarray]:
        """The ids of ``CHUNK`` words at a time."""
        known, entry, words = self.kept.get, self.entry, self.words(text)
        while found := [known(word) or entry(word) for word in islice(words, CHUNK)]:
            yield np.frombuffer(b"".join(found), self.kind)

    def chunks(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """For each of these, number of tokens, their ids and their labels, each joined by spaces."""
        for found in self.id_chunks(text):
            ids = found.tolist()
            yield [(len(ids), " ".join(map(self.numbers.__getitem__, ids)), self.decode(ids))]


def _lower(text: str) -> str:
    """NFC, then lower case character by character: a final sigma is no special case."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


@lru_cache(maxsize=2)
def tokenizer(file: str) -> WordTokenizer:
    """Compiled once in each Python worker."""
    return WordTokenizer(file)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def token_digests(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; a null text is an empty one.

    The digests are taken as the tokens come, so a very long text is never held as tokens.
    ``file`` has to be at the same place on all executors. Other columns are not read.
    """
    plain = _texts(docs, doc_id, text)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(file)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
                for found in coder.chunks(value.as_py()):
                    counts, numbers, labels = zip(*found, strict=True)
                    gap = " " if n else ""
                    ids.update((gap + " ".join(numbers)).encode())
                    decoded.update((gap + " ".join(labels)).encode())
                    n += sum(counts)
                rows.append((n, ids.hexdigest(), decoded.hexdigest()))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return plain.mapInArrow(digest, schema).withColumnRenamed("doc_id", doc_id)


def encode(docs: DataFrame, file: str, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, *keep, ids, n_tokens, decoded) for every row: ids as an array, decoded as the words they stand for."""
    own = (doc_id, *keep)
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(own)), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [
                    np.concatenate([np.empty(0, np.int32), *coder.id_chunks(t.as_py())], dtype=np.int32, casting="unsafe")
                    for t in part.column(len(own))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array(found, pa.list_(pa.int32())),
                        pa.array([len(i) for i in found], pa.int64()),
                        pa.array([coder.text_of(i.tolist()) for i in found], pa.string()),
                    ],
                    names=[*(f"c{i}" for i in range(len(own))), "ids", "n_tokens", "decoded"],
                )

    kinds = (f"c{i} {plain.schema[i].dataType.simpleString()}" for i in range(len(own)))
    found = plain.mapInArrow(ids, ", ".join([*kinds, "ids array<int>, n_tokens long, decoded string"]))
    return found.toDF(*own, "ids", "n_tokens", "decoded")
