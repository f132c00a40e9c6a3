"""Language identification by sparse logistic regression on TF-IDF character n-grams.

A text becomes the counts of its lower-case character 1- to ``N``-grams in hashed bins,
weighted by inverse document frequency and scaled to length one. One weight vector per
language is trained with follow-the-regularised-leader, whose L1 part keeps most weights at
exactly zero and whose L2 part keeps the rest small. A temperature, fitted on documents the
weights have not seen, makes the softmax a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.names import by_place, without
from tallyfold.llm.scratch import Scratch

N = 3
BITS = 14
#: Labelled documents trained on at most, and the share of them held back for the temperature.
MAX_TRAINED = 6000
CALIBRATED = 5
EPOCHS = 2
#: Follow the regularised leader: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Characters worked on at a time, so that memory does not grow with a text.
PIECE = 1 << 16
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def bins(text: str, bits: int = BITS) -> np.ndarray:
    """How often each bin of character n-grams occurs in the whole text."""
    counts = np.zeros(1 << bits, np.int64)
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE + N - 1].lower()
        points = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        grams = np.zeros(len(points), np.uint64)
        for n in range(N):
            if len(points) <= n:
                break
            grams = grams[: len(points) - n] * _STEPS[3] + (points[n:] + np.uint64(n + 1)) * _STEPS[n]
            # an n-gram that starts in the next piece is counted there
            own = grams[:PIECE] if at + PIECE < len(text) else grams
            mixed = (own ^ (own >> np.uint64(29))) * _STEPS[0]
            counts += np.bincount((mixed >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins that occur and their TF-IDF weights, scaled to length one."""
    counts = bins(text, int(idf.size).bit_length() - 1)
    there = np.flatnonzero(counts)
    weights = np.log1p(counts[there]) * idf[there]
    norm = np.sqrt((weights**2).sum())
    return there, weights / norm if norm else weights


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int) -> np.ndarray:
    """Weights (classes, bins) by FTRL-proximal, one document after another."""
    z, n = np.zeros((classes, size)), np.zeros((classes, size))

    def weights(there: np.ndarray) -> np.ndarray:
        zt = z[:, there]
        shrunk = np.sign(zt) * L1 - zt
        return np.where(np.abs(zt) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[:, there])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for there, x, label in rows:
            w = weights(there)
            p = _softmax(w @ x)
            p[label] -= 1
            g = p[:, None] * x
            before = n[:, there]
            sigma = (np.sqrt(before + g * g) - np.sqrt(before)) / ALPHA
            z[:, there] += g - sigma * w
            n[:, there] = before + g * g
    return weights(np.arange(size))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which the labels are likeliest, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0
    cost = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()
    low, high, ratio = -5.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if cost(a) <= cost(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class LanguageModel:
    """What is sent to the tasks: as many numbers as bins times languages, whatever the corpus."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and probability; ``und`` and 0 for a text without letters."""
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        there, x = features(text, self.idf)
        p = _softmax(self.weights[:, there] @ x / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(texts: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many texts of the column ``text`` each bin occurs, and the number of texts.

    Each task adds up its own texts first: a row per bin and task goes to the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    found += bins(text.as_py(), bits) > 0
                    n += 1
        at = np.r_[-1, np.flatnonzero(found)]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[n, found[at[1:]]])], names=["bin", "n"])

    rows = texts.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(1 << bits, np.int64)
    there = rows[rows.bin >= 0]
    found[there.bin] = there.n
    return found, int(rows.loc[rows.bin < 0, "n"].sum())


def fit(labelled: DataFrame, max_trained: int = MAX_TRAINED, bits: int = BITS) -> LanguageModel:
    """A model from rows (doc_id, text, lang); rows with a null text or language, or without letters, teach nothing.

    Document frequencies are counted over all rows. The weights are trained in one task on
    ``max_trained`` distinct texts at most, the same number of each language as far as it has them,
    chosen by a digest of the text.
    """
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    frequency, n = document_frequencies(rows, bits)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    scratch = Scratch(labelled.sparkSession)
    digest = F.xxhash64("text", F.lit("train"))

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(_LETTER.search(t.as_py())) for t in batch.column(2)], pa.bool_())).select([0, 1])

    # what a language can teach: its distinct texts, however many copies there are of one
    distinct = rows.select("lang", digest.alias("digest"), "text").mapInArrow(lettered, "lang string, digest long").distinct()
    keyed = scratch.write(distinct, n)
    sizes = {r.lang: r["count"] for r in keyed.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        scratch.drop(keyed)
        return LanguageModel((), idf, np.zeros((0, 1 << bits)), 1.0)
    of = {name: i for i, name in enumerate(languages)}
    share = max(1, max_trained // len(languages))
    # the least digests of each language, found without gathering a language in one task
    parts = {name: min(1.0, 1.2 * share / sizes[name]) for name in languages}
    while True:
        bound = F.lit(None).cast("long")
        for name in languages:
            upto = min(int(parts[name] * (1 << 64)) - (1 << 63), (1 << 63) - 1)
            bound = F.when(F.col("lang") == name, F.lit(upto)).otherwise(bound)
        got = {r.lang: r["count"] for r in keyed.where(F.col("digest") <= bound).groupBy("lang").count().collect()}
        short = [name for name in languages if got.get(name, 0) < min(share, sizes[name])]
        if not short:
            break
        parts |= {name: min(1.0, 2 * parts[name]) for name in short}
    scratch.drop(keyed)
    sample = rows.withColumn("digest", digest).where(F.col("digest") <= bound).dropDuplicates(["lang", "digest"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, lang, *features(t, idf)) for d, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if _LETTER.search(t)]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["digest", "lang", "bins", "weights"])

    def learn(key: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["digest", "lang"]).groupby("lang").head(share)
        seen = [(t, x, of[lang]) for t, x, lang in zip(part.bins, part.weights, part.lang, strict=True)]
        kept = [r for i, r in enumerate(seen) if i % CALIBRATED]
        back = [r for i, r in enumerate(seen) if not i % CALIBRATED]
        w = train(kept, len(languages), 1 << bits)
        logits = np.array([w[:, t] @ x for t, x, _ in back]).reshape(-1, len(languages))
        scale = temperature(logits, np.array([y for *_, y in back], np.int64))
        c, b = np.nonzero(w)
        return pd.DataFrame({"language": np.r_[-1, c], "bin": np.r_[-1, b], "weight": np.r_[scale, w[c, b]]})

    # texts become features where they are: what meets in one task is bounded by documents and bins
    sparse = sample.select("digest", "lang", "text").mapInArrow(featured, "digest long, lang string, bins array<long>, weights array<double>")
    one = sparse.withColumn("one", F.lit(1)).groupBy("one")
    learnt = one.applyInPandas(learn, "language long, bin long, weight double").toPandas()
    w, rest = np.zeros((len(languages), 1 << bits)), learnt[learnt.language >= 0]
    w[rest.language, rest.bin] = rest.weight
    scale = learnt.loc[learnt.language < 0, "weight"]
    return LanguageModel(languages, idf, w, float(scale.iloc[0]) if len(scale) else 1.0)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language of each whole text and its probability as two more columns.

    Nothing but the text is looked at. A null text or one without letters is ``und`` with score 0.
    Columns of ``docs`` that are called like the new ones give way to them.
    """
    docs = without(docs, *names)
    fields, at = docs.schema.fields, docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*(f"c{i}" for i in range(len(fields))), "language", "probability"],
            )

    plain = by_place(docs)
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "language string, probability double"])
    return plain.mapInArrow(predict, schema).toDF(*(f.name for f in fields), *names)


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, by a model of the labelled rows that are not held out."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(own.where(~held_out()))
    found = identify(own.select("doc_id", "text"), model)
    return found.select(F.col("doc_id").alias(doc_id), held_out().alias("held_out"), "lang_pred", "score")
