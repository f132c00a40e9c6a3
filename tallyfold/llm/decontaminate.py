"""Benchmark passages in documents, found by a prefix-filtered set join.

An item's words are cut into windows, each a set of word shingles with their offsets. A text
contains a window only if it has all of its shingles, so joining one of them, the necessary
prefix, loses nothing. It is the window's rarest: shingles are ordered by how often the whole
corpus has them, and a window with a shingle that the corpus lacks is gone. A shared prefix
shingle fixes where the window would have to start, and that place has to lie inside the
text. What is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import Scratch
from tallyfold.llm.words import NOT_ALPHANUMERIC, lower_ascii, with_shingles, words_between

WINDOW = 13
SHINGLE = 5
#: Shingles of the benchmark that are sent to all executors to pick out places in texts, eight
#: bytes each. A benchmark with more is joined by shuffling all places.
MAX_SENT = 50_000


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(window, words, hashes, items): each distinct window once, with the items that have it."""
    words = words_between(lower_ascii(F.col("text")), NOT_ALPHANUMERIC)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    cut = items.select("item", "words", F.explode(starts).alias("start")).select(
        "item", F.slice("words", F.col("start"), window).alias("words")
    )
    found = cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.select(F.array_join("words", " ").alias("window"), F.size("words").alias("length"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), "items")


def _tokens(windows: DataFrame, width: int) -> DataFrame:
    """(window, length, items, offset, shingle); windows of fewer words are one shingle."""
    parts = []
    for size in range(1, width + 1):
        of_size = windows.where(F.col("length") == size if size < width else F.col("length") >= size)
        shingled = with_shingles(of_size, "hashes", size, "shingles")
        parts.append(shingled.select("window", "length", "items", F.lit(size).alias("size"), F.posexplode("shingles").alias("offset", "shingle")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _places(shingles: str, size: int, known: list[int] | None) -> Column:
    """Array of (at, size, shingle): the places of ``known`` shingles, or of all."""

    def place(s: Column, i: Column) -> Column:
        found = F.struct(i.alias("at"), F.lit(size).alias("size"), s.alias("shingle"))
        return found if known is None else F.when(s.isin(known), found)

    return F.filter(F.transform(shingles, place), lambda p: p.isNotNull())


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = SHINGLE, max_sent: int = MAX_SENT) -> DataFrame:
    """(doc_id, digest, n_words, hits, n_hit, items) for every row of ``docs`` (doc_id, text).

    ``benchmark`` has the columns item_id and text. ``hits`` lists the verified windows with
    the word they start at, ``n_hit`` counts the words inside any of them and ``items`` are
    the ids of their items, sorted as strings. A null text has no words; an item without
    words has no windows, one without an id is not listed. ``digest`` is the text's xxhash64.
    Rows are told apart by their place, so ids may be null or repeat. Other columns are not
    read. Only the words of texts that share a shingle with the benchmark are kept beyond the
    first pass.
    """
    scratch = Scratch(docs.sparkSession)
    # a window for each word, and a few shingles for each window: about one for each character
    characters = benchmark.agg(F.sum(F.char_length("text"))).first()[0]
    tokens = scratch.write(_tokens(_windows(benchmark, window), width), characters or 0)
    wanted = tokens.select("size", "shingle").distinct()
    sent = wanted.limit(max_sent + 1).collect()
    few = len(sent) <= max_sent
    sizes = range(1, width + 1) if not few else sorted({r["size"] for r in sent})

    words = words_between(lower_ascii(F.col("text")), NOT_ALPHANUMERIC)
    marked = docs.select("doc_id", F.xxhash64("text").alias("digest"), words.alias("words"))
    marked = marked.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    places = [F.array().cast("array<struct<at: int, size: int, shingle: bigint>>")]
    for size in sizes:
        marked = with_shingles(marked, "hashes", size, f"shingles{size}")
        places.append(_places(f"shingles{size}", size, [r.shingle for r in sent if r["size"] == size] if few else None))
    marked = marked.withColumn("places", F.concat(*places))
    facts = scratch.write(
        marked.select(
            "doc_id",
            "digest",
            F.size("words").alias("n_words"),
            "places",
            F.when(F.size("places") > 0, F.col("words")).alias("words"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    matches = facts.select("row", "n_words", F.inline("places"))
    if not few:
        matches = scratch.write(matches.join(wanted, ["size", "shingle"]))

    counts = matches.groupBy("size", "shingle").agg(F.count("*").alias("n_corpus"))
    rarity = tokens.join(counts, ["size", "shingle"], "left")
    prefix = rarity.groupBy("window").agg(
        F.min(F.struct("n_corpus", "offset", "size", "shingle", "length", "items")).alias("p"), F.count("n_corpus").alias("seen"), F.count("*").alias("all")
    ).where("seen = all")
    prefix = scratch.write(prefix.select("window", "p.offset", "p.size", "p.shingle", "p.length", "p.items"), tokens.count())

    start = F.col("at") - F.col("offset")
    bounded = matches.join(prefix, ["size", "shingle"]).where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    candidates = bounded.groupBy("row").agg(F.collect_set(F.struct(start.alias("start"), "length", "window", "items")).alias("candidates"))
    compared = facts.where("words is not null").select("row", "words").join(candidates, "row")
    same = F.filter("candidates", lambda c: F.array_join(F.slice("words", c["start"] + 1, c["length"]), " ") == c["window"])
    verified = scratch.write(compared.select("row", same.alias("hits")), facts.count())

    none = F.array().cast(verified.schema["hits"].dataType)
    found = facts.select("row", "doc_id", "digest", "n_words").join(verified, "row", "left").withColumn("hits", F.coalesce("hits", none))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return found.select("doc_id", "digest", F.col("n_words").cast("long").alias("n_words"), "hits", F.size(covered).cast("long").alias("n_hit"), items.alias("items"))


def is_contaminated(share: int = 20):
    """Whether at least one word in ``share`` is inside a benchmark window."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
