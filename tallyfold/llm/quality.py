"""Quality rules: figures of each text, and lines that many documents of a host share.

Lines are normalised and hashed. For each host and line the distinct texts that have it are
counted; lines over the limits are boilerplate and go, and a document that has lost too many
of its words with them is rejected. Copies of one text count once, so that a text is not
boilerplate because it was crawled often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import Scratch
from tallyfold.llm.words import SPACES, from_the, with_shingles, words_between

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Most words, in percent, that may be in three-word windows found twice.
MAX_REPEATED = 50
#: A line goes if more than ``MANY_TEXTS`` distinct texts of its host have it; in a small host if
#: more than this share of them do, and more than ``MAX_TEXTS``.
MANY_TEXTS = 50
MAX_TEXTS = 5
MAX_SHARE = 0.05
#: A document has to keep this share of its words.
MIN_KEPT = 0.5


def normalised_line(line: Column) -> Column:
    """Lower case, digits alike, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACES, " "), "[0-9]", "0"))


def _with_repeats(df: DataFrame) -> DataFrame:
    """``df`` with n_repeat_words, from the word hashes in ``hashes``: words in three-word windows found twice or more.

    Sorted by hash, equal windows are neighbours; their places, sorted again, give the words
    covered. Texts without a repeated window, most of them, skip that with empty arrays.
    """
    df = with_shingles(df, "hashes", 3, "grams")
    unique = F.size(F.array_distinct("grams")) == F.size("grams")
    df = df.withColumn("grams", F.when(unique, F.array().cast("array<bigint>")).otherwise(F.col("grams")))
    df = df.withColumn("sorted", F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    df = df.withColumn("later", from_the("sorted", 1))
    df = df.withColumn("same", F.zip_with("sorted", "later", lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))))
    df = df.withColumn("before", F.concat(F.array(F.lit(False)), F.col("same")))
    df = df.withColumn("again", F.zip_with("same", "before", lambda a, b: F.coalesce(a, F.lit(False)) | b))
    df = df.withColumn("marked", F.zip_with("sorted", "again", lambda s, a: F.when(a, s["i"])))
    df = df.withColumn("places", F.array_sort(F.filter("marked", lambda p: p.isNotNull())))
    df = df.withColumn("next", from_the("places", 1))
    covered = F.zip_with("places", "next", lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x)
    return df.withColumn("n_repeat_words", total).drop("grams", "sorted", "later", "same", "before", "again", "marked", "places", "next")


def quality(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED,
    max_texts: int = MAX_TEXTS,
    max_share: float = MAX_SHARE,
    min_kept: float = MIN_KEPT,
    many_texts: int = MANY_TEXTS,
    with_text: bool = False,
) -> DataFrame:
    """Figures and verdict for every row of ``docs`` (doc_id, text, source); other columns are not read.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; n_lost_words are the words of
    lines that are removed; base_failed by the text's own figures, kept if neither that nor
    depleted. ``with_text`` adds ``cleaned``, the text without those lines. A null text has no
    words and is empty when cleaned; rows without a source are one host. Rows are told apart by
    their place, so ids may be null or repeat.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), text.alias("text"))
    split = split.withColumn("words", words_between(F.col("text"), SPACES))
    every = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    split = split.withColumn("lines", F.filter(every, lambda l: l["x"].rlike(r"[^\x20\x09-\x0D]")))
    split = split.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(F.col("lines.x")))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.transform(
            "lines",
            lambda l: F.struct(
                F.xxhash64(normalised_line(l["x"])).alias("line"), F.size(words_between(l["x"], SPACES)).alias("n"), l["i"].alias("i")
            ),
        ).alias("lines"),
        *(["text"] if with_text else []),
    )
    facts = scratch.write(_with_repeats(split).drop("hashes").withColumn("row", F.monotonically_increasing_id()))

    lines = facts.select("row", "host", "digest", F.explode("lines").alias("l")).select("row", "host", "digest", "l.line", "l.n", "l.i")
    shared = lines.select("host", "line", "digest").distinct().groupBy("host", "line").agg(F.count("*").alias("texts"))
    hosts = facts.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("of"))
    of_host = (F.col("texts") > many_texts) | (F.col("texts") > max_share * F.col("of"))
    frequent = shared.where(F.col("texts") > max_texts).join(hosts, "host").where(of_host)
    gone = [F.collect_list("i").alias("gone")] if with_text else []
    lost = lines.join(scratch.write(frequent.select("host", "line")), ["host", "line"]).groupBy("row").agg(F.sum("n").alias("n_lost_words"), *gone)
    found = facts.join(lost, "row", "left").withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0).cast("long")))

    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    stays = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    cleaned = [F.array_join(stays, "\n").alias("cleaned")] if with_text else []
    depleted = F.col("n_words") - F.col("n_lost_words") < min_kept * F.col("n_words")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words",
        base.alias("base_failed"), (~base & ~depleted).alias("kept"), *cleaned,
    )
