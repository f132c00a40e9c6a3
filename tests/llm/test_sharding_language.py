import binascii
import random

import numpy as np
import pytest

from tallyfold.llm import language, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000, 5000])
def test_permutation_and_its_inverse(n):
    to = sharding.permuted(np.arange(n), n)
    assert sorted(to) == list(range(n))
    assert (sharding.row_at(to % 7, to // 7, n, 7) == np.arange(n)).all()
    if n > 60:
        assert abs(np.corrcoef(np.arange(n), to)[0, 1]) < 0.25 and (sharding.permuted(np.arange(n), n, 1) != to).any()


def test_shards_are_even_gapless_and_reproducible(docs):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "é", "text", "x" * 5000])) for _ in range(500)] + [(7, "same")] * 300
    found = sharding.shard(docs(rows), shards=9).collect()
    assert sorted(r.row for r in found) == list(range(800))
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == 9 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {(r.doc_id, r.size, r.text_crc32) for r in found}
    assert texts == {(i, len((t or "").encode()) + 16, binascii.crc32((t or "").encode())) for i, t in rows}
    rng.shuffle(rows)
    again = sharding.shard(docs(rows).repartition(7), shards=9).collect()
    assert sorted((r.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in again) == sorted((r.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in found)
    assert sharding.shard(docs([])).count() == 0


def speak(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_languages_are_learnt_from_training_rows_only(spark):
    rng = random.Random(11)
    letters = {"aa": "abcdeé", "bb": "abcxyz", "cc": "жзиклм"}
    rows = [(i, speak(rng, letters[lang], rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choice(sorted(letters)) for _ in range(400))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 ?!", "bb"), (903, speak(rng, "жзи", 9000), None), (None, speak(rng, "abcdeé", 50), "aa"), (5, rows[5][1], "zz")]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: i is not None and binascii.crc32(str(i).encode()) % 4 == 2
    found = language.identify_languages(given).collect()
    assert len(found) == len(rows) and all(r.held_out == held(r.doc_id) for r in found)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, r)
    assert [(by[i].lang_pred, by[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903].lang_pred == "cc"
    fresh = [(by[i].lang_pred, lang) for i, _, lang in rows[:400] if held(i)]
    assert sum(a == b for a, b in fresh) >= 0.97 * len(fresh)
    assert all(0 <= r.score <= 1 for r in found)
    # labels of held-out rows teach nothing
    swapped = [(i, t, "qq" if held(i) else lang) for i, t, lang in rows]
    other = language.identify_languages(spark.createDataFrame(swapped, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id or -1, r.lang_pred, r.score) for r in other) == sorted((r.doc_id or -1, r.lang_pred, r.score) for r in found)


def test_no_labels_and_no_rows(spark, docs):
    from pyspark.sql import functions as F

    assert language.identify_languages(docs([])).count() == 0
    unlabelled = docs(["some words"]).withColumn("lang", F.lit(None).cast("string"))
    assert [r.lang_pred for r in language.identify_languages(unlabelled).collect()] == ["und"]


def test_pieces_do_not_change_the_counts(monkeypatch):
    text = "Ein Wort, ÉTÉ " * 50
    whole = language.bins(text)
    monkeypatch.setattr(language, "PIECE", 37)
    assert (language.bins(text) == whole).all()


def test_temperature_and_sparsity():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 500)
    logits = 8 * np.eye(3)[np.where(rng.random(500) < 0.8, labels, (labels + 1) % 3)]
    assert 2 < language.temperature(logits, labels) < 6
    rows = [(np.array([y, 3]), np.array([0.9, 0.1]), int(y)) for y in rng.integers(0, 2, 200)]
    w = language.train(rows, 2, 8)
    assert (w[:, 4:] == 0).all() and w[0, 0] > 0 > w[0, 1]


def test_copies_take_no_places_of_the_sample(spark, monkeypatch, tmp_path):
    """Every language trains on as many distinct texts as it has, up to its share, whatever copies there are."""
    rng = random.Random(4)
    rows = [(speak(rng, letters, 6), lang) for letters, lang in (("abcde", "aa"), ("vwxyz", "bb")) for _ in range(40)]
    rows += [("same same", "aa")] * 20_000 + [("12", "bb")] * 5000 + [("3 4", "cc")] * 10
    given = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    plain = language.train

    def counted(seen, classes, size):
        (tmp_path / f"{classes}-{sum(y == 0 for *_, y in seen)}-{sum(y == 1 for *_, y in seen)}").touch()
        return plain(seen, classes, size)

    monkeypatch.setattr(language, "train", counted)
    assert language.fit(given, max_trained=60, bits=8).languages == ("aa", "bb")
    classes, first, second = map(int, next(tmp_path.iterdir()).name.split("-"))
    assert classes == 2 and first + second == 60 - 12 and min(first, second) >= 30 - 12
