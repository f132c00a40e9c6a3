import random
import re

import pytest
import xxhash

from tallyfold.llm import simhash
from tallyfold.llm.components import components
from tallyfold.llm.scratch import Scratch


def slow_fingerprint(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def slow_components(prints, distance):
    """{id: smallest id reached} from {id: fingerprint}."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


TEXTS = [
    None, "", " \t\n", "one", "One two", "one two three four", "ONE TWO three four", "É É É É É", "x " * 5000,
    "one two three four five six seven eight nine ten", "one two three four five six seven eight nine Ten",
]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_the_majority_of_hashes(text):
    assert simhash.fingerprint(None if text is None else text.encode(), 4) == slow_fingerprint(text)


def test_groups_match_all_pairs(spark, docs):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(12)]
    texts = TEXTS + base + base[:4]
    for text in base:
        words = text.split()
        for _ in range(8):
            words[rng.randrange(60)] = "z"
            texts.append(" ".join(words))
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(texts)).collect()}
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fp % (1 << 64) for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == slow_components(prints, 4)


@pytest.mark.parametrize("cell_block", [simhash.CELL_BLOCK, 20])
def test_dense_groups_are_connected_without_all_pairs(spark, cell_block):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for f in list(prints)[:3]:
        for _ in range(80):
            prints.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [(f - (f >> 63 << 64),) for f in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 4, Scratch(spark), cell_block).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 4 for r in links)
    assert len(links) < len(prints) ** 2 / 4
    parent = {f: f for (f,) in signed}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        parent[root(r.a)] = root(r.b)
    wanted = slow_components({i: f % (1 << 64) for i, (f,) in enumerate(signed)}, 4)
    ids = {f: i for i, (f,) in enumerate(signed)}
    groups = lambda of: {frozenset(k for k in of if of[k] == v) for v in of.values()}
    assert groups({ids[f]: root(f) for (f,) in signed}) == groups(wanted)


def test_embedding_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 1000, np.uint64) for _ in range(2))
    below = np.bitwise_count(simhash._thermometers(a) ^ simhash._thermometers(b))
    assert (below <= np.bitwise_count(a ^ b)).all()
    popcounts = lambda f: [((f >> np.uint64(2 * i)) & np.uint64(1)) + ((f >> np.uint64(2 * i + 1)) & np.uint64(1)) for i in range(32)]
    manhattan = sum(abs(x.astype(int) - y.astype(int)) for x, y in zip(popcounts(a), popcounts(b), strict=True))
    assert (manhattan == below).all()


def test_components_of_a_path_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()
    assert {r.vertex: r.root for r in found} == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_one_row_of_each_group_stays(spark, docs):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "q r s t u"), (9, None), (8, "")]
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(3, "a b c d e"), (8, "")]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["q r s t u"]


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0
