import random
from collections import Counter

import numpy as np
import pytest

from tallyfold.llm import suffixes


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return out


def passages(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 900))) for _ in range(20)]
    texts = []
    for _ in range(80):
        text = ""
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(base)
            at = rng.randint(0, len(part))
            text += part[at : at + rng.randint(100, 600)] + rng.choice(["", "x", "yz"])
        texts.append(text)
    long = "".join(rng.choice("ab") for _ in range(suffixes.PIECE + 900))
    return texts + ["a" * 1000, "ab" * 300, None, "", "b" * 199, "c" * 200, "c" * 200, "d" * 201, base[0], base[0], long, long[300:]]


@pytest.mark.parametrize(("length", "bucket_rows"), [(200, suffixes.BUCKET_ROWS), (150, suffixes.BUCKET_ROWS), (200, 3)])
def test_removes_what_a_count_of_all_strings_removes(docs, length, bucket_rows):
    texts = passages(length)
    found = suffixes.without_repeats(docs(texts), length, bucket_rows=bucket_rows).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found}
    wanted = slow(texts, length)
    assert [i for i in range(len(texts)) if got[i] != wanted[i]] == []
    assert sum(w[1] for w in wanted) > 10_000


def test_repeated_rows_and_null_ids_count_as_places(docs):
    text = "".join(random.Random(2).choice("abcdef") for _ in range(400))
    found = suffixes.without_repeats(docs([(1, text), (1, text), (None, text), (None, "z" * 199)])).collect()
    assert sorted(r.n_removed for r in found) == [0, 400, 400, 400]
    assert suffixes.without_repeats(docs([])).count() == 0
    with pytest.raises(ValueError):
        suffixes.without_repeats(docs([text]), 2 * suffixes.Q - 1)


def test_refinement_numbers_equal_strings_alike():
    data = np.frombuffer(bytes(random.Random(4).choices(b"ab", k=3000)), np.uint8)
    starts = np.arange(len(data) - 29)
    number = suffixes.refine(data, starts, 30)
    strings = [bytes(data[i : i + 30]) for i in starts]
    assert len(set(zip(number.tolist(), strings, strict=True))) == len(set(strings)) == len(set(number.tolist()))
