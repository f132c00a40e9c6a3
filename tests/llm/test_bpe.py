import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyfold.llm import bpe

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def samples():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéßΣσςİıǅﬁ日本語한글العربية0123456789 \n\t'\"!?.,<|>_-  ​́😀👨‍👩‍👧"
    yield from ("", " ", "don't I'LL we've", "<|endoftext|>a<|startoftext|>É <|endoftext|>", "a" * 3000, "!" * 3000, "ΑΣ ΣΑ")
    for _ in range(1500):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        yield "".join(rng.choice("aehinorstl") for _ in range(rng.randint(1, 200)))


def test_ids_and_labels_match_the_library(library):
    coder = bpe.tokenizer(FILE)
    for text in samples():
        wanted = library.encode(text, add_special_tokens=False).ids
        found = [entry for chunk in coder.chunks(text) for entry in chunk]
        assert [int(i) for _, ids, _ in found for i in ids.split()] == wanted
        assert " ".join(labels for *_, labels in found) == library.decode(wanted, skip_special_tokens=False)


def test_words_come_back(library):
    coder = bpe.tokenizer(FILE)
    for text in ("Hello  World's 123 héllo !!!", "日本語 <|endoftext|> x"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.text_of(ids) == " ".join(coder.words(text))


def test_arcs_are_those_of_the_merges():
    """A small vocabulary: for every string, the automaton's path is what applying merges in order gives."""
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "b</w>"), ("b", "b"), ("ba", "ba")]
    symbols = ["a", "b", "a</w>", "b</w>", *(u + v for u, v in merges)]
    automaton = bpe.Automaton({s: i for i, s in enumerate(symbols)}, merges, "</w>")
    rng = random.Random(3)
    for _ in range(2000):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        tokens = [*word[:-1], word[-1] + "</w>"]
        for u, v in merges:
            at = 0
            while at + 1 < len(tokens):
                if tokens[at : at + 2] == [u, v]:
                    tokens[at : at + 2] = [u + v]
                at += 1
        assert [symbols[i] for i in automaton.path(word)] == tokens


def test_every_row_gets_its_digests(docs, library):
    import hashlib

    texts = [None, "", "Some words.", "Some words.", "x y " * 40_000]
    for r in bpe.token_digests(docs(texts), FILE).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.token_digests(docs([]), FILE).count() == 0
    assert bpe.encode(docs([(None, None)]), FILE, keep=("lang",)).first() == (None, "en", [], 0, "")


def test_a_worker_keeps_words_in_few_bytes(library):
    import sys

    coder = bpe.WordTokenizer(FILE)
    text = " ".join("".join(random.Random(i).choices("aehinorstl", k=9)) for i in range(2000))
    ids = [i for found in coder.id_chunks(text) for i in found.tolist()]
    assert ids == library.encode(text, add_special_tokens=False).ids
    held = [sum(map(sys.getsizeof, v)) + sys.getsizeof(v) if isinstance(v, tuple) else sys.getsizeof(v) for v in coder.kept.values()]
    assert len(held) == 2000 and max(held) < 64  # a tuple alone is as large
