"""Operators made of column expressions, against plain Python."""

import hashlib
import inspect
import random
import re

import pytest

from tallyfold.llm import decontaminate, licenses, quality, queries, surrogates, urls

NATIVE = [decontaminate, quality, licenses, surrogates, urls]


@pytest.mark.parametrize("module", NATIVE)
def test_no_python_runs_on_executors(module):
    assert not re.search(r"udf|mapIn|applyIn|\.rdd|pandas|pyarrow", inspect.getsource(module))


def alnum(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def hits_of(texts, items, window=13):
    out = []
    for text in texts:
        words, hit, found = alnum(text), set(), set()
        for item, passage in items:
            own = alnum(passage)
            size = min(window, len(own))
            parts = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1):
                if own and tuple(words[i : i + size]) in parts:
                    hit.update(range(i, i + size))
                    found.add(str(item)) if item is not None else None
        out.append((len(words), len(hit), sorted(found)))
    return out


def test_benchmark_hits(spark, docs):
    rng = random.Random(8)
    words = lambda n, of="abcdefgh": [rng.choice(of) * rng.randint(1, 2) for _ in range(n)]
    long = words(30, "ijklmnop")
    items = [(10, " ".join(long)), (9, "Short one, É"), (2, "x"), (2, "é x y z"), (7, " ".join(words(13, "qr"))), (None, "null item words here too"), (8, None), (6, "--"), (11, " ".join(long))]
    texts = [None, "", "x", "a Short-ONE é b", "null item words here too", " ".join(long[:12]), " ".join(long[3:17]), "É X y z x"]
    texts += [" ".join(words(50) + long[i : i + 20] + words(20)) for i in range(5)]
    texts += [" ".join(words(rng.randint(1, 60), "qr")) for _ in range(15)] + [" ".join(words(3000) + long)] + [texts[4]] * 3
    benchmark = spark.createDataFrame([(i, t, "doc") for i, t in items], "item_id long, text string, doc string")
    for limit in (0, 1000):  # joined by shuffling, and picked out in place
        found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.benchmark_hits(docs(texts), benchmark, max_sent=limit).collect()}
        assert found == dict(enumerate(hits_of(texts, items)))
    assert decontaminate.benchmark_hits(docs(texts), benchmark.where("false")).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.benchmark_hits(docs([]), benchmark).count() == 0
    twice = decontaminate.benchmark_hits(docs([(1, "x"), (1, "x"), (1, "q"), (None, "x")]), benchmark).collect()
    assert sorted(r.n_hit for r in twice) == [0, 1, 1, 1]


def test_quality_figures(spark, docs):
    texts = [None, "", " \n", "a b c a b c", "a a a a", "x y\nx y\n\nz #*\nx y", "é 1\t2 <|>", "w " * 4000, " ".join(str(i % 900) for i in range(5000))]
    for r in quality.quality(docs(texts)).collect():
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {g: grams.count(g) for g in set(grams)} if len(set(grams)) < 1000 else {}
        again = {p for i, g in enumerate(grams) if seen.get(g, 0) > 1 for p in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        figures = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
    assert quality.quality(docs([])).count() == 0


def test_shared_lines_deplete_documents_but_copies_do_not(docs):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(abs(i))) + "n" * (i < 0)
    own = lambda i: " ".join(f"w{word(i)}x{word(k)}" for k in range(60))
    menu = " ".join(f"m{word(k)}" for k in range(100))
    texts = [f"{own(i)}\n{menu}" for i in range(30)] + [f"{own(i)}\n{menu.upper()}\n{own(-i)}" for i in range(30, 60)] + [own(99)] * 50
    found = {r.doc_id: r for r in quality.quality(docs(texts)).collect()}
    assert [found[i].kept for i in range(110)] == [False] * 30 + [True] * 80
    assert {found[i].n_lost_words for i in range(60)} == {100} and found[109].n_lost_words == 0


def test_licenses(docs):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit")
    broken = mit.split()
    broken[8] = "CHANGED and"
    texts = [None, "", "CC-BY cc by cc, by", "General Public License; all rights reserved.", "general public", "a " * 3000 + mit, "x " + " ".join(broken) + " y",
             " ".join(mit.split()[:6]), " ".join(reversed(mit.split())), "cc by" + " q" * 2000 + " cc by"]
    found = {r.doc_id: r for r in licenses.scan_licenses(docs(texts)).collect()}
    phrases = {i: {p["label"]: (p["n"], p["first"], p["last"]) for p in r.phrases} for i, r in found.items()}
    assert phrases[2] == {"cc-by": (3, 0, 4)} and phrases[3] == {"gpl": (1, 0, 0), "reserved": (1, 3, 3)}
    assert phrases[9] == {"cc-by": (2, 0, 2002)} and not any(phrases[i] for i in (0, 1, 4, 5, 6, 7, 8))
    spans = {i: [(s["label"], s["start"]) for s in r.spans or []] for i, r in found.items()}
    assert spans[5] == [("mit", 3000)] and spans[6] == [("mit", 1)] and not any(spans[i] for i in (0, 1, 2, 3, 4, 7, 8, 9))
    assert found[5].score == 1.0 and 0.8 <= found[6].score < 1 and found[7].score == 0.0
    assert licenses.scan_licenses(docs([])).count() == 0


def test_licenses_that_differ_by_a_word(docs):
    """The license whose words are there in order, not one that lacks or adds a word."""
    cc = "This work is licensed under a Creative Commons {} 4.0 International License"
    texts = [cc.format(kind) for kind in ("Attribution", "Attribution-ShareAlike", "Attribution-NonCommercial", "Attribution-NoDerivatives", "Attribution-NonCommercial-ShareAlike")]
    gpl = next(t for label, t in licenses.TEMPLATES if label == "gpl")
    words = gpl.replace("/", " ").split()
    scattered = " ".join(w + (" foreign" if i % 8 == 7 else "") for i, w in enumerate(words))
    texts += [gpl, scattered, gpl.replace("General Public", "Lesser General Public"), f"{texts[2]} and {texts[0]}", " ".join(words[14:] + words[:14])]
    found = {r.doc_id: r for r in licenses.scan_licenses(docs(texts)).collect()}
    labels = {i: [s["label"] for s in r.spans or []] for i, r in found.items()}
    assert [labels[i] for i in range(5)] == [["cc-by"], ["cc-by-sa"], ["cc-by-nc"], ["cc-by-nd"], ["cc-by-nc-sa"]]
    assert labels[5] == ["gpl"] and labels[6] == ["gpl"] and labels[7] == ["lgpl"] and labels[8] == ["cc-by", "cc-by-nc"]
    assert "gpl" not in labels[9]
    assert [s["score"] for s in found[5].spans] == [1.0]
    assert found[6].spans[0]["score"] == pytest.approx(1 - ((len(words) - 1) // 8) / len(words))


def test_alignment_against_plain_python(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choices("abcd", k=rng.randint(0, 12))), "".join(rng.choices("abcd", k=rng.randint(1, 9)))) for _ in range(150)]

    def plain(own, words):
        best, row = 0, [0] * (len(words) + 1)
        for w in own:
            new = [0]
            for j, t in enumerate(words):
                new.append(max(new[-1], row[j] + 1 if t == w else 0, row[j + 1] - 1))
            row, best = new, max(best, *new)
        return best

    df = spark.createDataFrame([(i, list(a), list(b)) for i, (a, b) in enumerate(pairs)], "i int, own array<string>, words array<string>")
    found = {r.i: r.n for r in df.select("i", licenses.aligned_words("own", "words", 9).alias("n")).collect()}
    assert found == {i: plain(*pair) for i, pair in enumerate(pairs)}


def test_surrogates_keep_format_identity_and_everything_else(docs):
    text = 'Mail A.92@MAIL2.EXAMPLE.COM, a.92@mail2.example.com; +1 (310) 555-4510, 4465758382889437 4465758382889437 token = "1eb9c654e721b4f812088970e66a6345cee33dd0", 2.195.74.112.'
    names = "Mrs. Anna Meyer met Mr Meyer. Г-жа Анна Петрова"
    rows = [(1, text), (2, names), (3, None), (4, ""), (5, "nothing é here\n"), (None, "see 2.195.74.112"), (None, "see 2.195.74.112")]
    given = docs(rows)
    replaced = surrogates.replace_entities(given, "k")
    assert replaced.columns == [*given.columns, "n_entities"]
    found = {r.doc_id: r.text for r in replaced.collect()}
    assert replaced.count() == 7 and [found[i] for i in (3, 4, 5)] == [None, "", "nothing é here\n"]
    shape = re.fullmatch(
        r'Mail ([A-Z]\.\d\d@[A-Z]{4}\d\.[A-Z]{7}\.EXAMPLE), ([a-z]\.\d\d@[a-z]{4}\d\.[a-z]{7}\.example); \+1 \(\d{3}\) \d{3}-\d{4}, (\d{16}) (\d{16}) token = "[0-9a-f]{40}", ((?:\d+\.){3}\d+)\.',
        found[1],
    )
    assert shape and shape[1].lower() == shape[2] and shape[3] == shape[4] and found[None] == f"see {shape[5]}"
    person = re.fullmatch(r"Mrs\. ([A-Z][a-z]+lia) ([A-Z][a-z]+) met Mr ([A-Z][a-z]+)\. Г-жа [А-Я][а-я]+рина [А-Я][а-я]+рина", found[2])
    assert person and person[2] == person[3] and "Meyer" not in found[2]
    assert not any(x in found[1] for x in ("4465758382889437", "555-4510", "mail2", "1eb9c654", "2.195.74.112"))
    other = {r.doc_id: r.text for r in surrogates.replace_entities(given, "another key").collect()}
    assert other[1] != found[1]
    assert surrogates.replace_entities(docs([]), "k").count() == 0


def test_surrogates_hold_what_their_kind_promises(docs):
    """Countries of phone numbers, check digits, capitals; one entity in several spellings has one surrogate."""
    cards = ["4465 7583 8288 9437", "4465758382889437", "5500-0000-0000-0004", "378282246310005"]
    accounts = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432"]
    phones = ["+1 310 555 4510", "+13105554510", "+1 (310) 555-4510", "+44 20 7946 0958", "+442079460958", "+420 601 123 456"]
    emails = ["John.Doe@Example.com", "john.doe@example.com", "JOHN.DOE@EXAMPLE.COM"]
    mentions = cards + accounts + phones + emails
    given = docs([(i, f"see {m}, now") for i, m in enumerate(mentions)])
    found = {r.doc_id: re.fullmatch("see (.*), now", r.text)[1] for r in surrogates.replace_entities(given, "k").collect()}
    made = {m: found[i] for i, m in enumerate(mentions)}
    digits = {m: re.sub("[^0-9A-Z]", "", v) for m, v in made.items()}
    assert all(made[m] != m and len(made[m]) == len(m) for m in cards + accounts + phones)
    assert all(re.sub("[0-9]", "0", made[m]) == re.sub("[0-9]", "0", m) for m in cards + phones)
    for m in cards:
        each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits[m]))]
        assert sum(d - 9 if d > 9 else d for d in each) % 10 == 0
    for m in accounts:
        turned = digits[m][4:] + digits[m][:4]
        assert int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 and made[m][:2] == m[:2]
    assert digits[cards[0]] == digits[cards[1]] and digits[accounts[0]] == digits[accounts[1]]
    assert digits[phones[0]] == digits[phones[1]] == digits[phones[2]] != digits[phones[3]] == digits[phones[4]]
    assert digits[phones[0]][0] == "1" and digits[phones[3]][:2] == "44" and digits[phones[5]][:3] == "420"
    mixed, low, loud = (made[m] for m in emails)
    assert mixed.lower() == low == loud.lower() and loud == low.upper()
    assert re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}@[A-Z][a-z]{6}\.example", mixed)


def test_every_kind_has_a_hint(spark):
    """What has no hint is not looked at: texts of every kind, some without a digit."""
    mentions = ["a@b.cc", "abcdef" * 6, "ABCDEF" * 6, "AKIA" + "B" * 16, "ghp_" + "b" * 36, "sk-" + "c" * 20, "DE89 3704 0044 0532 0130 00",
                "4465 7583 8288 9437", "+1 (310) 555-4510", "078-05-1120", "2.195.74.112", "Mr. Meyer", "Ms Meyer", "Mrs Ab Cd", "Herr Müller",
                "Frau Weiß", "Monsieur Petit", "Madame Petit", "Señor Gil", "Señora Gil", "Г-н Петров", "Г-жа Петрова"]
    given = spark.createDataFrame([(i, f"x {m}, y") for i, m in enumerate(mentions)], "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_entities) for r in surrogates.replace_entities(given, "k").collect()}
    assert [m for i, m in enumerate(mentions) if found[i][1] != 1 or m in found[i][0]] == []


def test_colliding_surrogates_are_made_again(spark):
    """More short addresses at one domain than letters: distinct all the same."""
    from tallyfold.llm.scratch import Scratch

    values = [("email", f"{chr(c)}@b.cc") for c in [*range(97, 123), *range(0xE0, 0xF7)]]
    known = surrogates.entity_map(spark.createDataFrame(values, "kind string, value string"), "k", Scratch(spark)).collect()
    assert len(known) == len({r.surrogate for r in known}) == len(values)
    assert not {r.surrogate for r in known} & {v for _, v in values}


def test_addresses_of_any_script_are_replaced_and_shapes_do_not_run_out(spark):
    """Letters and digits of other scripts go too; more entities than a shape has values still end distinct."""
    from pyspark.sql import functions as F

    from tallyfold.llm.scratch import Scratch

    scripts = ["محمد@بريد.شبكة", "अमर@घर.भारत", "สมชาย@บาน.ไทย", "անի@տուն.հայ", "ნინო@სახლი.გე", "ꦲꦤ@ꦱꦭ.ꦲꦤ", "ёж@ёж.ру", "٣٤٥@٦٧.example", "Ⅷ½@²².cc"]
    rows = spark.createDataFrame([("email", v) for v in scripts], "kind string, value string")
    made = {r.value: r.surrogate for r in surrogates.with_surrogates(rows.withColumn("attempt", F.lit(0)), "k").collect()}
    parts = lambda v: (v.split("@")[0], v.split("@")[1].rsplit(".", 1)[0])
    assert [v for v in scripts if any(a == b for a, b in zip(parts(v), parts(made[v]), strict=True))] == []
    assert all(len(a) == len(b) for v in scripts for a, b in zip(parts(v), parts(made[v]), strict=True))
    digits = [f"{a}@{b}.{top}" for a in range(10) for b in range(10) for top in ("cc", "dd")]
    values = [("email", v) for v in [*scripts, *digits, "محمد@بريد.دار", "محمد@بريد.example", "+@-.cc", "+@-.dd", "+@-.example"]]
    values += [("ssn", v) for v in ("078051120", "078051121")]
    known = surrogates.entity_map(spark.createDataFrame(values, "kind string, value string"), "k", Scratch(spark)).collect()
    assert len(known) == len({r.surrogate for r in known}) == len(values)
    assert not {r.surrogate for r in known} & {v for _, v in values}
    # a number that has grown keeps the digits that its mention's format has no place for
    late = spark.createDataFrame([("ssn", "078051120", 10, "078-05-1120"), ("phone", "+1 3105554510", 9, "+1 (310) 555-4510")], "kind string, value string, attempt int, mention string")
    worn = {r.kind: r.worn for r in surrogates.with_surrogates(late, "k").select("kind", surrogates.dressed(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("worn")).collect()}
    assert re.fullmatch(r"\d{3}-\d\d-\d{6}", worn["ssn"]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{5}", worn["phone"])


RULES = queries.URL_RULES


def test_urls_by_rule(spark):
    urls_in = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "http://example.org", "http://x.org/q://y", "https://é.com/fr/x?y#z", "http://com/de/1", "http://notcom/de/1", "http://a.com#/de/", "http://example.org/en/19", "a://b?c"]
    rows = [(i, u, "x") for i, u in enumerate(urls_in)] + [(0, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, RULES).collect()}
    assert found == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("a.example.org", "/es/1", "example.org/es/", "block"), 5: ("example.org", "", None, "allow"),
        6: ("x.org", "/q://y", "org/", "allow"), 7: ("é.com", "/fr/x", "com/fr/", "allow"), 8: ("com", "/de/1", "com/de/", "block"),
        9: ("notcom", "/de/1", None, "allow"), 10: ("a.com", "", None, "allow"), 11: ("example.org", "/en/19", "example.org/en/1", "block"),
        12: ("b", "", None, "allow"),
    }
    assert urls.judge(pages, RULES).count() == 14 and urls.judge(pages.where("false"), RULES).count() == 0


def test_pure_templates_are_rejected_and_similar_branches_merged(spark):
    rows = [f"http://h.com/{s}/{i}/a" for i in range(60) for s in ("ads", "news", "blog")] + ["http://h.com/ads/x/b"] * 3
    rules = [("block", "h.com", f"/ads/{d}") for d in "123456789"] + [("allow", "h.com", f"/{s}/{d}") for s in ("news", "blog") for d in "12345"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    found = urls.judge(pages, rules).collect()
    assert {r.template for r in found if "/ads/" in r.path} == {"/ads/*/a", "/ads/x/b"}
    assert {r.template for r in found if "/news/" in r.path} == {r.template for r in found if "/blog/" in r.path} == {"/*-/*/a"}
    assert {r.verdict for r in found if r.path.startswith("/ads/0")} == {"block"}
    assert {r.verdict for r in found if r.path.startswith("/news/9")} == {"allow"}


def judged(spark, paths, rules):
    pages = spark.createDataFrame([(i, f"http://h.com{p}") for i, p in enumerate(paths)], "page_id long, url string")
    found = urls.judge(pages, rules).collect()
    return {r.path: r for r in found}


def test_templates_go_as_deep_as_paths(spark):
    deep = "/a/b/c/d/e/f/g"
    paths = [f"{deep}/{kind}/{i}/x" for i in range(60) for kind in ("spam", "good")]
    rules = [("block", "h.com", f"{deep}/spam/{d}") for d in "1234"] + [("allow", "h.com", f"{deep}/good/{d}") for d in "1234"]
    found = judged(spark, paths, rules)
    assert found[f"{deep}/spam/50/x"].template == f"{deep}/spam/*/x"
    assert {r.verdict for p, r in found.items() if "/spam/" in p} == {"block"}
    assert {r.verdict for p, r in found.items() if "/good/" in p} == {"allow"}


def test_branches_without_labels_are_not_blocked_with_others(spark):
    paths = [f"/{lang}/{i}" for i in range(12) for lang in ("de", "en", "es")]
    found = judged(spark, paths, [("block", "h.com", "/de/")])
    assert {r.verdict for p, r in found.items() if not p.startswith("/de/")} == {"allow"}
    assert {r.template for p, r in found.items()} == {"/de/*", "/*?/*"}


def test_templates_of_one_long_path_take_one_round(spark):
    long = "/" + "/".join(f"s{chr(97 + i % 26)}" for i in range(3000))
    found = judged(spark, [long, long, "/x"], [])
    assert found[long].template == "/*?" + long[3:] and found["/x"].template == "/*?"
    assert judged(spark, [long], [])[long].template == long


def quality_rows(docs, host_size):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    own = lambda i: " ".join(f"w{word(i)}x{word(k)}" for k in range(60))
    menu = " ".join(f"m{word(k)}" for k in range(100))
    texts = [f"\n{own(i)}\n{menu}\n\nend {word(i)}" for i in range(90)] + [own(i) for i in range(90, host_size)]
    return texts, menu, {r.doc_id: r for r in quality.quality(docs(texts), with_text=True).collect()}


@pytest.mark.parametrize("host_size", [100, 2000])
def test_lines_go_whatever_the_size_of_their_host(docs, host_size):
    texts, menu, found = quality_rows(docs, host_size)
    assert len(found) == host_size
    for i, text in enumerate(texts):
        assert found[i].n_lost_words == (100 if i < 90 else 0)
        assert found[i].kept == (i >= 90)
        assert found[i].cleaned == "\n".join(x for x in text.split("\n") if x != menu)


def test_cleaned_texts_of_odd_rows(docs):
    found = {r.doc_id: r.cleaned for r in quality.quality(docs([None, "", " \n", "a\n\nb"]), with_text=True).collect()}
    assert found == {0: "", 1: "", 2: " \n", 3: "a\n\nb"}


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
