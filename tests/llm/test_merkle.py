import hashlib

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def whole(rows):
    """Levels of each group's tree and of the upper one, of sorted (group, key, leaf, changed)."""
    names = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: [r for r in rows if r[0] == g] for g in names}
    trees = {g: tree([r[2] for r in members]) for g, members in groups.items()}
    return groups, trees, tree([trees[g][-1][0] for g in names]), names


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or ""))
    groups, trees, upper, names = whole(rows)
    out = []
    for g, members in groups.items():
        for i, (_, key, leaf, changed) in enumerate(members):
            new = [m[2] for m in members]
            new[i] = changed or leaf
            version = tree(new)
            top = tree([version[-1][0] if x == g else trees[x][-1][0] for x in names])
            proof, at = [], i
            for levels, at in ((trees[g], i), (upper, names.index(g))):
                for level in levels[:-1]:
                    start = at - at % 8
                    proof += [d for j, d in enumerate(level[start : start + 8], start) if j != at]
                    at //= 8
            copied = [
                d for new_levels, old in ((version, trees[g]), (top, upper)) for a, b in zip(new_levels[1:], old[1:], strict=True) for d in a if d not in b
            ]
            out.append((key, leaf, trees[g][-1][0], upper[-1][0], sha("".join(proof)), top[-1][0], copied if changed else None, proof))
    return sorted(out, key=str)


def run(spark, rows, **options):
    given = [(k, g, leaf, changed, "clash") for g, k, leaf, changed in rows]
    df = spark.createDataFrame(given, "key long, pos string, leaf string, changed string, tree string").repartition(3)
    out = merkle.versions(df.withColumnRenamed("key", "n"), "n", "pos", F.col("leaf"), F.col("changed"), with_proof=True, **options)
    return sorted([(r.n, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.copied, r.proof) for r in out.collect()], key=str)


def rows(sizes, changed=3):
    out = []
    for g, size in sizes.items():
        for i in range(size):
            out.append((g, i * 7 % (size + 1), sha(f"{g} {i}"), sha(f"new {g} {i}") if i % changed == 0 else None))
    return out


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_versions_equal_trees_built_anew(spark, levels):
    given = rows({None: 70, "": 1, "de": 8, "en": 129, "Ω": 9, "fr": 65})
    assert run(spark, given, levels=levels) == brute(given)


def test_many_groups_and_single_leaves(spark):
    given = rows({f"g{i}": 1 + i % 2 for i in range(70)}, changed=1)
    assert run(spark, given, levels=1) == brute(given)
    one = rows({None: 1})
    assert run(spark, one) == brute(one)
    assert run(spark, one)[0][6] == []  # a lone leaf is the root: its version copies no ancestor


def test_null_and_repeated_keys_and_rows(spark):
    same = [("a", 5, sha("x"), sha("y"))] * 10 + [("a", None, sha("z"), None), ("a", 1 << 60, sha("w"), None), ("a", (1 << 60) + 1, sha("v"), None)]
    assert run(spark, same) == brute(same)


def test_empty_table(spark):
    assert run(spark, rows({"a": 1})[:0]) == []


def test_a_version_shares_all_but_its_ancestors(spark):
    given = rows({"a": 600, "b": 3}, changed=50)
    for r in run(spark, given, levels=2):
        assert r[6] is None or len(r[6]) <= 4 + 1


def test_fields_tell_where_values_end(spark):
    df = spark.createDataFrame([(1, "é:1"), (None, "")], "a long, b string")
    got = [r[0] for r in df.select(F.concat(merkle.field(F.col("a")), merkle.field(F.col("b")))).collect()]
    assert got == ["1:14:é:1", "-0:"]
