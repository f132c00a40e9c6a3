"""A Merkle tree over the rows of a dataset, and versions of it that share what is not touched.

Rows are leaves; leaves of one group (a language) make a tree of ``FANOUT`` children a node,
and the groups' tops make one more tree, up to the root. A changed leaf makes a version of the
tree by path copying: new nodes for the leaf and its ancestors only, all others are shared.

Nodes are numbered from 0 in each level of a tree. An aligned block is what stands below one
node ``levels`` levels up, so a task has a whole block, of ``FANOUT ** levels`` nodes at most,
and works out its inner levels. The blocks' tops are the nodes of the next, much smaller
table, and so on up to the root: a few passes, each distributed. Then the same tables are gone
down: a block is told the path from its top to the root, with the siblings on the way, and
makes of it the paths of its own nodes, on which its leaves' versions go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.groups import with_groups
from tallyfold.llm.scratch import Scratch
from tallyfold.llm.sharding import numbered

#: Fixed value: children of a node.
FANOUT = 8
#: Inner levels of an aligned block: 4,096 leaves.
LEVELS = 4

#: The steps from a node to the top: its place among its siblings, and all of the run's digests.
_PATH = "path array<struct<place: int, run: array<binary>>>"
_NODE = "tree long, pos long, n long, digest binary"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts put together, as lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """A value as text that tells where it ends: its UTF-8 bytes' count, a colon, the value; a dash for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def _inner(nodes: list[bytes], n: int, levels: int) -> list[list[bytes]]:
    """A block level by level, ``nodes`` first; ``n`` nodes of the whole tree are on their level."""
    out = [nodes]
    while n > 1 and len(out) <= levels:
        last = out[-1]
        out.append([_hash(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
        n = -(-n // FANOUT)
    return out


def _steps(inner: list[list[bytes]], i: int) -> list[tuple[int, list[bytes]]]:
    """The path of the block's node ``i`` up to the block's top."""
    out = []
    for level in inner[:-1]:
        start = i - i % FANOUT
        out.append((i % FANOUT, level[start : start + FANOUT]))
        i //= FANOUT
    return out


def copied(path: Sequence[tuple[int, Sequence[bytes]]], leaf: bytes) -> list[bytes]:
    """The version that a changed leaf makes: the digests of its copied ancestors, bottom up; nothing else is new."""
    out = []
    for place, run in path:
        leaf = _hash([*run[:place], leaf, *run[place + 1 :]])
        out.append(leaf)
    return out


def _siblings(path: Sequence[tuple[int, Sequence[bytes]]]) -> list[bytes]:
    return [d for place, run in path for i, d in enumerate(run) if i != place]


def _upwards(nodes: DataFrame, levels: int, scratch: Scratch) -> list[DataFrame]:
    """Tables of (tree, pos, n, digest), from ``nodes`` to the one that has a single node for each tree."""

    def top(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        inner = _inner(list(block["digest"]), n, levels)
        for _ in inner[1:]:
            n = -(-n // FANOUT)
        return pd.DataFrame(
            {"tree": block["tree"].iloc[:1].to_numpy(), "pos": block["pos"].iloc[:1].to_numpy() // FANOUT**levels, "n": [n], "digest": inner[-1]}
        )

    tables = [nodes]
    while True:
        below = tables[-1].select("tree", "pos", "n", "digest")
        grouped = below.groupBy("tree", _block(levels))
        tables.append(scratch.write(grouped.applyInPandas(top, _NODE)))
        if (tables[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return tables


def _block(levels: int) -> Column:
    return F.expr(f"pos div {FANOUT**levels}").alias("block")


def _downwards(tables: list[DataFrame], tops: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """(tree, pos, path, subroot, root) of the first table's nodes, from ``tops``, those of the table above the last."""

    def paths(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        inner = _inner(list(nodes["digest"]), int(nodes["n"].iloc[0]), levels)
        rest = _path(above["path"].iloc[0])
        out = [_steps(inner, i) + rest for i in range(len(nodes))]
        return pd.DataFrame(
            {
                "tree": nodes["tree"].to_numpy(),
                "pos": nodes["pos"].to_numpy(),
                "path": [[{"place": p, "run": r} for p, r in path] for path in out],
                "subroot": [above["subroot"].iloc[0]] * len(nodes),
                "root": [above["root"].iloc[0]] * len(nodes),
            }
        )

    for nodes in reversed(tables):
        cells = nodes.groupBy("tree", _block(levels)).cogroup(tops.groupBy("tree", F.col("pos").alias("block")))
        tops = scratch.write(cells.applyInPandas(paths, f"tree long, pos long, {_PATH}, subroot binary, root binary"))
    return tops


def _path(cells) -> list[tuple[int, list[bytes]]]:
    return [(int(c["place"]), [bytes(d) for d in c["run"]]) for c in cells]


def versions(
    rows: DataFrame,
    key: str,
    group: str,
    leaf: Column,
    changed: Column,
    with_proof: bool = False,
    levels: int = LEVELS,
) -> DataFrame:
    """The tree over ``rows`` and, for each row, the version of it in which that row's leaf is changed.

    A row's leaf is the digest ``leaf``; ``changed`` is the one that a version has in its place,
    null for a row that is not changed. Leaves of one value of ``group`` (null is one) ascend by
    ``key``, nulls first and equal keys by their digests; groups ascend bytewise, null first.
    While a level has several nodes, every 8 in a row, fewer at the end, become the SHA-256 of
    their hex digests; a group's last node is its subroot, and subroots become the root likewise.

    Returns ``key``, leaf, changed, subroot, root, proof_sha256 (of the siblings on the way from
    leaf to root, level by level, left to right), copied (the digests of the nodes that the
    version does not share, from the leaf's parent to the version's root; null for a row that
    is not changed) and folded_root (what the changed leaf, else the leaf, gives with these
    siblings), digests as lowercase hex, and with ``with_proof`` the siblings, proof. Rows that are
    repeated are leaves of their own. Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession)
    digests = F.unhex(leaf).alias("digest"), F.unhex(changed).alias("changed")
    own = scratch.write(rows.select(F.col(key).alias("key"), F.col(group).alias("name"), *digests))  # rows are hashed once
    order = [F.col("name"), F.col("key"), F.col("digest"), F.col("changed")]
    placed, total = numbered(own, order, scratch)
    # A key for each group that is never null, as a string sorts before all that it begins.
    placed = placed.withColumn("named", F.coalesce(F.concat(F.lit("="), "name"), F.lit("")))
    sizes = scratch.write(placed.groupBy("named").agg(F.min("row").alias("start"), F.count("*").alias("n")))
    trees, groups = numbered(sizes, [F.col("named")], scratch)
    trees = trees.withColumnRenamed("row", "tree")
    member = with_groups(placed, trees, "named", "n", total)
    pos, text = (F.col("row") - F.col("start")).alias("pos"), F.col("key").cast("string").alias("key")  # pandas has no null integers
    leaves = scratch.write(member.select("tree", pos, "n", "digest", text, "changed"))

    forest = _upwards(leaves, levels, scratch)
    subroots = forest[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(groups).cast("long").alias("n"), "digest")
    upper = _upwards(subroots, levels, scratch)
    no_steps = F.array().cast(_PATH.split(" ", 1)[1])
    root = upper[-1].select("tree", "pos", no_steps.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    joined = _downwards(upper[:-1], root, levels, scratch)
    tops = joined.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root")
    tops = tops.join(forest[-1].select("tree", F.col("digest").alias("subroot")), "tree")
    blocks = _downwards(forest[1:-1], tops.select("tree", "pos", "path", "subroot", "root"), levels, scratch)
    def proofs(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        leaf, changed = list(nodes["digest"]), list(nodes["changed"])
        inner, rest = _inner(leaf, int(nodes["n"].iloc[0]), levels), _path(above["path"].iloc[0])
        upper_proof = b"".join(_siblings(rest))
        proof, version, folded = [], [], []
        for i, old in enumerate(leaf):
            steps = _steps(inner, i)
            path = steps + rest
            proof.append(b"".join(_siblings(steps)) + upper_proof)
            new = copied(path, old if changed[i] is None else changed[i])
            folded.append((new or [old if changed[i] is None else changed[i]])[-1])
            version.append(None if changed[i] is None else [d.hex() for d in new])
        out = {
            "key": nodes["key"].to_numpy(),
            "leaf": [d.hex() for d in leaf],
            "changed": [None if d is None else d.hex() for d in changed],
            "subroot": above["subroot"].iloc[0].hex(),
            "root": above["root"].iloc[0].hex(),
            "proof_sha256": [hashlib.sha256(p.hex().encode()).hexdigest() for p in proof],
            "copied": version,
            "folded_root": [d.hex() for d in folded],
        }
        if with_proof:
            out["proof"] = [[p[i : i + 32].hex() for i in range(0, len(p), 32)] for p in proof]
        return pd.DataFrame(out)

    hexes = "leaf string, changed string, subroot string, root string, proof_sha256 string, copied array<string>, folded_root string"
    schema = f"key string, {hexes}" + ", proof array<string>" * with_proof
    cells = leaves.groupBy("tree", _block(levels)).cogroup(blocks.groupBy("tree", F.col("pos").alias("block")))
    found = cells.applyInPandas(proofs, schema)
    return found.select(F.col("key").cast(own.schema["key"].dataType).alias(key), *found.columns[1:])
