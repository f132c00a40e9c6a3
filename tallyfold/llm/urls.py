"""URL filters by rule, and by the purity of path templates where no rule fits.

The paths of a host form a tree of segments. Digits in a segment are generalised at once.
Then, from the root down, the share of blocked pages among a branch's labelled ones is tested
against that of its siblings together. Branches above, below and not apart from the others
are merged into a wildcard each (``*+``, ``*-``, ``*``); one that is alone there stays. A branch
without labelled pages is not tested and only merged with others without any (``*?``); one that
has all the labelled pages stays by itself. So it goes on as deep as paths go. A page's way through the tree is its template. Labels are the verdicts of the rules; a
template's share of blocked pages, smoothed towards its host's and that towards all hosts',
is its purity, and pure ones are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import Scratch
from tallyfold.llm.words import lower_ascii

#: Two-sided test of equal shares, at 5 %.
Z = 1.96
#: Pages that a parent's share counts for in a child's.
SMOOTHING = 10.0
#: Least smoothed share of blocked pages in a rejected template.
PURITY = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty without ``://``."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits the host or a parent of it."""
    rule, verdict = (F.lit(None).cast("string") for _ in range(2))
    for decision, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def templates(shapes: DataFrame, scratch: Scratch, z: float = Z) -> DataFrame:
    """(host, shape, template, n, blocked, allowed) from counts by host and shape.

    Level by level: the counts of a level's nodes come from one aggregation, those of their
    parents and of the wildcards from one each on top of it. A shape that is alone below a node
    has its own segments from there on, so there are as many rounds as segments in which
    different shapes of a host begin alike, and one more.
    """
    named = shapes.withColumn("segments", F.array_remove(F.split("shape", "/"), "")).withColumn("template", F.lit(""))
    state, level, done = scratch.write(named), 0, []
    columns = ["host", "shape", "template", "n", "blocked", "allowed"]
    while True:
        deeper = F.size("segments") > level
        done.append(state.where(~deeper).select(*columns))
        at = state.where(deeper).withColumn("segment", F.get("segments", F.lit(level)))
        if at.isEmpty():
            break
        kids = at.groupBy("host", "template", "segment").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.count("*").alias("shapes"))
        parents = kids.groupBy("host", "template").agg(F.sum("b").alias("pb"), F.sum("a").alias("pa"), F.sum("shapes").alias("below"))
        both = kids.join(parents, ["host", "template"])
        n, rest = F.col("a") + F.col("b"), F.col("pa") + F.col("pb") - F.col("a") - F.col("b")
        share = (F.col("pb") / (F.col("pa") + F.col("pb"))).cast("double")
        apart = F.col("b") / n - (F.col("pb") - F.col("b")) / rest
        error = F.sqrt(share * (1 - share) * (1 / n + 1 / rest))
        tested = F.when(apart > z * error, F.lit("*+")).when(apart < -z * error, F.lit("*-")).otherwise(F.lit("*"))
        side = F.when(n == 0, F.lit("*?")).when(rest == 0, F.lit("*!")).otherwise(tested)
        sided = both.select("host", "template", "segment", "below", side.alias("side"))
        sizes = sided.groupBy("host", "template", "side").agg(F.count("*").alias("alike"))
        named = sided.join(sizes, ["host", "template", "side"]).select(
            "host", "template", "segment", "below", F.when(F.col("alike") == 1, F.col("segment")).otherwise(F.col("side")).alias("named")
        )
        grown = at.join(named, ["host", "template", "segment"])
        alone = F.col("below") == 1
        own = F.array_join(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), "/")
        grown = grown.withColumn("template", F.concat("template", F.lit("/"), F.when(alone, own).otherwise(F.col("named"))))
        # What is finished has no segments left to go through.
        rest_of = F.when(alone, F.array().cast("array<string>")).otherwise(F.col("segments")).alias("segments")
        state, level = scratch.write(grown.select(*columns, rest_of)), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    z: float = Z,
    smoothing: float = SMOOTHING,
    min_purity: float = PURITY,
) -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict) for every row of ``pages`` (page_id, url).

    A rule's verdict stands. Where none fits, a page is blocked if its template has labelled
    pages and its purity is ``min_purity`` or more, else allowed. A null url, or one without
    ``://``, has an empty host and path. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.regexp_replace("path", "[0-9]+", "*").alias("shape"))

    counts = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("by_rule") == "block").alias("blocked"),
        F.count_if(F.col("by_rule") == "allow").alias("allowed"),
    )
    tree = scratch.write(templates(counts, scratch, z))
    every = tree.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("allowed"), F.lit(0)).alias("a")).first()
    everywhere = (every.b + 1) / (every.a + every.b + 2)
    hosts = tree.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("allowed").alias("ha"))
    hosts = hosts.select("host", ((F.col("hb") + F.lit(smoothing * everywhere)) / (F.col("ha") + F.col("hb") + smoothing)).alias("of_host"))
    nodes = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).join(hosts, "host")
    purity = (F.col("b") + smoothing * F.col("of_host")) / (F.col("a") + F.col("b") + smoothing)
    nodes = nodes.select("host", "template", purity.alias("purity"), (F.col("a") + F.col("b") > 0).alias("labelled"))
    judged = scratch.write(tree.select("host", "shape", "template").join(nodes, ["host", "template"]))
    found = rows.join(judged, ["host", "shape"])
    by_method = F.when(F.col("labelled") & (F.col("purity") >= min_purity), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", "template", "purity", F.coalesce("by_rule", by_method).alias("verdict"))
