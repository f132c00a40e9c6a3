"""The operators as queries over the test tables, beside the same answers in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import (
    bpe,
    decontaminate,
    exact,
    language,
    licenses,
    merkle,
    quality,
    sharding,
    simhash,
    suffixes,
    surrogates,
    urls,
    whitening,
)
from tallyfold.llm.shipping import ship
from tallyfold.llm.words import lower_ascii

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), width=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(_documents(spark, sf_dir), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_documents(spark, sf_dir))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.benchmark_hits(_documents(spark, sf_dir), benchmark, window=13)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


#: Lower case for A-Z only, and words, as DuckDB has them.
_LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT doc_id, s, p.n, item_id
  FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM places) p JOIN windows USING (n, t)),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
  FROM hits GROUP BY doc_id),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN covered USING (doc_id)
"""


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


ORACLES["op3_quality"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS s, w FROM d WHERE len(w) > 2),
texts AS (SELECT doc_id, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS t FROM grams),
again AS (SELECT doc_id, s FROM texts QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM again) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, text, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS line
  FROM (SELECT doc_id, host, text, unnest(l) AS x FROM d)),
frequent AS (
  SELECT host, line
  FROM (SELECT host, line, count(DISTINCT text) AS texts FROM lines GROUP BY ALL)
  JOIN (SELECT host, count(DISTINCT text) AS of_host FROM d GROUP BY ALL) USING (host)
  WHERE texts > 5 AND (texts > 50 OR texts > 0.05::DOUBLE * of_host)),
lost AS (SELECT doc_id, sum(n) AS n FROM lines JOIN frequent USING (host, line) GROUP BY doc_id),
facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_lost_words >= 0.5::DOUBLE * n_words AS kept
FROM facts
"""


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_documents(spark, sf_dir))
    own = F.transform("phrases", lambda p: p["label"])
    other = F.transform(F.coalesce("spans", F.slice("spans", 1, 0)), lambda s: s["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("phrases", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("phrases", lambda p: p["last"])).cast("long").alias("last_word"),
        listed(own).alias("base_labels"),
        listed(F.concat(own, F.coalesce(other, F.array().cast("array<string>")))).alias("labels"),
        "score",
    )


_TEMPLATE_ROWS = ", ".join(
    f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(licenses.TEMPLATES)
)
_PHRASE_ROWS = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.PHRASES)

ORACLES["op6_licenses"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_PHRASE_ROWS}) AS t(phrase, label)),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
base AS (
  SELECT doc_id, count(*) AS n, min(s) - 1 AS first, max(s) - 1 AS last,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM spots JOIN p ON w[s] = p[1] AND w[s:s + len(p) - 1] = p GROUP BY doc_id),
t AS (
  SELECT template, label, {_WORDS.format("t.text")} AS w FROM (VALUES {_TEMPLATE_ROWS}) AS t(template, label, text)),
grams AS (
  SELECT template, label, w, len(w) AS size, unnest(range(0, len(w) - 2)) AS place,
    unnest([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) AS g FROM t),
votes AS (
  SELECT doc_id, template, label, size, place, s - 1 - place AS diagonal
  FROM (SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS g FROM spots WHERE s + 2 <= len(w)) JOIN grams USING (g)),
starts AS (
  SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 2)::INT, 1) AS new
  FROM (SELECT DISTINCT doc_id, template, diagonal FROM votes)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM starts),
voted AS (
  SELECT doc_id, template, label, size, run, greatest(min(diagonal), 0) AS a, max(diagonal) + size AS b
  FROM votes JOIN runs USING (doc_id, template, diagonal)
  GROUP BY doc_id, template, label, size, run
  HAVING len(list_distinct(flatten(list([place, place + 1, place + 2])))) >= 0.8::DOUBLE * size),
spans AS (
  SELECT doc_id, v.label, v.template, v.size, a, b, d.w[a + 1:b] AS own, t.w
  FROM voted v JOIN d USING (doc_id) JOIN t USING (template)),
steps AS (
  SELECT doc_id, template, a, b, 0 AS i, list_transform(w, lambda x: 0) AS met, list_transform(w, lambda x: 0) AS reached, 0 AS most
  FROM spans
  UNION ALL
  SELECT doc_id, template, a, b, i, met,
    list_transform(range(1, size + 1), lambda j: list_max(met[1:j])) AS reached, greatest(most, list_max(met))
  FROM (
    SELECT doc_id, template, a, b, i + 1 AS i, size, most,
      list_transform(range(1, size + 1), lambda j: CASE WHEN w[j] = own[i + 1] THEN 1 + CASE WHEN j = 1 THEN 0 ELSE reached[j - 1] END
        ELSE greatest(reached[j] - 1, 0) END) AS met
    FROM steps JOIN spans USING (doc_id, template, a, b) WHERE i < len(own))),
verified AS (
  SELECT doc_id, s.label, s.template, a, b, s.size, max(most) / s.size::DOUBLE AS score
  FROM steps JOIN spans s USING (doc_id, template, a, b) GROUP BY doc_id, s.label, s.template, a, b, s.size),
good AS (SELECT * FROM verified WHERE score >= 0.8::DOUBLE),
best AS (
  SELECT doc_id, label, score FROM good g WHERE NOT EXISTS (
    FROM good o WHERE o.doc_id = g.doc_id AND g.a < o.b AND o.a < g.b
      AND (o.score > g.score OR (o.score = g.score AND (o.size > g.size OR (o.size = g.size AND o.template < g.template)))))),
labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM best UNION ALL SELECT doc_id, unnest(string_split(labels, ',')) FROM base) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, first::BIGINT AS first_word,
  last::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(labelled.labels, '') AS labels,
  CASE WHEN base.n > 0 THEN 1 ELSE coalesce((SELECT max(score) FROM best WHERE best.doc_id = d.doc_id), 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labelled USING (doc_id)
"""


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_documents(spark, sf_dir), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _feistel_sql(x: str) -> str:
    """One pass of the network over the column ``x``, its halves ``h`` bits wide, as nested SELECTs."""
    source = f"SELECT *, {x} >> h AS a0, {x} & ((1::BIGINT << h) - 1) AS b0 FROM walk"
    for i in range(sharding.ROUNDS):
        once = f"((xor(b{i}, {sharding._round_key(sharding.KEY, i)}::BIGINT) & 2147483647)::HUGEINT * {sharding.FACTOR} % (1::HUGEINT << 62))::BIGINT"
        twice = f"((({once} >> 15) & 2147483647)::HUGEINT * {sharding.FACTOR} % (1::HUGEINT << 62))::BIGINT"
        source = f"SELECT *, b{i} AS a{i + 1}, xor(a{i}, ({twice} >> 13) & ((1::BIGINT << h) - 1)) AS b{i + 1} FROM ({source})"
    return f"SELECT doc_id, n, h, (a{sharding.ROUNDS} << h) | b{sharding.ROUNDS} AS x FROM ({source})"


ORACLES["op4_sharding"] = f"""
WITH RECURSIVE numbers AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n FROM documents),
walk AS (
  SELECT doc_id, n, greatest(1, (CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END + 1) // 2)::INT AS h, x, false AS moved FROM numbers
  UNION ALL
  SELECT doc_id, n, h, x, true FROM ({_feistel_sql("x").replace("FROM walk)", "FROM walk WHERE NOT moved OR x >= n)")})),
bits AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)
    ORDER BY b) AS t FROM range(256) AS r(b)),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, length(h) // 2 + 16 AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(h), 2), lambda i: ('0x' || h[i + 1:i + 2])::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM hexed, bits)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % 40)::INT AS shard, x // 40 AS slot, NULL::INT AS grown_shard
FROM walk JOIN sums USING (doc_id) WHERE moved AND x < n
"""


#: Verdict, host and path of each rule.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(ship(spark).read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


@query
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace_entities(_documents(spark, sf_dir).select("doc_id", "text"), key=SURROGATE_KEY)
    return replaced.select("doc_id", "text", "n_entities")


#: A test key; a real one comes from the caller and stays secret.
SURROGATE_KEY = "test tables only"


#: Levels of the tree in the SQL; the operator goes as deep as paths do.
_URL_LEVELS = 7


def _template_levels() -> str:
    """The tree level by level: l0 has empty templates, each next one a segment more."""
    out = []
    for i in range(_URL_LEVELS):
        out.append(f"""
k{i} AS (
  SELECT host, template, segments[{i + 1}] AS segment, sum(blocked) AS b, sum(allowed) AS a
  FROM l{i} WHERE len(segments) > {i} GROUP BY ALL),
f{i} AS (
  SELECT host, template, segment, a + b AS n, sum(a + b) OVER p - a - b AS rest,
    b::DOUBLE / nullif(a + b, 0) - (sum(b) OVER p - b)::DOUBLE / nullif(sum(a + b) OVER p - a - b, 0) AS apart,
    (sum(b) OVER p)::DOUBLE / nullif(sum(a + b) OVER p, 0) AS share
  FROM k{i} WINDOW p AS (PARTITION BY host, template)),
e{i} AS (SELECT *, 1.96::DOUBLE * sqrt(share * (1 - share) * (1::DOUBLE / nullif(n, 0) + 1::DOUBLE / nullif(rest, 0))) AS error FROM f{i}),
s{i} AS (
  SELECT *, CASE WHEN n = 0 THEN '*?' WHEN rest = 0 THEN '*!' WHEN apart > error THEN '*+' WHEN apart < -error THEN '*-' ELSE '*' END AS side FROM e{i}),
n{i} AS (
  SELECT host, template, segment,
    CASE WHEN count(*) OVER (PARTITION BY host, template, side) = 1 THEN segment ELSE side END AS named
  FROM s{i}),
l{i + 1} AS (
  SELECT host, shape, segments, blocked, allowed, template || coalesce('/' || named, '') AS template
  FROM (SELECT *, segments[{i + 1}] AS segment FROM l{i}) LEFT JOIN n{i} USING (host, template, segment)),""")
    return "".join(out)


def _rule_sql(column: int) -> str:
    cases = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p, v)[column]}'"
        for v, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {cases} END"


ORACLES["op10_urls"] = f"""
WITH u AS (
  SELECT page_id, {_LOWERED.format("regexp_extract(url, '://([^/?#]*)', 1)")} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS by_rule, regexp_replace(path, '[0-9]+', '*', 'g') AS shape FROM u),
l0 AS (
  SELECT host, shape, list_filter(string_split(shape, '/'), lambda x: x <> '') AS segments, '' AS template,
    count(*) FILTER (by_rule = 'block') AS blocked, count(*) FILTER (by_rule = 'allow') AS allowed
  FROM r GROUP BY ALL),{_template_levels()}
tree AS (
  SELECT host, shape, template, blocked, allowed FROM l{_URL_LEVELS}),
g AS (SELECT (sum(blocked) + 1)::DOUBLE / (sum(allowed) + sum(blocked) + 2) AS p FROM tree),
h AS (SELECT host, (sum(blocked) + 10.0::DOUBLE * any_value(p)) / (sum(allowed) + sum(blocked) + 10.0::DOUBLE) AS p FROM tree, g GROUP BY host),
t AS (
  SELECT host, template, sum(allowed) + sum(blocked) > 0 AS labelled,
    (sum(blocked) + 10.0::DOUBLE * any_value(p)) / (sum(allowed) + sum(blocked) + 10.0::DOUBLE) AS purity
  FROM tree JOIN h USING (host) GROUP BY host, template)
SELECT page_id, host, path, rule, template, purity,
  coalesce(by_rule, CASE WHEN labelled AND purity >= 0.8::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN tree USING (host, shape) JOIN t USING (host, template)
"""


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


ORACLES["op12_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)

    def leaf(text):
        return merkle.digest(*[merkle.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], merkle.field(text))

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(tampered, leaf(lower_ascii(F.col("text"))))
    found = merkle.versions(docs, "doc_id", "lang", leaf(F.col("text")), changed)
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)


#: Levels of a tree in the SQL: 262,144 leaves.
_TREE_LEVELS = 6


def _forest_sql(name: str, group: str) -> str:
    """From {name}0 (group, i, d, n) and f_{name}0 (row, group, i, cur, proof): the levels above, and the way up through them."""
    out = []
    for k in range(_TREE_LEVELS):
        out.append(f"""
{name}{k + 1} AS (
  SELECT {group}, i // 8 AS i, (any_value(n) + 7) // 8 AS n,
    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
  FROM {name}{k} GROUP BY {group}, i // 8),
f_{name}{k + 1} AS (
  SELECT f.row, f.{group}, f.i // 8 AS i, f.proof || coalesce(string_agg(l.d, '' ORDER BY l.i) FILTER (l.i <> f.i), '') AS proof,
    CASE WHEN any_value(l.n) > 1 THEN sha256(string_agg(CASE WHEN l.i = f.i THEN f.cur ELSE l.d END, '' ORDER BY l.i)) ELSE f.cur END AS cur
  FROM f_{name}{k} f JOIN {name}{k} l ON f.{group} = l.{group} AND f.i // 8 = l.i // 8 GROUP BY f.row, f.{group}, f.i, f.proof, f.cur),""")
    return "".join(out)


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


ORACLES["op11_merkle"] = f"""
WITH bits AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)
    ORDER BY b) AS t FROM range(256) AS r(b)),
sums AS (
  SELECT *, hex(encode(doc_id::VARCHAR)) AS h,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(h), 2), lambda i: ('0x' || h[i + 1:i + 2])::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM documents, bits),
given AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE leaf END AS cur
  FROM sums),
own AS (
  SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM given),
l0 AS (SELECT tree, i, count(*) OVER (PARTITION BY tree) AS n, leaf AS d FROM own),
f_l0 AS (SELECT row, tree, i, cur, '' AS proof FROM own),{_forest_sql("l", "tree")}
s0 AS (SELECT 0 AS whole, tree AS i, count(*) OVER () AS n, d FROM l{_TREE_LEVELS}),
f_s0 AS (SELECT row, 0 AS whole, tree AS i, cur, proof FROM f_l{_TREE_LEVELS}),{_forest_sql("s", "whole")}
roots AS (SELECT d AS root FROM s{_TREE_LEVELS})
SELECT doc_id, leaf, l.d AS subroot, root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = root AS verified
FROM own o JOIN f_s{_TREE_LEVELS} f USING (row) JOIN l{_TREE_LEVELS} l ON l.tree = o.tree, roots
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), key="vec_id", vector="embedding", components=4)
