"""One query for each operator, over its whole table, and SQL for those that have some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import (
    bpe, clusters, language, license_scan, line_dedup, packing, quality, repeats, simhash, spelling, toxicity,
    url_filter, vectors,
)
from sediment.llm.tables import table

RULES = [
    url_filter.Rule("org/", "allow"),
    url_filter.Rule("example.org/es/", "block"),
    url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"),
    url_filter.Rule("com/de/", "block"),
]
LINE_RATIO, LINE_LEAST = 0.1, 5
LONGEST, BUCKETS, BUDGET = 2048, 8, 32_768
CENTROIDS, ROUNDS = 16, 3
# Bytes of 51 short words, as in the pipeline.
PASSAGE = 256


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stripped = line_dedup.strip_lines(docs, ratio=LINE_RATIO, least=LINE_LEAST)
    return stripped.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_notices(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first_word"])

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    best = F.array_max(F.transform(F.col("matches"), lambda m: m["similarity"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9).rows


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), longest=LONGEST, buckets=BUCKETS, budget=BUDGET)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes go; ``n_repeated`` tells of passages of over 50 words too short for that."""
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400, shorter=PASSAGE)
    return rows.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), "n_repeated",
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        cut_at_spaces=True,
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), shortest=5, least=3, every=97)
    return spelling.spelling_groups(words, ratio=2)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster_vectors(table(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS, scale=64)
    return clusters.with_inertia(found)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = language.languages(docs, language.fit(docs))
    return named.select(
        "doc_id", (~language.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_line_dedup, op3_license_scan, op4_toxicity, op5_vector_dedup,
        op6_simhash, op7_packing, op8_quality, op9_repeats, op10_bpe, op11_spelling, op12_clusters,
        op13_language,
    )
}


def _rule_sql(column: str) -> str:
    found = "NULL"
    for rule in sorted(RULES, key=lambda r: (len(r.place), r.place)):
        found = (
            f"CASE WHEN ({column}host = '{rule.host}' OR ends_with({column}host, '.{rule.host}')) "
            f"AND starts_with({column}path, '{rule.path}') THEN '{rule.place}' ELSE {found} END"
        )
    return found


_ALLOWED = ", ".join(f"'{r.place}'" for r in RULES if r.verdict == "allow")

# The tables hold no canonical links, refreshes or redirects, so plain forms are the components.
_URL_SQL = rf"""
WITH cut AS (
  SELECT page_id, contains(url, '://') AS whole,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, whole, rest,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                                     lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&') AS query
  FROM cut),
ruled AS (
  SELECT page_id, host, path, {_rule_sql("")} AS rule,
         CASE WHEN whole THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
              || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS alias
  FROM parts),
judged AS (
  SELECT *, max(CASE WHEN rule IN ({_ALLOWED}) THEN 1 ELSE 0 END) OVER (PARTITION BY alias) AS any_allow,
         max(CASE WHEN rule NOT IN ({_ALLOWED}) THEN 1 ELSE 0 END) OVER (PARTITION BY alias) AS any_block
  FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({_ALLOWED}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN alias IS NULL OR any_allow = 1 THEN 'allow' WHEN any_block = 1 THEN 'block' ELSE 'allow' END AS verdict,
       alias
FROM judged
"""

_LINE_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM split),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM lines),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT k.source, k.bare
  FROM (SELECT source, bare, count(DISTINCT r) AS n FROM keyed WHERE bare <> '' GROUP BY source, bare) k
  JOIN pages p ON k.source IS NOT DISTINCT FROM p.source
  WHERE n >= {LINE_LEAST} AND n > pages * CAST({LINE_RATIO} AS DOUBLE)),
marked AS (
  SELECT k.*, o.bare IS NOT NULL AS gone
  FROM keyed k LEFT JOIN often o ON k.bare = o.bare AND k.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY r, doc_id
"""


def _packing_sql() -> str:
    """The dynamic programme with one step after the other; of equal costs the smallest start wins."""
    steps = ["f0 AS (SELECT CAST(0 AS HUGEINT) AS j, CAST(0 AS HUGEINT) AS cost)"]
    for k in range(1, BUCKETS + 1):
        steps.append(
            f"f{k} AS (SELECT j, min(cost) AS cost, arg_min(i, cost * 100000 + i) AS i FROM ("
            f"SELECT b.j, a.j AS i, a.cost + b.len * (b.n - coalesce(c.n, 0)) - (b.total - coalesce(c.total, 0)) AS cost "
            f"FROM f{k - 1} a JOIN hist b ON b.j > a.j LEFT JOIN hist c ON c.j = a.j) GROUP BY j)"
        )
    count = f"least({BUCKETS}, (SELECT max(j) FROM hist))"
    back = [f"b{BUCKETS} AS (SELECT CASE WHEN {count} = {BUCKETS} THEN (SELECT max(j) FROM hist) END AS j)"]
    for k in range(BUCKETS - 1, 0, -1):
        back.append(
            f"b{k} AS (SELECT CASE WHEN {count} = {k} THEN (SELECT max(j) FROM hist) "
            f"ELSE (SELECT i FROM f{k + 1} WHERE j = (SELECT j FROM b{k + 1})) END AS j)"
        )
    bounds = " UNION ALL ".join(f"SELECT j FROM b{k}" for k in range(1, BUCKETS + 1))
    return f"""
WITH counted AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
cut AS (
  SELECT doc_id, tokens, unnest(range(greatest(CAST(ceil(tokens / {LONGEST}.0) AS BIGINT), 1))) AS part FROM counted),
seq AS (SELECT doc_id, part, least(tokens - part * {LONGEST}, {LONGEST}) AS n_tokens FROM cut),
hist AS (
  SELECT row_number() OVER (ORDER BY len) AS j, len, sum(c) OVER (ORDER BY len) AS n, sum(c * len) OVER (ORDER BY len) AS total
  FROM (SELECT n_tokens AS len, count(*) AS c FROM seq GROUP BY 1)),
{", ".join(steps)}, {", ".join(back)},
bounds AS (SELECT h.len AS bound FROM ({bounds}) b JOIN hist h ON h.j = b.j),
placed AS (SELECT s.*, (SELECT min(bound) FROM bounds WHERE bound >= s.n_tokens) AS bucket FROM seq s),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, part, n_tokens) - 1 AS number,
         greatest({BUDGET} // greatest(bucket, 1), 1) AS each
  FROM placed)
SELECT doc_id, part, n_tokens, bucket, number // each AS batch, number % each AS slot FROM numbered
"""


def _clusters_sql() -> str:
    """Rounds one after the other, over rows of (vector, place, integer)."""
    assign = (
        "SELECT r, arg_min(c, d * 100 + c) AS c, min(d) AS d FROM ("
        "SELECT v.r, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM cells v JOIN {0} m ON v.i = m.i "
        "GROUP BY v.r, m.c) GROUP BY r"
    )
    rounds = []
    for n in range(ROUNDS):
        rounds.append(f"a{n} AS ({assign.format(f'm{n}')})")
        # Division of whole numbers, downwards also below zero.
        rounds.append(
            f"m{n + 1} AS (SELECT m.c, m.i, CASE WHEN s.n IS NULL THEN m.x "
            "ELSE (s.total - ((s.total % s.n) + s.n) % s.n) // s.n END AS x "
            f"FROM m{n} m LEFT JOIN (SELECT a.c, v.i, sum(v.x) AS total, count(*) AS n "
            f"FROM a{n} a JOIN cells v ON v.r = a.r GROUP BY a.c, v.i) s ON m.c = s.c AND m.i = s.i)"
        )
    return f"""
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (
  SELECT r, unnest(range(64)) AS i, CAST(unnest(list_transform(e, lambda x: floor(64 * x))) AS HUGEINT) AS x
  FROM vectors),
chosen AS (
  SELECT r, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS c FROM vectors
  ORDER BY c LIMIT {CENTROIDS}),
m0 AS (SELECT c, i, x FROM chosen JOIN cells USING (r)),
{", ".join(rounds)},
last AS ({assign.format(f"m{ROUNDS}")}),
prints AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       centroid_sha256
FROM last JOIN vectors USING (r) JOIN prints USING (c)
"""


ORACLES: dict[str, str] = {
    "op12_clusters": _clusters_sql(),
    "op1_url_filter": _URL_SQL,
    "op2_line_dedup": _LINE_SQL,
    "op7_packing": _packing_sql(),
}
