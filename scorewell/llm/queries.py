"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, cell_clusters, fingerprints, hard_negatives, language_id, near_duplicates, packing, quality_classifier, quality_rules, recurrent_lm, repeats, secret_scan, tight_packing
from .base import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir, "doc_id", "source", "text"))


ORACLES["op9_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (
  SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM win),
dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c >= 2),
cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
s AS (
  SELECT w.rid, doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov ON w.rid = cov.rid),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM j GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS mean, sum(n) AS n, count(*) AS hosts FROM h),
v AS (
  SELECT any_value(mean) AS mean, sum(h.n * (h.k / h.n - mean) ** 2) / any_value(m.n) AS spread,
         any_value(mean) * (1 - any_value(mean)) * any_value(hosts) / any_value(m.n) AS noise FROM h, m),
b AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread - noise, 1e-9) - 1, 1.0), 1e6) AS weight FROM v),
bad AS (SELECT source, (k + mean * weight) / (n + weight) > 0.5 AS host_failed FROM h, b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM j JOIN bad ON j.source IS NOT DISTINCT FROM bad.source
"""


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir, "doc_id", "text"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir, "doc_id", "text"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


@query
def op8_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_pairs.round_trip(documents(spark, sf_dir, "doc_id", "text"), ranks, public_tokenizers.PATTERN)


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_classifier.classify(documents(spark, sf_dir, "doc_id", "text"), labels)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), definition)


@query
def op11_tight_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    return tight_packing.pack(documents(spark, sf_dir, "doc_id", "text"), definition)


@query
def op12_cell_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(t: int, name: str) -> str:
    """Assignment of all vectors to the centroids c{t}, by distance and then number."""
    return f"""
{name} AS (SELECT rid, vec_id, v, k, dist FROM (
  SELECT rid, vec_id, v, k, dist, row_number() OVER (PARTITION BY rid ORDER BY dist, k) AS place FROM (
    SELECT rid, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM x, c{t})) WHERE place = 1)"""


def _cluster_sql() -> str:
    rounds = []
    for t in range(cell_clusters.ROUNDS):
        rounds.append(_round_sql(t, f"a{t}"))
        rounds.append(f"""
e{t} AS (SELECT k, place, sum(value)::HUGEINT AS s, count(*) AS n FROM (SELECT k, unnest(v) AS value, unnest(range(1, {cell_clusters.DIMENSIONS + 1})) AS place FROM a{t}) GROUP BY k, place),
m{t} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS c FROM e{t} GROUP BY k),
c{t + 1} AS (SELECT c{t}.k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} ON c{t}.k = m{t}.k)""")
    last = cell_clusters.ROUNDS
    return f"""
WITH x AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({cell_clusters.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {cell_clusters.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY key, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS key, v FROM x ORDER BY key, v LIMIT {cell_clusters.CLUSTERS})),
{','.join(rounds)},{_round_sql(last, 'f')}
SELECT f.vec_id, f.k::INT AS cluster, f.dist AS distance, (sum(f.dist) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia,
  (sum(f.dist) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{last}.c, ',')) AS centroid_sha256
FROM f JOIN c{last} ON f.k = c{last}.k"""


ORACLES["op12_cell_clusters"] = _cluster_sql()


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


ORACLES["op13_hard_negatives"] = """
WITH x AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arow, a.vec_id AS anchor_id, b.rid AS brow, b.vec_id AS other_id, a.label IS NOT DISTINCT FROM b.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
  FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (SELECT arow, anchor_id, brow, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY arow ORDER BY score DESC, other_id NULLS LAST, brow) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.arow, p.brow ORDER BY s.score DESC, s.other_id NULLS LAST, s.brow) AS place
  FROM p JOIN s ON p.arow = s.arow AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5
"""


@query
def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(documents(spark, sf_dir, "doc_id", "text"))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group(documents(spark, sf_dir, "doc_id", "text"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(documents(spark, sf_dir, "doc_id", "text"))


ORACLES["op6_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id
"""

ORACLES["op10_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_id FROM win) WHERE first_id < doc_id),
cut AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM hit),
isl AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cut),
sp AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM isl GROUP BY doc_id, k),
gap AS (SELECT doc_id, k, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS f, a AS t FROM sp
  UNION ALL SELECT doc_id, max(k) + 1, max(b), NULL FROM sp GROUP BY doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, length(h) // 2) - f)), '' ORDER BY k) AS h FROM gap JOIN d ON gap.doc_id = d.doc_id GROUP BY gap.doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id)
SELECT d.doc_id, length(d.h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_SPANS = """
{k}_m AS (SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS al, regexp_extract_all(t, {p}, {g}) AS te FROM d WHERE regexp_matches(t, {p})),
{k}_s AS (SELECT doc_id, '{k}' AS kind, {o} AS o, a AS start, a + length(m) AS stop, m FROM (
  SELECT doc_id, al[i] AS m, te[i] AS c, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(al[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(al) + 1)) AS i FROM {k}_m)) WHERE length(c) >= {n})"""


def _secret_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = {**secret_scan.BASE_KINDS, **secret_scan.WEAK_KINDS}
    spans = ",".join(_SPANS.format(k=k, p=quote(p), g=g, n=n, o=secret_scan.ORDER[k]) for k, (p, g, n) in kinds.items())
    base = " UNION ALL ".join(f"SELECT * FROM {k}_s" for k in secret_scan.BASE_KINDS)
    part = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in secret_scan.PART.items()) + " END"
    near = lambda p: f"EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = w.doc_id AND q.part = '{p}' AND abs(q.start - w.start) <= {secret_scan.SCOPE})"
    needs = " OR ".join(f"w.kind = '{k}' AND " + " AND ".join(near(p) for p in v) for k, v in secret_scan.NEEDS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{spans},
base AS ({base}),
cand AS (SELECT * FROM login_s UNION ALL SELECT * FROM endpoint_s UNION ALL
  SELECT * FROM opaque_s WHERE regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')),
weak AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.stop AND c.start < b.stop)),
parts AS (SELECT doc_id, start, {part} AS part FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
linked AS (SELECT * FROM weak w WHERE {needs}),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, o) AS x FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, o) AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN a ON d.doc_id = a.doc_id
"""


ORACLES["op5_secret_scan"] = _secret_sql()
