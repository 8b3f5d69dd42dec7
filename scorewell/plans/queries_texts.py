"""Free text, codes, themes."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import functions as F

from ..core import shared_dir
from ..functions import numbers as nb
from ..functions import replies as rp
from ..functions import text as tx
from ..functions.vectors import cosine
from ..operators import analysis as an
from ..operators import codes as cd
from ..operators import coding as co
from ..operators import ratings as ra
from ..sources import responses as src
from ..sources import texts as st
from . import tables as t
from .queries_tests import rounded
from .registry import query
from .sqltext import sql


def documents(spark, sf):
    d = t.table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("doc_order"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("participant_id"),
        F.when(F.col("lang") == "en", "interview").otherwise("reflection").alias("source_type"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("cohort_id"), "lang", "source",
    )


@query("read_transcripts", "SELECT concat('d', CAST(doc_id AS VARCHAR)) AS participant_id, 'interview' AS source_type, text AS content, source AS cohort_id FROM documents WHERE lang = 'en' AND doc_id % 6 <> 0 AND source IN ('src1', 'src2', 'src3')")
def _(spark, sf):
    return st.read_transcripts(documents(spark, sf), "interview", ["src1", "src2", "src3"])


def reflections(spark, sf):
    """Documents as reflection answers in the response log."""
    d = t.table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string")).alias("user_id"),
        F.concat(F.lit("module"), (F.col("doc_id") % 7 + 1).cast("string"), F.when(F.col("doc_id") % 5 == 0, "_other").otherwise("_module_reflections")).alias("instrument_name"),
        F.when(F.col("doc_id") % 2 == 0, "change").otherwise("takeaway").alias("question_id"),
        F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text")).alias("response_value"),
        F.timestamp_seconds(F.col("doc_id") * 60).alias("submitted_at"),
    )


REFL = """rf AS (SELECT concat('u', CAST(doc_id % 97 AS VARCHAR)) AS user_id, doc_id % 7 + 1 AS m, CASE WHEN doc_id % 2 = 0 THEN 'change' ELSE 'takeaway' END AS question_id, text, doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND trim(text) <> '')"""


@query("reflections_as_transcripts", f"WITH {REFL} SELECT user_id AS participant_id, 'reflection' AS source_type, concat('module_', CAST(m AS VARCHAR)) AS module_id, text AS content FROM rf WHERE m = 3")
def _(spark, sf):
    return st.reflections_as_transcripts(reflections(spark, sf), module="module3")


@query("reflection_texts", f"WITH {REFL} SELECT user_id, concat('module_', CAST(arg_min(m, doc_id) AS VARCHAR)) AS module_id, question_id, arg_min(text, doc_id) AS text FROM rf WHERE m IN (1, 2, 5) GROUP BY 1, 3")
def _(spark, sf):
    r = reflections(spark, sf).withColumnRenamed("instrument_name", "instrument_key")
    canon = r.withColumn("module_id", tx.reflection_module(F.col("instrument_key")))
    return st.reflection_texts(canon, modules=["module_1", "module_2", "module_5"])


@query("parse_captions", "SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS participant_id, concat('Hello ', CAST(n_chars AS VARCHAR), ' and ', lang, ' text from ', source) AS content FROM documents")
def _(spark, sf):
    d = t.table(spark, sf, "documents")
    body = F.concat(
        F.lit("WEBVTT\n\nNOTE made by hand\n1\n00:00:01.000 --> 00:00:04.500\nSpeaker 1: Hello "), F.col("n_chars").cast("string"),
        F.lit("\n\n2\n00:00:05.000 --> 00:00:09.000\n  Interviewer: and "), F.col("lang"), F.lit(" text \r\n\n3\n00:00:10.000 --> 00:00:19.000\nfrom "), F.col("source"), F.lit("\n"))
    path = F.concat(F.lit("/in/x/doc_"), F.col("doc_id").cast("string"), F.lit("_Interview_transcript.vtt"))
    return st.parse_captions(d.select(path.alias("path"), body.alias("value")))


@query("read_text_files", "SELECT source AS participant_id, concat('All of ', source) AS content FROM documents GROUP BY 1")
def _(spark, sf):
    folder = shared_dir(spark, "captions")
    d = t.table(spark, sf, "documents").select("source").distinct().withColumn("value", F.concat(F.lit("1\nSpeaker: All of\n"), F.col("source")))
    d.write.partitionBy("source").text(folder)
    files = st.read_text_files(spark, folder)
    named = files.withColumn("path", F.concat(F.regexp_extract("path", r"source=([^/]+)", 1), F.lit("_recording.vtt")))
    return st.parse_captions(named)


# -- text functions ----------------------------------------------------------------------------


@query("natural_sort_key", "SELECT p_partkey, concat(split_part(p_brand, '#', 1), '#', lpad(split_part(p_brand, '#', 2), 12, '0'), '-q', lpad(CAST(p_size AS VARCHAR), 12, '0')).lower() AS k FROM part")
def _(spark, sf):
    p = t.table(spark, sf, "part")
    return p.select("p_partkey", tx.natural_key(F.concat("p_brand", F.lit("-Q"), F.col("p_size").cast("string"))).alias("k"))


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def _(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("jaccard_to_next", """WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
   SELECT a.item_id, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) ELSE 0 END AS j FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def _(spark, sf):
    b = t.table(spark, sf, "benchmark").select("item_id", tx.word_set(F.col("text")).alias("w"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("w2"))
    return b.join(n, "item_id").select("item_id", F.round(tx.jaccard(F.col("w"), F.col("w2")), 6).alias("j"))


@query("cosine_to_next", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = t.table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(n, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("e2")), 6).alias("cos"))


@query(
    "item_records",
    """SELECT 'bank' AS instrument_key, CAST(p_partkey AS VARCHAR) AS question_id, trim(p_name) AS text,
       substr(sha256(concat('{"o": [["A", "', p_type, '"], ["B", "', p_brand, '"], ["C", "none"]], "t": "', p_name, '"}')), 1, 16) AS item_hash,
       false AS depends_on_figure, CASE WHEN p_partkey % 4 <> 0 THEN substr('ABC', CAST(1 + p_partkey % 3 AS INT), 1) END AS key, p_partkey IN (3, 5) AS in_selection, concat('A=', p_type, '|B=', p_brand, '|C=none') AS options FROM part""",
)
def _(spark, sf):
    p = t.table(spark, sf, "part")
    options = F.array(F.concat(F.lit("A) "), F.col("p_type")), F.concat(F.lit(" b. "), F.col("p_brand")), F.lit("none"))
    bank = p.select(F.lit("bank").alias("instrument_key"), F.col("p_partkey").cast("string").alias("question_id"), F.concat(F.lit(" "), F.col("p_name")).alias("question"), options.alias("options"))
    keys = p.filter(F.col("p_partkey") % 4 != 0).select(
        F.lit("bank").alias("instrument_key"), F.col("p_partkey").cast("string").alias("question_id"),
        F.substring(F.lit("ABC"), (1 + F.col("p_partkey") % 3).cast("int"), F.lit(1)).alias("answer"))
    df = src.item_records(bank, keys, ["3", "5"])
    return df.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit("="), o["text"])), "|"))


@query("depends_on_figure", "SELECT p_partkey, p_size % 3 = 0 OR p_size % 5 = 0 AS fig FROM part")
def _(spark, sf):
    p = t.table(spark, sf, "part")
    extra = F.when(F.col("p_size") % 3 == 0, " look at the TREE ").when(F.col("p_size") % 5 == 0, " (see Figure).").otherwise(" figurative imagery ")
    return p.select("p_partkey", tx.depends_on_figure(F.concat("p_name", extra)).alias("fig"))


@query("option_letter", sql("SELECT response_value, CASE WHEN response_value LIKE '%: option' THEN substr(response_value, 1, 1) END AS letter, count(*) AS n FROM responses GROUP BY 1, 2", "responses"))
def _(spark, sf):
    return t.responses(spark, sf).groupBy("response_value", tx.option_letter(F.col("response_value")).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


INDICATORS = ["'the whole things' matter", "and then", "erres thing onen"]


@query("matched_indicators", """SELECT doc_id, (contains(lower(text), 'whole') AND contains(lower(text), 'things') AND contains(lower(text), 'matter')) AS i1,
   contains(lower(text), 'then') AS i2, (contains(lower(text), 'erres') AND contains(lower(text), 'thing') AND contains(lower(text), 'onen')) AS i3 FROM documents""")
def _(spark, sf):
    d = t.table(spark, sf, "documents")
    hit = tx.matched_indicators(F.col("text"), F.array(F.lit("")), F.array(*[F.lit(i) for i in INDICATORS]))
    return d.select("doc_id", *[F.array_contains(hit, i).alias(f"i{n}") for n, i in enumerate(INDICATORS, 1)])


@query("numeric_functions", """SELECT l_linenumber, l_returnflag, count(*) AS n, round(1 / (1 + exp(-avg(l_discount * 10))), 6) AS sig, round(2 * avg(l_tax) / (1 + avg(l_tax)), 6) AS sb,
   round(avg(l_quantity) / sqrt(1 + avg(l_quantity) * avg(l_quantity)), 6) AS loading, round(-2 * -sum(l_tax) + 2 * 3, 4) AS aic, round(-2 * -sum(l_tax) + 3 * ln(count(*)), 4) AS bic,
   CASE WHEN avg(l_discount) >= 0.0505 THEN 'large' WHEN avg(l_discount) >= 0.05 THEN 'medium' WHEN avg(l_discount) >= 0.049 THEN 'small' ELSE 'negligible' END AS label FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    g = t.table(spark, sf, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("l_discount") * 10).alias("d"), F.avg("l_tax").alias("x"), F.avg("l_quantity").alias("a"), F.sum("l_tax").alias("s"), F.avg("l_discount").alias("e"))
    three = F.lit(3)
    return g.select(
        "l_linenumber", "l_returnflag", "n", F.round(nb.sigmoid(F.col("d")), 6).alias("sig"), F.round(nb.spearman_brown(F.col("x")), 6).alias("sb"), F.round(nb.irt_loading(F.col("a")), 6).alias("loading"),
        F.round(nb.aic(-F.col("s"), three), 4).alias("aic"), F.round(nb.bic(-F.col("s"), three, F.col("n")), 4).alias("bic"),
        nb.band(F.col("e"), [(0.0505, "large"), (0.05, "medium"), (0.049, "small")], "negligible").alias("label"))


@query("repair_replies", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'a b' AS s FROM events")
def _(spark, sf):
    e = t.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    head = F.concat(F.lit('{"k": '), k, F.lit(', "s": "a b"'))
    broken = (
        F.when(F.col("event_id") % 4 == 0, F.concat(head, F.lit("}")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), head, F.lit("}\n```\nDone")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"k": '), k, F.lit(', "s": "a\nb"}')))
        .otherwise(F.concat(head, F.lit(', "list": [1, {"x": "cut of')))
    )
    parsed = F.from_json(rp.reply_json(broken), "k int, s string")
    return e.select("event_id", parsed["k"].alias("k"), parsed["s"].alias("s"))


@query("schema_errors", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'missing:level' WHEN 2 THEN 'unexpected:extra' WHEN 3 THEN 'type:level' ELSE 'value:letters' END AS errors FROM events""")
def _(spark, sf):
    e = t.table(spark, sf, "events")
    j = (
        F.when(F.col("event_id") % 5 == 0, '{"level": 2, "why": "x", "letters": ["A"]}').when(F.col("event_id") % 5 == 1, '{"why": "x", "letters": []}')
        .when(F.col("event_id") % 5 == 2, '{"level": 3, "why": "x", "letters": ["B"], "extra": 1}').when(F.col("event_id") % 5 == 3, '{"level": "two", "why": "x", "letters": ["B"]}')
        .otherwise('{"level": 1, "why": "x", "letters": ["A", "Z"]}')
    )
    errs = rp.schema_errors(j, ["level", "why", "letters"], {"level": "integer", "why": "string", "letters": "array"}, {"level": [1, 2, 3], "letters": ["A", "B"]})
    return e.select("event_id", F.array_join(errs, "; ").alias("errors"))


@query("rubric_parse", "SELECT event_id, greatest(1, least(4, CAST(json_extract_string(props, '$.k') AS INT) - 3)) AS depth, 1 AS voice, length(concat('because ', event_type)) AS len FROM events")
def _(spark, sf):
    e = t.table(spark, sf, "events")
    j = F.concat(F.lit('{"scores": {"depth": '), (F.get_json_object("props", "$.k").cast("int") - 3).cast("string"), F.lit(', "voice": "n/a"}, "justification": "because '), F.col("event_type"), F.lit('"}'))
    s = rp.rubric_scores(j, ["depth", "voice"])
    return e.select("event_id", s[0]["score"].alias("depth"), s[1]["score"].alias("voice"), F.length(rp.rubric_justification(j)).alias("len"))


# -- codes -------------------------------------------------------------------------------------


def codes(spark, sf):
    e = t.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("code_id"), "embedding", "label")


UNIT = "un AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings)"


@query("similar_pairs", f"WITH {UNIT} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / (a.nrm * b.nrm), 4) AS similarity, CAST(1 AS BIGINT) AS n_a, CAST(1 AS BIGINT) AS n_b FROM un a JOIN un b ON a.vec_id < b.vec_id AND list_dot_product(a.e, b.e) / (a.nrm * b.nrm) >= 0.3")
def _(spark, sf):
    return cd.similar_pairs(codes(spark, sf), 0.3, exact=True)


def _noisy(weight, pair):
    return pair["e"] + F.lit(weight) * pair["f"]


def planted(spark, sf):
    """All codes, and for every fifth of them noisy copies before and after it; for every tenth an exact copy too."""
    e = t.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    both = e.filter("vec_id % 5 = 0").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    out = e.select(F.col("vec_id").alias("code_id"), "label", F.col("e").alias("embedding"))
    for number, weight, every in ((F.col("vec_id") + 1000000, 0.1, 5), (-1 - F.col("vec_id"), 0.25, 5), (F.col("vec_id") + 2000000, 0.4, 5), (F.col("vec_id") + 3000000, 0.0, 10)):
        noisy = F.transform(F.arrays_zip("e", "f"), partial(_noisy, weight))
        out = out.unionByName(both.filter(f"vec_id % {every} = 0").select(number.alias("code_id"), "label", noisy.alias("embedding")))
    return out


PLANTED = """RECURSIVE em AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
   bo AS (SELECT em.vec_id, em.label, em.e, n.e AS f FROM em JOIN em n ON n.vec_id = em.vec_id + 1 WHERE em.vec_id % 5 = 0),
   pl AS (SELECT vec_id AS code_id, label, e FROM em
     UNION ALL SELECT vec_id + 1000000, label, list_transform(list_zip(e, f), lambda p: p[1] + 0.1::DOUBLE * p[2]) FROM bo
     UNION ALL SELECT -1 - vec_id, label, list_transform(list_zip(e, f), lambda p: p[1] + 0.25::DOUBLE * p[2]) FROM bo
     UNION ALL SELECT vec_id + 2000000, label, list_transform(list_zip(e, f), lambda p: p[1] + 0.4::DOUBLE * p[2]) FROM bo
     UNION ALL SELECT vec_id + 3000000, label, e FROM bo WHERE vec_id % 10 = 0),
   dv AS (SELECT min(code_id) AS rep, count(*) AS n, e, sqrt(list_dot_product(e, e)) AS nrm FROM pl GROUP BY e),
   pr AS (SELECT a.rep AS a, b.rep AS b, list_dot_product(a.e, b.e) / (a.nrm * b.nrm) AS s, a.n AS n_a, b.n AS n_b FROM dv a JOIN dv b ON a.rep < b.rep)"""
# a scan in order: the state is the list of leaders so far
LED = """od AS (SELECT dv.rep, row_number() OVER (ORDER BY dv.rep) AS i, coalesce(any_value(nb.l), []) AS l FROM dv LEFT JOIN (SELECT b, list(a) AS l FROM pr WHERE s >= {t} GROUP BY b) nb ON nb.b = dv.rep GROUP BY dv.rep),
   g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS led UNION ALL SELECT od.i, CASE WHEN list_has_any(g.led, od.l) THEN g.led ELSE list_append(g.led, od.rep) END FROM g JOIN od ON od.i = g.i + 1),
   fin AS (SELECT led FROM g ORDER BY i DESC LIMIT 1),
   ld AS (SELECT od.rep, coalesce(list_min(list_intersect(od.l, fin.led)), od.rep) AS leader FROM od, fin),
   lk AS (SELECT pl.code_id, pl.label, pl.e, dv.nrm, ld.leader AS leader_id FROM pl JOIN dv ON pl.e = dv.e JOIN ld ON ld.rep = dv.rep)"""


for percent in (75, 85):

    @query(f"similar_codes_{percent}", f"WITH {PLANTED} SELECT a, b, round(s, 4) AS similarity, n_a, n_b FROM pr WHERE s >= {percent / 100}")
    def _(spark, sf, threshold=percent / 100):
        return cd.similar_pairs(planted(spark, sf), threshold)


@query("deduplicate_codes", f"WITH {PLANTED}, {LED.format(t=0.85)} SELECT leader_id AS code_id, count(*) - 1 AS merged_count FROM lk GROUP BY 1")
def _(spark, sf):
    return cd.deduplicate_codes(planted(spark, sf))


@query("dedup_links", f"WITH {PLANTED}, {LED.format(t=0.85)} SELECT code_id, leader_id FROM lk")
def _(spark, sf):
    return cd.dedup_links(planted(spark, sf))


@query("cluster_codes", f"""WITH {PLANTED}, {LED.format(t=0.75)}, pm AS (SELECT x.leader_id, avg(list_dot_product(x.e, y.e) / (x.nrm * y.nrm)) AS m FROM lk x JOIN lk y ON x.leader_id = y.leader_id AND x.code_id < y.code_id GROUP BY 1)
   SELECT lk.leader_id AS representative, count(*) AS cluster_size, round(coalesce(any_value(pm.m), 1.0), 4) AS avg_similarity FROM lk LEFT JOIN pm ON pm.leader_id = lk.leader_id GROUP BY 1""")
def _(spark, sf):
    return cd.cluster_codes(planted(spark, sf))


@query("cluster_members", f"""WITH {PLANTED}, {LED.format(t=0.75)} SELECT x.leader_id AS representative, x.code_id, x.label, round(CASE WHEN x.code_id = h.code_id THEN 1 ELSE list_dot_product(x.e, h.e) / (x.nrm * h.nrm) END, 4) AS similarity
   FROM lk x JOIN lk h ON h.code_id = x.leader_id""")
def _(spark, sf):
    return cd.cluster_members(planted(spark, sf)).select("representative", "code_id", "label", "similarity")


@query("removed_codes", "SELECT vec_id, label FROM embeddings WHERE (vec_id % 50, concat('code ', CAST(label AS VARCHAR))) NOT IN (SELECT vec_id % 50, concat('code ', CAST(label AS VARCHAR)) FROM embeddings WHERE vec_id % 3 = 0)")
def _(spark, sf):
    e = t.table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 50).alias("chunk_index"), F.concat(F.lit(" Code "), F.col("label").cast("string")).alias("name"))
    return cd.removed_codes(e, e.filter("vec_id % 3 = 0")).select("vec_id", "label")


def themes(spark, sf):
    """Themes of four runs: per (run, label) the mean vector of its codes."""
    e = t.table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("r"), "label", F.posexplode("embedding").alias("d", "x"))
    mean = e.groupBy("r", "label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = mean.groupBy("r", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("embedding"))
    name = F.concat(F.lit("theme "), F.element_at(F.array(*[F.lit(w) for w in ("alpha", "beta", "gamma")]), (F.col("label") % 3 + 1).cast("int")))
    return vec.select(
        F.concat(F.lit("run"), F.col("r").cast("string")).alias("run"), F.col("label").cast("bigint").alias("pos"), F.concat(name, F.lit(" "), F.col("label").cast("string")).alias("name"),
        "embedding", tx.word_set(F.concat(name, F.lit(" run "), F.when(F.col("r") % 2 == 0, "even").otherwise("odd"))).alias("words"))


THEMES = """mv AS (SELECT vec_id % 4 AS r, label, d, avg(x) AS x FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1, 2, 3),
   th AS (SELECT r, label, list(x ORDER BY d) AS e, sqrt(sum(x * x)) AS nrm, (['alpha', 'beta', 'gamma'])[CAST(label % 3 + 1 AS INT)] AS w1, CASE WHEN r % 2 = 0 THEN 'even' ELSE 'odd' END AS w2 FROM mv GROUP BY 1, 2),
   sc AS (SELECT a.r AS ra, b.r AS rb, a.label AS la, b.label AS lb, a.w1 AS w1, b.w1 AS w1b, list_dot_product(a.e, b.e) / (a.nrm * b.nrm) AS cos,
     (2 + CASE WHEN a.w1 = b.w1 THEN 1 ELSE 0 END + CASE WHEN a.w2 = b.w2 THEN 1 ELSE 0 END) / (8 - (2 + CASE WHEN a.w1 = b.w1 THEN 1 ELSE 0 END + CASE WHEN a.w2 = b.w2 THEN 1 ELSE 0 END))::DOUBLE AS jac
     FROM th a JOIN th b ON a.r <> b.r)"""


@query("align_themes", f"""WITH {THEMES}, b AS (SELECT *, row_number() OVER (PARTITION BY la ORDER BY round(0.7 * cos + 0.3 * jac, 9) DESC, lb) AS rn FROM sc WHERE ra = 0 AND rb = 1)
   SELECT la AS pos, concat('theme ', w1, ' ', CAST(la AS VARCHAR)) AS theme, concat('theme ', w1b, ' ', CAST(lb AS VARCHAR)) AS best_match, round(0.7 * cos + 0.3 * jac, 4) AS agreement,
   CASE WHEN 0.7 * cos + 0.3 * jac >= 0.8 THEN 'strong' WHEN 0.7 * cos + 0.3 * jac >= 0.65 THEN 'moderate' WHEN 0.7 * cos + 0.3 * jac >= 0.5 THEN 'weak' ELSE 'poor' END AS interpretation FROM b WHERE rn = 1""")
def _(spark, sf):
    th = themes(spark, sf)
    return cd.align_themes(th.filter("run = 'run0'").drop("run"), th.filter("run = 'run1'").drop("run"))


@query("compare_runs")
def _(spark, sf):
    return cd.compare_runs(themes(spark, sf))


@query("compare_all_runs")
def _(spark, sf):
    return cd.compare_all_runs(cd.compare_runs(themes(spark, sf)))


@query("run_agreement")
def _(spark, sf):
    return cd.run_agreement(cd.compare_runs(themes(spark, sf)))


@query("factorial_agreement", f"""WITH {THEMES}, p AS (SELECT CASE WHEN ra % 2 = rb % 2 THEN 'same_model' ELSE 'diff_model' END || '_' || CASE WHEN (ra < 2) = (rb < 2) THEN 'same_temp' ELSE 'diff_temp' END AS pair_group, round(avg(jac), 6) AS a FROM sc WHERE ra < rb GROUP BY ra, rb)
   SELECT pair_group, count(*) AS n_pairs, round(avg(a), 4) AS mean_agreement FROM p GROUP BY 1""")
def _(spark, sf):
    th = themes(spark, sf)
    a = th.select(F.col("run").alias("run_a"), F.col("words").alias("wa"))
    partners = F.filter(F.array(*[F.lit(f"run{i}") for i in range(4)]), lambda x: x > F.col("run_a"))
    pairs = a.withColumn("run_b", F.explode(partners)).join(th.select(F.col("run").alias("run_b"), F.col("words").alias("wb")), "run_b")
    summary = pairs.groupBy("run_a", "run_b").agg(F.round(F.avg(tx.jaccard(F.col("wa"), F.col("wb"))), 6).alias("agreement"))
    r = F.substring("run", 4, 9).cast("int")
    runs = th.select("run").distinct().select("run", (r % 2).alias("model"), (r < 2).alias("temperature"))
    return cd.factorial_agreement(summary, runs).select("pair_group", "n_pairs", "mean_agreement")


def themed(spark, sf):
    e = t.table(spark, sf, "embeddings")
    base = e.select(F.concat(F.lit("run"), (F.col("vec_id") % 4).cast("string")).alias("run"), F.col("vec_id").alias("code_id"), (F.col("vec_id") % 60).alias("chunk_index"),
                    F.concat(F.lit("code "), F.col("vec_id").cast("string")).alias("name"), F.concat(F.lit("about "), F.col("label").cast("string")).alias("description"),
                    F.when(F.col("vec_id") % 5 != 0, F.concat(F.lit("quote "), F.col("vec_id").cast("string"))).otherwise(" ").alias("quote"), F.concat(F.lit("d"), (F.col("vec_id") % 37).cast("string")).alias("participant_id"), "label")
    th = base.groupBy("run", F.concat(F.lit("T"), F.col("label").cast("string")).alias("theme"), F.col("label").alias("theme_index")).agg(F.sort_array(F.collect_set(F.when(F.col("code_id") % 3 == 0, F.col("chunk_index")))).alias("code_indices"))
    th = th.withColumn("code_indices", F.when(F.col("theme_index") % 4 != 0, F.col("code_indices")))
    return base, th


LINKED = """cb AS (SELECT concat('run', CAST(vec_id % 4 AS VARCHAR)) AS run, vec_id AS code_id, vec_id % 60 AS chunk_index, label, CASE WHEN vec_id % 5 <> 0 THEN concat('quote ', CAST(vec_id AS VARCHAR)) ELSE ' ' END AS quote FROM embeddings),
   ix AS (SELECT DISTINCT run, label, chunk_index FROM cb WHERE code_id % 3 = 0 AND label % 4 <> 0), tl AS (SELECT DISTINCT run, label FROM cb),
   lk AS (SELECT ix.run, concat('T', CAST(ix.label AS VARCHAR)) AS theme, cb.code_id, quote FROM ix JOIN cb ON cb.run = ix.run AND cb.chunk_index = ix.chunk_index
     UNION ALL SELECT tl.run, concat('T', CAST(tl.label AS VARCHAR)), cb.code_id, quote FROM tl JOIN cb ON cb.run = tl.run WHERE tl.label % 4 = 0)"""


@query("theme_codes", f"WITH {LINKED} SELECT run, theme, code_id FROM lk")
def _(spark, sf):
    base, th = themed(spark, sf)
    return cd.theme_codes(th, base).select("run", "theme", "code_id")


@query("top_quotes_per_theme", f"WITH {LINKED} SELECT run, theme, CAST(rn AS INT) AS position, quote FROM (SELECT *, row_number() OVER (PARTITION BY run, theme ORDER BY code_id) AS rn FROM lk WHERE trim(quote) <> '') WHERE rn <= 3")
def _(spark, sf):
    base, th = themed(spark, sf)
    return cd.top_quotes(cd.theme_codes(th, base))


# -- model-driven steps (a deterministic stand-in answers) --------------------------------------


def stub_codes(prompt: str) -> dict:
    body = prompt.split("\n", 3)[-1]
    words = body.split()
    if len(words) % 13 == 0:
        return {"text": "", "error": "overloaded"}
    codes = [{"name": f"code {w[:6].lower()}", "description": f"about {w}", "quote": w} for w in words[:3]]
    return {"text": "```json\n" + json.dumps({"codes": codes}) + "\n```", "error": None, "tokens_used": len(prompt) // 4}


def stub_themes(prompt: str) -> dict:
    lines = prompt.split("\n")[2:]
    wanted = int(prompt.split("\n")[1].split(": ")[1])
    idx = [int(l.split(" | ")[0]) for l in lines if l.split(" | ")[0].isdigit()]
    out = [{"name": f"theme {i}", "description": "d", "code_indices": sorted(set(idx[i::wanted]))} for i in range(wanted)]
    return {"text": json.dumps({"themes": out}), "error": None, "tokens_used": 1}


def stub_summary(prompt: str) -> dict:
    return {"text": json.dumps({"name": f"N{len(prompt) % 100}", "summary": f"{sum(x.startswith('* ') for x in prompt.splitlines())} codes"}), "error": None, "tokens_used": 1}


def stub_report(prompt: str) -> dict:
    return {"text": f" report over {sum(x.startswith('# ') for x in prompt.splitlines())} themes ", "error": None, "tokens_used": 1}


def stub_evidence(prompt: str) -> dict:
    n = len(prompt) % 4
    inst = [{"quote": f"q{i}", "valence": ("positive", "negative", "neutral")[i % 3]} for i in range(n)]
    return {"text": json.dumps({"evidence_count": n, "instances": inst}), "error": None, "tokens_used": 1}


def stub_objective(prompt: str) -> dict:
    return {"text": json.dumps({"evidence_present": int("a" in prompt.rsplit("\n", 1)[-1][:5]), "evidence_quote": prompt[-10:]}), "error": None, "tokens_used": 1}


def stub_rubric(prompt: str) -> dict:
    n = len(prompt)
    return {"text": json.dumps({"scores": {"depth": n % 7, "transfer": n % 5, "voice": "x"}, "justification": "j" * 600}), "error": None, "tokens_used": 1}


def stub_rating(prompt: str) -> dict:
    return {"text": json.dumps({"bloom_level": len(prompt) % 8, "needs_figure": len(prompt) % 2 == 0, "solved_answer": "ABC"[len(prompt) % 3], "key_defensible": "yes"}), "error": None, "tokens_used": 5}


@query("chunk_transcripts")
def _(spark, sf):
    return co.chunk_transcripts(documents(spark, sf), 500)


@query("chunk_words", r"SELECT concat('d', CAST(doc_id AS VARCHAR)) AS participant_id, len(list_filter(string_split_regex(text, '[\s]+'), lambda x: x <> '')) AS n_words, true AS in_order FROM documents WHERE trim(text) <> ''")
def _(spark, sf):
    """Chunks lose no word, and their numbers run through without a gap."""
    c = co.chunk_transcripts(documents(spark, sf), 500)
    n = F.sum(F.size(F.filter(F.split("content", r"\s+"), lambda x: x != "")))
    return c.groupBy("participant_id").agg(n.alias("n_words"), (F.max("chunk_index") - F.min("chunk_index") + 1 == F.count(F.lit(1))).alias("in_order"))


@query("code_chunks")
def _(spark, sf):
    return co.code_chunks(co.chunk_transcripts(documents(spark, sf), 2500), stub_codes, "Name the codes.")


@query("code_documents", r"""WITH w AS (SELECT concat('d', CAST(doc_id AS VARCHAR)) AS participant_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE trim(text) <> ''),
   c AS (SELECT participant_id, ws, unnest(range(1, least(3, len(ws)) + 1)) AS p FROM w WHERE len(ws) % 13 <> 0)
   SELECT participant_id, CAST(p - 1 AS INT) AS position, concat('code ', lower(substr(ws[p], 1, 6))) AS name, concat('about ', ws[p]) AS description, ws[p] AS quote, CAST(NULL AS VARCHAR) AS error FROM c
   UNION ALL SELECT participant_id, NULL, NULL, NULL, NULL, 'overloaded' FROM w WHERE len(ws) % 13 = 0""")
def _(spark, sf):
    """Every document is one chunk; some calls fail and stay as rows."""
    coded = co.code_chunks(co.chunk_transcripts(documents(spark, sf), 100_000_000), stub_codes, "Name the codes.")
    return coded.select("participant_id", "position", "name", "description", "quote", "error")


@query("group_codes")
def _(spark, sf):
    base, _ = themed(spark, sf)
    return co.group_codes(base, stub_themes, "Group the codes.").withColumn("code_indices", F.to_json("code_indices"))


@query("define_themes", f"WITH {LINKED} SELECT run, theme, 0 AS batch, CAST(count(*) AS VARCHAR) || ' codes' AS summary, count(*) AS n_lines FROM lk GROUP BY 1, 2")
def _(spark, sf):
    base, th = themed(spark, sf)
    df = co.define_themes(cd.theme_codes(th, base), stub_summary, "Define the theme.")
    return df.select("run", "theme", "batch", "summary", "n_lines")


@query("write_report", f"WITH {LINKED} SELECT run, 0 AS batch, count(DISTINCT label) AS n_themes, concat('report over ', CAST(count(DISTINCT label) AS VARCHAR), ' themes') AS report_text, CAST(NULL AS VARCHAR) AS error, 0 AS failed_parts FROM tl GROUP BY 1")
def _(spark, sf):
    base, th = themed(spark, sf)
    quotes = cd.top_quotes(cd.theme_codes(th, base))
    return co.write_report(th.withColumn("summary", F.lit("s")), quotes, stub_report, "Write it.")


def stub_outage(prompt: str) -> dict:
    """Answers like ``stub_report``, but not on parts about the themes T1, T5 and T9."""
    if any(f"# T{i} |" in prompt for i in (1, 5, 9)):
        return {"text": None, "error": "overloaded", "tokens_used": 0}
    return stub_report(prompt)


@query("report_with_failed_parts", """WITH tl AS (SELECT DISTINCT vec_id % 4 AS r, label FROM embeddings UNION ALL SELECT 9, 1 UNION ALL SELECT 9, 5)
   SELECT concat('run', CAST(r AS VARCHAR)) AS run, greatest(1, count(*) FILTER (label NOT IN (1, 5, 9))) AS n_themes, count(*) FILTER (label IN (1, 5, 9)) AS failed_parts, 'overloaded' AS error,
   count(*) FILTER (label NOT IN (1, 5, 9)) > 0 AS written FROM tl GROUP BY r""")
def _(spark, sf):
    """Every theme is a part of its own; some parts fail, and all parts of run9 do."""
    _, th = themed(spark, sf)
    th = th.select("run", "theme", "theme_index").unionByName(th.filter("theme_index IN (1, 5)").select(F.lit("run9").alias("run"), "theme", "theme_index").distinct())
    quotes = spark.createDataFrame([], "run string, theme string, position int, quote string")
    out = co.write_report(th.withColumn("summary", F.lit("s")), quotes, stub_outage, "Write it.", budget=1)
    return out.select("run", "n_themes", "failed_parts", "error", F.col("report_text").isNotNull().alias("written"))


BOOK = [
    {"name": "self_efficacy", "group": "motivation", "definition": "belief in oneself", "indicators": INDICATORS[:2]},
    {"name": "interest", "group": "engagement", "definition": "curiosity", "indicators": INDICATORS[2:]},
]


# the prompt's length modulo four is the number of instances; valences go round
@query("extract_evidence", f"""WITH b AS (SELECT unnest(['self_efficacy', 'interest']) AS construct_name, unnest(['motivation', 'engagement']) AS construct_group,
     unnest([length('Self Efficacy') + length('belief in oneself') + {len("; ".join(INDICATORS[:2]))}, length('Interest') + length('curiosity') + {len(INDICATORS[2])}]) AS k),
   u AS (SELECT concat('d', CAST(doc_id AS VARCHAR)) AS participant_id, construct_name, construct_group, (length('Find evidence.') + 1 + 4 + 1 + length('Look for: ') + 1 + 1 + 1 + k + length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) % 4 AS n
     FROM documents, b WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')
   SELECT participant_id, construct_name, construct_group, CAST(n AS INT) AS evidence_count, CAST(n >= 1 AS INT) AS valence_positive, CAST(n >= 2 AS INT) AS valence_negative, CAST(n >= 3 AS INT) AS valence_neutral,
   CASE n WHEN 0 THEN '' WHEN 1 THEN 'q0' WHEN 2 THEN 'q0,q1' ELSE 'q0,q1,q2' END AS quotes, 'm1' AS model, 1 AS tokens_used, CAST(NULL AS VARCHAR) AS error FROM u""")
def _(spark, sf):
    df = co.extract_evidence(documents(spark, sf), BOOK, stub_evidence, "Find evidence.", "goal", "m1")
    return df.drop("prompt", "reply", "matched_indicators").withColumn("quotes", F.array_join("instances.quote", ",")).drop("instances")


def stub_echo(prompt: str) -> dict:
    return {"text": "; ".join(prompt.split("\n")[1:]), "error": None, "tokens_used": 1}


EVIDENCED = f"""b AS (SELECT unnest(['self_efficacy', 'interest']) AS construct_name, unnest(['motivation', 'engagement']) AS construct_group,
     unnest([length('Self Efficacy') + length('belief in oneself') + {len("; ".join(INDICATORS[:2]))}, length('Interest') + length('curiosity') + {len(INDICATORS[2])}]) AS k),
   u AS (SELECT concat('run', CAST(doc_id % 3 AS VARCHAR)) AS run, construct_name, construct_group, (length('Find evidence.') + length('Look for: ') + 5 + k + length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) % 4 AS n
     FROM documents, b WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
   ct AS (SELECT run, construct_name, sum(n) AS e, count(*) FILTER (n >= 1) AS p, count(*) FILTER (n >= 2) AS g, count(*) FILTER (n >= 3) AS o FROM u GROUP BY 1, 2)"""


# the model's stand-in repeats its prompt, so the narrative is the construct table
@query("deductive_report", f"""WITH {EVIDENCED} SELECT run, 2 AS n_constructs, 2 AS n_rows, string_agg(concat(construct_name, ': evidence=', CAST(e AS VARCHAR), ', positive=', CAST(p AS VARCHAR), ', negative=', CAST(g AS VARCHAR), ', neutral=', CAST(o AS VARCHAR), ', participants=', CAST(p AS VARCHAR)), '; ' ORDER BY construct_name) AS report_text,
   CAST(NULL AS VARCHAR) AS error, 0 AS failed_parts FROM ct GROUP BY run""")
def _(spark, sf):
    found = co.extract_evidence(documents(spark, sf), BOOK, stub_evidence, "Find evidence.")
    runs = found.withColumn("run", F.concat(F.lit("run"), (F.substring("participant_id", 2, 20).cast("bigint") % 3).cast("string")))
    return an.deductive_report(runs, stub_echo, "Write it.").withColumn("n_rows", F.size("construct_table")).drop("construct_table")


def letters(text):
    """A stand-in for a sentence encoder: how often the text has each letter."""
    return F.array(*[F.length(F.regexp_replace(F.lower(text), f"[^{c}]", "")).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])


MODELS = {"code": stub_codes, "group": stub_themes, "define": stub_summary, "report": stub_report}
TASKS = {"code": "Name the codes.", "group": "Group the codes.", "define": "Define the theme.", "report": "Write it."}


@query("inductive_analysis")
def _(spark, sf):
    """Documents to report in one chain: counts of every step and the narrative."""
    found = an.inductive_analysis(documents(spark, sf), MODELS, TASKS, letters, threshold=0.95)
    return found["summary"].join(found["report"].select("run", "n_themes", "report_text", "error").withColumnRenamed("n_themes", "n_reported"), "run")


@query("objective_evidence", """WITH t AS (SELECT concat('d', CAST(doc_id AS VARCHAR)) AS participant_id, doc_id % 9 AS m, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS c FROM documents),
   u AS (SELECT *, substr(string_split(c, chr(10))[-1], 1, 5) AS tail FROM t WHERE c <> '' AND m <> 8)
   SELECT participant_id, concat('module_', CAST(m AS VARCHAR)) AS module_id, i AS lo_index, CASE i WHEN 1 THEN 'name parts' ELSE 'compare parts' END AS lo_text, CAST(contains(tail, 'a') AS INT) AS evidence_present, CAST(NULL AS VARCHAR) AS error FROM u, (SELECT CAST(unnest([1, 2]) AS INT) AS i)""")
def _(spark, sf):
    docs = documents(spark, sf).withColumn("module_id", F.concat(F.lit("module"), (F.col("doc_order") % 9).cast("string"), F.lit("_module_reflections")))
    goals = docs.select(tx.reflection_module(F.col("module_id")).alias("module_id")).distinct().filter("module_id <> 'module_8'").select(
        "module_id", F.concat(F.lit("On "), F.col("module_id")).alias("title"), F.array(F.lit("name parts"), F.lit("compare parts")).alias("objectives"))
    return co.objective_evidence(docs, goals, stub_objective, "Check the objective.").drop("evidence_quote")


@query("score_rubric", f"""WITH {REFL}, f AS (SELECT user_id, arg_min(m, doc_id) AS m, question_id, arg_min(text, doc_id) AS text FROM rf GROUP BY 1, 3),
   n AS (SELECT *, length('Score it.') + 1 + length(concat('module_', CAST(m AS VARCHAR))) + 1 + length(question_id) + 1 + length(text) AS n FROM f),
   s AS (SELECT *, greatest(1, least(4, n % 7)) AS depth, greatest(1, least(4, n % 5)) AS transfer FROM n)
   SELECT user_id AS participant_id, concat('module_', CAST(m AS VARCHAR)) AS module_id, question_id, CAST(depth AS INT) AS depth, CAST(transfer AS INT) AS transfer, 1 AS voice,
   round((depth + transfer + 1) / 12.0, 4) AS cpi_qual_q, 500 AS why, CAST(NULL AS VARCHAR) AS error FROM s""")
def _(spark, sf):
    r = reflections(spark, sf).withColumnRenamed("instrument_name", "instrument_key").withColumn("module_id", tx.reflection_module(F.col("instrument_key")))
    df = co.score_rubric(st.reflection_texts(r), stub_rubric, "Score it.", ["depth", "transfer", "voice"])
    s = F.col("scores")
    return df.select("participant_id", "module_id", "question_id", s[0]["score"].alias("depth"), s[1]["score"].alias("transfer"), s[2]["score"].alias("voice"), "cpi_qual_q", F.length("justification").alias("why"), "error")


# a prompt's length decides the stand-in's reply; levels 0 and 7 are asked again with "value:bloom_level" below the prompt
RATED = """it AS (SELECT CAST(p_partkey AS VARCHAR) AS question_id, trim(p_name) AS text, CASE WHEN length(CAST(p_partkey AS VARCHAR)) % 2 = 0 THEN 'A' END AS k FROM part),
   fan AS (SELECT question_id, k, m AS model, s AS step, r AS repeat_no, 8 + 1 + length(s) + 1 + 2 + 1 + 1 + 1 + length(text) + 1 + CASE WHEN s = 'key' THEN coalesce(length(k), 0) ELSE 0 END AS n
     FROM it, (SELECT unnest(['m1', 'm2']) AS m), (SELECT * FROM (VALUES ('blind', 0), ('blind', 1), ('key', 0)) v(s, r))),
   rt AS (SELECT *, CASE WHEN step = 'blind' AND n % 8 IN (0, 7) THEN n + 18 ELSE n END AS e FROM fan WHERE step = 'blind' OR k IS NOT NULL)"""


@query("rate_items", f"""WITH {RATED} SELECT question_id, model, step, CAST(repeat_no AS INT) AS repeat_no, true AS ok, CASE WHEN e % 8 BETWEEN 1 AND 6 THEN CAST(e % 8 AS INT) END AS bloom_level,
   CASE WHEN k IS NOT NULL THEN substr('ABC', CAST(1 + e % 3 AS INT), 1) = k END AS blind_matches_key, e % 2 = 0 AS needs_figure, CASE WHEN e > n THEN 10 ELSE 5 END AS tokens_used, CAST(NULL AS VARCHAR) AS error FROM rt
   UNION ALL SELECT question_id, model, step, CAST(repeat_no AS INT), false, NULL, NULL, false, 0, 'no key' FROM fan WHERE step = 'key' AND k IS NULL""")
def _(spark, sf):
    return rated(spark, sf).select("question_id", "model", "step", "repeat_no", "ok", "bloom_level", "blind_matches_key", "needs_figure", "tokens_used", "error")


@query("rated_suggestions", f"""WITH {RATED} SELECT question_id, model, count(*) AS n_runs, median(e % 8)::DOUBLE AS level_median, CAST(min(e % 8) AS INT) AS level_min, CAST(max(e % 8) AS INT) AS level_max,
   bool_or(e % 2 = 0) AS needs_figure FROM rt WHERE step = 'blind' GROUP BY 1, 2""")
def _(spark, sf):
    """Ratings of a run straight into the suggestions of the review."""
    return ra.latest_suggestion(rated(spark, sf)).select("question_id", "model", "n_runs", "level_median", "level_min", "level_max", "needs_figure")


def rated(spark, sf):
    p = t.table(spark, sf, "part")
    options = F.array(F.concat(F.lit("A) "), F.col("p_type")), F.concat(F.lit("B) "), F.col("p_brand")))
    bank = p.select(F.lit("bank").alias("instrument_key"), F.col("p_partkey").cast("string").alias("question_id"), F.col("p_name").alias("question"), options.alias("options"))
    keys = bank.filter(F.length("question_id") % 2 == 0).select("instrument_key", "question_id", F.lit("A").alias("answer"))
    return co.rate_items(src.item_records(bank, keys), stub_rating, "Rate it.", ["m1", "m2"], 2, created_at="2024-01-01")


@query("summarize_corpus", """WITH f AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
   SELECT source, count(*) AS n_texts, source IN ('src1', 'src2') AS from_cache, replace(string_agg(concat('(', CAST(r AS VARCHAR), ') ', text), chr(10) || chr(10) ORDER BY r), chr(10), '; ') AS summary FROM f WHERE r <= 5 GROUP BY 1""")
def _(spark, sf):
    """The model's stand-in repeats the texts, so the summary shows which were sent, and in which order."""
    docs = documents(spark, sf)
    first = co.summarize_corpus(docs.filter(F.col("source").isin("src1", "src2")), 5, stub_echo, "Sum up.", by="source")
    again = co.summarize_corpus(docs, 5, stub_echo, "Sum up.", stored=first, by="source")
    return again.select("source", "n_texts", "from_cache", "summary")
