"""Scoring rules, imports, texts, codes and tables on small fixtures with known answers."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.core import ContractError
from scorewell.functions import replies as rp
from scorewell.functions import text as tx
from scorewell.operators import canonical as cn
from scorewell.operators import codes as cd
from scorewell.operators import pairs as pa
from scorewell.operators import coding as co
from scorewell.operators import descriptive as de
from scorewell.operators import psychometrics as ps
from scorewell.operators import registry as rg
from scorewell.operators import scores as sc
from scorewell.operators import scoring as sg
from scorewell.operators import validation as va
from scorewell.plans import tables as t
from scorewell.sources import responses as src
from scorewell.sources import sinks as sk
from scorewell.sources import texts as st
from scorewell.streaming.tables import KeyedTable

TS = lambda s: dt.datetime.fromisoformat(s)


def rules(spark, rows):
    return cn.pin_config(sg.rule_table(spark.createDataFrame(rows, src.SCORING_SCHEMA)))


def test_smallest_until_beyond_submission_wins(spark):
    book = rules(spark, [("m", "binary", {"Q1": "C: see", "Q2": "A"}, [(TS("2025-06-01"), {"Q1": "B"}), (TS("2024-06-01"), {"Q1": "A", "Q2": "D"})], None, None, None, None)])
    answers = [("Q1", " B: x ", "2024-05-31"), ("Q1", "A: x", "2024-05-31"), ("Q1", "B", "2024-06-01"), ("Q1", "C", "2025-06-01"), ("Q2", "A", "2024-12-01"), ("Q2", "D", "2024-01-01"), ("Q1", None, "2026-01-01"), ("Q9", "A", "2026-01-01")]
    df = spark.createDataFrame([("m", q, v, TS(d)) for q, v, d in answers], "instrument_key string, question_id string, response_value string, submitted_at timestamp")
    got = [r["item_score"] for r in sg.score_items(df, book).collect()]
    # a question the version in force does not list is NULL, a missing answer to a listed one is 0
    assert got == [0.0, 1.0, 1.0, 1.0, None, 1.0, 0.0, None]


def test_likert_reverse_and_unknown_labels(spark):
    book = rules(spark, [("s", "likert", None, None, {"Low": 1.0, "High": 2.0}, {"Low": 2.0, "High": 1.0}, ["Q2"], None)])
    df = spark.createDataFrame([("u", "s", q, v, TS("2025-01-01")) for q, v in [("Q1", "High"), ("Q2", "High"), ("Q1", "high"), ("Q3", "text")]], "user_id string, instrument_key string, question_id string, response_value string, submitted_at timestamp")
    assert [r["item_score"] for r in sg.score_items(df, book).collect()] == [2.0, 1.0, None, None]
    assert sg.instrument_totals(df, book).first()["total_score"] == 3.0


def test_totals_equal_canonical_sums(spark):
    df = t.scored(spark, "/root/testdata/sf0.001")
    per = df.groupBy("user_id", "instrument_key").agg(F.sum("item_score").alias("s"))
    totals = sg.instrument_totals(cn.normalize_schema(t.responses(spark, "/root/testdata/sf0.001")), t.rulebook(spark).rules).filter("error IS NULL")
    joined = totals.join(per, ["user_id", "instrument_key"])
    assert joined.filter(F.abs(F.col("total_score") - F.col("s")) > 1e-9).count() == 0 and joined.count() == totals.count()


def test_one_canonical_row_per_answer_and_excluding_a_user_leaves_the_rest(spark):
    sf = "/root/testdata/sf0.001"
    raw = t.responses(spark, sf)
    full = cn.canonical_dataset(raw, t.rulebook(spark))
    assert full.count() == raw.count() == full.select("user_id", "instrument_key", "question_id").distinct().count()
    less = cn.canonical_dataset(raw, t.rulebook(spark), excluded=[" U7 "])
    rest = full.filter("user_id <> 'u7'")
    assert less.exceptAll(rest).count() == 0 and rest.exceptAll(less).count() == 0


def test_contracts(spark):
    df = spark.createDataFrame([("u", 1)], "user_id string, x int")
    with pytest.raises(ContractError):
        cn.normalize_schema(df)
    with pytest.raises(ContractError):
        cn.FilterSpec(module_ids=[1]).apply(t.scored(spark, "/root/testdata/sf0.001"))
    with pytest.raises(ContractError):
        sc.summarize_scores(sc.assessment_scores(t.scored(spark, "/root/testdata/sf0.001"), t.SURVEYS), "gender")


def test_fingerprint_ignores_order_and_sees_change(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    b = a.repartition(3).orderBy(F.desc("a"))
    c = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    h = lambda d: cn.dataset_fingerprint(d, "cfg").first()["dataset_hash"]
    assert h(a) == h(b) != h(c)


def test_text_columns(spark):
    df = spark.createDataFrame([("B: text", "/x/Ana_Lee_interview_TRANSCRIPT.txt", "Q10"), ("b", "p 7_reflection.docx", "Q2")], "a string, p string, q string")
    rows = df.select(tx.normalize_choice(F.col("a")).alias("c"), tx.option_letter(F.col("a")).alias("l"), tx.participant_from_file(F.col("p")).alias("pid"), tx.natural_key(F.col("q")).alias("k")).collect()
    assert [tuple(r)[:3] for r in rows] == [("B", "B", "Ana_Lee"), ("b", "B", "p_7")]
    assert rows[1]["k"] < rows[0]["k"]


def test_item_hash_is_sha_of_json(spark):
    import hashlib
    import json

    for text, options in (("Pick one", [("A", "yes")]), ('Say "hi" é', [("A", "a \\ b"), ("B", "two\nlines")])):
        df = spark.createDataFrame([(text, options)], "t string, o array<struct<label:string,text:string>>")
        payload = json.dumps({"t": text, "o": options}, ensure_ascii=False, sort_keys=True)
        assert df.select(tx.item_hash(F.col("t"), F.col("o"))).first()[0] == hashlib.sha256(payload.encode()).hexdigest()[:16]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', '{"a": 1}'), ('Sure!\n```json\n{"a": "x\ny"}\n``` bye', '{"a": "x y"}'), ('{"a": [1, {"b": "cut of', '{"a": [1, {"b": "cut of"}]}'),
        ('{"a": 1,', '{"a": 1}'), ("no json", None), ("", None), (None, None), ('{"a": "q \\" {" }', '{"a": "q \\" {"}'),
    ],
)
def test_reply_repair(raw, want):
    assert rp.repair_json(raw) == want


def greedy(vectors, threshold):
    u = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-10)
    leader = np.full(len(u), -1)
    for i in range(len(u)):
        if leader[i] < 0:
            leader[i] = i
            for j in range(i + 1, len(u)):
                if leader[j] < 0 and u[i] @ u[j] >= threshold:
                    leader[j] = i
    return leader


def code_vectors(seed=0, n=300, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = centres[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, dim))
    v[rng.random(n) < 0.33] = v[5]  # a third of the codes are copies of one
    v[7] = 0.0
    v[9] = 0.0
    return v


def test_leader_rounds_equal_sequential_greedy(spark):
    v = code_vectors()
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "code_id bigint, embedding array<double>")
    want = greedy(v, 0.85)
    got = {r["code_id"]: r["leader_id"] for r in cd.dedup_links(df, 0.85, exact=True).collect()}
    assert [got[i] for i in range(len(v))] == want.tolist()
    kept = {r["code_id"]: r["merged_count"] for r in cd.deduplicate_codes(df, 0.85, exact=True).collect()}
    assert kept == {int(l): int((want == l).sum() - 1) for l in np.unique(want)}
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    for r in cd.cluster_codes(df, 0.85, exact=True).collect():
        members = u[want == r["representative"]]
        m = len(members)
        assert m == r["cluster_size"]
        sims = [members[a] @ members[b] for a, b in itertools.combinations(range(m), 2)]
        assert r["avg_similarity"] == pytest.approx(np.mean(sims) if sims else 1.0, abs=1e-4)


@pytest.mark.parametrize("block", [16, 1024])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cd, "BLOCK", block)
    v = code_vectors(3, 250)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "code_id bigint, embedding array<double>")
    first = {}
    for i, row in enumerate(v):
        first.setdefault(i if not row.any() else row.tobytes(), i)
    reps = sorted(first.values())
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    want = {(a, b): u[a] @ u[b] for a, b in itertools.combinations(reps, 2) if u[a] @ u[b] >= 0.8}
    rows = cd.similar_pairs(df, 0.8, exact=True).collect()
    got = {(r["a"], r["b"]): r["similarity"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    assert max(max(r["n_a"], r["n_b"]) for r in rows) == (v == v[5]).all(1).sum()


@pytest.mark.parametrize("threshold", [0.75, 0.85])
def test_index_finds_nearly_all_pairs_and_no_others(spark, monkeypatch, threshold):
    monkeypatch.setattr(pa, "HOT_BUCKET", 40)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(60, 32))
    v = centre[rng.integers(0, 60, 900)] + rng.uniform(0.1, 0.7, (900, 1)) * rng.normal(size=(900, 32))
    v[300:600] = v[5] + 0.2 * rng.normal(size=(300, 32))  # a third of the codes are near copies of one
    v[7] = 0.0
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "code_id bigint, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    sims = np.triu(u @ u.T, 1)
    want = set(zip(*(x.tolist() for x in np.nonzero(sims >= threshold)), strict=True))
    got = [(r["a"], r["b"]) for r in cd.similar_pairs(df, threshold, recall=0.95).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.97 * len(want)
    links = {r["code_id"]: r["leader_id"] for r in cd.dedup_links(df, threshold, exact=True).collect()}
    assert [links[i] for i in range(900)] == greedy(v, threshold).tolist() and links[900] == 900 and links[901] == 901


def test_band_plan_reaches_its_recall():
    for n in (10, 10_000, 10**8):
        for threshold in (0.6, 0.75, 0.85, 0.99, 1.0):
            bands, bits = pa.band_plan(n, threshold, 0.95)
            agree = 1 - max(0.05, np.arccos(threshold)) / np.pi
            assert 1 - (1 - agree**bits) ** bands >= 0.95 and 2**bits >= n / 32


def test_leader_rounds_are_few(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 3000, (6000, 2)).tolist() if a != b}
    earlier = {}
    for a, b in pairs:
        earlier.setdefault(b, []).append(a)
    want, leads = {}, set()
    for i in range(3000):
        mine = [a for a in earlier.get(i, []) if a in leads]
        if mine:
            want[i] = min(mine)
        else:
            leads.add(i)
    writes = []
    real = pa.materialize
    monkeypatch.setattr(pa, "materialize", lambda df, name: writes.append(name) or real(df, name))
    got = {r["code"]: r["leader"] for r in pa.ordered_leaders(spark.createDataFrame(sorted(pairs), "a bigint, b bigint")).collect()}
    assert got == want
    assert writes.count("followers") <= 2 * np.log2(3000)


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3), (1, 4), (6, 6)])
def test_assignment_is_optimal(shape):
    for seed in range(20):
        s = np.random.default_rng(seed).random(shape)
        cols = cd._assignment(s)
        used = [c for c in cols if c >= 0]
        assert len(set(used)) == len(used) == min(shape)
        total = sum(s[i, c] for i, c in enumerate(cols) if c >= 0)
        small = s if shape[0] <= shape[1] else s.T
        best = max(sum(small[i, p[i]] for i in range(small.shape[0])) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert total == pytest.approx(best)


def test_best_match_takes_first_on_tie(spark, monkeypatch):
    monkeypatch.setattr(cd, "BLOCK", 2)
    one = [(0, "q", [1.0, 0.0], ["x"])]
    cand = [(i, f"c{i}", [1.0, 0.0] if i in (3, 5) else [0.0, 1.0], ["x"]) for i in range(7)]
    schema = "pos bigint, name string, embedding array<double>, words array<string>"
    r = cd.best_match(spark.createDataFrame(one, schema), spark.createDataFrame(cand, schema)).first()
    assert r["best_match"] == "c3" and r["agreement"] == 1.0 and r["interpretation"] == "strong"


def test_compare_runs_unmatched_and_floor(spark):
    rows = [("a", 0, "x", [1.0, 0.0], ["u"]), ("a", 1, "y", [0.0, 1.0], ["v"]), ("b", 0, "z", [1.0, 0.0], ["u"])]
    th = spark.createDataFrame(rows, "run string, pos bigint, name string, embedding array<double>, words array<string>")
    m = {(r["run_a"], r["theme"]): r for r in cd.compare_runs(th).collect()}
    assert m["a", "x"]["best_match"] == "z" and m["a", "x"]["matched"] and m["a", "y"]["best_match"] is None and m["a", "y"]["agreement"] == 0.0
    assert cd.compare_all_runs(cd.compare_runs(th)).first()["agreement"] == pytest.approx(0.75)


def test_all_runs_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(cd, "RUN_BLOCK", 2)
    rng = np.random.default_rng(4)
    rows = [(f"r{r}", i, f"t{i}", [float(x) for x in rng.normal(size=5)], [f"w{w}" for w in rng.integers(0, 4, 2)]) for r in range(7) for i in range(1 + r % 4)]
    th = spark.createDataFrame(rows, "run string, pos bigint, name string, embedding array<double>, words array<string>")
    got = {(r["run_a"], r["run_b"]): r["n_themes_a"] for r in cd.run_agreement(cd.compare_runs(th)).collect()}
    assert got == {(f"r{a}", f"r{b}"): 1 + a % 4 for a in range(7) for b in range(7) if a != b}
    one = cd.run_agreement(cd.compare_runs(th.filter("run IN ('r2', 'r3')"))).collect()
    whole = {(r["run_a"], r["run_b"]): r["overall_agreement"] for r in cd.run_agreement(cd.compare_runs(th)).collect()}
    assert all(whole[r["run_a"], r["run_b"]] == r["overall_agreement"] for r in one)


def test_chunks_keep_every_word_and_numbering(spark):
    docs = [(3, "p1", "One two. Three four five! " * 20), (1, "p2", "word " * 400 + "end. Short one."), (2, "p1", "  "), (5, "p1", "Tail? Yes.")]
    df = spark.createDataFrame(docs, "doc_order bigint, participant_id string, content string")
    rows = co.chunk_transcripts(df, 40).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    for pid in ("p1", "p2"):
        words = sorted(" ".join(c for _, p, c in docs if p == pid).split())
        assert sorted(" ".join(r["content"] for r in rows if r["participant_id"] == pid).split()) == words
    assert rows[0]["participant_id"] == "p2" and all(r["token_estimate"] <= 60 for r in rows)
    last = [r for r in rows if r["participant_id"] == "p1"]
    assert [r["source_chunk"] for r in last] == list(range(len(last)))


def test_code_chunks_keep_failed_rows_and_stamp_ids(spark):
    def model(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        if "bad" in prompt:
            return {"text": "nothing", "error": None}
        return {"text": '{"codes": [{"name": "n", "chunk_index": 99, "participant_id": "zz"}]}', "error": None}

    chunks = spark.createDataFrame([(0, "a", "fine"), (1, "b", "boom"), (2, "c", "bad")], "chunk_index bigint, participant_id string, content string")
    out = {r["chunk_index"]: r for r in co.code_chunks(chunks, model, "x").collect()}
    assert out[0]["name"] == "n" and out[0]["participant_id"] == "a" and out[0]["error"] is None
    assert "down" in out[1]["error"] and out[2]["error"] == "unreadable_reply"


def test_long_code_list_is_asked_in_parts_and_merged(spark):
    def seen(prompt):
        numbers = [int(x.split(" | ")[0]) for x in prompt.split("\n")[2:]]
        return {"text": '{"themes": [{"name": "t%d", "code_indices": %s}]}' % (len(numbers), numbers), "error": None}

    rows = [("r", i, i, f"code {i}", "d" * 30, "", "p") for i in range(40)]
    df = spark.createDataFrame(rows, "run string, code_id bigint, chunk_index bigint, name string, description string, quote string, participant_id string")
    one = co.group_codes(df, seen, "x").collect()
    many = co.group_codes(df, seen, "x", budget=100).collect()
    assert len(one) == 1 and one[0]["name"] == "t40" and one[0]["n_wanted"] == 13
    assert len(many) == 1 and sorted(many[0]["code_indices"]) == list(range(40)) and int(many[0]["name"][1:]) < 40


def test_failed_parts_are_told(spark):
    def some(prompt):
        numbers = [int(x.split(" | ")[0]) for x in prompt.split("\n")[2:]]
        if 0 in numbers and "code" in prompt:
            return {"text": None, "error": "down"}
        return {"text": '{"themes": [{"name": "t", "code_indices": %s}]}' % numbers, "error": None}

    rows = [("r", i, i, f"code {i}", "d" * 30, "", "p") for i in range(40)]
    df = spark.createDataFrame(rows, "run string, code_id bigint, chunk_index bigint, name string, description string, quote string, participant_id string")
    (one,) = co.group_codes(df, some, "x", budget=100).collect()
    left = sorted(one["code_indices"])
    assert one["failed_parts"] == 1 and one["error"] == "down" and left == list(range(40 - len(left), 40)) and len(left) > 20
    (none,) = co.group_codes(df, lambda p: {"text": None, "error": "down"}, "x", budget=100).collect()
    assert none["name"] is None and none["error"] == "down" and none["failed_parts"] > 1
    (empty,) = co.group_codes(df, lambda p: {"text": '{"themes": []}', "error": None}, "x", budget=100).collect()
    assert empty["error"] == "empty_reply"
    (whole,) = co.group_codes(df, lambda p: {"text": None, "error": "down"}, "x").collect()
    assert whole["error"] == "down" and whole["failed_parts"] == 0


def test_inductive_chain(spark):
    import json

    from scorewell.operators import analysis as an

    def code(prompt):
        words = prompt.split("\n")[-1].split()
        if "boom" in words:
            return {"text": None, "error": "down"}
        return {"text": json.dumps({"codes": [{"name": w, "description": "", "quote": f"about {w}"} for w in words]}), "error": None}

    def group(prompt):
        rows = [x.split(" | ")[:2] for x in prompt.split("\n")[2:]]
        by = {}
        for number, name in rows:
            by.setdefault(name[0], []).append(int(number))
        return {"text": json.dumps({"themes": [{"name": k, "description": "", "code_indices": sorted(set(v))} for k, v in sorted(by.items())]}), "error": None}

    texts = ["apple pear apple", "avocado plum", "boom", "pear peach"]
    docs = spark.createDataFrame([(i, f"p{i}", x) for i, x in enumerate(texts)], "doc_order bigint, participant_id string, content string")
    models = {
        "code": code, "group": group, "define": lambda p: {"text": json.dumps({"name": "x", "summary": ",".join(x.split(" | ")[0][2:] for x in p.split("\n")[1:])}), "error": None},
        "report": lambda p: {"text": p.split("\n", 1)[1], "error": None},
    }
    vectors = lambda c: F.array(*[(c.startswith(w)).cast("double") for w in ("apple", "avocado", "pear", "peach", "plum")])
    found = an.inductive_analysis(docs, models, dict.fromkeys(models, "x"), vectors)
    s = found["summary"].first()
    assert (s.n_chunks, s.n_failed_chunks, s.n_codes, s.n_kept, s.n_themes) == (4, 1, 7, 5, 2)
    assert sorted(r["name"] for r in found["kept"].collect()) == ["apple", "avocado", "peach", "pear", "plum"]
    assert {r.theme: r.summary for r in found["definitions"].collect()} == {"a": "apple,pear,avocado,plum", "p": "apple,pear,avocado,plum,peach"}  # by chunk
    report = found["report"].first()
    assert report["n_themes"] == 2 and report["report_text"].startswith("# a | apple,pear,avocado,plum\n> about apple") and report["error"] is None


def test_deductive_chain(spark):
    import json

    from scorewell.operators import analysis as an

    book = [{"name": "interest", "group": "g", "definition": "d", "indicators": ["really keen learner"]}, {"name": "worry", "group": "g", "definition": "d", "indicators": []}]
    evidence = lambda p: {"text": json.dumps({"evidence_count": p.count("keen"), "instances": [{"quote": "keen", "valence": "positive"}] * p.split("\n")[-1].count("keen")}), "error": None}
    docs = spark.createDataFrame([("p1", "keen and keen"), ("p2", "bored"), ("p3", " ")], "participant_id string, content string")
    found = an.deductive_analysis(docs, book, {"evidence": evidence, "report": lambda p: {"text": p, "error": None}}, {"evidence": "x", "report": "Tell."}, run="r1")
    report = found["report"].first()
    assert report["n_constructs"] == 2 and [r["construct_name"] for r in report["construct_table"]] == ["interest", "worry"]
    assert report["report_text"].split("\n")[2] == "worry: evidence=2, positive=2, negative=0, neutral=0, participants=1"
    assert {r["participant_id"]: r["total_positive"] for r in found["profiles"].collect()} == {"p1": 4, "p2": 0}


def test_names_that_are_null_stay_in_the_prompt(spark):
    df = spark.createDataFrame([("r", "T", 1, None, "d", "q"), ("r", "T", 2, "n", None, None)], "run string, theme string, code_id bigint, name string, description string, quote string")
    reply = lambda p: {"text": '{"name": "x", "summary": "%d"}' % sum(x.startswith("* ") for x in p.splitlines()), "error": None}
    assert co.define_themes(df, reply, "x").first()["summary"] == "2"


def test_calls_are_made_once(spark, tmp_path):
    def model(prompt):
        (tmp_path / str(abs(hash(prompt)))).open("a").write("x")
        return {"text": '{"codes": [{"name": "n"}]}', "error": None}

    chunks = spark.createDataFrame([(i, "a", f"text {i}") for i in range(5)], "chunk_index bigint, participant_id string, content string")
    out = co.code_chunks(chunks, model, "x")
    assert out.count() == 5 and out.select("code_id").distinct().count() == 5
    assert [f.read_text() for f in tmp_path.iterdir()] == ["x"] * 5


def test_blank_reflections_become_error_rows(spark):
    df = spark.createDataFrame([("u", "module_1", "q", " "), ("v", "module_1", "q", "text")], "user_id string, module_id string, question_id string, text string")
    out = {r["participant_id"]: r for r in co.score_rubric(df, lambda p: {"text": '{"scores": {"depth": 3}}', "error": None}, "x", ["depth"]).collect()}
    assert out["u"]["error"] == "blank text" and out["v"]["error"] is None
    long = co.rubric_long(co.score_rubric(df, lambda p: {"text": '{"scores": {"depth": 3}}', "error": None}, "x", ["depth"])).collect()
    assert [(r["participant_id"], r["dimension"], r["score"]) for r in long] == [("v", "depth", 3)]


def test_saving_a_phase_keeps_the_other_phases(spark, tmp_path):
    from scorewell.sources import sinks

    df, path = spark.createDataFrame([(1,), (2,)], "x int"), str(tmp_path / "results")
    for phase, rows in ((1, df), (2, df), (2, df.filter("x = 1"))):
        sinks.save_results(rows, path, F.lit("r"), F.lit(phase))
    got = sorted((r["phase"], r["x"]) for r in sinks.load_results(spark, path, "x int").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_options_are_any_text_before_the_colon(spark):
    rows = [(f"u{i}", "m1_quiz", "module_1", f"Q{q}", v, float(v.startswith("True")), "2024-01-01") for i in range(20) for q, v in enumerate(["True" if i % 3 else "False", "AB: x" if i % 2 else "True: y"])]
    df = spark.createDataFrame(rows, "user_id string, instrument_key string, module_id string, question_id string, response_value string, item_score double, submitted_at string")
    out = {(r["item"], r["option"]) for r in ps.distractor_analysis(df, "quiz", 2).collect()}
    assert out == {("Q0", "True"), ("Q0", "False"), ("Q1", "AB"), ("Q1", "True")}


def good_import(spark):
    rows = [(f"S{u:02d}", "module_1", "module1_motivation_survey", f"Q{q}", "Agree", "3", "interest", "cohortX") for u in range(4) for q in range(3)]
    return spark.createDataFrame(rows, "user_id string, module_id string, instrument_key string, question_id string, response_value string, item_score string, construct string, cohort_id string")


@pytest.mark.parametrize(
    "check, change",
    [
        ("bad_user_id", lambda d: d.withColumn("user_id", F.when(F.col("user_id") == "S01", "Ann Lee").otherwise(F.col("user_id")))),
        ("empty_construct", lambda d: d.withColumn("construct", F.lit(" "))),
        ("user_in_several_cohorts", lambda d: d.withColumn("cohort_id", F.when((F.col("user_id") == "S01") & (F.col("question_id") == "Q1"), "other").otherwise(F.col("cohort_id")))),
        ("score_not_numeric", lambda d: d.withColumn("item_score", F.lit("abc"))),
        ("duplicate_rows", lambda d: d.unionByName(d.limit(1))),
        ("several_scores_for_one_answer", lambda d: d.withColumn("item_score", F.when(F.col("user_id") == "S02", "1").otherwise("3"))),
        ("unknown_instrument", lambda d: d.withColumn("instrument_key", F.lit("nope"))),
        ("id_of_platform_user", lambda d: d.withColumn("user_id", F.when(F.col("user_id") == "S03", "known1").otherwise(F.col("user_id")))),
        ("cohort_already_registered", lambda d: d.withColumn("cohort_id", F.lit("taken"))),
    ],
)
def test_import_checks(spark, check, change):
    demo = spark.createDataFrame([(f"S{u:02d}", "Adult", "Male", "yes") for u in range(4)], "user_id string, grade string, gender string, first_language_english string")
    known = spark.createDataFrame([("known1",)], "user_id string")
    run = lambda d: {r["check"] for r in va.validate_import(d, demo, known, ["taken"], ["module1_motivation_survey"]).collect()}
    assert run(good_import(spark)) == set()
    assert check in run(change(good_import(spark)))


def test_ground_truth_headers_and_blank_rows(spark):
    df = spark.createDataFrame([(" a ", "b", ""), ("", " ", ""), ("c", "d", "q")], "` Category ` string, CODE_name string, quote string")
    r = va.validate_ground_truth(df).first()
    assert (r["n_rows"], r["n_empty_quotes"], r["has_participants"], r["valid"]) == (2, 1, False, True)
    with pytest.raises(ValueError):
        va.normalize_ground_truth(df.drop("quote"))


def test_captions(spark):
    raw = "WEBVTT\n\nNOTE hi\n1\n00:00:01.000 --> 00:00:02.000\nAna B: Hello there\n\n2\n00:00:03.000 --> 00:00:04.000\nSecond: \nplain line\n"
    files = spark.createDataFrame([("/d/ana_interview.vtt", raw), ("/d/bo.txt", " as is \n")], "path string, value string")
    got = {r["participant_id"]: r["content"] for r in st.parse_captions(files).collect()}
    assert got == {"ana": "Hello there plain line", "bo": "as is"}


def test_unanimous_group_orders(spark):
    d = spark.createDataFrame([("a", "Adult", "Adult", "Male", True), ("b", "Fourth (4th) grade", "4", None, None), ("c", None, None, "Female", False)], "user_id string, grade string, grade_level string, gender string, first_language_english boolean")
    assert [r["grade_level"] for r in de.count_by_grade(d).collect()] == ["4", "Adult", "Unknown"]
    assert [r["gender"] for r in de.count_by_gender(d).collect()] == ["Male", "Female", "Unknown"]
    assert [r["label"] for r in de.count_by_language(d).collect()] == ["English", "Non-English", "Unknown"]


def test_hot_user_lockout_window_spans_buckets(spark):
    base = TS("2025-01-01T00:59:00")
    rows = [("hot", i, base + dt.timedelta(seconds=40 * i), True) for i in range(6)]
    df = spark.createDataFrame(rows, "user string, id int, ts timestamp, failed boolean")
    out = rg.rolling_failures(df, "user", "ts", "failed").orderBy("ts").collect()
    assert [r["n_failures"] for r in out] == [1, 2, 3, 4, 5, 6] and [r["locked"] for r in out] == [False, False, True, True, True, True]
    assert out[3]["remaining_seconds"] == 300 - 120


def test_keyed_table_repeats_a_batch_without_change(spark, tmp_path):
    schema = "k string, ts bigint, v int"
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "ts", 4)
    first = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], schema)
    second = spark.createDataFrame([("a", 2, 10), ("b", 0, 99), ("c", 1, 3)], schema)
    table.upsert(first, 0)
    table.upsert(second, 1)
    want = {("a", 10), ("b", 2), ("c", 3)}
    assert {(r["k"], r["v"]) for r in table.read().collect()} == want
    table.upsert(second, 1)
    assert {(r["k"], r["v"]) for r in table.read().collect()} == want


def test_reimport_replaces_only_its_cohort(spark, tmp_path):
    path = str(tmp_path / "imports")
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "cohort_id string, v int")
    sk.replace_partitions(df, path, "cohort_id")
    sk.replace_partitions(spark.createDataFrame([("A", 9)], "cohort_id string, v int"), path, "cohort_id")
    assert sorted((r["cohort_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("A", 9), ("B", 3)]


def test_rename_refuses_to_merge(spark):
    u = spark.createDataFrame([("u1", "X"), ("u2", "Y")], "user_id string, cohort_id string")
    out = sk.rename_cohort(u, u.limit(0), u.select("cohort_id"), "X", "Y")
    assert not out["report"].first()["renamed"] and sorted(r["cohort_id"] for r in out["users"].collect()) == ["X", "Y"]
    ok = sk.rename_cohort(u, u.limit(0), u.select("cohort_id"), "X", "Z")
    assert ok["report"].first()["users"] == 1 and sorted(r["cohort_id"] for r in ok["users"].collect()) == ["Y", "Z"]


def test_text_timestamps_filter_and_bad_ones_drop(spark):
    rows = [("u", "m", "i", "q", 1.0, None, None, d) for d in ("2025-01-01", "2025-01-02T10:00:00", "soon", None, "2025-01-03")]
    schema = "user_id string, module_id string, instrument_key string, question_id string, item_score double, construct string, grade string, submitted_at string"
    df = spark.createDataFrame(rows, schema)
    kept = cn.FilterSpec(submitted_after="2025-01-01", submitted_before="2025-01-03").apply(df).collect()
    assert [r["submitted_at"] for r in kept] == ["2025-01-02T10:00:00"]
    assert cn.FilterSpec(module_ids=[], constructs=[]).apply(df).count() == 5


def test_readers(spark, tmp_path):
    import json

    bank = tmp_path / "bank.json"
    bank.write_text(json.dumps([{"id": "1", "question": " What? ", "options": ["A) yes", "no"]}]))
    item = src.item_records(src.read_item_bank(spark, str(bank), "m")).first()
    assert (item["question_id"], item["text"], item["key"]) == ("1", "What?", None)
    assert [(o["label"], o["text"]) for o in item["options"]] == [("A", "yes"), ("B", "no")]
    csv = tmp_path / "in.csv"
    csv.write_text('user_id,item_score,note\n007,1,NA\nS2,,"a, ""b"""\nS3,2,"one\ntwo, ""three"""\n')
    rows = src.read_import_csv(spark, str(csv)).collect()
    assert [tuple(r) for r in rows] == [("007", "1", "NA"), ("S2", "", 'a, "b"'), ("S3", "2", 'one\ntwo, "three"')]
    csv.write_text("user_id,note\nS1,a\nS2,\n")
    assert [tuple(r) for r in src.read_import_csv(spark, str(csv), multi_line=False).collect()] == [("S1", "a"), ("S2", "")]
    log = t.responses(spark, "/root/testdata/sf0.001").withColumn("extra", F.lit(1))
    log.write.parquet(str(tmp_path / "log"))
    assert src.read_responses(spark, str(tmp_path / "log")).columns == list(src.RESPONSE_COLUMNS)


def test_filters_reach_the_scan(spark, tmp_path):
    log = t.responses(spark, "/root/testdata/sf0.001").withColumn("instrument_name", F.concat(F.when(F.col("question_id") == "Q2", " ").otherwise(""), "instrument_name"))
    log.write.parquet(str(tmp_path / "log"))
    raw, book = src.read_responses(spark, str(tmp_path / "log")), t.rulebook(spark)
    specs = [
        (cn.FilterSpec(module_ids=["module_2"], submitted_after="1996-01-01"), ["StringStartsWith(instrument_name,module2_", "GreaterThan(submitted_at"]),
        (cn.FilterSpec(constructs=["effort", "amotivation"]), ["StringStartsWith(instrument_name,module1_engagement_survey", "StringStartsWith(question_id,Q4)"]),
        (cn.FilterSpec(instrument_keys=["module3_content_mcq_assessment"], question_ids=["Q1", "Q2"]), ["StringStartsWith(instrument_name,module3_content", "StringStartsWith(question_id,Q1)"]),
        (cn.FilterSpec(module_ids=["survey"]), []),
        (cn.FilterSpec(module_ids=["module_2"], constructs=["no such"]), []),
        (cn.FilterSpec(grades=["Adult"], module_ids=["module_1"], constructs=["task"]), ["StringStartsWith(instrument_name,module1_engagement_survey)"]),
    ]
    demo = t.demographics(spark, "/root/testdata/sf0.001")
    whole = cn.canonical_dataset(raw, book, demo)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    for spec, wanted in specs:
        df = cn.canonical_dataset(raw, book, demo, spec=spec)
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = " ".join(x for x in plan.splitlines() if "PushedFilters" in x and "instrument_name" in x)
        assert all(w in scans for w in wanted), (wanted, scans)
        key = lambda r: repr(tuple(r))
        assert sorted(df.collect(), key=key) == sorted(spec.apply(whole).collect(), key=key)
    many = cn.FilterSpec(instrument_keys=[f"module{i}_content_mcq_assessment" for i in range(1, 60)])
    assert cn.canonical_dataset(raw, book, spec=many).count() == many.apply(cn.canonical_dataset(raw, book)).count() > 0


def test_strict_metadata(spark):
    raw = spark.createDataFrame([("u", "module1_engagement_survey", "Q1", "Agree"), ("u", "module1_engagement_survey", "Q99", "x"), ("u", "new_test", "Q1", "x")], "user_id string, instrument_name string, question_id string, response_value string")
    book = t.rulebook(spark)
    with pytest.raises(ContractError, match="module1_engagement_survey/Q99 .question, 1 rows., new_test/Q1 .instrument"):
        cn.canonical_dataset(raw, book, strict=True)
    assert cn.canonical_dataset(raw.limit(1), book, strict=True).count() == 1
