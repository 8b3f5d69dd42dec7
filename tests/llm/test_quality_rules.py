import random

from brute import bad_hosts, rule_stats
from pyspark.sql import functions as F

from scorewell.llm import quality_rules as qr

TEXTS = [None, "", " \t\n", "a b c a b c", "a b c d\n\na b c d\n \n a b c d", "x " * 60, "é😀 # $% <|>\x0bßa\x1cb \x85 c", "of the of the of the " * 20, "ab cd e\na bc de\n" * 3]


def make(seed, n, hosts=("h1", "h2", None)):
    rng = random.Random(seed)
    rows = [(i, t, None, hosts[i % len(hosts)]) for i, t in enumerate(TEXTS)]
    for i in range(len(rows), n):
        host = rng.choice(hosts)
        vocab = 3 if host == "h2" and rng.random() < 0.9 else 500
        rows.append((i, " ".join(f"w{rng.randint(0, vocab)}" for _ in range(rng.choice([10, 60, 200]))), None, host))
    return rows


def test_counts_and_verdicts_equal_the_plain_version(docs):
    rows = [*make(1, 150), (5, TEXTS[5], None, "h1"), (None, "no id " * 40, None, "h2")]
    df = docs(rows).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(-1))
    want_stats = [(r[0], r[3], *rule_stats(r[1])) for r in rows]
    bad = bad_hosts([(r[3], rule_stats(r[1])[-1]) for r in rows])
    assert bad and len(bad) < 3
    want = sorted(((d, *s, not s[-1] and h not in bad) for d, h, *s in want_stats), key=repr)
    got = sorted((tuple(r) for r in qr.judge(df).collect()), key=repr)
    assert got == want


def test_kept_rows_keep_all_columns(docs):
    rows = make(2, 120)
    df = docs(rows).withColumn("host", F.lit(1)).withColumn("base_failed", F.col("doc_id") * 2)
    bad = bad_hosts([(r[3], rule_stats(r[1])[-1]) for r in rows])
    out = qr.keep_good(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows if not rule_stats(r[1])[-1] and r[3] not in bad}
    assert all(r.base_failed == 2 * r.doc_id and r.text == rows[r.doc_id][1] for r in got.values())


def test_empty_table_and_one_host(docs):
    assert qr.judge(docs([])).collect() == [] and qr.keep_good(docs([])).collect() == []
    assert [r.kept for r in qr.judge(docs([(1, " ".join(map(str, range(60))), None, "a")])).collect()] == [True]


def test_many_hosts_without_broadcast(docs, monkeypatch):
    rows = make(3, 80)
    want = sorted((tuple(r) for r in qr.judge(docs(rows)).collect()), key=repr)
    monkeypatch.setattr(qr, "BROADCAST_HOSTS", 0)
    assert sorted((tuple(r) for r in qr.judge(docs(rows)).collect()), key=repr) == want


def test_plan_has_no_python(spark):
    from scorewell.llm import queries

    plan = queries.op9_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
