"""run() against plain Python versions of the stages, one after the other."""

import random

import corpus_pipeline
from brute import bad_hosts, components, covered_bytes, rule_stats, text_without
from test_packing import layout_is_sound, want
from test_secret_scan import KINDS


def sentences(rng, n):
    return " ".join("".join(rng.choices("abcdefgiklmno", k=rng.randint(2, 9))) for _ in range(n))


def test_run_equals_the_plain_stages(spark, tmp_path):
    rng = random.Random(8)
    passage = sentences(rng, 30)
    rows = []
    for i in range(60):
        host = f"h{i % 3}"
        text = sentences(rng, rng.randint(40, 120))
        if i % 5 == 0:
            text = sentences(rng, 60) + " " + passage + " " + sentences(rng, 20)
        if i % 7 == 0:
            text += " password: hunter2222 " + sentences(rng, 5)
        if i % 11 == 0 and i:
            words = rows[i - 1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 13 == 0:
            text = "bad " * 80
        rows.append((i, text, "en", host))
    rows += [(200 + i, "junk " * 60, "en", "worst") for i in range(12)] + [(300, sentences(rng, 90), "en", "worst"), (301, None, None, None), (302, rows[4][1], "en", "h1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    bad = bad_hosts([(r[3], rule_stats(r[1])[-1]) for r in rows])
    assert bad == {"worst"} or "worst" in bad
    left = [(d, t) for d, t, _, h in rows if not rule_stats(t)[-1] and h not in bad]
    comp, _ = components(left, 80, 5)
    left = [(d, t) for d, t in left if comp[d] == d]
    left = [(d, text_without(data, cover)) for d, data, cover in covered_bytes(left)]
    masked = []
    for d, t in left:
        spans = sorted((m.start(), m.end()) for _, p, g, least in KINDS for m in p.finditer(t) if len(m.group(g)) >= least)
        for a, b in reversed(spans):
            t = t[:a] + "[secret]" + t[b:]
        masked.append((d, t))
    assert any("[secret]" in t for _, t in masked)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((d, *p) for d, t in masked for p in want(t))
    layout_is_sound(got)


def test_stages_have_the_right_order_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "secret_scan", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
