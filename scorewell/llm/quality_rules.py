"""Quality rules per text and per host: row-local counts, then a host verdict from shrunk failure rates.

Everything runs as DataFrame expressions. A text's counts come from arrays of its own words, so no word is shuffled;
hosts are a map-side combined aggregation; the host table is broadcast only after its rows were counted.

Defined results: NULL or empty text has no words and fails (fewer than 50 words); a NULL host is a host of its own;
repeated rows are judged one by one and count one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ASCII_SPACE, SPACE_CLASS, barrier, fresh, materialize, whole_text

SYMBOLS = r"[#*$%&|<>]"
NO_SPACE = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
BROADCAST_HOSTS = 100_000

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rule_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Append ``STATS`` and ``base_failed``, computed from the whole text of each row.

    A word is repeated when a window of three words that holds it occurs twice or more in its text. Windows are
    compared by 64-bit hashes within one text only; positions of repeated windows are merged as intervals.
    """
    keep = [c for c in df.columns if c not in {*STATS, "base_failed"}]
    t, n, w, ln, g, h, s = (fresh(df, f"_qr_{x}") for x in ("text", "n", "words", "lines", "word_hashes", "hashes", "sorted"))
    body = whole_text(text)
    out = barrier(df.select(*keep, body.alias(t)), **{w: F.split(F.btrim(F.col(t), F.lit(ASCII_SPACE)), SPACE_CLASS, -1)})
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NO_SPACE))
    out = barrier(
        out.select(
            *keep, F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            (F.size(F.split(t, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"), w, t,
        ),
        **{ln: lines, g: F.transform(F.filter(w, lambda x: x != ""), lambda x: F.xxhash64(x))},
    ).select(*keep, F.size(g).alias(n), "word_chars", "n_symbols", (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"), g)
    window = F.transform(F.slice(g, 1, F.col(n) - 2), lambda x, i: F.xxhash64(x, F.get(g, i + 1), F.get(g, i + 2)))
    out = barrier(
        out,
        **{h: F.when(F.col(n) >= 3, window).otherwise(F.array().cast("array<bigint>"))},
    )
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    empty = F.array().cast("array<struct<h:bigint,p:int>>")
    out = barrier(
        out.select(*keep, n, "word_chars", "n_symbols", "n_dup_lines", h),
        **{s: F.when(repeated, F.sort_array(pairs)).otherwise(empty)},
    )
    hit = F.filter(
        F.transform(
            s,
            lambda a, i: F.when(
                F.coalesce(a["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(a["h"] == F.get(s, i + 1)["h"], F.lit(False)), a["p"]
            ),
        ),
        lambda p: p.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(hit),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
        lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total")),
        lambda acc: acc["total"],
    )
    out = out.select(
        *keep, F.col(n).cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: ``n``, ``n_failed``, ``host_rate`` shrunk towards all hosts, ``host_failed``.

    The beta prior is fitted by moments: the pooled rate, and the spread of host rates beyond binomial noise. Without
    such spread the prior is strong, so every host gets nearly the pooled rate.
    """
    hosts = materialize(judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("n_failed").alias("k"), F.count("*").alias("hosts")).first()
    if not total["n"]:
        return hosts.withColumns({"host_rate": F.lit(None).cast("double"), "host_failed": F.lit(False)})
    mean = total["k"] / total["n"]
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("n_failed") / F.col("n") - F.lit(mean), 2))).first()[0] / total["n"]
    noise = mean * (1 - mean) * total["hosts"] / total["n"]
    weight = min(max(mean * (1 - mean) / max(spread - noise, 1e-9) - 1, 1.0), 1e6)
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", F.col("host_rate") > max_rate)


def with_host_verdict(df: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Join ``host_failed`` back to the rows. The host table is broadcast below a counted size, else AQE splits hot hosts."""
    name, flag = fresh(df, "_host"), fresh(df, "host_failed")
    side = verdicts.select(F.col("host").alias(name), F.col("host_failed").alias(flag))
    if verdicts.count() <= BROADCAST_HOSTS:
        side = F.broadcast(side)
    return df.join(side, df[host].eqNullSafe(side[name]), "left").drop(name).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def judge(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row of ``docs``."""
    judged = materialize(rule_stats(docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text"))).drop("text"), "rules")
    out = with_host_verdict(judged, host_verdicts(judged, "host"), "host")
    return out.select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows that pass, with all columns of ``docs``. Texts are read twice rather than stored again."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    judged = rule_stats(packed.select("host", "text")).select("host", "base_failed")
    out = with_host_verdict(rule_stats(packed).select("row", "host", "base_failed"), host_verdicts(judged, "host"), "host")
    return out.filter(~F.col("base_failed") & ~F.col("host_failed")).select("row.*")
