"""Secret scans: certain secrets by pattern, weak candidates only when the complementary parts stand nearby.

Positions come from built-in functions alone: the pieces between matches and the matches themselves alternate, so their
lengths give every start and end in code points. Parts of a credential (identifier, secret, endpoint) are rows of their
text; an interval join on position buckets tells a weak part whether the other parts lie within ``SCOPE`` code points.
A bucket is pre-aggregated to its first and last start per part, so a candidate meets at most three summary rows per
part, and no pairs are made.

Defined results: NULL text is empty and has no spans; repeated rows get the same spans; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import barrier, fresh, materialize, whole_text

# The base kinds, their patterns, the group whose length is tested, and that length.
BASE_KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK_KINDS = {
    "login": (r"""(?i)(username|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)""", 2, 3),
    "opaque": (r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
    "endpoint": (r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+""", 0, 8),
}
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "opaque": "secret", "endpoint": "endpoint"}
# Strings of which a text must hold one before a slow pattern is tried at all.
HINTS = {"assign": (":", "="), "login": (":", "="), "access": ("AKIA",), "endpoint": ("://",)}
# Which other parts must be near before a weak kind is reported.
NEEDS = {"login": ("secret", "endpoint"), "opaque": ("identifier",), "endpoint": ("identifier", "secret")}
ORDER = {k: i for i, k in enumerate([*BASE_KINDS, *WEAK_KINDS])}
SCOPE = 400
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _spans(df: DataFrame, text: str, kinds: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Per kind one column ``_<kind>``: array of (start, kind, stop), leftmost non-overlapping, failing matches dropped."""
    for kind, (pattern, group, least) in kinds.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        cell = fresh(df, f"_m_{kind}")
        hinted = F.lit(False)
        for hint in HINTS.get(kind, ()):
            hinted = hinted | F.contains(F.col(text), F.lit(hint))
        hit = F.when(hinted, F.col(text).rlike(pattern)) if kind in HINTS else F.col(text).rlike(pattern)
        df = barrier(df, **{cell: F.when(hit, F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("all"), tested.alias("tested")))})
        c = F.col(cell)
        steps = F.zip_with(
            F.slice(c["gaps"], 1, F.size(c["all"])), F.arrays_zip(c["all"], c["tested"]),
            lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["all"]).alias("size"), (F.length(m["tested"]) >= least).alias("good")),
        )
        walked = F.aggregate(
            steps, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
            lambda acc, e: F.struct(
                (acc["at"] + e["gap"] + e["size"]).alias("at"),
                F.when(
                    e["good"],
                    F.concat(
                        acc["out"],
                        F.array(F.struct((acc["at"] + e["gap"]).alias("start"), F.lit(ORDER[kind]).alias("kind"), (acc["at"] + e["gap"] + e["size"]).alias("stop"))),
                    ),
                ).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        df = df.withColumn(f"_{kind}", F.when(c.isNotNull(), walked).otherwise(F.array().cast(SPAN))).drop(cell)
    return df


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def find_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``base`` (certain spans, sorted) and ``weak`` (candidates outside base spans).

    An opaque run counts only when it mixes lower case, upper case and digits.
    """
    t = fresh(docs, "_text")
    df = docs.withColumn(t, whole_text(text)).drop(text)
    df = _spans(df, t, BASE_KINDS)
    df = _spans(df, t, WEAK_KINDS)
    base = F.sort_array(F.concat(*[F.col(f"_{k}") for k in BASE_KINDS]))
    out = barrier(df, base=base)
    mixed = F.filter("_opaque", lambda s: _mixed(F.substring(F.col(t), s["start"] + 1, s["stop"] - s["start"])))
    weak = F.concat("_login", "_endpoint", mixed)
    free = F.filter(weak, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return out.withColumn("weak", F.when(F.size(weak) > 0, F.sort_array(free)).otherwise(F.array().cast(SPAN))).drop(
        t, *[f"_{k}" for k in ORDER]
    )


def _mixed(c: Column) -> Column:
    return c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike("[0-9]")


def link_parts(found: DataFrame, key: str) -> DataFrame:
    """(key, ``linked`` array of weak spans whose complementary parts lie within ``SCOPE``), by interval join."""
    parts = found.filter(F.size("weak") > 0).select(key, F.explode(F.concat("base", "weak")).alias("s"))
    names = F.array(*[F.lit(PART[k]) for k in ORDER])
    parts = parts.select(key, F.col("s"), F.get(names, F.col("s.kind")).alias("part"), F.floor(F.col("s.start") / SCOPE).alias("cell")).distinct()
    summary = parts.groupBy(key, "part", "cell").agg(F.min("s.start").alias("low"), F.max("s.start").alias("high"))
    wanted = parts.filter(F.col("s.kind") >= len(BASE_KINDS)).select(
        key, "s", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("cell"), F.col("part").alias("own")
    )
    near = (
        wanted.join(summary, [key, "cell"])
        .filter((F.col("part") != F.col("own")) & (F.col("low") <= F.col("s.start") + SCOPE) & (F.col("high") >= F.col("s.start") - SCOPE))
        .groupBy(key, "s").agg(F.collect_set("part").alias("parts"))
    )
    enough = F.lit(False)
    for kind, needs in NEEDS.items():
        ok = F.lit(True)
        for part in needs:
            ok = ok & F.array_contains("parts", part)
        enough = enough | ((F.col("s.kind") == ORDER[kind]) & ok)
    return near.filter(enough).groupBy(key).agg(F.collect_list("s").alias("linked"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``docs`` except its text, ``base`` and ``spans`` (base and linked weak spans, sorted)."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(whole_text(text).cast("binary"), 256)))
    found = materialize(find_parts(keyed, text), "secret-parts")
    linked = link_parts(found, key)
    out = found.join(linked, key, "left")
    return out.withColumn("spans", F.when(F.col("linked").isNotNull(), F.sort_array(F.concat("base", "linked"))).otherwise(F.col("base"))).drop(key, "weak", "linked")


def report(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == ORDER[k])).cast("long")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; all other columns as they were, ``n_chars`` kept true if there.

    Spans that overlap are masked as one. The texts are joined to the spans by their own digest; only rows with spans
    travel in the join's other side.
    """
    key, cell = fresh(docs, "_key"), fresh(docs, "_spans")
    digest = F.sha2(whole_text(text).cast("binary"), 256)
    marked = scan(docs.select("doc_id", text).withColumn(key, digest).dropDuplicates(["doc_id", key]), text).filter(F.size("spans") > 0)
    marked = materialize(marked.select(F.col("doc_id").alias("_id"), F.col(key).alias("_dg"), F.col("spans").alias(cell)), "secret-spans")
    out = docs.join(marked, docs["doc_id"].eqNullSafe(marked["_id"]) & (digest == marked["_dg"]), "left").drop("_id", "_dg")
    walked = F.aggregate(
        cell, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))),
    )
    out = out.withColumn(text, F.when(F.col(cell).isNotNull(), walked).otherwise(F.col(text))).drop(cell)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
