"""Codes and themes as vectors: similar pairs, deduplication, clusters, matching, run comparison.

Input contract: ``code_id`` (order key, unique, bigint), ``embedding`` array, optional ``words`` array.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import materialize, spread, strip
from ..functions.numbers import agreement_label
from ..functions.vectors import dot, unit
from .pairs import RECALL, indexed_pairs, ordered_leaders

BLOCK = 1024  # vectors per block of a block product
MATCH_FLOOR = 0.3  # fixed value
COSINE_WEIGHT, JACCARD_WEIGHT = 0.7, 0.3  # fixed values


def _like_none(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x == 0), F.lit(True))


def distinct_vectors(codes: DataFrame, key: str = "code_id", vector: str = "embedding") -> DataFrame:
    """One row per distinct vector: the first code that has it, and how many codes share it.

    Copies collapse before any comparison, so a vector held by a third of the table is compared once.
    """
    v = F.col(vector).cast("array<double>")
    # a zero vector (or none at all) is similar to nothing, not even to its copies
    alone = F.when(_like_none(v), F.col(key))
    return codes.groupBy(v.alias("v"), alone.alias("_z")).agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n_copies"))


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def _unit_vectors(codes: DataFrame, key: str, vector: str) -> DataFrame:
    return materialize(distinct_vectors(codes, key, vector).filter("_z IS NULL").select("rep", "n_copies", unit(F.col("v")).alias("u")), "vectors")


def similar_pairs(codes: DataFrame, threshold: float, key: str = "code_id", vector: str = "embedding", exact: bool = False, recall: float = RECALL) -> DataFrame:
    """Pairs of distinct vectors with cosine >= threshold: ``a < b``, similarity (four decimals), copies.

    Candidates come from banded sign signatures and are verified on the vectors, so no wrong pair is returned; a pair at
    the threshold is found with probability ``recall``, pairs above it more surely. ``exact`` compares all pairs that an
    angle bound cannot part (``pivot_pairs``), for any threshold and at the cost of that.
    """
    vectors = _unit_vectors(codes, key, vector)
    pairs = pivot_pairs(vectors, threshold) if exact else indexed_pairs(vectors, threshold, recall)
    return pairs.withColumn("similarity", F.round("similarity", 4))


def pivot_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """All pairs of unit vectors (``rep, n_copies, u``) at or above the threshold.

    Pivots cut the sphere into cells, and a cell into blocks of about ``BLOCK`` vectors, a row each. Two blocks need not meet
    if the angle of their pivots exceeds the threshold angle by more than the widest angles in them (triangle inequality).
    All others are paired by a Cartesian product of the stored blocks, whose tasks read them from shared storage: vectors are
    shuffled into blocks once, nothing is copied per pair. A pair of blocks is one matrix product, and only pairs over the
    threshold leave a task.
    """
    n = reps.count()
    k = int(max(1, min(512, round((n / BLOCK) ** 0.5))))
    # k pivots, k <= 512: the smallest hashes, the same in every run
    pivots = [np.asarray(r["u"], dtype=np.float64) for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(k).select("u").collect()]
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6
    grid = np.vstack(pivots) if pivots else np.zeros((1, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            angles = np.arccos(np.clip(_stack(pdf["u"]) @ grid.T, -1.0, 1.0))
            yield pd.DataFrame({"rep": pdf["rep"], "n_copies": pdf["n_copies"], "u": pdf["u"], "home": angles.argmin(1).astype("int32"), "angle": angles.min(1)})

    placed = reps.mapInPandas(assign, "rep bigint, n_copies bigint, u array<double>, home int, angle double")
    placed = materialize(placed, "placed")
    # blocks per cell follow the cell's size, so a hot cell has more blocks, not larger ones
    per_cell = {r["home"]: max(1, -(-r["count"] // BLOCK)) for r in placed.groupBy("home").count().collect()}  # <= 512 rows
    counts = F.create_map(*[F.lit(x) for pair in (per_cell or {0: 1}).items() for x in pair])
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("rep"), F.element_at(counts, F.col("home"))).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        reps, copies = (np.ascontiguousarray(table[c].to_numpy(), dtype=np.int64) for c in ("rep", "n_copies"))
        home = table["home"][0].as_py()
        cells = {
            "home": [home], "blk": [table["blk"][0].as_py()], "pivot": [grid[home].tolist()], "radius": [float(table["angle"].to_numpy().max())],
            "reps": [reps.tobytes()], "copies": [copies.tobytes()], "u": [_stack(table["u"].to_pandas()).tobytes()],
        }
        return pa.table(cells, schema=pa.schema([
            ("home", pa.int32()), ("blk", pa.int32()), ("pivot", pa.list_(pa.float64())), ("radius", pa.float64()),
            ("reps", pa.binary()), ("copies", pa.binary()), ("u", pa.binary()),
        ]))

    packed = placed.groupBy("home", "blk").applyInArrow(pack, "home int, blk int, pivot array<double>, radius double, reps binary, copies binary, u binary")
    blocks = materialize(spread(packed, "home", "blk"), "blocks")
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns])
    once = (F.col("home_g") < F.col("home_h")) | ((F.col("home_g") == F.col("home_h")) & (F.col("blk_g") <= F.col("blk_h")))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("pivot_h"), F.col("pivot_g")))))
    near = (F.col("home_g") == F.col("home_h")) | (apart <= F.col("radius_h") + F.col("radius_g") + F.lit(reach))
    meet = side("h").join(side("g"), once & near)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch[c][at] for c in batch.schema.names}
                hid, gid, hc, gc = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("reps_h", "reps_g", "copies_h", "copies_g"))
                h, g = (np.frombuffer(row[f"u_{s}"].as_buffer(), np.float64).reshape(m, -1) for s, m in (("h", len(hid)), ("g", len(gid))))
                sims = h @ g.T
                hit = sims >= threshold
                if row["home_h"] == row["home_g"] and row["blk_h"] == row["blk_g"]:
                    hit &= hid[:, None] < gid[None, :]
                i, j = np.nonzero(hit)
                first = hid[i] < gid[j]
                yield pa.RecordBatch.from_pydict({
                    "a": np.where(first, hid[i], gid[j]), "b": np.where(first, gid[j], hid[i]), "similarity": sims[i, j],
                    "n_a": np.where(first, hc[i], gc[j]), "n_b": np.where(first, gc[j], hc[i]),
                })

    needed = [f"{c}_{s}" for s in ("h", "g") for c in ("home", "blk", "reps", "copies", "u")]
    return meet.select(*needed).mapInArrow(multiply, "a bigint, b bigint, similarity double, n_a bigint, n_b bigint")


def dedup_links(
    codes: DataFrame, threshold: float = 0.85, key: str = "code_id", vector: str = "embedding", exact: bool = False, recall: float = RECALL
) -> DataFrame:
    """Every code with the code that stands for it: the earliest earlier leader it is similar to, or itself.

    Same leaders as a scan in code order. Similar pairs are an edge list, leaders come from rounds of joins on it
    (``ordered_leaders``); copies of a vector follow its first code. No vector reaches the driver.
    """
    full = codes.select(F.col(key).alias("code_id"), F.col(vector).cast("array<double>").alias("v"))
    reps = materialize(distinct_vectors(codes, key, vector), "distinct")
    units = materialize(reps.filter("_z IS NULL").select("rep", "n_copies", unit(F.col("v")).alias("u")), "vectors")
    pairs = pivot_pairs(units, threshold) if exact else indexed_pairs(units, threshold, recall)
    led = ordered_leaders(pairs).withColumnRenamed("code", "rep")
    # copies follow the representative of their vector; a zero vector stands for itself
    own = F.when(_like_none(F.col("v")), F.col("code_id"))
    keyed = full.withColumn("k", F.xxhash64("v", own)).withColumn("_z", own)
    heads = reps.join(led, "rep", "left").select(F.xxhash64("v", "_z").alias("k"), F.col("v").alias("w"), F.col("_z").alias("y"), F.coalesce("leader", "rep").alias("leader_id"))
    return keyed.join(heads, "k").filter(F.col("v").eqNullSafe(F.col("w")) & F.col("_z").eqNullSafe(F.col("y"))).select("code_id", "leader_id")


def deduplicate_codes(codes: DataFrame, threshold: float = 0.85, key: str = "code_id", vector: str = "embedding", **search) -> DataFrame:
    """Kept codes with the number of later codes each absorbed; ``search`` as in ``dedup_links``."""
    links = dedup_links(codes, threshold, key, vector, **search)
    return links.groupBy(F.col("leader_id").alias(key)).agg((F.count(F.lit(1)) - 1).alias("merged_count"))


def removed_codes(codes: DataFrame, kept: DataFrame, index: str = "chunk_index", name: str = "name") -> DataFrame:
    """Codes whose (chunk, lower-case name) no kept code has."""
    tag = [F.col(index).alias("_c"), F.lower(strip(name)).alias("_n")]
    keys = kept.select(*tag).distinct()
    return codes.withColumn("_c", F.col(index)).withColumn("_n", F.lower(strip(name))).join(keys, ["_c", "_n"], "left_anti").drop("_c", "_n")


def cluster_members(codes: DataFrame, threshold: float = 0.75, key: str = "code_id", vector: str = "embedding", **search) -> DataFrame:
    """A row per code: its cluster's representative, its similarity to it, and the code's other columns."""
    links = dedup_links(codes, threshold, key, vector, **search).withColumnRenamed("leader_id", "representative")
    head = codes.select(F.col(key).alias("representative"), unit(F.col(vector)).alias("_h"))
    rows = codes.withColumnRenamed(key, "code_id").join(links, "code_id").join(head, "representative")
    near = F.when(F.col("code_id") == F.col("representative"), 1.0).otherwise(dot(unit(F.col(vector)), F.col("_h")))
    return rows.withColumn("similarity", F.round(near, 4)).drop("_h", vector)


def cluster_codes(codes: DataFrame, threshold: float = 0.75, key: str = "code_id", vector: str = "embedding", **search) -> DataFrame:
    """Leader clusters: representative, size, mean pairwise similarity, by descending size; ``cluster_members`` has their rows.

    The mean over pairs of unit vectors is (|sum|^2 - sum of squared norms) / (m (m - 1)): element
    sums per cluster, no pairs.
    """
    links = dedup_links(codes, threshold, key, vector, **search)
    members = links.join(codes.select(F.col(key).alias("code_id"), unit(F.col(vector)).alias("u")), "code_id")
    parts = members.select("leader_id", F.posexplode("u").alias("d", "x")).groupBy("leader_id", "d").agg(
        F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("q"), F.count(F.lit(1)).alias("m")
    )
    sums = parts.groupBy("leader_id").agg(F.sum(F.col("s") ** 2).alias("ss"), F.sum("q").alias("qq"), F.max("m").alias("cluster_size"))
    m = F.col("cluster_size")
    mean = F.when(m > 1, (F.col("ss") - F.col("qq")) / (m * (m - 1))).otherwise(F.lit(1.0))
    out = sums.select(F.col("leader_id").alias("representative"), "cluster_size", F.round(mean, 4).alias("avg_similarity"))
    return out.orderBy(F.desc("cluster_size"), "representative")


# -- themes ------------------------------------------------------------------------------------


def _block_count(themes: DataFrame, size: int = BLOCK) -> int:
    return max(1, -(-themes.count() // size))


def _pack_blocks(themes: DataFrame, by: Sequence[str], prefix: str, size: int = BLOCK) -> DataFrame:
    """Themes of a group in blocks of about ``size``, each one array column."""
    blocks = _block_count(themes, size)
    entry = F.struct("pos", "name", F.col("embedding").cast("array<double>").alias("e"), "words")
    return themes.withColumn(f"{prefix}_blk", F.pmod(F.xxhash64("name", "pos"), F.lit(blocks)).cast("int")).groupBy(
        *by, f"{prefix}_blk"
    ).agg(F.collect_list(entry).alias(prefix))


def _scores(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and Jaccard matrices of two theme lists."""
    ea, eb = (np.vstack([np.asarray(x["e"], dtype=np.float64) for x in side]) for side in (a, b))
    na, nb = np.linalg.norm(ea, axis=1), np.linalg.norm(eb, axis=1)
    scale = na[:, None] * nb[None, :]
    ok = (na[:, None] >= 1e-10) & (nb[None, :] >= 1e-10)
    cos = np.divide(ea @ eb.T, scale, out=np.zeros_like(scale), where=ok)
    wa, wb = [set(x["words"]) for x in a], [set(x["words"]) for x in b]
    vocab = {w: i for i, w in enumerate(sorted(set().union(*wa, *wb)))}
    ma, mb = np.zeros((len(a), max(1, len(vocab)))), np.zeros((len(b), max(1, len(vocab))))
    for m, sets in ((ma, wa), (mb, wb)):
        for i, ws in enumerate(sets):
            m[i, [vocab[w] for w in ws]] = 1
    inter = ma @ mb.T
    union = ma.sum(1)[:, None] + mb.sum(1)[None, :] - inter
    return cos, np.divide(inter, union, out=np.zeros_like(union), where=union > 0)


def best_match(queries: DataFrame, candidates: DataFrame, w_cos: float = COSINE_WEIGHT, w_jac: float = JACCARD_WEIGHT) -> DataFrame:
    """Each query theme's best candidate by weighted cosine and Jaccard; the first one on a tie.

    Frames have ``pos, name, embedding, words``. Blocks meet blocks, each meeting returns one best
    candidate per query, and a map-side combined maximum picks the winner.
    """
    a = _pack_blocks(queries, [], "a")
    b = _pack_blocks(candidates, [], "b").withColumnRenamed("b_blk", "_slot")
    slots = F.sequence(F.lit(0), F.lit(_block_count(candidates) - 1))
    meet = a.withColumn("_slot", F.explode(slots)).join(b, "_slot")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                cand = sorted(row.b, key=lambda x: x["pos"])
                cos, jac = _scores(row.a, cand)
                agreement = w_cos * cos + w_jac * jac
                top = agreement.argmax(1)
                rows = np.arange(len(row.a))
                yield pd.DataFrame({
                    "pos": [x["pos"] for x in row.a], "theme": [x["name"] for x in row.a],
                    "match_pos": [cand[j]["pos"] for j in top], "best_match": [cand[j]["name"] for j in top], "agreement": agreement[rows, top],
                })

    scored = meet.select("a", "b").mapInPandas(score, "pos bigint, theme string, match_pos bigint, best_match string, agreement double")
    winner = F.max(F.struct(F.round("agreement", 9).alias("s"), (-F.col("match_pos")).alias("k"), "best_match", "agreement")).alias("w")
    out = scored.groupBy("pos", "theme").agg(winner)
    return out.select("pos", "theme", "w.best_match", F.round("w.agreement", 4).alias("agreement")).withColumn(
        "interpretation", agreement_label(F.col("agreement"))
    )


def align_themes(a: DataFrame, b: DataFrame) -> DataFrame:
    return best_match(a, b)


def _assignment(score: np.ndarray) -> np.ndarray:
    """Column per row of a maximum-total one-to-one assignment (-1 for rows left over).

    Shortest augmenting paths with potentials, on the smaller side as rows.
    """
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, back = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        current, reached, base = row, -1, 0.0
        while True:
            reduced = base + cost[current] - u[current] - v
            better = ~done & (reduced < dist)
            dist[better], back[better] = reduced[better], reached
            reached = int(np.where(done, np.inf, dist).argmin())
            base = dist[reached]
            done[reached] = True
            if owner[reached] < 0:
                break
            current = owner[reached]
        gain = base - dist[done]
        v[done] -= gain
        rows = owner[done]
        held = rows >= 0
        u[rows[held]] += gain[held]
        u[row] += base
        while reached >= 0:
            prev = back[reached]
            owner[reached] = row if prev < 0 else owner[prev]
            reached = prev
    out = np.full(score.shape[0], -1)
    for col, r in enumerate(owner):
        if r >= 0:
            if flip:
                out[col] = r
            else:
                out[r] = col
    return out


MAX_THEMES_PER_RUN = 5000
RUN_BLOCK = 32  # runs that meet another run at a time


def compare_runs(themes: DataFrame, ordered: bool = True, w_cos: float = COSINE_WEIGHT, w_jac: float = JACCARD_WEIGHT) -> DataFrame:
    """Optimal one-to-one theme matching for every ordered pair of runs, one row per theme of run a.

    ``themes`` has ``run, pos, name, embedding, words``. A run's themes are a model's answer (about a
    dozen), so a run is one array and a run pair one small matrix; that bound is checked here. Any number of runs is compared.
    """
    sizes = themes.groupBy("run").count().agg(F.max("count").alias("m")).first()["m"] or 0
    if sizes > MAX_THEMES_PER_RUN:
        raise ValueError(f"a run has {sizes} themes; matching is defined for theme lists up to {MAX_THEMES_PER_RUN}")
    entry = F.struct("pos", "name", F.col("embedding").cast("array<double>").alias("e"), "words")
    runs = materialize(themes.groupBy("run").agg(F.sort_array(F.collect_list(entry)).alias("t")), "runs")
    blocks = max(1, -(-runs.count() // RUN_BLOCK))
    a = runs.select(F.col("run").alias("run_a"), F.col("t").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    b = runs.select(F.col("run").alias("run_b"), F.col("t").alias("b"), F.pmod(F.xxhash64("run"), F.lit(blocks)).cast("int").alias("_block"))
    pairs = a.join(b, "_block").filter(F.col("run_a") != F.col("run_b") if ordered else F.col("run_a") < F.col("run_b")).drop("_block")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                cos, jac = _scores(row.a, row.b)
                agreement = w_cos * cos + w_jac * jac
                cols = _assignment(agreement)
                rows = []
                for i, j in enumerate(cols):
                    if j < 0:
                        rows.append((row.run_a, row.run_b, row.a[i]["name"], None, None, None, 0.0))
                    else:
                        rows.append((row.run_a, row.run_b, row.a[i]["name"], row.b[j]["name"], cos[i, j], jac[i, j], agreement[i, j]))
                yield pd.DataFrame(rows, columns=["run_a", "run_b", "theme", "best_match", "cosine", "jaccard", "agreement"])

    schema = "run_a string, run_b string, theme string, best_match string, cosine double, jaccard double, agreement double"
    out = pairs.repartition("run_a", "run_b").mapInPandas(match, schema)
    out = out.select("run_a", "run_b", "theme", "best_match", *[F.round(c, 4).alias(c) for c in ("cosine", "jaccard", "agreement")])
    return out.withColumn("matched", F.col("agreement") >= MATCH_FLOOR)


def run_agreement(matches: DataFrame) -> DataFrame:
    """Overall agreement per ordered run pair, unmatched themes counting 0."""
    s = matches.groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("n_themes_a"), F.avg("agreement").alias("_m"))
    return s.select("run_a", "run_b", "n_themes_a", F.round("_m", 4).alias("overall_agreement"), agreement_label(F.col("_m")).alias("interpretation"))


def compare_all_runs(matches: DataFrame) -> DataFrame:
    """Symmetric summary: both directions averaged per unordered pair."""
    o = run_agreement(matches)
    pair = [F.least("run_a", "run_b").alias("run_a"), F.greatest("run_a", "run_b").alias("run_b")]
    return o.groupBy(*pair).agg(F.round(F.avg("overall_agreement"), 4).alias("agreement"))


def factorial_agreement(summary: DataFrame, runs: DataFrame) -> DataFrame:
    """Run pairs by same/different model and temperature: pairs, mean, t-based 95 % interval."""
    from ..functions.dist import p_value

    a = runs.select(F.col("run").alias("run_a"), F.col("model").alias("ma"), F.col("temperature").alias("ta"))
    b = runs.select(F.col("run").alias("run_b"), F.col("model").alias("mb"), F.col("temperature").alias("tb"))
    g = F.concat(
        F.when(F.col("ma").eqNullSafe(F.col("mb")), "same_model").otherwise("diff_model"), F.lit("_"),
        F.when(F.col("ta").eqNullSafe(F.col("tb")), "same_temp").otherwise("diff_temp"),
    )
    s = summary.join(a, "run_a").join(b, "run_b").groupBy(g.alias("pair_group")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("agreement").alias("m"), F.stddev_samp("agreement").alias("sd")
    )
    n = F.col("n_pairs")
    half = p_value("t_ppf", F.when(n >= 2, F.lit(0.975)), n - 1) * F.col("sd") / F.sqrt(n)
    return s.withColumn("_h", half).select(
        "pair_group", "n_pairs", F.round("m", 4).alias("mean_agreement"), F.round(F.col("m") - F.col("_h"), 4).alias("ci_low"), F.round(F.col("m") + F.col("_h"), 4).alias("ci_high")
    )


def theme_codes(themes: DataFrame, codes: DataFrame, code_key: str = "chunk_index") -> DataFrame:
    """Codes of each theme by its index list; a theme without a list has every code of its run.

    Codes are matched on their chunk index, which several codes of a chunk share; pass another
    ``code_key`` to match on a unique id.
    """
    listed = themes.filter(F.col("code_indices").isNotNull()).select("run", "theme", F.explode(F.array_distinct("code_indices")).alias("_i"))
    code = codes.select(F.col("run").alias("_r"), F.col(code_key).alias("_c"), *[c for c in codes.columns if c != "run"])
    a = listed.join(code, (F.col("run") == F.col("_r")) & (F.col("_i") == F.col("_c"))).drop("_i", "_r", "_c")
    b = themes.filter(F.col("code_indices").isNull()).select("run", "theme").join(code, F.col("run") == F.col("_r")).drop("_r", "_c")
    return a.unionByName(b)


def top_quotes(linked: DataFrame, n: int = 3, order: str = "code_id", by: Sequence[str] = ("run", "theme")) -> DataFrame:
    """First n non-blank quotes per theme, in code order."""
    from pyspark.sql import Window as W

    quotes = linked.filter(strip("quote") != "").withColumn("_s", F.pmod(F.xxhash64(order), F.lit(64)))
    # first n per (theme, slice), then per theme among those: no theme is ever sorted whole
    few = quotes.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_s").orderBy(order))).filter(F.col("_r") <= n)
    ranked = few.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(order)))
    return ranked.filter(F.col("position") <= n).select(*by, "position", "quote")
