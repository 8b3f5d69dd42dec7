"""Small helpers every operator shares: contracts, bounded broadcasts, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A configuration table (answer keys, scales, code books) is broadcast only below this many rows.
MAX_CONFIG_ROWS = 200_000


class ContractError(ValueError):
    """The input frame does not have the columns an operator needs."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{what} is missing column(s): {', '.join(sorted(missing))}")
    return df


def config_frame(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    """A broadcast-hinted frame made from configuration rows whose number is known here."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MAX_CONFIG_ROWS else df


def pin_config(df: DataFrame, max_rows: int = MAX_CONFIG_ROWS) -> DataFrame:
    """Configuration table -> local relation with a broadcast hint, read once.

    At most ``max_rows + 1`` rows reach the driver; a larger table is returned as it is, so the join
    strategy stays with the optimizer.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="scorewell-ship-")) / package.name
    path = shutil.make_archive(str(archive), "zip", root_dir=package.parent, base_dir=package.name)
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, below the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="scorewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing to shared storage, so a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` over all cores, for slow work on rows that come out of a few small files."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


ROWS_PER_TASK = 250_000  # rows that a task sorts or aggregates at a time


def place(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows dealt out by ``keys`` in as many parts as their number asks for.

    Sizes of shuffled bytes say little about rows that compress well: parts merged by bytes hold more and more rows as a table
    grows, and sorts and aggregations of them as much memory. Joins and aggregations by ``keys`` keep these parts.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)), *keys)


def all_of(conditions: Iterable[Column]) -> Column:
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """num / den, or ``empty`` when the denominator is zero or NULL."""
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))


def strip(c: Column | str) -> Column:
    """Whitespace of any kind off both ends (``trim`` takes spaces only)."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\n\r\x0b\x0c"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs, NULL when a side does not vary (``corr`` raises)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def clip(c: Column, low: float, high: float) -> Column:
    """``c`` limited to [low, high]; NULL stays NULL (least and greatest skip NULLs)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def round_clean(c: Column, places: int) -> Column:
    """Half-up rounding after floating-point noise beyond ten decimals is gone, so that sums taken in
    another order cannot flip an exact half."""
    return F.round(F.round(c, 10), places)


def weighted_available(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are present; NULL when none is."""
    top = reduce(lambda a, b: a + b, [F.coalesce(v * F.lit(w), F.lit(0.0)) for v, w in parts])
    bottom = reduce(
        lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for v, w in parts]
    )
    return F.when(bottom > 0, top / bottom)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The first row per key under ``order``: a map-side combined min over structs, not a window.

    A window would sort one key's whole group in one task; the struct minimum keeps a single row per
    key and map task, so a key that holds a third of the table stays cheap.
    """
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in columns])
    return (
        df.groupBy(*keys)
        .agg(F.min(packed).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in columns])
    )


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The last row per key under ``order`` (see ``first_row``)."""
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in columns])
    return (
        df.groupBy(*keys)
        .agg(F.max(packed).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])
    )
