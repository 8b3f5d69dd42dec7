"""The scored long table every analysis starts from."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import MAX_CONFIG_ROWS, ContractError, all_of, pin_config, require_columns, strip
from ..functions.text import DEMOGRAPHICS_KEY, infer_module
from .scoring import rule_table, score_items

CANONICAL_COLUMNS = (
    "user_id", "module_id", "instrument_key", "question_id", "response_value", "item_score",
    "construct", "grade", "submitted_at", "completed_at", "cohort_id",
)  # fixed value
LEGACY_NAMES = {
    "instrument_name": "instrument_key",
    "response_raw": "response_value",
    "response_score": "item_score",
    "timestamp": "submitted_at",
}  # fixed value


def normalize_schema(raw: DataFrame) -> DataFrame:
    """Legacy column names to current ones, then the contract check."""
    df = raw.withColumnsRenamed({old: new for old, new in LEGACY_NAMES.items() if old in raw.columns})
    return require_columns(df, ["user_id", "instrument_key", "question_id", "response_value"], "raw responses")


def pack_items(item_dim: DataFrame) -> DataFrame:
    """``item_dim`` as one row per instrument: its module and a question -> construct map."""
    return item_dim.groupBy("instrument_key").agg(
        F.max("module_id").alias("_module"),
        F.map_from_entries(F.collect_set(F.struct("question_id", "construct"))).alias("_constructs"),
    )


def attach_metadata(responses: DataFrame, packed_items: DataFrame) -> DataFrame:
    """Module and construct per (instrument, question); an undefined instrument gets an inferred module.

    Questions of a defined instrument that its definition does not list keep that instrument's module.
    ``packed_items`` comes from ``pack_items``.
    """
    df = responses.withColumn("question_id", strip("question_id")).withColumn("instrument_key", strip("instrument_key"))
    joined = df.join(packed_items, "instrument_key", "left")
    return joined.withColumn(
        "module_id", F.coalesce("_module", infer_module(F.col("instrument_key")))
    ).withColumn("construct", F.try_element_at("_constructs", F.col("question_id"))).drop("_module", "_constructs")


def unresolved_items(responses: DataFrame, item_dim: DataFrame) -> DataFrame:
    """(instrument_key, question_id, reason, n_rows) of answers whose metadata are guessed or missing.

    ``instrument`` means that no definition has the instrument, so its module is inferred from its name; ``question`` that the
    instrument's definition does not list the question, so it has the instrument's module and no construct.
    """
    named = responses.select(strip("instrument_key").alias("instrument_key"), strip("question_id").alias("question_id"))
    seen = named.groupBy("instrument_key", "question_id").agg(F.count(F.lit(1)).alias("n_rows"))
    listed = item_dim.select("instrument_key", "question_id", F.lit(True).alias("_listed")).distinct()
    defined = item_dim.select("instrument_key", F.lit(True).alias("_defined")).distinct()
    found = seen.join(listed, ["instrument_key", "question_id"], "left").join(defined, "instrument_key", "left").filter(F.col("_listed").isNull())
    return found.select("instrument_key", "question_id", F.when(F.col("_defined").isNull(), "instrument").otherwise("question").alias("reason"), "n_rows")


def require_resolved(responses: DataFrame, item_dim: DataFrame, shown: int = 20) -> DataFrame:
    """``responses`` if every answer's metadata are defined; otherwise an error that names the first cases."""
    cases = unresolved_items(responses, item_dim).orderBy("instrument_key", "question_id").limit(shown).collect()
    if cases:
        told = ", ".join(f"{r.instrument_key}/{r.question_id} ({r.reason}, {r.n_rows} rows)" for r in cases)
        raise ContractError(f"undefined metadata: {told}")
    return responses


def attach_grade(df: DataFrame, demographics: DataFrame) -> DataFrame:
    require_columns(demographics, ["user_id", "grade"], "demographics")
    return df.join(demographics.select("user_id", "grade"), "user_id", "left")


def attach_cohort(df: DataFrame, cohort_map: DataFrame) -> DataFrame:
    return df.join(cohort_map.select("user_id", "cohort_id"), "user_id", "left")


def drop_excluded(df: DataFrame, excluded: list[str], column: str = "user_id") -> DataFrame:
    """Leave listed participants out, whatever the case or spacing of their id."""
    ids = sorted({e.strip().lower() for e in excluded if e and e.strip()})
    return df.filter(~F.lower(strip(column)).isin(ids) | F.col(column).isNull()) if ids else df


SOME_PREFIXES = 40


def _begins(column: str, keys: list[str] | None) -> Column | None:
    """The column begins with one of the keys or with white space; many keys are compared as one range."""
    if keys is None or keys == []:
        return None
    if len(keys) > SOME_PREFIXES:
        hit = (F.col(column) >= min(keys)) & (F.col(column) < max(keys) + "\U0010ffff")
    else:
        hit = reduce(lambda a, b: a | b, [F.col(column).startswith(k) for k in keys])
    return hit | (F.col(column) < "!")


@dataclass
class FilterSpec:
    """Optional predicates, ANDed. An empty list filters nothing; date bounds are exclusive; score
    bounds are inclusive and drop rows without a score."""

    module_ids: list[str] | None = None
    instrument_keys: list[str] | None = None
    question_ids: list[str] | None = None
    user_ids: list[str] | None = None
    grades: list[str] | None = None
    constructs: list[str] | None = None
    submitted_after: str | None = None
    submitted_before: str | None = None
    completed_after: str | None = None
    completed_before: str | None = None
    min_score: float | None = None
    max_score: float | None = None
    cohort_ids: list[str] | None = None

    LISTS = {
        "module_ids": "module_id", "instrument_keys": "instrument_key", "question_ids": "question_id",
        "user_ids": "user_id", "grades": "grade", "constructs": "construct", "cohort_ids": "cohort_id",
    }

    def validate(self) -> bool:
        lists_ok = all(
            v is None or (isinstance(v, list) and all(isinstance(x, str) for x in v))
            for v in (getattr(self, name) for name in self.LISTS)
        )
        numbers_ok = all(v is None or isinstance(v, (int, float)) for v in (self.min_score, self.max_score))
        return lists_ok and numbers_ok

    def normalized(self) -> dict:
        return {k: sorted(v) if isinstance(v, list) else v for k, v in asdict(self).items()}

    def hash_column(self) -> Column:
        """SHA-256 over the spec's JSON with sorted keys and sorted lists, as a column."""
        import json

        return F.sha2(F.lit(json.dumps(self.normalized(), sort_keys=True)), 256)

    def condition(self, df: DataFrame) -> Column:
        if not self.validate():
            raise ContractError("invalid filter specification")
        needed = ["user_id", "module_id", "instrument_key", "question_id", "item_score", "construct", "grade", "submitted_at"]
        require_columns(df, needed + (["cohort_id"] if self.cohort_ids else []), "canonical dataset")
        tests = [F.col(c).isin(getattr(self, name)) for name, c in self.LISTS.items() if getattr(self, name)]
        tests += self._dates(df, "submitted_at", self.submitted_after, self.submitted_before)
        if "completed_at" in df.columns:
            tests += self._dates(df, "completed_at", self.completed_after, self.completed_before)
        if self.min_score is not None:
            tests.append(F.col("item_score") >= float(self.min_score))
        if self.max_score is not None:
            tests.append(F.col("item_score") <= float(self.max_score))
        return all_of(tests)

    @staticmethod
    def _dates(df: DataFrame, column: str, after: str | None, before: str | None) -> list[Column]:
        text = dict(df.dtypes)[column] == "string"
        # a real timestamp column is compared bare, so the bound reaches the Parquet scan
        value = F.try_to_timestamp(F.col(column)) if text else F.col(column)
        kind = "timestamp" if text else dict(df.dtypes)[column]
        out = []
        if after:
            out.append(value > F.lit(after).cast(kind))
        if before:
            out.append(value < F.lit(before).cast(kind))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition(df))

    def raw_condition(self, df: DataFrame, book: Rulebook) -> Column:
        """What the lists imply for raw columns, in comparisons that a Parquet scan can use; rows it drops ``condition`` drops too.

        Modules and constructs become the instruments and questions that the rule book has for them. Keys are compared after
        stripping, so a raw value passes if it begins with a key or with white space.
        """
        tests = [_begins("instrument_key", self.instrument_keys), _begins("question_id", self.question_ids)]
        if self.modules_or_constructs():
            tests += [_begins(column, keys) for column, keys in zip(("instrument_key", "question_id"), self._defined(book.item_rows()), strict=True)]
        return all_of([t for t in tests if t is not None])

    def modules_or_constructs(self) -> bool:
        return bool(self.module_ids or self.constructs)

    def _defined(self, rows: list | None) -> tuple[list[str] | None, list[str] | None]:
        """Beginnings of the instruments and questions that can have the wanted modules and constructs; None: any."""
        instruments = questions = None
        if rows is None:
            return None, None
        if self.constructs:
            mine = [r for r in rows if r.construct in self.constructs]
            instruments, questions = sorted({r.instrument_key for r in mine}), sorted({r.question_id for r in mine})
        if self.module_ids and "survey" not in self.module_ids:  # any other instrument without definition is a survey
            wanted = {r.instrument_key for r in rows if r.module_id in self.module_ids}
            wanted |= {name for name, module in (("module_reflections", "reflection"), (DEMOGRAPHICS_KEY, "demographics")) if module in self.module_ids}
            wanted |= {f"module{m.removeprefix('module_')}_" for m in self.module_ids if m.startswith("module_")}  # undefined tests carry their module
            instruments = sorted(wanted if instruments is None else {a for a in instruments if any(a.startswith(b) for b in wanted)})
        return instruments, questions


@dataclass
class Rulebook:
    """Item and scoring configuration of a study."""

    item_dim: DataFrame
    scoring: DataFrame
    rules: DataFrame = field(init=False)
    items: DataFrame = field(init=False)
    _rows: list | None = field(init=False, default=None, repr=False)

    def __post_init__(self):
        self.rules = pin_config(rule_table(self.scoring))
        self.items = pin_config(pack_items(self.item_dim))

    def item_rows(self) -> list | None:
        """The defined items as rows, read once; None when there are too many to hold on the driver."""
        if self._rows is None:
            self._rows = self.item_dim.select("instrument_key", "module_id", "question_id", "construct").limit(MAX_CONFIG_ROWS + 1).collect()
        return self._rows if len(self._rows) <= MAX_CONFIG_ROWS else None


def canonical_dataset(
    responses: DataFrame,
    book: Rulebook,
    demographics: DataFrame | None = None,
    cohort_map: DataFrame | None = None,
    spec: FilterSpec | None = None,
    excluded: list[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Raw responses -> the 11-column scored table, one output row per input row, as one lazy plan.

    Scores are computed on read from the raw answers and the rules; the two rule joins are broadcast. What ``spec`` implies for
    raw columns is tested before anything else, so it reaches the scan; users are cut down to the wanted grades and cohorts
    before they are scored. ``strict`` raises when an answer's instrument or question is not defined.
    """
    df = drop_excluded(normalize_schema(responses), excluded or [])
    if strict:
        require_resolved(df, book.item_dim)
    people = [("grade", demographics, spec and spec.grades), ("cohort_id", cohort_map, spec and spec.cohort_ids)]
    if spec is not None and spec.validate():
        df = df.filter(spec.raw_condition(df, book))
        for column, table, wanted in people:
            if wanted and table is not None:
                df = df.join(table.select("user_id", column).filter(F.col(column).isin(wanted)), "user_id")
    if "submitted_at" not in df.columns:
        df = df.withColumn("submitted_at", F.lit(None).cast("timestamp"))
    df = score_items(attach_metadata(df, book.items), book.rules)
    if "completed_at" not in df.columns:
        df = df.withColumn("completed_at", F.lit(None).cast("timestamp"))
    for (column, table, wanted), attach in zip(people, (attach_grade, attach_cohort), strict=True):
        if table is None:
            df = df.withColumn(column, F.lit(None).cast("string"))
        elif not wanted:
            df = attach(df, table)
    if spec is not None:
        df = spec.apply(df)
    return df.select(*CANONICAL_COLUMNS)


def dataset_fingerprint(canonical: DataFrame, config_hash: str = "") -> DataFrame:
    """Order-free hash of all rows plus the configuration hash: one row, no sort, no collect.

    A row's text is its values as strings, ``\\N`` for NULL, joined by U+0001, so other engines can say the same.
    """
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in canonical.columns]), 256)
    lanes = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = canonical.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(l), F.lit(0)).alias(f"s{i}") for i, l in enumerate(lanes)]
    )
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)], F.lit(config_hash))
    return sums.select("n_rows", F.sha2(text, 256).alias("dataset_hash"))


def union_without_clash(platform: DataFrame, imported: DataFrame) -> DataFrame:
    """Platform rows plus imported rows of users the platform does not have."""
    fresh = imported.join(platform.select("user_id").distinct(), "user_id", "left_anti")
    return platform.unionByName(fresh, allowMissingColumns=True)
