"""Evidence tables of deductive coding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import first_row


def dominant_valence(p: Column, n: Column, u: Column) -> Column:
    """absent when nothing was found; ties go to positive, then negative."""
    return (
        F.when((p == 0) & (n == 0) & (u == 0), "absent")
        .when((p >= n) & (p >= u), "positive")
        .when((n >= p) & (n >= u), "negative")
        .otherwise("neutral")
    )


def evidence_matrix(evidence: DataFrame, constructs: Sequence[str]) -> DataFrame:
    """Participants x constructs, summed evidence, 0 where none."""
    return evidence.groupBy("participant_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("construct_name") == c, F.col("evidence_count"))), F.lit(0)).alias(c) for c in constructs]
    )


def valence_matrix(evidence: DataFrame, constructs: Sequence[str], order: str) -> DataFrame:
    """Participants x constructs, dominant valence of the first row per cell."""
    v = dominant_valence(F.col("valence_positive"), F.col("valence_negative"), F.col("valence_neutral"))
    first = first_row(evidence.withColumn("_v", v), ["participant_id", "construct_name"], [F.col(order)], ["_v"])
    return first.groupBy("participant_id").agg(*[F.max(F.when(F.col("construct_name") == c, F.col("_v"))).alias(c) for c in constructs])


def summary_by_construct(evidence: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return evidence.groupBy(*by, "construct_name", "construct_group").agg(
        F.sum("evidence_count").alias("total_evidence"), F.count_if(F.col("evidence_count") > 0).alias("n_participants_with_evidence"),
        F.sum("valence_positive").alias("total_positive"), F.sum("valence_negative").alias("total_negative"), F.sum("valence_neutral").alias("total_neutral"),
    )


def summary_by_participant(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("participant_id").agg(
        F.sum("evidence_count").alias("total_evidence"), F.count_if(F.col("evidence_count") > 0).alias("constructs_with_evidence"),
        F.sum("valence_positive").alias("total_positive"), F.sum("valence_negative").alias("total_negative"),
    )


def participant_profiles(evidence: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Per participant (and ``by``) a map construct -> last evidence struct, and totals over all rows.

    Cells are reduced to one struct per construct first, so the map is bounded by the code book.
    """
    from ..core import last_row

    fields = ["evidence_count", "valence_positive", "valence_negative", "valence_neutral"]
    last = last_row(evidence, [*by, "participant_id", "construct_name"], [F.col(order)], fields)
    maps = last.groupBy(*by, "participant_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("construct_name", F.struct(*fields).alias("v"))))).alias("constructs")
    )
    totals = evidence.groupBy(*by, "participant_id").agg(
        F.sum("evidence_count").alias("total_evidence"), F.sum("valence_positive").alias("total_positive"), F.sum("valence_negative").alias("total_negative")
    )
    return maps.join(totals, [*by, "participant_id"])


def low_evidence_flag(evidence: DataFrame, threshold: int = 0) -> DataFrame:
    """Mark error-free rows with at most ``threshold`` pieces of evidence as reviewed."""
    return evidence.withColumn("phase4_reviewed", (F.col("evidence_count") <= threshold) & F.col("error").isNull())
