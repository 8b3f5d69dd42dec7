"""Module completion and sequential unlocking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def module_progress(completions: DataFrame, required: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Per (user, module): complete and unlocked flags, in curricular order.

    A module is complete when every required instrument is among the user's completed ones and at
    least one is required; the first module is unlocked, a later one when its predecessor is complete.
    ``required`` is configuration, so a user's state is one row holding at most that many entries.
    """
    wanted = [f"{m}\u0001{i}" for m, instruments in required for i in instruments]
    token = F.concat_ws("\u0001", "module_id", "instrument_key")
    users = completions.groupBy("user_id").agg(F.collect_set(F.when(token.isin(wanted), token)).alias("_done"))
    complete = [
        F.forall(F.array(*[F.lit(f"{m}\u0001{i}") for i in instruments]), lambda x: F.array_contains("_done", x))
        if instruments else F.lit(False)
        for m, instruments in required
    ]
    states = [
        F.struct(
            F.lit(m).alias("module_id"),
            F.lit(pos + 1).alias("position"),
            complete[pos].alias("complete"),
            (F.lit(True) if pos == 0 else complete[pos - 1]).alias("unlocked"),
        )
        for pos, (m, _) in enumerate(required)
    ]
    return users.select("user_id", F.explode(F.array(*states)).alias("s")).select("user_id", "s.*")


def neighbours(modules: Sequence[str]) -> list[tuple[str, str | None, str | None]]:
    """(module, previous, next) in curricular order."""
    return [
        (m, modules[i - 1] if i else None, modules[i + 1] if i + 1 < len(modules) else None) for i, m in enumerate(modules)
    ]


def module_neighbours(rows: DataFrame, modules: Sequence[str]) -> DataFrame:
    """Add the previous and next learning unit of each row's module."""
    from ..core import config_frame

    dim = config_frame(rows.sparkSession, neighbours(modules), "module_id string, previous string, next string")
    return rows.join(dim, "module_id", "left")
