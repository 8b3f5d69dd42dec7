"""Whole analyses of free text, chained from the single steps: inductive (codes to report) and deductive (evidence to report).

Every step stores what the model answered, so nothing is asked twice, and hands frames on; a failed call is a row that the
counts at the end show, never a lost one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import materialize, spread
from . import codes as cd
from . import coding as co
from .evidence import participant_profiles, summary_by_construct

CONSTRUCT_LINE = "{construct_name}: evidence={total_evidence}, positive={total_positive}, negative={total_negative}, neutral={total_neutral}, participants={n_participants_with_evidence}"


def inductive_analysis(
    transcripts: DataFrame, models: Mapping[str, co.ModelFn], instructions: Mapping[str, str], encode: Callable[[Column], Column],
    run: str = "run", model: str = "model", chunk_budget: int = 2_500, budget: int = 100_000, threshold: float = 0.85, n_codes: int = 3,
) -> dict[str, DataFrame]:
    """Chunks, codes, deduplication, themes, definitions and report of one run, as frames by name.

    ``models`` and ``instructions`` have an entry for each of ``code``, ``group``, ``define`` and ``report``; ``encode`` turns a
    text column into a vector column. Returned: ``chunks``, ``codes`` (with errors of failed chunks), ``links`` (a code and
    the code that stands for it), ``kept``, ``themes``, ``linked`` (a theme's codes), ``definitions``, ``report`` and
    ``summary`` (one row of counts).
    """
    step = lambda name: (models[name], instructions[name])
    chunks = materialize(co.chunk_transcripts(transcripts, chunk_budget), "chunks")
    coded = materialize(co.code_chunks(chunks, *step("code"), n_codes=n_codes, run=run, model=model), "codes")
    codes = coded.filter(F.col("code_id").isNotNull())
    links = materialize(_code_links(codes, encode, threshold), "links")
    kept = materialize(codes.join(links.filter("code_id = leader_id").select("code_id"), "code_id", "left_semi"), "kept")
    themes = materialize(co.group_codes(kept, *step("group"), budget=budget), "themes")
    found = themes.filter(F.col("theme_index").isNotNull()).select("run", F.col("name").alias("theme"), "theme_index", "code_indices")
    linked = materialize(cd.theme_codes(found, kept), "linked")
    definitions = materialize(co.define_themes(linked, *step("define"), budget=budget), "definitions")
    told = found.select("run", "theme", "theme_index").join(definitions.select("run", "theme", "summary"), ["run", "theme"], "left")
    report = materialize(co.write_report(told, cd.top_quotes(linked), *step("report"), budget=budget), "report")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))  # noqa: E731  single rows
    parts = [
        count(chunks, "n_chunks"), count(coded.filter("code_id IS NULL"), "n_failed_chunks"), count(codes, "n_codes"), count(kept, "n_kept"), count(found, "n_themes"),
        themes.agg(F.coalesce(F.max("failed_parts"), F.lit(0)).alias("n_failed_groupings")), count(definitions.filter("summary IS NULL"), "n_failed_definitions"),
    ]
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.join(F.broadcast(part))
    return {
        "chunks": chunks, "codes": coded, "links": links, "kept": kept, "themes": themes, "linked": linked, "definitions": definitions, "report": report,
        "summary": summary.select(F.lit(run).alias("run"), "*"),
    }


def _code_links(codes: DataFrame, encode: Callable[[Column], Column], threshold: float) -> DataFrame:
    """``code_id, leader_id`` of every code. Codes of the same text have the same vector, so a text is encoded once, and the
    first code of each text is linked for all of them; a code whose vector is zero stands for itself."""
    named = codes.select("code_id", F.concat_ws(" ", "name", "description").alias("text"))
    texts = spread(named.groupBy("text").agg(F.min("code_id").alias("first")), "first")
    encoded = materialize(texts.select("text", "first", encode(F.col("text")).cast("array<double>").alias("embedding")), "encoded")
    led = cd.dedup_links(encoded, threshold, key="first").withColumnRenamed("code_id", "first")
    told = encoded.select("text", "first", cd._like_none(F.col("embedding")).alias("alone")).join(led, "first")
    return named.join(told, "text").select("code_id", F.when(F.col("alone"), F.col("code_id")).otherwise(F.col("leader_id")).alias("leader_id"))


def deductive_report(
    evidence: DataFrame, model_fn: co.ModelFn, instruction: str, budget: int = 100_000, template: str = co.LIST_PROMPT, line: str = CONSTRUCT_LINE
) -> DataFrame:
    """One narrative per run over its construct table: ``run, n_constructs, construct_table, report_text, error, failed_parts``.

    ``evidence`` are rows of ``extract_evidence`` with a ``run``; rows with an error count as no evidence. The table goes into the
    prompt as one line per construct, in order of name; it also is in the result, as an array as long as the code book.
    """
    table = materialize(summary_by_construct(evidence, ["run"]), "constructs")
    cells = {c: F.col(c) for c in table.columns if c != "run"}

    def ask(lists: DataFrame) -> DataFrame:
        called = co.call_model(lists, co.fill(template, instruction=F.lit(instruction), lines=F.col("lines")), model_fn)
        return called.select("run", "batch", F.col("n_lines").alias("n_constructs"), co.strip("reply").alias("report_text"), "error")

    def again(answers: DataFrame, budget: int) -> DataFrame:
        return co._lines(answers, ["run"], "batch", F.col("report_text"), budget, F.col("n_constructs"))

    told = co._until_one(co._lines(table, ["run"], "construct_name", co.fill(line, **cells), budget), ["run"], ask, again, budget, "report_text")
    rows = table.groupBy("run").agg(F.sort_array(F.collect_list(F.struct(*cells))).alias("construct_table"))
    return told.join(rows, "run").select("run", "n_constructs", "construct_table", "report_text", "error", "failed_parts")


def deductive_analysis(
    transcripts: DataFrame, codebook: list[dict], models: Mapping[str, co.ModelFn], instructions: Mapping[str, str], run: str = "run", focus: str = "", model: str = "model"
) -> dict[str, DataFrame]:
    """Evidence, construct table with narrative, and participant profiles of one run; entries ``evidence`` and ``report``."""
    found = co.extract_evidence(transcripts, codebook, models["evidence"], instructions["evidence"], focus, model)
    evidence = materialize(found.select(F.lit(run).alias("run"), "*"), "evidence")
    return {
        "evidence": evidence, "report": deductive_report(evidence, models["report"], instructions["report"]),
        "profiles": participant_profiles(evidence, "construct_name", ["run"]),
    }
