"""Readers of free text: transcripts, reflections, caption files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import first_row, strip
from ..functions.text import FILE_SUFFIXES, participant_from_file, reflection_module

# Line shapes of a caption file.
CUE = r"^\d{2}:\d{2}:\d{2}\.\d+ --> \d{2}:\d{2}:\d{2}\.\d+"
SPEAKER = r"^[A-Za-z0-9 ]+:\s*"


def read_transcripts(df: DataFrame, source_type: str | None = None, cohort_ids: Sequence[str] | None = None) -> DataFrame:
    """Transcripts by type and cohort; with a cohort filter, untagged ones drop out."""
    if source_type:
        df = df.filter(F.col("source_type") == source_type)
    if cohort_ids:
        df = df.filter(F.col("cohort_id").isin(list(cohort_ids)))
    return df.select("participant_id", "source_type", "content", "cohort_id")


def reflections_as_transcripts(responses: DataFrame, part: str = "module_reflections", module: str | None = None) -> DataFrame:
    """Non-blank free-text answers of reflection instruments as transcripts."""
    df = responses.filter(F.col("instrument_name").contains(part) & (strip("response_value") != ""))
    if module:
        df = df.filter(F.col("instrument_name").contains(module))
    return df.select(
        F.col("user_id").alias("participant_id"), F.lit("reflection").alias("source_type"),
        reflection_module(F.col("instrument_name")).alias("module_id"), F.col("response_value").alias("content"),
    )


def reflection_texts(canonical: DataFrame, part: str = "module_reflections", modules: Sequence[str] | None = None, questions: Sequence[str] | None = None) -> DataFrame:
    """Non-blank reflections, the first per (user, question)."""
    df = canonical.filter(F.col("instrument_key").contains(part) & (strip("response_value") != ""))
    if modules:
        df = df.filter(F.col("module_id").isin(list(modules)))
    if questions:
        df = df.filter(F.col("question_id").isin(list(questions)))
    out = first_row(df, ["user_id", "question_id"], [F.col("submitted_at"), F.col("module_id")], ["module_id", "response_value"])
    return out.select("user_id", "module_id", "question_id", F.col("response_value").alias("text"))


def caption_text(raw: Column) -> Column:
    """Spoken text of a caption file: header, cue times, notes, numbers and speaker labels removed."""
    lines = F.transform(F.split(raw, r"\r\n|\r|\n"), lambda x: strip(x))
    spoken = F.filter(
        lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.rlike(CUE) & ~x.startswith("NOTE") & ~x.rlike(r"^\d+$")
    )
    bare = F.filter(F.transform(spoken, lambda x: F.regexp_replace(x, SPEAKER, "")), lambda x: x != "")
    return F.array_join(bare, " ")


def parse_captions(files: DataFrame, suffixes: Sequence[str] = FILE_SUFFIXES) -> DataFrame:
    """``path, value`` (whole files) -> ``participant_id, content``."""
    caption = F.lower("path").endswith(".vtt")
    return files.select(
        participant_from_file(F.col("path"), suffixes).alias("participant_id"),
        F.when(caption, caption_text(F.col("value"))).otherwise(strip("value")).alias("content"),
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a folder: ``path, value``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
