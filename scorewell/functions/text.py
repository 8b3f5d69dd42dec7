"""String columns: answers, instrument keys, modules, identifiers, word sets, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import strip

# Fixed values.
COURSE_PREFIXES = ("precourse_", "postcourse_")
DEMOGRAPHICS_KEY = "demographics_survey"
STUDENT_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_\-]{1,39}$"
FIGURE_WORDS = (
    r"(?i)\b(image|picture|diagram|photo|photograph|figure|chart|graph|illustration|"
    r"shown (below|above)|look at|the (tree|map|table) (below|above))\b"
)
OPTION_PATTERN = r"(?s)^\s*([A-Za-z])\s*[).:]\s*(.*)$"
FILE_SUFFIXES = ("transcript", "interview", "recording", "reflection")


def normalize_choice(c: Column) -> Column:
    """``"B: some text"`` -> ``"B"``; anything else is only trimmed."""
    return strip(F.element_at(F.split(strip(c), ":"), 1))


def option_letter(c: Column) -> Column:
    """The leading option letter of ``"B: text"`` or ``"b"``; NULL when there is none."""
    letter = F.upper(F.regexp_extract(strip(c), r"^([A-Za-z])\s*(?::|$)", 1))
    return F.when(letter != "", letter)


def matches_base(c: Column, base: str) -> Column:
    """The instrument is ``base`` itself or carries it behind a prefix."""
    return (c == base) | c.endswith("_" + base)


def is_survey(c: Column, survey_bases: Sequence[str]) -> Column:
    hit = F.lit(False)
    for base in survey_bases:
        hit = hit | matches_base(strip(c), base)
    return hit


def resolve_instrument_key(c: Column, survey_bases: Sequence[str]) -> Column:
    """Stored name -> canonical key: survey base, else course prefix off, else demographics, else itself."""
    name = strip(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for base in survey_bases:
        out = out.when(matches_base(name, base), F.lit(base))
    for prefix in COURSE_PREFIXES:
        out = out.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1_000_000))
    return out.when(matches_base(name, DEMOGRAPHICS_KEY), F.lit(DEMOGRAPHICS_KEY)).otherwise(name)


def normalize_module_id(c: Column) -> Column:
    """``module3`` -> ``module_3``; names that already contain an underscore stay."""
    bare = c.startswith("module") & ~c.contains("_")
    return F.when(bare, F.concat(F.lit("module_"), F.replace(c, F.lit("module"), F.lit("")))).otherwise(c)


def infer_module(instrument: Column) -> Column:
    """Module of an instrument that has no definition."""
    raw = (
        F.when(
            instrument.startswith("module") & instrument.contains("_content_mcq"),
            F.element_at(F.split(instrument, "_"), 1),
        )
        .when(instrument == "module_reflections", F.lit("reflection"))
        .when(instrument == DEMOGRAPHICS_KEY, F.lit("demographics"))
        .otherwise(F.lit("survey"))
    )
    return normalize_module_id(raw)


def module_number(c: Column) -> Column:
    """First run of digits as an int, 0 when there is none."""
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("int"))


def reflection_module(instrument: Column) -> Column:
    """``module_N`` from a leading ``moduleN`` / ``module_N``, else the name itself."""
    n = F.regexp_extract(instrument, r"(?i)^module_?(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("module_"), n)).otherwise(instrument)


def natural_key(c: Column, width: int = 12) -> Column:
    """Sort key under which ``Q2`` comes before ``Q10``: every digit run is zero-padded."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(F.lower(p)),
        ),
        "",
    )


def participant_from_file(path: Column, suffixes: Sequence[str] = FILE_SUFFIXES) -> Column:
    """Participant id from a file name: drop folder, extension and any trailing kind markers."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    tail = r"(?i)(_(" + "|".join(suffixes) + r"))+$"
    bare = F.regexp_replace(stem, tail, "")
    return F.replace(F.regexp_replace(bare, r"^_+|_+$", ""), F.lit(" "), F.lit("_"))


def parse_option(raw: Column, index: Column) -> Column:
    """``"B) text"`` -> struct(label, text); an unlabelled option gets the letter of its position."""
    label = F.upper(F.regexp_extract(raw, OPTION_PATTERN, 1))
    return F.when(
        label != "",
        F.struct(label.alias("label"), strip(F.regexp_extract(raw, OPTION_PATTERN, 2)).alias("text")),
    ).otherwise(
        F.struct(F.char(index + F.lit(65)).alias("label"), strip(raw).alias("text"))
    )


def depends_on_figure(text: Column) -> Column:
    return text.rlike(FIGURE_WORDS)


def item_hash(text: Column, options: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the item's canonical JSON (options, then text)."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    pairs = F.array_join(
        F.transform(
            options,
            lambda o: F.concat(F.lit("["), quoted(o["label"]), F.lit(", "), quoted(strip(o["text"])), F.lit("]")),
        ),
        ", ",
    )
    payload = F.concat(F.lit('{"o": ['), pairs, F.lit('], "t": '), quoted(strip(text)), F.lit("}"))
    return F.substring(F.sha2(payload, 256), 1, 16)


def token_estimate(text: Column) -> Column:
    """Four characters a token, one token at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets; two empty sets score 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def matched_indicators(text: Column, quotes: Column, indicators: Column) -> Column:
    """Indicators whose first three words of four or more letters all occur in text or quotes."""
    combined = F.concat(F.lower(text), F.lit(" "), F.lower(F.array_join(quotes, " ")))

    def keywords(ind: Column) -> Column:
        bare = strip(F.regexp_replace(F.lower(ind), "['\"]", ""))
        words = F.filter(F.split(bare, r"\s+"), lambda w: F.length(w) >= 4)
        return F.slice(words, 1, 3)

    return F.filter(
        indicators,
        lambda ind: (F.size(keywords(ind)) > 0) & F.forall(keywords(ind), lambda w: F.contains(combined, w)),
    )
