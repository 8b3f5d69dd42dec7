"""Coding of free text with an injected model: chunks, prompts, replies, evidence, ratings.

``model_fn(prompt) -> {"text": str, "error": str | None, "tokens_used": int}`` is the caller's. Every
operator builds prompts and reads replies with columns; only the call itself runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from string import Formatter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..core import materialize, spread, strip

from ..functions.replies import reply_json, rubric_justification, rubric_scores, schema_errors
from ..functions.text import matched_indicators, reflection_module, token_estimate
from .ordered import cumulative_histogram, running_total

ModelFn = Callable[[str], dict]
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
CODES_SCHEMA = "struct<codes: array<struct<name:string, description:string, quote:string>>>"
THEMES_SCHEMA = "struct<themes: array<struct<name:string, description:string, code_indices:array<int>>>>"
EVIDENCE_SCHEMA = "struct<evidence_count: int, instances: array<struct<quote:string, valence:string>>>"
UNREADABLE, EMPTY = "unreadable_reply", "empty_reply"
RUBRIC_MAX = 12.0  # fixed value: three dimensions of at most 4


ROWS_AT_ONCE = 64  # texts of a batch that are Python objects at a time


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so a worker's memory follows a few texts, not those of a whole batch; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


# -- chunks ------------------------------------------------------------------------------------


def _cuts(costs: Sequence[int], budget: int, fixed: Sequence[bool] | None = None) -> list[int]:
    """Start positions of consecutive runs whose cost stays within the budget; a fixed entry never starts one."""
    starts, load = [0], 0
    for at, cost in enumerate(costs):
        if load and load + cost > budget and not (fixed and fixed[at]):
            starts.append(at)
            load = 0
        load += cost
    return [*starts, len(costs)]


def pack_text(text: str, budget: int) -> list[tuple[str, bool]]:
    """Chunks of whole sentences within a budget of estimated tokens; the flag marks chunks cut inside a sentence.

    A sentence above the budget is cut between words: its full runs are chunks of their own, its last run is laid to the
    sentences around it.
    """
    cost = lambda s: max(1, len(s) // 4)
    units, costs, rest, inner = [], [], [], []
    for at, sentence in enumerate(_SENTENCE_END.split(text)):
        part, size = sentence, cost(sentence)
        if over := size > budget:
            words = sentence.split()
            sizes = [cost(w) for w in words]
            cuts = _cuts(sizes, budget)
            inner += [(at, " ".join(words[i:j]), True) for i, j in zip(cuts, cuts[1:-1])]
            part, size = " ".join(words[cuts[-2] :]), sum(sizes[cuts[-2] :])
        units.append(part)
        costs.append(size)
        rest.append(over)
    cuts = _cuts(costs, budget, rest)
    whole = [(j, " ".join(units[i:j]), False) for i, j in zip(cuts, cuts[1:])]
    # a run is complete where the next one starts, so chunks cut out of a sentence inside it come before it
    return [(chunk, within) for _, chunk, within in sorted(inner + whole, key=lambda c: c[0]) if chunk]


def chunk_transcripts(transcripts: DataFrame, chunk_size: int = 2500, order: str = "doc_order") -> DataFrame:
    """Transcripts (``order`` numeric and unique, ``participant_id, content``) as numbered chunks.

    Chunks of a document come from its own row; their global numbers are a prefix sum of per-document
    counts, so documents are processed independently.
    """

    chunk = pa.list_(pa.struct([("content", pa.string()), ("within", pa.bool_())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            chunks = [[{"content": c, "within": w} for c, w in pack_text(t.as_py().strip(), chunk_size)] for t in part["content"]]
            yield pa.RecordBatch.from_arrays([part["_doc"], part["participant_id"], pa.array(chunks, chunk)], ["_doc", "participant_id", "_chunks"])

    texts = transcripts.filter(strip("content") != "").select(F.col(order).alias("_doc"), "participant_id", "content")
    fields = [T.StructField("_chunks", T._parse_datatype_string("array<struct<content:string, within:boolean>>"))]
    docs = texts.mapInArrow(pack, T.StructType([*texts.schema.fields[:2], *fields]))
    docs = materialize(docs.withColumn("_n", F.size("_chunks")), "chunks")  # texts are packed once for the three uses below
    # only the counts go through the prefix sums, not the texts
    counts = docs.select("_doc", "participant_id", "_n")
    starts = running_total(counts, "_doc", "_n", "_start").select("_doc", "_start")
    mine = cumulative_histogram(counts, ["participant_id"], "_doc", F.col("_n")).select("_doc", F.col("n_before").alias("_mine"))
    rows = docs.join(starts, "_doc").join(mine, "_doc").select("_doc", "participant_id", "_start", "_mine", F.posexplode("_chunks").alias("_p", "_c"))
    index = F.col("_start") + F.col("_p")
    return rows.select(
        index.alias("chunk_index"), "participant_id", F.col("_c.content").alias("content"), F.length("_c.content").alias("char_count"),
        token_estimate(F.col("_c.content")).alias("token_estimate"),
        F.when(F.col("_c.within"), index).otherwise(F.col("_mine") + F.col("_p")).alias("source_chunk"),
    )


# -- model calls -------------------------------------------------------------------------------


def call_model(df: DataFrame, prompt: Column, model_fn: ModelFn) -> DataFrame:
    """One call per row; adds ``prompt, reply, error, tokens_used``. A raised error becomes a value.

    Replies are stored before they are returned: whatever is done with the frame, a row is asked once.
    """
    withp = df.withColumn("prompt", prompt)
    schema = T.StructType(
        withp.schema.fields
        + [T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()), T.StructField("tokens_used", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            replies, errors, tokens = [], [], []
            for p in part["prompt"]:
                try:
                    r = model_fn(p.as_py())
                except Exception as ex:  # an outage of the model is a row, not a failed job
                    r = {"text": None, "error": f"{type(ex).__name__}: {ex}"}
                errors.append(r.get("error"))
                replies.append(None if r.get("error") else r.get("text"))
                tokens.append(int(r.get("tokens_used") or 0))
            told = [pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *told], [*part.schema.names, "reply", "error", "tokens_used"])

    return materialize(withp.mapInArrow(run, schema), "replies")


def fill(template: str, **values: Column) -> Column:
    """A caller's template with ``{name}`` fields as a column; a NULL value is an empty text, so no line is lost."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def _parsed(called: DataFrame, schema: str) -> DataFrame:
    clean = called.withColumn("_json", reply_json(F.col("reply")))
    out = clean.withColumn("parsed", F.from_json("_json", schema))
    failed = F.col("error").isNull() & F.col("_json").isNull()
    return out.withColumn("error", F.when(failed, UNREADABLE).otherwise(F.col("error"))).drop("_json")


def _lines(rows: DataFrame, by: Sequence[str], order: str, line: Column, budget: int, weight: Column | None = None) -> DataFrame:
    """Lines of a group joined in order, in batches of about ``budget`` estimated tokens.

    A list that fits one prompt is one row, as a single call would take it; a longer one becomes
    several bounded prompts instead of one unbounded string. ``n_lines`` counts lines, or adds up ``weight``.
    """
    by = list(by)
    weight = F.lit(1) if weight is None else weight
    sized = rows.select(*by, F.col(order).alias("_o"), line.alias("_line"), weight.alias("_w")).withColumn("_t", token_estimate(F.col("_line")))
    before = cumulative_histogram(sized, by, "_o", F.col("_t")).select(*by, F.col("_o"), F.col("n_before"))
    placed = sized.join(before, [*by, "_o"]).withColumn("batch", F.floor(F.col("n_before") / budget).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_line"))), lambda s: s["_line"]), "\n")
    return placed.groupBy(*by, "batch").agg(joined.alias("lines"), F.sum("_w").cast("bigint").alias("n_lines"))


CODE_PROMPT = "{instruction}\nCodes: {n_codes}\nPart {chunk_index} by {participant_id}\n{content}"
CODE_LINE = "{number} | {name} | {description} | {participant_id} | {quote}"
GROUP_PROMPT = "{instruction}\nWanted: {n_wanted}\n{lines}"
MEMBER_LINE = "* {name} | {description} | {quote}"
LIST_PROMPT = "{instruction}\n{lines}"
THEME_LINE = "# {theme} | {summary}\n{quotes}"


def code_chunks(
    chunks: DataFrame, model_fn: ModelFn, instruction: str, n_codes: int = 3, run: str = "run", model: str = "model", template: str = CODE_PROMPT
) -> DataFrame:
    """One call per chunk -> its codes, named by ``run, code_id`` and ready for grouping, deduplication and reports.

    Ids come from the chunk and the place in its reply, never from the reply's text; a failed chunk stays as one row with its
    error and no ``code_id``.
    """
    asked = chunks.select("chunk_index", "participant_id", "content")
    prompt = fill(template, instruction=F.lit(instruction), n_codes=F.lit(n_codes), **{c: F.col(c) for c in asked.columns})
    parsed = _parsed(call_model(asked, prompt, model_fn), CODES_SCHEMA)
    rows = parsed.select("chunk_index", "participant_id", "tokens_used", "error", F.posexplode_outer("parsed.codes").alias("position", "c"))
    return rows.select(
        F.lit(run).alias("run"), F.lit(model).alias("model"), (F.shiftleft(F.col("chunk_index").cast("bigint"), 20) + F.col("position")).alias("code_id"),
        "chunk_index", "participant_id", "position", F.col("c.name").alias("name"), F.col("c.description").alias("description"), F.col("c.quote").alias("quote"), "tokens_used", "error",
    )


def _until_one(
    asked: DataFrame, by: Sequence[str], ask: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame, int], DataFrame], budget: int, answered: str
) -> DataFrame:
    """Ask batch by batch; while a group has several batches, their answers are the lines of a further round.

    The budget doubles from round to round, so that answers as long as their lines come to an end, too. A batch without an
    ``answered`` column has failed: its lines are missing in the result, which says so in ``failed_parts`` and carries the
    first error; a group of which every batch failed stays as one row with its error.
    """
    by, ok, failures = list(by), F.col(answered).isNotNull(), None
    answers = ask(asked)
    while answers.groupBy(*by).agg(F.count_distinct("batch").alias("n")).filter("n > 1").limit(1).count():
        sizes = answers.groupBy(*by).agg(F.count_distinct("batch").alias("_batches"), F.max(ok).alias("_some"))
        answers = materialize(answers.join(sizes, by), "round")
        several = answers.filter("_batches > 1")
        lost = several.filter(~ok).select(*by, "batch", F.coalesce("error", F.lit(EMPTY)).alias("_error"))
        failures = lost if failures is None else failures.unionByName(lost)
        hopeless = several.filter("NOT _some AND batch = 0")  # one row stands for the group
        single, budget = answers.filter("_batches = 1").unionByName(hopeless).drop("_batches", "_some"), 2 * budget
        following = ask(again(several.filter(ok).drop("_batches", "_some"), budget))
        answers = materialize(single.unionByName(following), "round")
    if failures is None:
        return answers.withColumn("failed_parts", F.lit(0).cast("bigint"))
    told = failures.groupBy(*by).agg(F.count(F.lit(1)).alias("_failed"), F.min_by("_error", "batch").alias("_first"))
    out = answers.join(told, by, "left").withColumns({"error": F.coalesce("error", "_first"), "failed_parts": F.coalesce("_failed", F.lit(0).cast("bigint"))})
    return out.drop("_failed", "_first")


def group_codes(
    codes: DataFrame, model_fn: ModelFn, instruction: str, n_themes: int | None = None, budget: int = 100_000, template: str = GROUP_PROMPT, line: str = CODE_LINE
) -> DataFrame:
    """Codes of a run (``run, code_id, chunk_index, name, description, quote, participant_id``) -> themes.

    The number of themes defaults to a third of the codes, between 5 and 13. A list above ``budget`` estimated tokens is asked
    in parts, and the parts' themes are grouped again until one answer per run is left; their ``code_indices`` are united.
    The codes of a part whose call failed are in no theme: ``failed_parts`` counts such parts, ``error`` has the first error.
    """
    wanted = F.lit(n_themes) if n_themes else F.greatest(F.lit(5), F.least(F.lit(13), F.floor(F.col("n_codes") / 3))).cast("int")
    totals = codes.groupBy("run").agg(F.count(F.lit(1)).alias("n_codes")).withColumn("n_wanted", wanted)

    def prompts(rows: DataFrame, budget: int) -> DataFrame:
        cells = {c: F.col(c) for c in ("number", "name", "description", "participant_id", "quote")}
        return _lines(rows, ["run"], "_order", fill(line, **cells), budget).join(totals, "run")

    def ask(lists: DataFrame) -> DataFrame:
        prompt = fill(template, instruction=F.lit(instruction), n_wanted=F.col("n_wanted"), lines=F.col("lines"))
        parsed = _parsed(call_model(lists.select("run", "batch", "n_codes", "n_wanted", "lines"), prompt, model_fn), THEMES_SCHEMA)
        return parsed.select("run", "batch", "n_codes", "n_wanted", "error", F.posexplode_outer("parsed.themes").alias("theme_index", "t")).select(
            "run", "batch", "n_codes", "n_wanted", "theme_index", F.col("t.name").alias("name"), F.col("t.description").alias("description"),
            F.col("t.code_indices").alias("code_indices"), "error",
        )

    parts: list[DataFrame] = []

    def again(answers: DataFrame, budget: int) -> DataFrame:
        from pyspark.sql import Window as W

        place = F.row_number().over(W.partitionBy("run").orderBy("batch", "theme_index"))  # themes of a run: at most 13 per batch
        numbered = materialize(answers.filter(F.col("theme_index").isNotNull()).withColumn("number", place), "parts")
        parts.append(numbered.select("run", "number", F.col("code_indices").alias("_under")))
        return prompts(numbered.select("run", F.col("number").alias("_order"), "number", "name", "description", F.lit("").alias("participant_id"), F.lit("").alias("quote")), budget)

    def ask_and_unite(lists: DataFrame) -> DataFrame:
        themes = ask(lists)
        if not parts:
            return themes
        under = themes.select("run", "batch", "theme_index", F.explode("code_indices").alias("number")).join(parts[-1], ["run", "number"])
        united = under.groupBy("run", "batch", "theme_index").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_under")))).alias("_all"))
        out = themes.join(united, ["run", "batch", "theme_index"], "left")
        return out.withColumn("code_indices", F.coalesce("_all", F.array().cast("array<int>"))).drop("_all")

    first = codes.select("run", F.col("code_id").alias("_order"), F.col("chunk_index").alias("number"), "name", "description", "participant_id", "quote")
    return _until_one(prompts(first, budget), ["run"], ask_and_unite, again, budget, "theme_index")


def define_themes(linked: DataFrame, model_fn: ModelFn, instruction: str, budget: int = 100_000, template: str = LIST_PROMPT, line: str = MEMBER_LINE) -> DataFrame:
    """Final name and summary per theme from its codes (``run, theme, code_id, name, description, quote``); lists above the
    budget are summarised in parts and the parts' summaries again."""
    by = ["run", "theme"]
    cells = {c: F.col(c) for c in ("name", "description", "quote")}

    def ask(lists: DataFrame) -> DataFrame:
        prompt = fill(template, instruction=F.lit(instruction), lines=F.col("lines"))
        parsed = _parsed(call_model(lists, prompt, model_fn), "struct<name:string, summary:string>")
        return parsed.select(*by, "batch", F.coalesce("parsed.name", "theme").alias("name"), F.col("parsed.summary").alias("summary"), "n_lines", "error")

    def again(answers: DataFrame, budget: int) -> DataFrame:
        rows = answers.withColumns({"description": F.col("summary"), "quote": F.lit("")})
        return _lines(rows, by, "batch", fill(line, **cells), budget, F.col("n_lines"))

    return _until_one(_lines(linked, by, "code_id", fill(line, **cells), budget), by, ask, again, budget, "summary")


def write_report(
    themes: DataFrame, quotes: DataFrame, model_fn: ModelFn, instruction: str, budget: int = 100_000, template: str = LIST_PROMPT, line: str = THEME_LINE
) -> DataFrame:
    """One narrative per run from its themes (``run, theme, theme_index, summary``) and top quotes; runs whose themes do not
    fit one prompt are written in parts, and the parts are written up again."""
    cited = quotes.groupBy("run", "theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "quote"))), lambda s: s["quote"]).alias("q"))
    rows = themes.join(cited, ["run", "theme"], "left").withColumn("quotes", F.array_join(F.transform("q", lambda x: F.concat(F.lit("> "), x)), "\n"))
    cells = {c: F.col(c) for c in ("theme", "summary", "quotes")}

    def ask(lists: DataFrame) -> DataFrame:
        called = call_model(lists, fill(template, instruction=F.lit(instruction), lines=F.col("lines")), model_fn)
        return called.select("run", "batch", F.col("n_lines").alias("n_themes"), strip("reply").alias("report_text"), "error")

    def again(answers: DataFrame, budget: int) -> DataFrame:
        parts = answers.withColumns({"theme": F.lit(""), "summary": F.col("report_text"), "quotes": F.lit("")})
        return _lines(parts, ["run"], "batch", fill(line, **cells), budget, F.col("n_themes"))

    return _until_one(_lines(rows, ["run"], "theme_index", fill(line, **cells), budget), ["run"], ask, again, budget, "report_text")


# -- deductive coding --------------------------------------------------------------------------


EVIDENCE_PROMPT = "{instruction}\n{focus}\nLook for: {construct}\n{definition}\n{indicators}\n{content}"
GOAL_PROMPT = "{instruction}\n{title}\n{lo_index}. {lo_text}\n{indicators}\n{content}"
RUBRIC_PROMPT = "{instruction}\n{module_id} {question_id}\n{text}"
RATING_PROMPT = "{instruction}\n{step} {model} {repeat_no}\n{text}\n{key}"


def extract_evidence(
    transcripts: DataFrame, codebook: Sequence[dict], model_fn: ModelFn, instruction: str, focus: str = "", model: str = "model", template: str = EVIDENCE_PROMPT
) -> DataFrame:
    """Transcript x construct -> evidence counts by valence, the instances (quote, valence), matched indicators, and what a
    later audit needs: model, prompt, reply, tokens.

    ``codebook`` entries: name, group, definition, indicators. The book is configuration and unfolds
    from a literal array on each row; the whole text goes into the prompt and the matching.
    """
    entries = F.array(*[
        F.struct(
            F.lit(c["name"]).alias("construct_name"), F.lit(c["group"]).alias("construct_group"), F.lit(c["definition"]).alias("definition"),
            F.array(*[F.lit(i) for i in c["indicators"]]).alias("indicators"),
        )
        for c in codebook
    ])
    text = strip("content")
    units = transcripts.filter(text != "").select("participant_id", text.alias("content"), F.explode(entries).alias("k")).select("participant_id", "content", "k.*")
    prompt = fill(
        template, instruction=F.lit(instruction), focus=F.lit(focus), construct=F.initcap(F.translate("construct_name", "_", " ")), definition=F.col("definition"),
        indicators=F.array_join("indicators", "; "), content=F.col("content"),
    )
    p = _parsed(call_model(units, prompt, model_fn), EVIDENCE_SCHEMA)
    inst = F.coalesce("parsed.instances", F.array().cast("array<struct<quote:string,valence:string>>"))
    n = lambda v: F.size(F.filter(inst, lambda i: i["valence"] == v))
    ok = F.col("error").isNull()
    return p.select(
        "participant_id", "construct_name", "construct_group",
        F.when(ok, F.coalesce("parsed.evidence_count", F.size(inst))).otherwise(0).alias("evidence_count"),
        *[F.when(ok, n(v)).otherwise(0).alias(f"valence_{v}") for v in ("positive", "negative", "neutral")],
        F.when(ok, matched_indicators(F.col("content"), F.transform(inst, lambda i: F.coalesce(i["quote"], F.lit(""))), F.col("indicators"))).alias("matched_indicators"),
        F.when(ok, inst).alias("instances"), F.lit(model).alias("model"), "prompt", "reply", "tokens_used", "error",
    )


def objective_evidence(transcripts: DataFrame, objectives: DataFrame, model_fn: ModelFn, instruction: str, template: str = GOAL_PROMPT) -> DataFrame:
    """Transcript x objective of its module -> 0/1 and a quote.

    ``objectives``: module_id, title, objectives array, and optionally indicators, an array of texts per objective. Transcripts without a module number or text,
    or of a module without objectives, have no rows.
    """
    module = reflection_module(F.col("module_id"))
    t = transcripts.filter((strip("content") != "") & module.rlike(r"^module_\d+$")).select("participant_id", module.alias("module_id"), strip("content").alias("content"))
    signs = F.col("indicators") if "indicators" in objectives.columns else F.array().cast("array<array<string>>")
    listed = objectives.select("module_id", "title", signs.alias("_signs"), F.posexplode("objectives").alias("_i", "lo_text"))
    units = t.join(listed.withColumn("indicators", F.coalesce(F.array_join(F.get("_signs", F.col("_i")), "; "), F.lit(""))), "module_id")
    units = units.withColumn("lo_index", F.col("_i") + 1).drop("_i", "_signs")
    prompt = fill(template, instruction=F.lit(instruction), **{c: F.col(c) for c in ("title", "lo_index", "lo_text", "indicators", "content")})
    p = _parsed(call_model(units, prompt, model_fn), "struct<evidence_present:int, evidence_quote:string>")
    return p.select(
        "participant_id", "module_id", "lo_index", "lo_text", F.coalesce("parsed.evidence_present", F.lit(0)).alias("evidence_present"),
        F.coalesce("parsed.evidence_quote", F.lit("")).alias("evidence_quote"), "error",
    )


def score_rubric(reflections: DataFrame, model_fn: ModelFn, instruction: str, dimensions: Sequence[str], template: str = RUBRIC_PROMPT) -> DataFrame:
    """Reflection -> clamped dimension scores, their share of the maximum, and the justification.

    A blank reflection is not sent to the model; it stays as a row with the error ``blank text``.
    """
    rows = reflections.select("user_id", "module_id", "question_id", "text")
    prompt = fill(template, instruction=F.lit(instruction), **{c: F.col(c) for c in ("module_id", "question_id", "text")})
    empty = F.coalesce(strip("text"), F.lit("")) == ""
    called = call_model(rows.filter(~empty), prompt, model_fn)
    none = F.lit(None).cast("string")
    called = called.unionByName(rows.filter(empty).withColumns({"prompt": none, "reply": none, "error": F.lit("blank text"), "tokens_used": F.lit(0).cast("bigint")}))
    clean = called.withColumn("_j", reply_json(F.col("reply")))
    error = F.when(F.col("error").isNull() & F.col("_j").isNull(), "no JSON object in reply").otherwise(F.col("error"))
    scores = rubric_scores(F.col("_j"), dimensions)
    total = F.aggregate(scores, F.lit(0), lambda acc, s: acc + s["score"])
    return clean.select(
        F.col("user_id").alias("participant_id"), "module_id", "question_id", scores.alias("scores"),
        F.when(error.isNull(), F.round(total / (4.0 * len(dimensions)), 4)).otherwise(F.lit(0.0)).alias("cpi_qual_q"),
        rubric_justification(F.col("_j")).alias("justification"), "tokens_used", error.alias("error"),
    )


def rubric_long(scored: DataFrame, max_score: int = 4) -> DataFrame:
    """Rubric results in long form, one row per dimension, as the rubric index takes them; rows with an error have none."""
    rows = scored.filter(F.col("error").isNull()).select("participant_id", "module_id", "question_id", F.explode("scores").alias("s"))
    return rows.select("participant_id", "module_id", "question_id", F.col("s.dimension").alias("dimension"), F.col("s.score").alias("score"), F.lit(max_score).alias("max_score"))


RATING_TYPES = {"bloom_level": "integer", "solved_answer": "string", "key_defensible": "string", "needs_figure": "boolean"}


def call_checked(df: DataFrame, prompt: Column, model_fn: ModelFn, faults: Callable[[Column], Column]) -> DataFrame:
    """``call_model``; rows whose reply has faults are asked once more, with the faults below the prompt.

    Adds ``json`` and ``faults`` (of the last reply); tokens of both calls are added up.
    """

    def judged(called: DataFrame) -> DataFrame:
        return called.withColumn("json", reply_json(F.col("reply"))).withColumn("faults", F.when(F.col("error").isNull(), F.coalesce(faults(F.col("json")), F.array(F.lit("no_object")))))

    # a reply is judged once: as a view, the check would run again for the filter and for each of the two uses
    first = materialize(judged(call_model(df, prompt, model_fn)), "judged")
    bad = F.coalesce(F.size("faults"), F.lit(0)) > 0
    asked = first.filter(bad).withColumn("_before", F.col("tokens_used")).withColumn("_prompt", F.concat("prompt", F.lit("\n"), F.array_join("faults", "; ")))
    again = judged(call_model(asked.drop("prompt", "reply", "error", "tokens_used", "json", "faults"), F.col("_prompt"), model_fn))
    again = again.withColumn("tokens_used", F.col("tokens_used") + F.col("_before")).drop("_prompt", "_before")
    return first.filter(~bad).unionByName(again)


def rate_items(
    items: DataFrame, model_fn: ModelFn, instruction: str, models: Sequence[str], repeats: int = 1, steps: Sequence[str] = ("blind", "key"),
    run_id: str = "run", provider: str = "provider", created_at: str | None = None, template: str = RATING_PROMPT,
) -> DataFrame:
    """Items x model x step x repeat (blind step only, 1..5 repeats) -> validated ratings.

    A reply is checked against the rating's schema and asked for once more when it fails. The rows are what
    ``latest_suggestion``, ``latest_key_review`` and ``rating_run_rollup`` take.
    """
    repeats = max(1, min(int(repeats), 5))
    fan = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(s).alias("step"), F.lit(r).alias("repeat_no"))
        for m in models for s in steps for r in range(repeats if s == "blind" else 1)
    ])
    names = ["instrument_key", "question_id", "item_hash", "model", "step", "repeat_no"]
    units = items.select(*names[:3], "text", "key", F.explode(fan).alias("f")).select(*names[:3], "text", "key", "f.*")
    shown = F.when(F.col("step") == "key", F.col("key"))
    prompt = fill(template, instruction=F.lit(instruction), key=shown, **{c: F.col(c) for c in ("step", "model", "repeat_no", "text")})
    asked = spread(units.filter((F.col("step") == "blind") | F.col("key").isNotNull()), *names)

    def faults(reply: Column) -> Column:
        blind = schema_errors(reply, ["bloom_level"], RATING_TYPES, {"bloom_level": ["1", "2", "3", "4", "5", "6"]})
        return F.when(F.col("step") == "blind", blind).otherwise(schema_errors(reply, ["key_defensible"], RATING_TYPES))

    p = call_checked(asked, prompt, model_fn, faults)
    p = p.withColumn("parsed", F.from_json("json", "struct<bloom_level:int, solved_answer:string, key_defensible:string, needs_figure:boolean>"))
    error = F.when(F.col("error").isNull() & (F.size("faults") > 0), F.array_join("faults", "; ")).otherwise(F.col("error"))
    solved, level = F.col("parsed.solved_answer"), F.col("parsed.bloom_level")
    rated = p.select(
        *names, error.isNull().alias("ok"), F.when(level.between(1, 6), level).alias("bloom_level"),
        F.when(F.col("key").isNotNull() & (solved != "unsure"), strip(solved) == strip("key")).alias("blind_matches_key"),
        F.col("parsed.key_defensible").alias("key_defensible"), F.coalesce("parsed.needs_figure", F.lit(False)).alias("needs_figure"), "tokens_used",
        token_estimate(F.col("prompt")).alias("tokens_in"), F.coalesce(token_estimate(F.col("reply")), F.lit(0)).alias("tokens_out"), error.alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("bigint")
    unkeyed = units.filter((F.col("step") == "key") & F.col("key").isNull()).select(
        *names, F.lit(False).alias("ok"), none("int").alias("bloom_level"), none("boolean").alias("blind_matches_key"), none("string").alias("key_defensible"),
        F.lit(False).alias("needs_figure"), zero.alias("tokens_used"), zero.cast("int").alias("tokens_in"), zero.cast("int").alias("tokens_out"), F.lit("no key").alias("error"))
    when = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    return rated.unionByName(unkeyed).select(
        F.lit(run_id).alias("run_id"), F.lit(provider).alias("provider"), when.alias("created_at"), F.xxhash64(*names).alias("id"), "*"
    )


def summarize_corpus(texts: DataFrame, n: int, model_fn: ModelFn, instruction: str, stored: DataFrame | None = None, by: str = "cohort_id", order: str = "doc_order", text: str = "content") -> DataFrame:
    """One summary per group from its first n texts; a stored result for the same texts is reused.

    ``n`` is the caller's run mode. The first n are picked slice-wise, so a group holding a third of
    the corpus is never sorted whole.
    """
    from pyspark.sql import Window as W

    from .ratings import content_hash

    sliced = texts.withColumn("_s", F.pmod(F.xxhash64(order), F.lit(64)))
    few = sliced.withColumn("_r", F.row_number().over(W.partitionBy(by, "_s").orderBy(order))).filter(F.col("_r") <= n)
    picked = few.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("_r") <= n)
    hashes = content_hash(picked, text, [by])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("t")))), lambda s: F.concat(F.lit("("), s["_r"].cast("string"), F.lit(") "), s["t"])), "\n\n")
    jobs = picked.groupBy(by).agg(body.alias("body")).join(hashes, by)
    if stored is not None:
        known = stored.select("content_hash", F.col("summary").alias("_old")).dropDuplicates(["content_hash"])
        hit = jobs.join(known, "content_hash").select(by, "n_texts", "content_hash", F.col("_old").alias("summary"), F.lit(True).alias("from_cache"), F.lit(None).cast("string").alias("error"))
        jobs = jobs.join(known, "content_hash", "left_anti")
    called = call_model(jobs, F.concat_ws("\n", F.lit(instruction), F.col("body")), model_fn)
    fresh = called.select(by, "n_texts", "content_hash", F.col("reply").alias("summary"), F.lit(False).alias("from_cache"), "error")
    return fresh if stored is None else fresh.unionByName(hit)
