"""Reading JSON out of model replies."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import strip
from pyspark.sql import types as T

_PART = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
_PARTNER = {"}": "{", "]": "["}


def _closers(text: str) -> str:
    """What a cut-off JSON text lacks at its end: a quote for an open string, then brackets, innermost first."""
    depth: list[str] = []
    quote = ""
    for part in _PART.findall(text):
        if part[0] == '"':
            quote = "" if len(part) > 1 and part[-1] == '"' else '"'
        elif part in _PARTNER:
            if depth and depth[-1] == _PARTNER[part]:
                depth.pop()
        else:
            depth.append(part)
    return quote + "".join("}" if x == "{" else "]" for x in reversed(depth))


def repair_json(text: str | None) -> str | None:
    """The JSON object in a reply as a JSON string: chatter around it off, a cut-off tail closed.

    Line breaks are blanks: between tokens they mean nothing, inside strings JSON does not allow them.
    """
    flat = (text or "").replace("\r", " ").replace("\n", " ")
    body = flat[flat.find("{") :] if "{" in flat else ""
    if not body:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(body)
        return json.dumps(found, ensure_ascii=False)
    except json.JSONDecodeError:
        pass
    cut = body.replace("```", " ").rstrip().removesuffix(",")
    try:
        return json.dumps(json.loads(cut + _closers(cut)), ensure_ascii=False)
    except json.JSONDecodeError:
        return None


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(repair_json)


def reply_json(reply: Column) -> Column:
    """Clean JSON text of a reply, NULL when there is none.

    Replies that already are one JSON object stay on the JVM; only the others reach Python.
    """
    bare = strip(reply)
    fine = bare.startswith("{") & F.try_parse_json(bare).isNotNull()
    return F.when(fine, bare).otherwise(_repair(F.when(~F.coalesce(fine, F.lit(False)), reply)))


def schema_errors(reply: Column, required: Sequence[str], types: dict[str, str], enums: dict[str, Sequence[str]] | None = None) -> Column:
    """Violations of a flat schema as an array of ``code:key``; empty when there are none.

    ``types`` maps key -> string | integer | boolean | array. Codes: ``missing``, ``unexpected``, ``type`` and ``value`` (outside
    ``enums``); a reply that is no object has the single entry ``no_object``.
    """
    enums = enums or {}
    shapes = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY"}
    known = F.array(*[F.lit(k) for k in types])
    tagged = lambda code, names: F.transform(names, lambda k: F.concat(F.lit(f"{code}:"), k))

    def faults(keys: Column, tree: Column) -> Column:
        found = [tagged("missing", F.array_except(F.array(*[F.lit(k) for k in required]), keys)), tagged("unexpected", F.array_except(keys, known))]
        for key, kind in types.items():
            at = f"$.{key}"
            right = F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(tree, at, "variant")), F.lit(shapes[kind])), F.lit(False))
            if key not in enums:
                good = F.lit(True)
            elif kind == "array":
                good = F.size(F.array_except(F.try_variant_get(tree, at, "array<string>"), F.array(*[F.lit(str(x)) for x in enums[key]]))) == 0
            else:
                good = F.try_variant_get(tree, at, "string").isin([str(x) for x in enums[key]])
            fault = F.when(~right, f"type:{key}").when(~F.coalesce(good, F.lit(False)), f"value:{key}")
            found.append(F.array_compact(F.array(F.when(F.array_contains(keys, key), fault))))
        return F.when(keys.isNull(), F.array(F.lit("no_object"))).otherwise(F.concat(*found))

    # bound in an array of one, so that a reply is parsed once and not once for each of its uses above
    one = F.array(F.struct(F.json_object_keys(reply).alias("keys"), F.try_parse_json(reply).alias("tree")))
    return F.get(F.transform(one, lambda r: faults(r["keys"], r["tree"])), F.lit(0))


def rubric_scores(reply: Column, dimensions: Sequence[str], low: int = 1, high: int = 4) -> Column:
    """Dimension -> score struct entries, each clamped to low..high and ``low`` when unreadable."""
    v = F.try_parse_json(reply)
    entries = []
    for d in dimensions:
        raw = F.try_variant_get(v, f"$.scores.{d}", "double")
        value = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(raw.cast("int"), F.lit(low))))
        entries.append(F.struct(F.lit(d).alias("dimension"), value.alias("score")))
    return F.array(*entries)


def rubric_justification(reply: Column, limit: int = 500) -> Column:
    return F.substring(F.coalesce(F.get_json_object(reply, "$.justification"), F.lit("")), 1, limit)
