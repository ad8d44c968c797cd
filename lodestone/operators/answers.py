"""Typed answers: format hints, coercion, validation, confidence, agreement, review packets."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALARS = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType()}


def hint_schema(hint: str) -> T.DataType:
    """The type that a format hint names: int, float, str, {f:t, ...} or list[{f:t, ...}]."""
    hint = hint.replace(" ", "")
    if hint in _SCALARS:
        return _SCALARS[hint]
    if m := re.fullmatch(r"list\[(.+)\]", hint):
        return T.ArrayType(hint_schema(m[1]))
    if m := re.fullmatch(r"\{(\w+:\w+(?:,\w+:\w+)*)\}", hint):
        return T.StructType([T.StructField(k, _SCALARS[t]) for k, t in (x.split(":") for x in m[1].split(","))])
    raise ValueError(f"unknown format hint: {hint}")


def fits(value, hint: str) -> bool:
    """Whether a value has exactly the hint's keys and types; an integer serves as a float, a boolean as neither."""

    def ok(v, t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return isinstance(v, list) and all(ok(x, t.elementType) for x in v)
        if isinstance(t, T.StructType):
            return isinstance(v, dict) and list(sorted(v)) == sorted(t.names) and all(ok(v[f.name], f.dataType) for f in t)
        if isinstance(v, bool):
            return False
        return isinstance(v, {T.LongType: int, T.DoubleType: (int, float), T.StringType: str}[type(t)])

    return ok(value, hint_schema(hint))


def coerced(text: Column, kind: str) -> Column:
    """A text as int, float (two decimals) or str; null where it isn't one. Commas between groups of three digits separate thousands."""
    if kind == "str":
        return text
    number = F.regexp_extract(text, r"(-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|-?[0-9]+(?:[.,][0-9]+)?)", 1)
    plain = F.when(number.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), F.regexp_replace(number, ",", "")).otherwise(F.regexp_replace(number, ",", "."))
    exact = plain.try_cast("decimal(28,8)")
    return F.round(exact, 2).cast("double") if kind == "float" else F.when(F.abs(exact - F.round(exact, 0)) <= 1e-9, exact.cast("long"))


def built(df: DataFrame, hint: str, order: list[Column]) -> DataFrame:
    """The first row, or all rows in order, of a result as one JSON text (column answer) of the hint's type, columns by position.

    A result that is an answer is small: the caller's limit bounds it.
    """
    t = hint_schema(hint)
    fields = t.elementType if isinstance(t, T.ArrayType) else t
    names = fields.names if isinstance(fields, T.StructType) else ["value"]
    types = [f.dataType for f in fields] if isinstance(fields, T.StructType) else [fields]

    def value(column: str, kind: T.DataType) -> Column:
        c = F.col(f"`{column}`")
        return F.round(c.cast("decimal(28,8)"), 2).cast("decimal(28,2)") if isinstance(kind, T.DoubleType) else c.cast(kind)

    record = F.struct(*(value(c, k).alias(n) for c, n, k in zip(df.columns, names, types)))
    rows = df.select(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("o"), record.alias("r"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"])
    one = rows.agg(every.alias("all"))
    if isinstance(t, T.ArrayType):
        return one.select(F.to_json("all").alias("answer"))
    if isinstance(t, T.StructType):
        return one.select(F.to_json(F.get("all", F.lit(0))).alias("answer"))
    return one.select(F.get("all", F.lit(0))["value"].cast("string").alias("answer"))


def failures(records: DataFrame) -> DataFrame:
    """records (qid, format_ok, cited, expected, chunks, seen, numeric, n_rows) -> (qid, failed): the names of failed checks."""
    missing, extra = F.array_except("expected", "cited"), F.array_except("cited", "expected")
    checks = {
        "format": ~F.col("format_ok"),
        "tables": (F.size(missing) > 0) | (F.size(extra) > 0),
        "chunks": F.size(F.array_except("chunks", "seen")) > 0,
        "rows": F.col("numeric") & (F.col("n_rows") == 0),
    }
    return records.select("qid", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items()))), ",").alias("failed"))


#: What each circumstance takes from a confidence of 0.75.
CONFIDENCE = {"rewrites": 0.05, "rag": 0.10, "repairs": 0.12, "no_rows": 0.30, "resolved_conflict": 0.05, "precedence": 0.05, "legacy_ambiguity": 0.10, "fallback": 0.05, "baseline": 0.05, "open_choices": 0.10, "disagrees": 0.15, "no_opinion": 0.03, "approximated": 0.10}


def confidence(records: DataFrame) -> DataFrame:
    """records (qid, one count or 0/1 flag per circumstance, invented) -> (qid, confidence), between 0.05 and 0.99."""
    cents = F.lit(75)
    for name, cost in CONFIDENCE.items():
        cents = cents - F.col(name) * round(cost * 100)
    cents = F.when(F.col("open_choices") > 0, F.least(cents, F.lit(75))).otherwise(cents)
    cents = F.when(F.col("invented") > 0, F.least(cents, F.lit(60))).otherwise(cents)
    return records.select("qid", (F.least(F.greatest(cents, F.lit(5)), F.lit(99)) / 100).alias("confidence"))


#: How far numbers of two answers may be apart: a cent, and what rounding adds.
APART = 0.011


def read_answer(text: str):
    """A text as JSON or, where it is none, as a Python literal; ValueError where it is neither."""
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        try:
            return ast.literal_eval((text or "").strip())
        except (SyntaxError, TypeError, MemoryError, RecursionError) as e:
            raise ValueError("no answer") from e


def _alike(x, y) -> bool:
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if number(x) and number(y):
        return abs(x - y) <= APART
    if isinstance(x, dict) and isinstance(y, dict):
        return x.keys() == y.keys() and all(_alike(x[k], y[k]) for k in x)
    if isinstance(x, (list, tuple)) and isinstance(y, (list, tuple)):
        return len(x) == len(y) and all(map(_alike, x, y))
    if isinstance(x, str) and isinstance(y, str):
        return x.split() == y.split()
    return type(x) is type(y) and x == y


def agree(a: str, b: str) -> bool | None:
    """Whether two answers say the same, numbers within APART at any depth; None where either can't be read."""
    try:
        return _alike(read_answer(a), read_answer(b))
    except ValueError:
        return None


def record_errors(record: dict) -> list[str]:
    """What an output record lacks: answered means an answer, a confidence in [0, 1] and no packet; at most two repairs."""
    answered = record.get("status") == "answered"
    found = []
    if answered != (record.get("final_answer") is not None):
        found.append("answer")
    if answered and not 0 <= (record.get("confidence") if record.get("confidence") is not None else -1) <= 1:
        found.append("confidence")
    if answered == (record.get("review") is not None):
        found.append("review")
    if record.get("repairs") not in (0, 1, 2):
        found.append("repairs")
    return found


def fitted_packet(packet: dict[str, str], words: int = 150) -> dict[str, str]:
    """A review packet of fewer than so many words: considered, blocker and understood give way in this order, the question and the decision never."""
    packet = dict(packet)
    count = lambda: sum(len(v.split()) for v in packet.values())
    for part in ("considered", "blocker", "understood"):
        over = count() - (words - 1)
        if over > 0 and part in packet:
            kept = packet[part].split()
            packet[part] = " ".join(kept[: max(0, len(kept) - over)])
    return packet
