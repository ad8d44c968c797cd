"""From questions to typed, cited, validated answers.

Routing, retrieval and planning run over all questions as DataFrames; a generator (any callable that turns a question
and its constraints into SQL) is then asked question by question, its statements are checked, repaired at most twice,
run under the guard, typed and validated. What can't be answered goes to review, with the reason.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import answers, constraints, retrieval
from lodestone.plans import sql as sqls
from lodestone.plans.parsed import operands
from lodestone.sources import corpus, tables

MAX_REPAIRS = 2
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@dataclass
class Step:
    """What a generator is told."""

    question: str
    hint: str
    constraints: str
    attempt: int = 0
    feedback: str = ""


@dataclass
class Record:
    """An answer, or why there is none; figures are what the confidence rubric counts."""

    qid: str
    status: str = "needs_review"
    final_answer: object = None
    sql: str = ""
    tables: list[str] = field(default_factory=list)
    expected: list[str] = field(default_factory=list)
    chunks: list[str] = field(default_factory=list)
    repairs: int = 0
    n_rows: int = 0
    review: str | None = None
    choices: list[tuple[str, str]] = field(default_factory=list)
    figures: dict[str, int] = field(default_factory=dict)
    events: list[dict] = field(default_factory=list)


Generator = Callable[[Step], str]


def template_generator(step: Step) -> str:
    """Statements for the registered questions from their constraints: formulas and windows come from documents."""
    lines = dict(x.split(": ", 1) for x in step.constraints.split("\n") if ": " in x)
    q = step.question.lower()
    revenue = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"
    where = ""
    if "DATE WINDOW" in lines:
        start, end = lines["DATE WINDOW"].split()[-3], lines["DATE WINDOW"].split()[-1]
        where = f" WHERE date(o_orderdate) BETWEEN DATE'{start}' AND DATE'{end}'"
    joined = "lineitem JOIN orders ON l_orderkey = o_orderkey"
    if "order value" in q:
        return f"SELECT {revenue} / COUNT(DISTINCT o_orderkey) AS aov FROM {joined}{where}"
    if "how many orders" in q:
        return "SELECT COUNT(*) AS n FROM orders;"
    if "suppliers by revenue" in q:
        return f"```sql\nSELECT s_name AS supplier, {revenue} AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey ORDER BY revenue DESC, s_suppkey LIMIT 3\n```"
    if "revenue" in q:
        members = lines["REPORTING GROUP"].split(" = ")[1].split(", ") if "REPORTING GROUP" in lines else []
        group = "lower(p_type) IN (" + ", ".join(f"'{m.lower()}'" for m in members) + ")" if members else ""
        return f"SELECT {revenue} AS revenue FROM {joined} JOIN part ON l_partkey = p_partkey" + (where + " AND " + group if where and group else where or group and " WHERE " + group)
    return "SELECT NULL AS unknown"


def planned(spark: SparkSession, questions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, retrieved) of all questions."""
    chunks = retrieval.sanitized(corpus.chunks(docs))
    columns = {n: spark.table(n).columns for n in TABLES}
    return constraints.plans(chunks, questions, docs, columns), retrieval.retrieve(chunks, questions)


def _from_documents(record: Record, plan: dict, hint: str) -> None:
    """The upper end of the range that a policy states for a subject of the question."""
    facts = [f for f in plan.get("facts") or [] if f["high"] is not None]
    if len({f["high"] for f in facts}) != 1 or not answers.fits(facts[0]["high"], hint):
        record.review = "documents disagree" if len({f["high"] for f in facts}) > 1 else "documents don't answer this"
        return
    record.status, record.final_answer, record.chunks, record.n_rows = "answered", facts[0]["high"], sorted({f["chunk_id"] for f in facts}), len(facts)
    record.figures["rag"] = 1


def answer(guard: sqls.Guarded, generator: Generator, plan: dict, hint: str, labels: dict[str, str] | None = None) -> Record:
    """One question's record; plan is its row of planned(); labels are those of tables.label_profile that collide, with their keys.

    A statement is repaired only where Spark refuses it; labels become keys and inclusive dates become days before it runs.
    """
    record, told = Record(plan["qid"]), lambda step, **kw: record.events.append({"qid": plan["qid"], "step": step, "attempt": record.repairs, "outputs": kw})
    told("plan", route=plan["route"], blocker=plan["blocker"])
    if plan["blocker"]:
        record.review = plan["blocker"]
        return record
    if plan["route"] == "rag":
        _from_documents(record, plan, hint)
        told("read", found=record.final_answer)
        return record
    spark, feedback = guard.spark, ""
    names = [*TABLES, *(c for t in TABLES for c in spark.table(t).columns)]
    while True:
        raw = sqls.compatible(sqls.clean_sql(generator(Step(plan["question"], hint, plan["constraints"], record.repairs, feedback))), names)
        statement, notes = sqls.repaired(spark, raw)
        problem = sqls.verdict(spark, statement)
        if not problem:
            for rewrite in (lambda s: sqls.by_key(spark, s, labels or {}), lambda s: sqls.grain_safe(spark, s)):
                statement, more = rewrite(statement)
                notes += more
            problem = sqls.static_error(spark, statement)
        if not problem:
            statement, more = sqls.whole_days(spark, statement)
            notes += more
        result = sqls.Result(error=problem) if problem else guard.execute(statement)
        told("execute", sql=statement, error=result.error, rows=len(result.rows), notes=notes)
        problem = result.error or ("no rows" if not result.rows else "truncated" if result.truncated else None)
        if not problem:
            value = shaped(result, hint)
            problem = None if answers.fits(value, hint) else f"not a {hint}"
        if not problem:
            record.status, record.final_answer, record.sql, record.n_rows = "answered", value, statement, len(result.rows)
            record.tables, record.chunks = sqls.footprint(spark, statement), list(plan.get("used_chunks") or [])
            record.expected = sorted({*record.tables, *_needed(spark, plan)})
            record.choices = sqls.open_choices(spark, statement, plan["question"], plan["constraints"])
            windows = plan.get("windows") or []
            record.figures = {
                "rewrites": len(notes), "repairs": record.repairs, "resolved_conflict": sum(bool(w["conflict"]) for w in windows), "precedence": sum(w["status"] == "revision claims precedence" for w in windows),
                "open_choices": len(record.choices), "approximated": len(plan.get("supplied") or []),
                "legacy_ambiguity": int(len({f["label"] for f in plan.get("formulas") or []}) > 1),
            }
            return record
        if record.repairs == MAX_REPAIRS:
            record.review = problem
            return record
        record.repairs += 1
        feedback = problem


def _needed(spark: SparkSession, plan: dict) -> set[str]:
    """The tables whose columns a plan's formulas need: those that alone have an operand."""
    owners: dict[str, set[str]] = {}
    for t in TABLES:
        for c in spark.table(t).columns:
            owners.setdefault(c.lower(), set()).add(t)
    named = {n.lower() for f in plan.get("formulas") or [] for n in operands(spark, f["expression"]) or []}
    return {next(iter(owners[n])) for n in named if len(owners.get(n, ())) == 1}


def shaped(result: sqls.Result, hint: str):
    """A result's rows as a value of the hint's type, by position; floats with two decimals."""
    cell = lambda v: round(float(v), 2) if not isinstance(v, (int, str, type(None))) else v
    hint = hint.replace(" ", "")
    if hint.startswith(("{", "list[{")):
        names = re.findall(r"(\w+):", hint)
        rows = [dict(zip(names, map(cell, r), strict=False)) for r in result.rows]
        return rows if hint.startswith("list") else rows[0]
    return [cell(r[0]) for r in result.rows] if hint.startswith("list") else cell(result.rows[0][0])


#: Format hints of the registered questions.
HINTS = {"q1": "float", "q2": "float", "q3": "{customer:str,margin:float}", "q4": "int", "q5": "int", "q6": "list[{supplier:str,revenue:float}]"}
#: Label columns that may collide, with their tables and keys.
LABELS = [("customer", "c_name", "c_custkey"), ("supplier", "s_name", "s_suppkey"), ("part", "p_name", "p_partkey")]


def packet(plan: dict, record: Record) -> dict[str, str]:
    """What a reviewer is shown of a question that wasn't answered, in fewer than 150 words."""
    windows = [f"{w['name']} {w['start_date']} to {w['end_date'] or 'unresolved'}" for w in plan.get("windows") or []]
    formulas = [f"{f['name']} = {f['expression']}" for f in plan.get("formulas") or []]
    executed = [e["outputs"] for e in record.events if e["step"] == "execute"]
    return answers.fitted_packet({
        "question": plan["question"],
        "understood": "; ".join([f"route {plan['route']}", *windows, *formulas]),
        "blocker": record.review or "",
        "considered": "; ".join(f"{x['sql']} ({x['error'] or str(x['rows']) + ' rows'})" for x in executed) or "no statement was run",
        "decision": "say which end of the window holds" if "conflict" in (record.review or "") else "say what stands for the missing field" if "no column" in (record.review or "") else "answer by hand or ask again",
    })


def run(spark: SparkSession, folder: str, generator: Generator = template_generator, hints: dict[str, str] = HINTS, second: Callable[[Step], str] | None = None) -> DataFrame:
    """(qid, route, status, answer, tables, chunks, confidence, repairs, assumptions, review) of the registered questions.

    A batch of questions is small by nature: plans come to the driver, statements run as Spark jobs. Validation and the
    confidence rubric then run over all records as DataFrames; an answer that fails a check goes to review: one of another
    type, from a statement that leaves out a table that the plan's formulas need, with a chunk that neither retrieval nor the plan
    had, or with a number from no rows. second, if given, is asked for an answer of its own, which lowers the confidence where it differs.
    """
    tables.register(spark, folder, TABLES)
    docs, questions = corpus.documents(spark), corpus.questions(spark)
    plans, hits = planned(spark, questions, docs)
    seen = {r["qid"]: r["chunks"] for r in hits.groupBy("qid").agg(F.collect_set("chunk_id").alias("chunks")).collect()}
    profile = tables.label_profile(spark, folder, [(t, c) for t, c, _ in LABELS]).filter("collides").collect()
    labels = {c: k for t, c, k in LABELS if f"{t}.{c}" in {r["label"] for r in profile}}
    guard, records, rows = sqls.Guarded(spark, timeout_s=60), [], []
    for p in plans.orderBy("qid").collect():
        plan = p.asDict(recursive=True)
        try:
            r = answer(guard, generator, plan, hints[p["qid"]], labels)
        except Exception as e:  # one question's crash is its own review
            r = Record(p["qid"], review=f"crash: {type(e).__name__}")
        if second and r.status == "answered":
            same = answers.agree(json.dumps(r.final_answer), second(Step(plan["question"], hints[p["qid"]], plan["constraints"], r.repairs, "")))
            r.figures |= {"no_opinion": int(same is None), "disagrees": int(same is False)}
        records.append((plan, r))
        about = [f"{c} and not {others}" for c, others in r.choices] + [f"{x['field']} as {x['expression']}" for x in plan["supplied"] or []]
        shown = sorted({*seen.get(r.qid, []), *plan["used_chunks"], *(f["chunk_id"] for f in plan["facts"] or [])})  # by retrieval, or in the plan
        numeric = isinstance(r.final_answer, (int, float))
        rows.append((
            r.qid, p["route"], r.status, None if r.final_answer is None else json.dumps(r.final_answer, sort_keys=True), r.tables, r.expected, r.chunks, shown, r.repairs, r.n_rows, numeric,
            r.status != "answered" or answers.fits(r.final_answer, hints[p["qid"]]), "; ".join(about), json.dumps(packet(plan, r), sort_keys=True), r.review, *(r.figures.get(c, 0) for c in answers.CONFIDENCE), 0,
        ))
    figures = ", ".join(f"{c} int" for c in answers.CONFIDENCE)
    schema = "qid string, route string, status string, answer string, cited array<string>, expected array<string>, chunks array<string>, seen array<string>, repairs int, n_rows int, `numeric` boolean, format_ok boolean, assumptions string, packet string, review string, "
    told = spark.createDataFrame(rows, schema.replace("repairs int, ", "n_repairs int, ") + figures + ", invented int")
    done = told.join(answers.failures(told), "qid").join(answers.confidence(told), "qid")
    passed = (F.col("status") == "answered") & (F.col("failed") == "")
    return done.select(
        "qid", "route", F.when(passed, "answered").otherwise("needs_review").alias("status"), F.when(passed, F.col("answer")).alias("answer"), F.col("cited").alias("tables"), "chunks", F.when(passed, F.col("confidence")).alias("confidence"),
        F.col("n_repairs").alias("repairs"), "assumptions", F.when(passed, F.lit(None)).otherwise(F.coalesce("review", F.concat(F.lit("failed: "), "failed"))).alias("review"), F.when(~passed, F.col("packet")).alias("packet"),
    )
