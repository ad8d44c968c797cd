"""Spark's own trees of a statement, as parsed and as analysed: which nodes, names and functions they have, where in the
text they stand, and which column of which table an expression comes from.

The only module that reaches for the session's JVM objects; nothing here parses.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from py4j.java_gateway import JavaObject
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# Classes of Spark whose objects hold neither plans nor expressions; nodes that stand for stored data; set operations.
_PLAIN = ("org.apache.spark.sql.types.", "org.apache.spark.unsafe.types.", "org.apache.spark.sql.util.CaseInsensitiveStringMap", "org.apache.spark.sql.catalyst.trees.Origin", "java.util.UUID", "java.math.", "scala.math.", "scala.Enumeration")
_STORED = frozenset("View LocalRelation LogicalRelation LogicalRDD InMemoryRelation HiveTableRelation DataSourceV2Relation".split())
_SETS = frozenset("Union Intersect Except".split())


class Unreadable(ValueError):
    """A node has a part of a class that isn't known to be harmless."""


@dataclass
class _Classes:
    """Spark's and Scala's classes by which parts are told apart."""

    tree: JavaObject
    plan: JavaObject
    many: JavaObject
    record: JavaObject


def _classes(spark: SparkSession) -> _Classes:
    jvm = spark._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    names = ("org.apache.spark.sql.catalyst.trees.TreeNode", "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", "scala.collection.Iterable", "scala.Product")
    return _Classes(*(jvm.java.lang.Class.forName(n, False, loader) for n in names))


@dataclass
class Node:
    """A node of a plan or an expression."""

    java: object
    classes: _Classes
    above: tuple[Node, ...] = ()

    @cached_property
    def is_plan(self) -> bool:
        return self.classes.plan.isInstance(self.java)

    @cached_property
    def kind(self) -> str:
        return self.java.getClass().getSimpleName()

    @property
    def names(self) -> list[str]:
        """The parts of a function's, column's or table's name."""
        kind = self.kind
        if kind in ("UnresolvedFunction", "UnresolvedAttribute"):
            return _list(self.java.nameParts())
        if kind == "UnresolvedRelation":
            return _list(self.java.multipartIdentifier())
        if kind == "UnresolvedTableValuedFunction":
            return _list(self.java.name())
        if kind == "UnresolvedGenerator":
            return [self.java.name().funcName()]
        return []

    @cached_property
    def span(self) -> tuple[int, int] | None:
        """Where it begins and ends in the statement."""
        o = self.java.origin()
        return (o.startIndex().get(), o.stopIndex().get() + 1) if o.startIndex().isDefined() and o.stopIndex().isDefined() else None

    def parts(self) -> Iterator[Node]:
        """Every plan and expression that this node holds in whatever field: children, subqueries, the queries that WITH
        binds, named windows, rows of VALUES, parameters of hints. Of stored data only what a view reads."""
        mine = (*self.above, self)
        held = _list(self.java.children()) if self.kind in _STORED else _each(self.java.productIterator())
        yield from (Node(x, self.classes, mine) for value in held for x in self._inside(value))

    def _inside(self, value) -> Iterator[object]:
        """The trees in a field's value, however collections, maps, options and records hold them."""
        if not isinstance(value, JavaObject):
            return  # a text, a number, nothing
        if self.classes.tree.isInstance(value):
            yield value
        elif self.classes.many.isInstance(value) or self.classes.record.isInstance(value):
            inside = value.iterator() if self.classes.many.isInstance(value) else value.productIterator()
            for x in _each(inside):
                yield from self._inside(x)
        elif not value.getClass().getName().startswith(_PLAIN):
            raise Unreadable(value.getClass().getName())

    def all(self) -> Iterator[Node]:
        """This node and all below it."""
        yield self
        for part in self.parts():
            yield from part.all()

    def child(self, i: int) -> Node:
        return Node(self.java.children().apply(i), self.classes, (*self.above, self))

    def expressions(self, field: str) -> list[Node]:
        """The expressions in one of a plan's fields."""
        return [Node(x, self.classes, (*self.above, self)) for x in _list(getattr(self.java, field)())]


def _each(iterator) -> Iterator[object]:
    while iterator.hasNext():
        yield iterator.next()


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def parsed(spark: SparkSession, sql: str) -> Node:
    """The parse tree; raises Spark's error where there is none."""
    return Node(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), _classes(spark))


def operands(spark: SparkSession, expression: str) -> list[str] | None:
    """The names of columns in an expression, each once, in order; None where Spark can't read it as one."""
    try:
        root = Node(spark._jsparkSession.sessionState().sqlParser().parseExpression(expression), _classes(spark))
        return list(dict.fromkeys(n.names[-1] for n in root.all() if n.kind == "UnresolvedAttribute"))
    except (PySparkException, Unreadable):
        return None


def parse_error(spark: SparkSession, sql: str) -> tuple[str, int] | None:
    """(condition, place in the text) of the parser's refusal, or None."""
    try:
        parsed(spark, sql)
    except PySparkException as e:
        at = re.search(r"\(line (\d+), pos (\d+)\)", str(e))
        line, pos = (int(at[1]), int(at[2])) if at else (1, len(sql))
        return e.getCondition() or type(e).__name__, sum(len(x) + 1 for x in sql.split("\n")[: line - 1]) + pos
    return None


@dataclass(frozen=True)
class Source:
    """A column of a table, at one of the places where a statement reads that table."""

    table: str
    column: str
    place: int
    type: str


@dataclass
class Step:
    """A query on the way from a column's use to its source that hands the column on, renamed or not."""

    id: int
    project: Node | None


@dataclass
class Analysed:
    """A statement's analysed plan: which tables it reads, and where its columns come from, by Spark's expression ids."""

    root: Node
    sources: dict[int, Source] = field(default_factory=dict)
    aliases: dict[int, tuple[Node, Node | None]] = field(default_factory=dict)
    bound: dict[int, tuple[int, Node]] = field(default_factory=dict)
    found: dict[tuple[str, tuple[int, int]], list[Node]] = field(default_factory=lambda: defaultdict(list))
    tables: set[str] = field(default_factory=set)

    def at(self, node: Node) -> Node | None:
        """The analysed node that a parsed one became: of its kind, at its place in the text, if it is the only one."""
        there = self.found.get((node.kind, node.span), []) if node.span else []
        return there[0] if len(there) == 1 else None

    def steps(self, expression: Node, plan: Node) -> tuple[list[Step], Source | None]:
        """The way of an expression over the output of plan back to a table's column, through aliases, subqueries and WITH,
        outermost step first; no source where something is computed or where set operations merge columns."""
        way: list[Step] = []
        while True:
            while expression.kind in ("OuterReference", "Alias"):
                expression = Node(expression.java.productElement(0), expression.classes, expression.above)
            if expression.kind != "AttributeReference":
                return way, None
            one = _id(expression.java)
            for below in _below(plan):
                if below.kind in _SETS and one in map(_id, _list(below.java.output())):
                    return way, None
                if below.kind == "Project" and any(x.kind == "AttributeReference" and _id(x.java) == one for x in below.expressions("projectList")):
                    way.append(Step(one, below))  # handed on as it is
            if one in self.sources:
                return way, self.sources[one]
            if one in self.aliases:
                expression, project = self.aliases[one]
                way.append(Step(one, project))
                if project is not None and project.java.children().size() == 1:
                    plan = project.child(0)
            elif one in self.bound:
                other, plan = self.bound[one]
                expression = next(Node(a, plan.classes, (plan,)) for a in _list(plan.java.child().output()) if _id(a) == other)
            else:
                return way, None


def _below(plan: Node) -> Iterator[Node]:
    """A plan and the plans that it takes rows from, down to tables and views."""
    yield plan
    if plan.kind not in _STORED:
        for i in range(plan.java.children().size()):
            yield from _below(plan.child(i))


def _id(attribute) -> int:
    return attribute.exprId().id()


def analysed(spark: SparkSession, sql: str) -> Analysed:
    """What Spark's analyser makes of a statement, which isn't run; raises its error where it refuses it."""
    found = Analysed(Node(spark.sql(sql)._jdf.queryExecution().analyzed(), _classes(spark)))
    nodes = list(found.root.all())
    definitions = {n.java.id(): n for n in nodes if n.kind == "CTERelationDef"}
    for place, n in enumerate(nodes):
        if n.span:
            found.found[n.kind, n.span].append(n)
        if n.kind in _STORED and n.kind != "LocalRelation":
            name = n.java.desc().identifier().table() if n.kind == "View" else ""
            if n.kind != "View" and any(x.kind == "View" for x in n.above):
                continue  # what the view around it reads
            if n.kind != "View":
                table = n.java.catalogTable() if n.kind == "LogicalRelation" else None
                name = table.get().identifier().table() if table is not None and table.isDefined() else n.kind
            if n.kind != "View" or not any(x.kind == "View" for x in Node(n.java.child(), n.classes).all()):
                found.tables.add(name)
            for a in _list(n.java.output()):  # an inner view, which comes later, is nearer to the table
                found.sources[_id(a)] = Source(name, a.name(), place, a.dataType().simpleString())
        elif n.kind == "Alias":
            holder = next((x for x in reversed(n.above) if x.is_plan), None)
            found.aliases[_id(n.java)] = (n.child(0), holder)
        elif n.kind == "CTERelationRef" and n.java.cteId() in definitions:
            definition = definitions[n.java.cteId()]
            for a, b in zip(_list(n.java.output()), _list(definition.java.child().output()), strict=True):
                found.bound[_id(a)] = (_id(b), definition)
    return found


def scanned(spark: SparkSession, sql: str) -> set[str]:
    """The columns that a statement's scans read, from the planned statement, which isn't run."""
    found: set[str] = set()

    def visit(plan) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(plan.inputPlan())
        if kind == "FileSourceScanExec":
            found.update(plan.requiredSchema().fieldNames())
        for x in [*_list(plan.children()), *_list(plan.subqueries())]:
            visit(x)

    visit(spark.sql(sql)._jdf.queryExecution().executedPlan())
    return found
