"""Hard negatives by dual-tree search for largest inner products.

An anchor's positives are the rows of its label with the largest inner products; its negatives, for each positive, those
of other labels whose product lies in a range below the positive's. Both are searches in the same pair of trees, one
over anchors and one over candidates. A node knows the mean of its vectors, their largest distance from it, the least
and largest value of every component, and the least and largest label. From these an interval follows that holds every
product between two nodes; a whole group of anchors leaves a whole group of candidates where the interval misses what
all of them still look for, or where labels exclude each other. Leaves that remain are multiplied exactly.

The top of the candidates' tree are cells (label and side of splitting planes, which a bounded sample of SAMPLE rows
fixes), the rest grows in tasks over units, which are a cell's rows or parts of a cell of at most about UNIT_ROWS. A
search has two steps: every anchor first visits the part of one promising cell, which gives it a floor below which nothing is wanted;
then runs of anchors that lie together are compared with all cells, and visit those that may hold more. Floors only rise
inside a unit, and the best of all units are merged in the end, so that the result is exact.

Scale: rows are shuffled once, into units of whole numbers in one to eight bytes a component, written and reread; anchors travel to
the units that they can't rule out. There are at most MAX_CELLS cells, so that their bounds (MAX_CELLS * dimensions * 24
bytes) are small enough for every task. Without any pruning (vectors in no groups at all) anchors meet every unit: the
work is anchors * rows then, and each anchor travels once to each unit; more than WAVE anchors of one unit are
shared among copies of it. A label or cell that holds most rows has many units. Nothing but the sample and the cells passes the driver.

Edge cases: rows with a null id, label or vector, or any null or non-finite component, take no part; rows equal in id,
label and vector are one, rows of one id that differ are several, but none is another's positive or negative; shorter
vectors are filled up with zeros, an empty one scores 0; ties go by id; an anchor without positives or a positive
without negatives has no row; a negative positive score has an empty range; an empty table gives an empty result; vectors whose squared length
reaches 2^53 are refused, since products wouldn't be exact; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved

#: Rows and numbers of the sample that the planes come from, wanted rows of a cell, most cells, most label classes of cells.
SAMPLE, SAMPLE_NUMBERS, CELL_ROWS, MAX_CELLS, CLASSES = 8192, 1 << 20, 16_384, 512, 16
#: Rows of a unit, anchors that meet a unit at once, anchors of a run, leaves of the two trees, most candidate leaves multiplied at once.
UNIT_ROWS, WAVE, RUN, LEAF, ANCHOR_LEAF, LEAVES = 1 << 18, 1 << 18, 512, 64, 16, 32
#: Components of node pairs that are compared at once.
NUMBERS = 1 << 21
#: Relative error of bounds computed in 32 bits, with room to spare.
SLACK = 1e-4
_HIT = "key long, slot int, score long, id long"


@dataclass
class Nodes:
    """Bounds of a row of nodes."""

    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray
    norm: np.ndarray = field(init=False)

    def __post_init__(self):
        self.norm = np.sqrt((self.centre**2).sum(1))

    @classmethod
    def of(cls, x: np.ndarray, label: np.ndarray, starts: np.ndarray) -> Nodes:
        """Those of runs of rows of x, which begin at starts."""
        sizes = np.diff(starts, append=len(x))
        centre = np.add.reduceat(x, starts) / sizes[:, None].astype(x.dtype)
        radius = np.sqrt(np.maximum.reduceat(((x - np.repeat(centre, sizes, axis=0)) ** 2).sum(1), starts))
        return cls(centre, radius, np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts))


def interval(a: Nodes, c: Nodes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above all products of vectors of nodes a[i] and c[j], pair by pair: by spheres and by boxes."""
    middle = np.einsum("ij,ij->i", a.centre[i], c.centre[j])
    around = a.radius[i] * c.norm[j] + c.radius[j] * a.norm[i] + a.radius[i] * c.radius[j]
    corners = [x[i] * y[j] for x in (a.low, a.high) for y in (c.low, c.high)]
    least, most = (f(f(corners[0], corners[1]), f(corners[2], corners[3])).sum(1) for f in (np.minimum, np.maximum))
    slack = 1 + SLACK * (a.norm[i] + a.radius[i]) * (c.norm[j] + c.radius[j])
    return np.maximum(middle - around, least) - slack, np.minimum(middle + around, most) + slack


def wanted(a: Nodes, c: Nodes, i: np.ndarray, j: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may hold products between floor[i] and ceiling[i] of the same label, or else of another; and the products' upper bounds."""
    if same:
        met = (c.label_low[j] <= a.label_high[i]) & (c.label_high[j] >= a.label_low[i])
    else:
        met = (a.label_low[i] != a.label_high[i]) | (c.label_low[j] != c.label_high[j]) | (a.label_low[i] != c.label_low[j])
    step = max(1, NUMBERS // max(a.centre.shape[1], 1))
    bounds = [interval(a, c, i[s : s + step], j[s : s + step]) for s in range(0, max(len(i), 1), step)]
    low, high = (np.concatenate(b) for b in zip(*bounds, strict=True))
    return met & (high >= floor[i]) & (low <= ceiling[i]), high


def widest(x: np.ndarray) -> np.ndarray:
    """Roughly the principal direction of rows, by power iteration from the farthest one."""
    if not len(x):
        return np.ones(x.shape[1], x.dtype)
    own = x - x.mean(0)
    v = own[(own**2).sum(1).argmax()].copy()
    for _ in range(4):
        v /= np.linalg.norm(v) or 1.0
        v = own.T @ (own @ v)
    return v / (np.linalg.norm(v) or 1.0)


class Tree:
    """Rows halved again and again along their widest direction; order has them so that every node is a run."""

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int):
        n = len(x)
        self.order = np.arange(n)
        self.edges = [np.array([0, n])]
        for _ in range(max(0, int(math.log2(max(n / leaf, 1))))):
            edges = [0]
            for start, end in zip(self.edges[-1], self.edges[-1][1:], strict=False):
                rows, middle = self.order[start:end], (end - start) // 2
                self.order[start:end] = rows[np.argpartition(x[rows] @ widest(x[rows]), middle)]
                edges += [start + middle, end]
            self.edges.append(np.array(edges))
        self.x, self.label = x[self.order], label[self.order]
        self.levels = [Nodes.of(self.x, self.label, edges[:-1]) for edges in self.edges]


class Best:
    """The k best hits of every (row, slot) so far, and what a further one must reach."""

    def __init__(self, floor: np.ndarray, ceiling: np.ndarray, k: int):
        self.floor, self.ceiling, self.k = floor.astype(np.float64), ceiling.astype(np.float64), k
        self.hits = np.zeros((0, 4), np.int64)  # row, slot, score, id

    def add(self, row: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        hits = np.concatenate([self.hits, np.stack([row, slot, score, ids], axis=1)])
        hits = hits[np.lexsort((hits[:, 3], -hits[:, 2], hits[:, 1], hits[:, 0]))]
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:, :2] != hits[:-1, :2]).any(1)
        place = np.arange(len(hits)) - np.maximum.accumulate(np.where(new, np.arange(len(hits)), 0))
        self.hits, place = hits[place < self.k], place[place < self.k]
        full = self.hits[place == self.k - 1]
        self.floor[full[:, 0], full[:, 1]] = np.maximum(self.floor[full[:, 0], full[:, 1]], full[:, 2])


def _outer(floor: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The widest range of every row's slots; slots without a range don't count."""
    open_ = floor <= ceiling
    return np.where(open_, floor, np.inf).min(1, initial=np.inf), np.where(open_, ceiling, -np.inf).max(1, initial=-np.inf)


def search(anchors: Tree, anchor_ids: np.ndarray, candidates: Tree, ids: np.ndarray, best: Best, same: bool) -> None:
    """Adds to best (rows and slots as in the anchors' order) every hit of the candidates that is among the k best."""
    i = j = np.zeros(1, np.int64)
    depth, deepest = 0, (len(anchors.levels) - 1, len(candidates.levels) - 1)
    while True:
        la, lc = min(depth, deepest[0]), min(depth, deepest[1])
        starts = anchors.edges[la][:-1]
        floor, ceiling = _outer(best.floor, best.ceiling)
        met, high = wanted(anchors.levels[la], candidates.levels[lc], i, j, np.minimum.reduceat(floor, starts), np.maximum.reduceat(ceiling, starts), same)
        i, j, high = i[met], j[met], high[met]
        if depth >= max(deepest) or not len(i):
            break
        if la < deepest[0]:
            i, j = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
        if lc < deepest[1]:
            i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
        depth += 1
    starts, ends = candidates.edges[-1][:-1], candidates.edges[-1][1:]
    for node in np.unique(i):
        first, last = anchors.edges[-1][node], anchors.edges[-1][node + 1]
        mine = np.flatnonzero(i == node)
        mine = mine[np.argsort(-high[mine], kind="stable")]
        at, some = 0, 1
        while at < len(mine):
            floor, _ = _outer(best.floor[first:last], best.ceiling[first:last])
            if high[mine[at]] < floor.min():
                break  # nor can any later leaf
            rows = np.concatenate([np.arange(starts[k], ends[k]) for k in j[mine[at : at + some]]])
            _multiply(anchors, anchor_ids, first, last, candidates, ids, rows, best, same)
            at, some = at + some, min(2 * some, LEAVES)


def _multiply(anchors: Tree, anchor_ids: np.ndarray, first: int, last: int, candidates: Tree, ids: np.ndarray, rows: np.ndarray, best: Best, same: bool) -> None:
    products = anchors.x[first:last] @ candidates.x[rows].T
    met = (anchors.label[first:last, None] == candidates.label[None, rows]) == same
    met &= anchor_ids[first:last, None] != ids[None, rows]
    for slot in range(best.floor.shape[1]):
        a, c = np.nonzero(met & (products >= best.floor[first:last, slot, None]) & (products <= best.ceiling[first:last, slot, None]))
        if len(a):
            best.add(a + first, np.full(len(a), slot), products[a, c].astype(np.int64), ids[rows[c]])


@dataclass
class Layout:
    """How vectors travel and where they lie: planes of a complete binary tree, label classes, the number type."""

    dims: int
    width: str
    exact: str
    classes: int
    normals: np.ndarray
    cuts: np.ndarray

    def matrix(self, q: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(q), self.width).reshape(len(q), self.dims).astype(self.exact)

    def cells(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(math.log2(len(self.cuts) + 1))):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[node]) > self.cuts[node])
        return (node - len(self.cuts)) * self.classes + label % self.classes


def planes(x: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Normals and cuts of a complete tree with so many leaves (a power of two): each node is cut at the median of its widest direction."""
    normals, cuts = np.zeros((leaves - 1, x.shape[1])), np.zeros(leaves - 1)
    rows = {0: np.arange(len(x))}
    for node in range(leaves - 1):
        v = widest(x[rows[node]])
        side = x[rows[node]] @ v
        normals[node], cuts[node] = v, np.median(side) if len(side) else 0.0
        rows[2 * node + 1], rows[2 * node + 2] = rows[node][side <= cuts[node]], rows[node][side > cuts[node]]
    return normals, cuts


def _padded(q: pd.Series, dims: int) -> np.ndarray:
    x = np.zeros((len(q), dims), np.int64)
    for row, own in zip(x, q, strict=True):
        row[: len(own)] = own
    return x


def _place(batches: Iterator[pd.DataFrame], layout: Layout) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        x, label = _padded(pdf["q"], layout.dims), pdf["label"].to_numpy()
        packed = x.astype(layout.width)
        yield pd.DataFrame({"id": pdf["id"], "label": label, "anchor": pdf["anchor"], "cell": layout.cells(x.astype(float), label), "q": [r.tobytes() for r in packed]})


def _unit(pdf: pd.DataFrame, layout: Layout) -> pd.DataFrame:
    """A unit's rows packed, with its bounds; equal rows once."""
    pdf = pdf.drop_duplicates(["id", "label", "q"])
    x, label = layout.matrix(pdf["q"]), pdf["label"].to_numpy(np.int64)
    n = Nodes.of(x, label, np.zeros(1, np.int64))
    row = {"cell": pdf["cell"].iloc[0], "part": pdf["part"].iloc[0], "rows": len(pdf), "ids": pdf["id"].to_numpy("<i8").tobytes(), "labels": label.astype("<i8").tobytes(), "vectors": b"".join(pdf["q"])}
    row |= {"centre": n.centre[0].astype(float).tolist(), "radius": float(n.radius[0]), "low": n.low[0].astype(float).tolist(), "high": n.high[0].astype(float).tolist()}
    return pd.DataFrame([row | {"label_low": int(n.label_low[0]), "label_high": int(n.label_high[0])}])


_UNIT = "cell long, part int, rows long, ids binary, labels binary, vectors binary, centre array<double>, radius double, low array<double>, high array<double>, label_low long, label_high long"


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """A cell's bounds from those of its units."""
    centres = np.stack(pdf["centre"].to_numpy())
    centre = (centres * (pdf["rows"] / pdf["rows"].sum()).to_numpy()[:, None]).sum(0)
    radius = float((np.sqrt(((centres - centre) ** 2).sum(1)) + pdf["radius"]).max())
    edges = {"low": np.stack(pdf["low"].to_numpy()).min(0).tolist(), "high": np.stack(pdf["high"].to_numpy()).max(0).tolist()}
    return pd.DataFrame([{"cell": pdf["cell"].iloc[0], "parts": len(pdf), "centre": centre.tolist(), "radius": radius} | edges | {"label_low": pdf["label_low"].min(), "label_high": pdf["label_high"].max()}])


@dataclass
class Cells:
    """All cells' bounds, for every task."""

    number: np.ndarray
    parts: np.ndarray
    nodes: Nodes


def _slots(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _visits(batches: Iterator[pd.DataFrame], layout: Layout, cells: Cells, same: bool, seeds: bool) -> Iterator[pd.DataFrame]:
    """Anchors with the units that they visit: part of the most promising cell, or all units of cells that their run can't rule out."""
    for pdf in batches:
        x, label = layout.matrix(pdf["q"]), pdf["label"].to_numpy(np.int64)
        floor, ceiling = _outer(_slots(pdf["floor"]), _slots(pdf["ceiling"]))
        starts = np.unique(np.concatenate([np.arange(0, len(pdf), RUN), np.flatnonzero(np.diff(pdf["cell"].to_numpy(), prepend=-1))]))
        runs = Nodes.of(x, label, starts)
        i, j = (z.ravel() for z in np.meshgrid(np.arange(len(starts)), np.arange(len(cells.number)), indexing="ij"))
        met, _ = wanted(runs, cells.nodes, i, j, np.minimum.reduceat(floor, starts), np.maximum.reduceat(ceiling, starts), same)
        i, j = i[met], j[met]
        if seeds:  # the one cell of each run whose mean has the largest product
            product = np.einsum("ij,ij->i", runs.centre[i], cells.nodes.centre[j])
            order = np.lexsort((-product, i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            i, j = i[first], j[first]
        ends = np.append(starts[1:], len(pdf))
        for run, cell in zip(i.tolist(), j.tolist(), strict=True):
            own, parts = pdf.iloc[starts[run] : ends[run]].drop(columns="cell"), int(cells.parts[cell])
            for part in [parts // 2] if seeds else range(parts):
                yield own.assign(unit_cell=cells.number[cell], part=np.int32(part))


def _meet(units: pd.DataFrame, visitors: pd.DataFrame, layout: Layout, same: bool, k: int) -> pd.DataFrame:
    """The k best hits of every visitor and slot in one unit."""
    found = []
    if len(units) and len(visitors):
        unit = units.iloc[0]
        vectors = np.frombuffer(unit["vectors"], layout.width).reshape(int(unit["rows"]), layout.dims).astype(layout.exact)
        candidates = Tree(vectors, np.frombuffer(unit["labels"], "<i8"), LEAF)
        ids = np.frombuffer(unit["ids"], "<i8")[candidates.order]
        visitors = visitors.iloc[Tree(layout.matrix(visitors["q"]), visitors["label"].to_numpy(np.int64), RUN).order]
        for start in range(0, len(visitors), 2 * RUN):
            some = visitors.iloc[start : start + 2 * RUN]
            anchors = Tree(layout.matrix(some["q"]), some["label"].to_numpy(np.int64), ANCHOR_LEAF)
            some = some.iloc[anchors.order]
            best = Best(_slots(some["floor"]), _slots(some["ceiling"]), k)
            search(anchors, some["id"].to_numpy(np.int64), candidates, ids, best, same)
            found.append(np.column_stack([some["key"].to_numpy(np.int64)[best.hits[:, 0]], best.hits[:, 1:]]))
    hits = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return pd.DataFrame(hits, columns=["key", "slot", "score", "id"]).astype({"slot": np.int32})


class Search:
    """The units and cells of one table of vectors, and searches in them."""

    def __init__(self, rows: DataFrame):
        """rows (id, label, q array<long>, anchor)."""
        length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims"), F.max(length).alias("square"), F.max(F.array_max(F.transform("q", F.abs))).alias("largest"), F.approx_count_distinct("label").alias("labels")).first()
        self.empty = not sizes["n"]
        if self.empty:
            return
        if (square := sizes["square"]) >= 2**53:
            raise ValueError("vectors are too long for exact products")
        dims, classes = max(sizes["dims"], 1), max(1, min(CLASSES, sizes["labels"]))
        leaves = min(MAX_CELLS, sizes["n"] // CELL_ROWS) // classes
        sample = min(SAMPLE, SAMPLE_NUMBERS // dims)
        drawn = rows.select("q", "id").orderBy(F.xxhash64("id", F.lit(13)), "id").limit(sample).select("q").toPandas()["q"] if leaves > 1 else []
        normals, cuts = planes(_padded(drawn, dims).astype(float), 1 << int(math.log2(max(leaves, 1))))
        # Any power of two lies between two widths.
        width = next(f"<i{w}" for w in (1, 2, 4, 8) if (sizes["largest"] or 0) < 1 << 8 * w - 1)
        self.layout = Layout(dims, width, "f4" if square < 2**24 else "f8", classes, normals, cuts)
        layout = self.layout
        placed = saved(rows.mapInPandas(partial(_place, layout=layout), "id long, label long, anchor boolean, cell long, q binary"), "placed")
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / UNIT_ROWS).alias("parts"))  # at most MAX_CELLS + CLASSES rows
        dealt = placed.drop("anchor").join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        self.units = saved(dealt.drop("parts").groupBy("cell", "part").applyInPandas(lambda pdf: _unit(pdf, layout), _UNIT), "units")
        bounds = self.units.drop("ids", "labels", "vectors").groupBy("cell").applyInPandas(_cell, "cell long, parts int, centre array<double>, radius double, low array<double>, high array<double>, label_low long, label_high long")
        cells = bounds.orderBy("cell").toPandas()  # bounded as above
        columns = [np.stack(cells[c].to_numpy()) if c in ("centre", "low", "high") else cells[c].to_numpy() for c in ("centre", "radius", "low", "high", "label_low", "label_high")]
        self.cells = Cells(cells["cell"].to_numpy(), cells["parts"].to_numpy(), Nodes(*columns))
        # Equal anchors once; neighbours lie together.
        own = placed.filter("anchor").select("id", "label", "cell", "q").distinct().repartitionByRange("cell", "id").sortWithinPartitions("cell", "q", "id")
        self.anchors = saved(own.withColumn("key", F.monotonically_increasing_id()), "anchors")
        self.waves = max(1, math.ceil(self.anchors.count() / WAVE))

    def _step(self, anchors: DataFrame, same: bool, k: int, seeds: bool) -> DataFrame:
        columns = "key long, id long, label long, q binary, floor array<long>, ceiling array<long>"
        visits = anchors.select("key", "id", "label", "q", "floor", "ceiling", "cell").mapInPandas(partial(_visits, layout=self.layout, cells=self.cells, same=same, seeds=seeds), columns + ", unit_cell long, part int")
        units = self.units.select("cell", "part", "rows", "ids", "labels", "vectors", F.explode(F.sequence(F.lit(0), F.lit(self.waves - 1))).alias("wave"))
        visits = visits.withColumn("wave", F.pmod(F.xxhash64("key"), F.lit(self.waves)).cast("int"))
        met = units.groupBy("cell", "part", "wave").cogroup(visits.groupBy("unit_cell", "part", "wave"))
        place = F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), "id"))
        layout = self.layout
        return saved(met.applyInPandas(lambda units, visitors: _meet(units, visitors, layout, same, k), _HIT).withColumn("rank", place).filter(F.col("rank") <= k), "hits")

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """anchors (those of this search, with arrays floor and ceiling) -> key, slot, rank, id, score: of each slot's range the k best, of the same label or of others."""
        seen = self._step(anchors, same, k, seeds=True).filter(F.col("rank") == k)
        floors = seen.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("seen"))
        raised = F.transform("floor", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("seen", i), x)))
        return self._step(anchors.join(floors, "key", "left").withColumn("floor", raised).drop("seen").sortWithinPartitions("cell", "q"), same, k, seeds=False)


def hard_negatives(
    vectors: DataFrame, anchor: Column, id: str = "vec_id", label: str | Column = "label", vector: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors become whole numbers, floor(scale * x). For each of an anchor's best rows of its label, the best rows of
    other labels with least * positive_score <= 100 * negative_score <= most * positive_score. anchor says which rows
    are anchors; label may be an expression.
    """
    found = F.col(f"`{vector}`")
    finite = F.forall(found, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), (F.col(f"`{label}`") if isinstance(label, str) else label).cast("long").alias("label"), F.when(finite, found).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter("id is not null and label is not null and x is not null")
    index = Search(rows.select("id", "label", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"), "anchor"))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index.empty:
        return vectors.sparkSession.createDataFrame([], result)
    all_ = (F.array(F.lit(x).cast("long")).alias(c) for c, x in (("floor", -(2**53)), ("ceiling", 2**53)))
    near = index.best(index.anchors.select("*", *all_), True, positives).select("key", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score")
    # A negative score has an empty range.
    ranges = near.select("key", "place", F.when(score >= 0, F.expr(f"({least} * positive_score + 99) div 100")).otherwise(1).cast("long").alias("floor"), F.when(score >= 0, F.expr(f"({most} * positive_score) div 100")).otherwise(0).cast("long").alias("ceiling"))
    ranges = ranges.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "floor", "ceiling"))).alias("r"))  # at most `positives` a key
    # Every anchor has as many slots; those without a positive have an empty range.
    filled = lambda c, x: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("r", i)[c], F.lit(x).cast("long"))).alias(c)
    far = index.best(index.anchors.join(ranges, "key").select(*index.anchors.columns, filled("floor", 1), filled("ceiling", 0)), False, negatives)
    far = far.select("key", (F.col("slot") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = index.anchors.select("key", F.col("id").alias("anchor_id"))
    return far.join(near, ["key", "place"]).join(named, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same by all products of anchors and rows, for DuckDB.
SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
