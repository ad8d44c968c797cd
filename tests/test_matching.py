import random
from itertools import permutations

import numpy as np
import pytest

from lodestone.functions.matching import matchable
from lodestone.operators import evaluation
from lodestone.plans.sql import equal_rows


def by_hand(a, b, tolerance=0.01):
    """Whether some order of b agrees with a, cell by cell."""
    close = lambda x, y: abs(x - y) <= tolerance + 1e-9 if isinstance(x, float) and isinstance(y, float) else x == y
    return len(a) == len(b) and any(all(all(map(close, r, o)) for r, o in zip(a, order, strict=True)) for order in permutations(b))


def tables(seed, n=5):
    rng = random.Random(seed)
    number = lambda: round(rng.randrange(6) * 0.005, 3)
    rows = [(rng.choice("ab"), number(), number()) for _ in range(n)]
    other = [(t, round(x + rng.choice((-0.01, -0.005, 0, 0.005, 0.01, 0.015 if rng.random() < 0.3 else 0)), 3), round(y + rng.choice((-0.005, 0, 0.01)), 3)) for t, x, y in rows]
    rng.shuffle(other)
    return rows, other


def test_rows_pair_if_any_order_does():
    outcomes = [by_hand(*tables(seed)) for seed in range(400)]
    assert outcomes == [equal_rows(*tables(seed)) for seed in range(400)]
    assert 100 < sum(outcomes) < 390
    narrow = [[[(t, x) for t, x, _ in rows] for rows in tables(seed)] for seed in range(200)]
    assert [by_hand(*t) for t in narrow] == [equal_rows(*t) for t in narrow]


def test_exchanges_are_found():
    assert equal_rows([(1.00,), (1.01,)], [(1.01,), (1.02,)]) and not equal_rows([(1.00,), (1.01,)], [(1.02,), (1.02,)])
    n = 300
    chain = np.array([[i * 0.01, 0.0] for i in range(n)])
    assert matchable(chain, chain[::-1] + [0.01, 0], 0.01) and not matchable(chain, chain + [0.011, 0], 0.01)
    assert equal_rows([(None, "a  b", True)], [(None, "a b", True)]) and not equal_rows([(None,)], [(0.0,)]) and not equal_rows([(1.0, 2.0)], [(1.0,)])
    assert equal_rows([("x", float("nan"))], [("x", float("nan"))]) and equal_rows([], []) and equal_rows([("12",)], [(12.001,)])
    assert equal_rows([(1.0,), (2.0,)], [(1.0,), (2.0,)], True) and not equal_rows([(1.0,), (2.0,)], [(2.0,), (1.0,)], True)


@pytest.mark.parametrize("columns", [1, 2])
def test_results_above_the_row_cap(spark, columns):
    schema = "t string, " + ", ".join(f"x{i} double" for i in range(columns))
    frame = lambda rows: spark.createDataFrame([r[: columns + 1] for r in rows], schema)
    seeds = range(5) if columns == 1 else range(8)
    cases = [tables(seed) for seed in seeds]
    want = [by_hand([r[: columns + 1] for r in a], [r[: columns + 1] for r in b]) for a, b in cases]
    assert [evaluation.same_rows(frame(a), frame(b)) for a, b in cases] == want
    assert len(set(want)) == 2


def test_odd_cells_and_shapes(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    nan, inf = float("nan"), float("inf")
    odd = [(None, None, 1), ("a ", nan, 2), ("a  b", inf, 3), ("", -inf, None)]
    tidy = [("", -inf, None), ("a b", inf, 3), ("a", nan, 2), (None, None, 1)]
    assert evaluation.same_rows(f(odd, "t string, x double, n int"), f(tidy, "t string, y float, n long"))
    assert not evaluation.same_rows(f(odd, "t string, x double, n int"), f(tidy[:3] + [(None, 0.0, 1)], "t string, x double, n int"))
    assert evaluation.same_rows(f([(1.004,)], "x double"), f([(1.006,)], "x double")) and not evaluation.same_rows(f([(1.0,)], "x double"), f([(1.0,), (1.0,)], "x double"))
    assert evaluation.same_rows(f([("a",), ("a",)], "t string"), f([("a",), ("a",)], "t string")) and not evaluation.same_rows(f([("a",), ("a",)], "t string"), f([("a",)], "t string"))
    assert not evaluation.same_rows(f([("a",)], "t string"), f([("a", 1)], "t string, n int")) and evaluation.same_rows(f([], "x double, y double"), f([], "x double, y double"))
