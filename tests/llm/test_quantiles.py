import numpy as np
import pytest

from bindery.llm.quantiles import RELATIVE_ERROR, Sketch, merged, read_quantiles, sketches

PROBS = [0.5, 0.9, 0.95, 0.99, 0.999]


def error(values, sketch):
    x = np.sort(values)
    worst = 0.0
    for p, v in zip(PROBS, sketch.quantiles(PROBS)):
        low, high = np.searchsorted(x, v, "left") + 1, np.searchsorted(x, v, "right")
        want = np.ceil(p * len(x))
        worst = max(worst, max(0, low - want, want - high) / len(x) / (1 - p) / RELATIVE_ERROR)
    return worst


@pytest.mark.parametrize("seed", range(6))
def test_error_is_relative_to_the_tail(seed):
    r = np.random.default_rng(seed)
    values = r.lognormal(size=200_000) if seed % 2 else np.round(r.exponential(size=200_000), 2)
    one = Sketch()
    for part in np.array_split(values, 37):
        one.add(part)
    assert one.n == len(values) and error(values, one) <= 1.3
    many = Sketch()
    for part in np.array_split(values, 50):
        many.merge(Sketch.unpack(Sketch().add(part).pack()))
    assert many.n == len(values) and error(values, many) <= 1.3
    assert sum(len(level[0]) for level in many.levels) < 6000
    assert sum(len(level[0]) << h for h, level in enumerate(many.levels)) == many.n


def test_small_sets_are_exact():
    s = Sketch().add(np.array([3.0, 1.0, 2.0, 4.0]))
    assert s.quantiles([0.25, 0.5, 0.75, 1.0]) == [1.0, 2.0, 3.0, 4.0]
    assert Sketch().quantiles([0.5]) == [None]


def test_frame(spark, rows):
    data = [("a", float(i), None if i % 2 else 1.0) for i in range(500)] + [(None, 5.0, float("nan")), ("b", None, None)]
    df = spark.createDataFrame(data, "k string, x double, y double").repartition(64)
    got = read_quantiles(merged(sketches(df, ["k"], ["x", "y"]), ["k"]), [0.5, 0.99])
    assert [(r[0], r[1], r[2], list(r[3])) for r in rows(got)] == [
        ("a", "x", 500, [249.0, 494.0]),
        ("a", "y", 250, [1.0, 1.0]),
        (None, "x", 1, [5.0, 5.0]),
    ]
    assert merged(sketches(df.limit(0), ["k"], ["x"]), ["k"], 1).count() == 0
