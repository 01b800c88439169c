import random

import pytest

from bindery.operators.intervals import runs_and_gaps

SCHEMA = "book string, a long, z long, entity string, lo string"


def brute(intervals):
    out = []
    by = {}
    for e, a, z in intervals:
        if e is not None and a is not None and z is not None and a <= z:
            by.setdefault(e, set()).update(range(a, z + 1))
    for e, units in by.items():
        runs = []
        for u in sorted(units):
            if runs and runs[-1][1] + 1 == u:
                runs[-1][1] = u
            else:
                runs.append([u, u])
        out += [(e, "period", a, z) for a, z in runs]
        out += [(e, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])]
    return sorted(out)


@pytest.mark.parametrize("shard", [1, 4, 7, 4096])
def test_random_intervals(spark, rows, shard):
    r = random.Random(shard)
    data = []
    for _ in range(300):
        a = r.randint(-30, 120)
        z = a + r.choice([-1, 0, 0, 1, 2, 5, 40])
        data.append((r.choice("xyz"), a, z))
    data += data[:20] + [(None, 1, 2), ("x", None, 3), ("x", 3, None), ("only", 5, 4)]
    df = spark.createDataFrame([(*d, "e", "l") for d in data], SCHEMA)
    assert rows(runs_and_gaps(df, "book", "a", "z", shard)) == sorted(brute(data), key=repr)


def test_long_intervals_stay_short(spark, rows):
    df = spark.createDataFrame([("b", 0, 2**40, "", ""), ("b", 2**40 + 1, 2**41, "", ""), ("b", 2**41 + 5, 2**41 + 5, "", "")], SCHEMA)
    got = rows(runs_and_gaps(df, "book", "a", "z"))
    assert got == sorted([("b", "period", 0, 2**41), ("b", "gap", 2**41 + 1, 2**41 + 4), ("b", "period", 2**41 + 5, 2**41 + 5)], key=repr)


def test_empty(spark, rows):
    assert rows(runs_and_gaps(spark.createDataFrame([], SCHEMA), "book", "a", "z")) == []
