import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bindery.llm.mixing import mix, rates
from bindery.llm.packing import pack, plan
from bindery.llm.tokens import ranked, token_count


@pytest.mark.parametrize("seed", range(20))
def test_plan_serves_every_item_once(seed):
    r = random.Random(seed)
    cap = r.choice([7, 50, 2048])
    hist = {r.randint(1, cap): r.randint(1, 400) for _ in range(r.randint(1, 60))}
    slots, made = plan(hist, cap)
    fill, served = Counter(), Counter()
    for length, a, z, first, per in slots:
        assert (z - a) % per == 0
        for rank in range(a, z):
            fill[first + (rank - a) // per] += length
            served[length, rank] += 1
    assert served == Counter({(x, k): 1 for x, n in hist.items() for k in range(n)})
    assert max(fill.values()) <= cap and set(fill) == set(range(made))
    total = sum(x * n for x, n in hist.items())
    least = max(-(-total // cap), sum(n for x, n in hist.items() if 2 * x > cap))
    assert made <= least * 1.25 + 1  # best fit decreasing stays near the bound


def test_ranks(spark):
    df = spark.createDataFrame([(i % 2 * (i % 3), i // 10, i) for i in range(200)], "g int, c int, id int")
    got = ranked(df, ["g"], ["c"], ["id"]).collect()
    for g in {r["g"] for r in got}:
        own = sorted((r["rank"], r["c"]) for r in got if r["g"] == g)
        assert [k for k, _ in own] == list(range(len(own))) and [c for _, c in own] == sorted(c for _, c in own)


def test_pack(spark):
    r = random.Random(1)
    data = [(i, r.choice([0, 3, 3, 3, 5, 9, 25, None]), "x") for i in range(300)] + [(7, 5, "x")] * 3
    df = spark.createDataFrame(data, "id int, n int, part string")
    got = pack(df, "n", ["id"], 10).collect()
    fill = Counter()
    for x in got:
        fill[x["container"]] += x["part_size"]
    assert max(fill.values()) <= 10
    sizes = Counter()
    for i, n, _ in data:
        sizes[i] += n or 0
    held = Counter()
    for x in got:
        held[x["id"]] += x["part_size"]
        assert x["part"] == 1 or x["n"] > 10
    assert held == sizes and {x["id"] for x in got} == {i for i, *_ in data}
    assert pack(df.limit(0), "n", ["id"], 10).count() == 0


def test_mix(spark, rows):
    r = random.Random(2)
    data = [(i, r.choice(["big", "big", "big", "small", "unlisted"]), r.randint(0, 90)) for i in range(2000)] + [(5000, "big", None), (5001, None, 4)]
    items = spark.createDataFrame(data, "id int, source string, n int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("nowhere", 0.3, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen = rates(items, targets, "source", "n")
    got = mix(items, chosen, "source", "n", ["id"])
    used = got.groupBy("source").agg(F.sum(F.col("n") * F.col("repeats")).alias("t"), F.max("repeats").alias("m")).collect()
    t = {x["source"]: x["t"] for x in used}
    assert set(t) == {"big", "small"} and abs(t["big"] / sum(t.values()) - 0.5) < 0.02
    limits = {"big": 1, "small": 3}
    assert all(x["m"] <= limits[x["source"]] for x in used)
    copies = {x["source"]: x["copies"] for x in chosen.collect()}
    assert all(x["repeats"] - copies[x["source"]] < 1 and copies[x["source"]] - x["repeats"] < 1 for x in got.collect())
    assert rows(got) == rows(mix(items, chosen, "source", "n", ["id"]))
    none = rates(items.limit(0), targets, "source", "n")
    assert none.count() == 0 and mix(items.limit(0), none, "source", "n", ["id"]).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("",), (None,), ("hello world",), ("x" * 20000,)], "t string")
    got = [r["n"] for r in df.select(token_count(F.col("t")).alias("n")).collect()]
    assert got[:3] == [0, 0, 2] and got[3] > 100
