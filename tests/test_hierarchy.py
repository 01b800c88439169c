import random

from bindery.operators import hierarchy as H

SCHEMA = "book string, id string, doc string, parent string, root string"


def build(spark, data):
    df = spark.createDataFrame([(*d, "clash") for d in data], SCHEMA)
    return H.hierarchy(H.links(df, "book", "id", "doc", "parent"))


def test_states(spark, rows):
    data = [
        ("b", "r", "d-r", None),
        ("b", "a", "d-a", " R "),
        ("b", "c", "d-c", "D-A"),
        ("b", "s", "d-s", "s"),
        ("b", "x", "d-x", "y"),
        ("b", "y", "d-y", "x"),
        ("b", "h", "d-h", "x"),
        ("b", "h2", "d-h2", "h"),
        ("b", "u", "d-u", "nothing"),
        ("b", "e", "d-e", ""),
        ("other", "a", "d-a", "r"),
        (None, "q", "d-q", None),
    ]
    got = {(r["book"], r["id"]): (r["state"], r["root"], r["depth"], list(r["path"])) for r in build(spark, data + data[:4]).collect()}
    assert got == {
        ("b", "r"): ("tree", "r", 0, ["r"]),
        ("b", "a"): ("tree", "r", 1, ["r", "a"]),
        ("b", "c"): ("tree", "r", 2, ["r", "a", "c"]),
        ("b", "s"): ("cycle", "", -1, []),
        ("b", "x"): ("cycle", "", -1, []),
        ("b", "y"): ("cycle", "", -1, []),
        ("b", "h"): ("hanging", "", -1, []),
        ("b", "h2"): ("hanging", "", -1, []),
        ("b", "u"): ("tree", "u", 0, ["u"]),
        ("b", "e"): ("tree", "e", 0, ["e"]),
        ("other", "a"): ("tree", "a", 0, ["a"]),
    }


def test_random_functions(spark):
    r = random.Random(3)
    parent = {f"n{i}": f"n{r.randrange(40)}" for i in range(40)}
    for i in range(0, 40, 9):
        parent[f"n{i}"] = None
    got = {x["id"]: x for x in build(spark, [("b", k, None, p) for k, p in parent.items()]).collect()}
    for k in parent:
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is None:
            assert (got[k]["state"], got[k]["root"], got[k]["depth"]) == ("tree", seen[-1], len(seen) - 1)
            assert list(got[k]["path"]) == seen[::-1]
        else:
            assert got[k]["state"] == ("cycle" if at == k else "hanging")


def test_descendants_and_empty(spark, rows):
    tree = build(spark, [("b", "r", "1", None), ("b", "a", "2", "r"), ("b", "c", "3", "a")])
    assert rows(H.descendants(tree)) == [("b", "a", "c", 1), ("b", "r", "a", 1), ("b", "r", "c", 2)]
    assert build(spark, []).count() == 0
