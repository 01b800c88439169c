"""Entries to find against the rule spelled out, and what is put into chapters and books."""

import random

from pyspark.sql import functions as F

from bindery.operators import entries as E
from bindery.operators import windows as W

DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(s):
    s = s.upper()
    if not s or any(c not in DIGITS for c in s):
        return 0
    v = [DIGITS[c] for c in s]
    return sum(-x if x < max(v[i + 1 : i + 2], default=0) else x for i, x in enumerate(v))


def compare(a, b):
    if a.isdigit() and b.isdigit():
        a, b = int(a), int(b)
    elif roman(a) and roman(b):
        a, b = roman(a), roman(b)
    else:
        a, b = a.lower(), b.lower()
    return (a > b) - (a < b)


def expected(entries, level, identifier, index, total, start, end):
    pages = [(compare(n or "", identifier), p) for lv, n, p in entries if lv == level and p is not None]
    before, after = max((p for c, p in pages if c < 0), default=None), min((p for c, p in pages if c > 0), default=None)
    if before is not None and after is not None:
        return before + int((after - before) / 2)
    if before is not None:
        return before + 10
    return after - 10 if after is not None else start + (end - start) * index // total


def test_entries_to_find(spark):
    r = random.Random(3)
    entries, patterns, want = {}, [], set()
    names = [str(n) for n in range(1, 8)] + ["I", "II", "III", "IV", "V", "ix", None, "", "3a", "Appendix"]
    for b in range(12):
        entries[f"b{b}"] = own = [(r.choice(["chapter", "part", None]), r.choice(names), r.choice([None, *range(5, 90)])) for _ in range(r.randint(0, 9))]
        for level, first, last in (("chapter", "1", "8"), ("part", "I", "VI"), ("letter", "A", "C"), ("none", "3", "1"), ("empty", "1", "4")):
            patterns.append((f"b{b}", level, first, last))
            whole = [str(n) for n in range(int(first), int(last) + 1)] if first.isdigit() else ["I", "II", "III", "IV", "V", "VI"] if first == "I" else ["A"]
            have = {f"{lv}_{n}".lower() for lv, n, _ in own if lv and n}
            for i, x in enumerate(whole):
                if f"{level}_{x}".lower() not in have:
                    p = expected(own, level, x, i, len(whole), 3, 80)
                    want.add((f"b{b}", f"{level}_{x}".lower(), level, x, p, max(p - 20, 3), min(p + 20, 80)))
    e = spark.createDataFrame([(b, *x) for b, own in entries.items() for x in own], "book_id string, level_name string, entry_number string, page int")
    p = spark.createDataFrame(patterns, "book_id string, level_name string, range_start string, range_end string")
    bodies = spark.createDataFrame([(b, 3, 80) for b in entries], "book_id string, body_start int, body_end int")
    got = [tuple(x) for x in E.entries_to_find(p, e, bodies).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert E.entries_to_find(p.limit(0), e, bodies).count() == 0


def test_keys(spark):
    df = spark.createDataFrame([("b", "te1", 7), ("b", "", 7), ("b", None, None)], "b string, t string, s int")
    assert [r[0] for r in df.select(E.chapter_key(F.col("b"), F.col("t"), F.col("s"))).collect()] == ["b:te1", "b:orphan:7", "b:orphan:0"]


def test_classification_keeps_what_a_map_lacks(spark):
    c = spark.createDataFrame([("b", "e1", "body", None, None, "x"), ("b", "e2", "body", "essay", False, "x"), ("c", "e1", None, None, None, "x")], "book_id string, entry_id string, matter_type string, content_type string, audio_include boolean, j string")
    r = spark.createDataFrame([("b", '{"classifications":{"e1":"front_matter"},"content_types":{"e1":"preface"},"audio_include":{"e2":true},"reasoning":{"e2":"why"}}'), ("c", "no json")], "book_id string, json string")
    got = {(x["book_id"], x["entry_id"]): (x["matter_type"], x["content_type"], x["audio_include"], x["reasoning"]) for x in E.classified(c, r).collect()}
    assert got == {("b", "e1"): ("front_matter", "preface", None, ""), ("b", "e2"): ("body", "essay", True, "why"), ("c", "e1"): (None, None, None, "")}


def test_gaps_with_neighbours(spark, rows):
    df = spark.createDataFrame([("b", 10, "A"), ("b", 26, "B"), ("b", 26, "C"), ("b", 60, "D"), ("b", None, "E"), ("c", 40, "X")], "g string, page int, t string")
    x = spark.createDataFrame([("b", 20, 30), ("c", 1, 99)], "g string, start_page int, end_page int")
    got = rows(W.gaps(df, "g", "page", F.lit(1), F.lit(80), 15, "t", x))
    assert got == sorted([("b", "gap_11_25", 11, 25, 15, "A", "B", 10, 26), ("b", "gap_61_80", 61, 80, 20, "D", "", 60, 0), ("c", "gap_1_39", 1, 39, 39, "", "X", 0, 40)], key=repr)


def test_ranges_against_brute_force(spark, rows):
    r = random.Random(1)
    points = [(r.choice("ab"), r.choice([None, *range(-20, 400)]), i) for i in range(80)]
    ranges = [(r.choice("abc"), a, a + r.randint(-3, 90), i) for i in range(30) for a in [r.randint(-30, 380)]] + [("a", None, 3, 99), ("a", 3, None, 98)]
    p, q = spark.createDataFrame(points, "g string, at int, id int"), spark.createDataFrame(ranges, "g string, s int, e int, r int")
    both = [(*x, *y[1:]) for x in points for y in ranges if x[0] == y[0] and None not in (x[1], y[1], y[2]) and y[1] <= x[1] <= y[2]]
    for block in (1, 7, 64):
        assert rows(W.in_ranges(p, "at", q, "s", "e", ["g"], block=block)) == sorted(both, key=repr)
    assert rows(W.in_ranges(p, "at", q, "s", "e", ["g"], "left_anti").select("id")) == sorted([(x[2],) for x in points if x not in [y[:3] for y in both]], key=repr)
