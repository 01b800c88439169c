import random
import re

import pytest

from bindery.llm import boilerplate as B
from bindery.llm import lines as L
from bindery.llm.scans import Reader

NUMBERS = ["12", "[12]", "- 12 -", "Page 12", "p. 8", "**20**", "8 / 64", "[lO]", "[l4]", "iv", "[iii]", "- l4 -", "Seite 5", "[v]", "--------- Page 123 ---------", "* * * * * * * * 12 * * * * * * * *"]
WORDS = ["", "mild.", "1688.", "a", "dim", "civil", "the", "* * *", "Of 12 ships", "4 crowns", "-----------------------------", "page after page of 1234 and more 12"]


def test_page_numbers():
    assert [L.is_page_number(x) for x in NUMBERS] == [True] * len(NUMBERS)
    assert [L.is_page_number(x) for x in WORDS] == [False] * len(WORDS)


def test_keys_survive_print_and_scan():
    same = ["The Lower Rivers", "THE LOWER  RIVERS ~", "8  T h e   L o w e r   R i v e r s", "The L0wer Riv€rs   12", "**Tbe Lowcr Rivers**"]
    assert len({L.line_keys(x)[0] for x in same}) == 1
    assert L.line_keys("Scanned on 3.4.2024 at 5") == L.line_keys("Scanned on 25.12.2024 at 9")
    assert L.line_keys("a\n\n7") == ["a", "", ""]
    assert L.line_keys("Дом на горе")[0] != L.line_keys("Лес у реки")[0] != ""


def test_only_lines_that_may_be_numbers_are_looked_at(monkeypatch):
    """Page texts are mostly long lines of words: of these none is held against the forms of page numbers."""
    prose = [f"It was said in the {w} that the rivers had been examined by it." for w in ("town", "vestry", "forêt", "дом")] * 20
    text = "\n".join([*prose, *NUMBERS, "", "  ", *WORDS])
    want = [L.is_page_number(x) for x in text.split("\n")]
    seen = []
    real = L.is_page_number
    monkeypatch.setattr(L, "is_page_number", lambda x: seen.append(x) or real(x))
    kinds = Reader(frozenset(), frozenset()).layout(text, set())[1]
    assert [k == "number" for k in kinds] == want and sum(want) == len(NUMBERS)
    assert not set(seen) & set(prose) and len(seen) < 40
    no_marks = [chr(i) for i in range(0x110000) if re.match(f"[{L.LETTER_RANGES}]", chr(i))]
    assert len(no_marks) > 30_000 and not any(re.match(r"[\W_]", c) for c in no_marks)


@pytest.mark.parametrize("seed", range(3))
def test_long_lines_are_no_numbers(seed):
    r = random.Random(seed)
    parts = [*NUMBERS, *WORDS, " ", "  ", "\t", "\n", "\n", "_", "—", "é", "٣٤", "\x1f", "ß", "xviii", "of 64"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        lines = text.split("\n")
        long = L.long_lines(text, lines)
        assert len(long) == len(lines) and not any(n and (L.is_page_number(x) or not x.strip()) for n, x in zip(long, lines))


def test_keyed_lines_of_several_fields_and_kinds_of_ids(spark, rows):
    docs = spark.createDataFrame([("b", 7, "One line\n12\nother", None), ("c", 8, "", "Last é"), ("b", None, "x y z", "x"), (None, 9, "x y z", "x")], "book string, page long, head string, body string")
    got = rows(B.keyed_lines(docs, ["book", "page"], ["head", "body"]).drop("h"))
    key = lambda x: L.line_keys(x)[0]
    assert got == sorted([("b", 7, "head", 1, key("One line")), ("b", 7, "head", 3, key("other")), ("c", 8, "body", 1, key("Last é"))], key=repr)
    assert B.keyed_lines(docs.limit(0), ["book", "page"], ["head", "body"]).count() == 0


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x") for p in pages], "book string, page string, head string, body string, hub string")


@pytest.fixture
def book(spark):
    texts = []
    for i in range(12):
        head = ["The Lower Rivers", "THE LOWER RIVERS", "The Low3r Rivers", "Tne Lower Rivers"][i % 4]
        stamp = "Property of the Reading Room\nDo not remove" if i < 9 else "x"
        texts.append(("b", f"p{i}", head, f"{stamp}\nOnly here number {'abcdefghijkl'[i] * 5}\n{i}"))
    texts += [texts[0], ("b", "q", None, ""), ("b", None, "The Lower Rivers", "x"), (None, "z", "The Lower Rivers", "x")]
    texts += [("c", f"c{i}", "The Lower Rivers", "So ran the tide") for i in range(7)]
    return frame(spark, texts)


def test_repeated_lines(spark, rows, book):
    found, hubs = B.repeated_lines(book, ["head", "body"])
    got = {(r["page"], r["field"], r["line_no"]) for r in found.collect()}
    want = {(f"p{i}", "head", 1) for i in range(12)} | {(f"p{i}", "body", n) for i in range(9) for n in (1, 2)}
    assert got == want
    assert hubs.count() == 3 and {r["book"] for r in hubs.collect()} == {"b"}
    blocks = {r["hub"]: r["block"] for r in B.blocks(found).collect()}
    assert len(set(blocks.values())) == 2
    clean = {r["page"]: (r["head"], r["body"]) for r in B.without_lines(book.where("book is not null"), found, ["head", "body"]).collect()}
    assert clean["p0"] == ("", "Only here number aaaaa\n0") and clean["q"] == (None, "") and clean["c1"] == ("The Lower Rivers", "So ran the tide")


def test_same_result_with_a_full_filter(rows, book, monkeypatch):
    want = rows(B.repeated_lines(book, ["head", "body"])[0])
    monkeypatch.setattr(B, "BROADCAST_HASHES", -1)
    assert rows(B.repeated_lines(book, ["head", "body"])[0]) == want
    monkeypatch.setattr(B, "BITS", 15)
    assert rows(B.repeated_lines(book, ["head", "body"])[0]) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_all_copies_are_found_whatever_their_ends(spark, seed):
    """Copies with so many edits as allowed, at any place, both ends always among them where there are two."""
    r = random.Random(seed)
    letters = "acdefgmnopruwxyz"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    hubs = [word(r.choice([3, 6, 9, 14, 20, 33, 60, 150])) for _ in range(40)]
    lines, want = [], set()
    for n, hub in enumerate(hubs):
        for k in range(6):
            key, left, shift = list(hub), L.allowed(len(hub)), 0
            places = [0, len(hub) - 1, *r.sample(range(len(hub)), min(left, len(hub)))][:left]
            for at in sorted(places, reverse=True):
                how = r.choice("sid") if abs(shift) < L.SHIFT else "s"
                shift += {"s": 0, "i": 1, "d": -1}[how]
                key[at : at + (how != "i")] = [] if how == "d" else [r.choice(letters)]
            lines.append(("b", f"{n} {k}", "x", 1, "".join(key)))
            want.add((f"{n} {k}", hub))
        lines.append(("c", f"{n} other", "x", 1, hub))
    lines += [("b", f"far {n}", "x", 1, word(20)) for n in range(50)]
    df = spark.createDataFrame(lines, "book string, page string, field string, line_no int, key string").selectExpr("*", "xxhash64(book, key) h")
    known = spark.createDataFrame([("b", h, 9) for h in hubs], "source string, hub string, pages long")
    got = {(x["page"], x["hub"]) for x in B.copies(df, known).collect()}
    keys = {x[1]: x[4] for x in lines}
    assert all(edits(keys[p], h) <= L.allowed(len(h)) for p, h in got)
    found = {p for p, _ in got}
    assert {p for p, _ in want} <= found and not any(p.startswith("far") or p.endswith("other") for p in found)


@pytest.mark.parametrize("seed", range(3))
def test_leaders_are_those_of_a_greedy_choice(spark, seed):
    r = random.Random(seed)
    hubs = {("b", "".join(r.choice("ab") for _ in range(7))): r.randint(2, 9) for _ in range(40)} | {("c", "aaaaaaa"): 2}
    stay = []
    for (source, hub), pages in sorted(hubs.items(), key=lambda x: (-x[1], x[0][1])):
        if not any(s == source and edits(hub, h) <= L.allowed(len(h)) for s, h in stay):
            stay.append((source, hub))
    df = spark.createDataFrame([(*k, v) for k, v in hubs.items()], "source string, hub string, pages long")
    df = B.numbered(df)
    assert {(x["source"], x["hub"]) for x in B.leaders(df, B.hub_pieces(df)).collect()} == set(stay)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] if seed == 0 else [(r.randint(0, 80), r.randint(0, 80)) for _ in range(55)]
    edges = [(a, b) for a, b in edges if a != b]
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {x["node"]: x["least"] for x in B.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == least


def test_empty(book):
    found, hubs = B.repeated_lines(book.limit(0), ["head", "body"])
    assert found.count() == 0 and hubs.count() == 0 and B.blocks(found).count() == 0
