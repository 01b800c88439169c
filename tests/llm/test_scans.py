import random
from itertools import product

import pytest

from bindery.llm import correction as C
from bindery.llm import scans as S

WORDS = {"the": 900, "harbour": 400, "barn": 300, "modern": 200, "inspected": 300, "tide-table": 80, "table": 90, "were": 800, "said": 300, "clear": 200, "house": 200, "said.": 1}


def brute(word, vocabulary):
    """Cheapest readings by searching all edits of the word, two confusions or one other edit deep."""
    letters = sorted({c for v in vocabulary for c in v})
    inverse = [(r, p) for p, rs in C.CONFUSIONS.items() for r in rs.split()]

    def confusions(w):
        return {w[:i] + p + w[i + len(r) :] for r, p in inverse for i in range(len(w)) if w.startswith(r, i)}

    cost = {word: 0}
    for w in confusions(word):
        cost.setdefault(w, 1)
    # Two confusions may not overlap; recombining pairs of places of the printed word gives the same set.
    for v in vocabulary:
        if C.Confusions().explained(v, word) == 2:
            cost.setdefault(v, 2)
    for i, c in product(range(len(word) + 1), letters):
        for w in (word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]):
            cost.setdefault(w, 2)
    return {v: cost[v] for v in vocabulary if v in cost}


@pytest.mark.parametrize("word", ["tbe", "harb0ur", "bam", "modem", "mspected", "harbouur", "harbor", "vvere", "wcrc", "sald", "dear", "bouse", "t", "zzzz", "(lear", "ciear", "the"])
def test_automaton_finds_all_candidates(word):
    assert C.Trie(WORDS).candidates(word) == brute(word, WORDS)


def test_judgements():
    trie, ordered = C.Trie(WORDS), sorted(WORDS)
    judge = lambda w, n=1: S.judge(w, n, trie, ordered)[:3]
    assert judge("tbe") == (False, True, False) and judge("the", 900) == (False, False, False)
    assert judge("tbe", 100)[1] is False  # too frequent to be a misreading
    assert judge("(the") == (False, False, False) and judge("(lear") == (False, True, False)
    assert judge("har\0bour") == (True, False, False) and judge("tide\0table") == (False, False, False)
    assert judge("h@r\0bour") == (True, True, False) and judge("har\0b0ur") == (True, False, True)
    assert judge("har\0") == (True, False, False) and judge("tide\0") == (False, False, False)


@pytest.fixture
def texts(spark):
    base = "the modern harbour were inspected\nthe tide-table said the harbour were clear\n" * 40
    page = "THE RIVERS\n12\nthe harb0ur were inspec-\n\nTHE RIVERS\n13\nted the tide-\ntable tbe end of har-"
    rows = [("page", "big", "b", base), ("page", "p", "b", page), ("page", "p", "b", page), ("paragraph", "q", None, "were wcre"), ("page", "n", "b", None), ("page", "e", "b", ""), ("page", "w", "b", "x" * 100_000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "tab string, row_key string, book string, text string, notes int")


@pytest.fixture
def running(spark):
    return spark.createDataFrame([("page", "p", 1), ("page", "p", 5)], "tab string, row_key string, line_no int")


def test_found(texts, running):
    furniture, marked, _ = S.findings(texts, running)
    got = {tuple(r) for r in S.found_lines(furniture, marked).collect()}
    assert got == {
        ("page", "p", 1, "running"),
        ("page", "p", 2, "number"),
        ("page", "p", 3, "misread"),
        ("page", "p", 3, "hyphen"),
        ("page", "p", 5, "running"),
        ("page", "p", 6, "number"),
        ("page", "p", 8, "misread"),
        ("page", "p", 8, "hyphen"),
        ("paragraph", "q", 1, "misread"),
    }


def test_partitions_without_rows(texts, running):
    few = texts.where("row_key = 'q'").repartition(7)
    furniture, marked, _ = S.findings(few, running.limit(0))
    assert S.found_lines(furniture, marked).count() == 0  # a vocabulary of one text knows nothing better


def test_repaired(texts, running):
    got = {r["row_key"]: r["text"] for r in S.repaired(texts, *S.findings(texts, running)).collect()}
    assert got["p"] == "the harbour were inspected the tide-table the end of har"
    assert got["q"] == "were were" and got["n"] is None and got["e"] == "" and len(got["w"]) == 100_000


def test_empty(texts, running):
    furniture, marked, contexts = S.findings(texts.limit(0), running.limit(0))
    assert S.found_lines(furniture, marked).count() == 0


def test_reflow():
    text = "# Head\nOne two\n\nthree. \n\nFour five-\nsix"
    assert S.reflow(text, set(), {6: False}, {}) == "# Head\n\nOne two three.\n\nFour five-six"
    assert S.reflow("Tbe M0DERN end", set(), {}, {1: {"tbe": "the", "m0dern": "modern"}}) == "The MODERN end"


def test_automaton_over_random_words():
    r = random.Random(5)
    word = lambda: "".join(r.choice("clidrn") for _ in range(r.randint(1, 5)))
    vocabulary = dict.fromkeys((word() for _ in range(300)), 1)
    for w in [word() for _ in range(60)]:
        assert C.Trie(vocabulary).candidates(w) == brute(w, vocabulary)


def test_confusions_are_learned_from_two_readings(spark):
    nouns = "house horse hotel honey harbour hammer herring heather hollow hedge".split()
    text = "\n".join(f"the {w} stood here" for w in nouns * 30)
    pairs = spark.createDataFrame([(text, text.replace("the h", "the n"))] * 3 + [("a b", "a"), ("", "x")], "one string, other string")
    known = {w: 90 for w in [*nouns, "the", "stood", "here"]}
    assert S.learned(pairs, spark.sparkContext.broadcast(known)) == [("h", "n")]
    assert S.learned(pairs.limit(0), spark.sparkContext.broadcast(known)) == []
    plain, taught = C.Trie(known), C.Trie(known, confusions=C.Confusions([("h", "n")]))
    assert S.judge("nouse", 1, plain, sorted(known))[1] is False and S.judge("nouse", 1, taught, sorted(known))[1] is True


def test_short_first_words_are_judged_by_the_page_before(spark):
    base = "the modern harbour were inspected and the tide said so\n" * 90
    rows = [("page", "big", base, None, None), ("page", "a", "the modern harb-", "b|1", "b|2"), ("page", "b", "tbe harbour", "b|2", "b|3"), ("page", "c", "tbe harbour", "b|3", "b|4"), ("page", "d", "the modern mod-", "b|4", "b|5"), ("page", "e", "t0 harbour", "b|5", None)]
    texts = spark.createDataFrame(rows, "tab string, row_key string, text string, place string, following string")
    none = spark.createDataFrame([], "tab string, row_key string, line_no int")
    furniture, marked, _ = S.findings(texts, none)
    got = {tuple(r) for r in S.found_lines(furniture, marked).collect()}
    assert got == {("page", "a", 1, "hyphen"), ("page", "c", 1, "misread"), ("page", "d", 1, "hyphen"), ("page", "e", 1, "misread")}
