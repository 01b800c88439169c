"""The vocabulary of p4 keeps rare words at any size, and the part that isn't broadcast is searched all the same."""

import random

import pytest

from bindery.llm import correction as C
from bindery.llm import scans as S


def test_a_name_of_one_book_is_kept_in_large_inputs(spark):
    words = spark.createDataFrame([("the", 70_000_000), ("melbury", 40), ("h@t", 90), ("cut-", 90), ("twice", 2)], "word string, count long")
    assert S.vocabulary(words) == ({"the": 70_000_000, "melbury": 40}, None)
    known, _ = S.vocabulary(words)
    assert S.judge("meibury", 1, C.Trie(known), sorted(known))[1:] == (True, False, [("melbury", pytest.approx(-0.311, abs=0.001))])


def test_doubted_words_come_last(spark):
    trie = C.Trie({"melbury": 200, "mclbury": 9}, frozenset(["mclbury"]))
    assert [v for v, _ in C.readings("mclb@ry", 1, trie, 20.0)][-1] == "mclbury"
    assert S.judge("mcl\0bury", 1, trie, sorted(trie.counts))[:3] == (True, True, False)


@pytest.mark.parametrize("seed", range(3))
def test_shards_hold_all_candidates(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("clidrnmhbeuvw") for _ in range(r.randint(1, 5)))
    vocabulary = {word() for _ in range(800)}
    shards: dict = {}
    for v in vocabulary:
        for k in C.vocabulary_keys(v):
            shards.setdefault(k, set()).add(v)
    trie = C.Trie(dict.fromkeys(vocabulary, 1))
    for w in [word() for _ in range(300)]:
        near = {v for k in C.Confusions().search_keys(w) for v in shards.get(k, ())}
        assert trie.candidates(w).keys() <= near


@pytest.fixture
def texts(spark):
    base = "the modern harbour were inspected\nthe tide-table said the harbour were clear\n" * 40
    name = "then melbury said the harbour\n" * 30
    page = "the harb0ur were inspec-\nted the tide-\ntable tbe end of har\nmeibury said tide-\nthe me1bury mel-\nbury (lear"
    rows = [("page", "big", "b", base), ("page", "name", "b", name), ("page", "p", "b", page), ("paragraph", "q", None, "were wcre")]
    return spark.createDataFrame(rows, "tab string, row_key string, book string, text string")


@pytest.mark.parametrize("broadcast, part", [(1, 50_000), (4, 1)])
def test_same_result_without_broadcast(spark, texts, monkeypatch, broadcast, part):
    running = spark.createDataFrame([], "tab string, row_key string, line_no int")

    def results():
        noise = S.findings(texts, running)
        return {tuple(r) for r in S.found_lines(*noise[:2]).collect()}, {tuple(r) for r in S.repaired(texts.drop("book"), *noise).collect()}

    want = results()
    assert ("page", "p", 4, "misread") in want[0] and "melbury said" in dict((k, t) for _, k, t in want[1])["p"]
    monkeypatch.setattr(S, "BROADCAST", broadcast)
    monkeypatch.setattr(S, "PART", part)
    assert results() == want
