import random

import pytest

from bindery.llm.splitting import spans, split_long


def check(text, limit, overlap):
    got = spans(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert "".join(text[fresh:end] for _, end, fresh, _ in got) == text
    for (a, b, fresh, _), before in zip(got, [None, *got]):
        assert b - a <= limit and a <= fresh < b
        assert before is None or (fresh == before[1] and before[0] <= a and fresh - a <= overlap)
    return got


@pytest.mark.parametrize("seed", range(25))
def test_any_text_round_trips_under_the_limit(seed):
    r = random.Random(seed)
    alphabet = ["word", "é", "𝒳", " ", " ", ". ", ", ", "\n", "\n\n", "x" * r.randint(1, 90), "-"]
    check("".join(r.choice(alphabet) for _ in range(r.randint(1, 900))), r.choice([40, 100, 257]), r.choice([0, 7, 19]))


def test_cuts_where_the_text_pauses():
    text = "\n\n".join(["One sentence of some length. Another one, with a clause, follows."] * 80)
    got = check(text, 1000, 100)
    assert {k for *_, k in got[:-1]} == {"paragraph"}
    words = " ".join(["word"] * 3000)
    assert {k for *_, k in check(words, 1000, 100)[:-1]} == {"word"}
    assert {k for *_, k in check("x" * 9000, 1000, 100)[:-1]} == {"none"}
    sizes = [b - a for a, b, *_ in check(words, 1000, 100)]
    assert min(sizes) > 0.8 * max(sizes)


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "a" * 12, 9), (1, "a" * 12, 9), (2, "", 9), (3, None, 9), (4, "short", 9)], "id int, text string, piece_no int")
    got = split_long(df, "text", 10, 2)
    assert got.columns == ["id", "text", "piece_no", "piece_start", "piece_end", "piece_fresh", "piece_cut"]
    ids = [r["id"] for r in got.collect()]
    assert (ids.count(1), ids.count(2), ids.count(3), ids.count(4)) == (4, 1, 0, 1)
    assert split_long(df.limit(0), "text", 10, 2).count() == 0
    with pytest.raises(ValueError):
        split_long(df, "text", 10, 5)
