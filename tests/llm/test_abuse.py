import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bindery.llm import abuse as A

FINE = ["The {n} was older than the {m}.", "Nobody could explain why the {n} stood near the {m}.", "She counted the {n} and sold the {m}.", "The great tits nest behind the {n}.", "A {n} led from the {m} to the bridge."]
FOUL = ["You are a filthy {b} and everyone here knows it.", "Go drown yourself, you miserable {b}.", "What kind of {b} scans a book like this?"]
NOUNS = "harbour barn mill lantern church market parish anchor ledger orchard".split()


def corpus(seed, n, noise=0.06):
    r = random.Random(seed)
    docs, truth = [], []
    for _ in range(n):
        bad = r.random() < 0.25
        lines = [r.choice(FINE).format(n=r.choice(NOUNS), m=r.choice(NOUNS)) for _ in range(r.randint(2, 8))]
        if bad:
            word = r.choice(["idiot", "moron", "bastard"])
            word = r.choice([word, word.upper(), word.replace("o", "0"), word[:2] + "​" + word[2:], word[:2] + "*" + word[3:], " ".join(word)])
            lines.insert(r.randrange(len(lines)), r.choice(FOUL).format(b=word))
        truth.append(int(bad))
        docs.append((" ".join(lines), int(bad) ^ (r.random() < noise)))
    return docs, truth


def test_held_out_accuracy_with_wrong_marks():
    model = A.fit(corpus(1, 600)[0])
    docs, truth = corpus(2, 400)
    found = list(model.tops([t for t, _ in docs]) > model.threshold)
    hits = sum(f and t for f, t in zip(found, truth))
    assert hits / sum(truth) > 0.95 and hits / sum(found) > 0.95


def test_kernel_is_the_gapped_subsequence_kernel():
    u = A.Units(["a filthy moron is a filthy moron", "the filthy m.oron", "x"])
    a, b = (list(u.flat[u.start[i] : u.start[i] + u.size[i]]) for i in (0, 1))

    def phi(c):
        out = {}
        padded = [*c, *[0] * A.WINDOW]
        for i in range(len(c)):
            for p in A._PATTERNS:
                key = tuple(padded[i + k] for k in p)
                out[key] = out.get(key, 0) + A.DECAY ** (p[-1] - A.LETTERS + 1)
        return out

    x, y = phi(a), phi(b)
    exact = sum(v * y.get(k, 0) for k, v in x.items()) / (max(len(a), A.PADDED) * max(len(b), A.PADDED)) ** 0.5 / A._ENERGY
    assert abs(A._kernel(u, np.array([1, 2]))[0, 0] - exact) < 1e-5 and abs(A._kernel_one(u, 1)[0] - exact) < 1e-5


def test_disguised_texts_are_found_at_once():
    texts = ["plain words", "You m0ron", "f u c k it", "idioooot", "sh*t", "a b", "", "12 km", "x", "!!!", "é", "so 5ick"]
    basic = [A._basic(t) for t in texts]
    for t, found in zip(basic, A._disguised(basic)):
        assert found or A._undisguised(t) == t


def test_disguises():
    assert A.plain("You м0r0n") == "you moron" and A.plain("f u c k it") == "fuck it" and A.plain("ti*s") == "tis"
    assert A.plain("sh​it") == "shit" and A.plain("idiooooot") == "idiot" and A.plain("Straße é") == "strasse e"
    assert len(A.Units([])) == len(A.Units([None, "", "12 ."])) == 0
    assert len(A.Units(["x" * 5000])) <= 1 and len(A.Units(["ab " * 3000])) > 50
    u = A.Units(["One here. Two!\nThree", None, "Idiot!"])
    assert list(u.owner) == [0, 2] and list(u.size) == [18, 6]
    assert list(A.Units(["A sentence here. No. Another sentence.\n12\nOh"]).size) == [18, 19]


def test_short_passages_are_scored():
    model = A.fit(corpus(1, 600)[0])
    assert A.Model.unpack(model.pack()).tops(["You idiot!"])[0] == model.tops(["You idiot!"])[0]
    tops = model.tops(["You idiot!", "Moron", "Barn", "Yes.", ""])
    assert min(tops[:2]) > max(tops[2:4]) and np.isnan(tops[4])


def test_frame(spark):
    docs = [(i, t) for i, (t, _) in enumerate(corpus(3, 300)[0])]
    marks = [(i, y, "r") for i, (_, y) in enumerate(corpus(3, 300)[0])] + [(0, None, "s"), (1, 0, "s"), (1, 1, "t"), (9999, 1, "r")]
    d = spark.createDataFrame([*docs, (1000, None), (1001, ""), (1002, "ok"), (1003, "fine words " * 20_000)], "doc_id long, text string")
    m = spark.createDataFrame(marks, "doc_id long, toxic int, annotator string")
    model = spark.sparkContext.broadcast(A.fit(A.labelled(d, m)))
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", A.score(F.col("text"), model).alias("s")).collect()}
    assert len(got) == len(docs) + 4 and got[1000]["score"] is None and got[1001]["abusive"] is False and got[1003]["abusive"] is False
    nothing = A.fit(A.labelled(d.limit(0), m))
    assert float(nothing.tops(["some text here"])[0]) < nothing.threshold
    assert isinstance(nothing.weights, np.ndarray)
