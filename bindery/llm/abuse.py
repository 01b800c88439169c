"""Scoring abusive, hateful and sexual passages with a subsequence-kernel SVM (p9)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and signs used in their place.
_ALIKE = dict(
    zip(
        "аеоросухіјԁԛѕһԝгкмтвнЬαβεικνορτυχ",
        "aeopocyxijdqshwrkmtbhbabeiknoptux",
    )
)
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "+": "t"}
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_SIGNED = re.compile(r"(?<=[^\W\d_])[0-9@$!€+]+(?=[^\W\d_])|(?<![\w@$])[0-9@$€+](?=[^\W\d_]{2})|(?<![\w@$+])[+1!@$][+1!@$0-9]{2,4}(?![\w@$+])")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*'’]{1,2}){2,}[^\W\d_](?![^\W\d_])")
_MASKED = re.compile(r"(?<=[^\W\d_])[*.\-_#+~'’]+(?=[^\W\d_])")
_LONG = re.compile(r"(.)\1{2,}")
_OTHER = re.compile(r"[^\x00-\x7f]")
_UNIT = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|\n+")

#: Subsequences of so many letters within so long a window; each gap costs this factor.
LETTERS, WINDOW, DECAY = 4, 6, 0.5
_PATTERNS = [(0, *c) for c in combinations(range(1, WINDOW), LETTERS - 1)]
_WEIGHTS = [DECAY ** (p[-1] - LETTERS + 1) for p in _PATTERNS]
_ENERGY = sum(w * w for w in _WEIGHTS)
SPACE = 1 << (5 * LETTERS)
#: Longer sentences are looked at through windows of this length and step.
SPAN, STEP = 85, 20
#: Shorter sentences are joined to a neighbour. Where there is none, they are scored, but say too little to learn from. What is
#: shorter than PADDED is scored as if blanks made it so long, else a word that is part of abuse would stand for all of it.
TAUGHT, PADDED = 8, 24
#: Weight of the errors against the norm.
REGULARITY = 200.0
#: Parts of the sample that are scored by a fit without them, for the threshold.
FOLDS = 5
#: The sample holds about so many times more abuse than the documents: a wrong find counts as so many for the threshold.
RARER = 5
#: A text like none of the sample scores the bias; the threshold keeps so far above it if it can.
CLEAR = 0.25
#: The bounded sample the classifier is fitted on: so many documents marked 1 and 0, and so many of their sentences.
POSITIVE_DOCS, NEGATIVE_DOCS, LANDMARKS = 2000, 4000, 256
POSITIVE_SENTENCES, NEGATIVE_SENTENCES = 24_000, 12_000
#: Positions worked on at once, so that what is made of them stays in the processor's cache.
BLOCK = 1 << 14


def _basic(text: str) -> str:
    """Text without hidden characters and accents, in lower case, letters of other scripts as those they look like."""
    t = _HIDDEN.sub("", text)
    if t.isascii():
        return t.lower()
    t = unicodedata.normalize("NFKD", t).casefold()
    return _OTHER.sub(lambda m: _ALIKE.get(m[0], "" if unicodedata.combining(m[0]) else m[0]), t)


def _undisguised(t: str) -> str:
    t = _SPACED.sub(lambda m: "".join(c for c in m[0] if c.isalpha()), t)
    t = _SIGNED.sub(lambda m: "".join(_SIGNS.get(c, "") for c in m[0]), t)
    t = _MASKED.sub("", t) if any(c in t for c in "*_#+~") else t
    return _LONG.sub(r"\1", t)


def plain(text: str) -> str:
    """Text with disguises taken off: hidden characters, letters of other scripts, signs for letters,
    letters set apart, masked by marks or drawn out."""
    return _undisguised(_basic(text))


#: What a character is to the look for disguises: 0 a letter (also any that isn't known), 1 a sign for a letter or a mark
#: that masks, 2 anything else.
_KIND = np.zeros(0x3000, dtype=np.uint8)
for _c in range(0x3000):
    if not chr(_c).isalpha():
        _KIND[_c] = 1 if chr(_c) in "0123456789@$!€+*_#~" else 2


def _disguised(texts: list[str]) -> np.ndarray:
    """Which of some basic texts may hold signs for letters, letters set apart or drawn out; all others are as ``_undisguised``
    would leave them. Looked up for all texts at once, since the patterns themselves are slow."""
    raw = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
    if len(raw) < 3:
        return np.ones(len(texts), dtype=bool)
    kind = _KIND[np.minimum(raw, 0x2FFF)]
    letter, sign = kind == 0, kind == 1
    hit = np.zeros(len(raw), dtype=bool)
    hit[1:-1] = (raw[1:-1] == raw[:-2]) & (raw[1:-1] == raw[2:])  # drawn out
    hit[1:] |= sign[1:] & letter[:-1]
    hit[:-1] |= sign[:-1] & letter[1:]
    hit[1:-1] |= sign[:-2] & sign[1:-1] & sign[2:]
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    at = np.flatnonzero(alone)
    hit[at[2:][(at[2:] - at[1:-1] <= 3) & (at[1:-1] - at[:-2] <= 3)]] = True
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = np.zeros(len(texts), dtype=bool)
    out[np.searchsorted(ends, np.flatnonzero(hit), side="right")] = True
    return out


_CODES = np.zeros(0x300, dtype=np.int32)
_CODES[97:123] = np.arange(1, 27)


def _joined(parts: list[str]) -> list[str]:
    """Sentences, with those too short to judge alone put to the one before them, or else to the one after."""
    if len(parts) < 2 or min(map(len, parts)) >= TAUGHT:
        return parts
    out: list[str] = []
    for x in parts:
        if out and (len(x) < TAUGHT or len(out[-1]) < TAUGHT):
            out[-1] = f"{out[-1]} {x}" if x else out[-1]
        else:
            out.append(x)
    return out


class Units:
    """The sentences of some texts, long ones as overlapping windows, as stretches of one line of codes: letters as 1 to 26,
    runs of anything else as one 0, other letters as 27 to 31. Sentences lie ``WINDOW`` zeros apart. Sentences of fewer than
    ``TAUGHT`` characters are put to a neighbour, if there is one; what has no letters is left out; ``owner`` is the
    text each is of."""

    def __init__(self, texts: list[str | None]) -> None:
        basic = [_basic(t) if t else "" for t in texts]
        for i in np.flatnonzero(_disguised(basic)) if basic else ():
            basic[i] = _undisguised(basic[i])
        parts = [_joined(_UNIT.split(t)) for t in basic]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        gap = "\0" * WINDOW
        raw = np.frombuffer(gap.join([gap, *(x.replace("\0", " ") for p in parts for x in p), ""]).encode("utf-32-le"), dtype=np.uint32)
        code = _CODES[np.minimum(raw, 0x2FF)]
        far = raw > 0x2FF
        code[far] = 27 + raw[far] % 5
        code[raw == 0] = -1
        keep = code != 0
        keep[1:] |= code[:-1] != 0
        code = code[keep]
        stop = np.flatnonzero(code < 0).reshape(-1, WINDOW)
        start, size = stop[:-1, -1] + 1, stop[1:, 0] - stop[:-1, -1] - 1
        code[code < 0] = 0
        letters = np.concatenate([[0], np.cumsum(code != 0)])
        # The join puts two gaps, and so an empty part, before the first.
        start, size = start[len(start) - len(owner) :], size[len(size) - len(owner) :]
        use = letters[start + size] > letters[start]
        start, size, owner = start[use], size[use], owner[use]
        windows = np.where(size > SPAN + STEP, -(-(size - SPAN + STEP) // STEP), 1)
        which = np.repeat(np.arange(len(start)), windows)
        step = (np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)) * STEP
        whole = windows[which] == 1
        self.flat = code
        self.start = start[which] + step
        self.size = np.where(whole, size[which], np.minimum(SPAN, size[which] - step))
        self.owner = owner[which]

    def __len__(self) -> int:
        return len(self.start)

    def only(self, rows: np.ndarray) -> Units:
        out = object.__new__(Units)
        out.flat, out.start, out.size, out.owner = self.flat, self.start[rows], self.size[rows], self.owner[rows]
        return out

    def compact(self) -> Units:
        """The same units on a line without what lies between them."""
        edges = np.zeros(len(self.flat) + 1, dtype=np.int32)
        np.add.at(edges, self.start, 1)
        np.add.at(edges, self.start + self.size + WINDOW, -1)
        inside = np.cumsum(edges[:-1]) > 0
        out = self.only(np.arange(len(self)))
        out.flat = np.concatenate([self.flat[inside], np.zeros(WINDOW, dtype=self.flat.dtype)])
        out.start = (np.cumsum(inside) - 1)[self.start]
        return out


def _grams(flat: np.ndarray, first: int, last: int) -> Iterator[tuple[float, np.ndarray]]:
    """Of each pattern its weight, and the number of the subsequence that begins at each position from ``first`` to ``last``."""
    f = flat[first : last + WINDOW]
    n = last - first
    a, b, c = f[:n] << 15, f << 10, f << 5
    for p, w in zip(_PATTERNS, _WEIGHTS):
        yield w, a | b[p[1] : p[1] + n] | c[p[2] : p[2] + n] | f[p[3] : p[3] + n]


def features(u: Units, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of all gapped subsequences that begin in a unit, scaled to about unit length."""
    parts = list(_grams(u.flat, u.start[i], u.start[i] + u.size[i]))
    weights = np.array([w for w, _ in parts]) / (max(u.size[i], PADDED) * _ENERGY) ** 0.5
    return np.concatenate([ids for _, ids in parts]), np.repeat(weights, u.size[i])


def _summed(u: Units, table: np.ndarray) -> np.ndarray:
    """The sum over each unit of its subsequences' weights times their entries in ``table``."""
    n = len(u.flat) - WINDOW
    total = np.zeros(n + 1)
    for at in range(0, n, BLOCK):
        end = min(at + BLOCK, n)
        here = np.zeros(end - at, dtype=np.float32)
        for w, ids in _grams(u.flat, at, end):
            here += np.float32(w) * table[ids]
        total[at + 1 : end + 1] = here
    np.cumsum(total, out=total)
    return total[u.start + u.size] - total[u.start]


class Model:
    """A decision function: one weight for each subsequence, and the threshold for documents.

    The Nyström approximation's function, a combination of kernel values with the landmarks, is a
    linear function of the subsequences, so the landmarks' vectors are added up once and scoring
    a text costs the same whatever their number. A long sentence is summed up once, and its windows are
    differences of the running sum.
    """

    def __init__(self, weights: np.ndarray, bias: float, threshold: float = 0.0) -> None:
        self.weights, self.bias, self.threshold = weights.astype(np.float32), bias, threshold

    def scores(self, u: Units) -> np.ndarray:
        return _summed(u, self.weights) / np.sqrt(np.maximum(u.size, PADDED) * _ENERGY) + self.bias if len(u) else np.empty(0)

    def tops(self, texts: list[str | None]) -> np.ndarray:
        """The highest score of each text's sentences; NaN for texts without letters."""
        u = Units(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, u.owner, self.scores(u))
        return np.where(np.isinf(out), np.nan, out)

    def pack(self) -> bytes:
        return np.array([self.bias, self.threshold], dtype="<f8").tobytes() + self.weights.astype("<f4").tobytes()

    @staticmethod
    def unpack(data: bytes) -> Model:
        bias, threshold = np.frombuffer(data, "<f8", 2)
        return Model(np.frombuffer(data, "<f4", SPACE, 16), float(bias), float(threshold))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float) -> np.ndarray:
    """Linear squared-hinge SVM by Newton steps; the last column of z is the bias."""
    w = np.zeros(z.shape[1])
    loss = np.inf
    for _ in range(40):
        active = y * (z @ w) < 1
        za, wa = z[active], weight[active]
        h = np.eye(len(w)) + 2 * c * (za * wa[:, None]).T @ za
        new = np.linalg.solve(h, 2 * c * za.T @ (wa * y[active]))
        margin = np.maximum(0, 1 - y * (z @ new))
        now = new @ new / 2 + c * (weight * margin**2).sum()
        if now > loss - 1e-6 * abs(loss):
            break
        w, loss = new, now
    return w


def _valley(x: np.ndarray) -> float:
    """Where to part numbers into two groups so that both vary least within."""
    x = np.sort(x)
    n = np.arange(1, len(x))
    if not len(n):
        return float(x[0]) - 1.0
    sums, squares = np.cumsum(x)[:-1], np.cumsum(x * x)[:-1]
    spread = squares - sums**2 / n + ((x * x).sum() - squares) - (x.sum() - sums) ** 2 / (len(x) - n)
    k = int(np.argmin(spread))
    return float(x[k] + x[k + 1]) / 2


def _kernel(u: Units, chosen: np.ndarray, block: int = 16) -> np.ndarray:
    """Kernel values of all units with the chosen ones, whose vectors lie side by side in blocks. Only subsequences that a
    block has are looked up in it; a table of bits tells them."""
    out = np.empty((len(u), len(chosen)), dtype=np.float32)
    order = np.argsort(u.start, kind="stable")
    start, size = u.start[order], u.size[order]
    reach = int(size.max(initial=0))
    table = np.zeros((SPACE, block), dtype=np.float32)
    has = np.zeros(SPACE, dtype=bool)
    for first in range(0, len(chosen), block):
        own = chosen[first : first + block]
        used = []
        for j, i in enumerate(own):
            ids, w = features(u, i)
            np.add.at(table[:, j], ids, w.astype(np.float32))
            used.append(ids)
        for ids in used:
            has[ids] = True
        at = 0
        while at < len(start):
            low = start[at]
            end = int(np.searchsorted(start, low + BLOCK))
            high = min(low + BLOCK + reach, len(u.flat) - WINDOW)
            total = np.zeros((high - low + 1, block), dtype=np.float32)
            for w, ids in _grams(u.flat, low, high):
                hit = np.flatnonzero(has[ids])
                total[hit + 1] += np.float32(w) * table[ids[hit]]
            np.cumsum(total, axis=0, out=total)
            a = start[at:end] - low
            sums = total[a + size[at:end]] - total[a]
            out[order[at:end], first : first + len(own)] = (sums / np.sqrt(np.maximum(size[at:end], PADDED) * _ENERGY)[:, None])[:, : len(own)]
            at = end
        for ids in used:
            table[ids] = 0
            has[ids] = False
    return out


def fit(docs: list[tuple[str, int]], seed: int = 7) -> Model:
    """A model from documents marked 1 (at least one abusive passage) or 0 (none); marks may be wrong.

    Marks are of documents, the SVM needs labelled sentences. They come from how much more often a
    sentence's subsequences occur in other documents marked 1 than in others marked 0, which wrong
    marks of some don't change: sentences of documents marked 1 that lie well above nearly all of
    documents marked 0 are positive, those that lie among them negative, the rest say nothing. Half
    of the landmarks are positive sentences, a quarter the likest of the others. The threshold is the
    one nearest to 0 (or to ``CLEAR`` above the bias) of those with about the best F1 on the documents, each
    scored by one of ``FOLDS`` fits without it. Of their sentences at most ``POSITIVE_SENTENCES`` and ``NEGATIVE_SENTENCES`` are used.
    """
    rng = np.random.default_rng(seed)
    nothing = Model(np.zeros(SPACE, dtype=np.float32), -1.0)
    u = Units([t for t, _ in docs])
    u = u.only(np.flatnonzero(u.size >= TAUGHT))
    marks = np.array([y for _, y in docs], dtype=int)
    mark = marks[u.owner] if len(u) else np.empty(0, dtype=int)
    if not (mark == 1).any() or not (mark == 0).any():
        return nothing
    first = _first_scores(u, mark)
    taken = [(np.flatnonzero(mark == y), most) for y, most in ((0, NEGATIVE_SENTENCES), (1, POSITIVE_SENTENCES))]
    taken = np.sort(np.concatenate([rng.choice(x, most, replace=False) if len(x) > most else x for x, most in taken]))
    u, mark, first = u.only(taken).compact(), mark[taken], first[taken]
    bags = np.unique(u.owner)
    bag = np.searchsorted(bags, u.owner)
    fold = rng.permutation(len(bags)) % FOLDS
    pos, neg = np.flatnonzero(mark == 1), np.flatnonzero(mark == 0)
    half = LANDMARKS // 2

    def draw(of: np.ndarray, most: int) -> np.ndarray:
        return rng.choice(of, min(most, len(of)), replace=False)

    high = np.quantile(first[neg], 0.98)
    bound = max(_valley(first[pos]), high)
    y = np.where((mark == 1) & (first > bound), 1.0, -1.0)
    if not (y > 0).any():
        y[pos[np.argmax(first[pos])]] = 1.0
    use = (y > 0) | ((first <= bound) & ((mark == 0) | (first <= high)))
    near = neg[np.argsort(-np.where(use[neg], first[neg], -np.inf))][: 4 * half]
    chosen = np.unique(
        np.concatenate(
            [_spread(u, np.flatnonzero(y > 0), half), draw(near, half // 2), draw(neg[use[neg]], LANDMARKS - half - half // 2)]
        )
    )
    root, z = _space(u, chosen)

    def solve(rows: np.ndarray) -> np.ndarray:
        share = max(1e-3, (y[rows] > 0).mean())
        weight = np.where(y > 0, min(10.0, (1 - share) / share), 1.0)
        return _svm(z[rows], y[rows], weight[rows] / weight[rows].sum(), REGULARITY)

    w = solve(use)
    weights = np.zeros(SPACE)
    for i, a in zip(chosen, root @ w[:-1]):
        ids, v = features(u, i)
        np.add.at(weights, ids, a * v)
    model = Model(weights, float(w[-1]))
    s = np.empty(len(u))
    for k in range(FOLDS):
        out = fold[bag] == k
        if (use & ~out & (y > 0)).any():
            s[out] = z[out] @ solve(use & ~out)
        else:
            s[out] = -1.0
    tops = np.full(len(bags), -np.inf)
    np.maximum.at(tops, bag, s)
    own = marks[bags] == 1
    if own.sum() >= 5:
        grid = np.linspace(-0.8, 0.8, 65)
        right, wrong = (np.array([((tops > g) & x).sum() for g in grid]) for x in (own, ~own))
        f1 = 2 * right / np.maximum(1, right + RARER * wrong + own.sum())
        good = grid[f1 >= f1.max() - 0.01]
        model.threshold = float(good[np.argmin(np.abs(good - max(0.0, model.bias + CLEAR)))])
    return model


def _spread(u: Units, among: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` units that together come close to all of ``among``: each next one is the unit the
    chosen ones explain least (pivoted Cholesky decomposition of the kernel matrix)."""
    own = u.only(among).compact()
    left = np.empty(len(own))
    for i in range(len(own)):
        ids, w = features(own, i)
        _, at = np.unique(ids, return_inverse=True)
        left[i] = (np.bincount(at, weights=w) ** 2).sum()
    columns: list[np.ndarray] = []
    chosen: list[int] = []
    while len(chosen) < min(most, len(among)) and left.max() > 1e-3:
        j = int(np.argmax(left))
        column = _kernel_one(own, j) - sum((c * c[j] for c in columns), np.zeros(len(among)))
        column /= max(column[j], 1e-9) ** 0.5
        columns.append(column)
        chosen.append(j)
        left = left - column**2
        left[j] = 0.0
    return among[chosen]


def _kernel_one(u: Units, landmark: int) -> np.ndarray:
    ids, w = features(u, landmark)
    table = np.zeros(SPACE, dtype=np.float32)
    np.add.at(table, ids, w.astype(np.float32))
    return Model(table, 0.0).scores(u)


def _space(u: Units, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Nyström map of the landmarks: the inverse root of their kernel matrix, and all units mapped
    by it, with a column of ones for the bias."""
    k = _kernel(u, chosen)
    values, basis = np.linalg.eigh((k[chosen] + k[chosen].T).astype(np.float64) / 2)
    good = values > 1e-3 * values.max()
    root = basis[:, good] / np.sqrt(values[good])
    return root, np.hstack([k @ root, np.ones((len(u), 1))])


def _first_scores(u: Units, mark: np.ndarray) -> np.ndarray:
    """Mean log odds of each unit's subsequences between other documents marked 1 and marked 0."""
    counts = np.zeros((2, SPACE), dtype=np.float32)
    edges = np.flatnonzero(np.diff(u.owner, prepend=-1, append=-1))
    for i, j in zip(edges[:-1], edges[1:]):  # the units of a document lie one behind the other
        first, last = u.start[i], int((u.start[i:j] + u.size[i:j]).max())
        counts[mark[i], np.unique(np.concatenate([ids for _, ids in _grams(u.flat, first, last)]))] += 1
    docs = [len(np.unique(u.owner[mark == m])) for m in (0, 1)]
    # As if every subsequence had been met in half a document more, split as the documents are.
    prior = 0.5 / sum(docs)
    out = np.empty(len(u))
    for m in (0, 1):  # a document says nothing of its own sentences
        one, none = np.maximum(counts[1] - m, 0), np.maximum(counts[0] - (1 - m), 0)
        odds = np.log((one + prior * docs[1]) / max(1, docs[1] - m)) - np.log((none + prior * docs[0]) / max(1, docs[0] - 1 + m))
        rows = np.flatnonzero(mark == m)
        own = u.only(rows)
        out[rows] = _summed(own, odds.astype(np.float32)) / (own.size * sum(_WEIGHTS))
    return out


def labelled(docs: DataFrame, marks: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample of marked documents ``(text, mark)`` for ``fit``.

    Null marks are ignored; a document whose reviewers disagree in equal numbers is left out. Of
    either mark, the documents with the least hashes of their ids are taken, up to ``POSITIVE_DOCS``
    and ``NEGATIVE_DOCS``.
    """
    votes = (
        marks.where("toxic is not null")
        .groupBy("doc_id")
        .agg(F.avg("toxic").alias("share"))
        .where("share <> 0.5")
        .select("doc_id", (F.col("share") > 0.5).cast("int").alias("mark"), F.xxhash64("doc_id").alias("h"))
    )
    parts = [
        votes.where(F.col("mark") == m).orderBy("h", "doc_id").limit(n) for m, n in ((1, POSITIVE_DOCS), (0, NEGATIVE_DOCS))
    ]
    sample = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").where("text is not null").join(sample, "doc_id").orderBy("h", "doc_id").collect()
    return [(r["text"], r["mark"]) for r in rows]


def score(text: Column, model) -> Column:
    """``struct<score double, abusive boolean>`` of each text by a broadcast model: the highest score of
    its sentences, however short. Null and empty texts and those without letters have a null score and aren't abusive."""

    @F.pandas_udf("struct<score:double,abusive:boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        m = model.value
        tops = np.concatenate([m.tops(list(texts[i : i + 1000])) for i in range(0, len(texts), 1000)] or [np.empty(0)])
        none = np.isnan(tops)
        scores = pd.arrays.FloatingArray(np.where(none, 0.0, tops), none)
        return pd.DataFrame({"score": scores, "abusive": ~none & (np.where(none, 0.0, tops) > m.threshold)})

    return run(text)
