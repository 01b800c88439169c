"""Candidates for misread words: a Levenshtein automaton run over a trie of the vocabulary."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterable
from math import log

# What scanners read (right) for what is printed (left), before anything is learned.
CONFUSIONS = {
    "a": "@",
    "b": "h 6",
    "c": "e (",
    "cl": "d",
    "d": "cl",
    "e": "c €",
    "f": "ſ",
    "fi": "ﬁ",
    "fl": "ﬂ",
    "g": "9",
    "h": "b li",
    "i": "1 l |",
    "in": "m",
    "l": "1 i |",
    "li": "h",
    "m": "rn in",
    "n": "ri",
    "ni": "m",
    "o": "0",
    "q": "9",
    "ri": "n",
    "rn": "m",
    "s": "5 ſ $",
    "t": "†",
    "u": "ii",
    "v": "y",
    "w": "vv",
    "y": "v",
    "z": "2",
}
#: Characters that no word has: each is a misreading wherever it stands between letters.
FOREIGN = frozenset("@€†ſ|($0123456789ﬁﬂ")

#: Cost of a confusion and of any other single edit; the greatest total.
CONFUSED, OTHER, BUDGET = 1, 2, 2
#: Taken from the score of a reading that is likely a misread word itself.
DOUBTED = 1000.0


class Confusions:
    """What is read for what is printed: the fixed pairs and those learned from two readings of the same text."""

    def __init__(self, learned: Iterable[tuple[str, str]] = ()) -> None:
        self.of: dict[str, list[str]] = {p: r.split() for p, r in CONFUSIONS.items()}
        for printed, read in learned:
            if read not in self.of.setdefault(printed, []):
                self.of[printed].append(read)
        self.single = {p: r for p, r in self.of.items() if len(p) == 1}
        self.double: dict[str, list[tuple[str, str]]] = {}
        for p, r in self.of.items():
            if len(p) == 2:
                self.double.setdefault(p[0], []).extend((p[1], x) for x in r)

    def explained(self, printed: str, read: str) -> int | None:
        """The number of confusions that turn ``printed`` into ``read`` (up to two), or None."""
        states = {(0, 0): 0}
        for _ in range(len(printed) + len(read) + 1):
            if (len(printed), len(read)) in states:
                return states[len(printed), len(read)] or None
            after: dict = {}
            for (i, j), cost in states.items():
                if i < len(printed) and j < len(read) and printed[i] == read[j]:
                    after[i + 1, j + 1] = min(cost, after.get((i + 1, j + 1), 9))
                if cost < 2:
                    for size in (1, 2):
                        for r in self.of.get(printed[i : i + size], ()) if i + size <= len(printed) else ():
                            if read.startswith(r, j):
                                k = (i + size, j + len(r))
                                after[k] = min(cost + 1, after.get(k, 9))
                if (i, j) == (len(printed), len(read)):
                    after[i, j] = min(cost, after.get((i, j), 9))
            states = after
        return None

    def search_keys(self, word: str) -> set[str]:
        """The shards (see ``vocabulary_keys``) that hold every candidate of ``word``. Two confusions change the length by up to
        two, and a first letter by the pairs only; another edit leaves no cost for a second, so one at the first letter leaves
        the rest as it is."""
        first = {word[0]} | {p[0] for p, read in self.of.items() if any(word.startswith(r) for r in read)}
        near = {f"{n} {c}" for c in first for n in range(max(1, len(word) - 2), len(word) + 3)}
        return near | {"*" + word, "*" + word[1:]} | ({"*" + word[2:]} if len(word) > 1 else set())


class Trie:
    """The vocabulary as nested dicts; the empty key of a node holds the word that ends there. Where only one word goes on,
    the node is that word itself, so there are about as many nodes as words."""

    def __init__(self, words: dict[str, int], doubted: frozenset = frozenset(), confusions: Confusions | None = None) -> None:
        self.counts, self.doubted, self.confusions = words, doubted, confusions or Confusions()
        self.root: dict = {}
        for w in words:
            node, at = self.root, 0
            while True:
                if at == len(w):
                    node[""] = w
                    break
                below = node.get(w[at])
                if below is None:
                    node[w[at]] = w
                    break
                if isinstance(below, str):  # two words go on here: the one that was alone moves down
                    other: dict = {}
                    other[below[at + 1] if at + 1 < len(below) else ""] = below
                    node[w[at]] = other
                    below = other
                node, at = below, at + 1

    def candidates(self, word: str) -> dict[str, int]:
        """All words of the vocabulary that can be read as ``word`` within the budget, with the cost.

        A state of the automaton is a position in ``word``, the cost so far, and the second letter of
        a printed pair if its first was just taken. States step through the trie letter by letter; a
        branch ends when no state is left.
        """
        n = len(word)
        found: dict[str, int] = {}

        def ends(v: str, states: dict) -> None:
            best = min((cost + OTHER * (n - i) for (i, due), cost in states.items() if not due), default=BUDGET + 1)
            if best <= BUDGET:
                found[v] = min(best, found.get(v, best))

        stack = [(self.root, 0, {(0, ""): 0})]
        while stack:
            node, depth, states = stack.pop()
            if isinstance(node, str):  # the rest of a word that goes on alone
                for c in node[depth:]:
                    if not (states := self._step(word, states, c)):
                        break
                else:
                    ends(node, states)
                continue
            if "" in node:
                ends(node[""], states)
            # With no cost left, only exact continuations remain: follow the word itself.
            if all(cost == BUDGET and not due for (_, due), cost in states.items()):
                letters = {word[i] for i, _ in states if i < n}
            else:
                letters = node.keys()
            for c in letters:
                if c and (below := node.get(c)) is not None:
                    if after := self._step(word, states, c):
                        stack.append((below, depth + 1, after))
        return found

    def _step(self, word: str, states: dict, c: str) -> dict:
        out: dict = {}

        def put(i: int, due: str, cost: int) -> None:
            if cost <= BUDGET and out.get((i, due), BUDGET + 1) > cost:
                out[i, due] = cost

        n = len(word)
        for (i, due), cost in states.items():
            if due:
                if due == c:
                    put(i, "", cost)
                continue
            if i < n and word[i] == c:
                put(i + 1, "", cost)
            if cost < BUDGET:
                for r in self.confusions.single.get(c, ()):
                    if word.startswith(r, i):
                        put(i + len(r), "", cost + CONFUSED)
                for second, r in self.confusions.double.get(c, ()):
                    if word.startswith(r, i):
                        put(i + len(r), second, cost + CONFUSED)
                if cost + OTHER <= BUDGET:
                    put(i, "", cost + OTHER)  # a letter of the vocabulary that wasn't read
                    if i < n and word[i] != c:
                        put(i + 1, "", cost + OTHER)  # another letter was read
                    if i + 1 < n and word[i + 1] == c:
                        put(i + 2, "", cost + OTHER)  # a letter was read that isn't there
        return out


class _Either:
    def __init__(self, *sets: frozenset) -> None:
        self._sets = sets

    def __contains__(self, v: str) -> bool:
        return any(v in x for x in self._sets)


class Overlay:
    """A trie of the broadcast words together with the few others that were found near one word."""

    def __init__(self, trie: Trie, more: dict[str, int], doubted: frozenset) -> None:
        self._parts = (trie, Trie(more, confusions=trie.confusions))
        self.counts, self.doubted, self.confusions = ChainMap(more, trie.counts), _Either(trie.doubted, doubted), trie.confusions

    def candidates(self, word: str) -> dict[str, int]:
        return {v: cost for part in self._parts for v, cost in part.candidates(word).items()}


def vocabulary_keys(v: str) -> list[str]:
    """The shards a word of the vocabulary is in: by length and first letter, and by all but the first letter."""
    return [f"{len(v)} {v[0]}", "*" + v[1:]]


def readings(word: str, count: int, trie: Trie | Overlay, ratio: float) -> list[tuple[str, float]]:
    """All words that ``word`` is more likely a misreading of than itself, as (word, score), the best first.

    Plain letters are doubted only if a word they are confused with, by the fixed pairs or learned ones, is at least
    ``ratio`` times as frequent: an edit that two readings of a text never differed by is no misreading. Any edit
    explains a word that holds a foreign character. Words that are doubted themselves come after all others.
    """
    foreign = not FOREIGN.isdisjoint(word)
    out = []
    for v, cost in trie.candidates(word).items():
        if v == word or trie.counts[v] < (1 if foreign else ratio) * count:
            continue
        confused = trie.confusions.explained(v, word)
        score = log(trie.counts[v]) - DOUBTED * (v in trie.doubted)
        if confused:
            out.append((v, score - 4.0 * confused))
        elif foreign and len(word) > 3:
            out.append((v, score - 9.0 * cost))
    return sorted(out, key=lambda x: (-x[1], x[0]))
