"""Repairing text read from scanned pages (p4)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from . import lines as L
from .correction import FOREIGN, Confusions, Overlay, Trie, readings, vocabulary_keys

#: Signs at the end of a line that a word is cut there.
HYPHENS = "-‐¬\xad"
_OUTER = ".,;:!?\"'“”„‘’»«*#~[]{}—–_)…¡¿"
#: A word of the vocabulary occurs so often in all, whatever the input's size.
LEAST = 4
#: Words of the vocabulary that are broadcast, the most frequent; words of a shard's part that are searched at once.
BROADCAST, PART = 200_000, 50_000
#: Plain letters are doubted if another word is so many times as frequent.
RATIO = 20.0
#: Readings whose scores lie so near the best are told apart by the word before: one that is 400 times less likely by itself isn't
#: taken for what it stands beside.
MARGIN = 6.0
#: An edit between two readings of the same text is a confusion if it occurs in so many different words and is so great a part of
#: all such edits.
LEARNED_WORDS, LEARNED_SHARE = 8, 0.002
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|er|e|ère|º|ª|s)?", re.I)
_ENDED = re.compile(r"[.!?:;…*]['\"”’»)\]*]*$")
_CUT = "\0"


def core(token: str) -> str:
    """A token in lower case without outer marks; an opening bracket may be a misread c and stays."""
    return token.lower().strip(_OUTER)


def is_word(w: str) -> bool:
    return any(c.isalpha() for c in w) and not _ORDINAL.fullmatch(w)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, count`` over all texts; words cut at a line's end aren't counted in their parts."""

    def count(batches):
        tokens: Counter = Counter()

        def flush():
            words: Counter = Counter()
            for t, n in tokens.items():
                if _CUT not in t and is_word(w := core(t)):
                    words[w] += n
            tokens.clear()
            return pd.DataFrame(list(words.items()), columns=["word", "count"])

        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    text = text.lower()
                    for c in HYPHENS:
                        if c in text:
                            text = text.replace(c + "\n", _CUT)
                    tokens.update(text.split())
            if len(tokens) > 500_000:
                yield flush()
        yield flush()

    return texts.select("text").mapInPandas(count, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def vocabulary(words: DataFrame) -> tuple[dict[str, int], DataFrame | None]:
    """The words that occur often enough to be taken as printed: the most frequent with their counts, and the
    others, if there are more than may be broadcast, as ``word, count``. Misread forms of frequent words are
    among them; ``verdicts`` tells them by the still more frequent word."""
    odd = "[" + re.escape("".join(sorted(FOREIGN))) + "]"
    ends = "[" + re.escape(HYPHENS) + "]$"
    kept = words.where((F.col("count") >= LEAST) & (F.col("word") != "") & ~F.col("word").rlike(odd) & ~F.col("word").rlike(ends))
    order = [F.desc("count"), F.asc("word")]
    head = kept.orderBy(*order).limit(BROADCAST + 1).collect()
    rest = None
    if len(head) > BROADCAST:
        last = head[BROADCAST - 1]
        rest = kept.where((F.col("count") < last["count"]) | ((F.col("count") == last["count"]) & (F.col("word") > last["word"])))
    return {r["word"]: r["count"] for r in head[:BROADCAST]}, rest


def _probes(word: str) -> list[str]:
    """What is looked up in the vocabulary to judge a word or cut word."""
    if _CUT not in word:
        return [word, word[1:]] if word[0] == "(" and len(word) > 1 else [word]
    a, b = word.split(_CUT)
    return [x for x in (a, b, a + b, f"{a}-{b}") if x] if b else []


def learned(pairs: DataFrame, vocab) -> list[tuple[str, str]]:
    """Confusions (printed, read) shown by ``pairs(one, other)``, two readings each of the same text.

    Lines of equal length in words are held side by side. Where a word differs and only one of its forms is in the
    vocabulary, or is ``RATIO`` times as frequent, that one was printed; what is left without the common beginning and end
    is the edit. Counted over all pairs, by edit and word; edits of up to two letters for one or two are looked at. The result
    is bounded by the pairs of letters that can reach the share.
    """

    def run(batches):
        known = vocab.value
        for pdf in batches:
            seen: Counter = Counter()
            for one, other in zip(pdf["one"], pdf["other"]):
                a, b = one.split("\n"), other.split("\n")
                if len(a) != len(b):
                    continue
                for x, y in zip(a, b):
                    if x != y and len(xs := x.split()) == len(ys := y.split()):
                        for v, w in zip(xs, ys):
                            if v != w and (v := core(v)) != (w := core(w)) and v and w:
                                n, m = known.get(v, 0), known.get(w, 0)
                                if n < m:
                                    v, w, n, m = w, v, m, n
                                if n >= RATIO * max(m, 1):
                                    p, q = _differs(v, w)
                                    printed, read = v[p : len(v) - (len(w) - 1 - q)], w[p : q + 1]
                                    if 0 < len(printed) <= 2 and 0 < len(read) <= 2:
                                        seen[printed, read, v] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["printed", "read", "word", "n"])

    each = pairs.mapInPandas(run, "printed string, read string, word string, n long").groupBy("printed", "read", "word").agg(F.sum("n").alias("n"))
    edits = staged(each.groupBy("printed", "read").agg(F.count("*").alias("words"), F.sum("n").alias("n")))
    total = edits.agg(F.sum("n")).first()[0] or 0
    good = edits.where((F.col("words") >= LEARNED_WORDS) & (F.col("n") >= LEARNED_SHARE * total))
    return sorted((r["printed"], r["read"]) for r in good.select("printed", "read").collect())


def nearby(types: DataFrame, rest: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``word, more, ahead, compound``: of each word of ``types``, its candidates ``(v, n)`` among the words of the
    vocabulary that aren't broadcast, and of parts at a line's end how often longer words of these begin with them,
    without and with a hyphen.

    Both sides meet in shards (see ``Confusions.search_keys``). Shards with many words are searched in parts, each by all words
    that look there; words stream past a trie of one part, so no task holds more than that.
    """

    def shards(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, v, n) for v, n in zip(pdf["word"], pdf["count"]) for k in vocabulary_keys(v)], columns=["key", "v", "n"])

    def searches(batches):
        confusions = Confusions(pairs)
        for pdf in batches:
            out = {(k, w, x) for w in pdf["word"] for x in _probes(w) for k in confusions.search_keys(x)}
            yield pd.DataFrame(list(out), columns=["key", "word", "v"])

    held = staged(rest.select("word", "count").mapInPandas(shards, "key string, v string, n long"))
    parts = held.groupBy("key").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    own = held.join(parts, "key").select("key", F.expr("pmod(xxhash64(v), parts)").cast("int").alias("part"), F.lit("").alias("word"), "v", "n")
    asked = types.select("word").mapInPandas(searches, "key string, word string, v string").join(parts, "key")
    asked = asked.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "word", "v", F.lit(0).cast("long").alias("n"))

    def search(batches):
        at, trie, words = None, None, {}
        confusions = Confusions(pairs)
        for pdf in batches:
            out = []
            for key, part, word, v, n in zip(pdf["key"], pdf["part"], pdf["word"], pdf["v"], pdf["n"]):
                if (key, part) != at:
                    at, trie, words = (key, part), None, {}
                if n:
                    words[v] = n
                    continue
                trie = trie or Trie(words, confusions=confusions)
                out += [(word, x, words[x]) for x in trie.candidates(v)]
            yield pd.DataFrame(out, columns=["word", "v", "n"])

    rows = own.unionByName(asked).repartition("key", "part").sortWithinPartitions("key", "part", F.desc("n"))
    found = rows.mapInPandas(search, "word string, v string, n long").groupBy("word").agg(F.collect_set(F.struct("v", "n")).alias("more"))
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i)))
    ahead = rest.where(F.length("word") > 1).select(starts.alias("a"), "count").groupBy("a").agg(F.sum("count").alias("ahead"))
    ends = types.where(F.col("word").endswith(_CUT)).select("word", F.regexp_replace("word", _CUT, "").alias("a"))
    ends = ends.join(ahead, "a", "left").withColumn("a", F.concat("a", F.lit("-"))).join(ahead.withColumnRenamed("ahead", "compound"), "a", "left")
    return found.join(ends.drop("a"), "word", "full")


def _differs(printed: str, read: str) -> tuple[int, int]:
    """First and last place of ``read`` that isn't as printed."""
    a = 0
    while a < min(len(printed), len(read)) and printed[a] == read[a]:
        a += 1
    b = 0
    while b < min(len(printed), len(read)) - a and printed[-1 - b] == read[-1 - b]:
        b += 1
    return a, max(a, len(read) - 1 - b)


def judge(word: str, count: int, trie: Trie | Overlay, ordered: list[str], ahead: tuple[int, int] = (0, 0)) -> tuple[bool, bool, bool, list[tuple[str, float]]]:
    """Whether the line's end cuts a word, whether its first part and its second are misread, and the
    readings. ``word`` is a word, or two parts with the sign of a cut between them, of which the second
    is empty if it stands elsewhere. ``ahead``: how often words that aren't in ``ordered`` begin with a part
    whose rest stands elsewhere, and with it and a hyphen."""
    if _CUT not in word:
        if word[0] == "(" and word[1:] in trie.counts:
            return False, False, False, []
        found = readings(word, count, trie, RATIO)
        if word[0] == "(" and not found:
            found = readings(word[1:], count, trie, RATIO)
            return False, bool(found) or not FOREIGN.isdisjoint(word[1:]), False, found
        return False, bool(found) or not FOREIGN.isdisjoint(word), False, found
    a, b = word.split(_CUT)
    odd = (not FOREIGN.isdisjoint(a.lstrip("(")), not FOREIGN.isdisjoint(b))
    if not b:

        def weight(prefix: str) -> int:
            k = bisect_left(ordered, prefix)
            total = 0
            while k < len(ordered) and ordered[k].startswith(prefix):
                if len(ordered[k]) > len(prefix):
                    total += trie.counts[ordered[k]]
                k += 1
            return total

        # A compound breaks at its hyphen far more often than another word is cut at just that place.
        compound = weight(a + "-") + ahead[1]
        return not (compound and compound * 5 >= weight(a) + ahead[0] - compound), odd[0], False, []
    solid, compound = a + b, f"{a}-{b}"
    sure = {w: trie.counts[w] for w in (solid, compound) if w in trie.counts and w not in trie.doubted}
    if sure:
        whole = sure.get(solid, 0) >= sure.get(compound, 0)
        return whole, odd[0], odd[1], [(solid if whole else compound, 0.0)]
    options = [(w, s, True) for w, s in readings(solid, 1, trie, RATIO)] + [
        (w, s, False) for w, s in readings(compound, 1, trie, RATIO)
    ]
    if options:
        printed, score, whole = max(options, key=lambda x: x[1])
        first, last = _differs(printed, solid if whole else compound)
        at = len(a) if whole else len(a) + 1
        return whole, first < at, last >= at, [(printed, score)]
    whole = not (a in trie.counts and b in trie.counts and trie.counts[a] > 0)
    return whole, odd[0], odd[1], []


def verdicts(
    types: DataFrame, vocab, rest: DataFrame | None = None, doubted=None, weak: DataFrame | None = None, pairs: list[tuple[str, str]] | None = None
) -> DataFrame:
    """``word, cut, first, second, readings`` of each word or cut word of ``types(word, count)``; ``vocab``
    is the broadcast part of the vocabulary, ``rest`` the other (see ``vocabulary``), ``pairs`` the learned confusions. Of the words of these that
    are doubted themselves, ``doubted`` is a broadcast set, and ``weak(word)`` holds those of ``rest``."""
    columns = ["word", "count"]
    types = types.select(*columns)
    if rest is not None:
        near = nearby(types, rest, pairs or [])
        if weak is not None:
            bad = near.select("word", F.explode("more.v").alias("v")).join(weak.select(F.col("word").alias("v")), "v", "left_semi")
            near = near.join(bad.groupBy("word").agg(F.collect_set("v").alias("weak")), "word", "left")
        else:
            near = near.withColumn("weak", F.lit(None).cast("array<string>"))
        types = types.join(near, "word", "left")
        columns += ["more", "ahead", "compound", "weak"]

    def run(batches):
        trie, ordered = _searched(vocab, doubted, pairs or [])
        for pdf in batches:
            rows = []
            for w, n, *near in pdf[columns].itertuples(index=False, name=None):
                if near:
                    more, ahead, compound, weak = near
                    more = {x["v"]: x["n"] for x in more} if more is not None else {}
                    own = Overlay(trie, more, frozenset(weak) if weak is not None else frozenset()) if more else trie
                    counts = tuple(0 if pd.isna(x) else int(x) for x in (ahead, compound))
                    rows.append((w, *judge(w, n, own, ordered, counts)))
                else:
                    rows.append((w, *judge(w, n, trie, ordered)))
            yield pd.DataFrame(
                [(w, c, f, s, [{"printed": x, "score": y} for x, y in r]) for w, c, f, s, r in rows],
                columns=["word", "cut", "first", "second", "readings"],
            )

    return types.mapInPandas(
        run, "word string, cut boolean, first boolean, second boolean, readings array<struct<printed:string,score:double>>"
    )


_TRIES: dict[tuple, tuple[Trie, list[str]]] = {}


def _searched(vocab, doubted, pairs: list[tuple[str, str]]) -> tuple[Trie, list[str]]:
    """The trie of a broadcast vocabulary and its words in order, built once in each Python worker."""
    name = lambda b: getattr(b, "_path", None) or id(b.value)
    key = (name(vocab), name(doubted) if doubted else 0, tuple(pairs))
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = (Trie(vocab.value, doubted.value if doubted else frozenset(), Confusions(pairs)), sorted(vocab.value))
    return _TRIES[key]


class Reader:
    """Reads texts line by line, given the words that need no second look."""

    def __init__(self, good: frozenset, watch: frozenset) -> None:
        self.good, self.watch = good, watch
        self.fine: set[str] = set()  # tokens, with their marks, that were looked at and are good
        self.contexts: Counter = Counter()
        self.cores: dict[str, str] = {}

    def layout(self, text: str, running: set[int]) -> tuple[list[str], list[str]]:
        """Lines, and the kind of each: '' blank, running, number or text."""
        lines = text.split("\n")
        kinds = []
        for i, (line, long) in enumerate(zip(lines, L.long_lines(text, lines)), 1):
            if not long and (not line or line.isspace()):
                kinds.append("")
            elif i in running:
                kinds.append("running")
            elif long:
                kinds.append("text")
            elif L.is_page_number(line):
                kinds.append("number")
            else:
                kinds.append("text")
        return lines, kinds

    def facts(self, text: str, running: set[int], place: str | None = None, following: str | None = None) -> list[tuple[int, int | None, str, str, str]]:
        """(line, line of the rest, kind, word, word before): furniture, cut words and words to look at.

        ``place``: the text may begin with the rest of a word cut in the text that has ``following`` the same. A first
        word that is short and in lower case is of kind start then, and a text that ends in a cut word has a row of kind
        open; their last column is the place.
        """
        lines, kinds = self.layout(text, running)
        out: list = [(i, None, k, "", "") for i, k in enumerate(kinds, 1) if k in ("running", "number")]
        body = [(i, line.split()) for i, (line, k) in enumerate(zip(lines, kinds), 1) if k == "text"]
        skip = 0
        if place and body and body[0][1][0][0].islower() and len(w := core(body[0][1][0])) < 4:
            skip = 1  # a rest so short can be like any word
            if w not in self.good and is_word(w):
                out.append((body[0][0], None, "start", w, place))
        if following and body and (last := body[-1][1][-1])[-1] in HYPHENS and len(last) > 1 and last[-2].isalnum():
            out.append((body[-1][0], None, "open", "", following))
        before = ""  # the last token of the line before
        for at, (no, tokens) in enumerate(body):
            end = len(tokens)
            last, rest = tokens[-1], 0
            if last[-1] in HYPHENS and len(last) > 1 and last[-2].isalnum():
                end -= 1
                part = last[:-1].lower().lstrip(_OUTER)
                if at + 1 < len(body) and (after := body[at + 1][1][0])[0].isalnum() | (after[0] in "@€†ſ|"):
                    rest = 1
                    out.append((no, body[at + 1][0], "word", part + _CUT + after.lower().rstrip(_OUTER), ""))
                else:
                    out.append((no, None, "word", part + _CUT, ""))
            fine = self.fine
            own = tokens[skip:end]
            if self.watch:
                previous, cores = core(before), self.cores
                if len(cores) > 1_000_000:
                    cores.clear()
                for t in own:
                    w = cores.get(t)
                    if w is None:
                        w = cores[t] = core(t)
                    if w in self.watch:
                        self.contexts[previous, w] += 1
                    previous = w
            for k, t in enumerate(own) if not fine.issuperset(own) else ():
                if t in fine:
                    continue
                w = core(t)
                if w in self.good or not is_word(w):
                    if len(fine) > 1_000_000:
                        fine.clear()
                    fine.add(t)
                else:
                    out.append((no, None, "word", w, core(own[k - 1] if k else before)))
            before = tokens[-1]
            skip = rest
        return out


def read_lines(texts: DataFrame, running: DataFrame, good, watch) -> DataFrame:
    """One pass over all texts: ``tab, row_key, line_no, rest_no, kind, word, before`` (see ``Reader.facts``),
    and rows of kind context, whose line_no counts how often ``word`` follows ``before``. ``running(tab, row_key, lines)``
    holds the running lines of each text; a text has few, and is shuffled once to meet them."""

    def run(batches):
        reader = Reader(good.value, watch.value)
        columns = ["tab", "row_key", "line_no", "rest_no", "kind", "word", "before"]
        for pdf in batches:
            out = []
            for tab, key, text, lines, place, following in pdf.itertuples(index=False, name=None):
                if text:
                    own = set() if lines is None else set(lines.tolist())
                    out += [(tab, key, *x) for x in reader.facts(text, own, place, following)]
            out += [("", "", n, None, "context", w, b) for (b, w), n in reader.contexts.items()]
            reader.contexts.clear()
            frame = pd.DataFrame(out, columns=columns)
            frame["rest_no"] = frame["rest_no"].astype("Int64")
            yield frame

    placed = texts.withColumns({c: F.lit(None).cast("string") for c in ("place", "following") if c not in texts.columns})
    # Row keys are as good as unique, so parts of the running lines are small enough to be hashed; texts needn't be sorted.
    rows = placed.join(running.hint("shuffle_hash"), ["tab", "row_key"], "left").select("tab", "row_key", "text", "lines", "place", "following")
    return rows.mapInPandas(
        run, "tab string, row_key string, line_no int, rest_no int, kind string, word string, before string"
    )


def findings(
    texts: DataFrame, running: DataFrame, pairs: DataFrame | None = None, contexts: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """All that is wrong with the lines of ``texts(tab, row_key, text, place, following)``: furniture lines, words
    with their verdicts, and, if asked for, the contexts of readings, by which they are told apart.

    Words are counted over all texts; those that occur LEAST times are the vocabulary. For every other word,
    and for every word of the vocabulary itself, an automaton is run over the vocabulary's trie, of which
    the words beyond BROADCAST are searched in shards. Words with several readings are judged again when it
    is known which words of the vocabulary are doubted.
    A second pass emits only words that aren't known to be good, so the shuffle that meets them
    with their verdicts holds a small part of all words. Null and empty texts have no lines. ``running(tab, row_key, line_no)``
    are the lines that recur in a book; ``pairs(one, other)``, two readings each of the same text, show what is confused;
    ``place`` and ``following`` name where texts follow each other (see ``Reader.facts``), null where none does.
    """
    sc = texts.sparkSession.sparkContext
    words = staged(word_counts(texts))
    known, rest = vocabulary(words)
    vocab = sc.broadcast(known)
    if rest is not None:
        rest = staged(rest)
    shown = learned(pairs, vocab) if pairs is not None else []
    once = staged(verdicts(words, vocab, rest, pairs=shown))
    names = texts.sparkSession.createDataFrame([(w,) for w in known] or [("",)], "word string")
    misread = frozenset(r["word"] for r in once.where("first and word <> ''").select("word").join(names, "word", "left_semi").collect())
    doubted = sc.broadcast(misread)
    weak = once.where("first").select("word").join(rest, "word", "left_semi") if rest is not None else None
    several = words.join(once.where("size(readings) > 1").select("word"), "word", "left_semi")
    judged = staged(once.where("size(readings) <= 1").unionByName(verdicts(several, vocab, rest, doubted, weak, shown)))
    good = sc.broadcast(frozenset(w for w in known if w not in misread))
    # Readings of words that have several. Those among the broadcast words are bounded by them; the others aren't known to be good,
    # so their facts count them.
    best = F.get("readings", F.lit(0))["score"]
    close = F.filter("readings", lambda r: best - r["score"] < MARGIN)
    printed = judged.where("first").where(F.size(close) > 1).select(F.explode(F.transform(close, lambda r: r["printed"])).alias("word")).distinct()
    watch = sc.broadcast(frozenset(r[0] for r in printed.join(names, "word", "left_semi").collect()) if contexts else frozenset())
    by_text = running.groupBy("tab", "row_key").agg(F.collect_set("line_no").alias("lines"))
    facts = staged(read_lines(texts, by_text, good, watch))
    furniture = facts.where("kind in ('running', 'number')").select("tab", "row_key", "line_no", "kind")
    cut_types = facts.where(F.col("kind") == "word").where(F.col("word").contains(_CUT)).groupBy("word").agg(F.count("*").alias("count"))
    every = judged.unionByName(verdicts(cut_types, vocab, rest, doubted, weak, shown))
    # A short first word is judged unless a cut word goes before it; a sign that no word has tells a misreading in any case.
    odd = "[" + re.escape("".join(sorted(FOREIGN))) + "]"
    opened = facts.where("kind = 'open'").select("before").distinct()
    starts = facts.where("kind = 'start'")
    alone = starts.join(opened, "before", "left_anti").unionByName(starts.where(F.col("word").rlike(odd)).join(opened, "before", "left_semi"), allowMissingColumns=True)
    own = facts.where("kind = 'word'").unionByName(alone.select(*[F.lit("").alias(c) if c == "before" else F.col(c) for c in facts.columns]))
    # A word stands there once, so parts of the verdicts are small enough to be hashed; the many facts needn't be sorted.
    marked = own.join(every.where("cut or first or second or size(readings) > 0").hint("shuffle_hash"), "word").select(
        "tab", "row_key", "line_no", "rest_no", "word", "before", "cut", "first", "second", "readings"
    )
    if not contexts:
        return furniture, marked, None
    counts = facts.where("kind = 'context'").groupBy("before", "word").agg(F.sum("line_no").alias("times"))
    if rest is not None:
        others = printed.join(names, "word", "left_anti")
        more = facts.where("kind = 'word'").join(others, "word", "left_semi").groupBy("before", "word").agg(F.count("*").alias("times"))
        counts = counts.unionByName(more)
    return furniture, marked, counts


def found_lines(furniture: DataFrame, marked: DataFrame) -> DataFrame:
    """``tab, row_key, line_no, kind``: one row per line and kind of noise."""
    kinds = F.array(
        F.when(F.col("cut"), F.struct(F.col("line_no").alias("line_no"), F.lit("hyphen").alias("kind"))),
        F.when(F.col("first"), F.struct(F.col("line_no").alias("line_no"), F.lit("misread").alias("kind"))),
        F.when(F.col("second"), F.struct(F.col("rest_no").alias("line_no"), F.lit("misread").alias("kind"))),
    )
    words = marked.select("tab", "row_key", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).select(
        "tab", "row_key", "x.line_no", "x.kind"
    )
    return furniture.unionByName(words.where("line_no is not null")).distinct()


def chosen_readings(marked: DataFrame, contexts: DataFrame) -> DataFrame:
    """``marked`` with the ``printed`` word of each: the reading with the best score, to which the
    logarithm of how often it follows the word before is added."""
    options = marked.withColumn("option", F.explode_outer("readings"))
    scored = options.join(
        contexts.select("before", F.col("word").alias("_printed"), "times"),
        (options["before"] == contexts["before"]) & (F.col("option.printed") == F.col("_printed")),
        "left",
    ).drop(contexts["before"])
    near = F.get("readings", F.lit(0))["score"] - F.col("option.score") < MARGIN
    score = F.col("option.score") + F.when(near, F.log(F.coalesce("times", F.lit(0)) + 1)).otherwise(0.0)
    return scored.groupBy("tab", "row_key", "line_no", "word", "cut").agg(
        F.max(F.struct(score.alias("score"), F.col("option.printed").alias("printed"))).alias("best"), F.max("first").alias("first"), F.max("second").alias("second")
    ).select("tab", "row_key", "line_no", "word", "cut", "first", "second", "best.printed")


def reflow(text: str, gone: set[int], cuts: dict[int, bool], fixes: dict[int, dict[str, str]]) -> str:
    """The text as paragraphs: furniture lines left out, cut words joined, misread words put right.

    ``cuts`` says of a line's end whether a word is cut there (true) or a compound breaks (false).
    Blank lines part paragraphs, unless they stand in the middle of a sentence, as between pages;
    headings stand alone.
    """
    paragraphs: list[str] = []
    current, glue, gap = "", False, False
    for no, line in enumerate(text.split("\n"), 1):
        if no in gone:
            continue
        tokens = line.split()
        if not tokens:
            gap = True
            continue
        heading = tokens[0].startswith("#")
        own = fixes.get(no, {})
        tokens = [_fix(t, own) for t in tokens]
        if (gap and not glue and _ENDED.search(current)) or heading:
            if current:
                paragraphs.append(current)
            current = ""
        gap = False
        body = " ".join(tokens)
        current = current + body if glue or not current else f"{current} {body}"
        glue = False
        if no in cuts and current[-1] in HYPHENS:
            current = current[:-1] if cuts[no] else current[:-1] + "-"
            glue = True
        if heading:
            paragraphs.append(current)
            current = ""
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)


def _fix(token: str, fixes: dict[str, str]) -> str:
    w = core(token)
    if not w or w not in fixes:
        return token
    start = token.lower().find(w)
    new = fixes[w]
    old = token[start : start + len(w)]
    letters = [c for c in old if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        new = new.upper()
    elif old[0].isupper() or (not old[0].isalpha() and len(letters) and start == 0 and token[:1].isupper()):
        new = new[:1].upper() + new[1:]
    return token[:start] + new + token[start + len(w) :]


def repaired(texts: DataFrame, furniture: DataFrame, marked: DataFrame, contexts: DataFrame) -> DataFrame:
    """``tab, row_key, text`` of every text as continuous paragraphs; null texts stay null."""
    words = chosen_readings(marked, contexts)
    notes = (
        furniture.select("tab", "row_key", F.struct("line_no", "kind", F.lit("").alias("word"), F.lit("").alias("printed")).alias("n"))
        .unionByName(
            words.select(
                "tab",
                "row_key",
                F.struct(
                    "line_no",
                    F.when(F.col("word").contains(_CUT), F.when(F.col("cut"), "cut").otherwise("break")).otherwise("word").alias("kind"),
                    "word",
                    F.coalesce("printed", F.lit("")).alias("printed"),
                ).alias("n"),
            )
        )
        .groupBy("tab", "row_key")
        .agg(F.collect_set("n").alias("notes"))
    )

    @F.pandas_udf("string")
    def apply(text: pd.Series, notes: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, notes):
            gone, cuts, fixes = set(), {}, {}
            for n in own if own is not None else ():
                if n["kind"] in ("running", "number"):
                    gone.add(n["line_no"])
                elif n["kind"] in ("cut", "break"):
                    cuts[n["line_no"]] = n["kind"] == "cut"
                elif n["printed"]:
                    fixes.setdefault(n["line_no"], {})[n["word"]] = n["printed"]
            out.append(None if t is None else reflow(t, gone, cuts, fixes))
        return pd.Series(out, dtype=object)

    return texts.select("tab", "row_key", "text").join(notes.hint("shuffle_hash"), ["tab", "row_key"], "left").select("tab", "row_key", apply("text", "notes").alias("text"))
