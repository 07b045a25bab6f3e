"""Toxicity by noisy-channel deobfuscation.

Odd words (leetspeak, inner separators, stretched letters, letters spaced out) span a
lattice of what each sign may stand for; a Viterbi search under a character trigram
model picks the likeliest spelling. The restored words, with all plain ones, are scored
by a lexicon of words that labelled toxic rows have and the others lack.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, slices, stored
from .langid import in_fold

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
BREAKS = ".-_*~'’:/\\ "
EDGE = ".,;:?\"'’()[]{}<>%#&*~=_-/\\|"
SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*]{1,2}[^\W_]){2,}(?![^\s.,;:!?])")
TRIPLE, REPEATED = re.compile(r"(.)\1\1"), re.compile(r"(.)\1{3,}", re.S)
#: Signs that are decoded at a time: twice those of a word of 30 spaced letters.
PIECE = 120
#: Costs of a word's end within a run: as the trigrams have it, and less, for one-letter and rare words.
ENDS = (0.0, -1.5)
#: Costs (negative log probabilities) of the channel.
FOLD, DROP, KEEP_RUN, SIGN = 0.7, 1.5, 2.5, 0.3


class CharModel:
    """Trigrams of characters with ``^`` before and ``$`` after a word, add-``k`` smoothed."""

    def __init__(self, counts: dict[str, int], k: float = 0.05):
        self.tri, self.bi, self.letters = counts, {}, {c for t in counts for c in t} - {"^", "$"}
        for t, n in counts.items():
            self.bi[t[:2]] = self.bi.get(t[:2], 0) + n
        self.k, self.size = k, max(len(self.letters) + 1, 2)

    def cost(self, context: str, c: str) -> float:
        return -math.log((self.tri.get(context + c, 0) + self.k) / (self.bi.get(context, 0) + self.k * self.size))

    def restore(self, word: str, ends: float | None = None) -> str:
        """The likeliest letters behind ``word`` (lower case); with ``ends``, a break may be the end of a word too (a space), at that cost."""
        beams = {"^^": (0.0, "")}
        for run in re.finditer(r"(.)\1*", word, re.S):
            c, n = run[1], len(run[0])
            if c.isalpha():
                options = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, FOLD)] if n == 2 else [(c, FOLD), (c * 2, FOLD)]
            elif c in LEET:
                options = [(x * m, SIGN * m) for x in LEET[c] for m in ([1] if n == 1 else [1, 2])] + ([] if c.isdigit() else [("", DROP + KEEP_RUN)])
            elif c in BREAKS:
                options = [("", 0.0 if c != "*" else DROP)] + ([(x, KEEP_RUN) for x in self.letters] if c == "*" and n == 1 else [])
            else:
                options = [("", DROP)]
            following: dict[str, tuple[float, str]] = {}
            for state, (cost, said) in beams.items():
                if ends is not None and c in BREAKS and said and said[-1] != " ":
                    total = cost + self.cost(state, "$") + ends
                    if "^^" not in following or (total, said + " ") < following["^^"]:
                        following["^^"] = (total, said + " ")
                for out, price in options:
                    s, total = state, cost + price
                    for x in out:
                        total += self.cost(s, x)
                        s = s[1] + x
                    if s not in following or (total, said + out) < following[s]:
                        following[s] = (total, said + out)
            beams = following
        return min((cost + self.cost(s, "$"), said) for s, (cost, said) in beams.items())[1]


def plain_words(text: str) -> set[str]:
    return {w.strip(EDGE + "!") for w in set(text.lower().split())}


def pieces(run: str) -> list[str]:
    """``run`` in pieces of ``PIECE`` signs at most, each of which repeats the last half of the one before. Of one sign in
    a row three stay; more are read the same."""
    run = REPEATED.sub(r"\1\1\1", run)
    return [run[i : i + PIECE] for i in range(0, max(1, len(run) - PIECE // 2), PIECE // 2)]


class Restorer:
    def __init__(self, model: CharModel):
        self.model, self.cache = model, {}

    def decoded(self, word: str) -> str:
        got = self.cache.get(word)
        if got is None:
            got = self.model.restore(word)
            if len(self.cache) < 200_000:
                self.cache[word] = got
        return got

    def parts(self, run: str) -> set[str]:
        """The likeliest words behind ``run``, whose breaks may end words."""
        out: set[str] = set()
        for x in pieces(run):
            key = " " + x  # no odd word begins with a space
            got = self.cache.get(key)
            if got is None:
                got = " ".join(self.model.restore(x, e) for e in ENDS)
                if len(self.cache) < 200_000:
                    self.cache[key] = got
            out.update(got.split())
        return out

    def words(self, text: str) -> tuple[set[str], set[str]]:
        """Distinct words of ``text``: those that are plain, and odd ones as restored."""
        low = text.lower()
        split = low.split()
        raw = set(split)
        plain = {w.strip(EDGE + "!") for w in raw}
        restored = set()
        for w in raw:
            if w.isalpha():
                continue
            core = w.strip(EDGE)
            for x in {core, core.rstrip("!")}:  # a call, or the letter i
                if len(x) >= 3 and not x.isalpha() and sum(map(str.isalpha, x)) >= 2:
                    x = REPEATED.sub(r"\1\1\1", x)
                    restored |= {self.decoded(x)} if len(x) <= 40 else self.parts(x)
        if TRIPLE.search(low):
            restored |= {self.decoded(x) for w in plain if len(w) >= 3 and w.isalpha() and TRIPLE.search(w) for x in pieces(w)}
        if sum(len(w) == 1 for w in split) >= 3:
            for m in SPACED.finditer(low):
                # the first and the last sign may be words beside it (a, I)
                for x in {m[0], m[0][1:].lstrip(BREAKS), m[0][:-1].rstrip(BREAKS)}:
                    restored |= self.parts(x)
                    if len(x) <= 120:
                        restored.add(self.decoded(x))
        plain.discard("")
        restored.discard("")
        return plain, restored


#: Beginnings of words are features too (``achlich*``), for stems with many endings. A stem is
#: weighed against how many of the text's words begin with its first letters (``ROOT`` of them).
STEMS, ROOT = (3, 4, 5, 6, 7), 2


#: Words or features that a task counts before it hands them on.
COUNTED = 200_000


def features(word: str) -> tuple[str, ...]:
    """The word itself, its root and its stems."""
    return (word, word[:ROOT] + "**", *[word[:k] + "*" for k in STEMS if len(word) > k]) if len(word) >= ROOT else (word,)


def count_trigrams(texts: Iterable[str]) -> Iterator[dict[str, int]]:
    """Trigrams of the plain words of letters, each word once a text, in parts that are to be added up."""
    words: Counter = Counter()

    def trigrams() -> dict[str, int]:
        counts: dict[str, int] = {}
        for w, n in words.items():
            if w.isalpha() and not TRIPLE.search(w):
                s = f"^^{w}$"
                for i in range(len(w) + 1):
                    counts[s[i : i + 3]] = counts.get(s[i : i + 3], 0) + n
        return counts

    for text in texts:
        words.update(plain_words(text))
        if len(words) > COUNTED:
            yield trigrams()
            words.clear()
    yield trigrams()


def count_features(rows: Iterable[tuple[str, int]], restorer: Restorer) -> Iterator[list[tuple[str, int, int, int]]]:
    """(feature, toxic texts, clean texts, distinct words of clean texts) of (text, toxic), in parts that are to be added up."""
    toxic, clean, many = Counter(), Counter(), Counter()
    known: dict[str, tuple[str, ...]] = {}

    def part() -> list[tuple[str, int, int, int]]:
        return [(w, toxic.get(w, 0), clean.get(w, 0), many.get(w, 0)) for w in toxic.keys() | clean.keys()]

    for text, label in rows:
        found: list[str] = []
        for w in set().union(*restorer.words(text)):
            got = known.get(w)
            if got is None:
                got = features(w)
                if len(known) < COUNTED:
                    known[w] = got
            found += got
        if label:
            toxic.update(set(found))
        else:
            clean.update(set(found))
            many.update(found)
        if len(toxic) + len(clean) > COUNTED:
            yield part()
            for x in (toxic, clean, many):
                x.clear()
    yield part()


def squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def _tail(c: int, mean: float) -> float:
    """-log P(at least c) of a Poisson variable, 40 at most."""
    if c <= 0:
        return 0.0
    term = math.exp(-mean)
    below = 0.0
    for i in range(c):
        below += term
        term *= mean / (i + 1)
    if below < 0.999:
        return min(40.0, -math.log(1 - below))
    total, i = 0.0, c
    while i < c + 60:
        total += term
        i += 1
        term *= mean / i
    return min(40.0, -math.log(max(total, 1e-18)))


class ToxicModel:
    """``weights`` of whole words; ``stems``: chance that a word with the stem's root has the stem, in clean texts."""

    def __init__(self, chars: CharModel, weights: dict[str, float], stems: dict[str, float], fit: tuple[float, float, float] = (1.0, 0.5, -3.0)):
        self.chars, self.weights, self.stems, self.fit = chars, weights, stems, fit
        self.short = {squeezed(w): w for w in sorted(weights)}
        self.lengths = sorted({len(x) for x in stems})

    def evidence(self, plain: set[str], restored: set[str]) -> tuple[float, float]:
        hits = (plain & self.weights.keys()) | {self.short[x] for x in map(squeezed, restored) if x in self.short}
        stems = Counter(w[:k] for k in self.lengths for w in plain | restored if len(w) > k and w[:k] in self.stems) if self.stems else {}
        x = 0.0
        if stems:
            roots = Counter(w[:ROOT] for w in plain | restored)
            x = _tail(sum(stems.values()), sum(q * roots.get(s[:ROOT], 0) for s, q in self.stems.items()))
        return round(min(30.0, sum(self.weights[w] for w in sorted(hits))), 1), round(x, 1)

    def score(self, evidence: tuple[float, float]) -> float:
        z = self.fit[0] * evidence[0] + self.fit[1] * evidence[1] + self.fit[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, lexicon: int = 1000) -> ToxicModel:
    """Fit on every labelled row that isn't held out.

    Labels other than 0 and 1 are ignored; of a document's several labels the largest counts.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels may be as many as documents, so neither side is sent whole at any size; held out documents go before the join. Labelled texts are read from the documents once
    rows = stored(docs.select("doc_id", "text").filter(F.col("text").isNotNull() & ~in_fold(F.col("doc_id"))).join(marked.hint("merge"), "doc_id").select("text", "toxic"))

    def characters(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for counts in count_trigrams(x for batch in batches for a, b in slices(np.full(batch.num_rows, 1 << 12), 1 << 20) for x in batch.column(0).slice(a, b - a).to_pylist()):
            yield pa.RecordBatch.from_pydict({"g": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    # trigrams of letters: as many as an alphabet has, whatever the number of rows; the most frequent will do
    got = rows.select("text").mapInArrow(characters, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(200_000).collect()
    chars = CharModel({r[0]: r[1] for r in got})

    def restored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        texts = (x for batch in batches for a, b in slices(np.full(batch.num_rows, 1 << 12), 1 << 20) for x in zip(*[batch.column(k).slice(a, b - a).to_pylist() for k in (0, 1)]))
        for part in count_features(texts, Restorer(chars)):
            w, *n = zip(*part) if part else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"w": pa.array(w, pa.string()), **{k: pa.array(v, pa.int64()) for k, v in zip(("t", "c", "clean"), n)}})

    seen = rows.select("text", "toxic").mapInArrow(restored, "w string, t long, c long, clean long").groupBy("w").agg(*[F.sum(k).alias(k) for k in ("t", "c", "clean")])
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    nt, nc = totals.get(1, 0), totals.get(0, 0)
    if not nt or not nc:
        return ToxicModel(chars, {}, {})
    n = F.col("t") + F.col("c")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (part(F.col("t"), n * nt / (nt + nc)) + part(F.col("c"), n * nc / (nt + nc)))
    often = stored(seen.withColumn("g2", F.round(g2, 9)).filter((n >= 3) | F.col("w").endswith("**")))
    tested = often.count()
    # so many tests that one word passes by chance at most
    good = often.filter((F.col("t") * nc > 4 * F.col("c") * nt) & (F.col("g2") > 2 * math.log(max(tested, 2)) + 2) & ~F.col("w").endswith("**"))
    best = good.orderBy(F.desc("g2"), "w").limit(lexicon).collect()
    words = {r["w"]: r for r in best if not r["w"].endswith("*")}
    chosen: dict[str, int] = {}
    for r in best:
        stem = r["w"][:-1]
        if r["w"].endswith("*") and not any(stem.startswith(x) or x.startswith(stem) for x in chosen):
            if r["t"] > 1.5 * max([0, *(words[w]["t"] for w in words if w.startswith(stem))]):
                chosen[stem] = r["clean"]
    roots = {r["w"][:-2]: r["clean"] for r in often.filter(F.col("w").isin([x[:ROOT] + "**" for x in chosen])).collect()}
    drop_stored(often)
    stems = {x: (k + 0.5) / (roots.get(x[:ROOT], 0) + 1) for x, k in chosen.items()}
    weights = {w: math.log((r["t"] + 0.5) / (nt + 1)) - math.log((r["c"] + 0.5) / (nc + 1)) for w, r in words.items() if not any(w.startswith(x) for x in stems)}
    model = ToxicModel(chars, weights, stems)

    def measured(batches: Iterator) -> Iterator:
        import pandas as pd

        r = Restorer(chars)
        for frame in batches:
            got = [model.evidence(*r.words(t)) for t in frame.text]
            yield pd.DataFrame({"x": [g[0] for g in got], "y": [g[1] for g in got], "toxic": frame.toxic.astype("int64")})

    points = rows.select("text", "toxic").mapInPandas(measured, "x double, y double, toxic long").groupBy("x", "y").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).orderBy("x", "y").collect()
    x = np.asarray([[r["x"], r["y"], 1.0] for r in points])
    t, m = (np.asarray([r[k] for r in points], float) for k in ("t", "n"))
    ridge, fit = np.diag([0.05, 0.05, 0.01]), np.asarray(model.fit)
    for _ in range(60):  # Newton steps of a ridged logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        step = np.linalg.solve((x * (m * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (t - m * p) - ridge @ fit)
        fit = fit + step * min(1.0, 2.0 / max(abs(step).max(), 1e-9))
    model.fit = tuple(float(round(v, 9)) for v in fit)
    drop_stored(rows)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no evidence and get the score of a text without toxic
    words. Repeated rows each give a row; without labels of both classes all scores
    are low; an empty table gives no rows. ``predicted`` is 1 from ``limit`` on.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.select("doc_id", "toxic"), **options))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        r = Restorer(model.chars)
        for batch in batches:
            scores = []
            for a, b in slices(np.full(batch.num_rows, 1 << 12), 1 << 20):
                scores += [round(model.score(model.evidence(*r.words(x or ""))), 6) for x in batch.column(1).slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(x >= limit) for x in scores], pa.int32())})

    return docs.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", "predicted")
