"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) are TF-IDF vectors over hashed terms; document frequencies
are those of all documents. A randomised SVD, fitted in tasks on all passages
of the documents and of the benchmark, gives a latent space. Every passage of every document
is projected there and compared with every benchmark passage by cosine; items of
half a passage and less, whose cosine the words around them take away, are looked up by
rare shared terms instead. Candidates are confirmed by the longest common subsequence with the item's words, and paraphrases by
the item's answer (its last sentence).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, Words, cut_words, drop_stored, map_rows, slices, stored, utf8, word_hashes

TERM_BITS, RANK, OVERSAMPLE = 15, 96, 16
BLOCK, WINDOW = 8, 4  # words a block, blocks a passage
#: Bytes of text and passages handled at a time: what is worked on stays near the processor.
SLICE, STEP = 1 << 17, 2048
#: Items compared in one pass over the documents; a larger benchmark takes more passes.
ITEMS = 5_000
#: Bytes that the space is fitted on at a time, and terms that are multiplied as a dense table (a choice of speed: the sums are the same).
FIT, COMMON = 1 << 18, 128


def _terms(w: Words) -> np.ndarray:
    return (w.hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _passages(w: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of ``table`` rows over each passage, its text and its first word (in the text). The table's last row is zero."""
    n = np.diff(w.bounds)
    blocks = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), blocks)
    within = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks)
    if not len(text):
        return np.zeros((0, table.shape[1]), np.float32), text, within
    # a text's last block is filled up with the zero row, so a block is the sum of as many rows as it has words
    terms = np.concatenate([_terms(w), np.full(BLOCK, len(table) - 1)])
    at, end = w.bounds[:-1][text] + within * BLOCK, w.bounds[1:][text]
    sums = table[terms[at]]
    for k in range(1, BLOCK):
        sums += table[np.where(at + k < end, terms[at + k], len(table) - 1)]
    out = sums.copy()
    for k in range(1, WINDOW):
        out[:-k] += sums[k:] * (text[k:] == text[:-k])[:, None].astype(np.float32)
    # the last windows of a text that has more blocks lie within the one before
    start = (within == 0) | (within + WINDOW <= blocks[text])
    return out[start], text[start], within[start] * BLOCK


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents that have each hashed term: a table of fixed size, over all rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 << TERM_BITS, np.int64)
        for batch in batches:
            texts = utf8(batch.column(0))
            for x in (x for x in texts if len(x) > LONG):
                total[np.unique(word_hashes(x) >> np.uint64(64 - TERM_BITS)).astype(np.int64)] += 1
            texts = [x for x in texts if len(x) <= LONG]
            for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), LONG):
                w = Words(texts[a:b])
                # by term, and within a term by text: a stable sort of 16 bits
                term = _terms(w).astype(np.uint16)
                order = np.argsort(term, kind="stable")
                term, text = term[order], np.repeat(np.arange(b - a, dtype=np.int32), np.diff(w.bounds))[order]
                new = np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])])[: len(term)]
                total += np.bincount(term[new], minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(k, pa.int32()), "df": pa.array(total[k])})

    rows = docs.select("text").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(1 << TERM_BITS)
    out[rows.term] = rows.df
    return out


def _sum_of(rows: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of what ``partial(words, total)`` adds to ``total``. There are as many partial tables as tasks, which follow
    the cores and not the rows; they are added up by blocks, in tasks."""
    spark, step = rows.sparkSession, 2048

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(shape, np.float64)
        for batch in batches:
            texts = [y for x in utf8(batch.column(0)) for y in (cut_words(x, FIT) if len(x) > FIT else [x])]
            for a, b in slices(np.fromiter((len(x) + 64 for x in texts), np.int64, len(texts)), FIT):
                partial(Words(texts[a:b]), total)
        for i in range(0, shape[0], step):
            yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int32()), "m": pa.array([total[i : i + step].astype(np.float32).tobytes()], pa.binary())})

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[at] = sums.get(at, 0.0) + np.frombuffer(m, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(sums), pa.int32()), "m": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros(shape)
    tasks, blocks = max(12, 2 * spark.sparkContext.defaultParallelism), -(-shape[0] // step)
    for r in rows.coalesce(tasks).mapInArrow(run, "at int, m binary").repartition(blocks, "at").mapInArrow(add, "at int, m binary").collect():  # one table
        m = np.frombuffer(r["m"], np.float64).reshape(-1, shape[1])
        out[r["at"] : r["at"] + len(m)] = m
    return out


def _run_sums(table: np.ndarray, rows: np.ndarray, at: np.ndarray, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``table[rows]`` over the rows with the same ``at`` (ascending), and those, in another order.

    Runs are short here and ``reduceat`` pays for each run and column. So all first rows are taken, then all second ones are added to
    them, and so on; the longest runs stand first, so those that go on are the beginning. What is left of the last ``least`` is added by run.
    """
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
    counts = np.diff(np.append(heads, len(at)))
    order = np.argsort(-counts, kind="stable")
    heads, counts = heads[order], counts[order]
    out = table.take(rows[heads], axis=0)
    more, nth = np.empty_like(out), 1
    while True:
        k = int(np.searchsorted(-counts, -nth))  # runs of more than nth rows
        if k < least:
            break
        # rows are valid; clip only spares a copy
        np.take(table, rows[heads[:k] + nth], axis=0, out=more[:k], mode="clip")
        out[:k] += more[:k]
        nth += 1
    for i in range(k):
        out[i] += table.take(rows[heads[i] + nth : heads[i] + counts[i]], axis=0).sum(0, dtype=np.float64)
    return out, at[heads]


def latent_space(texts: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Terms x ``rank``: idf-weighted right singular vectors of all passages of ``texts``, each of unit variance.

    With the passages' matrix A and a random omega, one pass over the texts gives Y = A' A omega, and Y (omega' Y)^-1 Y' is A' A but for
    what its ``rank + OVERSAMPLE`` greatest directions leave out (Nystrom's form of a randomised SVD).
    """
    terms, width, span = len(idf), rank + OVERSAMPLE, BLOCK * WINDOW
    omega = np.random.default_rng(7).standard_normal((terms, width)).astype(np.float32)
    weighted = omega * idf[:, None].astype(np.float32)
    # the most common terms are multiplied as a dense table, all others one by one: the same sums, sooner
    common = np.argsort(idf, kind="stable")[:COMMON]
    place = np.full(terms, -1, np.int64)
    place[common] = np.arange(len(common))

    def product(w: Words, total: np.ndarray) -> None:
        """Adds A' A omega of disjoint passages, but for the idf weights of its rows."""
        t = _terms(w)
        if not len(t):
            return
        n = np.diff(w.bounds)
        first = (np.arange(len(t)) - np.repeat(w.bounds[:-1], n)) % span == 0
        passage, many = np.cumsum(first) - 1, int(first.sum())
        dense, rest = np.flatnonzero(place[t] >= 0), np.flatnonzero(place[t] < 0)
        c = np.bincount(passage[dense] * len(common) + place[t[dense]], minlength=many * len(common)).reshape(many, len(common)).astype(np.float32)
        y = c @ weighted[common]
        if len(rest):
            got, at = _run_sums(weighted, t[rest], passage[rest])
            y[at] += got
            rest = rest[np.argsort(t[rest].astype(np.uint16), kind="stable")]
            got, at = _run_sums(y, passage[rest], t[rest])
            total[at] += got
        total[common] += c.T @ y

    y = _sum_of(texts, product, (terms, width)) * idf[:, None]
    core = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = y @ (vectors / np.sqrt(np.maximum(values, max(values[-1], 1e-12) * 1e-9)))
    values, vectors = np.linalg.eigh(half.T @ half)
    # divided twice by the singular values, for unit vectors and for unit variance: else the languages' common words make all passages alike
    return (idf[:, None] * (half @ (vectors / np.maximum(values, max(values[-1], 1e-12) * 1e-6))[:, ::-1][:, :rank])).astype(np.float32)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_of(text: str) -> str:
    """The last sentence of an item: what stands after the last inner sentence end, or its second half."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if x.strip()]
    if len(parts) > 1:
        return parts[-1]
    w = text.split()
    return " ".join(w[len(w) // 2 :])


class Matcher:
    #: Share of an item passage's idf weight that a candidate passage has to hold before words are compared in order.
    HELD = 0.3
    #: Items of so many words at most are candidates by shared terms alone. A passage starts every ``BLOCK`` words, so one holds
    #: any BLOCK * (WINDOW - 1) + 1 words in a row.
    SHORT = BLOCK * WINDOW // 2

    def __init__(self, table: np.ndarray, idf: np.ndarray, items: list[tuple[int, str]], least_cosine: float, sure: float, likely: float, answer: float):
        self.table, self.idf, self.ids = np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)]), idf.astype(np.float32), [i for i, _ in items]
        texts = [x.encode() for _, x in items]
        w = Words(texts)
        vectors, self.of, first = _passages(w, self.table)
        terms = _terms(w)
        # terms of the items are numbered from 1, all others are 0; a bit for each passage and number
        known = np.unique(terms)
        self.number = np.zeros(1 << TERM_BITS, np.int32)
        self.number[known] = np.arange(1, len(known) + 1)
        self.bits = np.zeros((len(vectors), len(known) // 8 + 1), np.uint8)
        self.weight = np.zeros(len(vectors), np.float32)
        for q, (i, a) in enumerate(zip(self.of, first)):
            t = terms[w.bounds[i] + a : min(w.bounds[i + 1], w.bounds[i] + a + BLOCK * WINDOW)]
            v = self.number[t]
            np.bitwise_or.at(self.bits[q], v >> 3, (1 << (v & 7)).astype(np.uint8))
            self.weight[q] = self.idf[t].sum()
        # terms of short items without the most common ones, which can't make HELD of the weight by themselves
        rare: list[tuple[int, int]] = []
        for q, i in enumerate(self.of):
            a, b = w.bounds[i], w.bounds[i + 1]
            if b - a <= self.SHORT:
                t = np.unique(terms[a:b])
                t = t[np.argsort(self.idf[t], kind="stable")]
                rare += [(int(x), q) for x in t[np.cumsum(self.idf[t]) >= self.HELD * self.idf[t].sum() * (1 - 1e-5)]]
        rare.sort()
        self.rare_of = np.asarray([q for _, q in rare], np.int64)
        self.rare_at = np.searchsorted(np.asarray([x for x, _ in rare], np.int64), np.arange((1 << TERM_BITS) + 1))
        self.is_rare = np.diff(self.rare_at) > 0
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        self.words = [w.hashes[a:b].tolist() for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        self.counts = [Counter(x) for x in self.words]
        v = Words([answer_of(x).encode() for _, x in items])
        self.answers = [v.hashes[a:b].tolist() for a, b in zip(v.bounds[:-1], v.bounds[1:])]
        self.least_cosine, self.sure, self.likely, self.answer = least_cosine, sure, likely, answer

    def _short(self, near: np.ndarray, terms: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pairs (as places in ``near``) of passages and short items that share a rare term, but for those near by cosine."""
        if not len(self.rare_of):
            return np.empty(0, np.int64)
        places = begin[0] + np.flatnonzero(self.is_rare[terms[begin[0] : begin[-1] + size[-1]]])
        # passages ascend, so those that cover a place are neighbours
        low, high = np.searchsorted(begin + size, places, "right"), np.searchsorted(begin, places, "right")
        over = np.maximum(high - low, 0)
        passage = np.repeat(low, over) + np.arange(over.sum()) - np.repeat(np.cumsum(over) - over, over)
        t = np.repeat(terms[places], over)
        low, many = self.rare_at[t], self.rare_at[t + 1] - self.rare_at[t]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        more = np.repeat(passage, many) * len(self.of) + self.rare_of[np.repeat(low, many) + nth]
        return np.unique(more[near.ravel()[more] < self.least_cosine])

    def _held(self, ps: np.ndarray, qs: np.ndarray, begin: np.ndarray, size: np.ndarray, byte: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whether passages ``ps`` hold ``HELD`` of the weight of item passages ``qs``; the last three have a row for each word, of what follows it."""
        at = begin[ps]
        hit = (self.bits.ravel()[(qs * self.bits.shape[1]).astype(np.int32)[:, None] + byte[at]] >> bit[at]) & np.uint8(1)
        value = weight[at]
        cut = np.flatnonzero(size[ps] < BLOCK * WINDOW)
        value[cut] *= np.arange(BLOCK * WINDOW) < size[ps[cut]][:, None]
        return np.einsum("ij,ij->i", hit.astype(np.float32), value) >= self.HELD * self.weight[qs]

    def search(self, texts: list[bytes]) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item) to (cosine, share of the item's words in the common subsequence, same of its answer). A very long text
        goes in pieces that overlap by more than what any item is compared with."""
        if all(len(x) <= LONG for x in texts):
            return self._search(texts)
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        overlap = 2 * (BLOCK * WINDOW + max(map(len, self.words), default=0))
        for i, x in enumerate(texts):
            for piece in cut_words(x, LONG, overlap):
                for (_, item), row in self._search([piece]).items():
                    found[i, item] = max(found.get((i, item), row), row, key=lambda r: (r[1], r[0]))
        return found

    def _search(self, texts: list[bytes]) -> dict[tuple[int, int], tuple[float, float, float]]:
        w = Words(texts)
        vectors, of, first = _passages(w, self.table)
        vectors /= np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-9)[:, None]
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        terms = np.concatenate([_terms(w), np.zeros(BLOCK * WINDOW, np.int64)])
        begin = w.bounds[:-1][of] + first
        size = np.minimum(w.bounds[1:][of] - begin, BLOCK * WINDOW)
        number = self.number[terms]
        views = [sliding_window_view(x, BLOCK * WINDOW) for x in (number >> 3, (number & 7).astype(np.uint8), np.where(number > 0, self.idf[terms], np.float32(0)))]
        for i in range(0, len(vectors), STEP):
            near = vectors[i : i + STEP] @ self.vectors.T
            short = self._short(near, terms, begin[i : i + STEP], size[i : i + STEP])
            ps, qs = np.divmod(np.concatenate([np.flatnonzero(near.ravel() >= self.least_cosine), short]), near.shape[1])
            # a few pairs at a time, so that what is looked up stays near the processor
            held = np.concatenate([np.zeros(0, bool), *[self._held(i + ps[k : k + 1024], qs[k : k + 1024], begin, size, *views) for k in range(0, len(ps), 1024)]])
            for p, q in zip(ps[held].tolist(), qs[held].tolist()):
                text, item = int(of[i + p]), int(self.of[q])
                if found.get((text, item), (0.0, 0.0))[1] == 1.0:
                    continue
                words = self.words[item]
                a = max(w.bounds[text], w.bounds[text] + first[i + p] - len(words))
                region = w.hashes[a : min(w.bounds[text + 1], w.bounds[text] + first[i + p] + BLOCK * WINDOW + len(words))].tolist()
                # no subsequence is longer than the item's words that are there at all
                there, counts = set(region), self.counts[item]
                if sum([counts[x] for x in counts.keys() & there]) < self.likely * len(words):
                    continue
                share = lcs(words, region) / max(1, len(words))
                if share < self.likely:
                    continue
                told = lcs(self.answers[item], region) / max(1, len(self.answers[item]))
                if share >= self.sure or told >= self.answer:
                    row = (float(near[p, q]), share, told)
                    found[text, item] = max(found.get((text, item), row), row, key=lambda x: (x[1], x[0]))
        return found


def matchers(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.48, sure: float = 0.7, likely: float = 0.5, answer: float = 0.7) -> Iterator[Matcher]:
    """One matcher for every ``ITEMS`` benchmark items, each made when the one before has been used. The space is fitted on
    all documents and the whole benchmark."""
    n = docs.count()
    df = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    items = benchmark.select("item_id", "text").filter(F.col("text").rlike(r"\S"))
    total = items.count()
    table = latent_space(docs.select("text").unionByName(items.select("text")), idf)
    blocks = -(-total // ITEMS)
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield Matcher(table, idf, [(r[0], r[1]) for r in rows], least_cosine, sure, likely, answer)


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer of every (document, item) where the item's text leaked.

    Null and empty texts, and items without a word, match nothing. Repeated rows give
    repeated pairs. Empty tables give no rows. A match has ``sure`` of the item's words in order
    near the passage, or ``likely`` of them with ``answer`` of the answer's.
    """
    docs = docs.select("doc_id", "text")
    out, many = None, benchmark.count() > ITEMS
    for m in matchers(docs, benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                texts, ids = utf8(batch.column(1)), batch.column(0).to_pylist()
                for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
                    found = sorted(shared.value.search(texts[a:b]).items())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([ids[a + t] for (t, _), _ in found], pa.int64()),
                            "item_id": pa.array([shared.value.ids[i] for (_, i), _ in found], pa.int64()),
                            **{k: pa.array([round(v[j], 4) for _, v in found], pa.float64()) for j, k in enumerate(("cosine", "lcs", "answer"))},
                        }
                    )

        part = docs.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs double, answer double")
        if many:  # one block's matches are written before the next block is sent
            part = stored(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer double")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay, whatever their names. Null and empty
    texts, and rows without a doc_id, are judged by their own text like all others; an empty table stays empty."""
    at, many, before = docs.columns.index("text"), benchmark.count() > ITEMS, None
    for m in matchers(docs.select("doc_id", "text"), benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                texts = utf8(batch.column(at))
                for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE):
                    bad = {t for t, _ in shared.value.search(texts[a:b])}
                    yield batch.take(pa.array([i for i in range(a, b) if i - a not in bad], pa.int64()))

        docs = map_rows(docs, run)
        if many:  # as in leaks
            docs = stored(docs)
            shared.unpersist()
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
