"""Language identification with language-bitmask n-gram filters.

The filter is one table of bit-sliced Bloom filters: a slot holds one bit for each
language, and the AND of an n-gram's slots gives all languages that contain it at once.
A document's bits are counted for each language and corrected for the share that the
language's own filter would answer by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_rows, mix64, slices, stored

N, SLOT_BITS, HASHES = 4, 18, 2
#: Characters that are hashed at a time.
PIECE = 1 << 19


def in_fold(doc_id: Column, mod: int = 3, rest: int = 1) -> Column:
    """Whether a row is held out of training: crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased texts, the bounds of each text's, and its letters.

    Whatever is no letter counts as one space; texts are padded by spaces.
    """
    joined = "\0\0".join(x.lower() for x in texts) + "\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    # lower() can change lengths, so texts' ends are found by their marks, of which the texts' own zeros are none
    lengths = np.fromiter((len(x.lower()) + 2 for x in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    mark = np.zeros(len(codes), bool)
    mark[ends - 1] = mark[ends - 2] = True
    keep = letter | mark
    keep[1:] |= letter[:-1] & ~letter[1:]
    keep[ends[:-1]] = True
    keep[:1] = True
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[keep]
    c = np.concatenate([[32], codes[keep], [32] * N]).astype(np.uint64)
    h = np.zeros(len(doc), np.uint64)
    for k in range(N):
        h = h * np.uint64(0x100000001B3) + c[k : k + len(doc)]
    whole = np.ones(len(doc), bool)
    has = letter[keep]
    near = np.concatenate([has, [False] * N])
    whole = near[: len(doc)] | near[1 : len(doc) + 1]
    bounds = np.searchsorted(doc[whole], np.arange(len(texts) + 1))
    return mix64(h[whole]), bounds, np.bincount(doc, has, len(texts)).astype(np.int64)


class BitFilter:
    """Bit-sliced Bloom filters of several languages, 64 to a word."""

    def __init__(self, langs: list[str], slot_bits: int = SLOT_BITS):
        self.langs, self.mask = langs, np.uint64((1 << slot_bits) - 1)
        self.table = np.zeros((-(-len(langs) // 64), 1 << slot_bits), np.uint64)

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(24 * k)) & self.mask).astype(np.int64) for k in range(HASHES)]

    def add(self, lang: int, h: np.ndarray) -> None:
        for s in self.slots(h):
            self.table[lang // 64, s] |= np.uint64(1 << (lang % 64))

    def counts(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts x languages: n-grams found, corrected for false positives."""
        n = np.diff(bounds).astype(float)
        out = np.zeros((len(n), len(self.langs)))
        slots = self.slots(h)
        for word, table in enumerate(self.table):
            bits = table[slots[0]]
            for s in slots[1:]:
                bits &= table[s]
            for lang in range(64 * word, min(64 * word + 64, len(self.langs))):
                bit = np.uint64(lang % 64)
                total = np.concatenate([[0], np.cumsum((bits >> bit) & np.uint64(1))]).astype(float)
                wrong = float(((table >> bit) & np.uint64(1)).mean()) ** HASHES
                out[:, lang] = np.maximum(0, (np.diff(total[bounds]) - n * wrong) / max(1 - wrong, 1e-9))
        return out


def most_frequent(counted: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows (lang, g, n) of each lang with the highest n, ties by least g. Langs are never gathered in a task: histograms, which are
    added up before they are shuffled, tell the n and, among the rows that have just that n, the g from which a row is left out."""
    n_at: dict[int, tuple[int, int]] = {}  # lang to the n at which the k-th row stands, and how many rows of that n are in
    for r in counted.groupBy("lang", "n").count().orderBy("lang", F.desc("n")).toLocalIterator():  # as many as there are different counts
        if r["lang"] not in n_at or n_at[r["lang"]][1] > 0:
            left = n_at[r["lang"]][1] if r["lang"] in n_at else k
            n_at[r["lang"]] = (r["n"], left - r["count"])
    rows = [(x, n, left) for x, (n, left) in n_at.items() if left < 0]  # too many rows of that n
    if not rows:
        return counted
    last = F.broadcast(counted.sparkSession.createDataFrame(rows, "of int, last long, over long"))
    joined = counted.join(last, counted["lang"] == last["of"], "left").filter(F.col("of").isNull() | (F.col("n") >= F.col("last")))
    ties = joined.filter(F.col("n") == F.col("last"))
    bucket = F.shiftright("g", 52)
    room = {r["of"]: (r["c"] + r["over"]) for r in ties.groupBy("of", "over").agg(F.count("*").alias("c")).collect()}
    cuts: dict[int, tuple[int, int]] = {}  # lang to the bucket in which the room ends, and how many of it fit
    for r in ties.groupBy("of", bucket.alias("b")).agg(F.count("*").alias("c")).orderBy("of", "b").collect():  # 4096 buckets a lang
        if r["of"] not in cuts:
            if room[r["of"]] < r["c"]:
                cuts[r["of"]] = (r["b"], room[r["of"]])
            else:
                room[r["of"]] -= r["c"]
    kept = F.lit(False)
    edge = ties.filter(F.coalesce(*[F.when((F.col("of") == x) & (bucket == b), F.lit(True)) for x, (b, _) in cuts.items()], F.lit(False))) if cuts else None
    inside: dict[int, list[int]] = {}
    if edge is not None:
        for r in edge.select("of", "g").orderBy("of", "g").collect():
            inside.setdefault(r["of"], []).append(r["g"])
    for x, (b, fit) in cuts.items():
        taken = inside.get(x, [])[:fit]
        kept = kept | ((F.col("of") == x) & ((bucket < b) | ((bucket == b) & (F.col("g") <= taken[-1]) if taken else F.lit(False))))
    return joined.filter(F.col("of").isNull() | (F.col("n") > F.col("last")) | kept).select("lang", "g", "n")


def learn(docs: DataFrame, train: Column, grams_per_lang: int = 8000, least_share: float = 0.05) -> BitFilter:
    """Fit the filter on all rows with a lang where ``train`` holds.

    A language's filter gets its ``grams_per_lang`` most frequent n-grams, without those
    that are under ``least_share`` as frequent as in another language (foreign lines).
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return BitFilter([])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, lang = batch.column(1).to_pylist(), np.asarray([langs.index(x) for x in batch.column(2).to_pylist()])
            pieces = [x[k : k + PIECE + N - 1] for x in texts for k in range(0, max(1, len(x)), PIECE)]
            lang = np.repeat(lang, [max(1, -(-len(x) // PIECE)) for x in texts])
            for a, b in slices(np.fromiter(map(len, pieces), np.int64, len(pieces)), PIECE):
                h, bounds, _ = grams(pieces[a:b])
                of = np.repeat(lang[a:b], np.diff(bounds))
                for x in np.unique(of):
                    g, n = np.unique(h[of == x], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(g), x), pa.int32()), "g": pa.array(g.view(np.int64)), "n": pa.array(n, pa.int64())})

    counted = stored(rows.mapInArrow(count, "lang int, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")))
    got = most_frequent(counted, grams_per_lang).toPandas()
    drop_stored(counted)
    got["share"] = got.n / got.groupby("lang").n.transform("sum")
    got = got[got.share >= least_share * got.groupby("g").share.transform("max")]
    out = BitFilter(langs)
    for x, part in got.groupby("lang"):
        out.add(int(x), part.g.to_numpy(np.int64).view(np.uint64))
    return out


def _judged(column, m: BitFilter) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """Slices of an Arrow column of texts: first row, languages, scores and coverages. A text longer than ``PIECE`` is read in
    pieces that overlap by an n-gram less one, and their counts are added up."""
    texts = [x or "" for x in column.to_pylist()]
    for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), PIECE):
        pieces = [texts[i][k : k + PIECE + N - 1] for i in range(a, b) for k in range(0, max(1, len(texts[i])), PIECE)]
        of = np.repeat(np.arange(b - a), [max(1, -(-len(x) // PIECE)) for x in texts[a:b]])
        count = np.zeros((b - a, max(1, len(m.langs))))
        total, letters = np.zeros(b - a), np.zeros(b - a)
        for i, j in [(0, len(pieces))] if len(pieces) == b - a else [(k, k + 1) for k in range(len(pieces))]:
            h, bounds, n = grams(pieces[i:j])
            np.add.at(total, of[i:j], np.diff(bounds))
            np.add.at(letters, of[i:j], n)
            if m.langs:
                np.add.at(count, of[i:j], m.counts(h, bounds))
        best, first, some = count.argmax(1), count.max(1), letters > 0
        count[np.arange(b - a), best] = 0
        second = count.max(1)
        score = np.where(some & (first > 0), first / np.maximum(first + second, 1e-9), 0.0)
        cover = np.where(some, first / np.maximum(total, 1), 0.0)
        yield a, [m.langs[x] if ok and m.langs else "und" for x, ok in zip(best, some)], np.round(score, 6), np.round(np.minimum(cover, 1.0), 6)


def identify(docs: DataFrame, model: BitFilter) -> DataFrame:
    """doc_id, lang_pred, score, coverage of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``und`` with score 0 for null texts, texts without a letter, and an empty model. Otherwise the language with
    the most n-grams (ties: the first by name); ``score`` is its share in those of the two best; ``coverage`` is
    the share of the text's n-grams that it has. Repeated rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, names, score, cover in _judged(batch.column(1), shared.value):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, len(names)), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "coverage": pa.array(cover)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, coverage double")


def language_id(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows that aren't held out and predict all: doc_id, held_out, lang_pred, score, coverage."""
    docs = docs.select("doc_id", "text", "lang")
    model = learn(docs, ~in_fold(F.col("doc_id")), **options)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "coverage")


def keep_identified(docs: DataFrame, least_coverage: float = 0.05, **options) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und``, and at least ``least_coverage`` of
    the n-grams are those of the predicted language. Rows keep all their columns, whatever their names; null doc_ids and
    repeated rows are judged by their own text; null and empty texts go; an empty table stays empty."""
    model = learn(docs.select("doc_id", "text", "lang"), ~in_fold(F.col("doc_id")), **options)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good = [np.zeros(0, np.int64)]
            for a, names, _, cover in _judged(batch.column(at), shared.value):
                good.append(a + np.flatnonzero((np.asarray(names) != "und") & (cover >= least_coverage)))
            yield batch.take(pa.array(np.concatenate(good)))

    return map_rows(docs, run)
