"""Near-duplicate detection by min-max hashing, confirmed on full shingle sets.

1. Each text gives the hashes of its distinct shingles. Under each of ``perms``
   permutations both the least and the greatest value are kept: two signature values
   for one evaluation. Bands of ``rows`` values are the buckets.
2. Texts with equal sets form a class; its smallest doc_id stands for it from here on.
3. Each class is compared with one hub, the fullest of those it shares a bucket with.
   So a bucket with m classes gives m comparisons, not m * m.
4. Classes that share a bucket with another component are contested. They are compared
   by prefixes: in the order of rarity, sets of which ``percent`` % is shared meet in the
   first (100 - percent) %. Classes whose own shingles nobody shares fill that prefix
   drop out. The rest is compared with the cleanest class it meets, then only pairs of different components are compared, and these on full sets,
   so the components are those of all links between candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG, Words, mix64, quoted, slices, stored, utf8, word_hashes
from .components import components

SHINGLE, PERMS, ROWS = 5, 72, 6
_C = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles of lower-cased words."""
    if len(texts) == 1 and len(texts[0]) > LONG:
        hashes = word_hashes(texts[0])
        w = SimpleNamespace(hashes=hashes, bounds=np.asarray([0, len(hashes)]))
    else:
        w = Words(texts)
    h = np.zeros(max(0, len(w.hashes) - size + 1), np.uint64)
    for k in range(size):
        h = h * _C + w.hashes[k : k + len(h)]
    h = mix64(h)
    out = []
    for a, b in zip(w.bounds[:-1], w.bounds[1:]):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in w.hashes[a:b]:
                    one = one * _C + x
            out.append(mix64(np.asarray([one])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def min_max(sets: list[np.ndarray], perms: int = PERMS, rows: int = ROWS) -> np.ndarray:
    """Sets (none empty) x bands: hashes of ``rows`` signature values each."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.int64)
    odd = mix64(np.arange(1, perms + 1, dtype=np.uint64)) | np.uint64(1)
    flip = mix64(np.arange(1001, 1001 + perms, dtype=np.uint64))
    sign = np.empty((2 * perms, len(sets)), np.uint64)
    for k in range(perms):
        v = (joined ^ flip[k]) * odd[k]
        sign[2 * k] = np.minimum.reduceat(v, starts)
        sign[2 * k + 1] = np.maximum.reduceat(v, starts)
    bands = 2 * perms // rows
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for v in sign[b * rows : (b + 1) * rows]:
            key = mix64(key * _C + v)
        out[:, b] = key
    return out


def signatures(docs: DataFrame, size: int = SHINGLE, perms: int = PERMS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a 128-bit digest of the set), bands (null for empty sets)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), LONG >> 1):
                sets = shingle_sets(texts[a:b], size)
                some = [s for s in sets if len(s)]
                got = iter(min_max(some, perms, rows).view(np.int64)) if some else iter(())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "d1": pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        "d2": pa.array([int(mix64(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        "bands": pa.array([next(got) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), LONG >> 1):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "sh": pa.array([s.view(np.int64) for s in shingle_sets(texts[a:b], size)], pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sh array<long>")


def _linked(a: Column, b: Column, percent: int) -> Column:
    """Whether the two sets' intersection is ``percent`` % of their union or more."""
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return F.when(F.least(na, nb) * 100 >= F.greatest(na, nb) * percent, 100 * both >= percent * (na + nb - both)).otherwise(False)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("sh").alias(f"s{x}")) for x in ("a", "b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(_linked(F.col("sa"), F.col("sb"), percent)).select("a", "b")


def _cross(pairs_of: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components (key, doc, n, comp, r) that share a key: members outside
    the key's first component against all; members of one component never meet. A pair whose sets
    can't reach the overlap with what stands from its places r on has an earlier key, or is none."""
    mixed = pairs_of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").drop("hi")
    rows = pairs_of.join(mixed, "key")
    x = rows.filter("comp <> lo").select("key", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("r").alias("ra"))
    y = rows.select("key", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("r").alias("rb"))
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    rest = 1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    near &= rest * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    return x.join(y, "key").filter((F.col("ca") != F.col("cb")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SHINGLE, perms: int = PERMS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text; other columns are ignored).

    A pair of sets at ``percent`` % shares one of the 2 * perms / rows buckets at least but
    for a chance of 1e-5 (defaults, at 85 %; less above). Null and empty texts have no shingles and are their own
    components. Rows that repeat a doc_id are one document. A null doc_id has a null component, is linked with nothing and kept.
    An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    sign = stored(signatures(docs, size, perms, rows))
    named = sign.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    member = sign.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left")
    # a doc_id with several texts ties their classes together
    several = member.filter("rep IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("r")).filter(F.size("r") > 1)
    ties = several.select("a", F.explode("r").alias("b")).filter("a <> b")

    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    bucket = stored(banded.join(shared, "key"))
    weight = bucket.groupBy("rep").agg(F.sum("m").alias("w"), F.first("n").alias("n"))
    weight = stored(weight)
    hubs = bucket.select("key", "rep").join(weight, "rep").groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("r"))).alias("h"))
    stars = bucket.select("key", "rep").join(hubs, "key").filter(-F.col("h.r") != F.col("rep")).groupBy("rep").agg(F.max("h").alias("h"))
    stars = stars.select(F.col("rep").alias("a"), (-F.col("h.r")).alias("b"))
    sets = stored(_sets(docs.join(weight.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), size).dropDuplicates(["doc_id"]))
    links = stored(_confirmed(stars, sets, percent).unionByName(ties))
    first = components(links)

    # what the stars left open
    placed = bucket.join(first, bucket.rep == first.node, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_ = stored(placed.join(mixed, "key").groupBy("rep").agg(F.first("n").alias("n"), F.first("comp").alias("comp")))
    items = open_.join(sets, open_.rep == sets.doc_id).select(F.col("rep").alias("doc"), "n", "comp", F.explode("sh").alias("key"))
    counts = items.groupBy("key").agg(F.count("*").alias("df"), F.min("doc").alias("doc"))
    own = counts.filter("df = 1").groupBy("doc").agg(F.count("*").alias("own"))
    allowed = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1  # length of the prefix
    left = open_.join(own, open_.rep == own.doc, "left").withColumn("own", F.coalesce("own", F.lit(0))).filter(F.col("own") < allowed)
    left = stored(left.select("rep", "n", "comp", "own"))
    items = left.join(sets, left.rep == sets.doc_id).select(F.col("rep").alias("doc"), "n", "comp", "own", F.explode("sh").alias("key"))
    counts = items.groupBy("key").agg(F.count("*").alias("df"))
    order = F.row_number().over(Window.partitionBy("doc").orderBy("df", "key"))
    prefix = stored(items.join(counts, "key").withColumn("r", order).filter(F.col("r") <= allowed).filter("df > 1").select("key", "doc", "n", "comp", "own", "r"))
    # first with the class of the key that has fewest shingles of its own: the nearest to a common source
    clean = prefix.groupBy("key").agg(F.min(F.struct("own", "doc", "comp")).alias("h"))
    near = prefix.join(clean, "key").filter(F.col("h.comp") != F.col("comp")).groupBy("doc").agg(F.min("h").alias("h"))
    stars = stored(_confirmed(near.select(F.col("doc").alias("a"), F.col("h.doc").alias("b")), sets, percent))
    links = links.unionByName(stars)
    second = components(links)
    placed = prefix.join(second, prefix.doc == second.node, "left").select("key", "doc", "n", "r", F.coalesce("component", "doc").alias("comp"))
    more = stored(_confirmed(_cross(placed, percent), sets, percent))
    final = components(links.unionByName(more))

    known = member.join(final, member.rep == final.node, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return known.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` but for those whose component has a smaller doc_id; all columns stay."""
    gone = near_duplicates(docs, **options).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
