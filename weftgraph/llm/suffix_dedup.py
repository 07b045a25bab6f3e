"""Removal of repeated byte strings by a hash-compared suffix sort.

All 100-byte strings ("windows") of all texts are judged exactly, without a row for
each. A window is led by the least of the hashes of its short strings (its anchor), so
equal windows have equal anchors, and the windows of a text fall into runs of about
``length - ANCHOR`` with one anchor.

1. Runs whose anchor is alone in the corpus hold no repeated window. The others stay.
2. Equal runs (two 64-bit hashes of their bytes, of their anchor, and their lengths agree) form a class, whose first
   member stands for it; all windows of the others are repeats.
3. Where an anchor has several classes, runs end at different places (at the edges of a copied passage). Each window
   reaches far to the right of its anchor, or to the left; classes that agree in these bytes form a group, and the bytes of
   their first members are sent to one task, which sorts the windows as suffixes by mergesort: two suffixes are compared
   by their longest common extension, which binary search over prefix polynomial hashes finds in a logarithmic
   number of steps; then one byte decides. Equal windows are neighbours in that order; those that agree over the whole
   length are verified byte by byte, and the smallest (document, start) of them is the first one. Groups of very many classes
   are dealt out by the windows' places before their anchors as well, and then by the windows themselves, so none stays in one task.
4. Each text gets its repeated windows and drops the bytes that they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, _INVERSE, drop_stored, mix64, parts, quoted, powers, slices, stored, utf8

LENGTH, ANCHOR = 100, 36
_OTHER = mix64(np.arange(7001, 7257, dtype=np.uint64))


class Hashes:
    """Prefix polynomial hashes of a byte array (modulo 2**64, random byte values)."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        self.data = data
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers(len(data)), out=self.prefix[1:])
        self.down = powers(len(data) + 1, _INVERSE)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Longest common extension of the suffixes at a and b, up to ``limit``, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.of(a, mid) == self.of(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Whether suffix a stands before suffix b (first ``limit`` bytes; ties by place)."""
        n = self.common(a, b, limit)
        at = np.minimum(n, limit - 1)
        x, y = self.data[a + at], self.data[b + at]
        return np.where(n < limit, x < y, a < b)


def suffix_sort(h: Hashes, starts: np.ndarray, limit: int = LENGTH, group: np.ndarray | None = None) -> np.ndarray:
    """``starts`` in the order of (group, suffix's first ``limit`` bytes, place); groups ascend along ``starts``.

    Bottom-up mergesort within the groups; all merges of a level run at once: an element's place is its own
    rank plus its rank in the sibling run, which binary search finds. Levels go on as far as the largest group needs, and
    elements of groups that are in order are left alone.
    """
    s = np.array(starts, np.int64)
    n, width = len(s), 1
    if not n:
        return s
    heads = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if group is not None else np.zeros(1, np.int64)
    sizes = np.diff(np.concatenate([heads, [n]]))
    low, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    while width < sizes.max():
        index = np.flatnonzero(size > width)  # elements whose group isn't sorted yet
        first, last = low[index], low[index] + size[index]
        pair = first + (index - first) // (2 * width) * (2 * width)
        right = index - pair >= width
        lo = np.where(right, pair, np.minimum(pair + width, last))
        begin = lo.copy()
        hi = np.where(right, np.minimum(pair + width, last), np.minimum(pair + 2 * width, last))
        while len(k := np.flatnonzero(lo < hi)):
            mid = (lo[k] + hi[k]) // 2
            before = h.less(s[mid], s[index[k]], limit)
            lo[k] = np.where(before, mid + 1, lo[k])
            hi[k] = np.where(before, hi[k], mid)
        place = np.where(right, index - width, index) + (lo - begin)
        moved = s[index]
        s[place] = moved
        width *= 2
    return s


def first_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Which of ``starts`` (a window each, in order of precedence within each ``group``, groups ascending) are the first of
    their kind in the group: suffixes are sorted, neighbours' common extension tells which are equal, and bytes verify it."""
    h = Hashes(data)
    # only windows that begin and end alike can be equal: the rest needs no sort
    key = mix64(h.of(starts, 16)) ^ h.of(starts + limit - 16, 16) ^ mix64(group.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    alike = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    more = alike | np.concatenate([alike[1:], [False]])
    out = np.ones(len(starts), bool)
    some = order[more]
    if not len(some):
        return out
    bunch = np.cumsum(~alike)[more]
    # the sort goes by places in ``data``, and these ascend with precedence within a bunch
    s = suffix_sort(h, starts[some], limit, bunch)
    same = np.concatenate([[False], (h.common(s[:-1], s[1:], limit) == limit) & (bunch[1:] == bunch[:-1])])
    span = np.arange(limit)
    k = np.flatnonzero(same)
    for j in range(0, len(k), 1 << 14):  # verified byte by byte
        part = k[j : j + (1 << 14)]
        same[part] = (data[s[part - 1][:, None] + span] == data[s[part][:, None] + span]).all(1)
    where = np.argsort(starts, kind="stable")
    out[where[np.searchsorted(starts[where], s[same])]] = False
    return out


def side(length: int, anchor: int) -> int:
    """How far the bytes on one side of an anchor reach: every window has so many before its anchor, or after it."""
    return (length - anchor) // 2


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first start (in ``data``), bytes, anchor hash, two hashes of the bytes, the
    anchor's place in the run, hashes of the bytes to its right and left (0 where no window has them)."""
    none, far = np.empty(0, np.int64), side(length, anchor)
    zero = none.view(np.uint64)
    nothing = (none, none, none, zero, zero, zero, none, zero, zero)
    if len(data) < length:
        return nothing
    h, other = Hashes(data), Hashes(data, _OTHER)
    gram, starts, lead = _led(h, offsets, length, anchor)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(starts):
        return nothing
    new = np.flatnonzero(np.concatenate([[True], (np.diff(lead) != 0) | (np.diff(starts) != 1)]))
    first = starts[new]
    size = np.diff(np.concatenate([new, [len(starts)]])) + length - 1
    at, wide = lead[new], anchor + far
    to_right, to_left = at - (first + size - length) <= far, at - first > far
    right = np.where(to_right, mix64(h.of(np.where(to_right, at, 0), wide)), np.uint64(0))
    left = np.where(to_left, mix64(h.of(np.where(to_left, at - far, 0), wide)), np.uint64(0))
    whole = [mix64(x.of(first, size) + size.astype(np.uint64)) for x in (h, other)]
    return text[first], first, size, gram[at], *whole, at - first, right, left


def leads(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """The anchors' hashes of ``runs``, once for each run."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    gram, starts, lead = _led(Hashes(data), offsets, length, anchor)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(lead) != 0) | (np.diff(starts) != 1)])) if len(starts) else starts
    return gram[lead[new]]


def _led(h: Hashes, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all anchors' places, starts of the windows that lie within one text, and the place of each one's anchor."""
    n = len(h.data) - anchor + 1
    gram = mix64((h.prefix[anchor:] - h.prefix[:n]) * h.down[:n])
    packed = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    window, have = length - anchor + 1, 1
    while 2 * have <= window:
        packed = np.minimum(packed[:-have], packed[have:])
        have *= 2
    if have < window:
        packed = np.minimum(packed[: len(packed) - (window - have)], packed[window - have :])
    lead = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # a window that starts so near a text's end that it would reach over it isn't one (texts end by one byte that isn't theirs)
    inside = np.ones(len(lead), bool)
    edge = np.zeros(len(h.data) + 1, np.int32)
    np.add.at(edge, np.maximum(offsets[1:] - length, offsets[:-1]), 1)
    np.add.at(edge, offsets[1:], -1)
    inside = np.cumsum(edge)[: len(lead)] == 0
    starts = np.flatnonzero(inside)
    return gram, starts, lead[starts]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


#: Bytes of text whose windows are hashed at a time; a longer text goes in pieces that overlap by a window less one byte.
PIECE = 1 << 19
#: Classes of one group up to which its first members are compared in one task; larger groups are dealt out further.
CROWD = 1 << 12


def _pieces(blobs: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in slices of about ``PIECE`` bytes: joined bytes, their offsets, and for each its row and place in the text."""
    rows, places, parts = [], [], []
    for i, x in enumerate(blobs):
        for k in range(0, max(1, len(x) - length + 1), PIECE):
            rows.append(i)
            places.append(k)
            parts.append(x[k : k + PIECE + length - 1] if len(x) > PIECE + length - 1 else x)
    for a, b in slices(np.fromiter(map(len, parts), np.int64, len(parts)), PIECE):
        yield *_joined(parts[a:b]), np.asarray(rows[a:b], np.int64), np.asarray(places[a:b], np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept``, the remaining bytes, of every row of ``docs`` (doc_id, text).

    With ``carry`` each row has these columns of its, as struct ``row``, and instead of ``kept`` the remaining text, ``rest``: characters
    of which bytes go are left out of it, null stays null.

    A byte goes if a ``length``-byte string over it also starts earlier: in a row with a
    smaller doc_id, or earlier in its own. Null text counts as empty. Null doc_id counts as the smallest.
    Rows that agree in doc_id and text are one document; rows that repeat a doc_id with other texts
    are documents in the order of a text hash. Texts under ``length`` bytes lose nothing. An empty table gives no rows.
    """
    row = F.struct(*map(quoted, carry)) if carry else F.lit(0)
    twice = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count()
    # no literal: Spark would take a constant out of the keys, and then the exchange would not serve the join
    sub = F.xxhash64(F.coalesce("text", F.lit(""))) if twice else F.xxhash64("doc_id").bitwiseAND(F.lit(0))
    own = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), sub.alias("sub"), "text", row.alias("row"))

    def count(batches: Iterator) -> Iterator:
        held: list[np.ndarray] = []
        for batch in batches:
            for data, offsets, _, _ in _pieces(utf8(batch.column(0)), length):
                held.append(leads(data, offsets, length, anchor))
                if sum(map(len, held)) > 1 << 18:  # counted here before they are shuffled
                    yield _counted(held)
                    held = []
        if held:
            yield _counted(held)

    def _counted(held: list[np.ndarray]):
        import pyarrow as pa

        lead, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"lead": pa.array(lead.view(np.int64)), "n": pa.array(n.astype(np.int32))})

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, subs = (batch.column(i).to_numpy() for i in (0, 1))
            for data, offsets, rows, places in _pieces(utf8(batch.column(2)), length):
                of, first, size, lead, w1, w2, off, right, left = runs(data, offsets, length, anchor)
                yield pa.RecordBatch.from_pydict(
                    {
                        **{k: pa.array(v.view(np.int64)) for k, v in (("lead", lead), ("w1", w1), ("w2", w2))},
                        "id": pa.array(ids[rows[of]]),
                        "sub": pa.array(subs[rows[of]]),
                        "at": pa.array((first - offsets[of] + places[of]).astype(np.int32)),
                        "size": pa.array(size.astype(np.int32)),
                        "off": pa.array(off.astype(np.int32)),
                        **{k: pa.array(v.view(np.int64)) for k, v in (("right", right), ("left", left))},
                    }
                )

    # stored apart, so that the join that follows may split the runs of a very common anchor
    shared = stored(own.select("text").mapInArrow(count, "lead long, n int").groupBy("lead").agg(F.sum("n").alias("n")).filter("n > 1").select("lead"))
    found = own.select("id", "sub", "text").mapInArrow(find, "lead long, w1 long, w2 long, id long, sub long, at int, size int, off int, right long, left long")
    again = stored(found.join(shared, "lead", "left_semi"))
    drop_stored(shared)
    place = F.struct("id", "sub", "at")
    classes = stored(again.groupBy("lead", "w1", "w2", "size", "off").agg(F.min(F.struct("id", "sub", "at")).alias("p"), *[F.first(c).alias(c) for c in ("right", "left")]))
    far, count_ = side(length, anchor), F.col("size") - length + 1
    skipped = F.greatest(F.col("off") - far, F.lit(0))  # windows that reach to the left
    # a side's windows: their first start, how many, and the anchor's place
    anchor_at = (F.col("p.at") + F.col("off")).alias("anchor")
    sides = (
        classes.select("lead", F.lit(0).alias("side"), F.col("right").alias("h"), "p", (F.col("p.at") + skipped).alias("at"), (count_ - skipped).alias("n"), anchor_at)
        .unionByName(classes.select("lead", F.lit(1).alias("side"), F.col("left").alias("h"), "p", F.col("p.at").alias("at"), F.least(count_, skipped).alias("n"), anchor_at))
        .filter("h <> 0 AND n > 0")
        .select(F.xxhash64("lead", "side", "h").alias("g"), "p.id", "p.sub", "at", (F.col("n") + length - 1).alias("size"), "anchor")
    )
    met = stored(sides.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1"))
    open_ = stored(sides.join(met, "g").withColumn("crowd", F.col("m") > CROWD).drop("m"))
    drop_stored(met)

    texts = own.repartition(parts(docs.select("doc_id", "text"), 16 << 20), "id", "sub")
    unsure = open_.groupBy("id", "sub").agg(F.collect_list(F.struct("at", "size", "anchor", "g", "crowd")).alias("r"))

    def cut_out(batches: Iterator) -> Iterator:
        """Bytes of the sides; windows of crowded groups one by one, but for those that this task has met before."""
        import pyarrow as pa

        names = ("g", "id", "sub", "at", "anchor", "bytes")
        for batch in batches:
            blobs = utf8(batch.column(2))
            ids, subs, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            out, held, seen = {k: [] for k in names}, 0, {}
            for i, blob in enumerate(blobs):
                flat = lists[i].values
                at, size, anchored, g, crowd = (flat.field(k).to_pylist() for k in range(5))
                for k in range(len(at)):
                    if not crowd[k]:
                        row = (g[k], ids[i], subs[i], at[k], anchored[k] - at[k], blob[at[k] : at[k] + size[k]])
                        for name, v in zip(names, row):
                            out[name].append(v)
                        held += size[k]
                        continue
                    for x in range(at[k], at[k] + size[k] - length + 1):
                        # the window's place before the anchor and its own bytes deal the group out
                        window, key = blob[x : x + length], (g[k], anchored[k] - x)
                        now = (ids[i], subs[i], x)
                        if (key, window) not in seen or now < seen[key, window]:
                            seen[key, window] = now
                if held + len(seen) * length > 4 << 20:
                    yield from _rows(out, seen, names)
                    out, held, seen = {k: [] for k in names}, 0, {}
            yield from _rows(out, seen, names)

    def _rows(out: dict, seen: dict, names: tuple) -> Iterator:
        import pyarrow as pa

        for ((g, off), window), (id_, sub_, x) in seen.items():
            salted = int.from_bytes(hashlib.blake2b(window, digest_size=8, key=(g & (1 << 64) - 1).to_bytes(8, "little") + bytes([off])).digest(), "little", signed=True)
            for name, v in zip(names, (salted, id_, sub_, x, off, window)):
                out[name].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        if out["g"]:
            yield pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in zip(names, kinds)})

    def decide(batches: Iterator) -> Iterator:
        """The first windows of each group. Rows come sorted by group, document and place; a slice ends where a group does."""
        import pyarrow as pa

        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 4096:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column(0).to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield from _firsts(table.slice(0, cut))
                table = table.slice(cut)
            held = table.to_batches()
        if held:
            yield from _firsts(pa.Table.from_batches(held).combine_chunks())

    def _firsts(table) -> Iterator:
        import pyarrow as pa

        size = np.asarray([len(x) for x in table.column(5).to_pylist()], np.int64)
        g = table.column(0).to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        # slices of whole groups
        for a, b in slices(np.add.reduceat(size, heads), PIECE):
            lo, hi = heads[a], heads[b] if b < len(heads) else len(g)
            part = table.slice(lo, hi - lo)
            data = np.frombuffer(b"".join(part.column(5).to_pylist()) + b"\0", np.uint8)
            n = size[lo:hi] - length + 1
            begin = np.concatenate([[0], np.cumsum(size[lo:hi])[:-1]])
            of = np.repeat(np.arange(hi - lo), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            # windows at different places before the anchor differ in their anchors' places, so they are groups of their own
            before = part.column(4).to_numpy()[of] - within
            order = np.lexsort((np.arange(len(of)), before, np.cumsum(np.concatenate([[0], np.diff(g[lo:hi]) != 0]))[of]))
            of, within, before = of[order], within[order], before[order]
            group = np.cumsum(np.concatenate([[0], (np.diff(g[lo:hi][of]) != 0) | (np.diff(before) != 0)]))
            good = first_windows(data, begin[of] + within, group, length)
            of, within = of[good], within[good]
            yield pa.RecordBatch.from_pydict({"id": part.column(1).to_numpy()[of], "sub": part.column(2).to_numpy()[of], "at": (part.column(3).to_numpy()[of] + within).astype(np.int32)})

    opened = texts.join(unsure, ["id", "sub"]).select("id", "sub", "text", "r").mapInArrow(cut_out, "g long, id long, sub long, at int, off int, bytes binary")
    dealt = opened.repartition(parts(docs.select("doc_id", "text"), 16 << 20), "g").sortWithinPartitions("g", "id", "sub", "at")
    earliest = stored(dealt.mapInArrow(decide, "id long, sub long, at int"))

    kind = lambda frame, k, size: frame.select("id", "sub", F.struct("at", size.cast("int").alias("size"), F.lit(k).alias("kind")).alias("x"))
    marks = (
        kind(again, 0, F.col("size"))
        .unionByName(kind(classes.select("p.id", "p.sub", "p.at"), 1, F.lit(0)))
        .unionByName(kind(open_, 2, F.col("size")))
        .unionByName(kind(earliest, 3, F.lit(0)))
        .groupBy("id", "sub")
        .agg(F.collect_list("x").alias("marks"))
    )

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column, lists = batch.column(2), batch.column(3)
            blobs = utf8(column)
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", left)}
            for i, blob in enumerate(blobs):
                spans = repeated_spans(len(blob), lists[i].values, length) if lists[i].is_valid else []
                removed = sum(b - a for a, b in spans)
                if carry:
                    spans = [whole_characters(blob, a, b) for a, b in spans]
                kept, last = [], 0
                for a, b in spans:
                    kept.append(blob[last:a])
                    last = b
                kept = b"".join([*kept, blob[last:]]) if column[i].is_valid or not carry else None
                for k, v in zip(out, (len(blob), removed, len(spans), kept)):
                    out[k].append(v)
            numbers = {k: pa.array(v, pa.int64()) for k, v in out.items() if k != left}
            blob = pa.array(out[left], pa.binary())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "row": batch.column(1), **numbers, left: blob.view(pa.string()) if carry else blob})

    left = "rest" if carry else "kept"
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", own.schema["row"].dataType), *[T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")], T.StructField(left, T.StringType() if carry else T.BinaryType())])
    done = texts.join(marks, ["id", "sub"], "left").select("id", "row", "text", "marks").mapInArrow(cut, schema)
    out = done.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", left, "row")
    return out if carry else out.drop("row")


def whole_characters(blob: bytes, a: int, b: int) -> tuple[int, int]:
    """The span a to b of UTF-8 bytes, widened to whole characters."""
    while a and blob[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(blob) and blob[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def repeated_spans(n: int, marks, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal covered byte spans of a text of n bytes from its marks (Arrow structs at, size, kind).

    Kinds: 0 a run with a shared anchor, 1 the first of its class, 2 windows of such a first
    that were looked at one by one, 3 a window that is the first of its kind.
    """
    at, size, kind = (marks.field(i).to_numpy().astype(np.int64) for i in range(3))
    use = (kind == 2) | (kind == 0) & ~np.isin(at, at[kind == 1])
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, at[use], 1)
    np.add.at(edge, at[use] + size[use] - length + 1, -1)
    window = np.cumsum(edge) > 0
    window[at[kind == 3]] = False
    s = np.flatnonzero(window)
    if not len(s):
        return []
    breaks = np.flatnonzero(np.diff(s) > length)
    return [(int(a), int(b) + length) for a, b in zip(s[np.concatenate([[0], breaks + 1])], s[np.concatenate([breaks, [len(s) - 1]])])]


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (and ``n_chars``, where there is one, told anew).

    A character whose bytes go in part goes as a whole. Rows of which nothing but white space is left
    after a cut are dropped; rows that lose nothing stay as they are. All columns stay, in their order.
    """
    out = remove_repeats(docs, length, carry=[c for c in docs.columns if c != "text"])
    cut = F.col("n_removed") > 0
    out = out.filter(~cut | F.col("rest").rlike(r"\S"))
    new = {"text": F.col("rest")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("rest")).otherwise(F.col("row.n_chars")).cast("long")
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (see ``remove_repeats``)."""
    out = remove_repeats(docs.select("doc_id", "text"), length)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
