"""Graph algorithms: PageRank, connected components, betweenness."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..catalog import DST, SRC
from ..plans.parser import QueryError
from ..runtime import discard, materialize

#: Edges up to which an adjacency is sent to every task for betweenness; beyond it the call is refused. Nodes with the same edges out count once.
MAX_BROADCAST_EDGES = 5_000_000
#: Nodes, classes and edges that the searches which a task runs together may touch (of memory and speed only).
SEARCHED_AT_ONCE = 16_000_000


def edges_of(session, rel: str | None = None) -> DataFrame:
    """Edges of one relationship table, or of all whose keys are integers."""
    tables = [session.catalog.need(rel, False)] if rel else session.catalog.rels()
    frames = [t.df.select(F.col(SRC).cast("bigint").alias(SRC), F.col(DST).cast("bigint").alias(DST)) for t in tables if t.df.schema[SRC].dataType.typeName() in ("byte", "short", "integer", "long")]
    if not frames:
        raise QueryError("no relationships with integer keys")
    return reduce(lambda a, b: a.unionByName(b), frames).filter(F.col(SRC).isNotNull() & F.col(DST).isNotNull())


def pagerank(edges: DataFrame, damping: float = 0.85, max_iterations: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """node_id, rank. Starts at 1/n; ranks of nodes without out-edges go to all alike; parallel edges
    count; ends after ``max_iterations`` or when the ranks move by less than ``tolerance`` in sum.

    Edges are summed up to weights once. A round joins ranks with them (both by source) and
    adds up by target; the rank that dangles and the change are one aggregate of the round before.
    """
    weights = edges.groupBy(SRC, DST).agg(F.count("*").alias("_m"))
    out = weights.groupBy(SRC).agg(F.sum("_m").alias("_out"))
    weights = materialize(weights.join(out, SRC).select(SRC, DST, (F.col("_m") / F.col("_out")).alias("_w")))
    nodes = materialize(weights.select(F.col(SRC).alias("node_id")).union(weights.select(DST)).distinct().join(out.select(F.col(SRC).alias("node_id"), F.lit(True).alias("_has")), "node_id", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("rank"))
    ranks, written = nodes.select("node_id", "_has", F.lit(1.0 / n).alias("rank")), nodes
    dangling = ranks.filter(F.col("_has").isNull()).count() / n
    for _ in range(max_iterations):
        given = ranks.join(weights, ranks.node_id == weights[SRC]).groupBy(F.col(DST).alias("_to")).agg(F.sum(F.col("rank") * F.col("_w")).alias("_in"))
        base = (1 - damping) / n + damping * dangling / n
        step = ranks.join(given, ranks.node_id == given["_to"], "left")
        # what the next round and the end need to know is observed while the round is written
        seen = Observation()
        new = step.select("node_id", "_has", (F.lit(base) + damping * F.coalesce("_in", F.lit(0.0))).alias("rank"), F.col("rank").alias("_old"))
        new = new.observe(seen, F.coalesce(F.sum(F.when(F.col("_has").isNull(), F.col("rank"))), F.lit(0.0)).alias("dangling"), F.coalesce(F.sum(F.abs(F.col("rank") - F.col("_old"))), F.lit(0.0)).alias("moved"))
        round_ = materialize(new.drop("_old"))
        discard(written)
        ranks = written = round_
        dangling = seen.get["dangling"]
        if seen.get["moved"] < tolerance:
            break
    discard(weights)
    return ranks.select("node_id", "rank")


def components(edges: DataFrame) -> DataFrame:
    """node_id, component: the least node that is connected, in whatever direction. Labels spread along
    edges and are followed to their own labels, so rounds grow with the logarithm of a component's width."""
    both = materialize(edges.select(SRC, DST).union(edges.select(DST, SRC)).toDF(SRC, DST).distinct())
    labels = written = materialize(both.groupBy(F.col(SRC).alias("node_id")).agg(F.least(F.min(DST), F.first(SRC)).alias("component")))
    while True:
        near = both.join(labels, both[DST] == labels.node_id).groupBy(SRC).agg(F.min("component").alias("_near"))
        spread = labels.join(near, labels.node_id == near[SRC]).select("node_id", F.col("component").alias("_old"), F.least("component", "_near").alias("_next"))
        upper = labels.select(F.col("node_id").alias("_next"), F.col("component").alias("_up"))
        new = materialize(spread.join(upper, "_next", "left").select("node_id", F.least("_next", F.coalesce("_up", "_next")).alias("component"), "_old"))
        discard(written)
        if new.filter("component <> _old").isEmpty():
            discard(both)
            return new.select("node_id", "component")
        labels, written = new.select("node_id", "component"), new


def betweenness(edges: DataFrame) -> DataFrame:
    """node_id, centrality: shares of shortest directed paths through each node, not normalised; parallel
    edges are paths of their own; loops are on no shortest path.

    Nodes with the same edges out are one class: their searches differ only in that a source is no target of its own, and from
    a class that was reached nothing new is reached through a member that lies farther. So there is one search for each class, which counts
    for all its members (Brandes, over classes), and a class's edges are walked once. Every task searches from its share of the
    classes over the edges from classes to nodes, whose number is checked first: the work is classes x these edges."""
    spark = edges.sparkSession
    weights = edges.filter(F.col(SRC) != F.col(DST)).groupBy(SRC, DST).agg(F.count("*").alias("_m"))
    out = weights.groupBy(SRC).agg(F.sort_array(F.collect_list(F.struct(F.col(DST).alias("to"), F.col("_m").alias("times")))).alias("_out"))
    out = out.join(weights.select(F.col(DST).alias(SRC), F.lit(True).alias("_met")).distinct(), SRC, "left")
    # members that no edge leads to count in the size alone
    classes = materialize(out.groupBy("_out").agg(F.count("*").alias("_size"), F.collect_list(F.when(F.col("_met"), F.col(SRC))).alias("_members")))
    if (classes.agg(F.sum(F.size("_out"))).first()[0] or 0) > MAX_BROADCAST_EDGES:
        discard(classes)
        raise QueryError(f"betweenness takes {MAX_BROADCAST_EDGES} edges of different nodes at most")
    graph = ClassGraph(classes.toArrow())
    discard(classes)
    shared = spark.sparkContext.broadcast(graph)

    def search(frames: Iterator) -> Iterator:
        import pandas as pd

        node, total = shared.value.centralities(frame["id"].to_numpy() for frame in frames)
        yield pd.DataFrame({"node_id": node, "centrality": total})

    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, graph.count))
    found = spark.range(0, graph.count, 1, tasks).mapInPandas(search, "node_id long, centrality double")
    sums = found.groupBy("node_id").agg(F.sum("centrality").alias("centrality"))
    nodes = edges.select(F.col(SRC).alias("node_id")).union(edges.select(DST)).distinct()
    return nodes.join(sums, "node_id", "left").select("node_id", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))


class ClassGraph:
    """A graph by classes of nodes with the same edges out, as arrays by position, and the searches over it.

    A node that edges of one class alone lead to is reached with its class, so such nodes are walked as edges
    from class to class; the others (``several``) are met on their own. A last class without edges has the nodes that lead nowhere."""

    def __init__(self, table) -> None:
        """``table``: an Arrow table with _out (to, times), _size and _members (those that an edge leads to) of each class."""
        import numpy as np

        def flat(name: str) -> tuple:
            lists = table[name].combine_chunks()
            return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()

        (each, out), (held, members) = flat("_out"), flat("_members")
        self.count = count = len(each)
        self.size = np.append(table["_size"].to_numpy(), 0).astype(float)
        self.nodes, head = np.unique(out.field("to").to_numpy(zero_copy_only=False), return_inverse=True)
        times = out.field("times").to_numpy(zero_copy_only=False).astype(float)
        self.home = np.full(len(self.nodes), count, np.int64)
        self.home[np.searchsorted(self.nodes, members.to_numpy(zero_copy_only=False))] = np.repeat(np.arange(count), held)
        tail, several = np.repeat(np.arange(count), each), np.bincount(head, minlength=len(self.nodes))[head] > 1
        # edges to nodes of several classes
        self.several_first, self.several_head, self.several_times = self._starts(tail[several]), head[several], times[several]
        # edges from class to class: paths and nodes of each; which of them each node is part of
        self.alone = np.bincount(tail[~several], minlength=count + 1).astype(float)
        on = np.flatnonzero(~several & (self.home[head] < count))
        pairs, self.part = np.unique(tail[on] * (count + 1) + self.home[head[on]], return_inverse=True)
        self.part_node, self.part_times = head[on], times[on]
        self.first, self.to = self._starts(pairs // (count + 1)), pairs % (count + 1)
        self.paths, self.held = np.bincount(self.part, times[on], len(pairs)), np.bincount(self.part, minlength=len(pairs)).astype(float)

    def _starts(self, tails):
        import numpy as np

        return np.searchsorted(tails, np.arange(self.count + 2))

    def centralities(self, batches: Iterator) -> tuple:
        """Keys of nodes, and what each carries of the shortest paths from all members of the classes in ``batches``."""
        import numpy as np

        n, c = len(self.nodes), self.count + 1
        at_once = max(1, SEARCHED_AT_ONCE // (n + c + len(self.to) + len(self.several_head)))
        # as each search leaves them: classes met (1; 2: the source's own), nodes met, room to number what is new
        scratch = np.zeros(c * at_once, np.int8), np.zeros(n * at_once, bool), np.zeros(max(n, c) * at_once, np.int32)
        scratch[0][self.count :: c] = 1
        totals = np.zeros(len(self.to)), np.zeros(n)
        for sources in batches:
            for i in range(0, len(sources), at_once):
                self._search(sources[i : i + at_once], totals, scratch)
        total = totals[1] + np.bincount(self.part_node, self.part_times * totals[0][self.part], n)
        some = total.nonzero()[0]
        return self.nodes[some], total[some]

    def _search(self, sources, totals: tuple, scratch: tuple) -> None:
        """Adds to ``totals`` of edges between classes (by path through a node) and of nodes of several classes, a level of all searches at a time."""
        import numpy as np

        met_class, met, number = scratch
        n, c = len(self.nodes), self.count + 1

        def numbered(keys) -> tuple:
            """One position of each different key, and for each key which of these it is."""
            count = np.arange(len(keys), dtype=np.int32)
            number[keys] = count
            one = (number.take(keys) == count).nonzero()[0]
            if len(one) == len(keys):
                return one, count
            number[keys.take(one)] = np.arange(len(one), dtype=np.int32)
            return one, number.take(keys)

        def spread(first, at) -> tuple:
            """Positions in ``at`` and edges of all edges out of its classes."""
            start = first.take(at)
            each = first.take(at + 1) - start
            if not each.any():
                return each[:0], each[:0]
            tail = np.repeat(np.arange(len(at)), each)
            return tail, np.arange(len(tail)) + np.repeat(start - (np.cumsum(each) - each), each)

        row, at, ways = np.arange(len(sources)), sources, np.ones(len(sources))
        undo, undo_class, levels = [], [row * c + at], []
        met_class[undo_class[0]] = 2
        while len(at):
            base, members = row * c, self.size.take(sources.take(row))
            # what paths to members of the classes' own nodes are worth, and what the source's own class, each a target of all others, takes off
            value = members * self.alone.take(at)
            tail, edge = spread(self.first, at)
            key = base.take(tail) + self.to.take(edge)
            state = met_class.take(key)
            back = (state == 2).nonzero()[0]
            if len(back):
                np.subtract.at(value, tail[back], self.held[edge[back]])
            on = (state == 0).nonzero()[0]
            tail, edge, key = tail.take(on), edge.take(on), key.take(on)
            came = ways.take(tail)
            arrived, further = came * self.paths.take(edge), None
            tail_, edge_ = spread(self.several_first, at)
            if len(tail_):
                node = row[tail_] * n + self.several_head[edge_]
                new = (~met[node]).nonzero()[0]
                tail_, edge_, node = tail_[new], edge_[new], node[new]
                one, head = numbered(node)
                undo.append(node[one])
                met[undo[-1]] = True
                times = self.several_times[edge_]
                node, row_ = self.several_head[edge_[one]], row[tail_[one]]
                node_ways = np.bincount(head, ways[tail_] * times, len(one))
                key_ = row_ * c + self.home[node]
                worth_ = (self.size[sources[row_]] - (met_class[key_] == 2)) / node_ways
                open_ = (met_class[key_] == 0).nonzero()[0]
                further = tail_, head, times, node, node_ways, worth_, open_
                key, arrived = np.concatenate([key, key_[open_]]), np.concatenate([arrived, node_ways[open_]])
            one, member = numbered(key)
            key = key.take(one)
            undo_class.append(key)
            met_class[key] = 1
            levels.append((value / ways, tail.astype(np.int32), edge.astype(np.int32), came, member, further))
            ways = np.bincount(member, arrived, len(one))
            row = key // c
            at = key - row * c
        # what a path to a member of a class is worth beyond it
        worth = np.zeros(0)
        edges, parts = [], []
        for value, tail, edge, came, member, further in reversed(levels):
            beyond = worth.take(member)
            if further:
                tail_, head, times, node, node_ways, worth_, open_ = further
                beyond_ = beyond[len(tail) :]
                beyond = beyond[: len(tail)]
                worth_[open_] += beyond_
                np.add.at(totals[1], node[open_], node_ways[open_] * beyond_)
                value += np.bincount(tail_, worth_[head] * times, len(value))
            edges.append(edge)
            parts.append(came * beyond)
            worth = value + np.bincount(tail, self.paths.take(edge) * beyond, len(value))
        totals[0][:] += np.bincount(np.concatenate(edges), np.concatenate(parts), len(self.to))
        met_class[np.concatenate(undo_class)] = 0
        if undo:
            met[np.concatenate(undo)] = False


def register(session) -> None:
    session.register_procedure("algo.pageRank", lambda s, d=0.85, n=20, tol=1e-6, rel=None: pagerank(edges_of(s, rel), float(d), int(n), float(tol)).orderBy(F.desc("rank"), "node_id"))
    session.register_procedure("algo.wcc", lambda s, rel=None: components(edges_of(s, rel)).orderBy("node_id"))
    session.register_procedure("algo.betweenness", lambda s, rel=None: betweenness(edges_of(s, rel)).orderBy(F.desc("centrality"), "node_id"))
