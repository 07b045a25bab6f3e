"""Reachability and shortest paths over edges (_src, _dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DST, SRC
from ..runtime import materialize

#: Hops up to which the levels are one lazy plan; beyond it each level is written, and the search stops when one is empty.
UNROLLED = 3
DEFAULT_MAX = 30


def oriented(edges: DataFrame, direction: str, *props: str) -> DataFrame:
    """Edges as walked: as they are, turned round, or both."""
    a = edges.select(F.col(SRC), F.col(DST), *props)
    b = edges.select(F.col(DST).alias(SRC), F.col(SRC).alias(DST), *props)
    return a if direction == "->" else b if direction == "<-" else a.unionByName(b)


def _first_visits(levels: DataFrame) -> DataFrame:
    return levels.groupBy(SRC, DST).agg(F.min("_depth").alias("_depth"))


def reachable(edges: DataFrame, sources: DataFrame | None, low: int = 1, high: int | None = None, direction: str = "->") -> DataFrame:
    """_src, _dst, _depth: each node that is first met ``low`` to ``high`` hops from a source.

    One row for each pair, at the depth of the shortest way; the source itself isn't
    reached. ``sources`` (one column ``_src``) bounds the search; None starts anywhere.
    """
    high = DEFAULT_MAX if high is None else high
    step = oriented(edges.select(SRC, DST), direction).filter(F.col(SRC).isNotNull() & F.col(DST).isNotNull() & (F.col(SRC) != F.col(DST))).distinct()
    start = step if sources is None else step.join(sources.select(SRC).distinct(), SRC, "left_semi")
    hop = step.select(F.col(SRC).alias("_via"), F.col(DST).alias("_to"))
    level = start.withColumn("_depth", F.lit(1))
    if high <= UNROLLED:
        seen = level
        for k in range(2, high + 1):
            level = level.join(hop, level[DST] == hop["_via"]).select(SRC, F.col("_to").alias(DST)).filter(F.col(SRC) != F.col(DST)).distinct().withColumn("_depth", F.lit(k))
            seen = seen.unionByName(level)
        out = _first_visits(seen) if high > 1 else seen
    else:
        step = materialize(step)
        hop = step.select(F.col(SRC).alias("_via"), F.col(DST).alias("_to"))
        level = out = materialize(level)
        for k in range(2, high + 1):
            further = level.join(hop, level[DST] == hop["_via"]).select(SRC, F.col("_to").alias(DST)).filter(F.col(SRC) != F.col(DST)).distinct()
            level = materialize(further.join(out, [SRC, DST], "left_anti").withColumn("_depth", F.lit(k)))
            if level.isEmpty():
                break
            out = out.unionByName(level)
    return out.filter(F.col("_depth") >= max(low, 1)) if low > 1 else out


def paths_from(edges: DataFrame, sources: DataFrame, targets: DataFrame, high: int | None = None, direction: str = "->", backwards: bool = False) -> DataFrame:
    """_src, _dst, _path of every one of ``targets`` (_dst) that is met up to ``high`` hops from one of ``sources`` (_src),
    itself left out: the least by its keys among equally short ways. Work and rows follow what is reached, never sources x targets.
    With ``backwards`` the search runs from the paths' ends: ``sources`` are the ends, and paths are told from the beginning."""
    high = DEFAULT_MAX if high is None else high
    step = materialize(oriented(edges.select(SRC, DST), direction).filter(F.col(SRC) != F.col(DST)).distinct())
    hop = step.select(F.col(SRC).alias("_via"), F.col(DST).alias("_to"))
    level = seen = materialize(sources.select(SRC).distinct().select(SRC, F.col(SRC).alias(DST), F.array(F.col(SRC)).alias("_path")))
    for _ in range(high):
        way = F.concat(F.array("_to"), "_path") if backwards else F.concat("_path", F.array("_to"))
        grown = level.join(hop, level[DST] == hop["_via"]).select(SRC, F.col("_to").alias(DST), way.alias("_path"))
        level = materialize(grown.groupBy(SRC, DST).agg(F.min("_path").alias("_path")).join(seen, [SRC, DST], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    out = seen.filter(F.size("_path") > 1).join(targets.select(DST).distinct(), DST, "left_semi")
    return out.select(F.col(DST).alias(SRC), F.col(SRC).alias(DST), "_path") if backwards else out.select(SRC, DST, "_path")


def shortest_paths(edges: DataFrame, pairs: DataFrame, high: int | None = None, direction: str = "->") -> DataFrame:
    """``pairs`` (_src, _dst) with ``_path``, the keys of the shortest way with both ends: the least by its keys among
    equally short ones, ``[x]`` from a node to itself, and an empty list where there is none."""
    high = DEFAULT_MAX if high is None else high
    pairs = pairs.select(SRC, DST).distinct()
    step = materialize(oriented(edges.select(SRC, DST), direction).filter(F.col(SRC) != F.col(DST)).distinct())
    hop = step.select(F.col(SRC).alias("_via"), F.col(DST).alias("_to"))
    level = materialize(pairs.select(SRC).distinct().select(SRC, F.col(SRC).alias(DST), F.array(F.col(SRC)).alias("_path")))
    seen = level
    for _ in range(high):
        open_ = pairs.join(seen, [SRC, DST], "left_anti")
        if open_.isEmpty():
            break
        live = level.join(open_.select(SRC).distinct(), SRC, "left_semi")
        grown = live.join(hop, live[DST] == hop["_via"]).select(SRC, F.col("_to").alias(DST), F.concat("_path", F.array("_to")).alias("_path"))
        level = materialize(grown.groupBy(SRC, DST).agg(F.min("_path").alias("_path")).join(seen, [SRC, DST], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    empty: Column = F.slice(F.array(F.col(SRC)), F.lit(1), F.lit(0))
    return pairs.join(seen, [SRC, DST], "left").select(SRC, DST, F.coalesce("_path", empty).alias("_path"))
