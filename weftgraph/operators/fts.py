"""Full-text search by BM25 (k1 = 1.2, b = 0.75)."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize

K1, B, MAX_TERM = 1.2, 0.75, 40
SCHEMA = "doc_id long, content string"


def terms(text):
    """Lower-cased runs of letters and digits; terms over 40 bytes are left out."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & (F.octet_length(w) <= MAX_TERM))


_CLAUSE = re.compile(r'([+-]?)(?:"([^"]*)"?|(\S+))')


def clauses(query: str) -> list[tuple[str, tuple[str, ...]]]:
    """The parts of a query as (sign, terms): ``+`` is needed, ``-`` excludes, others are OR-ed; several terms are a phrase.
    ``AND`` makes its neighbours needed and ``NOT`` excludes the next."""
    found: list[list] = []
    both = never = False
    for sign, quoted, word in _CLAUSE.findall(query):
        if word in ("AND", "OR", "NOT") and not sign:
            if word == "AND" and found and found[-1][0] == "":
                found[-1][0] = "+"
            both, never = both or word == "AND", word == "NOT"
            continue
        said = tuple(w for w in re.split(r"[\W_]+", (quoted or word).lower()) if w and len(w.encode()) <= MAX_TERM)
        if said:
            found.append(["-" if never else sign or ("+" if both else ""), said])
        both = never = False
    return list(dict.fromkeys((sign, said) for sign, said in found))


def _times(said: tuple[str, ...]):
    """How often a term or phrase stands among the terms ``_t``."""
    if len(said) == 1:
        return F.size("_t") - F.size(F.array_remove("_t", said[0]))
    at = lambda i: F.slice("_t", i, len(said)) == F.array(*map(F.lit, said))
    some = F.array_contains("_t", said[0]) & (F.size("_t") >= len(said))
    return F.when(some, F.size(F.filter(F.sequence(F.lit(1), F.size("_t") - len(said) + 1), at))).otherwise(0)


def bm25(docs: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """doc_id, score, snippet of the best documents (doc_id, content); ``clauses`` tells what a query may say.

    One pass over the texts counts lengths and the query's terms and writes these few numbers; statistics and scores
    come from them, and the texts are read again for the best documents' snippets only. No row per word is shuffled.
    ``doc_id`` is taken for a key. A phrase counts like a term whose idf is the sum of its terms'."""
    parts = clauses(query)
    wanted = sorted({w for sign, said in parts if sign != "-" for w in said})
    if not wanted:
        return docs.sparkSession.createDataFrame([], "doc_id long, score double, snippet string")
    t = docs.select("doc_id", terms(F.col("content")).alias("_t"))
    has = [F.array_contains("_t", w).cast("int").alias(f"_h{i}") for i, w in enumerate(wanted)]
    counted = materialize(t.select("doc_id", F.size("_t").alias("_n"), *has, *[_times(said).alias(f"_f{i}") for i, (_, said) in enumerate(parts)]))
    stats = counted.agg(F.count("*").alias("n"), F.avg("_n").alias("avg"), *[F.sum(f"_h{i}").alias(f"d{i}") for i in range(len(wanted))]).first()
    n, often = stats["n"], {w: stats[f"d{i}"] or 0 for i, w in enumerate(wanted)}
    score, keep, any_ = F.lit(0.0), F.lit(True), F.lit(False)
    for i, (sign, said) in enumerate(parts):
        tf = F.col(f"_f{i}").cast("double")
        if sign == "-":
            keep = keep & (tf == 0)
            continue
        idf = F.lit(sum(math.log(1 + (n - often[w] + 0.5) / (often[w] + 0.5)) for w in said))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.lit(float(stats["avg"] or 1.0))))
        keep, any_ = (keep & (tf > 0) if sign == "+" else keep), any_ | (tf > 0)
    best = counted.filter(keep & any_).select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id")
    best = best if limit is None else best.limit(limit)
    return best.join(docs.select("doc_id", F.col("content").alias("snippet")), "doc_id").select("doc_id", "score", "snippet").orderBy(F.desc("score"), "doc_id")


class TextIndex:
    """Documents added one by one or as a frame."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.clear()

    def clear(self) -> None:
        self.next, self.staged, self.docs = 0, [], self.spark.createDataFrame([], SCHEMA)

    def add(self, content: str) -> int:
        self.staged.append((self.next, content))
        self.next += 1
        return self.next - 1

    def use(self, docs: DataFrame) -> None:
        """Search ``docs`` (doc_id, content)."""
        self.docs = docs.select(F.col("doc_id").cast("bigint"), "content")

    def all(self) -> DataFrame:
        if self.staged:
            self.docs = self.docs.unionByName(self.spark.createDataFrame(self.staged, SCHEMA))
            self.staged = []
        return self.docs


def register(session) -> None:
    one = lambda s, sql, v: s.spark.range(1).select(F.lit(v).alias(sql))

    def clear(s):
        s.texts.clear()
        return one(s, "status", "ok")

    session.register_procedure("fts.add", lambda s, content: one(s, "doc_id", s.texts.add(str(content))))
    session.register_procedure("fts.search", lambda s, query, limit=10: bm25(s.texts.all(), str(query), int(limit)))
    session.register_procedure("fts.clear", clear)
