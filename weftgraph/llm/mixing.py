"""Mixing sources to target weights by soft membership (DataFrame functions only).

A naive Bayes classifier, fitted on a labelled table, gives each document posteriors
over domains. A document at rate r adds r * tokens * posterior to each domain's
expected tokens. Projected gradient steps find nonnegative rates, near 1, whose domain
totals meet the targets in least squares. A step needs one aggregate of as many numbers as there are
domains; the rates themselves stay an expression over one stored table of posteriors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, let, stored

#: Domains by the labels (quality, toxic), and the target share of tokens of each.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}
#: Information (nats, over the labelled rows) under which a term may be there by chance.
LEAST = 15.0


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain of labelled documents; of several rows the last by name counts, incomplete ones none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def _words(text: Column) -> Column:
    """Lower-cased words without the marks at their ends; marks that stand alone are none."""
    return F.array_remove(F.split(F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[.,;:!?]*[\x20\x09-\x0D]+"), "")


def _terms(w: Column, text: Column) -> Column:
    """Distinct terms of a text with words ``w``: its words, and three signs of its form."""
    n = F.greatest(F.size(w), F.lit(1))
    text = F.coalesce(text, F.lit(""))
    marks = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))

    def form(bare: Column) -> Column:
        signs = F.array(
            F.concat(F.lit("\x01size"), F.least(F.lit(6), F.floor(F.log10(n.cast("double")) * 2)).cast("string")),
            F.concat(F.lit("\x01marks"), F.least(F.lit(5), F.floor(marks * 4 / n)).cast("string")),
            F.concat(F.lit("\x01kinds"), F.floor(10 * F.size(bare) / n).cast("string")),
        )
        return F.concat(bare, signs)

    return let(F.array_distinct(w), form)


def classifier(docs: DataFrame, labelled: DataFrame, vocabulary: int) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Each domain's log probability of a document without a vocabulary term, and what each term adds to it.

    Fitted on all labelled rows. Labels may be as many as documents, so neither side is sent whole at any size.
    """
    rows = stored(docs.select("doc_id", "text").filter("doc_id IS NOT NULL").join(labelled.hint("merge"), "doc_id").select("domain", "text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    priors = {d: (sizes.get(d, 0) + 1.0) / (total + len(DOMAINS)) for d in DOMAINS}
    counts = rows.select("domain", F.explode(let(_words(F.col("text")), lambda w: _terms(w, F.col("text")))).alias("term")).groupBy("term").agg(*[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(d) for d in DOMAINS])
    chance = [(F.col(d) + 0.5) / (sizes.get(d, 0) + 1.0) for d in DOMAINS]
    every = (sum((F.col(d) for d in DOMAINS), F.lit(0)) + 0.5) / (total + 1.0)
    # the information that the term's presence gives about the domain
    weight = sum((F.col(d) * F.log(c / every) for d, c in zip(DOMAINS, chance)), F.lit(0.0))
    top = counts.filter((sum((F.col(d) for d in DOMAINS), F.lit(0)) >= 3) & (weight > LEAST)).orderBy(F.desc(F.round(weight, 6)), "term").limit(vocabulary).collect()
    drop_stored(rows)
    has = lambda r, d: (r[d] + 0.5) / (sizes.get(d, 0) + 1.0)
    base = {d: math.log(priors[d]) + sum(math.log(1 - has(r, d)) for r in top) for d in DOMAINS}
    return base, {r["term"]: {d: math.log(has(r, d)) - math.log(1 - has(r, d)) for d in DOMAINS} for r in top}


def posteriors(docs: DataFrame, base: dict[str, float], weights: dict[str, dict[str, float]]) -> DataFrame:
    """``docs`` with n_tokens (words) and post (array over ``DOMAINS``, sum 1)."""
    terms = sorted(weights)
    vocabulary = F.lit(terms) if terms else F.array().cast("array<string>")
    table = F.create_map(*[x for t in terms for x in (F.lit(t), F.array(*[F.lit(float(weights[t][d])) for d in DOMAINS]))]) if terms else None

    def scores(hits: Column) -> Column:
        zero = F.array(*[F.lit(float(base[d])) for d in DOMAINS])
        if table is None:
            return zero
        # in a fixed order, so that the sum is the same everywhere
        return F.aggregate(F.sort_array(hits), zero, lambda a, t: F.zip_with(a, F.element_at(table, t), lambda x, y: x + y))

    def normal(s: Column) -> Column:
        top = F.array_max(s)
        e = F.transform(s, lambda x: F.exp(F.greatest(x - top, F.lit(-40.0))))
        return let(e, lambda v: F.transform(v, lambda x: F.round(x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y), 9)))

    def both(w: Column) -> Column:
        hits = F.array_intersect(_terms(w, F.col("text")), vocabulary)
        return F.struct(F.size(w).cast("long").alias("n"), let(let(hits, scores), normal).alias("post"))

    return docs.withColumn("__m", let(_words(F.col("text")), both)).withColumns({"__n": F.col("__m.n"), "__post": F.col("__m.post")}).drop("__m")


def solve(table: DataFrame, targets: dict[str, float], steps: int = 25, tolerance: float = 1e-6) -> list[list[float]]:
    """Gradient steps g_1..g_k: the rates are r_0 = 1, r_j = max(0, r_(j-1) - g_j . post).

    In the metric of tokens, the gradient of half the squared distance of the domain
    totals from the targets is post . (totals - targets). It is scaled by the inverse of
    the curvature over the documents whose rate isn't held at 0, so few steps do. A step is one aggregate.
    """
    k = len(DOMAINS)
    post = [F.col("post")[i] for i in range(k)]
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return []
    want = np.array([total * targets[d] / sum(targets.values()) for d in DOMAINS])
    taken: list[list[float]] = []
    for _ in range(steps):
        now = table.select("n_tokens", "post", rates(F.col("post"), taken).alias("r"))
        free = F.when(F.col("r") > 0, F.col("n_tokens")).otherwise(0)
        sums = now.agg(*[F.sum(F.col("r") * F.col("n_tokens") * p) for p in post], *[F.sum(free * a * b) for a in post for b in post]).first()
        off = np.array([float(x) for x in sums[:k]]) - want
        if abs(off).max() <= tolerance * total:
            break
        curve = np.array([float(x) for x in sums[k:]]).reshape(k, k) + np.eye(k) * total * 1e-6
        taken.append([float(x) for x in np.linalg.solve(curve, off)])
    return taken


def rates(post: Column, taken: list[list[float]]) -> Column:
    """Nested projections, bound one by one so that each is evaluated once."""
    r = F.lit(1.0)
    for g in taken:
        r = F.greatest(F.lit(0.0), r - sum((F.lit(x) * post[i] for i, x in enumerate(g)), F.lit(0.0)))
    return r


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, vocabulary: int = 200, steps: int = 25, with_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, any others) with domain, p_good, p_poor, p_toxic, n_tokens and rate.

    ``rate`` is how often a document is to be read in an epoch. Null and empty texts have
    no tokens: they get posteriors from the prior, and the rate that these give. Without labels all domains are
    equal and rates are 1 where the targets can't be met. Repeated rows are documents of their own; an empty table gives no rows.
    Columns of ``docs`` with one of the new names are replaced. ``with_text`` false leaves the texts out.
    """
    base, weights = classifier(docs.select("doc_id", "text"), domain_labels(labels), vocabulary)
    marked = posteriors(docs, base, weights)
    # written once; the steps read two narrow columns of it
    marked = stored(marked if with_text else marked.drop("text"))
    taken = solve(marked.select(F.col("__n").alias("n_tokens"), F.col("__post").alias("post")).filter("n_tokens > 0"), targets, steps)
    named = {f"p_{d}": F.round(F.col("__post")[i], 6) for i, d in enumerate(DOMAINS)}
    best = F.array_position(F.col("__post"), F.array_max("__post"))
    domain = F.element_at(F.lit(list(DOMAINS)), best.cast("int"))
    out = marked.withColumns({**named, "domain": domain, "n_tokens": F.col("__n"), "rate": F.round(rates(F.col("__post"), taken), 6)})
    return out.drop("__n", "__post")


def mixing_rates(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    out = mixed(docs.select("doc_id", "text"), labels, with_text=False, **options)
    return out.select("doc_id", "n_tokens", "domain", *[f"p_{d}" for d in DOMAINS], "rate")
