"""Quality rules by distribution divergence (DataFrame functions only).

A document's histogram of character classes and its histogram of common words are
compared with those of its language by the Jensen-Shannon distance. The language
references are sums over all documents. Common words are the ``n_common`` most
frequent words of a language, whatever their length; each task adds up its counts
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

SPACE = r"[\x20\x09-\x0D]+"
#: Character classes beside white space and the rest (which is mostly lower-case letters).
CLASSES = {"symbols": r"[#*$%&|<>]+", "digits": r"[0-9]+", "upper": r"\p{Lu}+", "marks": r"[.,;:!?'\"()\[\]{}=+@_/-]+"}
#: References are kept on the driver and sent along with each task up to so many languages; beyond it they are joined.
MAX_LANGS = 2000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def plain(array: Column) -> Column:
    """``array`` taken apart once: reading an element of a stored array makes a new string each time."""
    return F.transform(array, lambda x: x)


def _signs(text: Column) -> Column:
    """What ``text`` has of ``CLASSES``: one scan of the whole text, after which each class is counted on the few signs left."""
    kept = "".join(p.removesuffix("+").removeprefix("[").removesuffix("]") for p in CLASSES.values())
    return F.regexp_replace(text, f"[^{kept}]+", "")


def _matched(signs: Column, pattern: str) -> Column:
    """Code points of ``signs`` that ``pattern`` matches."""
    return F.char_length(signs) - F.char_length(F.regexp_replace(signs, pattern, ""))


def _windows(w: Column) -> Column:
    """Hashes of the 3-word windows of ``w``; null under four words, which can't hold one twice."""
    # bound, so that ``w`` is evaluated once even where a filter on the results is pushed below it
    hashes = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(v[i], v[i + 1], v[i + 2]))
    return F.when(F.size(w) >= 4, let(plain(w), hashes))


#: Repeated hashes up to which they are looked up one by one; texts with more of them sort all their windows.
LOOKED_UP = 256


def repeat_words(w: Column, hashes: Column, in_order: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; ``hashes`` are those of ``_windows`` and ``in_order`` the same, sorted.

    Windows with distinct hashes are distinct, which settles most windows. Those whose hash is met again are
    sorted by their words (which hold no space, so joining them by one is exact), and neighbours that agree are found twice.
    """

    def candidates(dups: Column) -> Column:
        met = F.array_compact(F.transform(hashes, lambda h, i: F.when(F.array_contains(dups, h), i)))
        return F.when(F.size(dups) <= LOOKED_UP, met).otherwise(F.sequence(F.lit(0), F.size(hashes) - 1))

    def positions(s: Column) -> Column:
        same = lambda k, j: F.coalesce(s[k].x == F.get(s, j).x, F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(hit, lambda k: s[k].i))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.when(j + 1 < F.size(p), F.least(F.lit(3), F.get(p, j + 1) - x)).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    dups = let(in_order, lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
    windows = let(plain(w), lambda v: F.transform(let(dups, candidates), lambda i: F.struct(F.concat_ws(" ", v[i], v[i + 1], v[i + 2]).alias("x"), i.alias("i"))))
    slow = let(let(F.sort_array(windows), positions), covered)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), slow).otherwise(0).cast("long")


def dup_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.when(F.size(F.array_distinct(lines)) < F.size(lines), let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("long")


def base_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base counts and words ``w``; one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # each step is a projection of its own, so that what a step uses twice is evaluated once
    split = docs.select("doc_id", "lang", words_of(F.col("text")).alias("w"), F.split(text, "\n").alias("lines"), _signs(text).alias("signs"), F.char_length(text).cast("long").alias("n_chars"))
    hashed = split.withColumn("h", _windows(F.col("w")))
    ordered = hashed.withColumn("hs", F.sort_array("h"))
    return ordered.select(
        "doc_id",
        "lang",
        "w",
        "n_chars",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        repeat_words(F.col("w"), F.col("h"), F.col("hs")).alias("n_repeat_words"),
        dup_lines(F.col("lines")).alias("n_dup_lines"),
        *[_matched(F.col("signs"), p).cast("long").alias(k) for k, p in CLASSES.items()],
    )


def language_references(docs: DataFrame, n_common: int = 32) -> DataFrame:
    """One row per lang (null is one): ``q_chars`` (shares of the character classes),
    ``common`` (most frequent words; ties by word) and ``q_common`` (their shares of all words)."""
    counts = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    # no class holds white space, so the classes are counted on the distinct words
    signs = counts.select("lang", "n", F.char_length("word").alias("word_chars"), _signs(F.col("word")).alias("signs"))
    classes = signs.groupBy("lang").agg(F.sum(F.col("n") * F.col("word_chars")).alias("word_chars"), *[F.sum(F.col("n") * _matched(F.col("signs"), p)).alias(k) for k, p in CLASSES.items()])
    chars = docs.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n_chars"))
    zero = F.lit(0).cast("long")
    sums = chars.join(classes.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").select("lang", *[F.coalesce(k, zero).alias(k) for k in ("n_chars", "word_chars", *CLASSES)])
    top = (
        counts.withColumn("r", rank)
        .filter(F.col("r") <= n_common)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    )
    total = F.greatest(F.col("n_chars"), F.lit(1))
    shares = [(F.col(k) / total) for k in CLASSES]
    rest = F.col("word_chars") - sum((F.col(k) for k in CLASSES), F.lit(0))
    joined = sums.join(top, sums.lang.eqNullSafe(top.lang), "left").select(
        sums.lang,
        F.array(*shares, (F.col("n_chars") - F.col("word_chars")) / total, rest / total).alias("q_chars"),
        F.coalesce(F.transform("top", lambda x: x.word), F.array().cast("array<string>")).alias("common"),
        F.coalesce(F.transform("top", lambda x: x.n.cast("double") / F.aggregate("top", F.lit(0).cast("long"), lambda a, y: a + y.n)), F.array().cast("array<double>")).alias("q_common"),
    )
    return joined


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two share arrays of one length."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    both = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2))


def quality_rules(
    docs: DataFrame,
    n_common: int = 32,
    min_chars: int = 200,
    min_common: int = 20,
    max_char_distance: float = 0.3,
    max_common_distance: float = 0.65,
) -> DataFrame:
    """Base counts, divergences and verdict of each row of ``docs`` (doc_id, text, lang; other columns are ignored).

    ``js_chars`` is null under ``min_chars`` code points and ``js_common`` under
    ``min_common`` common words: too short to judge, so such a histogram never
    rejects. ``kept`` is false if ``base_failed`` or a distance passes its limit.
    Null or empty text: zero counts, ``base_failed``. Null lang: compared with the
    other documents without lang. Repeated rows each give their row; an empty table gives none.
    """
    docs = docs.select("doc_id", "text", "lang")
    refs = language_references(docs, n_common)
    rows = refs.limit(MAX_LANGS + 1).collect()
    if len(rows) <= MAX_LANGS:
        refs = F.broadcast(docs.sparkSession.createDataFrame(rows, refs.schema))
    s = base_stats(docs)
    s = s.join(refs.withColumnRenamed("lang", "ref_lang"), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    total = F.greatest(F.col("n_chars"), F.lit(1))
    rest = F.col("word_chars") - sum((F.col(k) for k in CLASSES), F.lit(0))
    p_chars = F.array(*[F.col(k) / total for k in CLASSES], (F.col("n_chars") - F.col("word_chars")) / total, rest / total)

    s = s.withColumn("hits", let(plain(F.col("common")), lambda c: F.filter("w", lambda x: F.array_contains(c, x))))
    n = F.size("hits")
    shares = let(F.col("hits"), lambda h: F.transform("common", lambda c: (F.size(h) - F.size(F.array_remove(h, c))).cast("double") / F.size(h)))
    js_common = F.when(n >= min_common, js_distance(shares, F.col("q_common")))
    out = s.select(
        "doc_id",
        "n_words",
        "word_chars",
        F.col("symbols").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.when(F.col("n_chars") >= min_chars, F.round(js_distance(p_chars, F.col("q_chars")), 6)).alias("js_chars"),
        F.round(js_common, 6).alias("js_common"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.coalesce("js_chars", F.lit(0.0)) <= max_char_distance) & (F.coalesce("js_common", F.lit(0.0)) <= max_common_distance)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fine).alias("kept"), "js_chars", "js_common"
    )


#: The same rows in SQL.
RULES_SQL = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[.,;:!?''"()\[\]{}=+@_/-]', '', 'g')) AS marks,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g,
    row_number() OVER () AS rid FROM d),
hits AS (SELECT rid, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM b),
twice AS (SELECT rid, x FROM hits GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM hits JOIN twice USING (rid, x), (VALUES (0), (1), (2)) v(k) GROUP BY 1),
ref AS (SELECT lang, greatest(sum(n_chars), 1) AS n, sum(word_chars) AS wc, sum(n_chars) AS nc, sum(symbols) AS s, sum(digits) AS g, sum(upper) AS u, sum(marks) AS m FROM b GROUP BY 1),
q AS (SELECT lang, [s / n, g / n, u / n, m / n, (nc - wc) / n, (wc - s - g - u - m) / n] AS q_chars FROM ref),
words AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM b) y GROUP BY 1, 2),
top AS (SELECT lang, x, n, n / sum(n) OVER (PARTITION BY lang) AS share FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS r FROM words) y WHERE r <= 32),
own AS (SELECT rid, lang, x, count(*) AS n FROM (SELECT rid, lang, unnest(w) AS x FROM b) y SEMI JOIN top ON top.lang IS NOT DISTINCT FROM y.lang AND top.x = y.x GROUP BY 1, 2, 3),
size AS (SELECT rid, lang, sum(n) AS n FROM own GROUP BY 1, 2 HAVING sum(n) >= 20),
pairs AS (SELECT size.rid, coalesce(own.n, 0) / size.n AS p, top.share AS q FROM size JOIN top ON top.lang IS NOT DISTINCT FROM size.lang LEFT JOIN own ON own.rid = size.rid AND own.x = top.x),
common AS (SELECT rid, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + q * log2(2 * q / (p + q))) / 2)), 6) AS js FROM pairs GROUP BY 1),
chars AS (
  SELECT rid, round(sqrt(greatest(0, list_sum(list_transform(list_zip([symbols / n_chars, digits / n_chars, upper / n_chars, marks / n_chars, (n_chars - word_chars) / n_chars, (word_chars - symbols - digits - upper - marks) / n_chars], q_chars),
    lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2)), 6) AS js
  FROM b JOIN q ON q.lang IS NOT DISTINCT FROM b.lang WHERE n_chars >= 200),
out AS (
  SELECT doc_id, n_words, word_chars, symbols AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, chars.js AS js_chars, common.js AS js_common
  FROM b LEFT JOIN rep USING (rid) LEFT JOIN chars USING (rid) LEFT JOIN common USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM out)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(js_chars, 0) <= 0.3 AND coalesce(js_common, 0) <= 0.65 AS kept, js_chars, js_common FROM judged
"""
