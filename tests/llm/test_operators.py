"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; against brute force."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, decontam, html, langid, minhash, mixing, quality, suffix_dedup, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, row int, score double"  # the last two clash with names used within
SYL = "the on er an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(SYL, r.integers(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    base, passage = words(300, 1), words(60, 2)
    w = base.split()
    texts = [base, base, " ".join(w[:150] + ["changed"] + w[151:]), " ".join(w[:100]), words(300, 3) + "\n" + passage, words(80, 4) + " " + passage + " " + words(90, 5), None, "", "   ", "a b", "A  B", "a b", words(3000, 6), "x" * 450, base.upper(), words(120, 7) + " é ünï " + words(60, 8)]
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, 1, 0.5) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_minhash_matches_brute_force(corpus, empty, spark):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {k: shingles(t) for k, t in texts_of(corpus).items()}
    parent = {k: k for k in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = by_id(minhash.near_duplicates(corpus))
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == {k: (len(s), root(k), root(k) == k) for k, s in sets.items()}
    assert minhash.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in minhash.near_duplicates(twice).collect()) == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert minhash.keep_one(corpus).columns == corpus.columns


def test_pipeline_drops_near_copies_from_80_percent_on(spark):
    import corpus_pipeline

    base = words(300, 41).split()
    other = [f"changed{i}" if i % 50 == 25 else w for i, w in enumerate(base)]  # 6 words: 266 shingles of 326
    far = [f"changed{i}" if i % 36 == 18 else w for i, w in enumerate(base)]  # 8 words: 256 of 336 and less
    docs = spark.createDataFrame([(1, " ".join(base), "en", 1, 0.5), (2, " ".join(other), "en", 1, 0.5), (3, " ".join(far), "en", 1, 0.5)], SCHEMA)
    a, b, c = minhash.shingle_sets([" ".join(x).encode() for x in (base, other, far)])
    share = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert 0.8 <= share(a, b) < 0.85 and share(a, c) < 0.8 and share(b, c) < 0.8
    assert sorted(texts_of(corpus_pipeline.drop_near_duplicates(spark, docs, ""))) == [1, 3]


def spans(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                edge[s] += 1
                edge[s + 100] -= 1
            seen.add(b[s : s + 100])
        gone = np.cumsum(edge)[: len(b)] > 0
        out[k] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup_matches_brute_force(corpus, empty, spark):
    got = by_id(suffix_dedup.suffix_dedup(corpus))
    assert {k: tuple(r)[1:] for k, r in got.items()} == spans(texts_of(corpus))
    assert suffix_dedup.suffix_dedup(empty).collect() == []
    odd = spark.createDataFrame([(1, "ab" * 300), (2, "x" * 99), (3, "x" * 100), (4, "x" * 101), (5, "q" * 5 + "ab" * 80 + "zz"), (None, "x" * 100), (8, "é" * 60), (9, "é" * 70 + "ab" * 55)], "doc_id long, text string")
    want = spans({(-1 if k is None else k): t for k, t in texts_of(odd).items()})
    assert {(-1 if k is None else k): tuple(r)[1:] for k, r in by_id(suffix_dedup.suffix_dedup(odd)).items()} == want
    cut = suffix_dedup.cut_repeats(corpus)
    assert cut.columns == corpus.columns and cut.filter("doc_id = 1").count() == 0 and cut.filter("doc_id = 6").count() == 1


def test_cuts_leave_whole_characters(spark):
    same = "".join(chr(0x410 + k) for k in np.random.default_rng(3).integers(0, 60, 80))
    texts = ["я" * 3 + "\u0430" + same + "\u0431 ab", "один \ufffd" + "\u0470" + same + "\u0432 cd", None, "", "\ufffd" + words(30, 9), same]  # around what is the same, bytes of characters are the same too
    docs = spark.createDataFrame([(i, t, 1, 0) for i, t in enumerate(texts)], "doc_id long, text string, `my.col` int, n_chars long")
    got = by_id(suffix_dedup.cut_repeats(docs))
    assert {k: r["text"] for k, r in got.items()} == {**dict(enumerate(texts[:5])), 1: "один \ufffd cd"}
    assert got[1]["n_chars"] == 9 and got[4]["n_chars"] == 0 and got[1]["my.col"] == 1
    assert suffix_dedup.remove_repeats(docs.select("doc_id", "text")).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]


def test_suffix_sort_orders_like_bytes():
    data = np.frombuffer(b"banana bandana banana cabana " * 5, np.uint8)
    got = suffix_dedup.suffix_sort(suffix_dedup.Hashes(data), np.arange(60), 40)
    assert got.tolist() == sorted(range(60), key=lambda i: (bytes(data[i : i + 40]), i))


def test_suffix_sort_decides_which_windows_are_first(monkeypatch):
    r = np.random.default_rng(9)
    copies = [bytes(r.integers(97, 101, 130, dtype=np.uint8)) for _ in range(6)]
    parts = [copies[i] for i in r.integers(0, 6, 40)]
    data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
    starts = np.concatenate([130 * i + np.arange(31) for i in range(40)])
    group = np.repeat(np.arange(1), len(starts))
    seen, want = set(), []
    for s in starts:
        w = bytes(data[s : s + 100])
        want.append(w not in seen)
        seen.add(w)
    assert suffix_dedup.first_windows(data, starts, group).tolist() == want
    monkeypatch.setattr(suffix_dedup, "suffix_sort", lambda h, s, limit, group: np.random.default_rng(1).permutation(s))
    assert suffix_dedup.first_windows(data, starts, group).tolist() != want


def test_suffix_dedup_of_crowds_long_texts_and_odd_columns(corpus, spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 1)
    assert {k: tuple(r)[1:] for k, r in by_id(suffix_dedup.suffix_dedup(corpus)).items()} == spans(texts_of(corpus))
    long_ = words(120000, 31)  # more than a piece
    docs = spark.createDataFrame([(1, long_, 1), (2, words(30, 32) + long_[300000:900000], 2), (3, None, 3)], "doc_id long, text string, `my col` int")
    assert len(long_) > suffix_dedup.PIECE and {k: tuple(r)[1:] for k, r in by_id(suffix_dedup.suffix_dedup(docs)).items()} == spans(texts_of(docs))
    assert suffix_dedup.cut_repeats(docs).columns == docs.columns and suffix_dedup.cut_repeats(docs).count() == 3


def test_language(spark, corpus, empty):
    de = [(1000 + i, "der die und ung " + words(5, i) + " schön für über die straße und", "de", 1, 0.0) for i in range(40)]
    fr = [(2000 + i, "les été déjà où que nous êtes à la forêt et " + words(5, i + 99), "fr", 1, 0.0) for i in range(40)]
    docs = spark.createDataFrame([*de, *fr, (1, None, "de", 1, 0.0), (2, "123 !!", "fr", 1, 0.0), (3, "ß", None, 1, 0.0)], SCHEMA)
    got = by_id(langid.language_id(docs))
    twice = docs.unionByName(docs.limit(1)).withColumnRenamed("row", "my col")
    assert langid.keep_identified(twice).columns == twice.columns and langid.language_id(twice).count() == 84
    assert langid.keep_identified(empty).collect() == []
    long_ = spark.createDataFrame([(7, "les été déjà où que nous êtes à la forêt " * 30000, "fr", 1, 0.0)], SCHEMA)
    assert len(long_.first()["text"]) > 2 * langid.PIECE and by_id(langid.identify(long_, langid.learn(docs, F.lit(True))))[7]["lang_pred"] == "fr"
    assert len(got) == 83 and all(r["lang_pred"] == ("de" if k < 2000 else "fr") for k, r in got.items() if k >= 1000)
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[3]["lang_pred"] in ("de", "fr")
    assert langid.language_id(empty).collect() == []
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1000, 2000} and kept.filter("doc_id IN (1, 2)").count() == 0


def test_language_learns_from_every_row(spark, monkeypatch):
    n = 8000
    docs = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'straße' ELSE 'forêt' END AS text", "CASE WHEN id % 2 = 0 THEN 'de' ELSE 'fr' END AS lang")
    seen = []
    monkeypatch.setattr(langid, "most_frequent", lambda counted, k, real=langid.most_frequent: seen.append(counted.groupBy("lang").agg(F.max("n")).orderBy("lang").collect()) or real(counted, k))
    langid.learn(docs, F.lit(True))
    assert [tuple(r) for r in seen[0]] == [(0, n // 2), (1, n // 2)]


def test_bit_filter_answers_all_languages():
    f = langid.BitFilter([f"l{i:02}" for i in range(70)])
    h = langid.mix64(np.arange(1, 2000, dtype=np.uint64))
    f.add(3, h[:900])
    f.add(69, h[500:1200])
    c = f.counts(h, np.array([0, 500, 900, 1999]))
    assert c[0, 3] > 495 and c[0, 69] < 5 and c[1, 3] > 395 and c[1, 69] > 395 and c[:, 10].max() == 0


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, words(40, i) + (" you idiot stupid moron" if bad else "") + " " + words(10, i + 999), "en", 1, 0.0))
        labels.append((i, 1, int(bad)))
    rows += [(1000, words(40, 5) + " 1d10t stuuupid " + words(5, 6), "en", 1, 0.0), (1001, words(30, 7) + " i d i o t m0r0n", "en", 1, 0.0), (1002, None, "en", 1, 0.0), (1003, "", None, 1, 0.0), (1004, words(50, 77), "en", 1, 0.0)]
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(docs, lab))
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(240))
    assert [got[i]["predicted"] for i in range(1000, 1005)] == [1, 1, 0, 0, 0]
    assert toxicity.toxicity(empty, lab.limit(0)).collect() == []


def test_toxicity_learns_from_every_labelled_row(spark):
    n = 24000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(CASE WHEN id % 2 = 0 THEN 'idiot ' ELSE 'clear ' END, CASE WHEN id % 11 = 0 THEN 'sky' ELSE 'sea' END) AS text")
    model = toxicity.learn(docs, spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 = 0 AS INT) AS toxic"))
    train = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    bad = sum(i % 2 == 0 for i in train)
    assert min(bad, len(train) - bad) > 7000
    assert (model.chars.tri["^^i"], model.chars.tri["^^c"], model.chars.tri["sky"]) == (bad, len(train) - bad, sum(i % 11 == 0 for i in train))
    assert model.weights["idiot"] == pytest.approx(np.log((bad + 0.5) / (bad + 1)) - np.log(0.5 / (len(train) - bad + 1)))


def test_toxicity_counts_match_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED", 50)  # several parts
    rows = [(words(20, i) + " a s t u p i d f00l yesss", i % 3 == 0) for i in range(40)]
    tri, want = collections.Counter(), {}
    for t, _ in rows:
        for w in {x.strip(toxicity.EDGE + "!") for x in t.split()}:
            if w.isalpha() and "sss" not in w:
                tri.update(f"^^{w}$"[k : k + 3] for k in range(len(w) + 1))
    got = collections.Counter()
    for part in toxicity.count_trigrams(t for t, _ in rows):
        got.update(part)
    assert got == tri
    r = toxicity.Restorer(toxicity.CharModel(dict(tri)))
    for t, bad in rows:
        stream = collections.Counter(f for w in set().union(*r.words(t)) for f in [w, *([w[:2] + "**"] if len(w) > 1 else []), *[w[:k] + "*" for k in range(3, 8) if len(w) > k]])
        for f, k in stream.items():
            x = want.setdefault(f, [0, 0, 0])
            x[0] += bad
            x[1] += not bad
            x[2] += 0 if bad else k
    parts, have = list(toxicity.count_features(rows, r)), {}
    for f, *x in (y for part in parts for y in part):
        have[f] = [a + b for a, b in zip(have.get(f, (0, 0, 0)), x)]
    assert len(parts) > 2 and have == want


def test_toxicity_reads_spaced_and_long_runs():
    counts = collections.Counter()
    for i in range(40):
        for w in {*words(60, i).split(), "stupid", "idiot", "clown", "you", "are", "and"}:
            s = f"^^{w}$"
            counts.update(s[k : k + 3] for k in range(len(w) + 1))
    r = toxicity.Restorer(toxicity.CharModel(dict(counts)))
    assert "stupid" in r.words("you are a s t u p i d clown")[1] and "idiot" in r.words("i d i o t y und")[1]
    assert {"idiot", "stupid"} <= r.words("ein i d i o t s t u p i d mensch")[1]
    assert {"stupid", "clown"} <= r.words("y o u a r e s t u p i d c l o w n " * 6)[1]
    assert "stupid" in r.words("stu" + "u" * 90 + "pid")[1] and "idiot" in r.words("i.d.i.o.t" + "." * 60)[1] | r.words("1" + "-" * 60 + "d1ot")[1]
    assert {"stupid", "clown"} <= r.words("s.t.u.p.i.d.c.l.o.w.n.s.t.u.p.i.d.c.l.o.w.n")[1]


def test_quality(corpus, empty):
    got = by_id(quality.quality_rules(corpus))

    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed

    assert {k: tuple(r)[1:7] for k, r in got.items()} == {k: brute(t) for k, t in texts_of(corpus).items()}
    assert quality.quality_rules(empty).collect() == []


def test_quality_counts_long_common_words(spark):
    r = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["nicht", "immer", "wieder", "zwischen"], 80)), "de") for i in range(30)] + [(99, "zwischen " * 80, "de")], "doc_id long, text string, lang string")
    got = by_id(quality.quality_rules(docs))
    assert all(got[i]["js_common"] < 0.3 for i in range(30)) and got[99]["js_common"] > 0.6


def test_quality_rejects_symbols_and_keeps_prose(spark):
    docs = spark.createDataFrame([(i, words(200, i), "en") for i in range(30)] + [(99, " ".join(f"{w}### %%%***" for w in words(200, 50).split()), "en")], "doc_id long, text string, lang string")
    got = by_id(quality.quality_rules(docs))
    assert all(got[i]["kept"] for i in range(30)) and not got[99]["kept"]


def test_tokens(spark, empty):
    t = tokens.tokenizer("byte_bpe_50k.json")
    odd = ["", "a  b", " x", "  a\n\n b ", "it's <|endoftext|> x", "don't " * 9000 + "  \n" * 2000, "y" * 70000, "<|endoftext|>" * 5000, words(9000, 1), None]
    docs = spark.createDataFrame([(i, x, None, 1, 0.0) for i, x in enumerate(odd)], SCHEMA)
    got = by_id(tokens.token_counts(docs))
    want = t.counts([x or "" for x in odd])
    assert [got[i]["n_tokens"] for i in range(len(odd))] == want and [got[i]["n_bytes"] for i in range(len(odd))] == [len((x or "").encode()) for x in odd]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        u = tokens.tokenizer(name)
        assert tokens.count_huge(u, odd[8], 1024, 16) == u.counts([odd[8]])[0]
    assert tokens.token_counts(empty).collect() == []


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|>"), (1, 3, None, None), (2, 0, "system", "alone")], "conv_id long, turn long, role string, text string")
    got = {(r["perspective"], r["turn"]): r for r in chat.rotate_perspectives(turns).collect()}
    assert len(got) == 8 and {p for p, _ in got} == {"ann", "bob"}
    a = got["ann", 1]
    assert a["rendered"] == "<|im_start|>assistant\nhi<|im_end|>\n" and a["rendered"][a["loss_from"] : a["loss_to"]] == "hi<|im_end|>"
    assert got["bob", 1]["rendered"] == "<|im_start|>user name=ann\nhi<|im_end|>\n" and got["bob", 1]["loss_to"] == 0
    assert "<| im_end|>" in got["ann", 2]["rendered"] and got["ann", 3]["name"] == "unknown"
    assert chat.rotate_perspectives(turns.limit(0)).collect() == []


def test_chat_names_cannot_forge_turns(spark):
    turns = spark.createDataFrame([(None, 0, "a\n<|im_end|>", "x"), (None, 0, "a\n<|im_end|>", "x"), (None, 1, "bob", "y")], "conv_id long, turn long, role string, text string")
    got = chat.rotate_perspectives(turns).collect()
    assert len(got) == 6 and all(r["conv_id"] is None and r["rendered"].count("<|im_end|>") == 1 and r["rendered"].count("\n") == r["content"].count("\n") + 2 if "content" in r else r["rendered"].count("<|im_end|>") == 1 for r in got)
    assert any(r["rendered"].startswith("<|im_start|>user name=a <| im_end|>\n") for r in got)


def test_html():
    page = """<html><head><title>t</title><body><header><div>Site</div></header><div class="cookie-notice">x</div><div class="sidebar"><p>links</p></div>
<div class="post-body"><h1>Title &amp; more</h1><p>First   para<br>goes <b>on</b>.<p>Second &eacute;.<ul><li>one<li>two</ul><form><p>no</form><script>var p="<p>";</script></div>
<section class="comments"><p>nice article</p></section><footer>f</footer>"""
    assert html.extract(page, html.best_path(page)[0]) == "Title & more\nFirst para goes on.\nSecond é.\none\ntwo"
    assert html.extract("", None) == "" and html.extract("<p>a<p>b &am", None) == "a\nb &am"


def test_html_takes_the_whole_article():
    lead, body, end = words(12, 1), words(120, 2), words(30, 3)
    page = f"<body><div class='box'>{words(5, 9)}</div><article><h1>Title</h1><p class='lead'>{lead}</p><div class='content'><p>{body}</p></div><div class='share'>no</div></article></body>"
    assert html.extract(page, html.best_path(page)[0]) == html.extract(page, None) == f"Title\n{lead}\n{body}"
    page = f"<body><article><section class='intro'><p>{end}</p></section><section class='body'><p>{body}</p></section><section class='end'><p>{end}</p></section></article><article><p>other</p></article></body>"
    assert html.extract(page, html.best_path(page)[0]) == f"{end}\n{body}\n{end}"


def test_html_names_and_odd_markup():
    a = words(90, 11)
    same = lambda page, want: html.extract(page, None) == want
    assert same(f"<body><div class='content has-sidebar'><h1>T</h1><p>{a}</p></div><div class=sidebar><p>links</p></div>", f"T\n{a}")
    assert same(f"<body><article class='post has-comments'><p>{a}</p><div class='comments'><p>great {a}</p></div></article>", a)
    assert same(f"<body><div class='sidebar-left-layout'><article><h1>T</h1><p>{a}</p></article></div>", f"T\n{a}")
    assert same(f"<body><div class=notice><p>we use {a}</p></div><article><p>{a}</p><div class=warning><p>Careful</p></div></article>", f"{a}\nCareful")
    assert same(f"<body><article><p>a {a}</p><svg width=1 /><p>b</p><svg><path d=x><p>c</p><object data=x><p>d</p><iframe src=x><p>e</p></article>", f"a {a}\nb\nc\nd\ne")
    assert same(f"<body><article><p title=Bob's>one {a}</p><p>it's two</p><svg><title>x</title><p>in</p></svg></article>", f"one {a}\nit's two\nin")
    long_ = words(60000, 12)
    assert same(f"<body><article><p>{long_}</p></article>", long_)


def test_html_many_hosts_and_repeated_rows(spark, monkeypatch):
    good = "<body><div class='story'><p>" + words(40, 1) + "</p></div><div class='box7'><p>{}</p></div>"
    pages = spark.createDataFrame([(i // 2, f"http://a.org/{i}", good.format(words(5 + 60 * (i == 7), i))) for i in range(8)] + [(None, "no url", "<p>x")], "page_id long, url string, html string")
    rows = lambda: sorted(((r["page_id"] is None, r["page_id"], r["text"]) for r in html.main_text(pages).collect()), key=repr)
    few = rows()
    assert len(few) == 9 and all(t == words(40, 1) for n, _, t in few if not n)
    monkeypatch.setattr(html, "MAX_HOSTS", 0)
    assert rows() == few and html.main_text(pages.limit(0)).collect() == []


def test_html_hosts_agree(spark):
    good = "<body><div class='story'><p>" + words(40, 1) + "</p></div><div class='box7'><p>{}</p></div>"
    pages = [(i, f"http://a.org/{i}", good.format(words(5, i))) for i in range(5)] + [(9, "http://a.org/9", good.format(words(300, 9))), (10, None, None), (11, "http://b.org", "")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == words(40, 1) and got[10] == got[11] == "" and len(got) == 8


def test_decontamination(spark, empty):
    items = [(i, words(30, 500 + i) + ". " + words(8, 900 + i) + ".") for i in range(12)]
    bench = spark.createDataFrame([*items, (98, None), (99, " ")], "item_id long, text string")
    cut = items[3][1].split()
    rows = [(i, words(200, i), "en", 1, 0.0) for i in range(60)]
    rows += [(100 + i, words(70, 700 + i) + " " + t + " " + words(50, 800 + i), "en", 1, 0.0) for i, t in items]
    rows += [(200, words(50, 1) + " " + " ".join(w for k, w in enumerate(cut) if k % 6), "en", 1, 0.0), (201, None, None, 1, 0.0), (202, "", None, 1, 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(100 + i, i) for i in range(12)} | {(200, 3)}
    kept = decontam.drop_leaked(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 62
    assert decontam.leaks(empty, bench).collect() == [] and decontam.leaks(docs, bench.limit(0)).collect() == []


def test_decontamination_finds_short_items(spark):
    items = [(i, words(6 + i // 5 * 2, 500 + i)) for i in range(30)]  # 6 to 16 words
    docs = spark.createDataFrame([(i, words(200, i)) for i in range(60)] + [(100 + i, words(70 + i, 700 + i) + " " + t + " " + words(50, 800 + i)) for i, t in items], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(100 + i, i) for i, _ in items}


def test_decontamination_recall_and_odd_columns(spark):
    r = np.random.default_rng(77)
    vocabulary = words(600, 3).split()
    text = lambda n: " ".join(r.choice(vocabulary, n))
    items = [(i, text(40)) for i in range(60)]
    rows, want = [(k, text(150), k) for k in range(200)], []
    for share in (0.0, 0.15, 0.3):
        for i, t in items:
            w = t.split()
            for k in r.choice(34, int(share * 40), replace=False):  # the last words, the answer, stay
                w[k] = vocabulary[r.integers(len(vocabulary))]
            want.append((share, 1000 + len(want), i))
            rows.append((want[-1][1], text(60) + " " + " ".join(w) + " " + text(60), 1))
    docs = spark.createDataFrame(rows + rows[:1] + [(None, None, 1)], "doc_id long, text string, `my col` int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(docs, bench).collect()}
    for share, least in ((0.0, 1.0), (0.15, 0.97), (0.3, 0.9)):
        mine = [(d, i) for s, d, i in want if s == share]
        assert sum(x in got for x in mine) >= least * len(mine), share
    assert all(d is None or d >= 1000 for d, _ in got)
    kept = decontam.drop_leaked(docs, bench)
    assert kept.columns == docs.columns and kept.filter("doc_id < 200").count() == 201 and kept.filter("doc_id IS NULL").count() == 1


def test_decontamination_fits_all_documents(spark, monkeypatch):
    # the space has all passages in it: among 1,500 documents one word pair that only a few have is a direction of its own
    texts = [words(40, i) for i in range(60)]
    rows = [(i, texts[i % 60]) for i in range(1500)] + [(5000, words(64, 900))]
    docs = spark.createDataFrame([*rows, (5001, None), (5002, " ")], "doc_id long, text string")
    items = [(0, words(40, 901))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    seen = []
    monkeypatch.setattr(decontam, "latent_space", lambda sample, idf, real=decontam.latent_space: seen.append(sample.count()) or real(sample, idf))
    next(iter(decontam.matchers(docs, bench)))
    assert seen == [1504]


def test_latent_space_matches_dense_svd(spark, monkeypatch):
    monkeypatch.setattr(decontam, "FIT", 700)  # many slices
    monkeypatch.setattr(decontam, "COMMON", 20)  # both ways to multiply
    vocabulary = words(60, 3).split()
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(vocabulary, 64)) for _ in range(90)] + ["", None, "  "]
    idf = 1 + np.random.default_rng(6).random(1 << decontam.TERM_BITS)
    got = decontam.latent_space(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3), idf, rank=50)
    w = decontam.Words([x.encode() for x in texts if x and x.strip()])
    a = np.zeros((180, len(idf)))
    np.add.at(a, (np.arange(180 * 32) // 32, decontam._terms(w)), 1)
    a = (a * idf)[:, a.any(0)]
    n = min(50, a.shape[1])
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    table = got[np.unique(decontam._terms(w))]
    raw = a / idf[np.unique(decontam._terms(w))]
    # passages in the space: unit variance a direction, and the same directions as by the dense SVD
    mine = raw @ table
    assert abs(mine[:, :n].T @ mine[:, :n] - np.eye(n)).max() < 1e-2
    assert abs(u[:, :n] @ u[:, :n].T - mine[:, :n] @ mine[:, :n].T).max() < 2e-2


def test_latent_space_takes_little_time(spark, monkeypatch):
    """One pass of the fit gives the sums of a plain one, by ``reduceat``, in less than half of its time."""
    r = np.random.default_rng(8)
    vocabulary = np.asarray([f"w{i}" for i in range(20_000)])
    share = 1 / (np.arange(20_000) + 5.0)
    texts = [" ".join(vocabulary[r.choice(20_000, 33_000, p=share / share.sum())]).encode(), b"w900 " * 40_000 + b"w901", b"w19000"]
    slices = [decontam.Words(texts[:1]), decontam.Words(texts[1:]), decontam.Words([b"", b" "])]
    idf = np.full(1 << decontam.TERM_BITS, 12.0)
    idf[decontam._terms(decontam.Words([" ".join(vocabulary).encode()]))[::-1]] = 2 - np.log(share[::-1])
    seen: dict = {}

    def plain(w, total, weighted):
        t = decontam._terms(w)
        n = np.diff(w.bounds)
        first = (np.arange(len(t)) - np.repeat(w.bounds[:-1], n)) % 32 == 0
        y = np.add.reduceat(weighted.take(t, axis=0), np.flatnonzero(first), axis=0)
        order = np.argsort(t, kind="stable")
        heads = np.flatnonzero(np.diff(t[order], prepend=-1))
        total[t[order][heads]] += np.add.reduceat(y.take((np.cumsum(first) - 1)[order], axis=0), heads, axis=0)

    def seconds(run, *args):
        start = time.thread_time()
        run(*args)
        return time.thread_time() - start

    def sum_of(rows, partial, shape):
        weighted = (np.random.default_rng(7).standard_normal(shape) * idf[:, None]).astype(np.float32)
        seen["want"], seen["got"] = np.zeros(shape), np.zeros(shape)
        for w in slices:
            partial(w, seen["got"])
            if len(w.hashes):
                plain(w, seen["want"], weighted.astype(np.float64))
        scratch = np.ones(shape)
        seen["ratio"] = min(seconds(partial, slices[0], scratch) for _ in range(5)) / min(seconds(plain, slices[0], scratch, weighted) for _ in range(5))
        return seen["got"]

    monkeypatch.setattr(decontam, "_sum_of", sum_of)
    decontam.latent_space(None, idf)
    assert abs(seen["got"] - seen["want"]).max() < 1e-4 * abs(seen["want"]).max()
    assert seen["ratio"] < 0.5


def test_long_texts_go_in_pieces(spark, monkeypatch):
    from weftgraph.llm import common

    text = (words(4000, 21) + "  \n " + words(2000, 22)).encode()
    pieces = common.cut_words(text, 1000, 7)
    back = pieces[0].split()
    for x in pieces[1:]:
        assert x.split()[:7] == back[-7:] and len(x) < 1200
        back += x.split()[7:]
    assert back == text.split() and common.cut_words(b"x" * 5000, 1000, 3) == [b"x" * 5000]
    whole = minhash.shingle_sets([text])[0]
    items = [(0, words(30, 23)), (1, words(9, 24))]
    docs = spark.createDataFrame([(1, words(3000, 25) + " " + items[0][1] + " " + words(2000, 26) + " " + items[1][1] + " " + words(10, 27)), (2, words(200, 28))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    m = next(iter(decontam.matchers(docs, bench)))
    monkeypatch.setattr(common, "LONG", 2000)
    monkeypatch.setattr(minhash, "LONG", 2000)
    monkeypatch.setattr(decontam, "LONG", 2000)
    monkeypatch.setattr(common.cut_words, "__defaults__", (2000, 0))
    assert (minhash.shingle_sets([text])[0] == whole).all()
    assert {k for k in m.search([r["text"].encode() for r in docs.orderBy("doc_id").collect()])} == {(0, 0), (0, 1)}


def test_most_frequent_matches_sorting(spark):
    r = np.random.default_rng(4)
    rows = [(int(x), int(g), int(n)) for x in range(3) for g, n in zip(r.integers(-(1 << 62), 1 << 62, 400 * x + 30), r.integers(1, 9, 400 * x + 30))]
    want = {t for x in range(3) for t in sorted((t for t in rows if t[0] == x), key=lambda t: (-t[2], t[1]))[:100]}
    assert {tuple(t) for t in langid.most_frequent(spark.createDataFrame(rows, "lang int, g long, n long"), 100).collect()} == want


def test_lcs():
    assert decontam.lcs(list("abcbdab"), list("bdcaba")) == 4 and decontam.lcs([], [1]) == 0


def test_mixing(spark, empty):
    rows = [(i, words(60, i) + (" idiot moron stupid" if i % 5 == 0 else "") + (" ### %%% *** $$$" * 12 if i % 7 == 1 else ""), None, 1, 0.0) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 7 != 1), int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (900, None, None, 1, 0.0), (901, "", None, 1, 0.0)], SCHEMA)
    out = mixing.mixed(docs, labels).toPandas()
    assert len(out) == 302 and (out.rate >= 0).all() and set(docs.columns) <= set(out.columns)
    total = out.n_tokens.sum()
    for d, share in mixing.TARGETS.items():
        assert abs((out.rate * out.n_tokens * out[f"p_{d}"]).sum() / total - share) < 1e-3
    assert mixing.mixed(empty, labels).collect() == []


def test_mixing_learns_from_every_labelled_row(spark):
    n = 15000
    docs = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'sea idiot' ELSE 'sea sky' END AS text")
    base, weights = mixing.classifier(docs, spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'toxic' ELSE 'good' END AS domain"), 200)
    bad, good = n // 3, n - n // 3
    has = {"idiot": {"good": 0.5 / (good + 1), "poor": 0.5, "toxic": (bad + 0.5) / (bad + 1)}, "sky": {"good": (good + 0.5) / (good + 1), "poor": 0.5, "toxic": 0.5 / (bad + 1)}}
    assert weights.keys() == has.keys()
    for t, by in has.items():
        assert weights[t] == pytest.approx({d: np.log(x) - np.log(1 - x) for d, x in by.items()})
    assert base["toxic"] == pytest.approx(np.log((bad + 1) / (n + 3)) + sum(np.log(1 - by["toxic"]) for by in has.values()))


def test_mixing_matches_plain_least_squares(spark):
    r = np.random.default_rng(8)
    post = r.dirichlet([2, 1, 0.6], 500)
    n = r.integers(5, 400, 500)
    table = spark.createDataFrame([(int(a), [float(v) for v in p]) for a, p in zip(n, post)], "n_tokens long, post array<double>")
    targets = {"good": 0.7, "poor": 0.25, "toxic": 0.05}
    taken = mixing.solve(table, targets)
    got = np.array([x[0] for x in table.select(mixing.rates(F.col("post"), taken).alias("r")).collect()])
    assert (got >= 0).all()
    totals = (got[:, None] * n[:, None] * post).sum(0)
    assert abs(totals - n.sum() * np.array(list(targets.values()))).max() < 2e-6 * n.sum()
    # of all rates that meet the targets these are near 1: rates by another start move no nearer to it
    free = got > 0
    a = (n[:, None] * post)[free]
    assert abs((got[free] - 1) - post[free] @ np.linalg.lstsq(post[free], got[free] - 1, rcond=None)[0]).max() < 1e-3 or not free.all()


def test_mixing_takes_repeated_rows_and_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (None, "d e", 2), (3, None, 3)], "doc_id long, text string, `my col` int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, labels).toPandas()
    assert len(out) == 4 and "my col" in out.columns and (out.rate >= 0).all()
    assert len(mixing.mixed(docs, labels.limit(0)).collect()) == 4


def test_toxicity_takes_repeated_rows_long_texts_and_odd_columns(spark):
    rows = [(i, words(30, i) + (" you idiot" if i % 4 == 0 else ""), 1) for i in range(120)]
    docs = spark.createDataFrame([*rows, rows[4], (None, "idiot", 1), (500, words(60000, 5) + " 1d10t", 1)], "doc_id long, text string, `my col` int")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] * 2, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 123 and sum(r["doc_id"] == 4 for r in got) == 2 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["score"] for r in got if r["doc_id"] is None][0] > [r["score"] for r in got if r["doc_id"] == 1][0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = words(200, 1)
    item = words(40, 77)
    rows = [(i, words(150, 100 + i), "en", "s", 1) for i in range(40)] + [(50, base, "en", "s", 1), (51, base, "en", "s", 1), (52, "!!!", "en", "s", 1), (53, words(50, 3) + " " + item + " " + words(50, 4), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
    assert ids == [*range(40), 50] and out.filter(F.col("rate") <= 0).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "suffix_array_dedup", "benchmark_decontamination", "mixing"]


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Each stage against a plain one on the same rows: sets for near copies, all 100-byte strings for repeats, words in order for leaks."""
    import corpus_pipeline

    item, passage = words(40, 77), words(50, 78)
    base = words(150, 60).split()
    rows = [(i, words(120, 100 + i), "en", "s", 1) for i in range(30)]
    rows += [(50 + k, " ".join(f"w{k}x" if k and i == 75 + k else w for i, w in enumerate(base)), "en", "s", 1) for k in range(4)]
    rows += [(60 + k, words(60, 300 + k) + " " + passage + " " + words(60, 400 + k), None, "s", 1) for k in range(5)]
    rows += [(70, words(50, 3) + " " + item + " " + words(50, 4), "en", "s", 1), (71, words(50, 5) + " " + item[:150] + " " + words(90, 6), "en", "s", 1), (80, "42 !!", "en", "s", 1), (81, None, "en", "s", 1), (82, "", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    left = {r[0]: r[1] for r in rows if r[1] and re.search("[a-z]", r[1])}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in left.items() for w in [t.split()]}
    parent = {k: k for k in left}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in left:
        for b in left:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    left = {k: t for k, t in left.items() if root(k) == k}
    seen = set()
    for k in sorted(left):
        t = left[k]
        gone = {s + j for s in range(len(t) - 99) if t[s : s + 100] in seen for j in range(100)}
        seen |= {t[s : s + 100] for s in range(len(t) - 99)}
        left[k] = "".join(c for j, c in enumerate(t) if j not in gone)
    left = {k: t for k, t in left.items() if t.strip() and decontam.lcs(item.split(), t.split()) < 0.7 * len(item.split())}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {r["doc_id"]: left[r["doc_id"]] for r in out}
    assert left.keys() - {r["doc_id"] for r in out} == set() and 50 in left and not {51, 52, 53, 70, 80, 81, 82} & left.keys() and {61, 71} <= left.keys()
    assert all(r["rate"] > 0 for r in out)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, tmp_path, stage):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, rate string, score double, `my.col` int, id int, marks int"
    rest = ("s", 1, "old", 0.5, 7, 8, 9)
    long_ = words(150000, 9000)
    rows = [(i, words(60, i), "en" if i % 3 else None, *rest) for i in range(1, 12)]
    rows += [rows[3], (None, words(70, 50), None, None, None, None, None, None, None, None), (None, None, None, *rest), (20, None, "en", *rest), (21, "", "en", *rest), (22, "  \n", None, *rest), (23, long_, "en", *rest), (24, words(60, 1), "en", *rest), (24, words(30, 60), "en", *rest)]
    spark.createDataFrame([(0, words(30, 99)), (None, None), (0, words(30, 99)), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1, 12)] + [(None, None, None), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(rows, schema)
    out = run(spark, docs, str(tmp_path))
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    if name != "mixing":
        assert out.columns == docs.columns
    want = [(r[0], r[1]) for r in rows]
    if name == "language_id":  # null, empty and blank texts go
        want = [x for x in want if x[1] and x[1].strip()]
    if name == "near_duplicates":  # 24 has the text of 1, so its rows go
        want = [x for x in want if x[0] != 24]
    if name == "suffix_array_dedup":  # nothing is left of the copy
        want = [x for x in want if x != (24, words(60, 1))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert run(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_rows_repeat_and_clash(spark):
    """Repeated rows give repeated results, in operators that judge each row by itself; null ids are kept."""
    docs = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (None, "d", 2), (2, None, 3)], "doc_id long, text string, n_tokens int")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.token_counts(docs).collect()) == [(0, 1), (1, 3), (1, 3), (2, 0)]
    got = quality.quality_rules(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in got) == [(0, 1, False), (1, 3, False), (1, 3, False), (2, 0, False)]
