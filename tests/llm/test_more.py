"""Token codes (1), substring dedup (2), language identification (3), URL filters (9)."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlens.llm import common, language, queries, substrings, token_codes, tokens, urls

LIB = Tokenizer.from_file(tokens.tokenizer_path())
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ 1

@pytest.mark.parametrize("high", [1, 256, 50_257, 1 << 24, 1 << 32])
def test_codes_round_trip(high):
    rng = np.random.default_rng(high)
    v = rng.integers(0, high, 5000).astype("<u4")
    v[:2] = 0, high - 1
    codes = token_codes.Codes(token_codes.encode(v))
    assert len(codes) == 5000 and [codes[i] for i in range(0, 5000, 7)] == v[::7].tolist()
    for a, n in ((0, 5000), (1, 1), (63, 130), (511, 2), (512, 700), (4999, 1), (77, 0)):
        assert codes.ids(a, n).tolist() == v[a:a + n].tolist()
    assert len(token_codes.Codes(token_codes.encode(v[:0]))) == 0


def test_token_code_query(spark, docs, save):
    got = {r.doc_id: r for r in queries.op1_token_codes(spark, save(documents=docs)).collect()}
    at = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        v = np.array([*LIB.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(v), zlib.crc32(v.tobytes()))
        at += len(v)
    assert not got


def test_token_code_segments(spark, docs, tmp_path):
    """Small segments; single tokens read by position; the same rows as one large segment."""
    token_codes.write(docs, f"{tmp_path}/a", per_segment=300)
    token_codes.write(docs, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/a").count() > spark.read.parquet(f"{tmp_path}/b").count()
    a, b = (sorted(map(tuple, token_codes.documents(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b
    every = [i for r in sorted(docs.collect(), key=lambda r: r.doc_id) for i in [*LIB.encode(r.text or "", add_special_tokens=False).ids, 0]]
    ask = [0, 1, 17, len(every) // 2, len(every) - 1, len(every)]
    got = {r.position: r.id for r in token_codes.tokens_at(spark, f"{tmp_path}/a", ask).collect()}
    assert got == {i: every[i] for i in ask[:-1]}


def test_token_code_edges(spark, tmp_path):
    df = spark.createDataFrame([(None, "b", 1), (3, None, 2), (3, "a", 3), (3, "a", 4)], "doc_id long, text string, shard int")
    token_codes.write(df, f"{tmp_path}/a")
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_codes.documents(spark, f"{tmp_path}/a").collect()))
    assert got == [(0, None, 2), (2, 3, 1), (3, 3, 2), (5, 3, 2)]
    token_codes.write(df.limit(0), f"{tmp_path}/b")
    assert token_codes.documents(spark, f"{tmp_path}/b").count() == 0


# ------------------------------------------------------------------ 2

def test_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))
    assert substrings.PERIOD - 1 + substrings.ANCHOR == substrings.WINDOW


@pytest.mark.parametrize("size", [64, 1024, 4096])
def test_long_words_that_polynomials_confuse(spark, size):
    """Two documents that differ in one word only, by strings whose polynomial hashes modulo 2^64 agree."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(size))
    b = a.translate(str.maketrans("ab", "ba"))
    words = [f"word{i}" for i in range(60)]
    rows = [(1, " ".join(words[:20] + [a] + words[21:])), (2, " ".join(words[:20] + [b] + words[21:])), (3, " ".join(words[:20] + [a] + words[21:]))]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 0, 3: 60}


def brute_removed(rows):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - 49) if d is not None else ():
            k = tuple(w[i:i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49) if d is not None else ():
            if first[tuple(w[i:i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def plant(seed, n=60):
    """Documents that share passages of 30 to 90 words at all alignments, copies and loops."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.randrange(30, 90))] for _ in range(8)]
    passages.append(["lo", "la"] * 60)
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(0, 70))]
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages) + [word() for _ in range(rng.randrange(0, 40))]
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out + out[3:6] + [out[7]] * 4


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substrings_planted(spark, save, seed):
    texts = plant(seed)
    ids = random.Random(seed).sample(range(-50, 500), len(texts))
    rows = list(zip(ids, texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = queries.op2_substring_dedup(spark, save(documents=df)).collect()
    want = brute_removed(rows)
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r[2] > 0 for r in want) > 10


def test_substrings_edges(spark, docs, save):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = queries.op2_substring_dedup(spark, save(documents=docs)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_removed(rows))
    t = " ".join(f"v{i}" for i in range(80))
    rows = [(4, t), (4, t), (4, "x " + t), (None, t), (None, None), (9, t)]
    df = spark.createDataFrame([(d, x, 1, 2) for d, x in rows], "doc_id long, text string, key int, positions int")
    got = substrings.dedup(df)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got.collect()) == sorted(
        (str(d), n, k) for d, n, k in [(4, 80, 0), (4, 80, 0), (4, 81, 0), (None, 80, 0), (None, 0, 0), (9, 80, 80)])
    assert substrings.dedup(df.limit(0)).count() == 0


def test_word_hash_slices(monkeypatch):
    texts = [t.encode() for t in plant(5)] + [b"", b" ", b"a" * 300]
    a = substrings.Words(texts).hashes(0)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 64)
    assert (substrings.Words(texts).hashes(0) == a).all()
    flat = [w for t in texts for w in t.split()]
    assert len(a) == len(flat) and len(set(a.tolist())) == len(set(flat))


# ------------------------------------------------------------------ 3

def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op3_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    tried = right = 0
    for r in docs:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= g.score <= 1
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert g.lang_pred == "und"
        elif g.held_out and r.lang:
            tried, right = tried + 1, right + (g.lang_pred == r.lang)
    assert tried > 100 and right >= 0.97 * tried


def test_language_edges(spark):
    rows = [(i, "der die und das ist nicht schön " * 5 if i % 2 else "the and of that is with which " * 5, "de" if i % 2 else "en", 1) for i in range(80)]
    rows += [(100, None, "en", 1), (101, "123 !!", None, 1), (None, "the and of the with", "de", 1), (103, "", "de", 1), (104, "the " * 50_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r.language for r in language.identify(df).collect()}
    assert [got[i].lang_pred for i in (0, 1, 100, 101, 103, 104, None)] == ["en", "de", "und", "und", "und", "en", "en"]
    none = language.identify(df.withColumn("lang", df.lang.substr(9, 1)).filter("doc_id < 2").selectExpr("doc_id", "text", "string(null) lang"))
    assert {r.language.lang_pred for r in none.collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_language_learns_nothing_from_held_out_rows(spark):
    rows = [(i, f"text number {i} here", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    used = language.sample(df, "doc_id", "text", "lang", language.Training())
    want = [f"text number {i} here" for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(x for _, x in used) == sorted(want)


def test_language_sample(spark):
    """Every language is drawn from, each up to its bound; a large group of copies counts once."""
    rows = [(i, f"text {i}", f"l{i % 230}") for i in range(230 * 6)] + [(i, f"much {i}", "de") for i in range(2000)] + [(7, "copy", "en")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    used = language.sample(df, "doc_id", "text", "lang", language.Training(per_class=20))
    by = {}
    for lang, p in used:
        by.setdefault(lang, []).append(p)
    want = {}
    for i, p, lang in set(rows):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            want.setdefault(lang, []).append(p)
    assert set(by) == set(want) and len(by) > 200
    assert all(len(by[x]) == len(set(by[x])) == min(20, len(want[x])) and set(by[x]) <= set(want[x]) for x in by)
    assert used == language.sample(df.repartition(3), "doc_id", "text", "lang", language.Training(per_class=20))


def test_language_model_in_plain_python():
    """Two steps of training and the forward pass, number by number."""
    texts = [("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chat et le chien"), ("en", "a dog"), ("de", "ein hund"), ("fr", "un chat")]
    t = language.Training(buckets=1 << 10, dim=2, epochs=2, batch=1000)
    model = language.train(texts, t)
    rng = np.random.default_rng(t.seed)
    rows = [texts[i] for i in rng.permutation(len(texts))]
    samples = []
    for i, (lang, text) in enumerate(rows):
        if i % 5:
            rng.integers(0, 1, 2)  # a short text's pieces are the whole text
            samples += [(["de", "en", "fr"].index(lang), language.grams(text, t.buckets).tolist())] * 3
    emb = (rng.uniform(-1, 1, (t.buckets, t.dim)) / t.dim).tolist()
    weights, bias = [[0.0] * 3 for _ in range(t.dim)], [0.0] * 3
    mean = lambda g: [sum(emb[h][d] for h in g) / len(g) for d in range(t.dim)]
    logits = lambda g: [sum(x * w for x, w in zip(mean(g), col)) + b for col, b in zip(zip(*weights), bias)]
    for rate in (t.rate, t.rate / 2):
        d_w, d_b, d_e = [[0.0] * 3 for _ in range(t.dim)], [0.0] * 3, {}
        for y, g in samples:
            z = logits(g)
            e = [np.exp(v) / sum(np.exp(z)) - (k == y) for k, v in enumerate(z)]
            for d in range(t.dim):
                for k in range(3):
                    d_w[d][k] += mean(g)[d] * e[k]
                for h in g:
                    d_e[h, d] = d_e.get((h, d), 0) + t.embedding_rate / len(g) * sum(e[k] * weights[d][k] for k in range(3))
            d_b = [b + x for b, x in zip(d_b, e)]
        weights = [[w - rate * x for w, x in zip(*both)] for both in zip(weights, d_w)]
        bias = [b - rate * x / len(samples) for b, x in zip(bias, d_b)]
        for (h, d), x in d_e.items():
            emb[h][d] -= rate * x
    assert model.weights is not None  # three languages, two dimensions: the factors
    for text in ("the dog", "der chat", "und"):
        assert model.logits(text) == pytest.approx(logits(language.grams(text, t.buckets).tolist()), abs=1e-4)


def test_many_languages_are_bounded(spark):
    """What is sampled and broadcast does not grow with buckets x languages."""
    import pickle
    rows = [(i, f"{k}x {k}y {k}z words of language {k} " * 3, f"l{k}") for i, k in enumerate(k for k in range(3000) for _ in range(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    t = language.Training(max_rows=3500, epochs=1)
    used = language.sample(df, "doc_id", "text", "lang", t)
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {x for x, _ in used} == learned and len(used) == len(learned)
    model = language.train(used[:2500], t)
    assert len(model.langs) == 2500 and len(pickle.dumps(model)) < 4 << 20


# ------------------------------------------------------------------ 9

def brute_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def brute_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_url_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op9_url_filters(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        g, (host, path) = got[p.page_id], brute_url(p.url)
        rule = brute_rule(host, path)
        assert (g.host, g.path, g.rule) == (host, path, rule.text if rule else None)
        assert g.verdict == rule.verdict if rule else g.verdict in ("allow", "block")


def test_url_edges(spark):
    us = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x?y", "x://ORG", "x://org/", "a://b.com/fr/://c.org/de/", "http://h.com?u=://z/",
          "http://É.Com/de/#a", "http://myexample.org/es/", "http://sub.example.org/en/1", "http://u:p@Example.org:80/es/", "x://a\nb/c\nd?e"]
    df = spark.createDataFrame([(i, u, None, "z") for i, u in enumerate(us)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.verdicts(df).collect()}
    for i, u in enumerate(us):
        host, path = brute_url(u)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.text if rule else None), u
        assert got[i].verdict == (rule.verdict if rule else "allow")
    assert urls.verdicts(df.limit(0)).count() == 0


def test_link_graph(spark):
    """Trust follows links, distrust goes back along them; against plain power iteration."""
    links = {"good.org": ["far.net", "good.org"], "far.net": ["farther.net"], "spam.net": ["d.example.org", "d.example.org/x"], "pre.net": ["SPAM.net"],
             "d.example.org": [], "mixed.net": ["far.net", "d.example.org"]}
    rows = [(i, f"http://{h}/{'es/' if h.startswith('d.') else 'a'}", " ".join(f'<a href="//{x}/p">' for x in to) + '<a href="/own">')
            for i, (h, to) in enumerate(links.items())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    s = urls.Spread(max_rounds=60, tolerance=1e-9)
    host, path = urls.host_and_path(df.url)
    edges = urls.host_links(df.select(host.alias("host"), "html"), "host", "html")
    assert {(r.src, r.dst, r.n) for r in edges.collect()} == {
        ("good.org", "far.net", 1), ("far.net", "farther.net", 1), ("spam.net", "d.example.org", 1), ("pre.net", "spam.net", 1),
        ("mixed.net", "far.net", 1), ("mixed.net", "d.example.org", 1)}
    seeds = spark.createDataFrame([("good.org", 1.0)], "host string, seed double")
    got = {r.host: r.score for r in urls.page_rank(edges, seeds, s).collect()}
    assert got == pytest.approx({"good.org": 0.15, "far.net": 0.15 * 0.85, "farther.net": 0.15 * 0.85 ** 2})
    verdict = {r.host: r.verdict for r in urls.verdicts(df, s=s).collect()}
    assert verdict == {"good.org": "allow", "far.net": "allow", "d.example.org": "block", "spam.net": "block", "pre.net": "block", "mixed.net": "block"}


def test_link_graph_to_its_end(spark):
    """Default rounds: a long chain towards a blocked page is followed to its end, whatever an unrelated hot host holds."""
    chain = [f"h{k}.net" for k in range(30)] + ["d.example.org"]
    rows = [(f"http://{a}/a", f'<a href="//{b}/p">') for a, b in zip(chain, chain[1:])] + [("http://d.example.org/es/", None)]
    rows += [("http://hot.example.org/es/x", None)] * 2000
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in urls.verdicts(df).collect()}
    assert got == {h: "block" for h in [*chain, "hot.example.org"]}


def test_link_graph_scores_are_settled(spark):
    """A ring, a way into it and a far larger seed elsewhere: every host's score, also the small ones, is that of power iteration."""
    links = {("a", "b"): 1, ("b", "c"): 3, ("b", "x"): 1, ("c", "a"): 1, ("x", "y"): 1, ("y", "a"): 2, ("y", "z"): 9}
    edges = spark.createDataFrame([(s, d, n) for (s, d), n in links.items()], "src string, dst string, n long")
    seeds = {"a": 1.0, "hot": 1e6}
    got = {r.host: r.score for r in urls.page_rank(edges, spark.createDataFrame(list(seeds.items()), "host string, seed double")).collect()}
    want = {}
    for _ in range(500):
        new = {h: 0.15 * v for h, v in seeds.items()}
        for (s, d), n in links.items():
            new[d] = new.get(d, 0.0) + 0.85 * want.get(s, 0.0) * n / sum(m for (t, _), m in links.items() if t == s)
        want = {h: v for h, v in new.items() if v}
    assert got == pytest.approx(want, rel=1e-4)


def linked_pages():
    """Chains towards blocked and allowed seeds, a hub, a large host with one bad link, repeated rows."""
    link = lambda *hosts: "".join(f"<a href='https://{h}/x'>" for h in hosts)
    rows = [("https://bad.com/de/1", link("far.net")), ("https://good.org/1", link("a0.net", "hub.net")), (None, None), ("no url", "")]
    rows += [(f"https://c{i}.net/p", link(f"c{i + 1}.net" if i < 12 else "bad.com")) for i in range(13)]
    rows += [(f"https://a{i}.net/p", link(f"a{i + 1}.net")) for i in range(8)]
    rows += [("https://hub.net/p", link(*[f"s{i}.net" for i in range(60)], "bad.com"))] * 3
    rows += [(f"https://s{i}.net/p", link("bad.com") if i % 2 else "") for i in range(60)]
    rows += [(f"https://big.net/{i}", link("bad.com") if i == 0 else "") for i in range(400)]
    return [(i, u, h) for i, (u, h) in enumerate(rows)]


def test_linked_pages_against_sql(spark, save):
    import duckdb

    from pairlens.llm.sql import SQL
    folder = save(pages=spark.createDataFrame(linked_pages(), "page_id long, url string, html string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op9_url_filters(spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(SQL["op9_url_filters"]).fetchall()}
    assert got == want
    verdict = {h: v for h, _, _, v in got.values()}
    assert verdict["c0.net"] == verdict["s1.net"] == "block" and verdict["a7.net"] == verdict["s0.net"] == "allow"


def test_a_large_host_is_not_blocked_by_one_link(spark):
    """The same link blocks a host of a page, and not one of many pages without trust."""
    edges = spark.createDataFrame([("big", "bad", 1), ("small", "bad", 1)], "src string, dst string, n long")
    pages = spark.range(3_000_000).select(F.lit("big").alias("host"), F.lit(None).cast("string").alias("verdict")).union(
        spark.createDataFrame([("small", None), ("bad", "block")], "host string, verdict string"))
    got = {r.host: (r.n_pages, r.blocked) for r in urls.host_scores(pages, edges).collect()}
    assert got == {"big": (3_000_000, False), "small": (1, True), "bad": (1, True)}


def test_edges_are_dealt_once(spark):
    """A hundred thousand hosts: a round deals ranks, the edges stay in their buckets."""
    import pyspark.sql.functions as P
    n = 100_000
    edges = spark.range(n).select(P.concat(P.lit("h"), "id").alias("src"), P.concat(P.lit("h"), P.expr("id div 7")).alias("dst"), P.lit(1).cast("long").alias("n")).filter("src <> dst")
    seeds = spark.createDataFrame([("h99999", 1000.0), ("h54321", 10.0)], "host string, seed double")
    got = {r.host: r.score for r in urls.page_rank(edges, seeds).collect()}
    want = {}
    for seed, at in ((1000.0, 99999), (10.0, 54321)):
        score = 0.15 * seed
        while True:
            want[f"h{at}"] = want.get(f"h{at}", 0) + score
            if at == 0:
                break
            at, score = at // 7, 0.85 * score
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h], rel=1e-5) for h in want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shares = urls.c.stored_in_buckets(edges.withColumn("salt", P.lit(0)), "test_shares", ["src", "salt"])
        sent = spark.createDataFrame([("h1", 1.0, 0)], "src string, score double, salt int")
        plan = shares.join(sent, ["src", "salt"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_a_segment_is_read_once(monkeypatch):
    """Reading files back goes through each level of a segment once, not once a document."""
    ids = np.array([5, 70_000, 0, 0, 300, 1 << 31, 0], "<u4")
    batch = pa.RecordBatch.from_arrays(
        [pa.array([2], pa.int32()), pa.array([100], pa.int64()), pa.array([[7, 8, 9]]), pa.array([[0, 3, 4]]), pa.array([token_codes.encode(ids)])],
        ["shard", "shard_start", "doc_ids", "starts", "code"])
    own, calls = token_codes.Codes.ids, []
    monkeypatch.setattr(token_codes.Codes, "ids", lambda self, start, n, level=0: calls.append(level) or own(self, start, n, level))
    got, = token_codes._documents([batch])
    assert got.to_pydict() == {
        "doc_id": [7, 8, 9], "shard": [2] * 3, "at": [100, 103, 104], "n_tokens": [3, 1, 3],
        "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in ((0, 3), (3, 4), (4, 7))]}
    assert sorted(calls) == [0, 1, 2, 3]


def test_substrings_send_small_batches(spark, monkeypatch):
    """Whole texts go to Python and come back in bounded batches, whatever the session's rows a batch."""
    monkeypatch.setattr(common, "BATCH_BYTES", 50_000, raising=False)
    key, own = "spark.sql.execution.arrow.maxBytesPerBatch", substrings._windows
    before = spark.conf.get(key, None)

    def watched(batches):
        def small(b):
            assert b.nbytes < 200_000, b.nbytes
            return b
        return own(small(b) for b in batches)

    monkeypatch.setattr(substrings, "_windows", watched)
    passage = " ".join(f"v{i}" for i in range(800))
    rows = [(i, f"{passage} own{i}") for i in range(300)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(i, 801, 0 if i == 0 else 800) for i in range(300)]
    assert spark.conf.get(key, None) == before


def test_kept_words_come_in_slices(monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_CHARS", 100)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([3, None, 5, 6]), pa.array(["a " * 60, None, "b " * 60, "c"]), pa.array([[0], None, None, None], pa.list_(pa.int32()))],
        ["doc_id", "text", "positions"])
    got = list(substrings._kept([batch, batch.slice(0, 0)]))
    assert [b.num_rows for b in got] == [3, 1]
    assert [r for b in got for r in map(tuple, zip(*b.to_pydict().values()))] == [
        (3, 60, 50, " ".join("a" * 10)), (None, 0, 0, ""), (5, 60, 0, " ".join("b" * 60)), (6, 1, 0, "c")]
