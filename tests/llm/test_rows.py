"""Row-local operators against plain Python: quality rules (7), decontamination (4), SimHash (10)."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pairlens.llm import contamination, quality, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n")]
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), failed


def test_quality_counts(spark, docs, save):
    got = {r.doc_id: r for r in queries.op7_quality_rules(spark, save(documents=docs)).collect()}
    src = docs.collect()
    assert len(got) == len(src)
    for r in src:
        if r.text and len(r.text) > 20_000:
            continue
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute_quality(r.text)
        assert not (g.base_failed and g.kept)


def test_boilerplate_parts_miss_nothing():
    """Every form that the pattern takes holds one of the parts, odd case forms included."""
    forms = ["All Rights Reserved", "ACCEPT COOKIES", "accept all cook\u0131es", "Cookie Policy", "PR\u0130VACY POL\u0130CY", "Terms of Use", "term\u017f of service",
             "enable JavaScript", "javascript is disabled", "Java\u017fcr\u0130pt is required", "Subscribe to our newsletter", "CLIC\u212a HERE", "cl\u0131ck here",
             "powered by x", "Lorem \u0130psum", "copyr\u0131ght \u00a9 2020", "Copyright (C)", "released under the MIT licence"]
    for t in forms:
        assert quality.BOILERPLATE.search(t) and quality.may_be_boilerplate(t), t
    assert not quality.may_be_boilerplate("nothing of that kind")


def test_repeated_words_in_numbers(monkeypatch):
    rng = __import__("random").Random(4)
    for k in range(300):
        t = " ".join(rng.choice(["a", "b", "c", "dd", "e\n", "é"][:rng.randrange(1, 7)]) for _ in range(rng.randrange(0, 30)))
        monkeypatch.setattr(quality, "SLICE", rng.choice([1, 5, 1 << 20]))
        got = quality.judge_text(t, quality.LineRules())
        assert (got[0], got[4]) == (brute_quality(t)[0], brute_quality(t)[4]), t
    size = (1 << 21) + 5  # more distinct words than fit three in a number
    many = quality.np.concatenate([quality.np.arange(size), [7, 8, 9, 1, 3, 5]])
    assert quality.repeated_words(many) == 6


def test_quality_lines_and_keep(spark):
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(8)) + "." for i in range(12))
    nav = "\n".join(["Home | About | Contact | Login"] * 3 + ["w%d no end mark here at all" % i for i in range(20)])
    df = spark.createDataFrame([(1, good, "x"), (2, nav, "x"), (3, None, "x"), (1, good, "x")], "doc_id long, text string, quality string")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1]
    assert quality.clean_text(good + "\nHome | About | Contact") == good
    assert quality.keep_good(df.limit(0)).count() == 0
    both = good + "\nHome | About | Contact"
    sized = spark.createDataFrame([(1, both, len(both)), (2, nav, 5), (3, None, 0), (4, good, -1)], "doc_id long, text string, n_chars long")
    assert quality.clean_good(sized, size="n_chars")._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, quality.clean_good(sized, size="n_chars").collect())) == [(1, good, len(good)), (4, good, -1)]


def test_quality_clean(spark, docs):
    """Cleaned texts come out of a DataFrame; what the verdict counts as removed is gone, the rest stays."""
    both = "first line here.\n\nHome | About | Contact\nfirst line here.\n# $ %\nlast one."
    df = spark.createDataFrame([(1, both, 5), (1, both, 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, n_lines int")
    got = quality.clean(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, str(r.text), r.n_lines) for r in got.collect()) == [(1, "first line here.\n\nlast one.", 5)] * 2 + [
        (2, "None", 6), (3, "", 7)]
    lost = {r.doc_id: r.quality.lost_chars for r in quality.verdicts(docs).collect()}
    chars = lambda t: len(re.sub(r"[\x20\x09-\x0D]", "", t or ""))
    new = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert all(chars(r.text) - chars(new[r.doc_id]) == lost[r.doc_id] for r in docs.collect())
    assert any(lost.values())


def brute_hits(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    w = norm(text)
    hit, ids = set(), set()
    for i, t in items:
        v = norm(t)
        if not v:
            continue
        n = min(13, len(v))
        for s in range(len(v) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[s:s + n]:
                    hit |= set(range(p, p + n))
                    ids |= {str(i)} - {"None"}
    return (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("shard_bytes", [16 << 20, 600])
def test_decontamination(spark, docs, texts, shard_bytes):
    prose = [t for t in texts if t and 60 < len(t.split()) < 300]
    items = [(1, " ".join(prose[0].split()[5:40])), (2, prose[1].upper()), (3, None), (4, "..."), (5, "two WORDS"), (10, "TWO words"),
             (None, "one"), (7, " ".join(prose[2].split()[:12])), (7, " ".join(prose[2].split()[:12])), (8, "😀 x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.mark(docs, bench, shard_bytes=shard_bytes, name="h", spans=True).select(
        "doc_id", "text", "h", contamination.n_hit("h").alias("n"), contamination.contaminated("h").alias("bad")).collect()
    for r in got:
        if r.text and len(r.text) > 20_000:
            continue
        n, hit, k, sha, bad = brute_hits(r.text, items)
        assert (r.h.n_words, r.n, len(r.h["items"]), r.bad) == (n, hit, k, bad), r.text
        assert hashlib.sha256(",".join(r.h["items"]).encode()).hexdigest() == sha
        for s, e in zip(r.h.spans[::2], r.h.spans[1::2]):
            assert re.match(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r.text[s]) and e <= len(r.text)
    assert sum(r.bad for r in got) >= 3
    clean = contamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.bad for r in got)
    assert contamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_shards_bound_the_automaton(spark):
    """Shards hold the text that an automaton may have, also of one long item; they have all windows together."""
    import random
    rng = random.Random(8)
    long = " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(6000))
    items = [("1", long), ("2", "two WORDS"), ("2", "two WORDS"), ("3", long[5000:5600])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    shards = list(contamination.item_shards(bench, "item_id", "text", 12_000))
    assert len(shards) > 2
    together = {}
    for own in shards:
        assert sum(len(t) for _, t in own) <= 12_000
        assert contamination.build(own).get_stats()["total_size"] <= 12_000 * contamination.AUTOMATON_PER_BYTE
        for p, ids in contamination.item_patterns(own).items():
            together.setdefault(p, set()).update(ids)
    assert together == contamination.item_patterns(items)


def test_pattern_hashes_against_patterns():
    import random
    rng = random.Random(3)
    items = [(str(k), " ".join(rng.choice("a b, C\n dé 12".split()) for _ in range(rng.randrange(0, 30)))) for k in range(40)] + [("x", ""), ("y", "..")]
    sizes = {}
    for p in contamination.item_patterns(items):
        sizes.setdefault(p.count(" ") - 1, set()).add(p)
    got = contamination.pattern_hashes([t for _, t in items], 13)
    assert {n: len(h) for n, h in got.items()} == {n: len(p) for n, p in sizes.items()}
    texts = [t for _, t in items] + ["a", "zz", "", "q a b c q", " ".join("z" for _ in range(50))]
    for known in (got, {n: h[::3] for n, h in got.items() if n > 5}, {}):
        n, may = contamination.with_patterns(texts, known)
        words = [[w.decode() for w in contamination.normal_words(t) if w] for t in texts]
        assert n.tolist() == list(map(len, words))
        if known is got:
            assert may.tolist() == [any(f" {' '.join(w[i:i + n])} " in p for n, p in sizes.items() for i in range(len(w) - n + 1)) for w in words]


def test_large_benchmark_scans_only_candidates(spark, monkeypatch):
    """Many shards and blocks of hashes: same hits as one automaton, and few documents reach them."""
    import random
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(60)]
    docs = [(i, " ".join([word() for _ in range(30)] + (items[i % 60][1].split()[5:25] if i % 10 == 0 else []))) for i in range(400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = lambda out: sorted((r.doc_id, r.hits.n_words, r.hits.ranges, r.hits["items"]) for r in out.collect())
    one = rows(contamination.mark(df, bench))
    kept, seen = contamination.c.stored, []
    monkeypatch.setattr(contamination.c, "stored", lambda d, n: seen.append((n, kept(d, n))) or seen[-1][1])
    blocks = contamination.hash_blocks
    monkeypatch.setattr(contamination, "hash_blocks", lambda items, window: blocks(items, window, 500))
    assert rows(contamination.mark(df, bench, shard_bytes=2000)) == one
    names = [n for n, _ in seen]
    assert names.count("found") >= 3 and names.count("hits") >= 5 and dict(seen)["candidates"].count() == 40


def test_one_shard_a_pass(spark):
    """No plan has two automata side by side; repeated rows and other columns stay."""
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[20:]))], "item_id long, text string")
    rows = [(1, "x " + " ".join(words[5:25]), 1), (1, "x " + " ".join(words[5:25]), 1), (None, " ".join(words).upper(), 2), (3, None, 3)]
    got = contamination.mark(spark.createDataFrame(rows, "doc_id long, text string, uid int"), bench, shard_bytes=150, spans=True)
    assert "ArrowEvalPython [run" not in got._jdf.queryExecution().optimizedPlan().toString()
    out = sorted(((r.uid, r.hits.n_words, r.hits.ranges, r.hits["items"]) for r in got.collect()))
    assert out == [(1, 21, [1, 21], ["1"])] * 2 + [(2, 60, [0, 60], ["1", "2"]), (3, 0, [], [])]
    assert got.columns == ["doc_id", "text", "uid", "hits"]


def test_columns_of_the_same_name(spark):
    """A result column takes the place of one of that name; filters leave all columns alone."""
    from pairlens.llm import language, prefix_counts
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    df = spark.createDataFrame([(1, "one two three", 7, 8, 9, 10, "en")],
                               "doc_id long, text string, hits int, quality int, language int, prefixes int, lang string")
    for out, name in ((contamination.mark(df, bench), "hits"), (contamination.mark(df, bench, shard_bytes=1), "hits"),
                      (quality.verdicts(df), "quality"), (language.identify(df), "language"), (prefix_counts.prefix_table(df), "prefixes")):
        assert sorted(out.columns) == sorted(df.columns)
        assert isinstance(out.first()[name], tuple)
    assert contamination.decontaminate(df, bench).columns == quality.keep_good(df).columns == simhash.keep_first(df).columns == df.columns


def test_decontamination_query(spark):
    items = [(r.item_id, r.text) for r in rows_of(spark, "benchmark")]
    got = {r.doc_id: r for r in queries.op4_decontaminate(spark, SF).collect()}
    assert any(r.contaminated for r in got.values())
    for d in [d for d in rows_of(spark, "documents") if got[d.doc_id].n_hit][:8]:
        g = got[d.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == brute_hits(d.text, items)


def brute_fingerprint(t):
    w = WORD.findall(lower(t or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps):
    comp = {}
    for d in sorted(fps):
        if d in comp:
            continue
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = d
                todo += [y for y in fps if y not in comp and (fps[x] ^ fps[y]).bit_count() <= 2]
    return comp


def test_simhash_query(spark, docs, save):
    got = queries.op10_simhash(spark, save(documents=docs)).collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    comp = brute_classes(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{f:016x}", comp[d]) for d, f in fps.items()}


@pytest.mark.parametrize("limit", [2048, 3])
def test_simhash_links(spark, limit):
    import random
    rng = random.Random(3)
    fps, base = {}, [rng.getrandbits(64) for _ in range(12)]
    for d in range(160):
        f = base[d % 12]
        for _ in range(rng.randrange(5)):
            f ^= 1 << rng.randrange(64)
        fps[d] = f
    keys = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in fps.items()], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes_of(keys, bucket_limit=limit).collect()}
    assert got == brute_classes(fps)
    assert len(set(got.values())) < 100


def test_simhash_keep(spark):
    t = "the quick brown fox jumps over the lazy dog again and again today"
    df = spark.createDataFrame([(5, t, 1), (3, t.upper(), 2), (3, t, 3), (9, None, 4), (8, "", 5), (None, "alone here now ok", 6),
                                (None, t, 7), (1, "completely different words in this one " * 3, 8)],
                               "doc_id long, text string, fp int")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 3, 8]
    assert simhash.keep_first(df.limit(0)).count() == 0
    assert simhash.classes(df).filter(F.col("component_id").isNull()).count() == 1
