"""The pipeline against its stages in plain Python."""

import re

import corpus_pipeline
from pairlens.llm import quality, queries, secrets
from test_rows import brute_classes, brute_fingerprint, brute_hits
from test_secrets import ASSIGN
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def has_secret(t):
    t = t or ""
    if any(len(m[2]) >= 8 for m in ASSIGN.finditer(t)):
        return True
    return any(re.search(r.pattern, t) for r in secrets.RULES[1:])


def brute(docs, items):
    """ids -> texts after each of the filtering stages."""
    kept = {d: quality.clean_text(t) for d, t in docs.items() if quality.judge_text(t, quality.LineRules())[-1]}
    out = [kept]
    comp = brute_classes({d: brute_fingerprint(t) for d, t in kept.items()})
    out.append({d: t for d, t in kept.items() if comp[d] == d})
    out.append({d: t for d, t in out[-1].items() if not brute_hits(t, items)[4]})
    out.append({d: t for d, t in out[-1].items() if not has_secret(t)})
    return out


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute({r.doc_id: r.text for r in docs.collect()}, bench)
    now = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "secret_scans", "best_fit_packing"]
    for (_, stage), left in zip(corpus_pipeline.STAGES[:-1], want):
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        got = {r.doc_id: r for r in now.collect()}
        assert {d: r.text for d, r in got.items()} == left and all(r.n_chars == len(r.text) for r in got.values())
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, want[-1], 2048)


def test_edges(spark, docs, save):
    """Nulls, empty and long texts, repeated rows, a further column; an empty table."""
    from pyspark.sql import functions as F
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    more = docs.withColumn("blob", F.lit(1)).withColumn("quality", F.lit("q"))
    sf = save(documents=more.union(more.limit(3)), benchmark=bench)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == more.columns
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids)) > 5
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(ids)
    empty = save(documents=docs.limit(0), benchmark=bench.limit(0))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_all_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", k)[0] for k in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
