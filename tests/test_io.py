import json
import os

import pytest

from pairlens import session
from pairlens.sinks import files as sink
from pairlens.sources import files as src
from pairlens.sources import lines


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_bad_line_keeps_its_number(spark, tmp_path):
    d = str(tmp_path / "corpus")
    _write(d, "a.jsonl", '{"text": "one"}\n{bad\n{"other": 1}\n')
    _write(d, "b.txt", '{"text": "ignored"}\n')
    rows = src.line_pairs(src.read_jsonl_corpus(spark, d)).orderBy("line_no").collect()
    assert [(r.line_no, r.pair_id, r.side, r.text) for r in rows] == [(1, 1, "chosen", "one"), (3, 2, "chosen", "")]


def test_files_numbered_in_name_order(spark, tmp_path):
    d = str(tmp_path / "two")
    _write(d, "b.jsonl", '{"text": "b1"}\n')
    _write(d, "a.jsonl", '{"text": "a1"}\n{"text": "a2"}\n')
    rows = src.read_jsonl_corpus(spark, d).orderBy("line_no").collect()
    assert [r.text for r in rows] == ["a1", "a2", "b1"]


def test_id_list_rank_skips_blank_lines(spark, tmp_path):
    d = str(tmp_path / "ids")
    _write(d, "ids.txt", "7\n\n 3 extra\n9\n")
    rows = src.read_id_list(spark, d).orderBy("rank").collect()
    assert [(r.rank, r.latent) for r in rows] == [(1, 7), (2, 3), (3, 9)]


def test_contrast_scan_skips_short_rows(spark, tmp_path):
    d = str(tmp_path / "contrast")
    _write(d, "c.txt", "1\t0.5\t2\t1\n2\n3 -0.25\n")
    rows = src.read_contrast(spark, d).orderBy("latent").collect()
    assert [(r.latent, r.diff) for r in rows] == [(1, 0.5), (3, -0.25)]


def test_pair_scores_drop_placeholder(spark, tmp_path):
    d = str(tmp_path / "scores")
    _write(d, "s.txt", "0 0.0\n1 1.5\n2 -0.5\n")
    rows = src.read_pair_scores(spark, d).orderBy("pair_id").collect()
    assert [(r.pair_id, r.saescore) for r in rows] == [(1, 1.5), (2, -0.5)]


def test_ordered_lines_round_trip(spark):
    df = spark.range(0, 500).selectExpr("cast(499 - id as int) as latent", "cast(id + 1 as int) as rank")
    path = sink.scratch_path(spark, "ids-test")
    sink.write_ranked_ids(df.repartition(7), path)
    back = src.read_id_list(spark, path).orderBy("rank").collect()
    assert [r.latent for r in back] == list(range(499, -1, -1))


def test_preference_dataset_prefers_train_split(spark, tmp_path):
    d = str(tmp_path / "ds")
    spark.createDataFrame([(1, "a", "b")], "pair_id long, chosen string, rejected string").write.parquet(d + "/train")
    assert src.read_preference_dataset(spark, d).count() == 1


def _big(tmp_path):
    d = str(tmp_path / "big")
    own = [f'{{"text": "line {i:05d}"}}' for i in range(5000)]
    _write(d, "a.jsonl", "\n".join(own[:3000]) + "\n")
    _write(d, "b.jsonl", "\n".join(own[3000:]) + "\n")
    return d


SPLITS = {"spark.sql.files.maxPartitionBytes": ("4096", "1g"), "spark.sql.files.minPartitionNum": ("16", "4")}


@pytest.mark.parametrize("flip", [False, True])
@pytest.mark.parametrize("key", sorted(SPLITS))
def test_line_numbers_survive_a_change_of_splits(spark, tmp_path, key, flip):
    """Built under one split layout, run under another: all rows, right numbers."""
    before, after = reversed(SPLITS[key]) if flip else SPLITS[key]
    names = [key, "spark.sql.files.openCostInBytes"]
    old = {k: spark.conf.get(k, None) for k in names}
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        spark.conf.set(key, before)
        df = src.read_jsonl_corpus(spark, _big(tmp_path))
        spark.conf.set(key, after)
        rows = df.collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 5000
    assert all(r.text == f"line {r.line_no - 1:05d}" for r in rows)


def test_equal_names_in_subfolders_and_long_part_numbers(spark, tmp_path):
    for k in (1, 2):
        _write(str(tmp_path / "c" / f"k={k}"), "a.jsonl", f'{{"text": "{k}1"}}\n{{"text": "{k}2"}}\n')
    rows = src.read_jsonl_corpus(spark, str(tmp_path / "c")).orderBy("line_no").collect()
    assert [(r.line_no, r.text) for r in rows] == [(1, "11"), (2, "12"), (3, "21"), (4, "22")]
    for n in (99999, 100000):
        _write(str(tmp_path / "p"), f"part-{n:05d}-x.txt", f"{n}\n")
    assert [r.value for r in lines.numbered_lines(spark, str(tmp_path / "p")).orderBy("line_no").collect()] == ["99999", "100000"]


BAD_JSON = ["{'text': 'single'}", '{"text": "x"} trailing', '{"text": "x"}{"text": "y"}', '{"text": "x"},{"text": "y"}', '{"text": "x"}]',
            '{"text": "x"}}', '{"text": "x"}] }', '{"text": "x"}} {', '{text: "x"}', '{"text": "x"', "", "nothing", '{"text": "x"} // c', "[1]", '"text"', "[" * 100_000]
GOOD_JSON = [('{"text": "a\\u00e9\\n"}', "a\u00e9\n"), ('  {"text": "b", "more": [1, {"x": "}"}]} \u00a0', "b"), ('{"other": 1}', ""), ("{}", ""), ('{"text": null}', ""),
             ('{"text": {"a": [1, "é"]}}', '{"a":[1,"é"]}'), ('{"text": 7, "text": 8}', "8"), ('{"text": "\\ud800x"}', "?x")]


def test_json_lines_are_strict(spark, tmp_path):
    d = str(tmp_path / "strict")
    _write(d, "a.jsonl", "\n".join(BAD_JSON + [g for g, _ in GOOD_JSON]) + "\n")
    _write(d, "b.jsonl", '{"text": "fine"}\n')
    rows = src.read_jsonl_corpus(spark, d).orderBy("line_no").collect()
    n = len(BAD_JSON)
    assert [(r.line_no, r.text) for r in rows] == [(n + 1 + i, t) for i, (_, t) in enumerate(GOOD_JSON)] + [(n + len(GOOD_JSON) + 1, "fine")]
    report = {r.file.rsplit("/", 1)[1]: (r.n_lines, r.n_bad) for r in src.bad_lines(spark, d).collect()}
    assert report == {"a.jsonl": (n + len(GOOD_JSON), n), "b.jsonl": (1, 0)}


def test_single_file_layouts(spark, tmp_path):
    _write(str(tmp_path), "context.json", json.dumps({
        "total_latents": 2, "threshold": 0.5, "max_length": 128, "max_per_token": 10, "lines": 4,
        "latent_context_map": {"3": {"": [{"context": "a b", "activation": 1.5}, {"context": "c", "activation": 1}]}, "17": {"x": [{"context": "d", "activation": 2.0}]}}}, indent=2))
    path = str(tmp_path / "context.json")
    got = sorted(tuple(r) for r in src.read_context_map(spark, path).collect())
    assert got == [("17", "x", "d", 2.0), ("3", "", "a b", 1.5), ("3", "", "c", 1.0)]
    assert tuple(src.read_context_meta(spark, path).first()) == (2, 0.5, 128, 10, 4)
    _write(str(tmp_path), "interpret.json", json.dumps({
        "cost": 0.25, "engine": "gpt-4o", "features_scored": 1, "average_score": 4.0,
        "results": {"3": {"score": 4, "explanation": "why"}, "x": {"score": None, "explanation": "Invalid latent ID."}}}, indent=2))
    results, summary = src.read_interpretation(spark, str(tmp_path / "interpret.json"))
    assert sorted(map(tuple, results.collect())) == [("3", 4, "why"), ("x", None, "Invalid latent ID.")]
    assert tuple(summary.first()) == (0.25, "gpt-4o", 1, 4.0)


def test_variant_folders_are_named_as_in_the_original(spark, tmp_path):
    d = str(tmp_path / "out")
    df = spark.createDataFrame([("flip_5.00%", 1, "a"), ("remove_2.0%", 2, "b"), ("flip_5.00%", 3, "c")], "variant string, pair_id long, chosen string")
    sink.write_variants(df, d)
    sink.write_variants(df, d)  # a second write replaces the first
    assert sorted(os.listdir(d)) == ["flip_5.00%", "remove_2.0%"]
    assert [f for f in os.listdir(d) if f.startswith("_")] == []
    back = src.read_variants(spark, d, ["flip_5.00%", "remove_2.0%"])
    assert sorted((r.variant, r.pair_id, r.chosen) for r in back.collect()) == sorted(map(tuple, df.collect()))


def test_a_shared_folder_is_required_unless_local():
    assert session.is_local("local") and session.is_local("local[8]")
    assert not any(map(session.is_local, ("local-cluster[3,2,1024]", "yarn", "spark://h:7077", "k8s://x")))

    class Context:
        master, applicationId = "yarn", "none"
        def getCheckpointDir(self): return None
        def getConf(self): return {}

    class Conf:
        def get(self, key, default=None): return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
