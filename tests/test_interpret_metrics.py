import math

from pyspark.sql import functions as F

from pairlens.operators import chat
from pairlens.operators import evaluate as ev
from pairlens.operators import features as feat
from pairlens.operators import interpret as itp
from pairlens.plans import inputs


def test_parse_responses(spark):
    feats = spark.createDataFrame([("1",), ("2",), ("x",), ("3",)], "latent_key string")
    resp = spark.createDataFrame([(1, "score: 4 \nexplanation: a\nb"), (2, "Score: [4]\nExplanation: z")],
                                 "latent int, response string")
    rows = {r.latent_key: (r.score, r.explanation) for r in itp.interpretation_results(feats, resp).collect()}
    assert rows["1"] == (4, "a\nb")
    assert rows["2"] == (None, "Failed to parse response.")
    assert rows["x"] == (None, "Invalid latent ID.")
    assert rows["3"] == (None, "Error during processing.")


def test_cost(spark):
    resp = spark.createDataFrame([(1, 1000, 100)], "latent int, n_in int, n_out int")
    row = itp.request_costs(resp, inputs.prices(spark), "gpt-4o").first()
    assert math.isclose(row.cost, 0.0035)
    assert itp.request_costs(resp, inputs.prices(spark), "other").first().cost == 0.0


def test_accuracy_counts_ties_as_wrong(spark):
    r = spark.createDataFrame([(1, 2.0, 1.0), (2, 1.0, 1.0), (3, 0.0, 1.0)], "pair_id long, r_chosen double, r_rejected double")
    assert math.isclose(ev.preference_accuracy(r).first().accuracy, 1 / 3)


def test_loss_of_equal_rewards_is_ln2(spark):
    r = spark.createDataFrame([(1, 3.0, 3.0)], "pair_id long, r_chosen double, r_rejected double")
    assert math.isclose(ev.pairwise_loss(r).first().loss, math.log(2))


def test_unicode_blanks_in_responses(spark):
    feats = spark.createDataFrame([("1",), ("2",), ("3",), ("x",)], "latent_key string")
    resp = spark.createDataFrame([(1, "Score:\u00a04\u3000\nExplanation:\u2003it is so\u00a0\u3000"), (2, "so: SCORE: 2\n\nexplanation: a\nb\x1c"),
                                  (3, "Score: 6\nExplanation: no")], "latent int, response string")
    got = {r.latent_key: (r.score, r.explanation) for r in itp.interpretation_results(feats, resp).collect()}
    assert got == {"1": (4, "it is so"), "2": (2, "a\nb"), "3": (None, "Failed to parse response."), "x": (None, "Invalid latent ID.")}


def test_unicode_blanks_around_chat_messages(spark):
    df = spark.createDataFrame([(1, [("user", "\u3000\u00a0hi\x1f\n"), ("assistant", "a b")])], "id long, m array<struct<role: string, content: string>>")
    text = df.select(chat.render_messages(F.col("m")).alias("t")).first().t
    assert "\n\nhi<|eot_id|>" in text and "\n\na b<|eot_id|>" in text


def test_unscored_features_can_be_left_out(spark):
    ranked = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "rank int, latent int")
    results = spark.createDataFrame([(10, None), (11, 5), (12, 4)], "latent int, score int")
    ids = lambda **k: [r.latent for r in feat.safety_filter(ranked, results, 5, 9, **k).orderBy("rank").collect()]
    assert ids() == [10, 11] and ids(keep_unscored=False) == [11]
