"""The streaming feature sums resume from their checkpoint and equal the batch sums."""

import math
import uuid

from pyspark.sql import functions as F

from pairlens.config import TEST
from pairlens.operators import features as feat
from pairlens.operators import vectors as vec
from pairlens.plans import inputs
from pairlens.streaming import feature_stream as fs

SF = "/root/testdata/sf0.001"


def test_stream_resumes_and_matches_batch(spark, tmp_path):
    docs = inputs.table(spark, SF, "documents")
    labels = inputs.table(spark, SF, "labels")
    d = inputs.test_dictionary(spark, SF, TEST.latent_size)
    src = str(tmp_path / "incoming")
    docs.filter(F.col("doc_id") % 2 == 0).coalesce(1).write.parquet(src + "/a")
    name = f"resume_{uuid.uuid4().hex[:8]}"

    q = fs.start_feature_sums(spark, src + "/a", labels, d, TEST, name)
    q.awaitTermination()
    first = {r.latent: r.v_chosen for r in fs.dense_sums(spark, name, TEST.latent_size).collect()}

    # new files arrive in the same folder; the restarted query only reads those
    docs.filter(F.col("doc_id") % 2 == 1).coalesce(1).write.mode("append").parquet(src + "/a")
    q = fs.start_feature_sums(spark, src + "/a", labels, d, TEST, name)
    q.awaitTermination()
    assert q.lastProgress is not None
    streamed = {r.latent: (r.v_chosen, r.v_rejected)
                for r in fs.dense_sums(spark, name, TEST.latent_size).collect()}

    batch_docs = fs.labelled_documents(docs, labels, 4)
    acts = fs.stream_activations(batch_docs, d, TEST)
    batch = {r.latent: (r.v_chosen, r.v_rejected)
             for r in feat.feature_sums(acts, TEST.latent_size).collect()}
    assert streamed.keys() == batch.keys()
    for k in batch:   # same sums; only the summation order differs (two micro-batches)
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(streamed[k], batch[k]))
    assert first != {k: v[0] for k, v in streamed.items()}
