"""Encode throughput at the original pipeline's dimensions (probe, not a query).

Random dictionary (L x d) and random vectors; reports vectors/s and
vectors/s/core for the Arrow-batch encode (V2 + V3, top-k).

    python scripts/encode_throughput.py [n_vectors] [d] [L] [k] [cores]
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from pairlens.operators import vectors as vec  # noqa: E402
from pairlens.session import get_spark  # noqa: E402


def main() -> None:
    n, d, L, k, cores = (int(a) for a in (sys.argv[1:] + ["20000", "2048", "16384", "64", "8"][len(sys.argv) - 1:]))
    spark = get_spark(master=f"local[{cores}]")
    rand_vec = lambda seed: F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.randn(seed) + i * 0)
    lat = spark.range(L).select(F.col("id").cast("int").alias("latent"), rand_vec(1).alias("enc"),
                                rand_vec(2).alias("dec"), F.lit(0.0).alias("latent_bias"))
    pb = spark.range(1).select(F.array_repeat(F.lit(0.0), d).alias("pre_bias"))
    dictionary = vec.FeatureDictionary(lat.checkpoint(), pb)
    x = spark.range(n).repartition(cores * 4).select("id", rand_vec(3).alias("x")).checkpoint()
    t0 = time.perf_counter()
    vec.encode(x, dictionary, k, ["id"]).write.format("noop").mode("overwrite").save()
    t = time.perf_counter() - t0
    print(json.dumps({"n": n, "d": d, "L": L, "k": k, "cores": cores, "sec": round(t, 2),
                      "vectors_per_sec": round(n / t), "vectors_per_sec_per_core": round(n / t / cores)}))
    spark.stop()


if __name__ == "__main__":
    main()
