"""Row validation of (feature, value, mode) triples (U4).

Returns the offending rows with the first violated rule instead of raising,
so a whole table is checked in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, latent_size: int, latent: str = "latent", value: str = "value",
               mode: str = "mode") -> DataFrame:
    rule = (F.when(~((F.col(latent) >= 0) & (F.col(latent) < latent_size)), F.lit("latent out of range"))
            .when(~(F.col(value) > 0), F.lit("value not above zero"))
            .when(~F.col(mode).isin(0, 1), F.lit("mode not 0 or 1")))
    return df.withColumn("violation", rule).filter(F.col("violation").isNotNull())
