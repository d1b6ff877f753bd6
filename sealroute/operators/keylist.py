"""Reading the colon-separated key listing of the gpg program."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_FINGERPRINT = "Could not extract key fingerprint from public key"


def first_fingerprint(lines: DataFrame, key: str = "key_id") -> DataFrame:
    """Per key the tenth field of its first ``fpr:`` line that has one; ``error`` when none does."""
    fields = F.split("line", ":")
    found = F.when(F.col("line").startswith("fpr:"), F.nullif(F.get(fields, F.lit(9)), F.lit("")))
    return (
        lines.groupBy(key)
        .agg(F.min_by(found, F.when(found.isNotNull(), F.col("line_no"))).alias("fingerprint"))
        .withColumn("error", F.when(F.col("fingerprint").isNull(), NO_FINGERPRINT))
    )
