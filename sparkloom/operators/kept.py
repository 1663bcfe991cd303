"""Results that several steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: checkpointed where the session names a folder, else persisted (a lost part is computed again)."""
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def measured(df: DataFrame) -> DataFrame:
    """``df`` kept with its true size: as Parquet in the checkpoint folder, else persisted and counted.

    A checkpoint goes on with the estimate of its plan, where a join counts as the product of its sides: after a dozen steps that are joined
    with themselves the number alone has millions of digits, and the driver multiplies them for minutes.
    """
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        df = df.persist()
        df.count()
        return df
    path = f"{named.rstrip('/')}/measured-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
