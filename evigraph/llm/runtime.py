"""Session helpers of the training-data operators, beside the library's own."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import Scratch, fresh_path, listing, remove, shared_dir, written

__all__ = ["Scratch", "free_name", "fresh_path", "listing", "remove", "shared_dir", "table", "texts", "written"]
BATCH_BYTES = 1 << 20


def texts(df: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df for a pass over Arrow batches of whole texts, with the session's batches bounded by bytes.

    The default batch of 10,000 rows of text costs each task several times its
    size in buffers outside the heap; rows of numbers still come by thousands.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df bears it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
