"""Intermediate tables in the folder that every executor sees."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Only where the session names none (tests on one machine) is one set.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = known.get() if known.isDefined() else None
    if not got:
        got = f"/tmp/checkpoints/tramline-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(got)
    return got


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tramline-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release, spark)
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`written` once all that was made of it is written too."""
    spark = df.sparkSession
    _delete(spark, df.written_path)
    _written.remove(df.written_path)
    # Shuffle files go once the driver has collected the plans that made them.
    spark.sparkContext._jvm.System.gc()


def _release(spark: SparkSession) -> None:
    try:
        for path in _written:
            _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder's owner cleans up
        return


def unused(name: str, taken: Iterable[str]) -> str:
    """``name`` or a variant of it that no column in ``taken`` bears."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name
