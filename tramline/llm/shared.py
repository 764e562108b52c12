"""What the operators share: written intermediate tables and key columns."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is one set.
    """
    bound_batches(spark)
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


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`written` once all that was made of it is written too."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.remove(df.written_path)
    # Shuffle files go once the driver has collected the plans that made them.
    spark.sparkContext._jvm.System.gc()


def _release(spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        for path in _written:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder's owner cleans up
        return


def text_key(text: str | Column, salt: int | None = None) -> Column:
    """Tells rows with one id but different texts apart; two salts make 128 bits."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.xxhash64(whole) if salt is None else F.xxhash64(F.lit(salt), whole)


#: The Python side holds a few Arrow batches at a time; long texts are counted by bytes.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches cut by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null ids: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fan(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, taken: Iterable[str]) -> str:
    """``name`` or a variant of it that no column in ``taken`` bears."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name
