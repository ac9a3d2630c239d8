"""What the operators of this subpackage have in common: the shared folder, Arrow mapping, content keys.

Nothing here collects rows. Lineage is cut by writing Parquet into the folder that the cluster
names in ``spark.checkpoint.dir``, so a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlark.session import ship, spread

#: A word: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees. A local master may fall back on a temporary folder;
    a cluster without ``spark.checkpoint.dir`` falls back on its warehouse, which is shared too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"file://{tempfile.gettempdir()}/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loomlark"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_folder(spark)}/loomlark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a written table that is read no more, and let the driver drop the shuffle files of queries that are gone."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)
    jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Ship this package, and keep Arrow batches of the session small where they are larger, as very long texts must not meet in one
    batch of 10,000 rows. The plans that follow are executed by the caller, so the session keeps these bounds."""
    ship(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        held = spark.conf.get(name)
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
