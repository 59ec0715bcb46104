"""What the corpus operators share: reading, keys, and tables written to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators, so that it orders before every other id.
NULL_ID = -(2**63)

#: White space that all operators split words on or delete: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where the session names none and runs in
    one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="convoke-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what follows restarts from files, not from the shuffles before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/convoke/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() gave, once nothing reads them any more."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


_HELD: dict = {}


def held(key: object, make=lambda: None):
    """make()'s object, kept by a worker from task to task until another operator takes its memory."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


def keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc (doc_id, null first), rid (24 bits of the text's hash; tells rows with one doc_id apart) and the text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.xxhash64(text).bitwiseAND(0xFFFFFF).cast("int").alias("rid"),
        text.alias("text"),
        *more,
    )


def others(df: DataFrame, *new: str) -> tuple[Column, list[Column]]:
    """A struct ``others`` of all columns but text and those that new ones replace, and what takes them out of it again."""
    names = [c for c in df.columns if c != "text" and c.lower() not in new]
    return F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names)).alias("others"), [F.col(f"others.`{c}`") for c in names]
