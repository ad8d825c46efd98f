"""What several operators share: a folder all executors see, written stages, and SQL pieces."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words; everything else, whatever the script, is part of one.
WORD = r"[^\x20\x09-\x0D]+"
_fresh = count()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of this machine only where the session names none and its
    executors are threads of the driver.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="stages-")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the written table, cutting its lineage.

    Spark commits each task's file once, so later reads see one consistent result even where a lost
    executor made tasks run again. The folder goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # this write is its plan's only run: its shuffle files can go when it ends
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_at_work: list[tuple[str, Callable[[], None]]] = []


def alone(owner: str, forget: Callable[[], None]) -> None:
    """Called where an operator's task begins: a Python worker serves tasks of many operators, one after another, and only the memo
    of the one at work stays. forget empties this one's memo when another's turn comes.
    """
    if _at_work and _at_work[0][0] == owner:
        return
    if _at_work:
        _at_work.pop()[1]()
        pa.default_memory_pool().release_unused()
    _at_work.append((owner, forget))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambda variables are bound, attributes would be inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def spare(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    return next(x for i in _fresh if (x := f"__{stem}_{i}") not in taken)


def hashed_sample(docs: DataFrame, most: int) -> DataFrame:
    """About `most` distinct rows, chosen by a hash of all their columns: reruns agree, and no partition sends more than its
    share. Equal rows count once.
    """
    n = docs.count()
    share = F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, most / max(n, 1))))
    return docs.filter(share).dropDuplicates()
