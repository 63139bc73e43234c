"""What several operators share: the shared folder, and distributed connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary one serves a local master, whose
    executors are threads of the driver; on a cluster no machine's own folder will do, so that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="biblioflow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


_writing: ContextVar[list[str] | None] = ContextVar("writing", default=None)


def new_path(spark: SparkSession, suffix: str = "") -> str:
    """A path of its own in the shared folder, noted for written()."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}{suffix}"
    if (noted := _writing.get()) is not None:
        noted.append(path)
    return path


def table(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written() -> Iterator[list[str]]:
    """Lists what table() and new_path() name meanwhile (in this thread), for delete()."""
    token = _writing.set([])
    try:
        yield _writing.get()
    finally:
        _writing.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables whose readers have been written elsewhere."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever dots or back-quotes it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until df has no column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node of an undirected edge list, as (node, component).

    Alternating large-star and small-star steps: each step replaces the neighbours of a node by links to the
    smallest of them. Minima are pre-aggregated, no neighbour list is ever gathered, and each step is cut by
    checkpoint(). So are the minima, since Spark splits the hot key of a join (the hub of a giant component) only where both
    sides come straight from their shuffles. Self-loops and null ends are dropped, so isolated nodes are absent from the result.
    """
    shared_dir(edges.sparkSession)
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
        .checkpoint()
    )

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = digest(links)
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        links = small.distinct().checkpoint()
        after = digest(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
