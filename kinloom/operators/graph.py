"""Connected components of an edge table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
_written: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which the cluster's machines share. Where that is unset, a temporary folder, with a local master only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="kinloom-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        top = f"file://{_own_folder[0]}"
    path = f"{top.rstrip('/')}/kinloom-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def delete_scratch(spark: SparkSession) -> int:
    """Deletes what this process has written to scratch paths so far, once its results are no longer read. Returns how many paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    for path in _written:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    _written.clear()
    return n


def materialize(df: DataFrame) -> DataFrame:
    """df written to a shared path and read again: lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Nodes whose only edge goes to a smaller node take that node's component after
    the rounds, which see the other edges alone. Rounds alternate large-star and
    small-star steps until the edges are stars. Each step is a minimum by node,
    partially aggregated, and one join, so a node with very many edges is never
    gathered in one task. The number of rounds grows with the logarithm of a
    component's size. Null ends and loops are ignored, repeated edges count once.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    leaves = materialize(ends.where("n = 1 AND v < u").select("u", "v"))
    edges = materialize(edges.join(leaves.select("u"), "u", "left_anti"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    hubs = materialize(leaves.select(F.col("v").alias("node")).distinct().join(stars, "node", "left"))
    alone = hubs.where("component IS NULL").select("node", F.col("node").alias("component"))
    hung = leaves.join(hubs.select(F.col("node").alias("v"), F.coalesce("component", "node").alias("component")), "v").select(F.col("u").alias("node"), "component")
    return stars.unionByName(alone).unionByName(hung)
