"""What several operators of this subpackage share: inputs, shared folders, text keys and components."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="mvspark-")
        sc.setCheckpointDir(folder)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def importable(spark: SparkSession) -> None:
    """Lets Python workers that start from now on import this package, where driver and executors share the code's folder."""
    root = str(Path(__file__).resolve().parents[2])
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{have}" if have else root


#: Rows of an Arrow batch where texts go to Python: with Spark's own 10,000 a task would hold tens of MB of text several times over.
TEXT_BATCH = 1000


def text_batches(spark: SparkSession) -> None:
    """Makes Arrow batches smaller in this session, from now on, unless it has smaller ones already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def train_row(doc_id: Column) -> Column:
    """True for rows that models may learn from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Two columns, never null, that tell documents apart by id and text: _i and _th."""
    return [F.coalesce(id_col.cast("string"), F.lit("null")).alias("_i"), F.xxhash64(text).alias("_th")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (_row, _i, _th): all columns of docs in one struct, so that no name can clash, and the row's key."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row_key(F.col(id_col), F.col(text_col)))


#: Up to so many keys of rows are broadcast (16 bytes and the id each).
BROADCAST_KEYS = 500_000


def checked_broadcast(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """df, to be broadcast if it has at most that many rows; df should be stored, as it is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as edges (a, b) of longs: rows (node, root), root the smallest node.

    Alternates large-star and small-star steps until the edge set is a forest of stars. Each
    step is a map-side combined minimum and a join on the node, so a hub's edges are never one
    group: the adaptive planner can split them. Nodes without edges get no row.
    """
    shared_dir(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = small.where("a <> b").distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
