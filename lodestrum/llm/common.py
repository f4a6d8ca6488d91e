"""What the text operators share: reading, shared-folder tables, words, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, as a Java character class body.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset in local mode (one machine, as in tests) a temporary
    folder is made and set; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lodestrum-")
        shared_dir.own = found
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: whatever executor is lost later, the rows are there.
    The folder can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    for paths in _noted:
        paths.append(path)
    return out


_noted: list[list[str]] = []


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables written meanwhile."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted.remove(paths)


def release(paths: list[str], docs: DataFrame) -> None:
    """Remove tables of a stage whose result has been written, but those that docs still reads."""
    read = " ".join(docs.inputFiles()) if paths else ""
    for path in paths:
        if path.rsplit("/", 1)[-1] not in read:
            _remove(docs.sparkSession, path)


def drop(df: DataFrame) -> None:
    """Remove a table() that no plan reads any more."""
    path = getattr(df, "shared_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs under names of our own (and those names), so that no name of theirs clashes with a working column."""
    names = [f"_own_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def words(text: Column) -> Column:
    """Words of a text between white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root) with the least node as root.

    Alternates large-star and small-star rounds, each written to the shared folder,
    until a round changes nothing. Every step is an aggregation with partial
    sums or an equi-join that adaptive execution can split; no pair of members
    of one component is ever made beyond the edges given. Nodes without an edge
    to another node have no row.
    """
    e = table(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        new = table(small, "edges")
        drop(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
