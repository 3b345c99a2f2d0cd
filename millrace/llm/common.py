"""Helpers that the operators share: shared-folder tables, size-checked joins and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A side is broadcast only after measuring it, and only up to this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
#: Edges of components that one task unites.
LOCAL_EDGES = 1_000_000

#: The separators of a word: space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder. A temporary one only on
    a local master, as in tests; on a cluster without either this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written since each of the open temporaries() began.
_written: list[list[str]] = []


def _folder(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the enclosing temporaries() end, else when the session's JVM does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = _folder(spark, path)
    files.deleteOnExit(target)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what materialize() writes within, at the end. What is to stay is taken off the list of folders."""
    held: list[str] = []
    _written.append(held)
    try:
        yield held
    finally:
        _written.remove(held)
        for path in held:
            files, target = _folder(spark, path)
            files.delete(target, True)


def _bytes_of(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        inner = field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else None
        if isinstance(inner, T.NumericType):
            return 16 + 8 * F.greatest(F.size(column), F.lit(0)).cast("long")
        return 16 + F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)).cast("long")
    if isinstance(field.dataType, T.StructType):
        return 16 + F.coalesce(F.length(F.to_json(column)), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df may be broadcast: up to most rows and BROADCAST_BYTES. It should be cheap to read."""
    size = F.lit(0).cast("long")
    for field in df.schema:
        size = size + _bytes_of(field)
    rows, total = df.select(size.alias("n")).limit(most + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows <= most and total <= BROADCAST_BYTES


def join_counted(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a side that is usually small: broadcast after measuring it, else a shuffled join.

    small should be cheap to read (a materialized table)."""
    return big.join(F.broadcast(small) if is_small(small, most) else small, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _united(edges: DataFrame) -> DataFrame:
    """The components of a bounded number of edges, in one task."""
    schema = T.StructType().add("node", edges.schema["a"].dataType).add("root", edges.schema["a"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def end_of(node: object) -> object:
            while (to := up.setdefault(node, node)) != node:
                up[node] = up[to]  # halve the way for later ones
                node = to
            return node

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = end_of(a), end_of(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        for at in range(0, len(nodes), 65_536):
            some = nodes[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(some, arrow[0].type), pa.array([end_of(n) for n in some], arrow[1].type)], schema=arrow)

    return edges.select("a", "b").coalesce(1).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), as (node, root) with root the smallest id; nodes without an edge are absent.

    Up to LOCAL_EDGES different edges are one task's work. Beyond, in rounds: each round points a node to its smallest neighbour, follows these pointers to their ends by doubling, and contracts
    every tree of pointers to its end, until no edge is left. Two rounds at least halve the nodes that still have
    edges: an end that stays has, alone, a node that the first of them took away. So rounds, and doublings in a round,
    grow with the logarithm of a component's size whatever the order of ids. Edges and labels stay distributed; each
    step is written to the shared folder."""
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = both = materialize(both, "edges")
    if both.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return materialize(_united(both), "labels")
    rounds = []
    while not both.isEmpty():
        # b points down to its smallest neighbour; a node with only larger neighbours is an end
        down = materialize(both.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "at"), "down")
        while True:
            further = down.select(F.col("at").alias("to"), F.col("to").alias("next"))
            if join_counted(down, further, ["to"], "left_semi").isEmpty():
                break
            down = materialize(join_counted(down, further, ["to"], "left").select("at", F.coalesce("next", "to").alias("to")), "down")
        rounds.append(down)
        moved = join_counted(both, down.select(F.col("at").alias("b"), F.col("to").alias("to_b")), ["b"], "left")
        moved = join_counted(moved, down.select(F.col("at").alias("a"), F.col("to").alias("to_a")), ["a"], "left")
        moved = moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        both = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = materialize(both, "edges")
    labels = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for down in rounds:
        labels = join_counted(labels, down.select(F.col("at").alias("root"), "to"), ["root"], "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(labels, "labels")
