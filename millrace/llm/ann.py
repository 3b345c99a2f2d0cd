"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors are scaled by the largest norm and lifted to the unit sphere, so that inner product orders as angle does. A
rotation learned on a bounded sample (principal directions, then iterative quantization) gives each a binary code, cut
into substrings of up to 16 bits; every substring has its index of buckets. Two codes within radius m * (r + 1) - 1
agree in one of m substrings up to r bits, so that probing all buckets within r bits in every index retrieves every
code within that radius; these are reranked by their floats. The radius grows until a vector as near as the k-th found
would lie beyond it with a probability of at most MISS.

Rows are indexed once, in shards of bounded size, each a row of a table in the shared folder: its buckets, codes and
floats. Queries travel in packed blocks, a copy of each to every shard, where they stream past the index; the rows
themselves are never copied. A stated query set thus meets all rows in blocks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import materialize
from millrace.llm.substring_dedup import _sent

SHARD_ROWS, QUERY_BLOCK = 8_192, 512
#: Rows that the rotation is fitted on, at most; all rows are indexed.
SAMPLE = 20_000
BITS, SUBSTRING = 64, 16
MISS = 0.2
SWEEPS, SEED = 30, 5

_ONES = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint32)).astype(np.uint8)


def learned_rotation(sample: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Columns that project lifted unit vectors to the numbers whose signs are the code's bits."""
    bits = min(bits, sample.shape[1])
    _, vectors = np.linalg.eigh(sample.T @ sample)
    basis = vectors[:, ::-1][:, :bits]
    data = sample @ basis
    turn, _ = np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, bits)))
    for _ in range(SWEEPS):
        u, _, vt = np.linalg.svd(np.sign(data @ turn).T @ data)
        turn = (u @ vt).T
    return basis @ turn


def lifted(rows: np.ndarray, largest: float) -> np.ndarray:
    scaled = rows / largest
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
    return np.column_stack((scaled, rest))


def substrings(rows: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The code of each row as one number per substring."""
    signs = rows @ rotation >= 0
    parts = range(0, signs.shape[1], SUBSTRING)
    return np.stack([signs[:, a : a + SUBSTRING] @ (1 << np.arange(min(SUBSTRING, signs.shape[1] - a))) for a in parts]).astype(np.int64)


def _whole(parts: np.ndarray) -> np.ndarray:
    """The substrings of up to 64 bits as one number."""
    code = np.zeros(parts.shape[1], np.uint64)
    for i, part in enumerate(parts):
        code |= part.astype(np.uint64) << np.uint64(SUBSTRING * i)
    return code


@cache
def _tails(bits: int) -> np.ndarray:
    """[angle step of 1000, radius]: the probability that more than radius of bits random planes part two vectors."""
    p = np.linspace(0, 1, 1001)[:, None]
    k = np.arange(bits + 1)[None, :]
    choose = np.array([math.comb(bits, i) for i in range(bits + 1)], float)
    mass = choose * p**k * (1 - p) ** (bits - k)
    return 1 - np.cumsum(mass, axis=1)


class MultiIndex:
    """The buckets of one shard, by substring, with the codes and floats of its rows."""

    def __init__(self, ids: list, rows: np.ndarray, rotation: np.ndarray, largest: float):
        self.ids, self.rows = ids, rows
        parts = substrings(lifted(rows, largest), rotation)
        self.codes = _whole(parts)
        self.tables = []
        for part in parts:
            order = np.argsort(part, kind="stable")
            values, first, count = np.unique(part[order], return_index=True, return_counts=True)
            self.tables.append((values, first, count, order.astype(np.int32)))
        self.ready()

    def ready(self) -> None:
        # rows by id: a query passes over those with its own key
        self.of: dict = {}
        for at, key in enumerate(self.ids):
            self.of.setdefault(key, []).append(at)
        self.short = self.rows.astype(np.float32)

    def dump(self) -> bytes:
        return pickle.dumps((self.ids, self.rows, self.codes, self.tables), 5)

    @classmethod
    def load(cls, payload: bytes) -> MultiIndex:
        found = cls.__new__(cls)
        found.ids, found.rows, found.codes, found.tables = pickle.loads(payload)
        found.ready()
        return found

    def within(self, far: list[np.ndarray], least: int, most: int) -> Iterator[np.ndarray]:
        """The rows in buckets that lie from least to most bits away, per substring."""
        for (_, first, count, order), away in zip(self.tables, far):
            at = np.flatnonzero((away >= least) & (away <= most))
            if len(at):
                size = count[at]
                yield order[np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def nearest(self, key: object, query: np.ndarray, parts: np.ndarray, k: int, bits: int, largest: float) -> tuple[list, np.ndarray]:
        """Ids and inner products of the k nearest found (all rows that may be, if fewer), ties to smaller ids.

        parts: the query's code by substring. All buckets within r bits are probed, r growing to what the k-th found
        asks for; rows whose code is beyond the radius that r guarantees wait for the next."""
        m = len(self.tables)
        norm = math.sqrt(query @ query)
        code, short = _whole(parts[:, None])[0], query.astype(np.float32)
        # single precision is off by less than this; what it can't decide is scored again below
        slack = 1e-5 * norm * largest
        far = [_ONES[values ^ c] for (values, *_), c in zip(self.tables, parts)]
        reached = np.zeros(len(self.ids), bool)
        reached[self.of.get(key, [])] = True  # the query's own row takes no part
        waiting, apart = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.float32)
        probed, r = -1, 1  # what has near copies is done at once; the others go on where chance alone would find k
        chance = int(np.argmax((1 - _tails(bits)[500]) * len(self.ids) >= k))
        while True:
            before = reached.copy()
            for rows in self.within(far, probed + 1, r):
                reached[rows] = True
            probed = r
            fresh = np.flatnonzero(reached & ~before)
            waiting = np.concatenate((waiting, fresh))
            apart = np.concatenate((apart, np.bitwise_count(self.codes[fresh] ^ code)))
            radius = m * (r + 1) - 1
            near = waiting[apart <= radius]
            waiting, apart = waiting[apart > radius], apart[apart > radius]
            found = np.concatenate((found, near))
            scores = np.concatenate((scores, self.short[near] @ short))
            if len(found) > k:
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= edge - slack
                found, scores = found[keep], scores[keep]
            if radius >= bits:
                break
            r = max(r + 1, -(-(chance + 1) // m) - 1)
            if len(found) >= k:
                worst = (float(np.partition(scores, len(scores) - k)[len(scores) - k]) - slack) / (largest * norm)
                step = math.ceil(1000 * math.acos(max(-1.0, min(1.0, worst))) / math.pi)
                enough = int(np.argmax(_tails(bits)[step] <= MISS))  # the radius that is enough for the k-th found
                if radius >= enough:
                    break
                r = max(r, -(-(enough + 1) // m) - 1)
        exact = (self.rows[found] * query).sum(axis=1)  # row by row: no result depends on a row's place
        best = sorted(zip((-exact).tolist(), (self.ids[i] for i in found)))[:k]
        return [key for _, key in best], np.array([-score for score, _ in best])


def valid(vectors: Column) -> Column:
    """Not null, without null and non-finite components, and not zero."""
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vectors.isNotNull() & ~bad & F.exists(vectors, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found nearest to each row of vectors that queries picks, by
    inner product in double precision, ties to the smaller key; all other rows, if there are fewer than k.

    A query meets every row but those with its own key. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without a key, nor vectors of another than the most frequent length (the
    shorter, if equally frequent). Repeated rows are candidates each. Of several rows with a query's key the one with
    the smallest vector asks. Rows of equal vectors can be nobody's k nearest, and are left out, beyond the k + 1
    smallest different keys and beyond k of each key. No queries, no rows."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"), queries.alias("asked")).where(F.col("id").isNotNull() & valid(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if lengths is None:
        return empty
    # both cuts are made where the rows are before anything is shuffled
    rows = rows.where(F.size("v") == lengths["n"]).withColumn("copy", F.row_number().over(Window.partitionBy("v", "id").orderBy(F.lit(1))))
    asked = materialize(rows.where(F.coalesce("asked", F.lit(False))).groupBy("id").agg(F.min("v").alias("v")), "asked")
    rows = rows.where(F.col("copy") <= k).withColumn("nth", F.dense_rank().over(Window.partitionBy("v").orderBy("id")))
    rows = materialize(rows.where(F.col("nth") <= k + 1).select("id", "v"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, largest = rows.agg(F.count("*"), F.max(square)).first()
    n_asked = asked.count()
    if not n_asked:
        return empty
    largest = math.sqrt(largest) * (1 + 1e-9)
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toPandas()["v"]
    rotation = learned_rotation(lifted(np.stack(sample.to_list()), largest))
    bits = rotation.shape[1]

    shards, blocks = -(-n // SHARD_ROWS), -(-n_asked // QUERY_BLOCK)
    shared = vectors.sparkSession.sparkContext.broadcast((rotation, largest))  # a row per dimension, whatever the data

    def pack(batches: Iterable[pa.RecordBatch], query: bool) -> Iterator[tuple]:
        turn, scale = shared.value
        held, ids, vs = None, [], []

        def packed() -> tuple:
            floats = np.stack(vs)
            if query:
                unit = floats / np.sqrt(np.einsum("ij,ij->i", floats, floats))[:, None]
                return held, pickle.dumps((ids, floats, substrings(np.column_stack((unit, np.zeros(len(ids)))), turn)), 5)
            return held, MultiIndex(ids, floats, turn, scale).dump()

        for batch in batches:
            for number, name, v in zip(*(c.to_pylist() for c in batch.columns)):
                if number != held and ids:
                    yield packed()
                    ids, vs = [], []
                held = number
                ids.append(name)
                vs.append(np.array(v))
        if ids:
            yield packed()

    schema = T.StructType().add("number", "long").add("payload", "binary")

    def packs(frame: DataFrame, count: int, query: bool) -> DataFrame:
        numbered = frame.select(F.pmod(F.xxhash64("id", "v"), F.lit(count)).alias("number"), "id", "v")
        dealt = numbered.repartitionByRange(count, "number").sortWithinPartitions("number", "id", "v")
        return dealt.mapInArrow(lambda batches: _sent(pack(batches, query), schema, 64), schema)

    index = materialize(packs(rows, shards, False), "index").select(F.col("number").alias("shard"), F.lit(-1).cast("long").alias("block"), "payload")
    blocked = materialize(packs(asked, blocks, True), "blocks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("number").alias("block"), "payload")
    out = T.StructType().add("query_id", vectors.schema[key].dataType).add("vec_id", vectors.schema[key].dataType).add("score", "double")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = shared.value[1]

        def answers() -> Iterator[tuple]:
            held, shard = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    number, block, payload = (c[i].as_py() for c in batch.columns)
                    if block < 0:
                        held, shard = MultiIndex.load(payload), number
                    elif shard == number:  # a shard without rows has no index
                        for name, query, parts in zip(*(lambda ids, floats, parts: (ids, floats, parts.T))(*pickle.loads(payload))):
                            for other, score in zip(*held.nearest(name, query, parts, k, bits, scale)):
                                yield name, other, float(score)

        return _sent(answers(), out, 8192)

    # a shard's index comes first, then the blocks stream past it
    dealt = index.unionByName(blocked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "block")
    found = dealt.mapInArrow(ask, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
