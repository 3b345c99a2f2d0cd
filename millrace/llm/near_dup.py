"""N-gram Jaccard join: a MinHash LSH forest proposes, exact set overlap decides.

Texts with equal shingle sets form a class, and classes are joined. Each has a label in TREES prefix tries: FULL MinHash
values in a row. The labels of all tries are sorted, range by range over the cluster; in one pass over them every class
meets its neighbours, and the longest prefixes it shares there. Prefixes are then shortened as far as the target recall
asks for. Whole labels first: classes that share one fall into a group. At START values a class that shares several prefixes with
the largest group of their buckets joins it. All pairs within a group are verified exactly, which tells how similar linked
texts are; a pair of similarity s shares a prefix of d values in some trie with probability 1 - (1 - s^d)^TREES, so that
the links found give the links there are, and the longest prefix at which the target recall of them is reached. That
prefix is never longer than START, and never shorter than what a pair just at the threshold needs. Groups that share
one are candidates of each other, and verified as well.

Verification works in blocks: a block pair is one task's work whatever the size of the group, and only link counts and
a spanning forest come out of it, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import components, join_counted, materialize
from millrace.llm.substring_dedup import _mixed, _powers, _sent

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9997
#: Tries, the values of a label (a byte each), and those that prefixes are shortened to before any estimate.
TREES, FULL, START = 28, 12, 8
#: A class joins the largest group in its buckets if they share this many prefixes.
SHARED = 3
#: A group is cut into this many blocks, of these many classes.
BLOCKS, LEAST_BLOCK, BLOCK = 24, 32, 512
#: Links are counted by similarity in this many steps from the threshold to 1.
STEPS = 50
#: Bytes of a class.
ID = 16
#: The side of a block that is verified against itself.
SELF = -1

_BASE = 0x9E3779B97F4A7C15


def met(similarity: float, length: int, trees: int) -> float:
    """The probability that a pair shares a prefix of length values in some trie."""
    return 1 - (1 - similarity**length) ** trees


def depth(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix that a pair at the threshold shares with probability recall."""
    found = 1
    while met(threshold, found + 1, trees) >= recall:
        found += 1
    return found


def shortened(links: dict[int, int], threshold: float, trees: int, recall: float, start: int) -> int:
    """The longest prefix, up to start, at which the expected share of links met is recall.

    links: how many were met at start, by step of similarity; each stands for 1 / met() of them. One more link just at
    the threshold is always reckoned with, so that few links ask for what the worst one does."""
    least = depth(threshold, trees, recall)
    similar = {threshold + (1 - threshold) * step / STEPS: n for step, n in links.items()}
    there = {s: n / met(s, start, trees) for s, n in similar.items()}
    there[threshold] = there.get(threshold, 0) + 1
    length = start
    while length > least and sum(n * met(s, length, trees) for s, n in there.items()) < recall * sum(there.values()):
        length -= 1
    return length


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's runs of words words, ascending; a shorter text is one run; none if no word."""
    raw = (text or "").encode()
    data = np.frombuffer(raw + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    offset = np.arange(size.sum()) - np.repeat(first, size)
    value = (data[~blank].astype(np.uint64) + np.uint64(1)) * _powers(0x100000001B3, int(size.max()))[offset]
    each = _mixed(np.add.reduceat(value, first))
    n = min(words, len(each))
    runs = np.zeros(len(each) - n + 1, np.uint64)
    for k in range(n):
        runs = runs * np.uint64(_BASE) + each[k : len(each) - n + 1 + k]
    return np.unique(_mixed(runs + np.uint64(n)))


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return (rng.integers(0, 2**32, count, np.uint32) | np.uint32(1)), rng.integers(0, 2**32, count, np.uint32)


def labels(found: np.ndarray, trees: int, length: int) -> bytes:
    """One label per trie: its number, then a byte of each of its length MinHash values."""
    odd, flip = _factors(trees * length)
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(trees * length, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):  # what fits into a core's cache
        some = low[at : at + 256, None] ^ flip
        some *= odd
        np.minimum(least, some.min(axis=0), out=least)
    values = (_mixed(least.astype(np.uint64) + np.uint64(_BASE)) >> np.uint64(56)).astype(np.uint8).reshape(trees, length)
    return np.column_stack((np.arange(trees, dtype=np.uint8), values)).tobytes()


def set_id(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=ID).digest()


def _signed(docs: DataFrame, key: str, text: str, words: int, trees: int) -> DataFrame:
    """id, class (of its shingle set; null if there is none) and labels of every row."""
    schema = T.StructType().add("id", docs.schema[key].dataType).add("class", "binary").add("labels", "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    name, found = batch.column(0)[i].as_py(), shingles(batch.column(1)[i].as_py(), words)
                    yield (name, set_id(found), labels(found, trees, FULL)) if len(found) else (name, None, None)

        yield from _sent(rows(), schema)

    return docs.select(key, text).mapInArrow(run, schema)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A column of byte strings of one length as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def _bytes(rows: np.ndarray) -> pa.Array:
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return fixed.cast(pa.binary())


def _forest(classes: DataFrame, trees: int, least: int) -> DataFrame:
    """class, label, shared, lead of the places in the tries where a class shares least values or more with a neighbour:
    shared is the longest prefix; lead, where the whole label is shared, the first class of those in its range.

    A range of the sorted labels is read once, as a stream. What the first and the last class of a range share with
    those beyond is not known: they are given with shared = FULL; and rows with shared = 0 lead the first class of the
    first and of the last label to a node named by the label, where ranges that part a label meet."""
    width = FULL + 1
    places = classes.select("class", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "labels")
    places = places.select(F.expr(f"substring(labels, tree * {width} + 1, {width})").alias("label"), "class")
    schema = T.StructType().add("class", "binary").add("label", "binary").add("shared", "integer").add("lead", "binary")
    arrow = pa.schema([("class", pa.binary()), ("label", pa.binary()), ("shared", pa.int32()), ("lead", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row is held back until what follows it is known
        label, name = np.zeros((0, width), np.uint8), np.zeros((0, ID), np.uint8)
        before, leader, first = 0, None, True

        def meeting(at: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lead.tobytes()], pa.binary()), pa.array([at.tobytes()], pa.binary()), pa.array([0], pa.int32()), pa.array([b"label" + at.tobytes()], pa.binary())], schema=arrow)

        def part(lab: np.ndarray, own: np.ndarray, prev: np.ndarray, after: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
            shared = np.maximum(prev, after) - 1  # the first byte is the trie's number
            keep = np.flatnonzero(shared >= least)
            led = (prev[keep] == width) & (lead[keep] != own[keep]).any(axis=1)
            arrays = [_bytes(own[keep]), _bytes(lab[keep]), pa.array(shared[keep].astype(np.int32)), pa.array([x.tobytes() if y else None for x, y in zip(lead[keep], led)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.concatenate((label, _fixed(batch.column(0), width)))
            name = np.concatenate((name, _fixed(batch.column(1), ID)))
            # how many bytes each row shares with the one before it
            same = np.cumprod(label[1:] == label[:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            prev = np.concatenate(([width if first else before], same))
            starts = prev < width
            starts[0] = first or before < width
            place = np.maximum.accumulate(np.where(starts, np.arange(len(label)), -1))
            lead = np.where((place >= 0)[:, None], name[np.maximum(place, 0)], leader if leader is not None else name[:1])
            if first:
                yield meeting(label[0], name[0])
            first = False
            yield part(label[:-1], name[:-1], prev[:-1], prev[1:], lead[:-1])
            label, name, before, leader = label[-1:], name[-1:], prev[-1], lead[-1]
        if len(label):
            yield meeting(label[0], leader)
            yield part(label, name, np.array([before]), np.array([width]), leader[None, :])

    ranged = places.repartitionByRange("label", "class").sortWithinPartitions("label", "class")
    return ranged.mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """class and set (its shingles' hashes) of every row of wanted (id, class), read from the document with that id."""
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("id_key", F.coalesce(F.col("id").cast("string"), F.lit("-null")))
    ids = wanted.select(F.coalesce(F.col("id").cast("string"), F.lit("-null")).alias("id_key"), F.col("class").alias("wanted"))
    schema = T.StructType().add("class", "binary").add("set", "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    found = shingles(batch.column(0)[i].as_py(), words)
                    if set_id(found) == (name := batch.column(1)[i].as_py()):
                        yield name, found.tobytes()

        yield from _sent(rows(), schema)

    found = join_counted(named, ids, ["id_key"]).select("text", "wanted").mapInArrow(run, schema)
    return found.dropDuplicates(["class"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    sizes = [len(s) for s in sets]
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[where]
    pick = shared[where]
    owner, column = owner[pick], column[pick]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((n, n), np.float64)
    width = max(64, 4_000_000 // n)
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (at, at + width))
        dense = np.zeros((n, width), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        total += dense @ dense.T
    total[np.arange(n), np.arange(n)] = sizes
    return total


def _verified(units: DataFrame, threshold: float) -> DataFrame:
    """units (unit, side, class, docs, set): class a has links more documents, or is joined to b; or, without a class,
    links pairs of classes are of similarity step."""
    schema = T.StructType().add("a", "binary").add("b", "binary").add("step", "integer").add("links", "long")

    def decide(rows: list[tuple]) -> Iterator[tuple]:
        names, docs = [r[2] for r in rows], np.array([r[3] for r in rows], np.int64)
        side = np.array([r[1] for r in rows])
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        both = _overlaps(sets)
        union = sizes[:, None] + sizes[None, :] - both
        linked = both >= threshold * union - 1e-9
        # of two sides only pairs across count
        linked &= ~np.eye(len(rows), dtype=bool) if side[0] == SELF else side[:, None] != side[None, :]
        pairs = np.triu(linked)
        steps = np.floor((both[pairs] / union[pairs] - threshold) / (1 - threshold) * STEPS) if threshold < 1 else np.zeros(int(pairs.sum()))
        for step, n in zip(*np.unique(np.clip(steps, 0, STEPS - 1).astype(int), return_counts=True)):
            yield None, None, int(step), int(n)
        more = linked @ docs
        for i in np.flatnonzero(more):
            yield names[i], None, None, int(more[i])
        seen = np.zeros(len(rows), bool)
        for root in range(len(rows)):
            if not seen[root]:
                seen[root], todo = True, [root]
                while todo:
                    at = todo.pop()
                    for to in np.flatnonzero(linked[at] & ~seen):
                        seen[to] = True
                        todo.append(to)
                        yield names[at], names[to], None, 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and row[0] != held[0][0]:
                        yield from decide(held)
                        held = []
                    held.append(row)
            if held:
                yield from decide(held)

        yield from _sent(rows(), schema)

    dealt = units.select("unit", "side", "class", "docs", "set").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, schema)


def _blocks(count: Column) -> Column:
    """How many blocks a side of count classes is cut into."""
    size = F.least(F.greatest(F.ceil(count / BLOCKS), F.lit(LEAST_BLOCK)), F.lit(BLOCK))
    return F.ceil(count / size).cast("long")


def _block(count: Column) -> Column:
    return F.pmod(F.xxhash64("class"), _blocks(count))


def _upto(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), _blocks(count) - 1)


def _within(member: DataFrame, sizes: DataFrame) -> DataFrame:
    """Units of work: each two blocks of a group, and each block with itself."""
    b, o = F.col("b"), F.col("o")
    inner = join_counted(member, sizes.where("n > 1"), ["group"]).withColumn("b", _block(F.col("n"))).select("group", "class", "docs", "b", F.explode(_upto(F.col("n"))).alias("o"))
    return inner.select(F.xxhash64("group", F.lit("in"), F.least("b", "o"), F.greatest("b", "o")).alias("unit"), F.when(b == o, F.lit(SELF)).otherwise(b).alias("side"), "class", "docs")


def _across(member: DataFrame, sizes: DataFrame, spots: DataFrame) -> DataFrame:
    """Units of work: a block of a group against a block of all classes of smaller groups that share a bucket with it."""
    pairs = spots.join(spots.withColumnRenamed("group", "other"), "prefix").where("group < other").select("group", "other").distinct()
    pairs = join_counted(pairs, sizes, ["group"])
    pairs = join_counted(pairs, sizes.select(F.col("group").alias("other"), F.col("n").alias("m")), ["other"])
    first = F.col("n") >= F.col("m")
    pairs = pairs.select(F.when(first, F.col("group")).otherwise(F.col("other")).alias("owner"), F.when(first, F.col("other")).otherwise(F.col("group")).alias("group"))
    outer = materialize(join_counted(pairs, member.select("group", "class", "docs"), ["group"]).select("owner", "class", "docs"), "outer")
    guests = outer.groupBy("owner").agg(F.count("*").alias("m"))
    guests = materialize(join_counted(guests, sizes.select(F.col("group").alias("owner"), "n"), ["owner"]), "guests")
    hosts = join_counted(member.select(F.col("group").alias("owner"), "class", "docs"), guests, ["owner"])
    hosts = hosts.withColumn("b", _block(F.col("n"))).select("owner", "class", "docs", "b", F.explode(_upto(F.col("m"))).alias("o"))
    outer = join_counted(outer, guests, ["owner"])
    outer = outer.withColumn("b", _block(F.col("m"))).select("owner", "class", "docs", "b", F.explode(_upto(F.col("n"))).alias("o"))
    host = hosts.select(F.xxhash64("owner", F.lit("out"), "b", "o").alias("unit"), F.lit(0).cast("long").alias("side"), "class", "docs")
    guest = outer.select(F.xxhash64("owner", F.lit("out"), "o", "b").alias("unit"), F.lit(1).cast("long").alias("side"), "class", "docs")
    return host.unionByName(guest)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """One row per row of docs: key, class_id (the smallest key among all documents it is linked to, directly or over
    others), n_links (documents whose shingle set has a Jaccard similarity of threshold or more, copies included) and
    copy_id (the smallest key with an equal shingle set).

    Words are those between blanks, unchanged; a text of fewer words than a shingle is one shingle. Null and empty
    texts, which have none, are linked to nothing. Repeated rows are copies of each other. A null key is a document;
    a class of only null keys has a null id. The share of links that is found is recall, as expected from the
    links' own similarities; where there are few, every link is found with probability recall or more. Other columns are not read; an empty table gives no rows."""
    least = depth(threshold, trees, recall)
    start = max(START, least)
    signed = materialize(_signed(docs, key, text, words, trees), "signatures")
    classes = signed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("docs"), F.first("labels").alias("labels"))
    classes = materialize(classes, "classes")
    forest = materialize(_forest(classes, trees, min(least, FULL)), "forest")

    def buckets(length: int) -> DataFrame:
        return forest.where(F.col("shared") >= min(length, FULL)).select("class", F.xxhash64(F.substring("label", 1, length + 1)).alias("prefix"))

    # whole labels; then prefixes of START values
    groups = components(forest.where(F.col("lead").isNotNull()).select(F.col("class").alias("a"), F.col("lead").alias("b")))
    member = forest.where("shared > 0").select("class").distinct()
    member = join_counted(member, groups.select(F.col("node").alias("class"), F.col("root").alias("group")), ["class"], "left")
    member = materialize(member.select("class", F.coalesce("group", "class").alias("group")), "members")
    spots = materialize(join_counted(buckets(start), member, ["class"]), "spots")
    size = join_counted(spots, member.groupBy("group").agg(F.count("*").alias("n")), ["group"])
    largest = size.groupBy("prefix").agg(F.max(F.struct("n", "group"))["group"].alias("to"))
    near = spots.join(largest, "prefix").where("group <> to").groupBy("class", "group", "to").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    merged = components(near.select(F.col("group").alias("a"), F.col("to").alias("b")))
    member = join_counted(member, merged.withColumnRenamed("node", "group"), ["group"], "left").select("class", F.coalesce("root", "group").alias("group"))
    member = materialize(join_counted(classes.select("class", "id", "docs"), member, ["class"]), "groups")
    sizes = materialize(member.groupBy("group").agg(F.count("*").alias("n")), "sizes")

    sets = materialize(_sets(docs, member.select("id", "class"), key, text, words), "sets")
    inner = materialize(_verified(_within(member, sizes).join(sets, "class"), threshold), "verified")
    links = {r["step"]: r["n"] for r in inner.where("step is not null").groupBy("step").agg(F.sum("links").alias("n")).collect()}
    length = shortened(links, threshold, trees, recall, start)
    spots = materialize(join_counted(buckets(length), member.select("class", "group"), ["class"]).select("prefix", "group").distinct(), "spots")
    outer = materialize(_verified(_across(member, sizes, spots).join(sets, "class"), threshold), "verified")
    found = inner.unionByName(outer).where("a is not null")

    roots = components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "class")
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    named = materialize(join_counted(classes.select("class", "id"), roots, ["class"]), "named")
    named = join_counted(named, materialize(named.groupBy("root").agg(F.min("id").alias("class_id")), "tops"), ["root"]).select("class", "class_id")
    table = classes.select("class", F.col("id").alias("copy_id"), "docs").join(links, "class", "left").join(named, "class", "left")
    table = table.where("docs > 1 or links is not null")
    table = materialize(table.select("class", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "table")
    # a class that no set has keeps texts without one off the join's null key
    out = join_counted(signed.select("id", F.coalesce("class", F.lit(b"-")).alias("class")), table, ["class"], "left")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copy_id", "id").alias("copy_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that are linked, directly or over others, to one of a smaller doc_id; columns
    unchanged. A doc_id names a document: rows that repeat one stay or go together. Rows without a doc_id stay."""
    found = near_duplicates(docs).select("doc_id", "class_id", "n_links")
    gone = materialize(found.where("n_links > 0 and doc_id <> class_id").select("doc_id").distinct(), "gone")
    return join_counted(docs, gone, ["doc_id"], "left_anti")
