"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

The lengths double up to the wanted one (9, 18, 35 for 35). Below it a window is represented by its anchor, the
smallest hash among its runs of the level's length: equal windows have equal anchors, so a window whose anchor stands
nowhere else is out, and far fewer anchors than windows are counted. At the wanted length the windows themselves are
counted, by 128 bits: what 64 bits leave in by chance on the way goes there. Documents that lose their last candidate are finished and leave; the rest go on to the next level.

Documents travel in chunks, rows of a table in the shared folder. A chunk sends each of its hashes once, in blocks by
hash range, with a mark on those that it holds twice; the counting task of a range answers with one bit per hash. A
hash that stands everywhere thus costs one entry a chunk, and no group of equal windows meets in one place.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import materialize

#: A chunk ends after this many bytes of text; a longer text is a chunk of its own.
CHUNK_BYTES = 2_000_000
#: Hashes that a counting task should get.
RANGE_HASHES = 250_000
#: Answers are broadcast up to this many bytes, joined by a shuffle beyond.
BROADCAST_BYTES = 32_000_000
FIRST_LENGTH = 8

_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least n of them."""
    held = _tables.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(1024, 1 << (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        held = _tables[base] = np.cumprod(steps, dtype=np.uint64)
    return held


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def levels(length: int) -> list[int]:
    """The wanted length, halved (rounding up) while it is FIRST_LENGTH or more, in ascending order."""
    found = [length]
    while (found[0] + 1) // 2 >= FIRST_LENGTH:
        found.insert(0, (found[0] + 1) // 2)
    return found


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of over every run of width values, in logarithmically many passes."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[:-step], x[step:])
        done += step
    return x


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, ascending; which of them each row is; whether it stands more than once."""
    if rows.shape[1] == 1:
        found, where, count = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
        return found[:, None], where, count > 1
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.concatenate((np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(axis=1)))
    where = np.empty(len(rows), np.int64)
    where[order] = np.cumsum(new) - 1
    return rows[new], where, np.bincount(where, minlength=int(new.sum())) > 1


class Chunk:
    """Documents of a chunk: ids, UTF-8 texts, and which window starts are candidates still."""

    def __init__(self, ids: list, texts: list[bytes], live: np.ndarray | None = None):
        self.ids, self.texts, self.live = ids, texts, live

    @classmethod
    def load(cls, payload: bytes) -> Chunk:
        ids, texts, live, n = pickle.loads(zlib.decompress(payload))
        return cls(ids, texts, None if live is None else np.unpackbits(live, count=n).astype(bool))

    def dump(self) -> bytes:
        live = None if self.live is None else np.packbits(self.live)
        return zlib.compress(pickle.dumps((self.ids, self.texts, live, 0 if self.live is None else len(self.live)), 5), 1)

    def read(self) -> None:
        """Word hashes, and the document and the words before it, of every word."""
        raw = np.frombuffer(b"\n".join(self.texts) + b"\n", np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        size = end - start
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        value = (raw[~blank].astype(np.uint64) + np.uint64(1)) * _powers(0x100000001B3, int(size.max(initial=1)))[offset]
        first = np.cumsum(size) - size
        self.words = _mixed(np.add.reduceat(value, first) if len(first) else np.zeros(0, np.uint64))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in self.texts), np.int64, len(self.texts)))
        self.doc = np.searchsorted(ends, start, side="right")
        self.bounds = np.searchsorted(start, np.concatenate(([0], ends)))

    def runs(self, length: int, base: int = _BASE) -> np.ndarray:
        """The hash of the length words from each word on, also across documents; none that run over the end."""
        n = len(self.words)
        if n < length:
            return np.zeros(0, np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * _powers(base, n)[:n], dtype=np.uint64)))
        return _mixed((sums[length:] - sums[:-length]) * _powers(pow(base, -1, 2**64), n)[: n - length + 1])

    def hashes(self, length: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The level's distinct hashes of candidate windows, a row each, ascending; which row each window has; whether a
        row's hash stands here twice. Rows are of one number, at the wanted length of two."""
        runs = self.runs(level)
        whole = len(self.words) - length + 1
        if whole <= 0:
            self.live = np.zeros(0, bool)
            return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        if self.live is None:
            self.live = self.doc[:whole] == self.doc[length - 1 :]
        if level == length:
            return distinct_rows(np.column_stack((runs[self.live], self.runs(level, _SECOND)[self.live])))
        width = length - level + 1
        anchor = _sliding(runs, width, np.minimum)
        # a run is an anchor if it is the smallest of some candidate window: the largest of those windows' anchors
        held = np.where(self.live, anchor, np.uint64(0))
        pad = np.zeros(width - 1, np.uint64)
        at = runs[_sliding(np.concatenate((pad, held, pad)), width, np.maximum) == runs]
        distinct, count = np.unique(at, return_counts=True)
        mine = anchor[self.live]
        # the hash 0 and anchors equal to one outside the candidates only add marks, never lose one
        missing = ~np.isin(mine, distinct)
        if missing.any():
            distinct, count = np.unique(np.concatenate((at, mine[missing])), return_counts=True)
        return distinct[:, None], np.searchsorted(distinct, mine), count > 1

    def keep(self, length: int, repeated: np.ndarray) -> Iterator[tuple]:
        """Take the answer for the candidate windows in; yield and drop the documents without any: id, words, 0, hash."""
        self.live[np.flatnonzero(self.live)[~repeated]] = False
        per_doc = np.bincount(self.doc[np.flatnonzero(self.live)], minlength=len(self.ids))
        parts, whole = [], len(self.live)
        ids, texts = [], []
        for i, (key, text) in enumerate(zip(self.ids, self.texts)):
            if per_doc[i]:
                ids.append(key)
                texts.append(text)
                a, b = self.bounds[i], self.bounds[i + 1]
                own = np.zeros(b - a, bool)
                own[: max(0, min(b, whole) - a)] = self.live[a : min(b, whole)]
                parts.append(own)
            else:
                yield finished(key, text)
        live = np.concatenate(parts) if parts else np.zeros(0, bool)
        self.ids, self.texts, self.live = ids, texts, live[: max(0, len(live) - length + 1)]

    def results(self, length: int, repeated: np.ndarray) -> Iterator[tuple]:
        """The result of every document: id, words, removed words, hash of the kept ones."""
        self.live[np.flatnonzero(self.live)[~repeated]] = False
        step = np.zeros(len(self.words) + 1, np.int64)
        at = np.flatnonzero(self.live)
        step[at] += 1
        step[at + length] -= 1
        kept = np.cumsum(step)[:-1] == 0
        for i, (key, text) in enumerate(zip(self.ids, self.texts)):
            own = kept[self.bounds[i] : self.bounds[i + 1]]
            words = text.split()
            yield key, len(words), int(len(own) - own.sum()), hashlib.sha256(b" ".join(compress(words, own.tolist()))).hexdigest()


def finished(key: object, text: bytes) -> tuple:
    words = text.split()  # of bytes: exactly the separators of a word
    return key, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()


def _schema(key: T.DataType) -> T.StructType:
    return T.StructType().add("id", key).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("chunk", "long").add("windows", "long").add("payload", "binary")


def _sent(rows: Iterator[tuple], schema: T.StructType, most: int = 512) -> Iterator[pa.RecordBatch]:
    arrow, held, weight = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        weight += 1 if row[-1] is None or not isinstance(row[-1], bytes) else 1 + len(row[-1]) // 20_000
        if weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


def _chunked(docs: DataFrame, length: int, schema: T.StructType) -> DataFrame:
    """Documents of fewer than length words are finished; the others are put into chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            ids, texts, size, number = [], [], 0, place
            for batch in batches:
                for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = (text or "").encode()
                    if len(raw) < 2 * length - 1 or len(raw.split()) < length:
                        yield *finished(key, raw), None, None, None
                        continue
                    ids.append(key)
                    texts.append(raw)
                    size += len(raw)
                    if size >= CHUNK_BYTES:
                        yield None, None, None, None, number, size // 4, Chunk(ids, texts).dump()
                        ids, texts, size, number = [], [], 0, number + 1
            if ids:
                yield None, None, None, None, number, size // 4, Chunk(ids, texts).dump()

        yield from _sent(rows(), schema)

    return docs.mapInArrow(run, schema)


def _counted(chunks: DataFrame, length: int, level: int, bits: int) -> DataFrame:
    """chunk, parts (range number and bit per hash, packed) of every chunk."""
    up = T.StructType().add("range", "long").add("chunk", "long").add("twice", "binary").add("hashes", "binary")

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for number, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload")):
                    chunk = Chunk.load(payload.as_py())
                    chunk.read()
                    distinct, _, twice = chunk.hashes(length, level)
                    of = _ranges(distinct, bits)
                    cuts = np.flatnonzero(np.diff(of)) + 1
                    for a, b in zip([0, *cuts], [*cuts, len(distinct)]):
                        if b > a:
                            yield int(of[a]), number, np.packbits(twice[a:b]).tobytes(), distinct[a:b].tobytes()

        yield from _sent(rows(), up)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64).reshape(-1, 2 if level == length else 1) for x in group["hashes"]]
        weight = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(s)) + 1 for t, s in zip(group["twice"], sets)])
        _, where, _ = distinct_rows(np.concatenate(sets))
        repeated = (np.bincount(where, weight) > 1)[where]
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        return pd.DataFrame({"chunk": group["chunk"], "range": group["range"], "bits": [np.packbits(x).tobytes() for x in np.split(repeated, cuts)]})

    sent = chunks.select("chunk", "payload").mapInArrow(send, up)
    back = sent.groupBy("range").applyInPandas(count, "chunk long, range long, bits binary")
    return back.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("range", "bits"))).alias("parts"))


def _ranges(distinct: np.ndarray, bits: int) -> np.ndarray:
    return distinct[:, 0] >> np.uint64(64 - bits) if bits else np.zeros(len(distinct), np.uint64)


def _answered(distinct: np.ndarray, bits: int, parts: list[dict]) -> np.ndarray:
    """Whether each distinct hash of a chunk is repeated."""
    of = _ranges(distinct, bits)
    numbers, sizes = np.unique(of, return_counts=True)
    if [p["range"] for p in parts] != numbers.tolist():
        raise ValueError("an answer is missing")
    return np.concatenate([np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=n) for p, n in zip(parts, sizes)]).astype(bool) if parts else np.zeros(0, bool)


def _advanced(chunks: DataFrame, answers: DataFrame, length: int, level: int, bits: int, schema: T.StructType) -> DataFrame:
    """Finished documents, and chunks of those that have candidates left; after the last level all are finished."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    number, payload, parts = (batch.column(c)[i].as_py() for c in ("chunk", "payload", "parts"))
                    chunk = Chunk.load(payload)
                    chunk.read()
                    distinct, where, _ = chunk.hashes(length, level)
                    repeated = _answered(distinct, bits, parts or [])[where]
                    done = chunk.results(length, repeated) if level == length else chunk.keep(length, repeated)
                    for row in done:
                        yield *row, None, None, None
                    if level < length and chunk.ids:
                        yield None, None, None, None, number, int(chunk.live.sum()), chunk.dump()

        yield from _sent(rows(), schema)

    size = answers.agg(F.sum(F.aggregate("parts", F.lit(0), lambda s, p: s + F.length(p["bits"])))).first()[0] or 0
    joined = chunks.select("chunk", "payload").join(F.broadcast(answers) if size <= BROADCAST_BYTES else answers, "chunk", "left")
    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a window of length words that covers it starts anywhere else too, in its own or another text;
    all windows are judged on the input. Null and empty texts have no words. Texts shorter than length lose nothing;
    equal texts of length or more words lose everything. Keys may be null or repeated. Other columns are not read.
    Windows are compared by 128-bit hashes of their words."""
    schema = _schema(docs.schema[key].dataType)
    state = materialize(_chunked(docs.select(key, text), length, schema), "chunks")
    done = [state]
    for level in levels(length):
        chunks = state.where(F.col("payload").isNotNull())
        windows = chunks.agg(F.sum("windows")).first()[0] or 0
        if not windows:
            break
        sent = windows if level == length else 2 * windows // (length - level + 2)
        bits = max(0, (sent // RANGE_HASHES).bit_length())
        answers = materialize(_counted(chunks, length, level, bits), "answers")
        state = _advanced(chunks, answers, length, level, bits, schema)
        state = state if level == length else materialize(state, "chunks")
        done.append(state)
    names = ("id", "n_words", "n_removed", "kept_sha256")
    found = [d.where(F.col("payload").isNull()).select(*names) for d in done]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.withColumnRenamed("id", key)
