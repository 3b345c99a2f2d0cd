"""Benchmark decontamination: every training passage queries a BM25 inverted index of test items by block-max WAND.

Impacts are divided by the item's own score, so that a passage holding all of an item scores 1 and one threshold fits
all items. Documents are cut into overlapping passages of twice the longest item, hence any copy of an item lies whole
in some passage. Items above the threshold are verified: with question and answer columns by the overlap of each one's
word n-grams, else by the share of the item's words that stand in word pairs of the passage, wherever in the item.
Number, lengths and document frequencies are those of all items, counted in Spark; items are indexed in shards of bounded
size, one after the other: a shard's index is broadcast, asked by every document, and given up before the next one is
built. Neither the driver nor a worker holds more than one, and results do not depend on the number of shards.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Mapping, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: A shard's bounds; more items make more shards.
SHARD_ITEMS, SHARD_CHARS = 20_000, 8_000_000
K1, B = 1.2, 0.75
BLOCK = 64
#: A passage is retrieved at this share of an item's own BM25 score, verified at these shares of its n-grams.
LEAST_SCORE, LEAST_QUESTION, LEAST_ANSWER = 0.5, 0.6, 0.6
GRAM = 5
#: An item without such columns is verified at this share of its words, in runs of this many.
LEAST_WORDS, RUN = 0.75, 2
#: Frequent terms are left out of the first test while no item has more than this share of its score from them.
SLACK = 0.2

#: ASCII characters that are neither letters, digits nor underscores part words.
_PARTED = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-cased words in UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PARTED).split()


def grams(words: Sequence[bytes]) -> set[tuple[bytes, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def covered(words: Sequence[bytes], passage: Sequence[bytes]) -> float:
    """The share of words that stand in runs of RUN which a stretch of the passage has too. Stretches are three times
    as long as words and begin at every length of words: a copy lies whole in one, even with as many words put in."""
    size, n, best = len(words), min(RUN, len(words)), 0
    runs = [tuple(words[i : i + n]) for i in range(size - n + 1)]
    for at in range(0, max(1, len(passage) - 2 * size), size):
        held = {tuple(passage[i : i + n]) for i in range(at, min(at + 3 * size, len(passage)) - n + 1)}
        marks = bytearray(size)
        for i, run in enumerate(runs):
            if run in held:
                marks[i : i + n] = b"\1" * n
        best = max(best, sum(marks))
    return best / size


class Statistics(NamedTuple):
    """Of all items that have a word: how many, their words in all, the longest one's, and items by term."""

    items: int
    words: int
    longest: int
    df: Mapping[bytes, int]

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> Statistics:
        counts = [Counter(tokens(t or "")) for t in texts]
        lengths = [sum(c.values()) for c in counts if c]
        return cls(len(lengths), sum(lengths), max(lengths, default=1), Counter(t for c in counts for t in c))


class ItemIndex:
    """Posting lists of items in ascending order, impacts and their maxima by block and list.

    whole: the statistics of all items that impacts count by, if items are only a part of them."""

    def __init__(self, items: Sequence[tuple[object, str, str | None, str | None]], least: float = LEAST_SCORE, whole: Statistics | None = None):
        whole = whole or Statistics.of(item[1] for item in items)
        self.ids, self.parts, terms_of = [], [], []
        for key, text, question, answer in items:
            words = tokens(text or "")
            if not words:
                continue
            self.ids.append(key)
            self.parts.append((grams(tokens(question)), grams(tokens(answer))) if question and answer else words)
            terms_of.append(Counter(words))
        self.least, self.longest = least, whole.longest
        n, df = whole.items, whole.df
        mean = whole.words / n if n else 1.0
        here = Counter(t for c in terms_of for t in c)
        self.number = {t: i for i, t in enumerate(here)}
        docs: list[list[int]] = [[] for _ in here]
        impacts: list[list[float]] = [[] for _ in here]
        for i, counts in enumerate(terms_of):
            norm = K1 * (1 - B + B * counts.total() / mean)
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in counts.items()}
            whole = sum(raw.values())
            for t, x in raw.items():
                docs[self.number[t]].append(i)
                impacts[self.number[t]].append(x / whole)
        self.docs, self.impacts = docs, impacts
        self.most = [max(x) for x in impacts]
        self.blocks = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in impacts]
        # light terms: the most frequent ones, while no item has more than SLACK of its score from them
        used, self.heavy = [0.0] * len(self.ids), {}
        for t in sorted(here, key=lambda t: (-here[t], t)):
            k = self.number[t]
            if all(used[i] + x <= SLACK for i, x in zip(docs[k], impacts[k])):
                for i, x in zip(docs[k], impacts[k]):
                    used[i] += x
            else:
                self.heavy[t] = k
        self.slack = max(used, default=0.0)
        self.heavy_most = np.array(self.most)
        self.df = np.array([len(x) for x in docs], dtype=np.int64)
        self.first = np.cumsum(self.df) - self.df
        self.flat_docs = np.array([i for x in docs for i in x], dtype=np.int64)
        self.flat_impacts = np.array([x for y in impacts for x in y])

    def search(self, terms: Iterable[bytes]) -> list[tuple[int, float]]:
        """(item, score) of every item that scores self.least or more, by block-max WAND."""
        least = self.least - 1e-9
        cursors = [[self.docs[k][0], 0, k] for k in {self.number[t] for t in terms if t in self.number}]
        found: list[tuple[int, float]] = []
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, k) in enumerate(cursors):
                bound += self.most[k]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, jump = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)
            for at in cursors[: pivot + 1]:
                # the block that would hold the pivot item
                docs, k = self.docs[at[2]], at[2]
                block = bisect_left(docs, item, at[1]) // BLOCK
                if block < len(self.blocks[k]):
                    bound += self.blocks[k][block]
                    jump = min(jump, docs[min(len(docs), (block + 1) * BLOCK) - 1] + 1)
            if bound >= least:
                if cursors[0][0] == item:
                    score = sum(self.impacts[k][p] for d, p, k in cursors[: pivot + 1] if d == item)
                    if score >= least:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                target = max(jump, item + 1)
            moved = []
            for at in cursors[: pivot + 1]:
                docs = self.docs[at[2]]
                if at[0] < target:
                    at[1] = bisect_left(docs, target, at[1])
                    if at[1] == len(docs):
                        continue
                    at[0] = docs[at[1]]
                moved.append(at)
            cursors = moved + cursors[pivot + 1 :]

    def passages(self, words: Sequence[bytes]) -> list[tuple[int, int]]:
        """Starts and ends of the passages in which some item's heavy terms alone come within the slack of the
        threshold: no other passage can reach it. One pass over the heavy terms of all passages."""
        get, bound, step = self.heavy.get, self.least - self.slack - 1e-6, self.longest
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        place = np.flatnonzero(at >= 0)
        if bound > 0 and self.heavy_most[at[place]].sum() < bound:
            return []
        starts = np.arange(0, max(1, len(words) - step), step)
        if bound > 0:
            last = place // step
            window = np.concatenate((last, last - 1))
            pairs = np.unique((window * len(self.most) + np.concatenate((at[place], at[place])))[(window >= 0) & (window < len(starts))])
            window, term = np.divmod(pairs, len(self.most))
            count = self.df[term]
            posting = np.repeat(self.first[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
            both, where = np.unique(np.repeat(window, count) * len(self.ids) + self.flat_docs[posting], return_inverse=True)
            reach = np.bincount(where, self.flat_impacts[posting], len(both))
            starts = starts[np.unique(both[reach >= bound] // len(self.ids))]
        return [(s, min(s + 2 * step, len(words))) for s in starts.tolist()]

    def leaks(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage), the best passage per item."""
        words = tokens(text)
        best: dict[int, tuple[int, float, float, float, int]] = {}
        for start, end in self.passages(words):
            passage = words[start:end]
            hits = self.search(set(passage))
            if not hits:
                continue
            by_size: dict[int, set] = defaultdict(set)
            for item, score in hits:
                parts, shares = self.parts[item], []
                if isinstance(parts, list):
                    shares = [covered(parts, passage)] * 2
                    held = shares[0] >= LEAST_WORDS
                else:
                    for part in parts:
                        n = len(next(iter(part), ()))
                        if n and n not in by_size:
                            by_size[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                        shares.append(len(part & by_size[n]) / len(part) if part else 1.0)
                    held = shares[0] >= LEAST_QUESTION and shares[1] >= LEAST_ANSWER
                if held:
                    best[item] = max(best.get(item, (item, -1.0, 0.0, 0.0, 0)), (item, min(1.0, score), *shares, start))
        return [best[i] for i in sorted(best)]


def _finder(index: Broadcast, schema: str):
    names = ("item_id", "score", "question", "answer", "first_word")

    def find(column: pd.Series) -> pd.Series:
        held = index.value
        rows = [[dict(zip(names, (held.ids[i], *rest))) for i, *rest in held.leaks(t or "")] for t in column]
        return pd.Series(rows, index=column.index, dtype=object)

    find.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(find, schema)


def statistics(items: DataFrame, text: str = "text") -> tuple[DataFrame, int, int, int]:
    """(term, df) of all items, a materialized table; and their number, words and longest, of those that have a word."""

    @F.pandas_udf("struct<terms:array<binary>,words:bigint>")
    def counted(column: pd.Series) -> pd.DataFrame:
        each = [tokens(t or "") for t in column]
        return pd.DataFrame({"terms": [sorted(set(words)) for words in each], "words": [len(words) for words in each]})

    found = materialize(items.select(counted(text).alias("t")).select("t.*").where("words > 0"), "terms")
    n, words, longest = found.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(1))).first()
    return materialize(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df"), n, words, longest


def with_leaks(docs: DataFrame, items: DataFrame, name: str = "leaks", text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """docs with a column name: the items found in the whole text, as item_id, score, question and answer (shares of
    n-grams; of an item without both columns twice the share of its words), first_word (of the passage). items:
    item_id, text and, if there are any, question and answer; other columns are not read.

    Items without a word match nothing; repeated items are each reported. Null and empty texts have an empty list. Rows
    are neither lost nor multiplied, repeated ones included. Items by item_id (as text), then text. With more than one
    shard of items docs are written to the shared folder once, and every shard reads them again: work grows with
    documents times shards of SHARD_ITEMS."""
    kind = items.schema["item_id"].dataType.simpleString()
    more = [F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in ("question", "answer")]
    chosen = materialize(items.select("item_id", "text", *more), "items")
    rows, chars = chosen.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, math.ceil(rows / SHARD_ITEMS), math.ceil(chars / SHARD_CHARS))
    sharded = chosen.withColumn("shard", F.pmod(F.xxhash64("item_id", "text", F.lit(1)), F.lit(shards)))
    df, n, words, longest = statistics(chosen)
    schema = f"array<struct<item_id:{kind},score:double,question:double,answer:double,first_word:int>>"

    def index_of(shard: int) -> Broadcast:
        part = sharded.where(F.col("shard") == shard).drop("shard")
        held = sorted(map(tuple, part.collect()), key=lambda item: (str(item[0]), item[1] or ""))  # one shard: bounded
        terms = [(bytearray(t),) for t in {t for item in held for t in tokens(item[1] or "")}]
        own = df.join(F.broadcast(docs.sparkSession.createDataFrame(terms, "term binary")), "term")
        whole = Statistics(n, words, longest, {bytes(r.term): r.df for r in own.collect()})
        return docs.sparkSession.sparkContext.broadcast(ItemIndex(held, least, whole))

    if shards == 1:
        return docs.withColumn(name, _finder(index_of(0), schema)(F.col(text)))
    at = f"_mr_row_{name}"
    docs = materialize(docs.withColumn(at, F.monotonically_increasing_id()), "docs")
    found = None
    for shard in range(shards):
        index = index_of(shard)
        hits = docs.select(at, F.explode(_finder(index, schema)(F.col(text))).alias("hit"))
        hits = materialize(hits, "hits")
        index.destroy()
        found = hits if found is None else found.unionByName(hits)
    lists = found.groupBy(at).agg(F.sort_array(F.collect_list(F.struct(F.col("hit.item_id").cast("string").alias("key"), "hit"))).alias("hits"))
    lists = lists.select(at, F.transform("hits", lambda x: x["hit"]).alias(name))
    return docs.join(lists, at, "left").withColumn(name, F.coalesce(name, F.array().cast(schema))).drop(at)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item, columns unchanged."""
    return with_leaks(docs, items, "_mr_leaks").where(F.size("_mr_leaks") == 0).drop("_mr_leaks")
