"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates r that meet every source's token target, entropy balancing picks those closest to the natural
mix, in which every document counts once: the least sum of r ln r - r + 1 over documents, r at most the allowed copies.
The convex dual has one multiplier a source; at its optimum a document's rate is tilted exponentially by its tokens,
r = min(most, exp(lambda * size)), so that a source that must grow repeats its longer documents first, and one that must
shrink keeps its shorter ones. Newton iterations solve the dual: each aggregates gradient (tokens missing) and Hessian
over the documents' sizes, distributed, and moves all sources' multipliers at once. The rates are then rounded into
whole copies by error diffusion within small hash buckets of a source, largest documents first, so that a bucket ends
within about its smallest document's size of what it should take.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, WORD, join_counted, materialize

#: A source's tokens must come this near its target, relatively; rounding alone is coarser.
NEAR = 1e-9
#: Documents a rounding bucket should hold.
BUCKET_DOCS = 128
REPEATS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add weight and target to (name, source_size, ...): share of all sizes dealt by weight, no target above
    most times its source's size, the excess dealt again by weight among the others. Weights repeat in the order
    of names by code point, null last. The windows run over one row per source."""
    by_name = Window.orderBy(F.col("name").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("name").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"level": (total - capped) / rest, "rank": F.row_number().over(order)})
    open_row = F.when(F.col("full_at") >= F.col("level"), F.struct("rank", "level"))
    rows = rows.withColumn("level", F.min(open_row).over(Window.partitionBy())["level"])
    return rows.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).drop("cap", "full_at", "level", "rank")


def _exact_sum(term: Column) -> Column:
    """A sum that does not depend on the order of rows: over nine decimals."""
    return F.sum(term.cast("decimal(28,9)")).cast("double")


def rate_of(size: Column, multiplier: Column, scale: Column, most: float) -> Column:
    """The tilted rate. A multiplier counts by scale tokens; null: all a source has at the most allowed."""
    return F.coalesce(F.least(F.lit(float(most)), F.exp(multiplier * size / scale)), F.lit(float(most)))


def balanced(sizes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Add scale and multiplier to sources (g, source_size, target): the dual's optimum for sizes (g, size, docs).

    A Newton step in the logarithm of a source's tokens, which are nearly exponential in its multiplier. They grow with
    it, so every step also narrows an interval that holds the optimum, and a step that leaves the interval, or that the
    Hessian does not give, halves it. Sources are done when their tokens are within NEAR of the target, or when no
    double lies within the interval any more; the loop ends when all are. A target of all tokens at the most allowed
    has a null multiplier; so has a source without tokens."""
    sizes = sizes.where("size > 0")
    moments = sizes.groupBy("g").agg(F.min("size").cast("double").alias("least"), (_exact_sum(F.col("docs") * F.col("size").cast("double") * F.col("size")) / F.sum(F.col("docs") * F.col("size"))).alias("scale"))
    state = join_counted(sources.select("g", "source_size", "target"), moments, ["g"])
    whole = F.col("source_size") * F.lit(float(most))
    open_ = (F.col("target") > 0) & (F.col("target") < whole * (1 - NEAR))
    unit = F.col("scale") / F.col("least")  # the smallest document's tilt bounds all others'
    state = state.where(open_).select("g", "scale", "target", F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) * unit).alias("low"), F.greatest(F.lit(0.0), F.log(F.lit(float(most))) * unit).alias("high"))
    state = state.withColumns({"at": F.lit(0.0), "done": F.lit(False)})
    state = materialize(state, "dual")
    few = state.count() <= BROADCAST_ROWS  # rows of state and of all sums below: one a source
    side = F.broadcast if few else (lambda df: df)
    while not state.where("not done").isEmpty():
        tilted = F.exp(F.col("at") * F.col("size") / F.col("scale"))
        tokens = F.col("docs") * F.col("size")
        free = tilted < float(most)
        each = sizes.join(side(state.where("not done").select("g", "scale", "at")), "g")
        sums = each.groupBy("g").agg(
            _exact_sum(tokens * F.least(tilted, F.lit(float(most)))).alias("got"),
            _exact_sum(F.when(free, tokens * tilted * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
        )
        at, low, high, got = F.col("at"), F.col("low"), F.col("high"), F.col("got")
        moved = state.join(side(sums), "g", "left")
        moved = moved.withColumns({"low": F.when(got < F.col("target"), at).otherwise(low), "high": F.when(got > F.col("target"), at).otherwise(high)})
        newton = at - F.log(got / F.col("target")) * got / F.col("slope")
        middle = (F.col("low") + F.col("high")) / 2
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        near = (F.abs(got - F.col("target")) <= F.col("target") * NEAR) | (middle <= F.col("low")) | (middle >= F.col("high"))
        fixed = F.col("done") | F.coalesce(near, F.lit(False))
        moved = moved.withColumn("next", F.when(fixed, at).otherwise(F.when(inside, newton).otherwise(middle))).withColumn("done", fixed)
        state = materialize(moved.select("g", "scale", "target", "low", "high", F.col("next").alias("at"), "done"), "dual")
    return join_counted(sources, state.select("g", "scale", F.col("at").alias("multiplier")), ["g"], "left")


def mix(docs: DataFrame, weights: Sequence[float], share: float, most: float = 2.0, key: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs: key, group, size, source_size, target, rate, copies, taken (copies * size).

    Null text has size 0 and is never taken; a null group is a source of its own, in last place. Rows that repeat a
    key and size share its copies out among themselves. Equal sizes: by hash of the key, then the key. Reruns agree, whatever
    the partitions. An empty table gives no rows; other columns of docs are not read."""
    sized = docs.select(F.col(key).alias("id"), F.col(group).alias("name"), word_count(F.col(text)).alias("size"))
    # a null name gets a key that no name has
    sized = materialize(sized.withColumn("g", F.coalesce(F.concat(F.lit("1"), "name"), F.lit("0"))), "sizes")
    sources = sized.groupBy("g", "name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialize(water_filled(sources, weights, share, most), "targets")
    sizes = materialize(sized.groupBy("g", "size").agg(F.count("*").alias("docs")), "histogram")
    sources = materialize(balanced(sizes, sources, most), "sources")

    rows = sized.groupBy("g", "id", "size").agg(F.count("*").alias("m"))
    rows = join_counted(rows, sources.select("g", "n", "multiplier", "scale"), ["g"])
    hashed = F.xxhash64(F.col("id"), F.col("size"))
    rate = rate_of(F.col("size"), F.col("multiplier"), F.col("scale"), most)
    rows = rows.withColumns({"h": hashed, "bucket": F.pmod(hashed, F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_DOCS)).cast("long")), "rate": rate})
    buckets = rows.groupBy("g", "bucket").agg(F.sort_array(F.collect_list(F.struct("size", "h", "id", "m", "rate")), asc=False).alias("docs"))

    kind = "array<struct<id:{0},size:bigint,m:bigint,rate:double,copies:bigint>>".format(sized.schema["id"].dataType.simpleString())
    zero = F.lit(0).cast("long")

    def row(doc: Column, copies: Column) -> Column:
        return F.array(F.struct(doc["id"].alias("id"), doc["size"].alias("size"), doc["m"].alias("m"), doc["rate"].alias("rate"), copies.alias("copies")))

    def rounded(state: Column, doc: Column) -> Column:
        base = F.floor(doc["rate"] + 1e-9) * doc["m"]
        want = state["err"] + (doc["rate"] * doc["m"] - base) * doc["size"]
        more = F.when((doc["size"] > 0) & (doc["rate"] * doc["m"] > base), F.greatest(zero, F.least(doc["m"], F.round(want / doc["size"]).cast("long")))).otherwise(zero)
        copies = F.when(doc["size"] > 0, base + more).otherwise(zero)
        return F.struct((want - more * doc["size"]).alias("err"), F.concat(state["out"], row(doc, copies)).alias("out"))

    def settled(state: Column, doc: Column) -> Column:
        # what no rounding could take up goes to the largest documents that are no larger than it
        spare = F.lit(int(most)) * doc["m"] - doc["copies"]
        more = F.when(doc["size"] > 0, F.greatest(-doc["copies"], F.least(spare, (state["err"] / doc["size"]).cast("long")))).otherwise(zero)
        return F.struct((state["err"] - more * doc["size"]).alias("err"), F.concat(state["out"], row(doc, doc["copies"] + more)).alias("out"))

    start = F.struct(F.lit(0.0).alias("err"), F.array().cast(kind).alias("out"))
    once = buckets.select("g", F.aggregate("docs", start, rounded).alias("s"))
    again = F.aggregate(F.col("s.out"), F.struct(F.col("s.err").alias("err"), F.array().cast(kind).alias("out")), settled, lambda s: s["out"])
    done = once.select("g", F.explode(again).alias("d")).select("g", "d.*")
    # one row again for every row, in two steps, so that no array grows with the repeats of a key
    steps = F.sequence(zero, F.floor((F.col("m") - 1) / REPEATS))
    done = done.select("*", F.explode(steps).alias("step")).select("*", F.explode(F.sequence(F.col("step") * REPEATS + 1, F.least(F.col("m"), (F.col("step") + 1) * REPEATS))).alias("nth"))
    done = done.withColumn("copies", F.floor(F.col("copies") / F.col("m")) + (F.col("nth") <= F.col("copies") % F.col("m")).cast("long"))
    done = join_counted(done, sources.select("g", "name", "source_size", "target"), ["g"])
    return done.select(F.col("id").alias(key), F.col("name").alias(group), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
