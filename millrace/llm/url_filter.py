"""URL filter: host and path rules, then a listed-URL test by a blocked Bloom filter and an exact join.

The filter is a table of 256-bit blocks, built by bit_or and probed by one equi-join on the block number, so that
it has no size limit: it is broadcast only where its counted size allows, and shuffled otherwise. Possible hits
alone go on to the exact hash join with the list, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, join_counted, materialize

#: Bits of a block, in four 64-bit words; an entry sets PROBES of them.
WORDS, PROBES = 4, 6
BITS_PER_ENTRY = 12


class Rule(NamedTuple):
    action: str
    host: str
    path: str = "/"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ? or # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: host without www. and port, path without index page and last slash."""
    bare = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^www\.", "")
    return F.concat(bare, F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"(/|\.html?|/index\.html?)$", ""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and action; null where none fits. Equal lengths: the earlier rule."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    # what is longer, and of equally long what comes earlier, overrides
    for _, rule in sorted(enumerate(rules), key=lambda x: (len(x[1].host) + len(x[1].path), -x[0])):
        dotted = F.concat(F.lit("."), host)
        fits = dotted.endswith("." + rule.host) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.host + rule.path)).otherwise(text)
        action = F.when(fits, F.lit(rule.action)).otherwise(action)
    return text, action


def _block(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry), F.lit(blocks)).alias("block")


def _hash(entry: Column) -> Column:
    return F.xxhash64(F.concat(entry, F.lit("\x01")))


def _masks(h: Column) -> list[Column]:
    """The four words of the bits that a hash sets."""
    bits = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(WORDS * 64 - 1)) for i in range(PROBES)]
    masks = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for bit in bits:
            word = word.bitwiseOR(F.when(F.shiftright(bit, 6) == w, _one_at(bit)).otherwise(F.lit(0).cast("long")))
        masks.append(word)
    return masks


def _one_at(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """One row per used block: block, w0..w3. Copies of an entry set the same bits."""
    masks = _masks(F.col("h"))
    hashed = listed.select("entry", _hash(F.col("entry")).alias("h"))
    return hashed.select(_block(F.col("entry"), blocks), *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url: str = "url", listed_action: str = "block", other_action: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of pages.

    listed: (entry string), canonical URLs as canonical() writes them; null entries are ignored, copies count once.
    A fitting rule decides; else listed_action if the URL's canonical form is listed, else other_action. Null, empty
    and malformed URLs have an empty host and path and get other_action unless a rule fits. Rows are neither lost nor
    multiplied; an empty list or table gives the same columns. Other columns of pages stay, even if called entry,
    block or w0: the join keys carry a prefix of their own."""
    listed = materialize(listed.where(F.col("entry").isNotNull()).select("entry").distinct(), "listed")
    blocks = max(1, -(-listed.count() * BITS_PER_ENTRY // (WORDS * 64)))
    bloom = materialize(bloom_blocks(listed, blocks), "bloom").select(F.col("block").alias("_mr_block"), *[F.col(f"w{i}").alias(f"_mr_w{i}") for i in range(WORDS)])

    host, path = host_of(F.col(url)), path_of(F.col(url))
    text, action = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.withColumns({"host": host, "path": path}).withColumns({"rule": text, "_mr_action": action})
    judged = judged.withColumn("_mr_entry", canonical(F.col("host"), F.col("path")))
    judged = judged.withColumns({"_mr_block": _block(F.col("_mr_entry"), blocks), "_mr_h": _hash(F.col("_mr_entry"))})
    probed = join_counted(judged, bloom, ["_mr_block"], "left")
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col("_mr_h"))):
        hit = hit & (F.col(f"_mr_w{i}").bitwiseAND(mask) == mask)
    # the other rows carry a key without a slash, which no entry has, spread over many values
    aside = F.concat(F.lit("-"), F.pmod(F.xxhash64(url), F.lit(65536)).cast("string"))
    probed = probed.withColumn("_mr_key", F.when(F.col("_mr_action").isNull() & F.coalesce(hit, F.lit(False)), F.col("_mr_entry")).otherwise(aside))
    exact = listed.select(F.col("entry").alias("_mr_key"), F.lit(True).alias("_mr_listed"))
    found = join_counted(probed, exact, ["_mr_key"], "left")
    verdict = F.coalesce("_mr_action", F.when(F.col("_mr_listed"), F.lit(listed_action)).otherwise(F.lit(other_action)))
    return found.withColumn("verdict", verdict).select(*pages.columns, "host", "path", "rule", "verdict")
