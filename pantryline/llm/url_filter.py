"""URL verdicts: host and path rules, then an exact Bloom filter cascade. DataFrame functions only.

The cascade (``build_cascade``) works over a *closed* universe of keys, each listed or not. Level 1 is a Bloom filter
of the listed keys; level 2 one of the unlisted keys that level 1 lets through; level 3 one of the listed keys that
level 2 lets through, and so on until a level lets nothing wrong through. A key is listed if the first level that
refuses it has an even number, or if none refuses it and the number of levels is odd. Over the universe this is exact.

Filters are blocked: a key's bits lie in one block of 32,768 bits. A level of up to ``max_words`` 64-bit words goes to
the probing query as one scalar subquery of that size, so the probed rows meet no join and no shuffle. A larger level
is kept as a table of blocks, which the probed rows meet by block number.

Up to ``IN_PLAN`` rules are one constant list in the plan, longest first, that each url goes along; more are a table that distinct hosts and paths meet by the host's
suffixes.

Nulls: a null key counts as the empty key. Repeated keys count once, as listed if any of them is. An empty universe
gives a cascade of no levels, which lists nothing. A null url has an empty host and path, an empty one too; a long one is taken
whole. Repeated pages are judged each, equal urls alike; of rules of one length the first given wins. ``judge_urls`` reads two
columns and ``is_listed`` returns all as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantryline.llm.common import apart, lower_ascii, new_path, written

BLOCK_WORDS = 512
BLOCK_BITS = 64 * BLOCK_WORDS
IN_PLAN = 200
KEY = "key of the cascade"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null.

    ``rules``: (verdict, ``host/path``), written into the plan. A rule fits its host and all subdomains if the path starts with the
    rule's. Of rules of one length the first given wins.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda x: -len(x[1]))  # a constant of the plan, longest first
    each = []
    for verdict, rule in ordered:
        name, slash, rest = rule.partition("/")
        each.append(F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(name).alias("end"), F.lit(slash + rest).alias("begin")))
    fit = F.filter(F.array(*each), lambda r: ((host == r["end"]) | host.endswith(F.concat(F.lit("."), r["end"]))) & path.startswith(r["begin"]))
    first = F.get(fit, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def with_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``df`` (host, path, ...) with ``_rule``, the struct of ``longest_rule``."""
    if len(rules) <= IN_PLAN:
        return df.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    table = df.sparkSession.createDataFrame([(i, v, r) for i, (v, r) in enumerate(rules)], "_n long, verdict string, rule string")
    table = table.withColumns({"_end": F.substring_index("rule", "/", 1), "_from": F.expr("substr(rule, instr(concat(rule, '/'), '/'))")})
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = df.select("host", "path").distinct().withColumn("_end", F.explode(ends))
    fits = each.join(table, "_end").filter(F.startswith("path", "_from"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), -F.col("_n"))).alias("_rule"))
    # as a table of its own, so that a join whose one url has many rows can be split
    return df.join(written(best, "rules"), ["host", "path"], "left")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its number from 1, its blocks and hashes, and the table of its words."""

    number: int
    blocks: int
    hashes: int
    words: DataFrame
    whole: bool

    def _bits(self, key: Column) -> tuple[Column, list[Column]]:
        """Block number, and the bits in it, of a key."""
        block = F.pmod(F.xxhash64(F.lit(self.number), F.lit(-1), key), F.lit(self.blocks))
        return block, [F.pmod(F.xxhash64(F.lit(self.number), F.lit(j), key), F.lit(BLOCK_BITS)) for j in range(self.hashes)]

    def passes(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a boolean column ``name``: whether the filter lets the key through."""
        block, bits = self._bits(key)

        def has(words: Column, first: Column) -> Column:
            out = F.lit(True)
            for bit in bits:
                word = F.element_at(words, (first + F.shiftright(bit, 6) + 1).cast("int"))
                out = out & (F.getbit(word, (bit % 64).cast("int")) == 1)
            return out

        if self.whole:
            return df.withColumn(name, has(self.words.select("words").scalar(), block * BLOCK_WORDS))
        blocks = self.words.withColumnsRenamed({"block": f"_{name}_block", "words": f"_{name}_words"})
        joined = df.withColumn(f"_{name}_at", block).join(blocks, F.col(f"_{name}_at") == F.col(f"_{name}_block"), "left")
        return joined.withColumn(name, F.coalesce(has(F.col(f"_{name}_words"), F.lit(0)), F.lit(False))).drop(f"_{name}_at", f"_{name}_block", f"_{name}_words")


def _level(keys: DataFrame, number: int, n: int, bits_per_key: float, max_words: int) -> Level:
    blocks = max(1, math.ceil(n * bits_per_key / BLOCK_BITS))
    whole = blocks * BLOCK_WORDS <= max_words
    level = Level(number, blocks, max(1, round(bits_per_key * math.log(2))), keys, whole)
    block, bits = level._bits(F.col("key"))
    at = keys.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    words = at.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    spark = keys.sparkSession
    empty = spark.range(blocks * BLOCK_WORDS).select(F.expr(f"id div {BLOCK_WORDS}").alias("block"), (F.col("id") % BLOCK_WORDS).alias("word"), F.lit(0).cast("long").alias("bits"))
    full = words.unionByName(empty).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    group = [] if whole else ["block"]
    lists = full.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("block", "word", "bits"))).alias("s")).select(*group, F.col("s.bits").alias("words"))
    path = new_path(spark, f"cascade-{number}")
    lists.write.parquet(path)
    return Level(number, blocks, level.hashes, spark.read.parquet(path), whole)


def build_cascade(universe: DataFrame, bits_per_key: float = 10.0, max_words: int = 1 << 20) -> list[Level]:
    """Levels over ``universe`` (key string, listed boolean). ``max_words``: of one level that a query takes whole (8 MB)."""
    keys = universe.groupBy(F.coalesce("key", F.lit("")).alias("key")).agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    alive, levels = written(keys, "universe"), []
    for number in count(1):  # each level lets through a small part of what the one before did
        encoded = F.col("listed") if number % 2 else ~F.col("listed")
        n = alive.filter(encoded).count()
        if not n:
            return levels
        level = _level(alive.filter(encoded), number, n, bits_per_key, max_words)
        levels.append(level)
        alive = written(level.passes(alive, F.col("key"), "_pass").filter("_pass").drop("_pass"), "alive")
    return levels


def is_listed(df: DataFrame, key: Column, levels: list[Level], name: str = "listed") -> DataFrame:
    """``df`` with the boolean ``name``. Exact for keys of the universe that the cascade was built over."""
    out = F.lit(len(levels) % 2 == 1)
    plain, back = apart(df.withColumn(KEY, F.coalesce(key, F.lit(""))), KEY, own=("_listed",))
    for level in levels:
        plain = level.passes(plain, F.col(KEY), f"_p{level.number}")
    for level in reversed(levels):
        out = F.when(~F.col(f"_p{level.number}"), F.lit(level.number % 2 == 0)).otherwise(out)
    return back(plain.withColumn("_listed", out), _listed=name).drop(KEY)


def judge_urls(pages: DataFrame, listed: Column, rules: list[tuple[str, str]], bits_per_key: float = 10.0, max_words: int = 1 << 20) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict.

    A rule that fits decides; else ``block`` if the page's key, host and path together, is listed. A key is listed if
    the condition ``listed`` holds for any page with it; null counts as false. A null url has an empty host and path.
    """
    parts = pages.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"), F.coalesce(listed, F.lit(False)).alias("_listed"))
    key = F.concat("host", "path")
    levels = build_cascade(parts.select(key.alias("key"), F.col("_listed").alias("listed")), bits_per_key, max_words)
    found = is_listed(parts.drop("_listed"), key, levels, "_block")
    found = with_rules(found, rules)
    method = F.when(F.col("_block"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"))
