"""URL rules held in Bloom filter cascades: exact membership without joins, built-in functions only.

A cascade answers "is this key listed?" exactly for every key of a known universe. Level 0 is a
Bloom filter over the listed keys. The keys of the universe that pass it wrongly are put into
level 1, the listed keys that pass level 1 are put into level 2, and so on until a level has no
false positives. A lookup walks the levels and stops at the first filter that does not hold the key.

The bit arrays are scalar subqueries over one small stored table, so pages meet them without a join.
They take about ``BITS_PER_KEY`` bits for each rule, whatever the number of pages, and a check on
``MAX_BITS`` guards that size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.sinks import shared_folder, stage

BITS_PER_KEY = 12
HASHES = 4
MAX_BITS = 1 << 28
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        """Labels of the host and characters of the path: what a url must be cut to."""
        return self.host.count(".") + 1, len(self.path)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def candidate(host: Column, path: Column, labels: int, length: int) -> Column:
    """The key a rule of this shape would have to have to fit; null where the url is too short."""
    dots = F.length(host) - F.length(F.translate(host, ".", ""))
    fits = (dots >= labels - 1) & (F.length(path) >= length)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))


def bit_positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


class Cascade:
    """Levels of bit arrays over a universe table with a ``key`` and a boolean ``flag`` column.

    Every key with ``flag`` is a member; the answer is exact for each key of ``universe``.
    """

    def __init__(self, universe: DataFrame, flag: str):
        spark = universe.sparkSession
        self.levels: list[tuple[DataFrame, int]] = []
        inside, outside = universe.filter(F.col(flag)), universe.filter(~F.col(flag))
        while True:
            n = inside.count()
            if n == 0 and self.levels:
                break
            level = len(self.levels)
            bits = 64 * (1 + n * BITS_PER_KEY // 64)
            if bits > MAX_BITS:
                raise ValueError(f"a level of {bits} bits is over the bound of {MAX_BITS}")
            path = f"{shared_folder(spark)}/stage/bloom-{uuid.uuid4().hex}"
            self._filter(inside, level, bits).write.parquet(path)
            self.levels.append((spark.read.parquet(path), bits))
            inside, outside = outside.filter(self._holds(F.col("key"), level)), inside

    @staticmethod
    def _filter(keys: DataFrame, level: int, bits: int) -> DataFrame:
        """One row, one array of 64-bit words; words without a bit are zero."""
        position = F.explode(F.array(*bit_positions(F.col("key"), level, bits)))
        words = (
            keys.select(position.alias("p"))
            .groupBy((F.col("p") / 64).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        )
        held = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
        every = F.sequence(F.lit(0), F.lit(bits // 64 - 1))
        return held.select(F.transform(every, lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias("bits"))

    def _holds(self, key: Column, level: int) -> Column:
        filter_row, bits = self.levels[level]
        words = filter_row.scalar()
        tests = [
            F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
            for p in bit_positions(key, level, bits)
        ]
        return reduce(lambda a, b: a & b, tests)

    def contains(self, key: Column) -> Column:
        last = len(self.levels) - 1
        answer = F.lit(last % 2 == 0)
        for level in range(last, -1, -1):
            answer = F.when(self._holds(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return F.when(key.isNotNull(), answer).otherwise(F.lit(False))


def judge(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: its id, host, path, the longest fitting rule and the verdict.

    A rule fits its host and every subdomain if the path starts with the rule's path; among rules of
    equal length the greater key wins. Pages that no rule fits get ``rule`` null and ``default``.
    Null urls and urls without ``://`` have empty host and path, so no rule with a path fits them.
    Repeated rows are judged each; other columns of ``pages`` do not matter. With no pages the result
    is empty; without rules every page gets ``default``.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = sorted({r.shape for r in rules})
    cut = [candidate(F.col("host"), F.col("path"), *shape) for shape in shapes]
    seen = rows.select(F.explode(F.array(*cut)).alias("key")).filter(F.col("key").isNotNull())
    entries = [F.struct(F.lit(r.key).alias("key"), F.lit(r.verdict != default).alias("other")) for r in rules]
    listed = spark.range(1).select(F.inline(F.array(*entries)))
    universe = stage(
        seen.select("key", F.lit(False).alias("listed"), F.lit(False).alias("other"))
        .unionByName(listed.select("key", F.lit(True).alias("listed"), "other"))
        .groupBy("key")
        .agg(F.max("listed").alias("listed"), F.max("other").alias("other")),
        "url-keys",
    )
    is_rule, is_other = Cascade(universe, "listed"), Cascade(universe, "other")
    fitting = [F.when(is_rule.contains(c), F.struct(F.length(c).alias("n"), c.alias("key"))) for c in cut]
    judged = rows.withColumn("rule", F.array_max(F.array(*fitting))["key"])
    other = next((r.verdict for r in rules if r.verdict != default), default)
    verdict = F.when(F.col("rule").isNotNull() & is_other.contains(F.col("rule")), F.lit(other)).otherwise(F.lit(default))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
