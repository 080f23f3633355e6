"""URL rules by a Bloom filter cascade: exact membership of every key of the corpus, without joins.

Level 1 encodes the listed keys. The unlisted keys of the corpus that it wrongly admits are its false positives; level 2
encodes those, level 3 the listed keys that level 2 wrongly admits, and so on until a level admits none. A key of the
corpus is listed if the first level that doesn't admit it is even (or, past the last, by the count of levels). The
filters are literals of bounded size; where any level would exceed ``MAX_BITS``, be it of listed keys or of false positives, keys are dealt by hash into slices
with a cascade of their own, each applied to its slice alone. Only DataFrame functions are used.

A null url, or one without ``://``, has empty host and path and fits no rule. Repeated rows get the same verdict, an
empty table gives an empty one with no filter levels beyond the first, further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparsefold.llm.shared import let, stored

#: (rule as host/path prefix, verdict); the longest that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts that no rule decides are blocked if a label holds one of these words.
BAD_LABELS = r"(^|[.-])(spam|casino|pills|xxx|warez|malware|phish)"
BITS_PER_KEY = 12
PROBES = 6
#: Share of other keys that a level of that many bits and probes admits, with room.
WRONGLY_ADMITTED = 0.005
MAX_BITS = 1 << 24
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    bits: int
    words: tuple[int, ...]


@dataclass(frozen=True)
class Cascade:
    """Levels of each slice; a key belongs to the slice of its hash."""

    slices: tuple[tuple[Level, ...], ...]

    def holds(self, key: Column) -> Column:
        if len(self.slices) == 1:
            return listed_by(self.slices[0], key)
        dealt = F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(len(self.slices)))
        out = F.lit(False)
        for i, levels in enumerate(self.slices):
            out = F.when(dealt == i, listed_by(levels, key)).otherwise(out)
        return out


def probes(key: Column, bits: int, level: int) -> Column:
    """Bit numbers of a key: double hashing, with other hashes on every level."""
    def spread(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(h["a"] + i.cast("long") * h["b"], F.lit(bits).cast("long")))

    part = lambda name: F.shiftright(F.xxhash64(F.lit(f"{name}{level}"), key), 2).cast("long")  # noqa: E731  so that the sums don't overflow
    return let(F.struct(F.pmod(part("a"), F.lit(1 << 40)).alias("a"), (F.pmod(part("b"), F.lit(1 << 40)) * 2 + 1).alias("b")), spread)


def admits(level: Level, number: int, key: Column) -> Column:
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    return F.forall(probes(key, level.bits, number), lambda b: F.call_function("bit_get", F.element_at(words, F.shiftright(b, 6).cast("int") + 1), F.pmod(b, F.lit(64)).cast("int")) == 1)


def listed_by(levels: Sequence[Level], key: Column) -> Column:
    """The first level, counted from 0, that doesn't admit the key is odd; past the last, their count is."""
    out = F.lit(len(levels) % 2 == 1)
    for number in reversed(range(len(levels))):
        out = F.when(admits(levels[number], number, key), out).otherwise(F.lit(number % 2 == 1))
    return out


def encode(keys: DataFrame, n: int, number: int) -> Level:
    """The filter of ``n`` keys, at a size of whole words: bits are joined by word before the few words are fetched."""
    bits = max(64, -(-n * BITS_PER_KEY // 64) * 64)
    bit = keys.select(F.explode(probes(F.col("key"), bits, number)).alias("b"))
    words = bit.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).collect()
    by = {r["w"]: r["v"] for r in words}
    return Level(bits, tuple(by.get(i, 0) for i in range(bits // 64)))


def build(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
    """``universe``: (key, listed), every key of the corpus and the list once."""
    n, n_listed = universe.agg(F.count("*"), F.count_if("listed")).first()
    keys = max(n_listed, (n - n_listed) * WRONGLY_ADMITTED)
    n_slices = max(1, -(-int(2 * keys * BITS_PER_KEY) // max_bits))
    while True:
        dealt = F.pmod(F.xxhash64(F.lit("slice"), "key"), F.lit(n_slices))
        slices: list[tuple[Level, ...]] = []
        for i in range(n_slices):
            slices.append(levels_of(universe.where(dealt == i) if n_slices > 1 else universe))
            if max((x.bits for x in slices[-1]), default=0) > max(max_bits, 64):
                break
        else:
            return Cascade(tuple(slices))
        # Some level, first or later, outgrew the bound: finer slices.
        n_slices *= 2


def levels_of(universe: DataFrame) -> tuple[Level, ...]:
    levels: list[Level] = []
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    while len(levels) < MAX_LEVELS:
        keys, others = (inside, outside) if len(levels) % 2 == 0 else (outside, inside)
        n = keys.count()
        if not n:
            break
        level = encode(keys, n, len(levels))
        passed = others.where(admits(level, len(levels), F.col("key")))
        # What a level admits wrongly is a small share of the keys; storing it keeps later levels from probing all again.
        inside, outside = (inside, stored(passed)) if len(levels) % 2 == 0 else (stored(passed), outside)
        levels.append(level)
    else:
        raise ValueError(f"no exact cascade within {MAX_LEVELS} levels")
    return tuple(levels)


def universe_of(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) of both, each key once, joined by aggregation; stored, as every level reads it."""
    both = keys.select("key", F.lit(False).alias("l")).unionByName(listed.select("key", F.lit(True).alias("l")))
    return stored(both.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("l").alias("listed")))


def rule_keys(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Every host suffix and path prefix that could be one of the rules, longest first."""
    most = max(r.partition("/")[0].count(".") + 1 for r, _ in rules)
    lengths = sorted({len(r) - r.index("/") for r, _ in rules}, reverse=True)

    def keys(labels: Column) -> Column:
        suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
                               lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
        prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: F.length(path) >= n), lambda n: F.substring(path, F.lit(1), n))
        return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))

    return F.array_sort(let(F.split(host, r"\."), keys), lambda a, b: F.length(b) - F.length(a))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES,
          blocked_hosts: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed_host). ``blocked_hosts``: (key); left out, the corpus's hosts with a bad label."""
    spark = pages.sparkSession
    parsed = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = stored(parsed.groupBy(F.col("host").alias("key")).agg(F.count("*").alias("n")))
    if blocked_hosts is None:
        blocked_hosts = hosts.where(F.col("key").rlike(BAD_LABELS)).select("key")
    keys = parsed.select(F.explode(rule_keys(F.col("host"), F.col("path"), rules)).alias("key")).groupBy("key").agg(F.lit(1).alias("one"))
    in_hosts = build(universe_of(hosts, blocked_hosts))
    lists = {v: build(universe_of(keys, spark.createDataFrame([(r,) for r, w in rules if w == v], "key string"))) for v in ("allow", "block")}

    fits = F.filter(rule_keys(F.col("host"), F.col("path"), rules), lambda k: lists["allow"].holds(k) | lists["block"].holds(k))
    found = parsed.withColumn("rule", F.try_element_at(fits, F.lit(1))).withColumn("listed_host", in_hosts.holds(F.col("host")))
    by_rule = F.when(F.col("rule").isNull(), None).when(lists["block"].holds(F.col("rule")), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("listed_host"), "block").otherwise("allow")).alias("verdict"),
                        "listed_host")
