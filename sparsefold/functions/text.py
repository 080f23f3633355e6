"""Column expressions over text. Everything here stays inside one row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def hash_bit(value: Column, n_bits: int) -> Column:
    """First 32 bits of md5, folded to ``[0, n_bits)``."""
    head = F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")
    return (head % F.lit(n_bits)).cast("int")


def ngram(tok: Column, start: Column, n: int) -> Column:
    """The n-gram of array ``tok`` whose first word has the 0-based position ``start``."""
    words = [tok[start + k] for k in range(n)]
    spaced = [part for word in words for part in (F.lit(" "), word)][1:]
    return F.concat(*spaced) if n > 1 else words[0]


def ngram_map(tok: Column, n: int, fn, element_type: str) -> Column:
    """``fn`` over every n-gram of ``tok``; empty when there are fewer than n words."""
    positions = F.sequence(F.lit(0), F.size(tok) - F.lit(n))
    empty = F.array().cast(f"array<{element_type}>")
    return F.when(F.size(tok) >= n, F.transform(positions, lambda i: fn(ngram(tok, i, n)))).otherwise(empty)


def ngram_bits(tok: Column, n_bits: int, max_n: int = 3) -> Column:
    """Distinct folded bits of all 1..max_n-grams. ``tok`` must be a materialised column."""
    parts = [ngram_map(tok, n, lambda g: hash_bit(g, n_bits), "int") for n in range(1, max_n + 1)]
    return F.array_distinct(F.concat(*parts))


def unnest(df: DataFrame, row_id: str, array: str | Column, out: str) -> DataFrame:
    """(row_id, out): one row per element of a computed array.

    Outer explode, then a filter on the element: for a plain explode the optimizer adds a filter on the
    array's size and pushes it down to the scan, where tokenising would be repeated for every word.
    """
    return df.select(row_id, F.explode_outer(array).alias(out)).where(F.col(out).isNotNull())


def count_class(text: Column, char_class: str) -> Column:
    """Number of characters of ``text`` inside a regex character class body."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]", ""))
