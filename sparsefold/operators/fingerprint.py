"""Bit fingerprints. A record's set bits are one ``array<int>``, at most ``n_bits`` long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparsefold.functions.text import ngram_bits, tokens, unnest


def with_ngram_bits(df: DataFrame, text: str, n_bits: int, max_n: int = 3, out: str = "bits") -> DataFrame:
    """Hashed 1..max_n word n-grams, computed inside the row and replacing the text column."""
    kept = [c for c in df.columns if c != text]
    tok = df.select(*kept, tokens(F.col(text)).alias("_tok"))
    return tok.select(*kept, ngram_bits(F.col("_tok"), n_bits, max_n).alias(out))


def ngram_fingerprint(df: DataFrame, row_id: str, text: str, n_bits: int = 1024, max_n: int = 3) -> DataFrame:
    """Long form (row_id, bit)."""
    bits = with_ngram_bits(df.select(row_id, text), text, n_bits, max_n)
    return unnest(bits, row_id, "bits", "bit")


# Fixed yes/no keys for text records, numbered from 1 in this order.
TEXT_KEYS = [
    ("has_digit", "text rlike '[0-9]'"),
    ("has_at", "contains(text, '@')"),
    ("has_url", "contains(text, 'http')"),
    ("has_newline", "contains(text, '\\n')"),
    ("has_question", "contains(text, '?')"),
    ("has_bang", "contains(text, '!')"),
    ("has_colon", "contains(text, ':')"),
    ("has_quote", "contains(text, '\"')"),
    ("has_brace", "contains(text, '{')"),
    ("has_upper_run", "text rlike '[A-Z]{3}'"),
    ("has_long_number", "text rlike '[0-9]{5}'"),
    ("over_1000_chars", "length(text) > 1000"),
    ("over_5000_chars", "length(text) > 5000"),
    ("is_english", "lang = 'en'"),
    ("starts_upper", "text rlike '^[A-Z]'"),
    ("ends_stop", "endswith(text, '.')"),
]


def key_array(keys: list[tuple[str, str]]) -> Column:
    """Numbers of the predicates that hold. A NULL predicate counts as no."""
    hits = [F.when(F.expr(cond), F.lit(i)) for i, (_, cond) in enumerate(keys, start=1)]
    return F.array_compact(F.array(*hits))


def key_fingerprint(df: DataFrame, row_id: str, keys: list[tuple[str, str]] = TEXT_KEYS) -> DataFrame:
    """Long form (row_id, key) over predefined SQL predicates."""
    return unnest(df, row_id, key_array(keys), "key")
