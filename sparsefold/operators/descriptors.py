"""Eleven scalar descriptors per record, and rule flags over descriptors."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparsefold.functions.numeric import nan_to_null
from sparsefold.functions.text import count_class, tokens

DESCRIPTORS = [
    "n_chars", "n_tokens", "n_distinct", "mean_token_len", "longest_token", "type_token_ratio",
    "digit_ratio", "punct_ratio", "upper_ratio", "space_ratio", "n_lines",
]


def scalar_descriptors(df: DataFrame, row_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, 11 doubles). Ratios of an empty text, and word means without words, are NULL."""
    base = df.select(row_id, text, *keep).select(
        row_id, *keep, F.col(text).alias("_t"), tokens(F.col(text)).alias("_tok"))
    t, tok = F.col("_t"), F.col("_tok")
    chars = F.length(t)
    per_char = lambda n: n / F.when(chars > 0, chars)
    words = F.when(F.size(tok) > 0, F.size(tok))
    cols = {
        "n_chars": chars,
        "n_tokens": F.size(tok),
        "n_distinct": F.size(F.array_distinct(tok)),
        "mean_token_len": F.length(F.array_join(tok, "")) / words,
        "longest_token": F.array_max(F.transform(tok, F.length)),
        "type_token_ratio": F.size(F.array_distinct(tok)) / words,
        "digit_ratio": per_char(count_class(t, "0-9")),
        "punct_ratio": per_char(F.length(F.regexp_replace(t, r"[\p{L}\p{N} \t\r\n]", ""))),
        "upper_ratio": per_char(count_class(t, "A-Z")),
        "space_ratio": per_char(chars - F.length(F.replace(t, F.lit(" "), F.lit("")))),
        "n_lines": chars - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1,
    }
    return base.select(row_id, *keep, *[cols[c].cast("double").alias(c) for c in DESCRIPTORS])


OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}

# Drug-likeness filters over molecular descriptors.
MOLECULE_RULES = {
    "lipinski_rule": [("molecular_weight", "<=", 500), ("logp", "<=", 5), ("h_bond_donor", "<=", 5),
                      ("h_bond_acceptors", "<=", 5), ("rotatable_bonds", "<=", 5)],
    "ghose_filter": [("molecular_weight", ">=", 160), ("molecular_weight", "<=", 480), ("logp", ">=", 0.4),
                     ("logp", "<=", 5.6), ("number_of_atoms", ">=", 20), ("number_of_atoms", "<=", 70),
                     ("molar_refractivity", ">=", 40), ("molar_refractivity", "<=", 130)],
    "veber_filter": [("rotatable_bonds", "<=", 10), ("topological_surface_area_mapping", "<=", 140)],
    "rule_of_3": [("molecular_weight", "<=", 300), ("logp", "<=", 3), ("h_bond_donor", "<=", 3),
                  ("h_bond_acceptors", "<=", 3), ("rotatable_bonds", "<=", 3)],
    "REOS_filter": [("molecular_weight", ">=", 200), ("molecular_weight", "<=", 500), ("logp", ">=", -5),
                    ("logp", "<=", 5), ("h_bond_donor", ">=", 0), ("h_bond_donor", "<=", 5),
                    ("h_bond_acceptors", ">=", 0), ("h_bond_acceptors", "<=", 10), ("formal_charge", ">=", -2),
                    ("formal_charge", "<=", 2), ("rotatable_bonds", ">=", 0), ("rotatable_bonds", "<=", 8),
                    ("heavy_atoms", ">=", 15), ("heavy_atoms", "<=", 50)],
    "drug_like": [("molecular_weight", "<", 400), ("num_of_rings", ">", 0), ("rotatable_bonds", "<", 5),
                  ("h_bond_donor", "<=", 5), ("h_bond_acceptors", "<=", 10), ("logp", "<", 5)],
}

# The same six shapes with bounds that split text descriptors.
TEXT_RULES = {
    "rule_short": [("n_chars", "<=", 5000), ("n_tokens", "<=", 800), ("n_distinct", "<=", 400),
                   ("n_lines", "<=", 50), ("longest_token", "<=", 20)],
    "rule_band": [("n_chars", ">=", 160), ("n_chars", "<=", 4800), ("type_token_ratio", ">=", 0.4),
                  ("type_token_ratio", "<=", 1), ("n_tokens", ">=", 20), ("n_tokens", "<=", 700),
                  ("mean_token_len", ">=", 3), ("mean_token_len", "<=", 8)],
    "rule_plain": [("longest_token", "<=", 14), ("punct_ratio", "<=", 0.05)],
    "rule_clean": [("n_chars", "<=", 3000), ("digit_ratio", "<=", 0.03), ("punct_ratio", "<=", 0.03),
                   ("upper_ratio", "<=", 0.03), ("n_lines", "<=", 30)],
    "rule_ranges": [("n_chars", ">=", 200), ("n_chars", "<=", 5000), ("mean_token_len", ">=", 2),
                    ("mean_token_len", "<=", 9), ("digit_ratio", ">=", 0), ("digit_ratio", "<=", 0.05),
                    ("punct_ratio", ">=", 0), ("punct_ratio", "<=", 0.1), ("n_lines", ">=", 1),
                    ("n_lines", "<=", 40), ("space_ratio", ">=", 0.1), ("space_ratio", "<=", 0.25),
                    ("longest_token", ">=", 5), ("longest_token", "<=", 25)],
    "rule_compact": [("n_chars", "<", 4000), ("n_lines", ">", 0), ("longest_token", "<", 18),
                     ("n_distinct", "<=", 500), ("n_tokens", "<=", 900), ("mean_token_len", "<", 8)],
}


def rule_columns(rules: dict[str, list[tuple[str, str, float]]]) -> dict[str, Column]:
    """A 0/1 column per rule: 1 when every bound holds. A missing or NaN operand gives 0."""
    def flag(bounds):
        checks = [OPS[op](nan_to_null(F.col(c).cast("double")), F.lit(float(b))) for c, op, b in bounds]
        return F.when(reduce(operator.and_, checks), 1).otherwise(0)

    return {name: flag(bounds) for name, bounds in rules.items()}


def rule_flags(df: DataFrame, row_id: str, rules: dict[str, list[tuple[str, str, float]]]) -> DataFrame:
    return df.select(row_id, *[flag.alias(name) for name, flag in rule_columns(rules).items()])
