"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Labelled rows are told apart by crc32 of the id: remainder 0 of 4 teaches the lexicon (words and word beginnings that
toxic texts hold far more often), 1 the trees, 3 the calibration; 2 is never used. Of each part at most ``max_rows``
labelled rows are taken, in order of a hash, so fitting stays bounded while every text is scored whole.

A null or empty text has all-zero features and is scored like any other. Rows without an id are scored and never
learnt from; of repeated labels the greatest counts; a part without both classes leaves its step out (no calibration,
or the share of toxic labels as everyone's score). Repeated rows get equal scores, an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from sparsefold.llm.shared import numbered, stored, whole

MAX_ROWS = 20_000
LEXICON_SIZE = 4000
LEAST_TOXIC, LEAST_ODDS = 3, 2.0
THRESHOLD = 0.3
HELD_OUT = 2
STEM = 5
NEAR = 5
TOKENS_AT_ONCE = 200_000
KNOWN_TOKENS = 300_000
TREES = {"maxIter": 25, "maxDepth": 4, "stepSize": 0.2, "seed": 11, "maxBins": 64}

#: Common insults, stated as they are.
INSULTS = frozenset("""
    idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage clown disgusting imbecile cretin fool jerk
    bastard pig vermin filth freak creep coward liar ugly hate shut kill die
    dumm blöd trottel depp abschaum widerlich crétin débile ordure dégoûtant estúpido tonto imbécil basura asqueroso
""".split())
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
RUN = re.compile(r"(.)\1{2,}")
INNER = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_][\d@$!]+[^\W\d_]")

#: Summed per token: insult, learnt word, its odds, learnt stem, its odds, second person, obfuscated, disguised insult, capitals, letters, digits,
#: marks, shouted word, exclamation.
N_SUMS = 14
N_FEATURES = 20


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]


def token_row(token: str, lexicon: Lexicon) -> tuple:
    word = token.rstrip(".,;:")
    low = word.lower()
    if word.isalpha() and (word == low or word[1:] == low[1:]) and not RUN.search(low):
        # Most tokens: letters, lower case or capitalised, with a mark behind them at most.
        caps, size = sum(c.isupper() for c in word[:1]), len(word)
        odds, stem = lexicon.words.get(low, 0.0), lexicon.stems.get(low[:STEM], 0.0) if size > STEM else 0.0
        return (low in INSULTS, odds > 0, odds, stem > 0, stem, low in SECOND_PERSON, False, False, caps, size, 0, len(token) - size, False, 0)
    return odd_token_row(token, lexicon)


def odd_token_row(token: str, lexicon: Lexicon) -> tuple:
    low = token.lower()
    core = EDGE.sub("", low)
    plain = EDGE.sub("", RUN.sub(r"\1", low.translate(LEET)))
    plain = "".join(c for c in plain if c.isalpha())
    hidden = core not in INSULTS and plain in INSULTS
    letters = sum(c.isalpha() for c in token)
    caps = sum(c.isupper() for c in token)
    digits = sum(c.isdigit() for c in token)
    stem = lexicon.stems.get(core[:STEM], 0.0) if len(core) > STEM else 0.0
    word = lexicon.words.get(core, 0.0)
    return (core in INSULTS, word > 0, word, stem > 0, stem, core in SECOND_PERSON, bool(INNER.search(token) or RUN.search(low)), hidden, caps, letters, digits,
            len(token) - letters - digits, letters > 2 and caps == letters, token.count("!") + token.count("?"))


def features_of(texts: list[str], lexicon: Lexicon, known: dict[str, int], table: list[tuple]) -> np.ndarray:
    """One row per text. ``known`` and ``table`` keep what was worked out for tokens before."""
    lists = [t.split() for t in texts]
    lengths = np.array([len(x) for x in lists])
    out = np.zeros((len(texts), N_FEATURES))
    full = np.flatnonzero(lengths)
    if not full.size:
        return out
    codes, tokens = numbered([w for x in lists for w in x])
    for w in tokens:
        if w not in known:
            known[w] = len(table)
            table.append(token_row(w, lexicon))
    unique = np.array([table[known[w]] for w in tokens], dtype=float)
    ends = np.cumsum(lengths[full])
    starts = ends - lengths[full]
    sums = np.stack([np.add.reduceat(unique[codes, j], starts) for j in range(N_SUMS)], axis=1)
    n, letters = lengths[full].astype(float), np.maximum(sums[:, 9], 1)
    bad = (unique[:, 0] + unique[:, 1] + unique[:, 3] + unique[:, 7] > 0)[codes]
    before = np.concatenate([[0], np.cumsum(unique[:, 5][codes])])
    at = np.flatnonzero(bad)
    of = np.searchsorted(ends, at, side="right")
    near = before[np.minimum(at + NEAR + 1, ends[of])] - before[np.maximum(at - NEAR, starts[of])] > 0
    hits, close = np.bincount(of, minlength=len(full)), np.bincount(of, weights=near, minlength=len(full))
    strongest = np.maximum.reduceat(np.maximum(unique[:, 2], unique[:, 4])[codes], starts)
    chars = np.maximum(sums[:, 9] + sums[:, 10] + sums[:, 11], 1)
    out[full] = np.stack([np.log1p(n), sums[:, 0] / n, np.log1p(sums[:, 0]), sums[:, 1] / n, np.log1p(sums[:, 1]), sums[:, 2] / n, sums[:, 3] / n,
                          np.log1p(sums[:, 3]), sums[:, 4] / n, strongest, sums[:, 5] / n, close / np.maximum(hits, 1), sums[:, 6] / n, np.log1p(sums[:, 7]),
                          sums[:, 8] / letters, sums[:, 12] / n, sums[:, 11] / chars, sums[:, 13] / n, sums[:, 10] / chars, sums[:, 9] / n], axis=1)
    return out


def feature_column(text: Column, lexicon: Lexicon) -> Column:
    @F.pandas_udf("array<double>")
    def dense(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        rows: list[tuple] = []
        for batch in batches:
            done, part, size = [], [], 0
            for t in batch:
                part.append(t or "")
                size += len(part[-1]) // 5
                if size > TOKENS_AT_ONCE:
                    done += list(features_of(part, lexicon, known, rows))
                    part, size = [], 0
                if len(rows) > KNOWN_TOKENS:
                    known, rows = {}, []
            if part:
                done += list(features_of(part, lexicon, known, rows))
            yield pd.Series(done, dtype=object)

    return dense(text)


def part_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """(part, text, y), stored: at most ``max_rows`` labels of each part that may be learnt from, with their texts."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").cast("double").alias("y"))
    marked = known.withColumn("part", part_of(F.col("id"))).where(F.col("part") != HELD_OUT)
    taken = [marked.where(F.col("part") == p).orderBy(F.xxhash64("id"), "id").limit(max_rows) for p in (0, 1, 3)]
    few = taken[0].unionByName(taken[1]).unionByName(taken[2])  # at most three times max_rows rows of three numbers
    return stored(docs.select(F.col(doc_id).alias("id"), whole(text).alias("text")).join(F.broadcast(few), "id").select("part", "text", "y"))


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> Lexicon:
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1.0, 0), total.get(0.0, 0)
    if not toxic or not clean:
        return Lexicon({}, {})
    cores = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    stems = F.transform(F.filter(cores, lambda w: F.length(w) > STEM), lambda w: F.substring(w, 1, STEM))

    def odds(units: Column) -> dict[str, float]:
        each = rows.select("y", F.explode(F.array_distinct(units)).alias("unit")).groupBy("unit").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
        score = F.log((F.col("t") + 0.5) / toxic) - F.log((F.col("c") + 0.5) / clean)
        best = each.where(F.col("t") >= LEAST_TOXIC).withColumn("odds", score).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.log1p("t")), "unit").limit(size)
        return {r["unit"]: r["odds"] for r in best.collect()}

    return Lexicon(odds(cores), odds(stems))


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: object | None
    curve: object | None
    share: float

    def score(self, df: DataFrame, text: str, out: str = "score") -> DataFrame:
        """``df`` with ``out``. The calibrated value is mixed with a fiftieth of the trees' own, which keeps their order
        inside the curve's steps."""
        if self.trees is None:
            return df.withColumn(out, F.lit(self.share))
        names = [c for c in df.columns if c != out]
        x = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), array_to_vector(feature_column(whole(text), self.lexicon)).alias("features"))
        raw = self.trees.transform(x).select("row", vector_to_array("probability")[1].alias("raw"))
        if self.curve is not None:
            raw = self.curve.transform(raw).withColumn("raw", 0.98 * F.col("curve") + 0.02 * F.col("raw"))
        return raw.select("row.*", F.least(F.greatest("raw", F.lit(0.0)), F.lit(1.0)).alias(out))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Scorer:
    rows = labelled(docs, labels, doc_id, text, label, max_rows)
    lexicon = learn_lexicon(rows.where("part = 0"))
    seen = stored(rows.where("part <> 0").select("part", F.col("y").alias("label"), array_to_vector(feature_column(F.col("text"), lexicon)).alias("features")))
    learn, check = seen.where("part = 1"), seen.where("part = 3")
    share = rows.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0]
    if learn.select("label").distinct().count() < 2:
        return Scorer(lexicon, None, None, share)
    trees = GBTClassifier(**TREES).fit(learn)
    raw = stored(trees.transform(check).select("label", vector_to_array("probability")[1].alias("raw")))
    both = raw.select("label").distinct().count() == 2
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="curve").fit(raw) if both else None
    return Scorer(lexicon, trees, curve, share)
