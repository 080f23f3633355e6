"""Packing against the library's ids, plain best fit and brute-force checks of every sequence."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparsefold.llm import packing, units
from sparsefold.llm.queries import op11_packing

ODD = "aB cé 日本 \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  　 's 've 'LL 1239 ,.!?-_İßΣς̧́Å ﬁ😀<|endoftext|> <|startoftext|>\x00"


def plain(texts, capacity):
    coder = Tokenizer.from_file(packing.TOKENIZER)
    out = []
    for key, text in texts:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start:start + capacity]
            out.append((key, piece, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    return out


def odd_texts():
    rng = random.Random(4)
    singles = list(ODD)
    parts = [*singles, " ", " ", "the", "and", "Hello", "<|endoftext|>", "<|startoftext|>", "I've", "it's"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(600)]
    return [(i, t) for i, t in enumerate([None, "", " ", "   ", "x" * 20_000, "word " * 9000, *made, *made[:40]])]


def held(rows, capacity):
    """Pieces by sequence; asserts that every sequence is gapless and short enough."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return by


@pytest.mark.parametrize("capacity", [1, 7, 64, packing.CAPACITY])
def test_pieces_equal_the_library_and_fill_sequences(spark, tmp_path, capacity):
    texts = odd_texts()
    docs = spark.createDataFrame([(t, k, "x", 1) for k, t in texts] + [("no id", None, "x", 1)], "text string, doc_id long, ids string, part int").repartition(5)
    cut = packing.cut(docs, capacity=capacity)
    cut.write.parquet(f"{tmp_path}/cut")
    packed = packing.pack(spark.read.parquet(f"{tmp_path}/cut"), capacity)
    rows = packed.collect()
    want = Counter(plain([*texts, (None, "no id")], capacity))
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = held(rows, capacity)
    total = sum(n * w[3] for w, n in want.items())
    plain_fit = sum(f.count for f in packing.best_fit([], dict(Counter(r["length"] for r in rows)), capacity))
    assert -(-total // capacity) <= len(sequences) <= plain_fit * 1.01 + 2
    ids = {r["sequence_id"]: (r["ids"], r["lengths"]) for r in packing.sequences(packed).collect()}
    assert ids.keys() == sequences.keys()
    for r in rows:
        own = ids[r["sequence_id"]][0][r["offset"]:r["offset"] + r["length"]]
        assert own == r["ids"] and r["length"] in ids[r["sequence_id"]][1]


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op11_packing(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in rows) == Counter({(1, 0, 4): 2, (None, 0, 1): 1})
    assert len(held(rows, packing.CAPACITY)) == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op11_packing(spark, f"{tmp_path}/none").collect() == []


def test_a_length_of_a_third_of_all_pieces_keeps_its_ranks_apart(spark, tmp_path):
    docs = spark.range(30_000).selectExpr("id doc_id", "if(id % 3 = 0, 'same words here', repeat('a b ', int(id % 90))) text").repartition(16)
    packing.cut(docs, capacity=100).write.parquet(f"{tmp_path}/cut")
    rows = packing.pack(spark.read.parquet(f"{tmp_path}/cut"), 100).collect()
    assert len(rows) == len({(r["sequence_id"], r["offset"]) for r in rows})
    held(rows, 100)


def histograms():
    rng = np.random.default_rng(0)
    for x in (rng.lognormal(5.8, 1, 200_000), rng.integers(1, 2048, 100_000), rng.integers(690, 1400, 50_000), rng.lognormal(5.8, 1, 500), [2047, 1, 2048]):
        yield dict(Counter(np.clip(np.asarray(x).astype(int), 1, 2048).tolist()))


@pytest.mark.parametrize("histogram", list(histograms()))
def test_plan_holds_the_histogram_in_about_the_least_sequences(histogram):
    families = packing.plan(histogram)
    got = Counter()
    for f in families:
        assert f.room == 2048 - sum(n * k for n, k in f.parts) >= 0 < f.count
        for length, times in f.parts:
            got[length] += f.count * times
    assert got == histogram
    assert sum(f.count for f in families) <= 1.002 * sum(f.count for f in packing.best_fit([], dict(histogram), 2048)) + 1


def test_fit_reaches_the_least_squares():
    rng = np.random.default_rng(1)
    rows = packing.patterns(np.array([1, 2, 3, 5, 6, 8]), 12)
    assert {tuple(r) for r in rows} == {(1, 3, 8), (1, 5, 6), (2, 2, 8), (3, 3, 6), (6, 6, 0), (2, 5, 5)}
    goal, weights = rng.integers(0, 50, 13).astype(float), np.arange(13) / 12
    x = packing.fitted(rows, goal, weights)
    matrix = np.array([np.bincount(r, minlength=13) * weights for r in rows]).T
    matrix[0] = 0
    miss = goal * weights - matrix @ x
    assert (x >= 0).all() and (matrix.T @ miss <= 1e-4).all() and np.allclose((matrix.T @ miss)[x > 0], 0, atol=1e-4)


def test_plan_finds_pairs_that_best_fit_misses():
    # Best fit puts 7 beside 3 and strands the threes that belong in fours; both plans need the same room here.
    assert sum(f.count for f in packing.plan({7: 4, 3: 4, 5: 8}, 10)) == 8


def test_words_are_merged_as_by_the_library():
    with open(packing.TOKENIZER, encoding="utf-8") as f:
        coder = packing.WordCoder(f.read())
    rng = random.Random(2)
    letters = "etaoinshrdluETAOIN" + "éßÅçÿÀñü"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 70))) + "".join(rng.choices(".,;:!?|\"()-'_#$%&*+/=@<", k=rng.choice([0, 0, 1, 2]))) for _ in range(20_000)]
    words += ["the", "The", "I've", "it's", "'s", "x's,", "a'", "", "-", "...", "ÿ", "×", "don't."]
    assert coder(words) == coder.by_library(words)


def test_words_cost_by_their_merges(monkeypatch):
    """Pairs are looked up beside merges only, and a word once, whatever marks or capitals it comes with."""
    with open(packing.TOKENIZER, encoding="utf-8") as f:
        coder = packing.WordCoder(f.read())
    rng = random.Random(5)
    words = list({"".join(rng.choices("etaoinshrdlué", k=rng.randint(1, 20))) for _ in range(5_000)})
    want = coder.by_library(words)
    asked = []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda pairs, keys, *a, **k: asked.append(np.size(keys)) or search(pairs, keys, *a, **k))
    assert coder(words) == want
    merges = sum(len(w.encode()) - len(ids) for w, ids in zip(words, want, strict=True))
    assert 0 < sum(asked) <= 2 * merges
    asked.clear()
    forms = [form for w in words for form in (w.upper() if "é" not in w else w, w.title() + ",", w + "...")]
    assert coder(forms) == coder.by_library(forms)
    assert sum(asked) == 0


def test_plain_words_at_every_edge_equal_the_library():
    with open(packing.TOKENIZER, encoding="utf-8") as f:
        coder = packing.WordCoder(f.read())
    letters = [chr(c) for c in range(0x180)]
    odd = [*letters, *(a + b for a in letters for b in ("a", ".", "é", "\u0301")), *("a" * n for n in range(1, 70)), *("É" * n + "!" for n in range(30, 66)),
           *("x" + m * k for m in packing.MARKS for k in (1, 2, 5, 63, 64)), "", "\x00", "a\x00", "a\x00.", "a.\x00", "a.b", ".a", "a.\n", "\u212a", "ﬁ.", "İ.", "Σς."]
    units_ = [u for u in odd if " " not in u]
    assert coder(units_) == coder.by_library(units_)
    assert coder([]) == [] and coder([".", "|x"]) == coder.by_library([".", "|x"])


def test_memo_forgets_without_changing_results():
    memo = units.Memo(lambda new: units.flattened([[len(u)] for u in new]), known=2)
    for some in (["a", "bb"], ["ccc", "a"], ["dddd"], ["a"]):
        numbers = memo.numbered(some)
        flat, starts = memo.tables()
        assert [flat[starts[n]] for n in numbers] == [len(u) for u in some]
