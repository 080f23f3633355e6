"""Alignment against a brute-force version that encodes whole texts with both libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import sentencepiece
from tokenizers import Tokenizer

from sparsefold.llm import alignment, units
from sparsefold.llm.queries import op13_alignment

ODD = ["a", "b", "é", "日本", "한", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'ve", "12", "3.", ",", "?!", "ß", "Å", "ﬁ", "😀", "👩‍👩‍👧",
       "<|endoftext|>", "<s>", "</s>", "\x00", "the", "and", "Hello", "ing", " ", " ", " ", " ", "  ", "\n ", " \n", "́", "‍"]


def texts():
    rng = random.Random(9)
    made = ["".join(rng.choices(ODD, k=rng.randint(1, 40))) for _ in range(1200)]
    prose = [" ".join(rng.choices(["the", "cat", "sat", "unbelievable", "tokenization", "Haus", "été", "niño"], k=rng.randint(1, 60))) for _ in range(200)]
    return [None, "", " ", "  ", "   \n", "▁", "a ▁ b", "x" * 5000, " " * 300, "word " * 5000, *made, *prose, *prose[:50]]


def brute(rows):
    a_coder, b_coder = Tokenizer.from_file(alignment.BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=alignment.SENTENCE)
    a_coder.encode_special_tokens = True
    chars = {c: b for b, c in enumerate(units.byte_chars())}
    out, links = [], []
    for key, text in rows:
        a = a_coder.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        spell_a = [bytes(chars[c] for c in a_coder.id_to_token(i)) for i in a]
        spell_b = [bytes([int(p[3:5], 16)]) if b_coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_coder.id_to_piece, b))]
        if text and not b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
            a = b = spell_a = spell_b = []
        spans = []
        for spelt in (spell_a, spell_b):
            at, own = 0, []
            for t in spelt:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for i, (x, y) in zip(ids, own) if start <= x and y <= e) for ids, own in ((a, spans[0]), (b, spans[1]))))
            start = e
        met, j = [], 0
        for i, (x, y) in enumerate(spans[0]):
            while j and spans[1][j - 1][1] > x:
                j -= 1
            while j < len(b) and spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < y:
                met.append((a[i], b[k]))
                k += 1
        links.append(met)
        out.append([key, len(a), len(b), len(groups), len(met), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = Counter(p for met in links for p in met)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter((*row[:5], sum(count[p] == best[p[1]] for p in met), sum(count[p] for p in met), row[5]) for row, met in zip(out, links, strict=True))


def got(df):
    return Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, links string, row int").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert got(op13_alignment(spark, str(tmp_path))) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    path = f"{tmp_path}/aligned"
    alignment.align(docs, keep_groups=True).write.parquet(path)
    aligned = spark.read.parquet(path)
    cut = alignment.scored(aligned, alignment.pair_counts(aligned), alignment.vocabulary_size(), pairs_at_once=500)
    assert got(cut.withColumnRenamed("id", "doc_id")) == want
    for r in aligned.collect():
        said, i, j = [], 0, 0
        for n, m in zip(r["a_sizes"], r["b_sizes"], strict=True):
            said.append(f"{','.join(map(str, r['a_ids'][i:i + n]))}|{','.join(map(str, r['b_ids'][j:j + m]))}")
            i, j = i + n, j + m
        assert (i, j) == (r["n_a"], r["n_b"]) and r["groups_sha256"] == (hashlib.sha256(";".join(said).encode()).hexdigest() if said else "")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_alignment(spark, str(tmp_path)).collect() == []


def test_words_keep_the_text():
    for t in texts():
        if t:
            assert " ".join(alignment.words_of(t)) == t
