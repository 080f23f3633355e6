"""SentencePiece against the library, chat formatting by round trips."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from sparsefold.llm import chat, pieces
from sparsefold.llm.queries import op7_pieces, op8_chat

ALPHABET = "abcdeinorst  ABé①日本中文한국어😀\n\t▁.,!?=(){}0123456789_-\x00"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def odd_texts():
    rng = random.Random(1)
    fixed = ["", " ", "  ", "   x", "x   ", "a" * 5000, " " * 40, " " * 41 + "🎉", " " * 300 + "a", "▁a▁▁b", "\x00", "a\x00", "  🎉  🎉", "Hello  world", "the the the"]
    return fixed + ["".join(rng.choices(ALPHABET, k=rng.randint(1, 80))) for _ in range(1500)]


def test_ids_equal_the_library_and_decode(vocabulary):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = odd_texts()
    offsets, ids = vocabulary.encode(texts)
    for i, t in enumerate(texts):
        own = ids[offsets[i]:offsets[i + 1]]
        assert own.tolist() == lib.encode(t), repr(t[:60])
        assert vocabulary.decode(own) == t.replace("▁", " ")


def test_long_words_equal_the_library(vocabulary):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdeinorst", k=n)) for n in (510, 511, 512, 513, 3000)] + ["the" * 900, "é日😀x" * 400, "-" * 2000, "".join(rng.choices(ALPHABET.replace(" ", ""), k=5000))]
    offsets, ids = vocabulary.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == lib.encode(t), t[:20]


def test_a_million_letters_take_seconds(vocabulary):
    word = "".join(random.Random(7).choices("etaoinshrdlu", k=1_000_000))
    start = time.perf_counter()
    _, ids = vocabulary.encode([word])
    assert time.perf_counter() - start < 60
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(word)


def test_texts_are_compared_byte_by_byte(vocabulary):
    texts = ["a b", "", "x  y", "é日", "", "end"]
    offsets, ids = vocabulary.encode(texts)
    assert vocabulary.spelt(offsets, ids, pa.array(texts)).all()
    assert vocabulary.spelt(offsets, ids, pa.array(["a c", "", "x  y", "e日", "z", "end"])).tolist() == [False, True, True, False, False, True]
    assert vocabulary.spelt(offsets, ids, pa.array(["", *texts[1:]]).slice(0)).tolist() == [False] + [True] * 5
    padded = pa.array(["zz", *texts]).slice(1)
    assert vocabulary.spelt(offsets, ids, padded).all()


def test_long_merging_agrees_with_short(vocabulary):
    for t in ("a" * 60, "▁" * 63, "theinre" * 8):
        assert vocabulary.merged(t) == vocabulary.merged_long(t)


def test_unigram_model_takes_the_best_path():
    names = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "bab", "c"]
    scores = [-2.0, -3.1, -3.3, -4.05, -4.2, -6.7, -4.4, -7.3, -5.5]
    v = pieces.Vocabulary(names, scores, [True] * 9, [n.encode() for n in names], [], 99, False)

    def best(t):
        top = [(0.0, [])] + [(-np.inf, None)] * len(t)
        for j in range(1, len(t) + 1):
            for i in range(j):
                if t[i:j] in names and top[i][1] is not None:
                    k = names.index(t[i:j])
                    top[j] = max(top[j], (top[i][0] + scores[k], [*top[i][1], k]), key=lambda x: x[0])
        return top[-1]

    rng = random.Random(2)
    texts = ["".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(300)]
    offsets, ids = v.encode(texts)
    for i, t in enumerate(texts):
        own = ids[offsets[i]:offsets[i + 1]].tolist()
        assert "".join(names[p] for p in own) == "▁" + t and sum(scores[p] for p in own) == pytest.approx(best("▁" + t)[0])
    assert v.encode(["z"])[1].tolist() == [0, 99]


def test_query_and_decoding(spark, tmp_path, vocabulary):
    rows = [(1, "Hello  wörld\n", "x"), (2, None, "x"), (2, "", None), (None, "a b", "x"), (1, "Hello  wörld\n", "x"), (3, "x▁y", "z")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = sorted(((r["doc_id"], r["n_ids"], r["ids"], r["decoded"]) for r in op7_pieces(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, len(w), w, True) for i, t, _ in rows for w in [lib.encode(t or "")]), key=str)
    back = pieces.decode(op7_pieces(spark, str(tmp_path)), vocabulary)
    assert sorted(r["text"] for r in back.collect()) == sorted((t or "").replace("▁", " ") for _, t, _ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(empty, vocabulary).count() == 0


def expected(rows):
    groups = {}
    for c, t, r, x in sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1] is not None, q[1] or 0, q[2] is not None, (q[2] or "").encode(), q[3] is not None, (q[3] or "").encode())):
        groups.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def chats():
    rng = random.Random(3)
    odd = [*chat.CONTROLS, "\\", "\\\\", "<", "|", "[", "a", " ", "\n", "é", "日", "😀", "ok", "<\\|turn|>", "<<SYS", "<|turn<|turn|>", ""]
    rows = [(i, t, rng.choice(["user", "assistant", "system", "<|says|>", None]), "".join(rng.choices(odd, k=rng.randint(0, 9)))) for i in range(60) for t in range(rng.randint(1, 6))]
    return rows + [(7, 1, "assistant", None), (7, 1, "assistant", None), (None, 2, "assistant", "no id"), (None, None, "user", "x"), (500, 0, "assistant", "long " * 4000)] \
        + [(600, t, "assistant" if t % 2 else "user", f"turn {t} " * 9) for t in range(3000)]


@pytest.mark.parametrize("chunk_chars,hot_rows", [(1, 100_000), (5000, 500), (5000, 0), (chat.CHUNK_CHARS, 100_000)])
def test_chats_read_back(spark, chunk_chars, hot_rows):
    rows = chats()
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, chunk string").repartition(7)
    formatted = chat.format_chats(df, chunk_chars=chunk_chars, hot_rows=hot_rows)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for c, w in want.items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == w, c


def test_chunks_do_not_change_tokens(spark):
    df = spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string")
    whole, cut = ({}, {})
    for out, size in ((whole, 1 << 30), (cut, 300)):
        for r in sorted(chat.format_chats(df, chunk_chars=size).collect(), key=lambda r: (str(r["conv_id"]), r["chunk"])):
            ids, mask = out.setdefault(r["conv_id"], ([], []))
            ids += r["ids"]
            mask += r["loss_mask"]
    assert whole == cut


def test_chat_query_adds_the_control_conversation(spark, tmp_path):
    rows = [(3, 1, "assistant", "b"), (3, 0, "user", "a")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op8_chat(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert set(got) == {-1, 3}
    assert got[-1]["loss_chars"] == len(said) and got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r["conv_id"] for r in op8_chat(spark, f"{tmp_path}/none").collect()] == [-1]
