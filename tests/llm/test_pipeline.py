"""Toxicity by held-out accuracy, and each stage of the pipeline against a brute-force version on its own input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from sparsefold.llm import bktree, mixing, pieces, secrets, toxicity
from sparsefold.llm.queries import op4_toxicity
from tests.llm.test_mixing import plain_count
from tests.llm.test_simhash import components, shingle_fp

INSULTS = ["idiot", "moron", "loser", "scum", "worthless", "zorgfleck", "zorgmund"]


def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("aeioutnrsl", k=rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        words = rng.choices(vocabulary, k=rng.randint(20, 90))
        toxic = i % 5 == 0
        if toxic:
            for w in rng.choices(INSULTS, k=4):
                words.insert(rng.randrange(len(words)), rng.choice([w, w.upper(), "you " + w]))
        if i % 11 == 3:
            words.insert(5, "token=abcdef123456ABCDEF" if i % 2 else f"password=Zx81Qw92Er{i}Ty")
        docs.append((i, " ".join(words), "en", f"src{i % 4 if i % 3 else 0}"))
        if i % 10 != 9:
            labels.append((i, int(toxic)))
    docs += [(2000 + i, docs[i][1], "en", "copy") for i in range(1, 60, 3)] + [(2100 + i, docs[i][1].upper().replace(" ", "\n", 1), "en", "copy") for i in range(1, 60, 4)]
    docs += [(3000, None, None, None), (3001, "", "en", "src1"), (3002, " \t ", "en", "src1"), (None, "no id here", "en", "src2"), (3003, "no id  here", "en", "src2")]
    return docs, labels


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    docs, labels = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, a, s, len(t or ""), "extra") for i, t, a, s in docs], "doc_id long, text string, lang string, source string, n_chars long, ids string") \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (7, None), (8, 0)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, base):
    out = [spark.read.parquet(f"{base}/documents.parquet")]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], base).write.parquet(f"{base}/stage{at}")
        out.append(spark.read.parquet(f"{base}/stage{at}"))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_held_out_accuracy_and_scores(spark, base):
    got = rows(op4_toxicity(spark, base))
    docs, _ = corpus()
    assert len(got) == len(docs)
    toxic = {i for i, *_ in docs if i is not None and (i < 900 and i % 5 == 0)}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == (r["doc_id"] in toxic) for r in held)
    assert len(held) > 150 and right / len(held) > 0.97


def test_features():
    lexicon = toxicity.Lexicon({"zorg": 2.5}, {"zorgf": 3.0})
    f = toxicity.features_of(["", "you are an IDIOT !!", "1d10t zorg zorgfleck", "a\x00 a"], lexicon, {}, [])
    assert f.shape == (4, toxicity.N_FEATURES) and not f[0].any()
    assert f[1][1] == pytest.approx(1 / 5) and f[1][11] == 1 and f[1][15] == pytest.approx(1 / 5)
    assert f[2][13] > 0 and f[2][3] == pytest.approx(1 / 3) and f[2][9] == 3.0
    again = toxicity.features_of(["you are an IDIOT !!"], lexicon, {}, [])
    assert np.array_equal(again[0], f[1])


def plain_features(text, lexicon):
    """The features of one text, token by token."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * toxicity.N_FEATURES
    insult, word, odds, stem, stem_odds, second, hidden, disguised = [], [], [], [], [], [], [], []
    caps = letters = digits = marks = shouts = bangs = 0
    for t in tokens:
        low = t.lower()
        core = re.sub(r"^[\W_]+|[\W_]+$", "", low)
        plain = re.sub(r"(.)\1{2,}", r"\1", "".join("oieastasi"["013457@$!".index(c)] if c in "013457@$!" else c for c in low))
        plain = "".join(c for c in re.sub(r"^[\W_]+|[\W_]+$", "", plain) if c.isalpha())
        own = [sum(map(f, t)) for f in (str.isupper, str.isalpha, str.isdigit)]
        insult.append(core in toxicity.INSULTS)
        word.append(lexicon.words.get(core, 0.0))
        stem.append(lexicon.stems.get(core[:5], 0.0) if len(core) > 5 else 0.0)
        second.append(core in toxicity.SECOND_PERSON)
        hidden.append(bool(toxicity.INNER.search(t) or re.search(r"(.)\1{2,}", low)))
        disguised.append(core not in toxicity.INSULTS and plain in toxicity.INSULTS)
        caps, letters, digits, marks = caps + own[0], letters + own[1], digits + own[2], marks + len(t) - own[1] - own[2]
        shouts += own[1] > 2 and own[0] == own[1]
        bangs += t.count("!") + t.count("?")
    bad = [i for i in range(n) if insult[i] or word[i] > 0 or stem[i] > 0 or disguised[i]]
    close = sum(any(second[max(0, i - 5):i + 6]) for i in bad)
    chars = max(letters + digits + marks, 1)
    n_word, n_stem = sum(w > 0 for w in word), sum(x > 0 for x in stem)
    return [np.log1p(n), sum(insult) / n, np.log1p(sum(insult)), n_word / n, np.log1p(n_word), sum(word) / n, n_stem / n, np.log1p(n_stem), sum(stem) / n,
            max(word + stem), sum(second) / n, close / max(len(bad), 1), sum(hidden) / n, np.log1p(sum(disguised)), caps / max(letters, 1), shouts / n, marks / chars,
            bangs / n, digits / chars, letters / n]


def walked(node, x):
    while node.subtreeDepth() > 0:
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def pooled(points):
    """Isotonic means by pooling adjacent violators: [(first, last, mean)]."""
    merged = {}
    for x, y in points:
        merged.setdefault(x, []).append(y)
    pools = []
    for x in sorted(merged):
        pools.append([x, x, sum(merged[x]), len(merged[x])])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return [(a, b, t / n) for a, b, t, n in pools]


def test_scores_equal_a_plain_walk_through_the_fitted_model(spark, base):
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scorer = toxicity.fit(docs, labels)
    trees = [(w, t._java_obj.rootNode()) for w, t in zip(scorer.trees.treeWeights, scorer.trees.trees, strict=True)]

    def raw(text):
        x = plain_features(text, scorer.lexicon)
        return 1 / (1 + np.exp(-2 * sum(w * walked(node, x) for w, node in trees)))

    texts, toxic = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {}
    for r in labels.collect():
        if r["doc_id"] in texts and r["doc_id"] is not None and r["toxic"] is not None:
            toxic[r["doc_id"]] = max(r["toxic"], toxic.get(r["doc_id"], 0))
    checked = [(raw(texts[i]), y) for i, y in toxic.items() if zlib.crc32(str(i).encode()) % 4 == 3]
    pools = pooled(checked)
    xs, ys = [v for a, b, _ in pools for v in (a, b)], [m for *_, m in pools for _ in range(2)]
    some = scorer.score(docs.where("doc_id % 3 = 0 or doc_id is null or doc_id >= 2000"), "text").select("text", "score").collect()
    assert len(some) > 300
    for r in some:
        x = raw(r["text"] or "")
        assert r["score"] == pytest.approx(0.98 * np.interp(x, xs, ys) + 0.02 * x, abs=1e-6), r["text"]


def test_usual_tokens_take_the_short_way_to_the_same_row():
    rng = random.Random(9)
    lexicon = toxicity.Lexicon({"zorg": 2.5, "ab": 1.0}, {"zorgf": 3.0})
    words = ["zorg", "Zorg", "zorgfleck", "you", "You.", "idiot,", "IDIOT", "Idiot", "É", "éa", "a", "A", "I", "i", "zorg..", "zorg!", "loooser", "ab;", "İx", "ßa", "x1", ".", "日本", "ǅa"]
    words += ["".join(rng.choices("abzorgfleckABÉé.,:;!13@", k=rng.randint(1, 9))) for _ in range(5000)]
    for w in words:
        assert toxicity.token_row(w, lexicon) == toxicity.odd_token_row(w, lexicon), w


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0), (4, 0)]])
def test_without_both_classes_scores_are_constant(spark, labels):
    docs = spark.createDataFrame([(i, "you idiot", 1) for i in range(30)], "doc_id long, text string, score int")
    scorer = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r["score"] for r in scorer.score(docs, "text").collect()} == {0.0}
    assert scorer.score(docs.limit(0), "text").count() == 0


def test_toxic_rows_go(stages):
    toxic = {i for i, t, *_ in corpus()[0] if i is not None and i < 900 and i % 5 == 0}
    before, after = rows(stages[0]), rows(stages[1])
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) < 0.02 * len(before)
    assert {tuple(sorted(r.items(), key=str)) for r in after} <= {tuple(sorted(r.items(), key=str)) for r in before}


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    fps = [shingle_fp(r["text"] or "") for r in before]
    root = components(set(fps), bktree.RADIUS)
    best = {}
    for r, f in zip(before, fps, strict=True):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        best[root[f]] = min(best.get(root[f], (key, None)), (key, None))
    want = sorted((k[0][1] if not k[0][0] else None for k in best.values()), key=str)
    assert sorted((r["doc_id"] for r in after), key=str) == want and len(after) < len(before)


def test_live_secrets_are_masked(stages):
    before, after = {r["doc_id"]: r for r in rows(stages[2])}, {r["doc_id"]: r for r in rows(stages[3])}
    pattern = re.compile(r"(?:password|token)=([A-Za-z0-9]+)")
    owners = {}
    for r in before.values():
        for m in pattern.finditer(r["text"] or ""):
            owners.setdefault(m[1], set()).add(r["source"])
    n = Counter()
    for i, r in before.items():
        want = r["text"] and pattern.sub(lambda m: m[0] if len(owners[m[1]]) >= secrets.MIN_OWNERS else secrets.MASK, r["text"])
        assert after[i]["text"] == want and after[i]["n_chars"] == len(want or ""), i
        n[want == r["text"]] += 1
    assert set(after) == set(before) and n[False] > 10


def test_mixture(stages):
    before, after = rows(stages[3]), rows(stages[4])
    size = Counter()
    for r in before:
        size[r["source"]] += len(r["text"] or "")
    weight = {s: n ** mixing.ALPHA for s, n in size.items() if n}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / n if n else 1.0 for s, n in size.items()}
    want = Counter()
    for r in before:
        want[r["doc_id"]] += plain_count(r["doc_id"], rate[r["source"]])
    assert Counter(r["doc_id"] for r in after) == +want and stages[4].columns == stages[0].columns


def test_tokens_and_whole_run(spark, base, stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r["doc_id"]: r["text"] for r in rows(stages[4])}
    last = rows(stages[5])
    for r in last:
        assert r["ids"] == lib.encode(texts[r["doc_id"]] or "") and r["decoded"]
    assert len(last) == stages[4].count()
    key = lambda r: str(sorted(r.items()))
    assert sorted(map(key, rows(corpus_pipeline.run(spark, base)))) == sorted(map(key, last))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
