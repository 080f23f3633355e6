"""Mixing against its SQL twin and a plain inversion; SQL twins of the other operators."""

import hashlib
import math
from collections import Counter

import pytest

from sparsefold.llm import mixing
from sparsefold.llm.queries import ORACLES, QUERIES
from tests.oracle import duck, mismatch


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    base = "/root/testdata/sf0.01"
    assert mismatch(QUERIES[name](spark, base), duck(base), ORACLES[name]) is None


def plain_count(identity, rate, seed=mixing.SEED):
    n = max(1, math.ceil(rate / mixing.PART))
    mean, out = rate / n, 0
    for j in range(1, n + 1):
        u = int(hashlib.md5(f"count{seed}:{identity}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = below = math.exp(-mean)
        k = 0
        while below <= u and k < mixing.TERMS:
            k += 1
            p = p * mean / k
            below += p
        out += k
    return out


def test_counts_follow_rates_and_edge_rows(spark):
    rows = [(i, "x" * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    rows += [(None, "y", None), (None, "y", None), (9000, None, "big"), (9001, "", "hollow"), (9002, None, "hollow"), (5, "xxxxxx", "big")]
    df = spark.createDataFrame([(*r, "c", -1) for r in rows], "doc_id long, text string, source string, copy string, row int")
    got = mixing.mix(df).collect()
    size, total = Counter(), sum(len(t or "") for _, t, _ in rows)
    for _, t, s in rows:
        size[s] += len(t or "")
    weight = {s: n ** mixing.ALPHA for s, n in size.items()}
    want = Counter()
    for i, t, s in rows:
        rate = weight[s] / sum(weight.values()) * total / size[s] if size[s] else 1.0
        want[i, t, s] += plain_count(i if i is not None else hashlib.md5((t or "").encode()).hexdigest(), rate)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == +want
    assert {r["row"] for r in got} == {-1} and min(r["copy"] for r in got) == 1
    chars = Counter()
    for r in got:
        chars[r["source"]] += len(r["text"] or "")
    for s, w in weight.items():
        if size[s] > 300:
            assert chars[s] == pytest.approx(w / sum(weight.values()) * total, rel=0.2)
    assert mixing.mix(df.limit(0)).count() == 0


def test_given_weights_high_rates_and_shuffle_join(spark, monkeypatch):
    rows = [(i, "ab", "rare" if i < 20 else "common") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"rare": 0.5, "common": 0.5, "absent": 5}
    plain = sorted(map(tuple, mixing.mix(df, weights=weights).collect()))
    n = Counter(r[2] for r in plain)
    assert n["rare"] == sum(plain_count(i, 50.0) for i in range(20)) and 800 < n["common"] < 1200
    monkeypatch.setattr(mixing, "broadcast_if_small", lambda table, row_bytes: table)
    assert sorted(map(tuple, mixing.mix(df, weights=weights).collect())) == plain
    assert {r["source"] for r in mixing.mix(df, weights={"rare": 1}).collect()} == {"rare"}


def test_positions_spread_copies_over_the_whole_order(spark):
    df = spark.createDataFrame([(i, "ab", "s") for i in range(500)], "doc_id long, text string, source string")
    got = sorted(mixing.mix(df, epochs=4.0).collect(), key=lambda r: r["position"])
    first = Counter(r["doc_id"] for r in got[:len(got) // 2])
    assert max(first.values()) < 15 and len({r["position"] for r in got}) == len(got)
    assert abs(sum(r["doc_id"] for r in got[:1000]) / 1000 - 249.5) < 25
