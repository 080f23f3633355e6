"""Repair against a brute-force search over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from sparsefold.llm import repair
from sparsefold.llm.queries import ORACLES, op12_repair
from tests.oracle import mismatch

TEXTS = ["Hello.", "Yes", "Why?", "", " ", "\t\r\n", "Go! ", "No... ok", "é\xa0", "\xa0", "End.\n", None]


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows):
    """Least (cost, audit, repaired) of a conversation by trying edits from every state, remembered from the end."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    following = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}
    for i in range(len(rows), -1, -1):
        own = {s: [] for s in following}
        for s in following:
            if i == len(rows):
                if s in ("", "a"):
                    own[s].append((0, "", ()))
                continue
            _, role, text = rows[i]
            if best[i + 1][s]:
                c, e, r = best[i + 1][s]
                own[s].append((c + 3, "D" + e, r))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                for new, price, edit in [(role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")]:
                    if new and new[0] in following[s] and best[i + 1][new[0]]:
                        c, e, r = best[i + 1][new[0]]
                        own[s].append((c + price + extra, edit + e, ((new, text), *r)))
        now = {s: min(f, default=None) for s, f in own.items()}
        for _ in range(4):
            for s in following:
                for new in ("user", "assistant"):
                    if new[0] in following[s] and now[new[0]]:
                        c, e, r = now[new[0]]
                        now[s] = min(x for x in (now[s], (c + 2, "I" + e, ((new, ""), *r))) if x)
        best[i] = now
    return best[0][""], faults


def expected(rows, tie=lambda r: (r[1], r[2])):
    out = {}
    for conv, own in damaged(rows).items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, *tie(r)))
        (cost, audit, turns), faults = brute(own)
        known = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        said = "\n".join(f"{r}:{t}" for r, t in turns)
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256(said.encode()).hexdigest())
    return out


def conversations(n=300):
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "sys"]
    rows = [(c, t if rng.random() < 0.9 else t + 3, rng.choice(roles), rng.choice([*TEXTS, f"say {t}.", f"say {t}"])) for c in range(n) for t in range(rng.randint(1, 14))]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"long {t % 700}" + "." * (t % 3)) for t in range(3000)]
    rows += [(None, t, "user", f"no id {t}.") for t in range(4)] + [(1001, None, "user", "no turn"), (1001, None, "user", "no turn"), (1001, 4, "assistant", "ok.")]
    rows += [(c, t, "user", "gone") for c in range(2000, 2040) for t in [next(t for t in range(1000) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)]]
    rows += [(1002, 5, "user", "same.")] * 500
    # Rows of equal turns need no order of their own here: one row of each (conversation, turn) but for exact repeats.
    first = {}
    return [r for r in rows if first.setdefault(r[:2], r) == r]


def got(df):
    rows = df.collect()
    out = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("fragment_rows", [1, 3, 50, repair.FRAGMENT_ROWS])
def test_repair_equals_brute_force(spark, fragment_rows):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, audit string, part int").repartition(7)
    assert got(repair.digests(repair.repair(repair.damage(df), fragment_rows))) == expected(rows)


def test_one_conversation_over_many_tasks(spark):
    rows = [(7, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 900}" + "." * (t % 2)) for t in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(repair.digests(repair.repair(repair.damage(df), 40))) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_and_empty_table(spark, tmp_path):
    rows = conversations(20)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(op12_repair(spark, str(tmp_path))) == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert mismatch(op12_repair(spark, str(tmp_path)), con, ORACLES["op12_repair"]) is None
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op12_repair(spark, f"{tmp_path}/none").collect() == []


def test_ranks_order_arcs_by_their_labels():
    rng = np.random.default_rng(3)
    n = 400
    node = np.repeat(np.arange(n), 2)
    label = np.stack([rng.choice([1, 2], n), rng.choice([3, 4], n)], axis=1).ravel()
    head = np.minimum(node + rng.integers(1, 4, 2 * n), n)
    node, label, head = np.append(node, n), np.append(label, 0), np.append(head, n)
    chosen, rank, doubled, length = repair.ranked(node, label, head, n + 1)
    said = {n: ""}
    for v in range(n - 1, -1, -1):
        said[v] = min(f"{label[e]}{said[head[e]]}" for e in (2 * v, 2 * v + 1))
    full = [f"{label[e]}{said[head[e]]}" if label[e] else "" for e in range(len(node))]
    assert [full[chosen[v]] for v in range(n + 1)] == [said[v] for v in range(n + 1)]
    assert length.tolist() == [len(f) for f in full]
    order = np.argsort(rank, kind="stable")
    assert [full[e] for e in order] == sorted(full, key=lambda f: f) and len(doubled) >= 8
