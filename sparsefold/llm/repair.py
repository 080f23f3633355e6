"""Repair of conversations whose turns are damaged: the cheapest edits that give the roles (system)? (user assistant)+, or none.

A row is kept (0), given the role user or assistant (2) or deleted (3; a must for blank and repeated rows); a row of empty
text may be inserted anywhere (2); a truncated row that stays costs 1 more. Places between rows and the roles so far make
nodes, edits the arcs. A backward pass finds every node's least cost. Then the optimal arcs are ranked by their audits, the
initials of the edits that follow (D < I < K < R), over lengths 1, 2, 4, ...: each round pairs an arc's rank with the rank
of the arc that its doubled pointer names, and the ranks choose every node's arc. The doubled pointers then read off the
least path, all places at once. The initials of a node's arcs differ, so there is one such path.

Rows are sorted over the cluster by conversation and turn, so a conversation of any length is spread over tasks. One that lies
within a task is repaired there, many at a time. Those cut by a task's end or longer than a fragment's bound are repaired in
fragments: least costs between the four roles before and after each, handed backwards; audits for each role before, chosen
forwards. No task holds more than a fragment, but for the keys of one task's rows.

Rows are taken by turn, nulls first, equal turns by role, then the text's first 64 characters, then a hash of it. Null roles and texts are one space, null ids
one conversation; an empty or foreign role can't be kept. Rows that are not ``present`` only name their conversation, which
then has a result without rows. Repeated rows are duplicates, an empty table gives an empty one, further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparsefold.llm.shared import stored

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Roles so far: none, system, open user turn, answered.
NONE_YET, AFTER_SYSTEM, AFTER_USER, ANSWERED = range(4)
INITIALS = "sua"
#: Roles after keeping a row of each initial, -1 where it does not fit; after a user or assistant turn that fits.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
TURNED = np.array([2, 2, 3, 2])
NEXT_ROLE = ("user", "user", "assistant", "user")
#: What is still to insert behind the last row.
TAIL = ("", "II", "I", "")
KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
AUDIT = np.frombuffer(b"$DIKR", dtype=np.uint8)
FAR = 1 << 50
LEGAL = frozenset(("su", "ua", "au"))
PREFIX = 64
FRAGMENT_ROWS, FRAGMENT_CHARS, ROWS_AT_ONCE, CHARS_AT_ONCE = 4096, 1 << 21, 16_384, 1 << 22
#: What is known of a stretch of a conversation before it is repaired.
FOUND = "illegal long, blank long, duplicate long, truncated long, n_turns long, least_turn long, most_turn long"
EDGES = "first_turn long, last_turn long, first_initial string, last_initial string, n_rows long"
TURNS = "array<struct<role:string,text:string>>"
REPAIRED = f"conv_id long, number long, audit string, turns {TURNS}, cost long, {FOUND}"
FRAGMENT = f"conv_id long, part int, frag long, whole boolean, audit string, cost long, turns {TURNS}, codes array<int>, keys array<binary>, {FOUND}, {EDGES}"


@dataclass
class Stretch:
    """Consecutive rows of one conversation; ``codes`` hold fault * 4 + number of the role's initial."""
    conv_id: int | None
    rows: list[tuple[str, str]] = field(default_factory=list)
    codes: list[int] = field(default_factory=list)
    keys: list[bytes | None] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)
    size: int = 0

    def add(self, turn: int | None, role: str, text: str, seen: set[bytes]) -> None:
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        shown = text.rstrip(BLANKS)
        if not shown:
            fault = BLANK
        elif key in seen:
            fault = DUPLICATE
        else:
            seen.add(key)
            fault = SOUND if shown[-1] in ENDS else TRUNCATED
        self.rows.append((role, text))
        self.codes.append(fault * 4 + (INITIALS.find(role[:1]) if role and role[0] in INITIALS else 3))
        self.keys.append(key if fault in (SOUND, TRUNCATED) else None)
        self.turns.append(turn)
        self.size += len(text) + len(role)

    def found(self) -> list:
        firsts = [r[:1] for r, _ in self.rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:], strict=False))
        known = [t for t in self.turns if t is not None]
        faults = np.bincount(np.array(self.codes, dtype=np.int64) // 4, minlength=4).tolist()
        return [illegal, *faults[1:], len(set(known)), min(known, default=None), max(known, default=None)]

    def edges(self) -> list:
        if not self.rows:
            return [None, None, None, None, 0]
        return [self.turns[0], self.turns[-1], self.rows[0][0][:1], self.rows[-1][0][:1], len(self.rows)]


@dataclass
class Block:
    """The codes of many stretches one after the other; each has a layer of nodes before every row and one behind the last."""
    codes: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.row_at = np.cumsum(self.sizes) - self.sizes
        self.layer_at = self.row_at + np.arange(len(self.sizes))
        self.layer_of_row = np.arange(len(self.codes)) + np.repeat(np.arange(len(self.sizes)), self.sizes)
        fault, initial = self.codes // 4, self.codes % 4
        self.forced = (fault == BLANK) | (fault == DUPLICATE)
        self.more = np.where(fault == TRUNCATED, TRUNCATED_COST, 0)
        self.kept = np.where(self.forced[:, None], -1, KEPT[initial])

    def arcs(self, rows: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs by deleting, keeping and giving a role to each of ``rows``, ``ahead`` being the costs behind it."""
        to = self.kept[rows]
        keep = np.where(to >= 0, KEEP_COST + self.more[rows, None] + np.take_along_axis(ahead, np.maximum(to, 0), 1), FAR)
        role = np.where(self.forced[rows, None], FAR, ROLE_COST + self.more[rows, None] + ahead[:, TURNED])
        return DELETE_COST + ahead, keep, role

    def costs(self, behind: np.ndarray) -> np.ndarray:
        """Least cost of every node (layer x role), ``behind`` being the costs behind each stretch's last row."""
        out = np.full((len(self.codes) + len(self.sizes), 4), FAR, dtype=np.int64)
        out[self.layer_at + self.sizes] = behind
        by_size = np.argsort(-self.sizes, kind="stable")
        longest_first = -self.sizes[by_size]
        for back in range(1, int(self.sizes.max(initial=0)) + 1):
            now = by_size[:np.searchsorted(longest_first, -back, side="right")]
            layer = self.layer_at[now] + self.sizes[now] - back
            best = np.minimum.reduce(self.arcs(self.row_at[now] + self.sizes[now] - back, out[layer + 1]))
            for _ in range(2):
                best = np.minimum(best, INSERT_COST + best[:, TURNED])
            out[layer] = best
        return np.minimum(out, FAR)

    def least_paths(self, behind: np.ndarray, enters: np.ndarray) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
        """For each stretch and entered role: the cost, the least audit of that cost, the role that it leaves behind."""
        cost = self.costs(behind)
        layer, role = self.layer_of_row, np.arange(4)[None]
        deleted, kept, given = self.arcs(np.arange(len(self.codes)), cost[layer + 1])
        now = cost[layer]
        # (initial's rank, whether optimal, node that follows), a node's number being layer * 4 + role.
        choices = [(1, deleted, (layer[:, None] + 1) * 4 + role), (2, INSERT_COST + now[:, TURNED], layer[:, None] * 4 + TURNED[None]),
                   (3, kept, (layer[:, None] + 1) * 4 + np.maximum(self.kept, 0)), (4, given, (layer[:, None] + 1) * 4 + TURNED[None])]
        last = (self.layer_at + self.sizes)[:, None] * 4 + role
        node, label, head = [last.ravel()], [np.zeros(last.size, dtype=np.int64)], [last.ravel()]
        for initial, price, follows in choices:
            best = (price == now) & (now < FAR)
            node.append((layer[:, None] * 4 + role)[best])
            label.append(np.full(int(best.sum()), initial))
            head.append(np.broadcast_to(follows, best.shape)[best])
        node, label, head = (np.concatenate(x) for x in (node, label, head))
        chosen, rank, doubled, length = ranked(node, label, head, cost.size)
        starts = chosen[self.layer_at[:, None] * 4 + enters]
        known = starts >= 0
        steps = np.where(known, length[starts], 0)
        path = np.repeat(starts[known], steps[known])
        flat_steps = steps[known]
        place = np.arange(len(path)) - np.repeat(np.cumsum(flat_steps) - flat_steps, flat_steps)
        ends, remaining = starts[known], flat_steps.copy()
        for power, pointer in enumerate(doubled):
            on = (place >> power) & 1 == 1
            path[on] = pointer[path[on]]
            on = (remaining >> power) & 1 == 1
            ends[on] = pointer[ends[on]]
        text = AUDIT[label[path]].tobytes().decode()
        cuts = np.concatenate([[0], np.cumsum(steps.ravel())]).tolist()
        audits = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        left = np.full(starts.shape, -1)
        left[known] = node[ends] % 4
        width = enters.shape[1]
        return cost[self.layer_at[:, None], enters], [audits[i:i + width] for i in range(0, len(audits), width)], left


def ranked(node: np.ndarray, label: np.ndarray, head: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Ranks arcs by the labels along their least paths, over 1, 2, 4, ... labels.

    Gives each node's arc (-1 for none), the ranks, the pointers 1, 2, 4, ... arcs ahead, and each path's length. Arcs labelled
    0 end paths and lead to their own node.
    """
    def choice(rank: np.ndarray) -> np.ndarray:
        order = np.lexsort((rank, node))
        out = np.full(n_nodes, -1, dtype=np.int64)
        out[node[order[::-1]]] = order[::-1]
        return out

    rank, length = label.copy(), (label > 0).astype(np.int64)
    chosen = choice(rank)
    ahead = chosen[head]
    doubled = [ahead]
    while (label[ahead] > 0).any():
        length = length + length[ahead]
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead], return_inverse=True)[1]
        ahead = ahead[ahead]
        doubled.append(ahead)
    return choice(rank), rank, doubled, length


def replayed(rows: list[tuple[str, str]], codes: list[int], audit: str, role: int) -> tuple[list[tuple[str, str]], int]:
    """(turns after the edits, their cost), entered with the roles so far."""
    out, cost, at = [], 0, 0
    for edit in audit:
        if edit == "I":
            out.append((NEXT_ROLE[role], ""))
            role, cost = int(TURNED[role]), cost + INSERT_COST
            continue
        (own, text), code = rows[at], codes[at]
        at += 1
        if edit == "D":
            cost += DELETE_COST
            continue
        cost += TRUNCATED_COST * (code // 4 == TRUNCATED)
        if edit == "K":
            out.append((own, text))
            role = int(KEPT[code % 4][role])
        else:
            out.append((NEXT_ROLE[role], text))
            role, cost = int(TURNED[role]), cost + ROLE_COST
    return out, cost


def block_of(codes: list[list[int]]) -> Block:
    return Block(np.array([c for own in codes for c in own], dtype=np.int64), np.array([len(own) for own in codes], dtype=np.int64))


END_COSTS = np.array([len(t) * INSERT_COST for t in TAIL])


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
         "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), TURNS: pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def batch_of(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = [KINDS[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names_of(schema))


def some_at_once(rows: Iterator, size, limit: int) -> Iterator[list]:
    some, total = [], 0
    for r in rows:
        some.append(r)
        total += size(r)
        if total >= limit:
            yield some
            some, total = [], 0
    if some:
        yield some


def rows_in(batches: Iterator[pa.RecordBatch], at_once: int = 1024) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in b.slice(at, at_once).columns), strict=True)


def as_turns(rows: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in rows]


def stretches(rows: Iterator[tuple], fragment_rows: int) -> Iterator[tuple[Stretch, bool]]:
    """(stretch, whether it is sure to be a whole conversation) of one task's sorted rows; the task's first and last may go on elsewhere."""
    now, seen, first, alone = None, set(), True, True
    for conv_id, turn, role, text, present in rows:
        if now is None or now.conv_id != conv_id:
            if now is not None:
                yield now, alone and not first
                first = False
            now, seen, alone = Stretch(conv_id), set(), True
        elif len(now.rows) >= fragment_rows or now.size >= FRAGMENT_CHARS:
            yield now, False
            now, alone = Stretch(conv_id), False
        if present:
            now.add(turn, " " if role is None else role, " " if text is None else text, seen)
    if now is not None:
        yield now, False


def fragments(turns: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """Whole conversations repaired, the others as fragments with all that is known of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        weigh = lambda s: 1 + len(s[0].rows) + s[0].size * ROWS_AT_ONCE // CHARS_AT_ONCE
        for some in some_at_once(stretches(rows_in(batches), fragment_rows), weigh, ROWS_AT_ONCE):
            own = [s for s, whole in some if whole]
            audits = iter(())
            if own:
                block = block_of([s.codes for s in own])
                _, found, left = block.least_paths(np.repeat(END_COSTS[None], len(own), 0), np.zeros((len(own), 1), dtype=np.int64))
                audits = iter([f[0] + TAIL[e] for f, e in zip(found, left[:, 0].tolist(), strict=True)])
            out = []
            for s, whole in some:
                audit, cost, rows, codes, keys = None, None, s.rows, s.codes, s.keys
                if whole:
                    audit, codes, keys = next(audits), None, None
                    rows, cost = replayed(s.rows, s.codes, audit, NONE_YET)
                out.append([s.conv_id, part, number, whole, audit, cost, as_turns(rows), codes, keys, *s.found(), *s.edges()])
                number += 1
            yield batch_of(out, FRAGMENT)

    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
                       F.coalesce(F.col("present"), F.lit(True)).alias("present"),
                       F.xxhash64(F.coalesce("text", F.lit(" "))).alias("tie"), F.monotonically_increasing_id().alias("spread"))
    # Short keys, as the cluster samples them; equal rows are told apart by any number, so that a crowd of them is spread.
    order = ["conv_id", "turn", F.coalesce("role", F.lit(" ")), F.substring(F.coalesce("text", F.lit(" ")), 1, PREFIX), "tie"]
    return own.repartitionByRange(*order, "spread").sortWithinPartitions(*order, "text").select(
        "conv_id", "turn", "role", "text", "present").mapInArrow(run, FRAGMENT)


SETTLED = f"conv_id long, part int, frag long, turns {TURNS}, codes array<int>, {FOUND}, {EDGES}, price array<long>"


def settled(cut: DataFrame) -> DataFrame:
    """Fragments whose rows are told from rows of earlier fragments, with the least costs between the roles before and behind (16)."""
    keys = cut.select("conv_id", "part", "frag", F.posexplode("keys").alias("at", "key")).where(F.col("key").isNotNull())
    earlier = F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("part", "frag", "at")) > 1
    late = keys.select("part", "frag", "at", earlier.alias("late")).where("late").groupBy("part", "frag").agg(F.collect_list("at").alias("late"))
    kept = [c.split()[0] for c in SETTLED.split(", ")[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        faults, codes_at = kept.index("blank"), kept.index("codes")
        for some in some_at_once(rows_in(batches, 8), lambda r: 1 + len(r[codes_at]), ROWS_AT_ONCE):
            rows = [list(r) for r in some]
            for r in rows:
                codes = r[codes_at]
                for at in r[-1] or ():
                    codes[at] = DUPLICATE * 4 + codes[at] % 4
                r[faults:faults + 3] = np.bincount(np.array(codes, dtype=np.int64) // 4, minlength=4).tolist()[1:]
            block = block_of([r[codes_at] for r in rows])
            prices = []
            for behind in range(4):
                only = np.where(np.arange(4) == behind, 0, FAR)
                prices.append(block.costs(np.repeat(only[None], len(rows), 0))[block.layer_at])
            # A stretch of no rows has just the nodes behind it.
            price = np.stack(prices, axis=2).reshape(len(rows), 16).tolist()
            yield batch_of([[*r[:-1], p] for r, p in zip(rows, price, strict=True)], SETTLED)

    joined = cut.join(late, ["part", "frag"], "left")
    return joined.select(*kept, "late").mapInArrow(run, SETTLED)


def costs_behind(fragments_: DataFrame) -> DataFrame:
    """(part, frag, behind, is_last): least costs from each role behind a fragment to its conversation's end, handed from the last to the first."""
    schema = "part int, frag long, behind array<long>, is_last boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, behind, out = None, None, []
        for conv_id, part, frag, price in rows_in(batches):
            is_last = now is None or now[0] != conv_id
            if is_last:
                now, behind = (conv_id,), END_COSTS
            out.append([part, frag, behind.tolist(), is_last])
            behind = np.minimum((np.array(price).reshape(4, 4) + behind[None]).min(axis=1), FAR)
            if len(out) >= ROWS_AT_ONCE:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    order = [F.col("conv_id"), F.col("part").desc(), F.col("frag").desc()]
    return fragments_.select("conv_id", "part", "frag", "price").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


PATHS = f"conv_id long, part int, frag long, is_last boolean, turns {TURNS}, codes array<int>, {FOUND}, {EDGES}, audits array<string>, leaves array<int>"


def paths(fragments_: DataFrame, behind: DataFrame) -> DataFrame:
    """Each fragment with the least audit for every role before it and the role that this leaves."""
    kept = names_of(PATHS)[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_at = kept.index("codes")
        for rows in some_at_once(rows_in(batches, 8), lambda r: 1 + len(r[codes_at]), ROWS_AT_ONCE):
            block = block_of([r[codes_at] for r in rows])
            after = np.array([r[-1] for r in rows], dtype=np.int64).reshape(-1, 4)
            _, audits, leaves = block.least_paths(after, np.repeat(np.arange(4)[None], len(rows), 0))
            yield batch_of([[*r[:-1], a, e] for r, a, e in zip(rows, audits, leaves.tolist(), strict=True)], PATHS)

    return fragments_.join(behind, ["part", "frag"]).select(*kept, "behind").mapInArrow(run, PATHS)


def joined_up(found: DataFrame) -> DataFrame:
    """Repaired fragments, a conversation's in order within one partition, each entered with the role that the one before leaves."""
    columns = names_of(PATHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, role, number, turn, initial = None, NONE_YET, 0, None, None
        for some in some_at_once(rows_in(batches, 8), lambda r: 1 + len(r[columns.index("codes")]), ROWS_AT_ONCE):
            out = []
            for r in (dict(zip(columns, s, strict=True)) for s in some):
                if now is None or now[0] != r["conv_id"]:
                    now, role, number, turn, initial = (r["conv_id"],), NONE_YET, 0, None, None
                audit, left = r["audits"][role], r["leaves"][role]
                audit += TAIL[left] if r["is_last"] else ""
                turns, cost = replayed([(t["role"], t["text"]) for t in r["turns"]], r["codes"], audit, role)
                n_turns, illegal = r["n_turns"], r["illegal"]
                if r["n_rows"]:
                    illegal += initial is not None and initial + r["first_initial"] not in LEGAL
                    n_turns -= turn is not None and turn == r["first_turn"]
                    turn, initial = r["last_turn"], r["last_initial"]
                out.append([r["conv_id"], number, audit, as_turns(turns), cost, illegal, r["blank"], r["duplicate"], r["truncated"], n_turns, r["least_turn"], r["most_turn"]])
                role, number = left, number + 1
            yield batch_of(out, REPAIRED)

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "frag").mapInArrow(run, REPAIRED)


def repair(turns: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """Repaired conversations of rows (conv_id, turn, role, text, present): audit, turns and counts by conversation and ``number``.

    Nearly every conversation is one row; a long one is several, which follow each other in one partition and whose counts add up.
    """
    found = stored(fragments(turns, fragment_rows))
    whole = found.where("whole").select("conv_id", F.lit(0).cast("long").alias("number"), *names_of(REPAIRED)[2:])
    cut = stored(settled(found.where("not whole")))
    return whole.unionByName(joined_up(paths(cut, costs_behind(cut))))


DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation, from the rows of ``repair`` as they come."""
    columns = names_of(REPAIRED)

    def row(conv_id: int | None, own: dict, audit: list[str], digest) -> list:
        gaps = own["most"] - own["least"] + 1 - own["n_turns"] if own["n_turns"] else 0
        return [conv_id, gaps, own["blank"], own["duplicate"], own["truncated"], own["illegal"], own["cost"], "".join(audit), digest.hexdigest()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, begun, out = None, [], None, False, []
        for values in rows_in(batches, 64):
            r = dict(zip(columns, values, strict=True))
            if r["number"] == 0:
                if now is not None:
                    out.append(row(conv_id, now, audit, digest))
                    if len(out) >= 1024:
                        yield batch_of(out, DIGESTS)
                        out = []
                conv_id, now, audit, digest, begun = r["conv_id"], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"), 0), [], hashlib.sha256(), False
                now["least"] = now["most"] = None
            for c in ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"):
                now[c] += r[c]
            for c, of, better in (("least", "least_turn", min), ("most", "most_turn", max)):
                if r[of] is not None:
                    now[c] = r[of] if now[c] is None else better(now[c], r[of])
            audit.append(r["audit"])
            said = "\n".join([f"{t['role']}:{t['text']}" for t in r["turns"]])
            if r["turns"]:
                digest.update(("\n" + said if begun else said).encode())
                begun = True
        if now is not None:
            out.append(row(conv_id, now, audit, digest))
        if out:
            yield batch_of(out, DIGESTS)

    return repaired.mapInArrow(run, DIGESTS)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` names by its remainder of 20: dropped, empty, without ends, repeated, of role user."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *said)) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (fault != 0).alias("present"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
