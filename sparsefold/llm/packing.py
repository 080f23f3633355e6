"""Best-fit packing of token sequences by patterns of few documents.

Texts become ids, each text's ids are closed by an end id, and those longer than a sequence are cut. The lengths of all
pieces make a histogram, which is all that the plan needs: patterns of up to three length classes that fill a sequence
are enumerated, non-negative least squares fit their repeat counts to the histogram, the counts are rounded to what is
there, and the remaining lengths go by best fit, longest first, into the room that patterns left, then into new
sequences. The plan's size depends on the sequence length alone. Pieces of one length are interchangeable: a piece's
rank among them (its place in its task, plus the count of such pieces in earlier tasks) says which sequence and place
it gets, so no rows meet and a length that a third of all pieces share is no hot key.

A null text is empty: its piece is the end id alone. Null ids, repeated rows and ties keep a piece each, an empty table
gives an empty one, and further columns are not read. The tokenizer must drop white space and not join over it.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparsefold.llm.shared import broadcast_if_small, stored
from sparsefold.llm.units import KNOWN_UNITS, Memo, byte_chars, encoded_at_spaces, flattened, gathered, slices, strings, sums

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY, END_ID = 2048, 0
#: Classes of lengths that patterns are made of, and lengths to a pattern at most.
CLASSES, DEPTH = 512, 3
#: Misses of long lengths weigh more than those of short ones, which best fit places anywhere.
WEIGHT_POWER = 8
PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
RANK_BITS = 48
#: Words that lower-casing and composing leave letter by letter: ASCII and Latin-1; the marks are one token's or more, never joined with a letter.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "\xAA\xB5\xBA")
MARKS = ".,;:!?|\"()#$%&*+/=@-"
LONGEST = 64
PLAIN = rf"\A[{LETTERS}]+[{MARKS}]*\z"
NO_RANK = 1 << 40


class WordCoder:
    """A word tokenizer's ids of text units. Plain words and the marks behind them are told apart by Arrow, each is learnt once, whatever it
    stands with. Words are merged many at a time: all words of one length take their best pair, the leftmost of equals, in the same step,
    and only pairs beside a merge are looked up again. The library does marks and the others."""

    def __init__(self, json_text: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(json_text)
        model = json.loads(json_text)["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, both = np.array([[ids[a], ids[b], ids[a + b]] for a, b in pairs], dtype=np.int64).T
        order = np.argsort(left << 32 | right, kind="stable")
        # One more pair that no word holds keeps every search inside.
        self.pairs = np.append((left << 32 | right)[order], np.iinfo(np.int64).max)
        self.ranks, self.both = np.append(order, NO_RANK), both
        self.inner, self.last = (np.array([ids.get(c + end, -1) for c in byte_chars()]) for end in ("", suffix))
        # Ranks of any two bytes, the second one inside a word or its last.
        self.inside, self.at_end = (self.ranked(self.inner[:, None], second[None]) for second in (self.inner, self.last))
        self.words = Memo(self.merged, known=KNOWN_UNITS)
        self.others = Memo(lambda new: flattened(self.by_library(new)), known=KNOWN_UNITS)

    def __call__(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit, which holds no white space but what is dropped."""
        flat, starts = self.ids_of(pa.array(units, pa.string()))
        return [flat[a:b].tolist() for a, b in pairwise(starts.tolist())]

    def ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, where each unit's start, and the end)."""
        plain = pc.and_(pc.match_substring_regex(units, PLAIN), pc.less_equal(pc.utf8_length(units), LONGEST))
        own, mask = units.filter(plain), plain.to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(pc.utf8_rtrim(own, MARKS)).dictionary_encode()
        # What is not a word: marks behind words, units that are not plain, and nothing, which stands with the latter.
        others = pa.concat_arrays([pc.utf8_ltrim(own, LETTERS), units.filter(pc.invert(plain)), pa.array([""], units.type)]).dictionary_encode()
        word, other = (memo.numbered(strings(found.dictionary))[found.indices.to_numpy()] for memo, found in ((self.words, words), (self.others, others)))
        (flat, starts), (more, behind) = self.words.tables(), self.others.tables()
        two = np.full((len(units), 2), other[-1] + len(starts))
        two[mask, 0], two[mask, 1] = word, other[:len(own)] + len(starts)
        two[~mask, 0] = other[len(own):-1] + len(starts)
        flat, ends = gathered(np.append(flat, more), np.append(starts, behind + len(flat)), two.ravel())
        return flat, np.append(0, ends[1::2])

    def by_library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_RANK)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many of each)."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        flat, sizes, where = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for length in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == length)
            chars = np.frombuffer(b"".join([raw[i] for i in which.tolist()]), dtype=np.uint8).reshape(len(which), length)
            now = self.inner[chars]
            now[:, -1] = self.last[chars[:, -1]]
            # The rank of each pair; a last column stands for none.
            rank = np.full(now.shape, NO_RANK)
            rank[:, :-1] = self.inside[chars[:, :-1], chars[:, 1:]]
            if length > 1:
                rank[:, -2] = self.at_end[chars[:, -2], chars[:, -1]]
            while True:
                best = rank.argmin(axis=1)
                least = rank[np.arange(len(rank)), best]
                going = least < NO_RANK
                if not going.all():
                    flat.append(now[~going].ravel())
                    sizes.append(np.full(len(which) - int(going.sum()), now.shape[1]))
                    where.append(which[~going])
                    which, now, rank, best, least = which[going], now[going], rank[going], best[going], least[going]
                    if not which.size:
                        break
                line, kept = np.arange(len(which)), np.ones(now.shape, dtype=bool)
                now[line, best] = self.both[least]
                kept[line, best + 1] = False
                now, rank = (m[kept].reshape(len(line), -1) for m in (now, rank))
                for touched, at in ((best > 0, best - 1), (best < now.shape[1] - 1, best)):
                    rows, at = line[touched], at[touched]
                    rank[rows, at] = self.ranked(now[rows, at], now[rows, at + 1])
                rank[:, -1] = NO_RANK
        flat, sizes, order = np.concatenate(flat), np.concatenate(sizes), np.argsort(np.concatenate(where))
        return gathered(flat, np.append(0, np.cumsum(sizes)), order)[0], sizes[order]


def cut(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
        keep_ids: bool = True) -> DataFrame:
    """Every piece: id, piece (from 0), start, length, ids_crc32, ids if kept, and its place: ``nth`` of its length in task ``part``.

    ``nth`` holds for the rows of one run, so store the result before packing it.
    """
    with open(path, encoding="utf-8") as f:
        json_text = f.read()
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(json_text)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in slices(batches, lambda b: pc.utf8_length(b.column(1))):
            yield pieces_of(batch, coder, seen, part)

    def pieces_of(batch: pa.RecordBatch, coder: WordCoder, seen: np.ndarray, part: int) -> pa.RecordBatch:
        counts, codes, distinct = encoded_at_spaces(pc.replace_substring(batch.column(1).fill_null(""), "\n", " "))
        flat, starts = coder.ids_of(distinct)
        own, _ = gathered(flat, starts, codes)
        lengths = sums(np.diff(starts)[codes], counts) + 1
        ends = np.cumsum(lengths)
        ids = np.full(ends[-1] if len(ends) else 0, end_id, dtype="<u4")
        inner = np.ones(len(ids), dtype=bool)
        inner[ends - 1] = False
        ids[inner] = own
        each = -(-lengths // capacity)
        last = np.cumsum(each)
        doc = np.repeat(np.arange(len(lengths)), each)
        piece = np.arange(len(doc)) - np.repeat(last - each, each)
        start = piece * capacity
        length = np.minimum(lengths[doc] - start, capacity)
        at = (ends - lengths)[doc] + start
        raw = memoryview(ids.view(np.uint8))
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                   pa.array(np.full(len(doc), part), pa.int32()), pa.array(counted(length, seen), pa.int64())]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def counted(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many equal values came before each, in earlier calls too; ``seen`` counts on."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(first, len(values)))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, sizes) + np.repeat(seen[ordered[first]], sizes)
    seen[ordered[first]] += sizes
    return out


def patterns(classes: np.ndarray, total: int, depth: int = DEPTH) -> np.ndarray:
    """Every ascending choice of 2 to ``depth`` of the classes that adds up to ``total``; a row each, 0 for no class."""
    there = np.zeros(total + 1, dtype=bool)
    there[classes[classes <= total]] = True
    rows, found = np.zeros((1, 0), dtype=np.int64), []
    for size in range(1, depth):
        left, low = total - rows.sum(axis=1), rows[:, -1] if size > 1 else np.zeros(len(rows), dtype=np.int64)
        at, pick = np.nonzero((classes[None] >= low[:, None]) & (2 * classes[None] <= left[:, None]))
        rows = np.column_stack([rows[at], classes[pick]])
        rest = total - rows.sum(axis=1)
        full = rows[there[rest]]
        found.append(np.column_stack([full, total - full.sum(axis=1), np.zeros((len(full), depth - size - 1), dtype=np.int64)]))
    return np.concatenate(found) if found else np.zeros((0, depth), dtype=np.int64)


def fitted(rows: np.ndarray, goal: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squares of (counts of classes in the repeated rows - goal).

    An active set: the pattern of the steepest slope enters, those that would fall below zero leave, until no slope is left.
    At most as many patterns as classes are in use at a time.
    """
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    weight = weights.copy()
    weight[0] = 0
    goal = goal * weight
    chosen: list[int] = []
    matrix, gram = np.zeros((0, len(goal))), np.zeros((0, 0))
    barred = np.zeros(len(rows), dtype=bool)
    residual = goal
    tolerance = 1e-6 * max(1.0, (weight * goal).max())
    while True:
        slope = (weight * residual)[rows].sum(axis=1)
        slope[barred] = -np.inf
        slope[chosen] = -np.inf
        new = int(np.argmax(slope))
        if slope[new] <= tolerance:
            return x
        line = np.bincount(rows[new], minlength=len(goal)) * weight
        across = matrix @ line
        gram = np.block([[gram, across[:, None]], [across[None], np.array([[line @ line * (1 + 1e-9)]])]])
        matrix = np.vstack([matrix, line])
        chosen.append(new)
        while chosen:
            best = np.linalg.solve(gram, matrix @ goal)
            now = x[chosen]
            falling = best <= 1e-9
            if not falling.any():
                x[chosen] = best
                break
            reach = np.where(falling, now / np.maximum(now - best, 1e-300), np.inf)
            now = np.maximum(now + min(1.0, reach.min()) * (best - now), 0)
            now[np.argmin(reach)] = 0
            stay = now > 1e-9
            now[~stay] = 0
            x[chosen] = now
            chosen, matrix, gram = [c for c, s in zip(chosen, stay, strict=True) if s], matrix[stay], gram[np.ix_(stay, stay)]
        # A pattern that leaves as soon as it enters is beyond the numbers' precision until another has changed the slopes.
        barred[:] = barred & (x[new] <= 0)
        barred[new] = x[new] <= 0
        residual = goal - x[chosen] @ matrix


@dataclass
class Family:
    """``count`` sequences that hold the same lengths in the same order: (length, how many)."""
    count: int
    parts: list[tuple[int, int]]
    room: int

    def with_more(self, count: int, length: int, times: int) -> Family:
        return Family(count, [*self.parts, (length, times)], self.room - length * times)


def repeats(histogram: dict[int, int], capacity: int, n_classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[list[int], int]]:
    """(classes of a pattern, repeat count), fitted and rounded to what the histogram holds; class c holds lengths up to c grains."""
    grain = max(1, capacity // n_classes)
    total = capacity // grain
    there = np.zeros(total + 1, dtype=np.int64)
    for length, n in histogram.items():
        if -(-length // grain) <= total and length < capacity:
            there[-(-length // grain)] += n
    rows = patterns(np.flatnonzero(there), total, depth)
    counts = np.floor(fitted(rows, there, np.arange(total + 1) / total) + 0.5).astype(np.int64)
    out = []
    for at in np.argsort(-counts, kind="stable").tolist():
        own = [c for c in rows[at].tolist() if c]
        uses = np.bincount(own, minlength=total + 1)
        n = min(int(counts[at]), *(int(there[c]) // int(uses[c]) for c in own)) if counts[at] else 0
        if n:
            there -= n * uses
            out.append((own, n))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, n_classes: int = CLASSES, depth: int = DEPTH) -> list[Family]:
    """Families of sequences that hold exactly the histogram's pieces."""
    grain = max(1, capacity // n_classes)
    left = {length: n for length, n in histogram.items() if n}
    families = [Family(left.pop(capacity), [(capacity, 1)], 0)] if capacity in left else []
    by_class = defaultdict(list)
    for length in sorted(left):
        by_class[-(-length // grain)].append(length)

    def taken(of: int, n: int) -> list[tuple[int, int]]:
        """The longest ``n`` pieces left in a class, fewer if it holds fewer, as (length, count)."""
        runs = []
        for length in reversed(by_class[of]):
            if m := min(n, left[length]):
                runs.append((length, m))
                left[length] -= m
                n -= m
        return runs

    lengths = np.array(sorted(left), dtype=np.int64)
    for own, n in repeats(left, capacity, n_classes, depth):
        # The class with most pieces comes last, so that its place goes to the very lengths that fill the sequences.
        last = max(own, key=lambda c: sum(left[x] for x in by_class[c]))
        own.remove(last)
        slots = [taken(c, n) for c in own]
        for count, parts in overlaid(slots):
            room = capacity - sum(parts)
            at = int(np.searchsorted(lengths, room, side="right")) - 1
            while count and at >= 0 and lengths[at] > (last - 1) * grain:
                length = int(lengths[at])
                if m := min(count, left[length]):
                    families.append(Family(m, [*((p, 1) for p in parts), (length, 1)], room - length))
                    left[length] -= m
                    count -= m
                at -= 1
            if count:
                families.append(Family(count, [(p, 1) for p in parts], room))
    return best_fit(families, left, capacity)


def overlaid(slots: list[list[tuple[int, int]]]) -> Iterator[tuple[int, list[int]]]:
    """(count, a length of each slot) for runs of (length, count) laid side by side; slots that run out fall away."""
    heads = [list(reversed(runs)) for runs in slots if runs]
    while heads:
        count = min(runs[-1][1] for runs in heads)
        yield count, [runs[-1][0] for runs in heads]
        for runs in heads:
            length, m = runs.pop()
            if m > count:
                runs.append((length, m - count))
        heads = [runs for runs in heads if runs]


def best_fit(families: list[Family], left: dict[int, int], capacity: int) -> list[Family]:
    """Longest first, each length into the fullest sequences that still have room for it, then into new ones."""
    open_at: dict[int, list[Family]] = defaultdict(list)
    for f in families:
        open_at[f.room].append(f)
    some = np.zeros(capacity + 1, dtype=bool)
    some[list(open_at)] = True

    def keep(f: Family) -> None:
        open_at[f.room].append(f)
        some[f.room] = True

    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            room = length + int(np.argmax(some[length:]))
            if not some[room]:
                f = Family(-(-n // (capacity // length)), [], capacity)
            else:
                f = open_at[room].pop()
                some[room] = bool(open_at[room])
            times = min(f.room // length, n)
            whole = min(f.count, n // times)
            keep(f.with_more(whole, length, times))
            n -= whole * times
            if n and n < times and whole < f.count:
                keep(f.with_more(1, length, n))
                whole, n = whole + 1, 0
            if whole < f.count and f.parts:
                keep(Family(f.count - whole, f.parts, f.room))
    return [f for fs in open_at.values() for f in fs]


def lookup(families: list[Family]) -> tuple[np.ndarray, ...]:
    """Sorted (length, first rank) keys, and for each: first rank, times in a sequence, first sequence, offset."""
    rows, used, sequence = [], defaultdict(int), 0
    for f in families:
        offset = 0
        for length, times in f.parts:
            rows.append((length << RANK_BITS | used[length], used[length], times, sequence, offset))
            used[length] += f.count * times
            offset += length * times
        sequence += f.count
    return tuple(np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T)


def pack(pieces: DataFrame, capacity: int = CAPACITY, n_classes: int = CLASSES, depth: int = DEPTH) -> DataFrame:
    """Stored pieces of ``cut`` with sequence_id and offset, in the place of ``part`` and ``nth``."""
    own = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, first, times, sequence, offset = lookup(plan(histogram, capacity, n_classes, depth))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = own.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        at = np.searchsorted(keys, size << RANK_BITS | r, side="right") - 1
        beyond = r - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + beyond // times[at], "offset": offset[at] + beyond % times[at] * size})

    joined = pieces.join(broadcast_if_small(stored(bases), 20), ["part", "length"])
    place = joined.withColumn("place", placed(F.col("length"), F.col("base") + F.col("nth")))
    return place.select(*[c for c in pieces.columns if c not in ("part", "nth")], "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the packed sequences themselves, from pieces that kept their ids. A sequence is of bounded length."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(inside.alias("inside")).select(
        "sequence_id", F.flatten("inside.ids").alias("ids"), F.col("inside.length").alias("lengths"))
