"""SentencePiece encoding and decoding with a given model, as a batched Viterbi search in numpy.

The distinct words of a batch are grouped by length and advance together, one character at a time. Rolling hashes of
their substrings probe the sorted hashes of the pieces; for every end position the best start is a vectorised maximum
whose backpointer is kept. For a unigram model a path's score is the sum of its pieces' scores. For a BPE model a path
may only join pieces that the merges of their joined text leave apart; exactly one path does so, and it is what merging
gives (each piece must survive merging alone, each adjacent pair merging together). Results equal the library's.

Models must leave characters as they are, put one space mark in front of a text and never have that mark inside a piece;
others are refused. A null text is empty and has no ids; decoding gives the text back, with the mark character itself
read as a space, as the library does. Rows are independent: repeated ones get equal results, an empty table gives an
empty one, and a column named like the output is replaced. The model file is read on the driver and its tables, bounded
by the vocabulary, travel with the tasks.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sparsefold.llm.units import at_spaces, gathered, slices, sums

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
CHARS_AT_ONCE, WORDS_AT_ONCE = 4_000_000, 8192
KNOWN_PAIRS, KNOWN_WORDS = 1_000_000, 400_000
TOP_BITS = 18
#: Words of so many characters are encoded one by one.
LONG = 512
FALLBACK = -2
#: No id and no character: marks unused places.
NONE = -(1 << 40)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads code points over 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    out = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
    for j, c in enumerate(mixed(points).T):
        out[:, j + 1] = out[:, j] * BASE + c
    return out


def long_prefix_hashes(points: np.ndarray) -> np.ndarray:
    """``prefix_hashes`` of one row without a loop: the base is odd, so it has an inverse to scale each place by."""
    n = len(points)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    down = np.multiply.accumulate(np.full(n, inverse, dtype=np.uint64))
    up = np.multiply.accumulate(np.full(n, BASE, dtype=np.uint64))
    return np.concatenate([[np.uint64(0)], np.add.accumulate(mixed(points) * down) * up])


@dataclass
class Vocabulary:
    names: list[str]
    scores: list[float]
    usual: list[bool]
    raw: list[bytes]
    bytes_at: list[int]
    unknown: int
    merging: bool
    ids: dict[str, int] = field(default_factory=dict)
    keys: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: By length: which leading bits some key has; most substrings end here.
    seen: dict[int, np.ndarray] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)
    #: Units met so far: their number; ``flat`` holds their ids one after the other, ``starts`` where each begins.
    units: dict[str, int] = field(default_factory=dict)
    flat: array = field(default_factory=lambda: array("i"))
    starts: array = field(default_factory=lambda: array("q", [0]))
    powers: np.ndarray | None = None

    def __post_init__(self):
        spelt = [r.replace(MARK.encode(), b" ") for r in self.raw]
        lengths = np.array([len(r) for r in spelt], dtype=np.int64)
        self.raw_flat, self.raw_at = np.frombuffer(b"".join(spelt), dtype=np.uint8), (np.cumsum(lengths) - lengths, lengths)
        self.weights = np.array(self.scores, dtype=float)
        self.ids = {p: i for i, p in enumerate(self.names) if self.usual[i]}
        with np.errstate(over="ignore"):
            longest = max(map(len, self.ids), default=1)
            self.powers = np.array([1, *np.multiply.accumulate(np.full(longest, BASE))], dtype=np.uint64)
            if self.merging:
                joins = [(self.ids[p[:i]], self.ids[p[i:]], k) for p, k in self.ids.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
                left, right, whole_id = np.array(joins, dtype=np.int64).reshape(-1, 3).T
                order = np.argsort(left << 32 | right)
                self.join_keys, self.join_ids = np.append((left << 32 | right)[order], np.iinfo(np.int64).max), np.append(whole_id[order], -1)
                self.chars = [[self.ids.get(c, -1) for c in p] for p in self.names]
                alone = {p for p in self.ids if self.merged(p) == [self.ids[p]]}
            else:
                alone = set(self.ids)
            by_length: dict[int, list[str]] = {}
            for p in alone:
                by_length.setdefault(len(p), []).append(p)
            for n, own in by_length.items():
                h = prefix_hashes(code_points(own))[:, -1]
                order = np.argsort(h)
                if len(np.unique(h)) < len(h):
                    raise ValueError("two pieces share a hash")
                self.keys[n] = h[order], np.array([self.ids[p] for p in own])[order]
                self.seen[n] = np.zeros(1 << TOP_BITS, dtype=bool)
                self.seen[n][h >> np.uint64(64 - TOP_BITS)] = True

    def merged(self, text: str) -> list[int]:
        """Ids by merging the best pair of neighbours again and again, the leftmost of equals; for short strings and runs."""
        if len(text) > 64:
            return self.merged_long(text)
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = self.ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.scores[p] > best):
                    best, at = self.scores[p], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, FALLBACK) for p in parts]

    def merged_long(self, text: str) -> list[int]:
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        todo: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if (p := self.ids.get(both)) is not None:
                    heapq.heappush(todo, (-self.scores[p], i, after[i], both))

        for i in range(len(parts) - 1):
            offer(i)
        while todo:
            _, i, j, both = heapq.heappop(todo)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.ids.get(p, FALLBACK) for p in parts if p is not None]

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces as it is; nothing merges with an unknown character."""
        keys, which = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        listed = keys.tolist()
        new = [k for k in listed if k not in self.pairs]
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at:at + WORDS_AT_ONCE]
            self.pairs.update(zip(part, self.stay(part).tolist(), strict=True))
        out = np.array([self.pairs[k] for k in listed], dtype=bool)
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        return out[which]

    def stay(self, keys: list[int]) -> np.ndarray:
        """Whether merging the joined text of each pair ends with that pair: all rows merge their best neighbours, the
        leftmost of equals, at the same time."""
        texts = [self.chars[k >> 32] + self.chars[k & 0xFFFFFFFF] for k in keys]
        width = max(3, *map(len, texts))
        rows = np.array([t + [-1] * (width - len(t)) for t in texts], dtype=np.int64)
        pair = np.array([(k >> 32, k & 0xFFFFFFFF) for k in keys])
        active = np.arange(len(rows))
        while active.size:
            now = rows[active]
            key = now[:, :-1] << 32 | now[:, 1:]
            at = np.searchsorted(self.join_keys, key)
            found = (self.join_keys[at] == key) & (now[:, :-1] >= 0) & (now[:, 1:] >= 0)
            score = np.where(found, self.weights[self.join_ids[at]], -np.inf)
            best = np.argmax(score, axis=1)
            line = np.arange(len(active))
            going = np.isfinite(score[line, best])
            active, now, best, at = active[going], now[going], best[going], at[going]
            line = line[:len(active)]
            place = np.arange(width)[None]
            shifted = np.take_along_axis(now, np.minimum(place + (place > best[:, None]), width - 1), 1)
            shifted[:, -1] = -1
            shifted[line, best] = self.join_ids[at[line, best]]
            rows[active] = shifted
        return (rows[:, :2] == pair).all(axis=1) & (rows[:, 2:] < 0).all(axis=1)

    def viterbi(self, words: list[str]) -> np.ndarray:
        """Pieces of words of one length, a row each behind NONE; unknown characters as FALLBACK minus their code point."""
        points = code_points(words)
        n, length = points.shape
        hashes = prefix_hashes(points)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((n, length + 1), FALLBACK, dtype=np.int64)
        back = np.zeros((n, length + 1), dtype=np.int32)
        floor = min(self.scores, default=0.0) - 10
        for j in range(1, length + 1):
            ends: list[tuple[np.ndarray, np.ndarray, int]] = []
            for size in (s for s in self.keys if s <= j):
                keys, ids = self.keys[size]
                h = hashes[:, j] - hashes[:, j - size] * self.powers[size]
                rows = np.flatnonzero(self.seen[size][h >> np.uint64(64 - TOP_BITS)])
                at = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
                hit = (keys[at] == h[rows]) & np.isfinite(best[rows, j - size])
                if hit.any():
                    ends.append((rows[hit], ids[at[hit]], j - size))
            if ends:
                rows, piece = (np.concatenate([e[x] for e in ends]) for x in (0, 1))
                start = np.concatenate([np.full(len(e[0]), e[2]) for e in ends])
                if self.merging:
                    joined = np.flatnonzero(last[rows, start] >= 0)
                    fits = np.ones(len(rows), dtype=bool)
                    fits[joined] = self.apart(last[rows[joined], start[joined]], piece[joined])
                    rows, piece, start = rows[fits], piece[fits], start[fits]
                score = best[rows, start] + (0 if self.merging else self.weights[piece])
                by = np.lexsort((score, rows))
                by = by[np.append(rows[by][1:] != rows[by][:-1], True)] if by.size else by
                best[rows[by], j], last[rows[by], j], back[rows[by], j] = score[by], piece[by], start[by]
            single_keys = self.keys.get(1, (np.zeros(1, np.uint64), None))[0]
            one = hashes[:, j] - hashes[:, j - 1] * BASE
            at = np.minimum(np.searchsorted(single_keys, one), len(single_keys) - 1)
            lone = np.flatnonzero((single_keys[at] != one) & np.isfinite(best[:, j - 1]))
            score = best[lone, j - 1] + (0 if self.merging else floor)
            better = score > best[lone, j]
            lone, score = lone[better], score[better]
            best[lone, j], last[lone, j], back[lone, j] = score, FALLBACK - points[lone, j - 1].astype(np.int64), j - 1
        rows, at, steps = np.arange(n), np.full(n, length), []
        found = np.full((n, length), NONE, dtype=np.int64)
        while rows.size:
            found[rows, length - 1 - len(steps)] = last[rows, at]
            steps.append(len(rows))
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        return found

    def walk(self, word: str) -> list[int]:
        """``viterbi`` of one long word: pieces are probed at all places by one call per length; only the choice goes place by place."""
        points = code_points([word])[0]
        n = len(points)
        with np.errstate(over="ignore"):
            hashes = long_prefix_hashes(points)
            ends, starts, found = [], [], []
            for size, (keys, ids) in self.keys.items():
                if size <= n:
                    h = hashes[size:] - hashes[:n + 1 - size] * self.powers[size]
                    rows = np.flatnonzero(self.seen[size][h >> np.uint64(64 - TOP_BITS)])
                    at = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
                    hit = keys[at] == h[rows]
                    starts.append(rows[hit])
                    ends.append(rows[hit] + size)
                    found.append(ids[at[hit]])
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        edges = np.searchsorted(end[order], np.arange(n + 2)).tolist()
        start, piece = np.concatenate(starts)[order].tolist(), np.concatenate(found)[order].tolist()
        single = set(piece[i] for i in np.flatnonzero(end[order] - np.concatenate(starts)[order] == 1).tolist())
        known = np.zeros(n + 1, dtype=bool)
        known[[e for e, s in zip(end[order].tolist(), start) if e - s == 1]] = bool(single)
        known, codes = known.tolist(), points.tolist()
        best, last, back = [0.0] + [-np.inf] * n, [FALLBACK] * (n + 1), [0] * (n + 1)
        floor = 0.0 if self.merging else min(self.scores, default=0.0) - 10
        for j in range(1, n + 1):
            top = -np.inf
            for c in range(edges[j], edges[j + 1]):
                i, p = start[c], piece[c]
                if best[i] == -np.inf or (self.merging and last[i] >= 0 and not self.stays(last[i], p)):
                    continue
                score = best[i] if self.merging else best[i] + self.scores[p]
                if score > top:
                    top, last[j], back[j] = score, p, i
            if not known[j] and best[j - 1] + floor > top:
                top, last[j], back[j] = best[j - 1] + floor, FALLBACK - codes[j - 1], j - 1
            best[j] = top
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def stays(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if key not in self.pairs:
            if len(self.pairs) > KNOWN_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self.merged(self.names[left] + self.names[right]) == [left, right]
        return self.pairs[key]

    def finished(self, found: list[int]) -> list[int]:
        """Unknown characters as the pieces of their bytes, or the unknown id where the model has none."""
        if not found or min(found) >= 0:
            return found
        out = []
        for p in found:
            if p <= FALLBACK:
                c = chr(FALLBACK - p).encode("utf-8", "surrogatepass")
                out += [self.bytes_at[b] for b in c] if self.bytes_at else [self.unknown]
            else:
                out.append(p)
        return out

    def learn(self, units: list[str]) -> None:
        """Encodes the units not met before. A unit is a word behind the spaces in front of it, all but one written out."""
        by_length: dict[int, list[str]] = {}
        for w in dict.fromkeys(u.lstrip(" ") for u in units):
            if w not in self.units:
                by_length.setdefault(len(w), []).append(w)
        for length in [n for n in by_length if n >= LONG]:
            for w in by_length.pop(length):
                self.keep(w, self.finished(self.walk(MARK + w)))
        for length, own in by_length.items():
            step = max(1, min(WORDS_AT_ONCE, WORDS_AT_ONCE * 64 // (length + 1)))
            for at in range(0, len(own), step):
                part = own[at:at + step]
                found = self.viterbi([MARK + u for u in part])
                if self.bytes_at:
                    ascii_ = (found <= FALLBACK) & (found > FALLBACK - 128)
                    found[ascii_] = np.array(self.bytes_at)[FALLBACK - found[ascii_]]
                rest = ((found <= FALLBACK) & (found != NONE)).any(axis=1)
                for i in np.flatnonzero(rest).tolist():
                    self.keep(part[i], self.finished(found[i][found[i] != NONE].tolist()))
                if rest.any():
                    part, found = [u for u, r in zip(part, rest.tolist(), strict=True) if not r], found[~rest]
                self.units.update(zip(part, range(len(self.units), len(self.units) + len(part)), strict=True))
                self.starts.frombytes((self.starts[-1] + np.cumsum((found != NONE).sum(axis=1))).astype(np.int64).tobytes())
                self.flat.frombytes(found[found != NONE].astype(np.int32).tobytes())
        for u in units:
            if u[:1] == " ":
                self.keep(u, self.behind_spaces(u))

    def keep(self, unit: str, found: list[int]) -> None:
        self.units[unit] = len(self.units)
        self.flat.extend(found)
        self.starts.append(len(self.flat))

    def behind_spaces(self, unit: str) -> list[int]:
        word = unit.lstrip(" ")
        spaces, at = len(unit) - len(word), self.units[word]
        found = self.flat[self.starts[at]:self.starts[at + 1]].tolist()
        if self.merging and found[0] == self.ids.get(MARK):
            # The mark in front of the word stayed alone, so it merges with the other spaces first.
            found, spaces = found[1:], spaces + 1
        run = self.merged(MARK * spaces) if self.merging else [x for x in self.viterbi([MARK * spaces])[0].tolist() if x != NONE]
        return self.finished(run) + found

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts. Words are cut and told apart by Arrow; only a batch's distinct ones are looked at here."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = marks_to_spaces(texts)
        if len(self.units) > KNOWN_WORDS:
            self.units, self.flat, self.starts = {}, array("i"), array("q", [0])
        kinds = np.zeros(len(texts), dtype=np.int8)
        kinds[pc.match_substring_regex(texts, "  |^ | $").to_numpy(zero_copy_only=False)] = 1
        kinds[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 2
        sizes, parts = np.zeros(len(texts), dtype=np.int64), []
        for kind, cut in ((0, at_spaces), (1, behind_spaces)):
            own = np.flatnonzero(kinds == kind)
            if not own.size:
                continue
            counts, codes, distinct = cut(texts.take(pa.array(own)) if own.size < len(texts) else texts)
            with np.errstate(over="ignore"):
                self.learn([u for u in distinct if u not in self.units])
            number = np.array([self.units[u] for u in distinct], dtype=np.int64)[codes]
            starts, flat = np.array(self.starts), np.array(self.flat)
            ids, _ = gathered(flat, starts, number)
            sizes[own] = sums(starts[number + 1] - starts[number], counts)
            parts.append((own, ids))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if len(parts) == 1:
            return offsets, parts[0][1]
        out = np.zeros(offsets[-1], dtype=np.int32)
        for own, ids in parts:
            each = sizes[own]
            ends = np.cumsum(each)
            out[np.repeat(offsets[own] - (ends - each), each) + np.arange(len(ids))] = ids
        return offsets, out

    def spelt(self, offsets: np.ndarray, ids: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Whether decoding each text's ids gives the text back: all decoded bytes in one array, against the texts' own."""
        starts, lengths = self.raw_at
        each = lengths[ids]
        ends = np.concatenate([[0], np.cumsum(each)])
        decoded = self.raw_flat[np.repeat(starts[ids] - ends[:-1], each) + np.arange(ends[-1])]
        at, sizes = ends[offsets[:-1]], np.diff(ends[offsets])
        texts = marks_to_spaces(texts)
        own = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        full = sizes > 0
        same = sizes == own + full
        same[full] &= decoded[at[full]] == ord(" ")
        if not same.all():
            # Few texts at most: what differs in length needs no comparison.
            decoded = np.concatenate([decoded[a:a + n] for a, n, ok in zip(at, sizes, same, strict=True) if ok and n] or [decoded[:0]])
            texts = texts.filter(pa.array(same))
            own = own[same]
        first = np.cumsum(own + (own > 0)) - (own + (own > 0))
        inner = np.ones(len(decoded), dtype=bool)
        inner[first[own > 0]] = False
        wrong = np.concatenate([[0], np.cumsum(decoded[inner] != flat_bytes(texts))])
        ends = np.concatenate([[0], np.cumsum(own)])
        same[same] = wrong[ends[1:]] == wrong[ends[:-1]]
        return same

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def marks_to_spaces(texts: pa.Array) -> pa.Array:
    """The library reads the mark as a space."""
    return pc.replace_substring(texts, MARK, " ") if pc.any(pc.match_substring(texts, MARK)).as_py() else texts


def flat_bytes(texts: pa.Array) -> np.ndarray:
    """All texts' bytes, one after the other."""
    as_bytes = pa.concat_arrays([texts.cast(pa.binary())])
    ends = np.frombuffer(as_bytes.buffers()[1], dtype=np.int32)[as_bytes.offset:as_bytes.offset + len(as_bytes) + 1]
    data = as_bytes.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None and len(as_bytes) else np.zeros(0, dtype=np.uint8)


def behind_spaces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``at_spaces`` of texts where spaces follow each other or stand at an end."""
    lists = [spaced(t.split(" ")) for t in texts.to_pylist()]
    found = pa.array([u for own in lists for u in own], pa.string()).dictionary_encode()
    return np.array([len(own) for own in lists]), found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def spaced(words: list[str]) -> list[str]:
    """Empty strings between split points become spaces in front of the next word; those at the end a unit of their own."""
    out, n = [], 0
    for w in words[:-1]:
        if w:
            out.append(" " * n + w)
            n = 0
        else:
            n += 1
    return [*out, " " * n + words[-1]]


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    with open(path, "rb") as f:
        lib = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    n = lib.get_piece_size()
    names, scores = [lib.id_to_piece(i) for i in range(n)], [lib.get_score(i) for i in range(n)]
    special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
    is_byte = [lib.is_byte(i) for i in range(n)]
    usual = [not s and not b for s, b in zip(special, is_byte, strict=True)]
    probe = "  Aé①ﬁ  x "
    if lib.decode(lib.encode(probe)) != probe or any(MARK in p.lstrip(MARK) for p, u in zip(names, usual, strict=True) if u):
        raise ValueError("the model changes characters, adds no space mark, or has the mark inside a piece")
    merging = all(float(s).is_integer() for s, u in zip(scores, usual, strict=True) if u)
    if merging:
        words = [s for p, s, u in zip(names, scores, usual, strict=True) if u and p.strip(MARK) and len(p) > 1]
        runs = [s for p, s, u in zip(names, scores, usual, strict=True) if u and len(p) > 1 and not p.strip(MARK)]
        if (runs and words and max(runs) >= min(words)) or any(p.startswith(MARK * 2) and p.strip(MARK) for p, u in zip(names, usual, strict=True) if u):
            raise ValueError("the model merges spaces before words")
    by_byte = {int(p[3:5], 16): i for i, p in enumerate(names) if is_byte[i]}
    raw = [bytes([int(p[3:5], 16)]) if is_byte[i] else " ⁇ ".encode() if lib.is_unknown(i) else b"" if special[i] else p.encode() for i, p in enumerate(names)]
    return Vocabulary(names, scores, usual, raw, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], lib.unk_id(), merging)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids`` (array of int), and ``ids_decoded`` which tells whether decoding them gave the text back."""
    flag = f"{ids}_decoded"
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (ids, flag)])
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(flag, T.BooleanType())])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, lambda b: pc.utf8_length(b.column(at)), CHARS_AT_ONCE):
            texts = part.column(at).fill_null("")
            offsets, found = vocabulary.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(vocabulary.spelt(offsets, found, texts))], names=[*part.schema.names, ids, flag])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of its ids; null ids give null."""
    @F.pandas_udf("string")
    def joined(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else vocabulary.decode(np.asarray(x)) for x in batch], dtype=object)

    return df.withColumn(text, joined(F.col(ids)))
