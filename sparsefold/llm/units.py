"""Texts cut at spaces into units, every distinct unit worked out once.

A tokenizer that never joins characters over a space gives a text's ids as its units' ids one after the other. ``Memo`` keeps
what was learnt of units, up to a stated number, and gathers it for whole batches of texts.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHARS_AT_ONCE = 8_000_000
KNOWN_UNITS = 400_000


def slices(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], pa.Array], limit: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the rows' sizes add up to about ``limit``, one row at least; rows without a size count as 0."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(size(batch), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(ends // limit)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in pairwise(cuts):
            yield batch.slice(a, b - a)


def encoded_at_spaces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(units per text, number of each unit, distinct units); an empty text is one empty unit."""
    lists = pc.split_pattern(texts, " ")
    found = lists.flatten().dictionary_encode()
    return np.diff(lists.offsets.to_numpy()), found.indices.to_numpy(zero_copy_only=False), found.dictionary


def strings(texts: pa.Array) -> list[str]:
    """``to_pylist`` of an array without nulls, by one conversion for all."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def at_spaces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    counts, codes, distinct = encoded_at_spaces(texts)
    return counts, codes, distinct.to_pylist()


def byte_chars() -> list[str]:
    """The character of every byte in byte-level vocabularies: visible Latin-1 bytes are themselves, the others follow in order from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def gathered(flat: np.ndarray, starts: np.ndarray, which: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` one after the other, each without its first ``skip`` numbers, and where each ends."""
    each = starts[which + 1] - starts[which] - skip
    ends = np.cumsum(each)
    places = np.repeat(starts[which] + skip - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
    return flat[places], ends


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's stretch of values; stretches may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return total[ends[1:]] - total[ends[:-1]]


def flattened(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers one after the other, how many of each list)."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum())), sizes


class Memo:
    """Numbers units; ``learn`` gives the integers of new units, all in one array, and how many of each; they stay in one flat array."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], code: str = "i", known: int = KNOWN_UNITS):
        self.learn, self.code, self.known = learn, code, known
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.starts = array(self.code), array("q", [0])

    def numbered(self, distinct: list[str]) -> np.ndarray:
        if len(self.numbers) > self.known:
            self.forget()
        new = [u for u in distinct if u not in self.numbers]
        if new:
            values, sizes = self.learn(new)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            self.flat.frombytes(values.astype(self.code).tobytes())
            self.starts.frombytes((self.starts[-1] + np.cumsum(sizes)).astype(np.int64).tobytes())
        return np.fromiter(map(self.numbers.__getitem__, distinct), dtype=np.int64, count=len(distinct))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.flat), np.array(self.starts)
