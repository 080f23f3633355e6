"""Alignment of the ids that two tokenizers give for one text.

Both tokenizers spell the same bytes, so a byte offset where a token of each ends closes a group. Offsets are kept as
end-to-index dictionaries; their common keys, sorted, slice both id lists into groups, and within a group every A-B pair
of tokens whose byte ranges meet is a link. Neither tokenizer joins bytes over a space between words, so this is done once
for every distinct word with what surrounds it, and a text's groups are its words' groups one after the other.

A text of no ids: null, empty, or one whose tokens spell other bytes (the mark U+2581 reads back as a space). It keeps its
row, with zeros and an empty digest. Null ids, repeated rows and ties keep a row each, an empty table gives an empty one, and
further columns are not read. Link counts are a table of at most one row per pair of ids that ever meet, whatever the
corpus; it is counted, then looked up in slices of bounded size, so links are not shuffled back to their texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparsefold.llm.shared import stored
from sparsefold.llm.units import Memo, at_spaces, byte_chars, flattened, gathered, slices, sums

BYTE_LEVEL, SENTENCE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
#: Unicode's white space, by which the byte-level tokenizer cuts.
SPACES = "\t-\r \x85\xa0\N{OGHAM SPACE MARK}\N{EN QUAD}-\N{HAIR SPACE}\N{LINE SEPARATOR}\N{PARAGRAPH SEPARATOR}\N{NARROW NO-BREAK SPACE}\N{MEDIUM MATHEMATICAL SPACE}\N{IDEOGRAPHIC SPACE}"
BLANK = re.compile(f"[{SPACES}]")
#: Words that hold neither blanks nor the space mark.
PLAIN = re.compile(rf"[^\s{MARK}]+")
#: Texts in which some space is not the only blank between two words.
ODD = f"^ | $|  |[{SPACES}] [{SPACES}]"
HEAD = 4
LINKS_AT_ONCE, PAIRS_AT_ONCE = 2_000_000, 4_000_000
TEXT_AT_ONCE, WORDS_AT_ONCE, KNOWN_WORDS = 4_000_000, 100_000, 250_000
#: How byte-level vocabularies cut texts before merging.
BYTE_LEVEL_CUTS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ALIGNED = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<{}>"
GROUPS = ", a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"


def words_of(text: str) -> list[str]:
    """The text, behind one more space, cut at spaces over which neither tokenizer joins; a word's own space is left out."""
    parts = text.split(" ")
    out = [parts[0]]
    for i, p in enumerate(parts[1:], 1):
        before = out[-1]
        inside = before == "" or before[-1] == " " or (p == "" and i == len(parts) - 1) or (BLANK.match(before[-1]) and (p == "" or BLANK.match(p)))
        if inside:
            out[-1] = f"{before} {p}"
        else:
            out.append(p)
    return out


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and of the B tokens that close a group: those at whose byte offsets tokens of both end."""
    at_a, at_b = (dict(zip(ends.tolist(), range(len(ends)), strict=True)) for ends in (a_ends, b_ends))
    common = sorted(at_a.keys() & at_b.keys())
    a, b = (np.fromiter(map(at.__getitem__, common), dtype=np.int64, count=len(common)) for at in (at_a, at_b))
    return a, b


def links_in(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of every link. Between two neighbouring ends of either kind lies one token of each, and two
    tokens that meet do so between just two neighbouring ends, so every slice is expanded at once."""
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.diff(ends, prepend=0) > 0]
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def spelt(table: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends, listed = np.cumsum(sizes).tolist(), ids.tolist()
    return [b"".join([table[i] for i in listed[e - n:e]]) for e, n in zip(ends, sizes.tolist(), strict=True)]


class Aligner(Memo):
    """Of each word: whether both tokenizers spell it, counts of ids and groups, then its links; and its groups in writing."""

    def __init__(self, json_text: str, model: bytes, keep_groups: bool = False):
        import sentencepiece
        import tiktoken

        spec = json.loads(json_text)
        special = {t["id"] for t in spec["added_tokens"] if t["special"]}
        if spec["normalizer"] or spec["pre_tokenizer"] != BYTE_LEVEL_CUTS or any(spec["model"][k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("not a byte-level vocabulary cut in the usual way")
        chars = {c: b for b, c in enumerate(byte_chars())}
        tokens = {i: bytes(chars[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        # Ids follow the order of merges, so the library of ranks gives the same ids, several times as fast on short texts.
        self.a = tiktoken.Encoding("own", pat_str=CUTS, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in own], dtype=np.int64) for own in (self.a_bytes, self.b_bytes))
        self.width, self.keep_groups = len(names), keep_groups
        # How an id is written inside and at the end of its group, for either tokenizer.
        written = [f"{i}{mark}" for mark, n in ((",", len(self.a_bytes)), ("|", len(self.a_bytes)), (",", self.width), (";", self.width)) for i in range(n)]
        self.written, self.written_at = np.frombuffer("".join(written).encode(), dtype=np.uint8), np.cumsum([0, *map(len, written)])
        self.line_break = spec["model"]["vocab"][byte_chars()[10]]
        super().__init__(self.aligned, code="q", known=KNOWN_WORDS)

    def forget(self) -> None:
        super().forget()
        self.said: list[bytes] = []
        self.parts: list[tuple[list[int], ...]] = []

    def aligned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words are laid one after the other, so that one set of offsets serves them all."""
        (a, n_a), (b, n_b) = self.coded(words)
        whole = [(" " + w).encode() for w in words]
        of_a, of_b = (np.repeat(np.arange(len(words)), n) for n in (n_a, n_b))
        bytes_of = np.array([len(w) for w in whole])
        same = all((np.bincount(of, weights=sizes[ids], minlength=len(words)) == bytes_of).all() for of, sizes, ids in ((of_a, self.a_sizes, a), (of_b, self.b_sizes, b)))
        ok = np.ones(len(words), dtype=bool)
        if not same or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != b"".join(whole) or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != b"".join(whole):
            ok = np.array([x == w == y for x, y, w in zip(spelt(self.a_bytes, a, n_a), spelt(self.b_bytes, b, n_b), whole, strict=True)], dtype=bool)
            a, b, n_a, n_b = a[ok[of_a]], b[ok[of_b]], n_a[ok], n_b[ok]
            of_a, of_b = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        close_a, close_b = common_ends(a_ends, b_ends)
        at_a, at_b = links_in(a_ends, b_ends)
        n_groups, n_links = (np.bincount(of_a[at], minlength=len(n_a)) for at in (close_a, at_a))
        self.write(a, b, close_a, close_b, of_a, of_b, ok)
        if self.keep_groups:
            self.keep([x.tolist() for x in np.split(a, np.cumsum(n_a)[:-1])], [x.tolist() for x in np.split(b, np.cumsum(n_b)[:-1])], close_a, close_b, n_groups, ok)
        heads = np.zeros((len(words), HEAD), dtype=np.int64)
        heads[ok] = np.stack([np.ones(len(n_a), dtype=np.int64), n_a, n_b, n_groups], axis=1)
        sizes = np.full(len(words), HEAD)
        sizes[ok] += n_links
        values = np.zeros(int(sizes.sum()), dtype=np.int64)
        head_at = ((np.cumsum(sizes) - sizes)[:, None] + np.arange(HEAD)).ravel()
        values[head_at] = heads.ravel()
        inner = np.ones(len(values), dtype=bool)
        inner[head_at] = False
        values[inner] = a[at_a] * self.width + b[at_b]
        return values, sizes

    def coded(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many of each word) by A and by B. Words without blanks are encoded by A many in one text, a line each."""
        plain = np.array([PLAIN.fullmatch(w) is not None for w in words], dtype=bool)
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        sizes, parts = np.zeros(len(words), dtype=np.int64), []
        for some in np.array_split(at, 1 + len(at) // WORDS_AT_ONCE):
            ids = self.a.encode_to_numpy("".join([f" {words[i]}\n" for i in some.tolist()])).astype(np.int64)
            sizes[some] = np.diff(np.flatnonzero(ids == self.line_break), prepend=-1) - 1
            parts.append(ids[ids != self.line_break])
        ids, sizes[rest] = flattened([self.a.encode_ordinary(" " + words[i]) for i in rest.tolist()])
        # Back to the order of the words.
        starts, order = np.zeros(len(words), dtype=np.int64), np.concatenate([at, rest])
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return [(np.concatenate([*parts, ids])[places], sizes), flattened(self.b.encode(words, num_threads=1))]

    def write(self, a: np.ndarray, b: np.ndarray, close_a: np.ndarray, close_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, ok: np.ndarray) -> None:
        """Appends each word's groups as ``a1,a2|b1;``: ids in the order of groups, A before B, each with the mark that follows it."""
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[close_a], last_b[close_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        entry = np.concatenate([a + last_a * len(self.a_bytes), 2 * len(self.a_bytes) + b + last_b * self.width])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        marks, ends = gathered(self.written, self.written_at, entry[order])
        text = marks.tobytes()
        of = np.concatenate([of_a, of_b])[order]
        edges = np.concatenate([[0], ends])[np.searchsorted(of, np.arange(int(ok.sum()) + 1))].tolist()
        found = iter([text[s:e] for s, e in pairwise(edges)])
        self.said += [next(found) if o else b"" for o in ok.tolist()]

    def keep(self, a_lists: list, b_lists: list, close_a: np.ndarray, close_b: np.ndarray, n_groups: np.ndarray, ok: np.ndarray) -> None:
        ends = np.cumsum(n_groups)
        sizes_a, sizes_b = np.diff(close_a, prepend=-1).tolist(), np.diff(close_b, prepend=-1).tolist()
        found = iter([(a, b, sizes_a[s:e], sizes_b[s:e]) for a, b, s, e in zip(a_lists, b_lists, (ends - n_groups).tolist(), ends.tolist(), strict=True)])
        self.parts += [next(found) if o else ([], [], [], []) for o in ok.tolist()]


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", a_path: str = BYTE_LEVEL, b_path: str = SENTENCE, keep_groups: bool = False) -> DataFrame:
    """One row per text: counts, the digest of its groups, and its links as A id * (size of B's vocabulary) + B id.

    ``keep_groups`` adds both id lists and how many of each make up every group. ``row`` tells rows apart within one run.
    """
    with open(a_path, encoding="utf-8") as f:
        json_text = f.read()
    with open(b_path, "rb") as f:
        model = f.read()
    a_size = max(json.loads(json_text)["model"]["vocab"].values()) + 1
    small = a_size * vocabulary_size(b_path) < 1 << 31
    schema = ALIGNED.format("int" if small else "bigint") + (GROUPS if keep_groups else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(json_text, model, keep_groups), TaskContext.get().partitionId() << 40
        for batch in slices(batches, lambda b: pc.utf8_length(b.column(1)), TEXT_AT_ONCE):
            texts = batch.column(1).fill_null("")
            odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
            for own, cutting in ((np.flatnonzero(~odd), at_spaces), (np.flatnonzero(odd), at_blanks)):
                if len(own):
                    some = pa.array(own)
                    yield rows_of(aligner, batch.column(0).take(some), cutting(texts.take(some)), row + own)
            row += batch.num_rows

    def at_blanks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        lists = [words_of(t) for t in texts.to_pylist()]
        found = pa.array([w for own in lists for w in own], pa.string()).dictionary_encode()
        return np.array([len(own) for own in lists]), found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()

    def rows_of(aligner: Aligner, ids: pa.Array, cut: tuple, row: np.ndarray) -> pa.RecordBatch:
        counts, codes, distinct = cut
        numbers = aligner.numbered(distinct)[codes]
        flat, starts = aligner.tables()
        ok = sums(1 - flat[starts[numbers]], counts) == 0
        if not ok.all():
            numbers, counts = numbers[np.repeat(ok, counts)], np.where(ok, counts, 0)
        heads = [sums(flat[starts[numbers] + i], counts) for i in range(1, HEAD)]
        links, _ = gathered(flat, starts, numbers, HEAD)
        n_links = sums(starts[numbers + 1] - starts[numbers] - HEAD, counts)
        said, listed, ends = aligner.said, numbers.tolist(), np.cumsum(counts).tolist()
        digests = [hashlib.sha256(b"".join([said[n] for n in listed[b - c:b]])[:-1]).hexdigest() if c else "" for b, c in zip(ends, counts.tolist(), strict=True)]
        as_lists = lambda sizes, values, kind: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values).cast(kind))
        columns = [pa.array(row), ids, *(pa.array(h, pa.int64()) for h in heads), pa.array(n_links, pa.int64()), pa.array(digests, pa.string()),
                   as_lists(n_links, links, pa.int32() if small else pa.int64())]
        if keep_groups:
            for part, sizes in enumerate((heads[0], heads[1], heads[2], heads[2])):
                columns.append(as_lists(sizes, flattened([aligner.parts[n][part] for n in listed])[0], pa.int32()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of all texts hold each pair of ids. Added up within each task before the shuffle."""
    return aligned.select(F.explode("links").alias("pair")).groupBy(F.col("pair").cast("long").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def scored(aligned: DataFrame, counts: DataFrame, width: int, pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """Stored rows of ``align`` with n_best and count_sum, from the stored pair counts of all texts."""
    highest = F.max("n").over(Window.partitionBy(F.col("pair") % width))
    marked = stored(counts.select("pair", "n", (F.col("n") == highest).alias("best")))
    n_slices = max(1, -(-marked.count() // pairs_at_once))
    parts = [looked_up(aligned, marked.where(F.col("pair") % n_slices == i)) for i in range(n_slices)]
    if n_slices == 1:
        return parts[0]
    added = parts[0]
    for p in parts[1:]:
        added = added.unionByName(p)
    kept = [c for c in aligned.columns if c not in ("row", "links")]
    return added.groupBy("row").agg(*[F.first(c).alias(c) for c in kept], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def looked_up(aligned: DataFrame, marked: DataFrame) -> DataFrame:
    table = marked.toPandas().sort_values("pair")
    pairs, n, best = (table[c].to_numpy() for c in ("pair", "n", "best"))
    # A last pair that no link equals keeps every search inside.
    pairs, n, best = np.append(pairs, np.iinfo(np.int64).max), np.append(n, 0), np.append(best.astype(bool), False)
    at = aligned.columns.index("links")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links") + ", n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, lambda b: pc.list_value_length(b.column(at)), LINKS_AT_ONCE):
            lists = batch.column(at)
            links, sizes = lists.flatten().to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy()
            place = np.searchsorted(pairs, links)
            hit = pairs[place] == links
            own = [c for i, c in enumerate(batch.columns) if i != at]
            found = [pa.array(sums(v, sizes), pa.int64()) for v in ((best[place] & hit).astype(np.int64), np.where(hit, n[place], 0))]
            yield pa.RecordBatch.from_arrays([*own, *found], names=[*(x for i, x in enumerate(batch.schema.names) if i != at), "n_best", "count_sum"])

    return aligned.mapInArrow(run, schema)


def vocabulary_size(b_path: str = SENTENCE) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
