"""SimHash fingerprints by weighted votes, and all fingerprints within a Hamming radius by permuted block tables.

DataFrame functions only. A term's 64 bit hash votes with its weight on every bit; two bits share one sum (32 bits
each), so a text's votes are 32 sums. The sums hold texts of up to 14 million words. A null text is empty; a text
without words has fingerprint zero. Repeated rows get equal results each, an empty table gives an empty one, and only
the named columns of the input are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsefold.llm.shared import broadcast_if_small, stored, whole

BITS = 64
SPACE = " \t\n\x0b\x0c\r"
PAIR = (1 << 32) + 1
LONG_WORD = 12
RADIUS, BLOCKS = 3, 5
CELL_ROWS, MAX_CELLS = 2000, 1_000_000


def words(text: Column) -> Column:
    """Runs of characters other than ASCII space, in order."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.expr("cast(array() as array<string>)"))


def votes(hashed: Column, weight: Column) -> list[Column]:
    """Aggregates that ``fingerprint`` reads: 32 sums of paired votes and the sum of weights."""
    pairs = [F.sum(F.shiftrightunsigned(hashed, b).bitwiseAND(F.lit(PAIR)) * weight).alias(f"v{b}") for b in range(BITS // 2)]
    return [*pairs, F.sum(weight).alias("weight")]


def fingerprint() -> Column:
    """A bit is set if the terms that set it hold over half of the weight."""
    bits = []
    for b in range(BITS // 2):
        low, high = F.col(f"v{b}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{b}", 32)
        bits += [F.when(x * 2 > F.col("weight"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for x, i in ((low, b), (high, b + 32))]
    return reduce(Column.bitwiseOR, bits)


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def word_fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp) per distinct keys: each word votes with the square of its length, as longer words are rarer."""
    terms = texts.select(*keys, F.explode_outer(words(F.col(text))).alias("word"))
    size = F.least(F.coalesce(F.length("word"), F.lit(0)), F.lit(LONG_WORD)).cast("long")
    return terms.groupBy(*keys).agg(*votes(F.xxhash64("word"), size * size)).select(*keys, fingerprint().alias("fp"))


def block_masks(blocks: int, agree: int) -> list[int]:
    """Masks of ``agree`` of ``blocks`` blocks each, as signed 64 bit numbers."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [(m := sum(part[i] for i in own)) - (1 << 64) * (m >> 63) for own in combinations(range(blocks), agree)]


def within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, bits): every pair of a query and a fingerprint that differ in ``radius`` bits or fewer, once.

    Both inputs have distinct ``fp``. Pairs within the radius agree on at least ``blocks - radius`` whole blocks, so they
    share a row of one of the tables keyed by those; only the first table that a pair shares reports it.
    """
    masks = block_masks(blocks, blocks - radius)
    if not masks or radius >= blocks:
        raise ValueError("more blocks than bits that may differ are needed")

    def tables(df: DataFrame, name: str) -> DataFrame:
        keyed = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
        return df.select(F.col("fp").alias(name), F.explode(keyed).alias("k")).select(name, "k.t", "k.key")

    apart = F.col("query").bitwiseXOR(F.col("other"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    q, o = tables(queries, "query"), tables(fps, "other")
    pairs = q.join(o, (q["t"] == o["t"]) & (q["key"] == o["key"]) & (F.bit_count(apart) <= radius) & (first == q["t"]))
    return pairs.select("query", F.col("other").alias("fp"), F.bit_count(apart).alias("bits"))


def cells_of(ids: DataFrame) -> str:
    """The cell of ``id`` in SQL, such that cells of equal width hold some ``CELL_ROWS`` rows at most where ids differ.

    Ids that span most of a long are halved twice first, so that no difference leaves its range.
    """
    low, high, n = ids.agg(F.min("id"), F.max("id"), F.count("*")).first()
    if low is None:
        return "0L"
    halvings = 0 if high - low < 1 << 62 else 2
    low, high, want = low >> halvings, high >> halvings, max(CELL_ROWS, n // MAX_CELLS)
    cell = lambda width: f"(shiftright(id, {halvings}) - ({low})) div {width}"
    width = max(1, (high - low + 1) * want // max(n, 1))
    while width > 1:
        fullest = ids.groupBy(F.expr(cell(width))).count().agg(F.max("count")).first()[0]
        if fullest <= 4 * want:
            break
        width = max(1, width * want // fullest)
    return cell(width)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(cell, place, doc_id, text, next_text, ghost): each row's text beside that of the row with the next smaller id; the last
    row's next is the first. Rows of one id follow each other by text, rows without an id come last. (cell, place) is
    unique. Ids are cut into cells of bounded size; the first row of each cell also ends the cell above it, there with
    ``ghost`` 1 and no next text, so no task needs more than one cell, and texts are shuffled once."""
    known = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    cell = cells_of(known.select(F.col("doc_id").cast("long").alias("id")).where("id is not null"))
    placed = known.withColumn("id", F.col("doc_id").cast("long")).withColumn("cell", F.coalesce(F.expr(cell), F.lit(-1)).cast("long")).drop("id")

    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    # Compact: the first row of each cell in the order is the one of its greatest id, least text.
    tops = placed.groupBy("cell").agg(F.max("doc_id").alias("top"))
    by_cell = Window.orderBy("cell")
    above = F.coalesce(F.lead("cell").over(by_cell), F.min("cell").over(Window.partitionBy()))
    heads = stored(tops.select("cell", "top", above.alias("to")))
    top = broadcast_if_small(heads, 64)
    first = placed.join(top, (placed["cell"] == top["cell"]) & placed["doc_id"].eqNullSafe(top["top"])) \
        .groupBy(placed["cell"], top["to"]).agg(F.min_by(F.struct("doc_id", "text"), "text").alias("r"))
    ghosts = first.select(F.col("to").alias("cell"), "r.doc_id", "r.text", F.lit(1).alias("ghost"))
    both = placed.select("cell", "doc_id", "text", F.lit(0).alias("ghost")).unionByName(ghosts)
    w = Window.partitionBy("cell").orderBy("ghost", *order)
    return both.select("cell", F.row_number().over(w).alias("place"), "doc_id", "text", F.lead("text").over(w).alias("next_text"), "ghost")


def edited(text: Column, next_text: Column) -> Column:
    """The last third replaced by as many first characters of the next text."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(next_text, F.lit(1), k))


def fingerprint_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp), stored: each row's fingerprint, that of its edited text and
    that of the next row."""
    rows = with_next(docs, doc_id, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    digest = F.unhex(F.sha2("edited", 256))
    facts = ["cell", "place", "doc_id", "ghost", "n_chars", "digest"]
    bodies = rows.select("cell", "place", "doc_id", "ghost", F.length("text").cast("long").alias("n_chars"), digest.alias("digest"),
                         F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("b"))
    fps = word_fingerprints(bodies.select(*facts, "b.which", F.coalesce("b.body", F.lit("")).alias("body")), [*facts, "which"], "body")
    by_row = fps.groupBy(*facts).agg(*[F.max(F.when(F.col("which") == i, F.col("fp"))).alias(n) for i, n in enumerate(("fp", "edited_fp"))])
    following = F.lead("fp").over(Window.partitionBy("cell").orderBy("place"))
    return stored(by_row.withColumn("next_fp", following).where("ghost = 0").select("doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), "fp", "edited_fp", "next_fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def found_within(rows: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, n, found): for each distinct fingerprint of the rows that ``asked`` selects, the rows within the radius, its own included, and
    the distinct fingerprints (fp, bits) that they have, of which a radius of 3 bits allows 43,745 at most."""
    sizes = stored(rows.groupBy("fp").agg(F.count("*").alias("rows"), F.max(asked).alias("asked")))
    pairs = within(sizes.where("asked").select("fp"), sizes.select("fp"), radius)
    return pairs.join(sizes.select("fp", "rows"), "fp").groupBy(F.col("query").alias("fp")).agg(
        F.sum("rows").alias("n"), F.array_sort(F.collect_list(F.struct("bits", "fp"))).alias("found"))
