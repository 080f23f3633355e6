"""Secrets by corpus-wide ownership: a value that many owners, or many repositories of several owners, share is a copied example;
one owner's value looks live.

``scan`` finds candidates in the row, ``ownership`` counts the distinct repositories and owners of each candidate hash
over the whole corpus, ``judged`` puts each candidate's verdict beside it and ``redact`` replaces live ones. Only
DataFrame functions are used. A null text is empty and has no candidates, null owners or repositories count as one
value of their own, rows that agree in id and text are judged once and each keep the result, an empty table gives an
empty one. Further input columns are carried by ``redact`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparsefold.llm.shared import let, row_key, stored, whole

#: Kind, pattern, group that is the secret, least characters of that group. Longer runs are matched whole, so a least
#: length inside a pattern drops the same runs as a check after it.
BASE = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Formats that name their issuer; the method adds them where they look live.
MARKED = ("marked", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|"
          r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 12)
KINDS = (*BASE, MARKED)
BLOCK = 256
MIN_OWNERS = 3
#: Two owners hold a copied example too, if it lies in so many of their repositories; one owner's own repositories prove nothing.
MIN_REPOS = 8
MIN_SYMBOLS = 6
MASK = "<secret>"

SPAN = "struct<kind:string,start:int,end:int,hash:string,alive:boolean>"


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one pattern. What lies between matches comes from splitting at the same pattern, so a match starts at the
    summed lengths of all before it; sums by blocks keep texts with very many matches cheap."""
    def located(x: Column) -> Column:
        def start(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            add = lambda a, b: a + b
            done = F.aggregate(F.slice(x["sums"], 1, block), F.lit(0), add)
            return done + F.aggregate(F.slice(x["lens"], block * BLOCK + 1, i - block * BLOCK), F.lit(0), add) + F.length(x["gaps"][i])

        def span(h: Column, i: Column) -> Column:
            return let(F.struct(start(i).alias("s"), x["secrets"][i].alias("v")), lambda y: F.when(F.length(y["v"]) >= least, F.struct(
                F.lit(kind).alias("kind"), y["s"].alias("start"), (y["s"] + F.length(h)).alias("end"),
                F.sha2(y["v"], 256).alias("hash"), looks_alive(y["v"]).alias("alive"))))

        return F.filter(F.transform(x["hits"], span), lambda s: s.isNotNull())

    def with_sums(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(x["lens"]) / BLOCK).cast("int")),
                           lambda b: F.aggregate(F.slice(x["lens"], b * BLOCK + 1, BLOCK), F.lit(0), lambda a, n: a + n))
        return let(F.struct(x["hits"].alias("hits"), x["secrets"].alias("secrets"), x["gaps"].alias("gaps"), x["lens"].alias("lens"),
                            sums.alias("sums")), located)

    def with_lens(x: Column) -> Column:
        lens = F.transform(x["hits"], lambda h, i: F.length(h) + F.length(x["gaps"][i]))
        return let(F.struct(x["hits"].alias("hits"), x["secrets"].alias("secrets"), x["gaps"].alias("gaps"), lens.alias("lens")), with_sums)

    extract = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    found = F.struct(extract(0).alias("hits"), extract(group).alias("secrets"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(found, with_lens)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def looks_alive(value: Column) -> Column:
    """Generated values mix letters with digits and use many symbols anywhere; placeholders such as repeated letters don't."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_SYMBOLS) \
        | value.startswith("-----BEGIN")


def candidates(text: Column) -> Column:
    return F.concat(*[matches(text, *k) for k in KINDS])


def has_candidate(text: Column) -> Column:
    """True for every text with candidates, cheap to test again."""
    return F.array_max(F.array(*[whole(text).rlike(k[1]) for k in KINDS]))


def scan(docs: DataFrame, doc_id: str, text: str, owner: Column, repo: Column) -> DataFrame:
    """(key, doc_id, owner, repo, found) per row: a compact stored table, as several passes read it."""
    body = whole(text)
    return stored(docs.select(row_key(F.col(doc_id), body).alias("key"), F.col(doc_id).alias("doc_id"), owner.cast("string").alias("owner"),
                              repo.cast("string").alias("repo"), candidates(body).alias("found")))


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos): hashes are reduced to distinct (owner, repo) before each shuffle, so a value that a
    third of all rows hold costs no more than its owners."""
    pairs = scanned.select("owner", "repo", F.explode("found.hash").alias("hash")).groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("one").alias("n"))
    return owners.groupBy("hash").agg(F.count("n").alias("n_owners"), F.sum("n").alias("n_repos"))


def judged(scanned: DataFrame, min_owners: int = MIN_OWNERS) -> DataFrame:
    """(key, spans): the candidates of each row that has any, by start, then kind as listed, each with its verdict:
    ``example`` (``min_owners`` distinct owners hold the value, or several do in ``MIN_REPOS`` distinct repositories), ``live`` (fewer, and it looks
    generated) or ``dull``."""
    each = scanned.where(F.size("found") > 0).select("key", F.explode("found").alias("c")) \
        .groupBy("key", "c").agg(F.lit(1).alias("one")).select("key", "c", F.col("c.hash").alias("hash"))
    verdict = F.when((F.col("n_owners") >= min_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= MIN_REPOS)), "example").when(F.col("c.alive"), "live").otherwise("dull")
    rank = F.array_position(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("c.kind"))
    span = F.struct(F.col("c.start").alias("start"), rank.alias("rank"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end"),
                    verdict.alias("verdict"), "n_owners", "n_repos")
    return each.join(ownership(scanned), "hash").groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id",
           min_owners: int = MIN_OWNERS, n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with live secrets masked; ``n_chars``, if given, follows the new text. Texts without candidates pass
    unshuffled; the others meet the verdicts by row key."""
    scanned = scan(docs, doc_id, text, F.col(owner), F.col(repo))
    live = judged(scanned, min_owners).select("key", F.filter("spans", lambda s: s["verdict"] == "live").alias("spans")) \
        .where(F.size("spans") > 0)
    flagged = docs.where(has_candidate(F.col(text))).select(F.struct("*").alias("row"), row_key(F.col(doc_id), whole(text)).alias("key"))
    met = flagged.join(live, "key", "left")
    clean = F.when(F.col("spans").isNull(), F.col(f"row.`{text}`")).otherwise(masked(F.col(f"row.`{text}`"), F.col("spans")))
    changed = met.select("row", clean.alias("clean"))
    cells = []
    for c in docs.columns:
        if c == text:
            cells.append(F.col("clean").alias(c))
        elif c == n_chars:
            cells.append(F.when(F.col("clean").isNull(), F.col(f"row.`{c}`")).otherwise(F.length("clean").cast(docs.schema[c].dataType)).alias(c))
        else:
            cells.append(F.col(f"row.`{c}`"))
    return docs.where(~F.coalesce(has_candidate(F.col(text)), F.lit(False))).unionByName(changed.select(*cells))


def masked(text: Column, spans: Column) -> Column:
    """Of spans that overlap, one mask covers all: each span puts its mask in front of the text up to the next span."""
    def widen(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], s["end"]).alias("e"))
        return F.when(last["e"] > s["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))) \
            .otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("s"), s["end"].alias("e")))))

    merged = F.aggregate(spans, F.expr("cast(array() as array<struct<s:int,e:int>>)"), widen)

    def build(m: Column) -> Column:
        tail = lambda x, i: F.substring(text, x["e"] + 1, F.coalesce(F.try_element_at(m, i + 2)["s"], F.length(text)) - x["e"])
        return F.concat(F.substring(text, F.lit(1), m[0]["s"]), F.array_join(F.transform(m, lambda x, i: F.concat(F.lit(MASK), tail(x, i))), ""))

    return let(merged, build)
