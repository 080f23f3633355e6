"""DuckDB twins of the queries that SQL can express."""

from sparsefold.llm import mixing, secrets, urls


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP2 = f"""
WITH RECURSIVE sized AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(size, {mixing.ALPHA}) AS weight FROM sized),
total AS (SELECT sum(size) AS s, sum(weight) AS w FROM weighted),
rated AS (SELECT source, CASE WHEN size > 0 THEN weight / w * s / size ELSE 1.0 END AS rate FROM weighted, total),
parts AS (SELECT source, greatest(ceil(rate / {mixing.PART})::INT, 1) AS n, rate / greatest(ceil(rate / {mixing.PART})::INT, 1) AS mean FROM rated),
dist(source, mean, k, p, below) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) FROM dist WHERE k < {mixing.TERMS - 1}),
cdf AS (SELECT source, list(below ORDER BY k) AS belows FROM dist GROUP BY source),
keyed AS (SELECT d.*, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS identity FROM documents d),
drawn AS (
  SELECT k.*, list_sum(list_transform(range(1, n + 1), lambda j: len(list_filter(belows,
    lambda b: b <= ('0x' || substr(md5('count{mixing.SEED}:' || identity || ':' || j), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)}::DOUBLE)))) AS times
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source JOIN cdf c ON c.source IS NOT DISTINCT FROM p.source),
copies AS (SELECT doc_id, text, lang, source, n_chars, identity, unnest(range(1, times::BIGINT + 1)) AS copy FROM drawn WHERE times > 0)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, ('0x' || substr(md5('place{mixing.SEED}:' || identity || ':' || copy), 1, 15))::BIGINT AS position FROM copies
"""


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The assignment pattern with its letters' cases spelt out, as case folding here knows more than A-Z.
ASSIGN = f"(?:{'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
PATTERNS = [(k, ASSIGN if k == "assign" else p, g, n) for k, p, g, n in secrets.KINDS]
BASE_KINDS = ", ".join(quoted(k[0]) for k in secrets.BASE)
FOUND = "\nUNION ALL ".join(
    f"SELECT doc_id, source, lang, {rank} AS rank, {quoted(k)} AS kind, {n} AS least, regexp_extract_all(t, {quoted(p)}, 0) AS hits, "
    f"regexp_extract_all(t, {quoted(p)}, {g}) AS vals, string_split_regex(t, {quoted(p)}) AS gaps FROM docs" for rank, (k, p, g, n) in enumerate(PATTERNS, 1))
OP3 = f"""
WITH docs AS (SELECT *, coalesce(text, '') AS t FROM documents),
found AS ({FOUND}),
each AS (SELECT doc_id, source, lang, rank, kind, least, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM found),
placed AS (
  SELECT doc_id, source, lang, rank, kind, vals[i] AS v,
    (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS s, length(hits[i]) AS n
  FROM each WHERE length(vals[i]) >= least),
owned AS (SELECT v, count(DISTINCT coalesce('+' || source, '-')) AS owners,
  count(DISTINCT coalesce('+' || source, '-') || chr(31) || concat_ws('/', source, lang)) AS repos FROM placed GROUP BY v),
judged AS (
  SELECT p.*, kind || ':' || s || ':' || (s + n) AS said, kind IN ({BASE_KINDS}) AS base,
    CASE WHEN owners >= {secrets.MIN_OWNERS} OR (owners > 1 AND repos >= {secrets.MIN_REPOS}) THEN 'example'
      WHEN (regexp_matches(p.v, '[0-9]') AND regexp_matches(p.v, '[A-Za-z]') AND len(list_distinct(string_split(p.v, ''))) >= {secrets.MIN_SYMBOLS})
        OR starts_with(p.v, '-----BEGIN') THEN 'live' ELSE 'dull' END AS verdict
  FROM placed p JOIN owned o ON p.v = o.v),
summed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(said, ',' ORDER BY s, rank) FILTER (base) AS base, string_agg(said, ',' ORDER BY s, rank) FILTER (base OR verdict = 'live') AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN summed s ON d.doc_id IS NOT DISTINCT FROM s.doc_id
"""

RULES = ", ".join(f"({quoted(r)}, {quoted(r.partition('/')[0])}, {quoted('/' + r.partition('/')[2])}, {quoted(v)})" for r, v in urls.RULES)
OP5 = f"""
WITH rules(rule, h, p, said) AS (VALUES {RULES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
parsed AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(u, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
  regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN regexp_matches(host, {quoted(urls.BAD_LABELS)}) THEN 'block' ELSE 'allow' END) AS verdict,
  regexp_matches(host, {quoted(urls.BAD_LABELS)}) AS listed_host
FROM parsed LEFT JOIN best USING (n)
"""

#: CRC-32 of the text K, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(K) + 1), lambda i: unicode(substr(K, i, 1))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda j: 0::BIGINT)),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def path(cost: str, edit: str, said: str, rest: str) -> str:
    """Cost, audit and repaired lines of an edit in front of the path ``rest``."""
    return f"{{'c': ({cost}) + {rest}.c, 'e': '{edit}' || {rest}.e, 'r': {said} || {rest}.r}}"


def edited(state: int) -> str:
    """The least path behind a row, over keeping, giving a role and deleting it, from a state that lets the next role be ``after``."""
    after, role = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))[state]
    keep = {0: "CASE first WHEN 's' THEN {s} WHEN 'u' THEN {u} END", 2: "CASE first WHEN 'a' THEN {a} END"}.get(state, "CASE first WHEN 'u' THEN {u} END")
    own = {x: path("late", "K", "chr(10) || role || ':' || text", f"s{to}") for x, to in (("s", 1), ("u", 2), ("a", 3))}
    given = path("late + 2", "R", f"chr(10) || '{role}:' || text", f"s{after}")
    return f"list_min(list_filter([{path('3', 'D', chr(39) * 2, f's{state}')}, CASE WHEN NOT forced THEN {keep.format(**own)} END, CASE WHEN NOT forced THEN {given} END], lambda x: x IS NOT NULL))"


def inserted(state: int) -> str:
    """The least of a path, one behind an inserted row, and one behind two."""
    one, two = ((2, 3), (2, 3), (3, 2), (2, 3))[state]
    user, both = ("user", "user:' || chr(10) || 'assistant:") if state != 2 else ("assistant", "assistant:' || chr(10) || 'user:")
    return f"list_min([b{state}, {path('2', 'I', f'chr(10) || {chr(39)}{user}:{chr(39)}', f'b{one}')}, {path('4', 'II', f'chr(10) || {chr(39)}{both}{chr(39)}', f'b{two}')}])"


OP12 = f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC.replace('K', "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
told AS (
  SELECT *, left(role, 1) AS first, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
rows AS (SELECT *, fault IN ('blank', 'duplicate') AS forced, (fault = 'truncated')::BIGINT AS late FROM told),
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, n + 1, {{'c': 0::BIGINT, 'e': '', 'r': ''}}, {{'c': 4::BIGINT, 'e': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}},
    {{'c': 2::BIGINT, 'e': 'I', 'r': chr(10) || 'assistant:'}}, {{'c': 0::BIGINT, 'e': '', 'r': ''}} FROM placed
  UNION ALL
  SELECT conv_id, i, {", ".join(inserted(s) for s in range(4))}
  FROM (SELECT w.conv_id, r.i, {", ".join(f"{edited(s)} AS b{s}" for s in range(4))}
    FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i - 1) t),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || first NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s0.c, 0) AS cost, coalesce(s0.e, '') AS audit, sha256(coalesce(substr(s0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 1
"""

ORACLES = {"op2_mixing": OP2, "op3_secrets": OP3, "op5_urls": OP5, "op12_repair": OP12}
