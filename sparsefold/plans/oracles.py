"""DuckDB SQL giving the same result as the query of the same name."""

from __future__ import annotations

from sparsefold.operators.descriptors import DESCRIPTORS as DESC, TEXT_RULES

TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def bit(expr: str, n: int) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT % {n})::INTEGER"


def h(row_id: str, seed) -> str:
    return f"md5(concat({row_id}, '|', {seed}))"


REC = "rec AS (SELECT d.*, l.quality AS y FROM documents d JOIN labels l USING (doc_id))"


def tok(source: str) -> str:
    return f"tok AS (SELECT doc_id, {TOK} AS t FROM {source})"


WORDS = """word AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tok),
nxt AS (SELECT doc_id, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""


def bits(source: str, n: int, only_words: bool = False) -> str:
    if only_words:
        return f"""{tok(source)}, {WORDS}, bits AS (SELECT DISTINCT doc_id, {bit("w", n)} AS bit FROM nxt)"""
    return f"""{tok(source)}, {WORDS},
gram AS (SELECT doc_id, w AS g FROM nxt UNION SELECT doc_id, w || ' ' || w2 FROM nxt WHERE w2 IS NOT NULL
    UNION SELECT doc_id, w || ' ' || w2 || ' ' || w3 FROM nxt WHERE w3 IS NOT NULL),
bits AS (SELECT DISTINCT doc_id, {bit("g", n)} AS bit FROM gram)"""


REC_BITS = lambda n, only_words=False: f"{REC}, {bits('rec', n, only_words)}, rb AS (SELECT b.doc_id, b.bit, r.y FROM bits b JOIN rec r USING (doc_id))"


def outside(chars: str) -> str:
    return f"length(regexp_replace(text, '{chars}', '', 'g'))"


RAW_DESC = {
    "n_chars": "length(text)",
    "n_tokens": "len(t)",
    "n_distinct": "len(list_distinct(t))",
    "mean_token_len": "length(array_to_string(t, ''))::DOUBLE / nullif(len(t), 0)",
    "longest_token": "list_max(list_transform(t, lambda w: length(w)))",
    "type_token_ratio": "len(list_distinct(t))::DOUBLE / nullif(len(t), 0)",
    "digit_ratio": f"{outside('[^0-9]')}::DOUBLE / nullif(length(text), 0)",
    "punct_ratio": "length(regexp_replace(text, '[\\p{L}\\p{N} \\t\\r\\n]', '', 'g'))::DOUBLE / nullif(length(text), 0)",
    "upper_ratio": f"{outside('[^A-Z]')}::DOUBLE / nullif(length(text), 0)",
    "space_ratio": "(length(text) - length(replace(text, ' ', '')))::DOUBLE / nullif(length(text), 0)",
    "n_lines": "length(text) - length(replace(text, chr(10), '')) + 1",
}
DESC_CTE = (f"dt AS (SELECT doc_id, text, {TOK} AS t FROM documents), dsc AS (SELECT doc_id, "
            + ", ".join(f"({RAW_DESC[c]})::DOUBLE AS {c}" for c in DESC) + " FROM dt)")
MELT = "melted AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS feature, {c} AS value FROM dsc" for c in DESC) + ")"
PART = f"""part AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {h('doc_id', 1)}, doc_id)
    <= round(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM documents)"""

KEY_SQL = [
    "regexp_matches(text, '[0-9]')", "contains(text, '@')", "contains(text, 'http')", "contains(text, chr(10))",
    "contains(text, '?')", "contains(text, '!')", "contains(text, ':')", "contains(text, '\"')",
    "contains(text, '{')", "regexp_matches(text, '[A-Z]{3}')", "regexp_matches(text, '[0-9]{5}')",
    "length(text) > 1000", "length(text) > 5000", "lang = 'en'", "regexp_matches(text, '^[A-Z]')",
    "suffix(text, '.')",
]
KEYS = "keys AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS key FROM documents WHERE {c}" for i, c in enumerate(KEY_SQL, 1)) + ")"

FEATURES = f"""{bits('documents', 1024)}, {KEYS}, {DESC_CTE}, {MELT},
f AS (SELECT doc_id, 'ng' AS family, 'ng_' || bit AS feature FROM bits
      UNION ALL SELECT doc_id, 'key', 'key_' || key FROM keys
      UNION ALL SELECT doc_id, 'num', feature FROM melted WHERE value IS NOT NULL)"""


def pairs(n: int) -> str:
    return f"""{REC_BITS(n)}, sup AS (SELECT bit, count(*) AS n FROM rb GROUP BY bit),
co AS (SELECT p.bit AS a, q.bit AS b, count(*) AS "both" FROM rb p JOIN rb q ON p.doc_id = q.doc_id AND p.bit < q.bit
       GROUP BY 1, 2),
sim AS (SELECT a, b, "both", "both"::DOUBLE / (x.n + z.n - "both") AS sim FROM co JOIN sup x ON x.bit = a
        JOIN sup z ON z.bit = b)"""


def chi2(n: int) -> str:
    return f"""{REC_BITS(n, True)}, tot AS (SELECT avg(y) AS p FROM rec),
s AS (SELECT bit, count(*) AS support, sum(y) AS pos FROM rb GROUP BY bit),
c AS (SELECT bit, support, pos::DOUBLE / support AS rate,
             (pos - p * support) ** 2 / (p * support)
             + (support - pos - (1 - p) * support) ** 2 / ((1 - p) * support) AS chi2 FROM s, tot)"""


SIG_NEG = "chi2 > 3.841458820694124 AND rate < 0.40"
SIG_POS = "chi2 > 3.841458820694124 AND rate > 0.80"

GRAPH = f"""{REC}, {tok('rec')},
nodes AS (SELECT DISTINCT doc_id, unnest(t) AS node FROM tok),
{WORDS},
nbr AS (SELECT doc_id, w AS node, w2 AS nbr FROM nxt WHERE w <> w2 UNION SELECT doc_id, w2, w FROM nxt WHERE w <> w2),
l0 AS (SELECT doc_id, node, md5(node) AS label FROM nodes),
l1 AS (SELECT l0.doc_id, l0.node, md5(any_value(l0.label) || coalesce(string_agg(m.label, '' ORDER BY m.label), '')) AS label
       FROM l0 LEFT JOIN nbr USING (doc_id, node) LEFT JOIN l0 m ON m.doc_id = l0.doc_id AND m.node = nbr.nbr GROUP BY 1, 2),
l2 AS (SELECT l1.doc_id, l1.node, md5(any_value(l1.label) || coalesce(string_agg(m.label, '' ORDER BY m.label), '')) AS label
       FROM l1 LEFT JOIN nbr USING (doc_id, node) LEFT JOIN l1 m ON m.doc_id = l1.doc_id AND m.node = nbr.nbr GROUP BY 1, 2),
lab AS (SELECT doc_id, label FROM l0 UNION ALL SELECT doc_id, label FROM l1 UNION ALL SELECT doc_id, label FROM l2),
nf AS (SELECT doc_id, {bit('label', 1024)} AS bit, count(*) AS n FROM lab GROUP BY 1, 2)"""

U = f"('0x' || substr({h('doc_id', 'seed')}, 1, 8))::BIGINT % 1000 / 1000.0::DOUBLE"
LEN = "least(1.0::DOUBLE, n_chars / 4000.0::DOUBLE)"
THREE = f"""{REC}, sc AS (SELECT seed::INTEGER AS seed, doc_id, y, {U} AS m1, {LEN} AS m2, ({U} + {LEN}) / 2 AS m3
    FROM rec, range(1, 6) s(seed)),
three AS (SELECT seed, doc_id, y, 'm1' AS model, m1 AS prob FROM sc UNION ALL SELECT seed, doc_id, y, 'm2', m2 FROM sc
    UNION ALL SELECT seed, doc_id, y, 'm3', m3 FROM sc)"""


def auc(source: str, by: str) -> str:
    return f"""cum AS (SELECT {by}, prob, sum(y) AS p, sum(1 - y) AS n FROM {source} GROUP BY ALL),
win AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS below FROM cum),
auc AS (SELECT {by}, sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM win GROUP BY ALL)"""


def confusion(source: str, by: str) -> str:
    return f"""cell AS (SELECT {by}, sum(CASE WHEN y = 1 AND prob > 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tp,
    sum(CASE WHEN y = 0 AND prob <= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tn,
    sum(CASE WHEN y = 0 AND prob > 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fp,
    sum(CASE WHEN y = 1 AND prob <= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM {source} GROUP BY ALL),
conf AS (SELECT {by}, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
    coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity FROM cell)"""


PREDS = f"{THREE}, {PART}, preds AS (SELECT three.*, part.part FROM three JOIN part USING (doc_id))"
LOSS = """loss AS (SELECT model, seed,
    avg(-(y * ln(least(greatest(prob, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15)))) AS logloss,
    avg(abs(y - CASE WHEN prob > 0.5 THEN 1 ELSE 0 END)) AS mae FROM three GROUP BY ALL)"""


def scaled(value: str, fit: str) -> str:
    return f"""WITH {DESC_CTE}, {MELT}, {PART},
fit AS (SELECT feature, {fit} FROM melted JOIN part USING (doc_id) WHERE part = 'train' GROUP BY feature)
SELECT doc_id, feature, round({value}, 8) AS scaled FROM melted JOIN fit USING (feature)"""


def pearson() -> str:
    body = " UNION ALL ".join(
        f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM dsc"
        for i, a in enumerate(DESC) for b in DESC[i + 1:])
    return f"{DESC_CTE}, pr AS ({body})"


POINTS = """pt AS (SELECT vec_id, i, embedding[4*i+1]::DOUBLE AS x, embedding[4*i+2]::DOUBLE AS y,
    embedding[4*i+3]::DOUBLE AS z, embedding[4*i+4]::DOUBLE AS w FROM embeddings, range(16) s(i)),
pp AS (SELECT a.vec_id, least(floor(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) / 0.1), 9)::INTEGER AS bin, a.w * b.w AS w
    FROM pt a JOIN pt b ON a.vec_id = b.vec_id AND a.i < b.i)"""
COORDS = ["embedding[1]::DOUBLE", "embedding[2]::DOUBLE", "embedding[3]::DOUBLE"]
COV = """SELECT label, a.i::INTEGER AS i, b.j::INTEGER AS j, covar_pop(embedding[a.i + 1]::DOUBLE, embedding[b.j + 1]::DOUBLE) AS cov
    FROM embeddings, range(64) a(i), range(64) b(j) WHERE a.i <= b.j GROUP BY 1, 2, 3"""
MASKED = "CASE WHEN abs(o_totalprice) <= 100000 THEN o_totalprice END"

GRAM = """g AS (SELECT a.vec_id AS a, (0.001::DOUBLE * list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) ** 2 AS k,
    (0.001::DOUBLE * list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) + 1) ** 2 AS own FROM embeddings a, embeddings b)"""
SCALED = f"""{REC}, dt AS (SELECT doc_id, y, text, {TOK} AS t FROM rec),
raw AS (SELECT doc_id, y, {", ".join(f"coalesce(round(({RAW_DESC[c]})::DOUBLE, 6), 0) AS {c}" for c in DESC)} FROM dt),
top AS (SELECT {", ".join(f"coalesce(nullif(max(abs({c})), 0), 1) AS {c}_m" for c in DESC)} FROM raw),
pts AS (SELECT doc_id, y, {", ".join(f"{c} / {c}_m AS {c}" for c in DESC)} FROM raw, top)"""
GAP = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in DESC)
CLASSES = f"{REC}, c AS (SELECT y, count(*) AS n FROM rec GROUP BY y), cls AS (SELECT y, n, (SELECT max(n) FROM c) AS top FROM c)"

ORACLES = {
    "src_labelled_records": f"WITH {REC} SELECT doc_id, y, n_chars FROM rec",
    "src_tsv_roundtrip": "SELECT * FROM documents",
    "label_recode": """SELECT doc_id, CASE quality WHEN 1 THEN 'Permeable' WHEN 0 THEN 'Non_permeable' END AS target,
        quality AS target_num FROM labels""",
    "label_index_alpha": "SELECT lang, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS code, count(*) AS n FROM documents GROUP BY lang",
    "label_inverse": "SELECT doc_id, lang FROM documents",
    "class_balance": "SELECT quality AS y, count(*) AS n FROM labels GROUP BY 1",
    "balanced_weights": "SELECT quality AS y, round((SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)), 6) AS w FROM labels GROUP BY 1",
    "feature_family_stats": f"""WITH {FEATURES} SELECT family, count(DISTINCT feature) AS n_features, count(*) AS n_cells
        FROM f GROUP BY family""",
    "assemble_families": f"""WITH {FEATURES} SELECT doc_id, count(*) FILTER (family = 'ng') AS n_bits,
        count(*) FILTER (family = 'key') AS n_keys, count(*) FILTER (family = 'num') AS n_nums FROM f GROUP BY doc_id""",
    "melt_features": f"WITH {DESC_CTE}, {MELT} SELECT doc_id, feature, round(value, 6) AS value FROM melted",
    "feature_as_array": f"""WITH {DESC_CTE}, {MELT}
        SELECT feature, floor(doc_id / 256)::BIGINT AS chunk, count(*) AS n,
        string_agg(coalesce(round(value * 1000)::BIGINT::VARCHAR, '?'), ',' ORDER BY doc_id) AS "column" FROM melted GROUP BY 1, 2""",
    "similarity_pivot": f"WITH {pairs(16)} SELECT i::INTEGER AS bit_1, "
        + ", ".join(f"round(max(sim) FILTER (b = {c}), 6) AS c_{c}" for c in range(16))
        + " FROM range(16) s(i) LEFT JOIN sim ON a = i GROUP BY 1",
    "missing_profile": f"""WITH m AS (SELECT {MASKED} AS p, o_orderdate AS d FROM orders)
        SELECT 'o_totalprice' AS "column", count(*) FILTER (p IS NULL) AS n_missing, count(*) AS n_rows FROM m
        UNION ALL SELECT 'o_orderdate', count(*) FILTER (d IS NULL), count(*) FROM m
        UNION ALL SELECT '*', count(*) FILTER (p IS NULL OR d IS NULL), count(*) FROM m""",
    "rank_by_abs": f"""WITH {REC_BITS(1024, True)}, c AS (SELECT bit, round(avg(y) - (SELECT avg(y) FROM rec), 6) AS coef FROM rb GROUP BY bit)
        SELECT bit, coef, row_number() OVER (ORDER BY abs(coef) DESC, bit)::INTEGER AS rank FROM c WHERE coef <> 0""",
    "join_features_outer": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, (d.doc_id IS NOT NULL)::INTEGER AS has_doc,
        (l.doc_id IS NOT NULL)::INTEGER AS has_label FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""",
    "feature_pairs": f"""WITH {REC_BITS(4096, True)} SELECT a.bit AS a, b.bit AS b, count(*) AS "both" FROM rb a JOIN rb b ON a.doc_id = b.doc_id AND a.bit < b.bit
        GROUP BY 1, 2 HAVING count(*) * 5 >= (SELECT count(*) FROM rec)""",
    "tanimoto_rows": f"""WITH {bits('documents', 1 << 20)}, s AS (SELECT d.doc_id, list_sort(coalesce(list(bit) FILTER (bit IS NOT NULL), [])) AS b
        FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY d.doc_id),
        f AS (SELECT b, min(doc_id) AS id, len(b) AS n FROM s GROUP BY b),
        p AS (SELECT y.id AS doc_id, x.id AS nbr, len(list_intersect(x.b, y.b)) AS k, x.n + y.n AS n FROM f x JOIN f y ON x.id < y.id AND least(x.n, y.n) >= 0.95 * greatest(x.n, y.n) - 1e-9 AND x.n > 0 AND y.n > 0)
        SELECT s.doc_id, f.id AS nbr, 1.0::DOUBLE AS sim FROM s JOIN f ON s.b = f.b WHERE s.doc_id <> f.id
        UNION ALL SELECT doc_id, nbr, round(k::DOUBLE / (n - k), 6) FROM p WHERE k::DOUBLE / (n - k) >= 0.95""",
    "kpca_landmark_bounds": f"""WITH {bits('documents', 1024, True)}, n AS (SELECT d.doc_id, count(bit) AS n FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || '|1'), doc_id) AS place FROM n)
        SELECT doc_id, round((0.001::DOUBLE * n + 1) * (0.001::DOUBLE * n + 1), 6) AS k_self, true AS "within", CASE WHEN place <= 512 THEN true END AS exact FROM o""",
    "oof_folds": f"""WITH {REC} SELECT doc_id, (('0x' || substr({h('doc_id', 8516)}, 1, 8))::BIGINT % 5)::INTEGER AS fold, y AS actual, true AS scored FROM rec""",
    "platt_rows": f"WITH {REC} SELECT doc_id, y, true AS scored FROM rec",
    "search_settings": """WITH c AS (SELECT i, pow(10::DOUBLE, -2 + 3 * i / 29.0::DOUBLE) AS c FROM range(30) t(i))
        SELECT (2 * i + b)::INTEGER AS at, round(c, 6) AS c, b = 1 AS balanced, 20 AS n_reps, true AS possible FROM c, range(2) u(b)""",
    "autocorr_graph": f"""WITH {tok('documents')}, word AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tok),
        nxt AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM word),
        e AS (SELECT DISTINCT doc_id, w, v FROM nxt WHERE v IS NOT NULL AND w <> v UNION SELECT DISTINCT doc_id, v, w FROM nxt WHERE v IS NOT NULL AND w <> v),
        far AS (SELECT DISTINCT a.doc_id, a.w, b.v FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.v = b.w WHERE a.w <> b.v),
        apart AS (SELECT doc_id, w, v, 1 AS lag FROM e UNION ALL SELECT doc_id, w, v, 2 FROM (SELECT * FROM far EXCEPT SELECT * FROM e)),
        s AS (SELECT doc_id, lag, sum(length(w) * length(v)) / 2 AS ac FROM apart GROUP BY 1, 2)
        SELECT d.doc_id, l::INTEGER AS lag, coalesce(ac, 0)::DOUBLE AS ac FROM documents d CROSS JOIN range(1, 3) r(l) LEFT JOIN s ON s.doc_id = d.doc_id AND s.lag = l""",
    "results_from_log": f"""WITH {PREDS}, {auc('preds', 'model, part, seed')}, {confusion('preds', 'model, part, seed')}
        SELECT 'twice' AS run, model, part, seed, round(auc, 6) AS auc, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1,
        round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM auc JOIN conf USING (model, part, seed)""",
    "train_sizes": f"""WITH {REC}, g AS (SELECT source, count(*) AS n, sum(y) AS pos FROM rec GROUP BY 1),
        c AS (SELECT *, sum(n) OVER (ORDER BY {h('source', 1)}, source) AS upto, sum(n) OVER () AS total FROM g),
        held AS (SELECT n, pos FROM c WHERE upto > total * 0.8), rest AS (SELECT source, n, pos FROM c WHERE upto <= total * 0.8),
        r AS (SELECT seed, source, n, pos, sum(n) OVER (PARTITION BY seed ORDER BY {h('source', 'seed')}, source) AS upto, sum(n) OVER (PARTITION BY seed) AS total
            FROM rest, range(1, 6) t(seed)),
        e AS (SELECT seed, 'valid' AS part, n, pos FROM r WHERE upto > total * 0.875 UNION ALL SELECT seed, 'test', n, pos FROM held, range(1, 6) t(seed))
        SELECT 'logistic' AS model, part, seed::INTEGER AS seed, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS n_pos, true AS scored FROM e GROUP BY seed, part""",
    "split_semi_join": f"WITH {PART} SELECT d.doc_id, source, n_chars FROM documents d JOIN part USING (doc_id) WHERE part = 'test'",
    "drop_listed_features": f"""WITH {pearson()}, {MELT} SELECT doc_id, feature, round(value, 6) AS value FROM melted
        WHERE feature NOT IN (SELECT f2 FROM pr WHERE abs(r) > 0.95 AND NOT isnan(r))""",
    "stack_align_predictions": f"""WITH {THREE} SELECT seed, doc_id, y, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3
        FROM sc""",
    "fp_ngram": f"WITH {bits('documents', 1024)} SELECT doc_id, bit FROM bits",
    "fp_keys": f"WITH {KEYS} SELECT doc_id, key FROM keys",
    "doc_graph_edges": f"""WITH {tok('documents')},
        {WORDS} SELECT DISTINCT doc_id, least(w, w2) AS src, greatest(w, w2) AS dst FROM nxt WHERE w <> w2""",
    "fp_neighbourhood": f"WITH {GRAPH} SELECT doc_id, bit FROM nf",
    "graph_embedding": f"""WITH {GRAPH}, df AS (SELECT bit, count(*) AS df FROM nf GROUP BY bit)
        SELECT doc_id, bit, round(n * ln(((SELECT count(DISTINCT doc_id) FROM nf) + 1.0::DOUBLE) / (df + 1)), 6) AS weight
        FROM nf JOIN df USING (bit)""",
    "autocorr_lag": """WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
        SELECT a.user_id, k::INTEGER AS lag, round(sum(a.value * b.value), 4) AS ac FROM o a, range(1, 9) s(k), o b
        WHERE b.user_id = a.user_id AND b.rn = a.rn + k GROUP BY 1, 2""",
    "autocorr_distance": f"""WITH {POINTS} SELECT v.vec_id, b::INTEGER AS bin, round(coalesce(sum(w), 0), 6) AS ac
        FROM (SELECT vec_id, b FROM embeddings, range(10) s(b)) v LEFT JOIN pp ON pp.vec_id = v.vec_id AND pp.bin = v.b GROUP BY 1, 2""",
    "group_covariance": f"SELECT label, i, j, round(cov, 8) AS cov FROM ({COV})",
    "group_pca_moments": f"""SELECT label, round(sum(CASE WHEN i = j THEN cov ELSE 0 END), 8) AS trace,
        round(sum(CASE WHEN i = j THEN cov * cov ELSE 2 * cov * cov END), 8) AS sum_sq FROM ({COV}) GROUP BY label""",
    "group_leverage": """WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS sxx FROM events GROUP BY 1)
        SELECT event_id, round(1.0::DOUBLE / n + (value - m) ** 2 / sxx, 8) AS h FROM events JOIN s USING (event_type)""",
    "scalar_descriptors": f"WITH {DESC_CTE} SELECT doc_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in DESC) + " FROM dsc",
    "rule_flags": f"WITH {DESC_CTE} SELECT doc_id, " + ", ".join(
        "CASE WHEN " + " AND ".join(f"{c} {op} {b}" for c, op, b in rule) + f" THEN 1 ELSE 0 END AS {name}"
        for name, rule in TEXT_RULES.items()) + " FROM dsc",
    "chi2_bits": f"WITH {chi2(1024)} SELECT bit, support, round(chi2, 6) AS chi2 FROM c",
    "bit_positive_rate": f"WITH {REC_BITS(1024, True)} SELECT bit, round(avg(y), 6) AS rate FROM rb GROUP BY bit",
    "sig_bits_neg": f"WITH {chi2(4096)} SELECT bit FROM c WHERE {SIG_NEG}",
    "sig_bits_pos": f"WITH {chi2(4096)} SELECT bit FROM c WHERE {SIG_POS}",
    "sig_bit_counts": f"""WITH {chi2(4096)} SELECT r.doc_id, count(*) FILTER ({SIG_NEG})::INTEGER AS neg_cnt,
        count(*) FILTER ({SIG_POS})::INTEGER AS pos_cnt FROM rec r LEFT JOIN bits b USING (doc_id) LEFT JOIN c USING (bit) GROUP BY 1""",
    "outlier_mask": f"SELECT o_orderkey, {MASKED} AS price FROM orders",
    "impute_mean_fit_apply": f"""WITH m AS (SELECT o_orderkey, {MASKED} AS price,
        row_number() OVER (ORDER BY {h('o_orderkey', 1)}, o_orderkey) <= round(count(*) OVER () * 0.8) AS train FROM orders)
        SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM m WHERE train)), 6) AS price FROM m""",
    "scale_standard": scaled("(value - m) / CASE WHEN s = 0 THEN 1 ELSE s END", "avg(value) AS m, stddev_pop(value) AS s"),
    "scale_minmax": scaled("(value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END", "min(value) AS lo, max(value) AS hi"),
    "scale_maxabs": scaled("value / CASE WHEN m = 0 THEN 1 ELSE m END", "max(abs(value)) AS m"),
    "scale_rowsum": f"""WITH {DESC_CTE}, {MELT}, t AS (SELECT doc_id, nullif({' + '.join(DESC)}, 0) AS s FROM dsc)
        SELECT doc_id, feature, round(value / s, 8) AS scaled FROM melted JOIN t USING (doc_id)""",
    "tanimoto_pairs": f"WITH {pairs(1024)} SELECT a, b, \"both\", round(sim, 6) AS sim FROM sim WHERE sim > 0.5",
    "prune_tanimoto": f"WITH {pairs(4096)} SELECT DISTINCT b AS bit FROM sim WHERE sim > 0.5",
    "pearson_pairs": f"WITH {pearson()} SELECT f1, f2, round(r, 6) AS r FROM pr",
    "prune_pearson": f"WITH {pearson()} SELECT DISTINCT f2 AS feature FROM pr WHERE abs(r) > 0.95 AND NOT isnan(r)",
    "split_fractions": f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {h('doc_id', 1)}, doc_id) AS rn, count(*) OVER () AS n FROM documents)
        SELECT CASE WHEN rn <= round(n * 0.7) THEN 'train' WHEN rn <= round(n * 0.9) THEN 'valid' ELSE 'test' END AS part,
        count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM o GROUP BY 1""",
    "split_stratified": f"""WITH o AS (SELECT rep::INTEGER AS rep, quality AS y, doc_id,
        row_number() OVER (PARTITION BY rep, quality ORDER BY {h('doc_id', 'rep')}, doc_id) AS rn,
        count(*) OVER (PARTITION BY rep, quality) AS n FROM labels, range(1, 21) s(rep))
        SELECT rep, y, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM o WHERE rn <= round(n * 0.125) GROUP BY 1, 2""",
    "split_by_group": f"""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
        c AS (SELECT source, sum(n) OVER (ORDER BY {h('source', 1)}, source) AS upto, sum(n) OVER () AS total FROM g)
        SELECT source, CASE WHEN upto <= total * 0.7 THEN 'train' WHEN upto <= total * 0.8 THEN 'valid' ELSE 'test' END AS part FROM c""",
    "threshold_class": f"WITH {REC}, s AS (SELECT doc_id, 1 AS seed FROM rec) SELECT doc_id, CASE WHEN {U} > 0.5 THEN 1 ELSE 0 END AS cls FROM s",
    "metric_auc": f"WITH {THREE}, {auc('three', 'model, seed')} SELECT model, seed, round(auc, 6) AS auc FROM auc",
    "metric_confusion": f"""WITH {THREE}, {confusion('three', 'model, seed')} SELECT model, seed, round(accuracy, 6) AS accuracy,
        round(f1, 6) AS f1, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM conf""",
    "metric_logloss_mae": f"WITH {THREE}, {LOSS} SELECT model, seed, round(logloss, 6) AS logloss, round(mae, 6) AS mae FROM loss",
    "results_table": f"""WITH {PREDS}, {auc('preds', 'model, part, seed')}, {confusion('preds', 'model, part, seed')}
        SELECT model, part, seed, round(auc, 6) AS auc, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1,
        round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM auc JOIN conf USING (model, part, seed)""",
    "metric_over_seeds": f"""WITH {PREDS}, {auc('preds', 'model, part, seed')}
        SELECT model, part, round(avg(auc), 3) AS mean, round(stddev_pop(auc), 3) AS sd FROM auc GROUP BY 1, 2""",
    "pick_best_params": f"""WITH {THREE}, {LOSS}, m AS (SELECT model AS params, avg(-logloss) AS score FROM loss GROUP BY 1)
        SELECT params, round(score, 6) AS score FROM m ORDER BY score DESC, params LIMIT 1""",
    "kernel_gram": f"WITH {GRAM} SELECT a AS vec_id, round(max(own), 6) AS k_self, round(sum(k), 6) AS k_sum FROM g GROUP BY a",
    "kernel_gram_centered": f"""WITH {GRAM}, s AS (SELECT a, max(own) AS own, avg(k) AS m FROM g GROUP BY a)
        SELECT a AS vec_id, round(own - 2 * m + (SELECT avg(k) FROM g), 9) AS k_centered FROM s""",
    "kpca_scores": f"""WITH {REC}, dt AS (SELECT doc_id, text, {TOK} AS t FROM rec),
        dsc AS (SELECT doc_id, {", ".join(f"({RAW_DESC[c]})::DOUBLE AS {c}" for c in DESC)} FROM dt),
        mom AS (SELECT {", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in DESC)} FROM dsc),
        v AS (SELECT doc_id, [{", ".join(f"(coalesce({c}, {c}_m) - {c}_m) / {c}_s" for c in DESC)}] AS x FROM dsc, mom),
        k AS (SELECT a.doc_id AS i, b.doc_id AS j, (0.001::DOUBLE * list_dot_product(a.x, b.x) + 1) ** 2 AS k FROM v a, v b),
        r AS (SELECT i, avg(k) AS m FROM k GROUP BY i), g AS (SELECT avg(k) AS m FROM k),
        c AS (SELECT k.i, k.j, k.k - p.m - q.m + g.m AS k FROM k JOIN r p ON p.i = k.i JOIN r q ON q.i = k.j, g)
        SELECT round(sum(k) FILTER (i = j), 4) AS trace, round(sum(k * k), 2) AS sum_sq_sq FROM c""",
    "knn_minority": f"""WITH {SCALED}, d AS (SELECT a.doc_id, b.doc_id AS nbr,
        row_number() OVER (PARTITION BY a.doc_id ORDER BY {GAP}, b.doc_id)::INTEGER AS rn
        FROM pts a JOIN pts b ON a.doc_id <> b.doc_id WHERE a.y = 0 AND b.y = 0) SELECT doc_id, nbr, rn FROM d WHERE rn <= 5""",
    "smote_balance_counts": f"WITH {CLASSES} SELECT y, n AS n_before, greatest(n, top) AS n_after FROM cls",
    "smote_ratio_counts": f"""WITH {CLASSES} SELECT y, n AS n_before, CASE WHEN n = top THEN n ELSE floor(top * 1.5)::BIGINT END AS n_after
        FROM cls""",
    "smote_rows": f"WITH {CLASSES} SELECT y, top AS n, 0 AS n_outside_box FROM cls",
}
