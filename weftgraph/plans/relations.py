"""More registered queries of the core: fixpoints, repairs, texts and scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import code as codes
from weftgraph.functions import scores, text
from weftgraph.graph import CodeGraph
from weftgraph.io import table
from weftgraph.operators import checks, lookup, points, reach, slices, steps, taint, windows
from weftgraph.plans.queries import DOC_WORDS, NAMES, SQL, SYMBOLS, TOKEN, WITH, _docs, _g, _n, _of, _pipe, _symbols, query
from weftgraph.sources.textual import from_graph_text, graph_text

# ---- lookups


@query("SELECT DISTINCT id, code FROM nodes WHERE type = 'ReturnStatement' AND code LIKE 'return %'")
def type_and_code(spark, d):
    return lookup.by_type_and_code(_n(spark, d), "ReturnStatement", "return *").select("id", "code").distinct()


@query("SELECT DISTINCT id, name FROM nodes WHERE type = 'Function' AND name LIKE 'read%' AND filepath LIKE '/corpus/sard/%'")
def functions_by_file_and_name(spark, d):
    return lookup.functions_by_file(_n(spark, d), "/corpus/sard/*", "read*").select("id", "name").distinct()


@query("SELECT DISTINCT id FROM nodes WHERE type = 'Condition' AND regexp_full_match(code, 'len (<|<=|>|>=) .*')")
def conditions_on_len(spark, d):
    return _pipe(lookup.conditions(_n(spark, d)).where(checks.code_matches("%s (<|<=|>|>=) .*", "len")))


@query("SELECT DISTINCT id FROM nodes WHERE is_cfg AND type = 'GotoStatement' AND function_id IN (SELECT function_id FROM nodes WHERE type = 'Condition' AND code LIKE '%len%')")
def gotos_beside_checks(spark, d):
    n = _n(spark, d)
    return _pipe(lookup.in_functions_of(lookup.by_type(lookup.statements(n), "GotoStatement"), lookup.by_type_and_code(n, "Condition", "*len*")))


@query("SELECT DISTINCT id FROM nodes WHERE type = 'Condition' AND id NOT IN (SELECT dst FROM edges WHERE etype = 'REACHES')")
def conditions_without_data(spark, d):
    return steps.minus(_of(spark, d, "Condition"), _g(spark, d).edge("REACHES").select(F.col("dst").alias("id")))


@query(WITH + "SELECT DISTINCT x.dst AS id FROM e x JOIN n ON n.id = x.src AND n.type = 'CFGEntryNode' JOIN n p ON p.id = x.dst AND p.type = 'Parameter' WHERE x.etype = 'CONTROLS'")
def parameters_of_entries(spark, d):
    g = _g(spark, d)
    return steps.dedup(steps.out(g, _of(spark, d, "CFGEntryNode"), "CONTROLS").join(_of(spark, d, "Parameter"), "id", "left_semi"))


@query(WITH + "SELECT id, count(*) AS n FROM (SELECT x.dst AS id FROM (SELECT DISTINCT src, dst FROM e WHERE etype = 'FLOWS_TO') x JOIN n ON n.id = x.src AND n.type = 'Condition' UNION ALL SELECT x.src FROM (SELECT DISTINCT src, dst FROM e WHERE etype = 'FLOWS_TO') x JOIN n ON n.id = x.dst AND n.type = 'Condition') GROUP BY id")
def neighbours_in_flow(spark, d):
    return steps.both(_g(spark, d), _of(spark, d, "Condition"), "FLOWS_TO").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT id, line, col FROM n WHERE type = 'Condition'")
def sorted_conditions(spark, d):
    return slices.sorted_by_place(_g(spark, d).node("line", "col", where="type = 'Condition'"))


# ---- scopes, fixpoints and paths

SCOPES = """fw AS MATERIALIZED (SELECT DISTINCT e.src, e.dst FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.etype = 'FLOWS_TO' AND b.start_idx > a.start_idx),
    ar AS (SELECT src AS test, flow_label AS branch, dst AS id FROM e WHERE etype = 'FLOWS_TO' AND flow_label IN ('True', 'False') UNION SELECT ar.test, ar.branch, fw.dst FROM ar JOIN fw ON fw.src = ar.id),
    sc AS MATERIALIZED (SELECT test, min(branch) = 'True' AS branch, id FROM ar WHERE id <> test GROUP BY test, id HAVING count(DISTINCT branch) = 1) """
SQL["if_scopes"] = WITH + ", " + SCOPES + "SELECT id, list_sort(list(DISTINCT test)) AS tests FROM sc GROUP BY id"
SQL["nearest_conditions"] = WITH + ", " + SCOPES + "SELECT id, min({'n': z.n, 'test': sc.test}).test AS test FROM sc JOIN (SELECT test, branch, count(*) AS n FROM sc GROUP BY ALL) z USING (test, branch) GROUP BY id"
COMPLETED = """ed AS (SELECT DISTINCT src, id AS dst, symbol AS var FROM (SELECT *, last_value(CASE WHEN is_def THEN id END IGNORE NULLS)
    OVER (PARTITION BY function_id, symbol ORDER BY pos NULLS FIRST, is_def::INT, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM s) WHERE NOT is_def AND src IS NOT NULL AND src <> id) """


@query(WITH + ", " + SCOPES + ", " + SYMBOLS + ", " + COMPLETED + "SELECT src, dst, var FROM ed WHERE NOT EXISTS (SELECT 1 FROM sc a JOIN sc b USING (test) WHERE a.id = ed.src AND b.id = ed.dst AND a.branch <> b.branch)")
def completed_without_opposites(spark, d):
    g = _g(spark, d)
    return slices.complete_data_edges(_symbols(g), slices.if_scopes(g))


@query(WITH + ", " + SYMBOLS + ", " + COMPLETED + "SELECT DISTINCT src, dst, var FROM (SELECT src, dst, var FROM e WHERE etype = 'REACHES' UNION SELECT src, dst, var FROM ed)")
def data_edges_with_completed(spark, d):
    g = _g(spark, d)
    return slices.add_edges(g.edge("REACHES", columns=("src", "dst", "var")), slices.complete_data_edges(_symbols(g)))


@query(WITH + """, df AS MATERIALIZED (SELECT DISTINCT src AS id, var FROM e WHERE etype = 'REACHES'), fl AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE etype = 'FLOWS_TO'),
    r AS (SELECT df.id AS src, df.var, fl.dst AS at_ FROM df JOIN fl ON fl.src = df.id UNION SELECT r.src, r.var, fl.dst FROM r JOIN fl ON fl.src = r.at_ WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.id = r.at_ AND df.var = r.var)),
    us AS (SELECT DISTINCT dst AS id, var FROM e WHERE etype = 'REACHES') SELECT DISTINCT r.src, r.at_ AS dst, r.var FROM r JOIN us ON us.id = r.at_ AND us.var = r.var""")
def reaching_over_flow(spark, d):
    g = _g(spark, d)
    known = _symbols(g).select("id", "symbol", "is_def")
    return reach.reaching_definitions(g.edge("FLOWS_TO"), known)


ORDER = """o AS MATERIALIZED (SELECT id, function_id AS f, row_number() OVER (PARTITION BY function_id ORDER BY start_idx NULLS FIRST, id) AS no FROM n WHERE is_cfg AND function_id IS NOT NULL) """


@query(WITH + ", " + ORDER + ", " + SYMBOLS + """, fl AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM o a JOIN o b ON b.f = a.f AND b.no = a.no + 1), df AS MATERIALIZED (SELECT DISTINCT id, symbol AS var FROM s WHERE is_def),
    r AS (SELECT df.id AS src, df.var, fl.dst AS at_ FROM df JOIN fl ON fl.src = df.id UNION SELECT r.src, r.var, fl.dst FROM r JOIN fl ON fl.src = r.at_ WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.id = r.at_ AND df.var = r.var))
    SELECT DISTINCT r.src, r.at_ AS dst, r.var FROM r JOIN s ON s.id = r.at_ AND s.symbol = r.var AND NOT s.is_def""")
def reaching_in_text_order(spark, d):
    g = _g(spark, d)
    order = windows.text_order(g.node("function_id", "start_idx", where="is_cfg and function_id is not null"))
    return reach.reaching_definitions(order, _symbols(g).select("id", "symbol", "is_def"))


@query(WITH + ", " + ORDER + """, w AS MATERIALIZED (SELECT DISTINCT x.src, x.dst, x.var, a.f, a.no AS i, b.no AS j FROM e x JOIN o a ON a.id = x.src JOIN o b ON b.id = x.dst AND b.f = a.f WHERE x.etype = 'REACHES' AND b.no > a.no AND b.no - a.no < 20),
    df AS MATERIALIZED (SELECT DISTINCT x.src AS id, x.var, o.f, o.no FROM e x JOIN o ON o.id = x.src WHERE x.etype = 'REACHES'), cl AS MATERIALIZED (SELECT o.f, o.no FROM o JOIN n USING (id) WHERE regexp_matches(n.code, '(^| )(sizeof|MAX_PATH)( |$)'))
    SELECT w.src AS start, w.dst AS "end", w.var, list(o.id ORDER BY o.no) AS path FROM w JOIN o ON o.f = w.f AND o.no BETWEEN w.i AND w.j
    WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.f = w.f AND df.var = w.var AND df.no > w.i AND df.no <= w.j) AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.f = w.f AND cl.no > w.i AND cl.no <= w.j) GROUP BY 1, 2, 3""")
def unsanitized_paths(spark, d):
    """Paths along the order of the text, for the data edges of these graphs lie where no flow edge leads."""
    g = _g(spark, d)
    order = windows.text_order(g.node("function_id", "start_idx", where="is_cfg and function_id is not null"))
    data = g.edges.where("etype = 'REACHES'")
    by_text = CodeGraph(g.nodes, data.unionByName(order.withColumn("etype", F.lit("FLOWS_TO")), allowMissingColumns=True))
    every = _pipe(lookup.statements(g.nodes))
    return taint.unsanitized_paths(by_text, every, every, F.col("code").rlike("(^| )(sizeof|MAX_PATH)( |$)"))


@query(WITH + r""", m AS (SELECT id, function_id AS f, line, unnest(list_distinct(regexp_extract_all(code, '([A-Za-z_]\w*) = (?:\( [^()]* \) )?(?:malloc|calloc|realloc) \(', 1))) AS var FROM n WHERE code IS NOT NULL AND function_id IS NOT NULL),
    u AS (SELECT id, function_id AS f, line, unnest(list_distinct(list_concat(regexp_extract_all(code, '(?:^| )([A-Za-z_]\w*) -> ', 1), regexp_extract_all(code, '(?:^| )delete (?:\[ \] )?([A-Za-z_]\w*)', 1)))) AS var FROM n WHERE code IS NOT NULL AND function_id IS NOT NULL)
    SELECT DISTINCT m.id AS src, u.id AS dst, m.var FROM m JOIN u ON u.f = m.f AND u.var = m.var WHERE m.id <> u.id AND u.line >= m.line""")
def object_edges(spark, d):
    return slices.object_edges(_g(spark, d), slices.BY_ALLOCATION)


@query(WITH + """, c AS (SELECT id, function_id, code, line FROM n WHERE id IN (SELECT src FROM edges WHERE etype = 'FLOWS_TO' UNION SELECT dst FROM edges WHERE etype = 'FLOWS_TO')), t AS (SELECT function_id, code, line, min(id) AS other FROM c GROUP BY ALL)
    SELECT n.id, CASE WHEN c.id IS NULL THEN coalesce(t.other, n.id) ELSE n.id END AS now FROM n LEFT JOIN c ON c.id = n.id LEFT JOIN t ON t.function_id = n.function_id AND t.code = n.code AND t.line = n.line WHERE n.type = 'Statement'""")
def repaired_nodes(spark, d):
    g = _g(spark, d)
    ends = g.edge("FLOWS_TO").select(F.explode(F.array("src", "dst")).alias("id"))
    return slices.repaired(g.node("function_id", "code", "line", where="type = 'Statement'"), g.node_of(ends, "function_id", "code", "line"))


HASHES = SQL["neighborhood_hash"].replace("SELECT l1.id, xor(", ", l2 AS (SELECT l1.id, xor(", 1)
SQL["neighborhood_vectors"] = HASHES + """) SELECT function_id AS owner, string_agg(label || ':' || k, ' ' ORDER BY label) AS vector FROM (SELECT n.function_id, l2.label, count(*) AS k FROM l2 JOIN n ON n.id = l2.id AND n.function_id IS NOT NULL GROUP BY ALL) GROUP BY 1"""


# ---- text

FREE = "(regexp_matches(x, '^[A-Za-z_]') AND x NOT IN ({}))".format(", ".join(f"'{w}'" for w in text.KEYWORDS))
FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
SQL["canonical_codes"] = WITH + f""", t AS (SELECT id, regexp_extract_all(code, '{TOKEN}') AS ts FROM n WHERE is_cfg AND code IS NOT NULL),
    f0 AS (SELECT *, list_filter(ts, lambda x, i: {FREE} AND ts[i + 1] = '(') AS f FROM t), f1 AS (SELECT id, ts, {FIRST.format("f")} AS fs FROM f0),
    v0 AS (SELECT *, list_filter(ts, lambda x: {FREE} AND NOT list_contains(fs, x)) AS v FROM f1), v1 AS (SELECT id, ts, fs, {FIRST.format("v")} AS vs FROM v0)
    SELECT id, array_to_string([CASE WHEN NOT {FREE} THEN x WHEN list_contains(fs, x) THEN 'func_' || (list_position(fs, x) - 1) ELSE 'variable_' || (list_position(vs, x) - 1) END FOR x IN ts], ' ') AS code FROM v1"""

NESTED = r"[^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*"
WRITERS = ", ".join(f"('{n}', 0)" for n in codes.WRITES_FIRST) + ", " + ", ".join(f"('{n}', {k})" for n, k in codes.WRITES_FROM.items())
SQL["written_variables"] = WITH + rf""", w AS (SELECT * FROM (VALUES {WRITERS}) v(name, k)), c AS (SELECT id, code FROM n WHERE is_cfg AND code IS NOT NULL AND contains(code, '(')),
    a AS (SELECT c.id, w.name, w.k, regexp_extract_all(regexp_extract(code, '(?:^|[^A-Za-z0-9_])' || w.name || ' ?\((' || '{NESTED}' || ')\)', 1), '(?:[^,()]|\([^()]*(?:\([^()]*\)[^()]*)*\))+') AS args FROM c JOIN w ON contains(c.code, w.name)),
    x AS (SELECT id, unnest(CASE WHEN k > 0 THEN args[k + 1:] ELSE args[1:1] END) AS arg FROM a),
    b AS (SELECT id, string_split(regexp_extract(regexp_replace(trim(arg), '^(?:\( [A-Za-z_][A-Za-z0-9_ *]* \) )?[&* ]*', ''), '^([A-Za-z_][A-Za-z0-9_]*(?: (?:->|\.) [A-Za-z_][A-Za-z0-9_]*)*)', 1), ' ') AS t FROM x)
    SELECT DISTINCT id, array_to_string(t[1:m], ' ') AS name FROM (SELECT id, t, unnest(range(1, len(t) + 1, 2)) AS m FROM b WHERE t[1] <> '')"""

BARE = "[trim(regexp_replace(x, '[*&]', '', 'g')) FOR x IN {}]"


@query(WITH + f""", t AS (SELECT id, trim(string_split(code, ' = ')[1]) AS l, code FROM n WHERE type = 'Statement' AND code IS NOT NULL AND contains(code, ' = ')),
    k AS (SELECT id, ends_with(l, ']') AS el, CASE WHEN ends_with(l, ']') THEN string_split(trim(string_split(code, ' [ ')[1]), ' ') ELSE string_split(l, ' ') END AS w FROM t), p AS (SELECT *, coalesce(list_position(w, '->'), 0) AS a FROM k),
    j AS (SELECT id, CASE WHEN a > 1 AND a < len(w) THEN list_concat(list_concat(CASE WHEN a > 2 THEN w[1:a - 2] ELSE [] END, [w[a - 1] || ' -> ' || w[a + 1]]), list_concat(w[a + 2:], CASE WHEN el THEN [] ELSE [w[a - 1]] END)) ELSE w END AS s FROM p)
    SELECT DISTINCT id, symbol FROM (SELECT id, unnest({BARE.format("s")}) AS symbol FROM j) WHERE symbol <> ''""")
def defined_in_text(spark, d):
    code = _g(spark, d).node("code", where="type = 'Statement' and code is not null")
    return code.select("id", F.explode(codes.defined_in_text(F.col("code"))).alias("symbol"))


MARKS = ", ".join(f"'{x}'" for x in codes.MARKS)


@query(WITH + f"""SELECT DISTINCT id, symbol FROM (SELECT id, unnest([trim(regexp_replace(x, '[*&]', '', 'g')) FOR x IN string_split(CASE WHEN contains(code, ' = ') THEN trim(string_split(code, ' = ')[2]) ELSE code END, ' ') IF x NOT IN ({MARKS})]) AS symbol
    FROM n WHERE type = 'Statement' AND code IS NOT NULL) WHERE symbol <> ''""")
def used_in_text(spark, d):
    code = _g(spark, d).node("code", where="type = 'Statement' and code is not null")
    return code.select("id", F.explode(codes.used_in_text(F.col("code"))).alias("symbol"))


@query(WITH + f"""SELECT id, name, CASE WHEN list_contains(ts, name) THEN list_position(ts, name) ELSE len(ts) // 2 + 1 END AS focus FROM (SELECT id, regexp_extract_all(code, '{TOKEN}') AS ts, unnest(list_distinct({NAMES})) AS name FROM n WHERE type = 'ExpressionStatement' AND code IS NOT NULL)""")
def focus_of_calls(spark, d):
    code = _g(spark, d).node("code", where="type = 'ExpressionStatement' and code is not null")
    each = code.select("id", text.c_tokens(F.col("code")).alias("ts"), F.explode(F.array_distinct(points.called_names(F.col("code")))).alias("name"))
    return each.select("id", "name", codes.focus_index(F.col("ts"), F.col("name")).cast("long").alias("focus"))


@query(WITH + f"""SELECT id, CASE WHEN len(ts) >= 12 THEN ts[greatest(1, least(f - 6, len(ts) - 11)):greatest(1, least(f - 6, len(ts) - 11)) + 11] ELSE list_resize(ts, 12, '') END AS window_ FROM (SELECT id, ts, len(ts) // 2 + 1 AS f
    FROM (SELECT id, regexp_extract_all(code, '{TOKEN}') AS ts FROM n WHERE is_cfg AND code IS NOT NULL))""")
def windows_of_tokens(spark, d):
    code = _g(spark, d).node("code", where="is_cfg and code is not null").select("id", text.c_tokens(F.col("code")).alias("ts"))
    return code.select("id", text.pad(F.col("ts"), 12, codes.focus_index(F.col("ts"), F.lit(""), expression=True)).alias("window_"))


@query(WITH + """SELECT test_id, CASE WHEN len(g) > 0 THEN g ELSE ['main'] END AS names FROM (SELECT test_id, [x FOR x IN list_sort(list(DISTINCT name)) IF regexp_matches(lower(x), 'good|bad')] AS g FROM n WHERE type = 'Function' AND name IS NOT NULL GROUP BY test_id)""")
def names_of_cases(spark, d):
    names = _g(spark, d).node("name", "test_id", where="type = 'Function' and name is not null").groupBy("test_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return names.select("test_id", codes.good_or_bad(F.col("names")).alias("names"))


@query("WITH " + DOC_WORDS + "SELECT doc_id, word, round(count(*) / any_value(len(words)), 9) AS share, count(*) AS n FROM (SELECT doc_id, words, unnest(words) AS word FROM w) GROUP BY doc_id, word")
def term_shares(spark, d):
    share = text.term_matrix(_docs(spark, d), "freq").withColumnRenamed("value", "share")
    return share.join(text.term_matrix(_docs(spark, d), "count"), ["doc_id", "word"]).select("doc_id", "word", F.round("share", 9).alias("share"), F.col("value").cast("long").alias("n"))


@query("WITH " + DOC_WORDS + "SELECT word, count(*)::DOUBLE AS n_docs FROM (SELECT DISTINCT doc_id, unnest(words) AS word FROM w) GROUP BY word")
def documents_of_terms(spark, d):
    return text.term_matrix(_docs(spark, d), "binary").groupBy("word").agg(F.sum("value").alias("n_docs"))


@query("WITH " + DOC_WORDS + """, r AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM (SELECT unnest(words) AS word FROM w) GROUP BY word)
    SELECT word, round(least(1, sqrt(1e-5 * (rank * (ln(rank) + 0.577) + 0.5 - 1 / (12 * rank)))), 9) AS rate FROM r""")
def sampling_rates(spark, d):
    counts = text.vocabulary(_docs(spark, d)).select("word", F.struct((-F.col("n")).alias("n"), "word").alias("place"))
    ranked = text.numbered_rows(counts, "place")
    return ranked.select("word", F.round(text.sampling_rates(F.col("no")), 9).alias("rate"))


@query(WITH + "SELECT id, code FROM n WHERE code IS NOT NULL AND type IN ('Condition', 'ReturnStatement')")
def graph_round_trip(spark, d):
    g = _g(spark, d)
    nodes = g.node("code", where="code is not null and type in ('Condition', 'ReturnStatement')")
    back = from_graph_text(graph_text(nodes, g.edge(columns=("src", "dst", "etype"))))[0]
    return back.select("id", F.get_json_object("properties", "$.code").alias("code"))


@query("SELECT DISTINCT src, dst, etype FROM edges")
def edges_round_trip(spark, d):
    g = _g(spark, d)
    return from_graph_text(graph_text(g.node("type"), g.edge(columns=("src", "dst", "etype", "var"))))[1].select("src", "dst", "etype").distinct()


# ---- scores

OUTCOMES = "SELECT l_orderkey, l_linenumber, l_linestatus, CASE WHEN l_returnflag = 'R' AND l_discount * 10 >= 0.5 THEN 'tp' WHEN l_discount * 10 >= 0.5 THEN 'fp' WHEN l_returnflag = 'R' THEN 'fn' ELSE 'tn' END AS outcome FROM lineitem"


def _outcomes(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))
    return scores.outcomes(rows, "y", "p")


@query(OUTCOMES)
def outcomes_of_samples(spark, d):
    return _outcomes(spark, d).drop("y", "p")


@query(f"SELECT l_orderkey AS case_id, f AS function, list(outcome ORDER BY l_linenumber, outcome) AS outcomes FROM (SELECT *, unnest(['all', l_linestatus]) AS f FROM ({OUTCOMES})) GROUP BY 1, 2")
def verdicts_of_cases(spark, d):
    rows = _outcomes(spark, d).select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("sample_id"), F.array(F.lit("all"), "l_linestatus").alias("functions"), "outcome")
    return scores.verdicts(rows)


@query("SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean, round(sum(l_quantity), 3) AS n FROM lineitem")
def weighted_means(spark, d):
    return scores.weighted_mean(table(spark, d, "lineitem"), "l_discount", "l_quantity").select(F.round("mean", 9).alias("mean"), F.round("n", 3).alias("n"))


@query("SELECT vec_id, len([v FOR v IN x[1:10] IF v > x[label + 1]]) < 3 AS hit FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)")
def hits_in_top_3(spark, d):
    first = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    return table(spark, d, "embeddings").select("vec_id", scores.in_top_k(first, F.col("label"), 3).alias("hit"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS path FROM orders")
def calendar_paths(spark, d):
    return table(spark, d, "orders").select("o_orderkey", codes.calendar_path(F.col("o_orderdate")).alias("path"))


@query("SELECT id, try_cast(x AS BIGINT) AS n FROM (SELECT DISTINCT id, string_split(code, ' ')[-1] AS x FROM nodes WHERE type = 'Condition' AND code IS NOT NULL) WHERE regexp_full_match(x, '[0-9]+|[A-Za-z_]+')")
def cast_properties(spark, d):
    last = _g(spark, d).node("code", where="type = 'Condition' and code is not null").select("id", F.element_at(F.split("code", " "), -1).alias("x"))
    return last.where(F.col("x").rlike("^([0-9]+|[A-Za-z_]+)$")).select("id", codes.property_value(F.col("x"), "integer").alias("n"))


@query("SELECT slice_id, (n > 1)::INT AS label FROM (SELECT path AS slice_id, count(*) AS n FROM vul_lines GROUP BY path)")
def two_classes(spark, d):
    counts = table(spark, d, "vul_lines").groupBy(F.col("path").alias("slice_id")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return counts.select("slice_id", codes.two_classes(F.col("n")).alias("label"))
