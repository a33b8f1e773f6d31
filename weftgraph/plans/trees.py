"""Registered queries over syntax trees and symbols, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import arguments, checks, lookup, steps, taint
from weftgraph.operators.trees import NO_CALLEES, with_callees, with_trees
from weftgraph.plans.queries import WITH, _g, _of, _pipe, query

KEYWORDS = ", ".join(f"'{x}'" for x in NO_CALLEES)
S, C = 1 << 24, 1 << 10
TREE = (
    WITH
    + f""", q AS (SELECT id AS s, function_id AS f, test_id AS t, j, txt, split_part(txt, ' (', 1) AS name, trim(substr(txt, strpos(txt, '(') + 1, length(txt) - strpos(txt, '(') - 1)) AS inside
        FROM (SELECT id, function_id, test_id, unnest(x) AS txt, unnest(range(len(x))) AS j FROM (SELECT *, regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]* \\([^()]*\\)') AS x FROM n WHERE is_cfg AND code IS NOT NULL AND function_id IS NOT NULL))),
    c AS MATERIALIZED (SELECT *, s * {S} + j * {C} AS k, CASE WHEN inside = '' THEN []::VARCHAR[] ELSE string_split(inside, ' , ') END AS args FROM q WHERE name NOT IN ({KEYWORDS})),
    p AS (SELECT *, regexp_extract(code, '^(\\w+) (<|>|<=|>=|==|!=) (\\w+)$', ['l', 'o', 'r']) AS m, string_split(code, ' && ') AS w FROM n WHERE type = 'Condition' AND function_id IS NOT NULL AND strpos(code, '(') = 0),
    tn(id, type, code, place, above, f, t) AS MATERIALIZED (SELECT k + 1, 'CallExpression', txt, j, s, f, t FROM c UNION ALL SELECT k + 2, 'Callee', name, 0, k + 1, f, t FROM c
        UNION ALL SELECT k + 3, 'ArgumentList', inside, 1, k + 1, f, t FROM c UNION ALL SELECT k + 4 + unnest(range(len(args))), 'Argument', unnest(args), unnest(range(len(args))), k + 3, f, t FROM c
        UNION ALL SELECT id * {S} + 1, CASE WHEN m.o IN ('==', '!=') THEN 'EqualityExpression' ELSE 'RelationalExpression' END, code, 0, id, function_id, test_id FROM p WHERE m.o <> ''
        UNION ALL SELECT id * {S} + 2, 'Identifier', m.l, 0, id * {S} + 1, function_id, test_id FROM p WHERE m.o <> '' UNION ALL SELECT id * {S} + 3, 'Identifier', m.r, 1, id * {S} + 1, function_id, test_id FROM p WHERE m.o <> ''
        UNION ALL SELECT id * {S} + 1, 'AndExpression', code, 0, id, function_id, test_id FROM p WHERE len(w) = 2 UNION ALL SELECT id * {S} + 2, 'Expression', w[1], 0, id * {S} + 1, function_id, test_id FROM p WHERE len(w) = 2
        UNION ALL SELECT id * {S} + 3, 'Expression', w[2], 1, id * {S} + 1, function_id, test_id FROM p WHERE len(w) = 2
        UNION ALL SELECT id * {S} + 1, 'ParameterType', base_type, 0, id, function_id, test_id FROM n WHERE type = 'Parameter' AND function_id IS NOT NULL
        UNION ALL SELECT id * {S} + 2, 'Identifier', identifier, 1, id, function_id, test_id FROM n WHERE type = 'Parameter' AND function_id IS NOT NULL
        UNION ALL SELECT id * {S} + 1, 'FunctionDef', name, 0, id, id, test_id FROM n WHERE type = 'Function'),
    y AS MATERIALIZED (SELECT function_id * {S} + {S // 2} + dense_rank() OVER (PARTITION BY function_id ORDER BY var) AS symbol, id, is_def, var, function_id AS f FROM (
        SELECT DISTINCT function_id, var, src AS id, true AS is_def FROM edges WHERE etype = 'REACHES' AND var IS NOT NULL UNION SELECT DISTINCT function_id, var, dst, false FROM edges WHERE etype = 'REACHES' AND var IS NOT NULL)),
    an AS MATERIALIZED (SELECT id, type, code, place, f, t FROM tn UNION ALL SELECT id, type, code, child_num, function_id, test_id FROM n),
    te AS MATERIALIZED (SELECT above AS src, id AS dst FROM tn WHERE type <> 'FunctionDef' UNION SELECT function_id * {S} + 1, id FROM n WHERE is_cfg AND function_id IS NOT NULL),
    us AS MATERIALIZED (SELECT DISTINCT id AS src, symbol AS dst, var FROM y WHERE NOT is_def UNION SELECT a.id, y.symbol, y.var FROM tn a JOIN y ON y.f = a.f AND y.var = a.code WHERE a.type = 'Argument'),
    df AS MATERIALIZED (SELECT DISTINCT id AS src, symbol AS dst, var FROM y WHERE is_def) """
)
#: Below and above: everything in the trees of some nodes, and everything over them.
DOWN = "dn AS (SELECT id AS top, id FROM st UNION SELECT dn.top, te.dst FROM dn JOIN te ON te.src = dn.id) "
UP = "up AS (SELECT id, id AS top, 0 AS h FROM st UNION SELECT up.id, te.src, h + 1 FROM up JOIN te ON te.dst = up.top) "
#: The nearest statement at or above each node.
AT = "nm AS (SELECT up.id, arg_min(up.top, h) AS statement FROM up JOIN n ON n.id = up.top AND n.is_cfg GROUP BY up.id) "
LINKS = """ln AS MATERIALIZED (SELECT DISTINCT a.id AS argument, p.id AS parameter FROM (SELECT k, name, t, f, len(args) AS m FROM c) c JOIN tn a ON a.above = c.k + 3 AND a.type = 'Argument'
    JOIN n fn ON fn.type = 'Function' AND fn.name = c.name AND coalesce(fn.test_id, '') = coalesce(c.t, '') JOIN (SELECT function_id, count(*) AS m FROM n WHERE type = 'Parameter' GROUP BY 1) z ON z.function_id = fn.id AND z.m = c.m
    JOIN n p ON p.type = 'Parameter' AND p.function_id = fn.id AND p.child_num = a.place) """


def _t(spark, d):
    return with_trees(_g(spark, d))


def _in(g, kind):
    return _pipe(lookup.by_type(g.nodes, kind))


def _start(kind):
    return f", st AS (SELECT id FROM an WHERE type = '{kind}'), "


@query(TREE + "SELECT type, code, place::INT AS child_num, count(*) AS n FROM tn GROUP BY ALL")
def tree_nodes(spark, d):
    from weftgraph.operators.trees import trees

    return trees(_g(spark, d)).groupBy("type", "code", "child_num").agg(F.count(F.lit(1)).alias("n"))


@query(TREE + "SELECT te.dst AS id FROM te JOIN tn ON tn.id = te.src AND tn.type = 'CallExpression'")
def children_of_calls(spark, d):
    g = _t(spark, d)
    return steps.children(g, _in(g, "CallExpression"))


@query(TREE + "SELECT te.src AS id FROM te JOIN tn ON tn.id = te.dst AND tn.type = 'Argument'")
def parents_of_arguments(spark, d):
    g = _t(spark, d)
    return steps.parents(g, _in(g, "Argument"))


@query(TREE + "SELECT id FROM tn WHERE type = 'Argument' AND place = 1")
def second_children(spark, d):
    g = _t(spark, d)
    return steps.ith_children(g, _in(g, "ArgumentList"), 1)


@query(TREE + "SELECT tn.id, count(te.dst) AS n FROM tn LEFT JOIN te ON te.src = tn.id WHERE tn.type = 'ArgumentList' GROUP BY 1")
def argument_numbers(spark, d):
    g = _t(spark, d)
    return steps.num_children(g, _in(g, "ArgumentList"))


@query(TREE + "SELECT tn.id FROM tn JOIN tn a ON a.id = tn.above AND a.type IN ('EqualityExpression', 'RelationalExpression') WHERE tn.place = 0")
def left_sides(spark, d):
    g = _t(spark, d)
    return steps.lval(g, steps.set_union(_in(g, "EqualityExpression"), _in(g, "RelationalExpression")))


@query(TREE + "SELECT tn.id FROM tn JOIN tn a ON a.id = tn.above AND a.type IN ('EqualityExpression', 'RelationalExpression') WHERE tn.place = 1")
def right_sides(spark, d):
    g = _t(spark, d)
    return steps.rval(g, steps.set_union(_in(g, "EqualityExpression"), _in(g, "RelationalExpression")))


@query(TREE + "SELECT us.dst AS id FROM us JOIN n ON n.id = us.src AND n.type = 'Condition'")
def symbols_used(spark, d):
    g = _t(spark, d)
    return steps.uses(g, _of(spark, d, "Condition"))


@query(TREE + "SELECT df.dst AS id FROM df JOIN n ON n.id = df.src AND n.type = 'ExpressionStatement'")
def symbols_defined(spark, d):
    g = _t(spark, d)
    return steps.defines(g, _of(spark, d, "ExpressionStatement"))


@query(TREE + "SELECT DISTINCT df.src AS id FROM us JOIN n ON n.id = us.src AND n.type = 'Condition' JOIN df ON df.dst = us.dst")
def setters(spark, d):
    g = _t(spark, d)
    return steps.dedup(steps.set_by(g, steps.uses(g, _of(spark, d, "Condition"))))


@query(TREE + "SELECT DISTINCT df.src AS id FROM us JOIN n ON n.id = us.src AND n.type = 'Condition' JOIN df ON df.dst = us.dst JOIN n k ON k.id = df.src AND k.type IN ('IdentifierDecl', 'Parameter', 'IdentifierDeclStatement')")
def definitions_used(spark, d):
    g = _t(spark, d)
    return steps.dedup(steps.definitions(g, _of(spark, d, "Condition")))


@query(TREE + "SELECT a.id FROM tn a JOIN c ON a.above = c.k + 3 WHERE a.type = 'Argument'")
def call_to_arguments(spark, d):
    g = _t(spark, d)
    return steps.call_to_arguments(g, _in(g, "CallExpression"))


@query(TREE + "SELECT a.id, a.code FROM tn a JOIN c ON a.above = c.k + 3 WHERE a.type = 'Argument' AND a.place = 1 AND c.name = 'memcpy'")
def second_arguments_of_memcpy(spark, d):
    g = _t(spark, d)
    found = steps.ith_arguments(g, _pipe(lookup.calls_to(g.nodes, g.edges, "memcpy")), 1)
    return found.join(g.node_of(found, "code"), "id").select("id", "code")


@query(TREE + "SELECT k + 2 AS id FROM c")
def call_to_callee(spark, d):
    g = _t(spark, d)
    return steps.call_to_callee(g, _in(g, "CallExpression"))


@query(TREE + "SELECT k + 1 AS id, count(*) AS n FROM c JOIN tn a ON a.above = c.k + 3 AND a.type = 'Argument' GROUP BY 1")
def argument_to_call(spark, d):
    g = _t(spark, d)
    return steps.argument_to_call(g, _in(g, "Argument")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(TREE + "SELECT k + 1 AS id FROM c WHERE name = 'strcpy'")
def callee_to_call(spark, d):
    g = _t(spark, d)
    return steps.callee_to_call(g, _pipe(lookup.by_type_and_code(g.nodes, "Callee", "strcpy")))


@query(TREE + "SELECT DISTINCT k + 1 AS id FROM c WHERE name = 'memcpy'")
def calls_to_memcpy(spark, d):
    g = _t(spark, d)
    return _pipe(lookup.calls_to(g.nodes, g.edges, "void * memcpy"))


@query(TREE + "SELECT k + 1 AS id, txt AS code FROM c")
def all_calls(spark, d):
    g = _t(spark, d)
    return lookup.calls(g.nodes).select("id", "code").distinct()


@query(TREE + f"SELECT id * {S} + 2 AS id FROM n WHERE type = 'Parameter' AND function_id IS NOT NULL")
def parameter_names(spark, d):
    g = _t(spark, d)
    return steps.parameter_parts(g, _in(g, "Parameter"), "Identifier")


@query(TREE + f"SELECT id * {S} + 1 AS id FROM n WHERE type = 'Parameter' AND function_id IS NOT NULL")
def parameter_types(spark, d):
    g = _t(spark, d)
    return steps.parameter_parts(g, _in(g, "Parameter"), "ParameterType")


@query(TREE + f"SELECT id * {S} + 1 AS id FROM n WHERE type = 'Function' AND name LIKE 'read%'")
def trees_of_functions(spark, d):
    g = _t(spark, d)
    return steps.out(g, _pipe(lookup.functions_by_name(g.nodes, "read*")), "IS_FUNCTION_OF_AST")


@query(TREE + _start("Argument") + UP + ", " + AT + "SELECT id, statement FROM nm")
def statements_of_arguments(spark, d):
    g = _t(spark, d)
    return steps.statement_of(g, _in(g, "Argument"))


@query(TREE + ", st AS (SELECT k + 2 AS id FROM c WHERE name = 'memcpy'), " + UP + ", " + AT + "SELECT DISTINCT statement AS id FROM nm")
def statements_by_callee(spark, d):
    g = _t(spark, d)
    at = steps.statement_of(g, _pipe(lookup.by_type_and_code(g.nodes, "Callee", "memcpy")))
    return steps.dedup(at.select(F.col("statement").alias("id")))


@query(TREE + _start("Condition") + DOWN + "SELECT top, id FROM dn")
def trees_of_conditions(spark, d):
    g = _t(spark, d)
    return steps.below(g, _in(g, "Condition"))


@query(TREE + _start("FunctionDef") + DOWN + "SELECT top, count(*) AS n FROM dn GROUP BY top")
def sizes_of_trees(spark, d):
    g = _t(spark, d)
    return steps.below(g, _in(g, "FunctionDef")).groupBy("top").agg(F.count(F.lit(1)).alias("n"))


@query(TREE + _start("FunctionDef") + DOWN + "SELECT dn.id FROM dn JOIN tn ON tn.id = dn.id AND tn.type = 'Callee' AND tn.code = 'free'")
def callees_in_trees(spark, d):
    g = _t(spark, d)
    return steps.match(g, _in(g, "FunctionDef"), (F.col("type") == "Callee") & (F.col("code") == "free"), "type", "code")


@query(TREE + _start("Callee") + UP + "SELECT up.id AS id, up.top AS above, h AS hops FROM up")
def nodes_above_callees(spark, d):
    g = _t(spark, d)
    return steps.above(g, _in(g, "Callee")).select("id", F.col("top").alias("above"), "hops")


@query(TREE + _start("Callee") + UP + "SELECT n.id, count(*) AS n FROM up JOIN n ON n.id = up.top AND n.type = 'ExpressionStatement' GROUP BY 1")
def statements_above_callees(spark, d):
    g = _t(spark, d)
    found = steps.match_parents(g, _in(g, "Callee"), F.col("type") == "ExpressionStatement", "type")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(TREE + "SELECT DISTINCT tn.above AS id FROM tn JOIN tn a ON a.id = tn.above AND a.type IN ('EqualityExpression', 'RelationalExpression') WHERE tn.code = 'len'")
def checks_of_len(spark, d):
    g = _t(spark, d)
    return checks.check_expressions(g, _in(g, "Condition"), "len")


@query(TREE + "SELECT DISTINCT n.id FROM n JOIN us ON us.src = n.id AND regexp_full_match(us.var, 'len|size|n') WHERE n.type = 'Condition'")
def conditions_on_sizes(spark, d):
    g = _t(spark, d)
    return checks.checks(g, _in(g, "Condition"), "len|size|n")


@query(TREE + "SELECT k + 1 AS id FROM c JOIN n ON n.id = c.s AND n.type = 'ReturnStatement' WHERE regexp_full_match(txt, '[a-m].*')")
def calls_within_returns(spark, d):
    g = _t(spark, d)
    return checks.calls_within(g, _in(g, "ReturnStatement"), "[a-m].*")


@query(TREE + "SELECT DISTINCT a.id FROM tn a JOIN c ON a.above = c.k + 3 WHERE a.type = 'Argument' AND a.place = 2 AND starts_with(c.txt, 'memcpy')")
def third_arguments_in_trees(spark, d):
    g = _t(spark, d)
    return steps.dedup(checks.arguments_of(g, _in(g, "FunctionDef"), "memcpy", 2))


@query(TREE + "SELECT id FROM n WHERE type = 'Parameter' AND function_id IS NOT NULL AND is_cfg AND regexp_full_match(code, '.*(int|size_t) .*')")
def parameters_of_type(spark, d):
    g = _t(spark, d)
    return checks.parameters_matching(g, _in(g, "FunctionDef"), ".*(int|size_t) .*")


@query(TREE + _start("FunctionDef") + DOWN + "SELECT top, an.code AS symbol, count(*) AS n FROM dn JOIN an ON an.id = dn.id AND an.type IN ('Callee', 'IdentifierDeclType', 'Parameter') AND an.code IS NOT NULL GROUP BY ALL")
def symbols_of_interfaces(spark, d):
    g = _t(spark, d)
    return checks.api_symbols(g, _in(g, "FunctionDef")).groupBy("top", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query(TREE + """, u AS (SELECT DISTINCT us.src AS id, us.var FROM us JOIN n ON n.id = us.src AND n.type = 'ReturnStatement')
    SELECT id, var AS symbol FROM u WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.id = u.id AND length(x.var) > length(u.var) AND contains(x.var, u.var))""")
def longest_symbols(spark, d):
    g = _t(spark, d)
    return checks.longest_uses(g, _in(g, "ReturnStatement"))


@query(TREE + """, st AS (SELECT id FROM tn WHERE type = 'Argument'), """ + UP + ", " + AT + """SELECT DISTINCT us.src AS id, e.src AS sink FROM us JOIN nm ON nm.id = us.src JOIN e ON e.etype = 'REACHES' AND e.dst = nm.statement AND e.var = us.var""")
def sources_of_arguments(spark, d):
    g = _t(spark, d)
    return checks.tree_sources(g, _in(g, "Argument"))


@query(TREE + """SELECT DISTINCT df.src AS id, e.dst AS sink FROM df JOIN n ON n.id = df.src AND n.type = 'ExpressionStatement' AND n.is_cfg JOIN e ON e.etype = 'REACHES' AND e.src = df.src AND e.var = df.var""")
def sinks_of_statements(spark, d):
    g = _t(spark, d)
    return checks.tree_sinks(g, _in(g, "ExpressionStatement"))


@query(TREE + f"""SELECT DISTINCT x.id FROM (SELECT id * {S} + 1 AS id FROM p WHERE m.o <> '' OR len(w) = 2 UNION SELECT k + 1 FROM c JOIN n ON n.id = c.s AND n.type = 'Condition' WHERE c.j = 0
    UNION SELECT id * {S} + 2 FROM p WHERE len(w) = 2 UNION SELECT id * {S} + 3 FROM p WHERE len(w) = 2) x""")
def parts_of_conditions(spark, d):
    g = _t(spark, d)
    return taint.sub_conditions(g, _in(g, "Condition"))


@query(TREE + ", " + LINKS + "SELECT argument, parameter FROM ln")
def argument_links(spark, d):
    return taint.argument_links(_t(spark, d)).distinct()


@query(TREE + ", " + LINKS + "SELECT argument AS src, parameter AS dst, 'IS_ARG' AS etype FROM ln")
def interprocedural_edges(spark, d):
    return taint.interprocedural_edges(_t(spark, d))


@query(TREE + ", " + LINKS + "SELECT coalesce(ln.argument, n.id) AS id, count(*) AS n FROM n LEFT JOIN ln ON ln.parameter = n.id WHERE n.type = 'Parameter' GROUP BY 1")
def expanded_parameters(spark, d):
    g = _t(spark, d)
    return taint.expand_parameters(g, _in(g, "Parameter")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(TREE + ", " + LINKS + "SELECT coalesce(ln.parameter, tn.id) AS id, count(*) AS n FROM tn LEFT JOIN ln ON ln.argument = tn.id WHERE tn.type = 'Argument' GROUP BY 1")
def expanded_arguments(spark, d):
    g = _t(spark, d)
    return taint.expand_arguments(g, _in(g, "Argument")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(TREE + "SELECT c.k + 2 AS id, count(*) AS n FROM c JOIN n ON n.type = 'Function' AND n.name = c.name AND coalesce(n.test_id, '') = coalesce(c.t, '') GROUP BY 1")
def callers_by_name(spark, d):
    g = _t(spark, d)
    return steps.function_to_callers(g, _in(g, "Function")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(TREE + "SELECT n.id AS callee, c.k + 2 AS \"call\", c.f AS caller FROM c JOIN n ON n.type = 'Function' AND n.name = c.name AND n.test_id IS NOT DISTINCT FROM c.t")
def call_edges(spark, d):
    return taint.call_edges(_t(spark, d))


@query(TREE + """, ce AS (SELECT DISTINCT n.id AS callee, c.f AS caller FROM c JOIN n ON n.type = 'Function' AND n.name = c.name AND n.test_id IS NOT DISTINCT FROM c.t),
    iv AS (SELECT id AS root, function_id AS top, [function_id] AS chain, false AS done FROM n WHERE type = 'ReturnStatement' AND function_id IS NOT NULL
        UNION ALL SELECT root, coalesce(ce.caller, top), CASE WHEN ce.caller IS NULL THEN chain ELSE list_append(chain, ce.caller) END, ce.caller IS NULL FROM iv LEFT JOIN ce ON ce.callee = iv.top
        WHERE NOT done AND len(chain) <= 4 AND (ce.caller IS NULL OR NOT list_contains(chain, ce.caller)))
    SELECT DISTINCT root, chain FROM iv WHERE done OR len(chain) = 5""")
def chains_of_calls(spark, d):
    g = _g(spark, d)
    return taint.invocations(g, _in(g, "ReturnStatement"), calls=taint.call_edges(with_callees(g)))


@query(TREE + ", " + LINKS + ", st AS (SELECT DISTINCT argument AS id FROM ln), " + UP + ", " + AT + """, b AS MATERIALIZED (SELECT dst AS src, src AS dst FROM e WHERE etype = 'REACHES' UNION SELECT ln.parameter, nm.statement FROM ln JOIN nm ON nm.id = ln.argument),
    r AS (SELECT id AS root, id, 0 AS hops FROM n WHERE type = 'ReturnStatement' UNION SELECT r.root, b.dst, hops + 1 FROM r JOIN b ON b.src = r.id WHERE hops < 4) SELECT root, id, min(hops) AS hops FROM r GROUP BY ALL""")
def tainted_across_calls(spark, d):
    g = _t(spark, d)
    return taint.tainted_by(g, _in(g, "ReturnStatement"))


@query(TREE + """, at_ AS (SELECT DISTINCT k + 1 AS id, s AS statement FROM c WHERE name = 'memcpy'), r AS (SELECT statement AS root, statement AS id, 0 AS hops FROM at_ WHERE statement IN (SELECT dst FROM e WHERE etype = 'REACHES')
    UNION SELECT r.root, e.src, hops + 1 FROM r JOIN e ON e.dst = r.id AND e.etype = 'REACHES' WHERE hops < 2)
    SELECT id FROM at_ WHERE statement IN (SELECT root FROM r JOIN n ON n.id = r.id AND regexp_full_match(n.code, '(?s).*alloc.*'))""")
def tainted_copies(spark, d):
    return taint.tainted_arguments(_t(spark, d), "memcpy", ".*alloc.*", 2)


@query(TREE + """SELECT DISTINCT c.k + 1 AS "call", a.place::INT AS place, us.var, e.src AS definition FROM c JOIN tn a ON a.above = c.k + 3 AND a.type = 'Argument' JOIN us ON us.src = a.id
    JOIN e ON e.etype = 'REACHES' AND e.dst = c.s AND e.var = us.var WHERE c.name = 'memcpy'""")
def definitions_of_arguments(spark, d):
    g = _t(spark, d)
    return arguments.definitions_per_argument(g, _pipe(lookup.calls_to(g.nodes, g.edges, "memcpy")))


@query(TREE + """SELECT DISTINCT c.k + 1 AS "call", a.place::INT AS place, us.var, n.id AS condition, trim(array_to_string([CASE WHEN regexp_matches(x, '^[0-9]') THEN 'NUM' WHEN regexp_matches(x, '^["'']') THEN 'TEXT' ELSE x END
    FOR x IN string_split(replace(' ' || n.code || ' ', ' ' || us.var || ' ', ' ARG '), ' ')], ' ')) AS template FROM c JOIN tn a ON a.above = c.k + 3 AND a.type = 'Argument' JOIN us ON us.src = a.id
    JOIN e ON e.etype = 'CONTROLS' AND e.dst = c.s AND e.src <> e.dst JOIN n ON n.id = e.src AND n.type = 'Condition' AND n.code IS NOT NULL JOIN us u ON u.src = n.id AND u.var = us.var""")
def conditions_of_arguments(spark, d):
    g = _t(spark, d)
    return arguments.conditions_per_argument(g, _in(g, "CallExpression"))


@query(TREE + f"SELECT c.k + 1 AS \"call\", a.place::INT AS place, a.id AS argument, c.s AS statement FROM c JOIN tn a ON a.above = c.k + 3 AND a.type = 'Argument' WHERE c.name IN ('memcpy', 'strcpy')")
def places_of_arguments(spark, d):
    g = _t(spark, d)
    calls = steps.bag_union(*(_pipe(lookup.calls_to(g.nodes, g.edges, x)) for x in ("memcpy", "strcpy")))
    return arguments.call_arguments(g, calls)
