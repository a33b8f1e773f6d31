"""The registered queries of the core, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import code as codes
from weftgraph.functions import scores, text
from weftgraph.functions.embed import api_vectors, baseline_scores, embedded, mean_vectors, nearest
from weftgraph.functions.recurrent import Classifier, predict
from weftgraph.functions.skipgram import skip_gram
from weftgraph.graph import CodeGraph
from weftgraph.io import cut, table
from weftgraph.operators import arguments, checks, lookup, points, reach, slices, snippets, steps, taint, windows
from weftgraph.sources.textual import case_of_folders, graph_text
from weftgraph.sources.tree import folders
from weftgraph.streaming.dedup import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

COLUMNS = ["type", "code", "name", "function_id", "is_cfg", "child_num", "operator", "line", "col", "start_idx", "stop_idx", "filepath", "base_type", "complete_type", "identifier", "test_id", "hidden"]
WITH = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT DISTINCT id, {", ".join(COLUMNS)} FROM nodes),
    e AS MATERIALIZED (SELECT DISTINCT src, dst, etype, var, flow_label FROM edges) """
PDG = """sp AS (SELECT id, type, function_id FROM n WHERE type IN ('CFGEntryNode', 'CFGExitNode', 'CFGErrorNode')),
    pdg AS MATERIALIZED (SELECT DISTINCT coalesce(t.function_id, x.src) AS src, x.dst, x.var FROM e x LEFT JOIN sp t ON x.src = t.id AND t.type = 'CFGEntryNode'
        WHERE x.etype IN ('REACHES', 'CONTROLS') AND x.src NOT IN (SELECT id FROM sp WHERE type <> 'CFGEntryNode')
        AND x.dst NOT IN (SELECT id FROM sp WHERE type <> 'CFGEntryNode')) """
POINTS = """pt AS MATERIALIZED (SELECT DISTINCT kind || '|' || coalesce(test_id, '') || '|' || coalesce(function_id::VARCHAR, '') || '|' || list_sort(node_ids)::VARCHAR AS k, unnest(node_ids) AS id
    FROM slice_points) """
TOKEN = text.TOKEN.replace("'", "''").replace("*+", "*")


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its own name."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return keep


def _g(spark: SparkSession, d: str) -> CodeGraph:
    return CodeGraph.read(spark, d)


def _n(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as delivered: take distinct rows after the filter."""
    return table(spark, d, "nodes")


def _pipe(found: DataFrame) -> DataFrame:
    return found.select("id").distinct()


def _of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The ids of the nodes of a type."""
    return _pipe(lookup.by_type(_n(spark, d), kind))


# ---- lookups


@query("SELECT DISTINCT id, code FROM nodes WHERE type = 'Condition' AND code LIKE '%len%'")
def lookup_query(spark, d):
    return lookup.query(_n(spark, d), "type:Condition AND code:*len*").select("id", "code").distinct()


@query("SELECT DISTINCT id, code FROM nodes WHERE type = 'ReturnStatement' AND code = 'return 0 ;'")
def lookup_quoted(spark, d):
    return lookup.query(_n(spark, d), 'type:ReturnStatement AND code:"return 0 ;"').select("id", "code").distinct()


@query("SELECT DISTINCT id, name FROM nodes WHERE type = 'Function' AND name LIKE 'read%'")
def functions_by_name(spark, d):
    return lookup.functions_by_name(_n(spark, d), "read*").select("id", "name").distinct()


@query("SELECT DISTINCT id FROM nodes WHERE type = 'Function' AND id IN (SELECT function_id FROM nodes WHERE type = 'Parameter' AND code LIKE '%char%')")
def functions_by_parameter(spark, d):
    return lookup.functions_by_parameter(_n(spark, d), "*char*").select("id").distinct()


@query("SELECT DISTINCT id, name, filepath FROM nodes WHERE type = 'Function' AND name IS NOT NULL AND filepath LIKE '/corpus/sard/%'")
def functions_by_file(spark, d):
    return lookup.functions_by_file(_n(spark, d), "/corpus/sard/*").select("id", "name", "filepath").distinct()


@query("SELECT DISTINCT filepath FROM nodes WHERE filepath LIKE '%/main_%.c'")
def files_by_name(spark, d):
    return lookup.files_by_name(table(spark, d, "nodes"), "*/main_*.c")


@query("SELECT DISTINCT id FROM nodes WHERE is_cfg")
def all_statements(spark, d):
    return lookup.statements(_n(spark, d)).select("id").distinct()


@query("SELECT DISTINCT id FROM nodes WHERE code LIKE 'memcpy %'")
def calls_with_prefix(spark, d):
    return lookup.calls_with_prefix(_n(spark, d), "memcpy").select("id").distinct()


@query("SELECT DISTINCT id, code FROM nodes WHERE type = 'Condition' AND regexp_full_match(code, '.*(len|size).*') AND function_id IN (SELECT id FROM nodes WHERE type = 'Function' AND name LIKE 'g%')")
def conditions_of(spark, d):
    return lookup.conditions_of(_n(spark, d), "g*", ".*(len|size).*").select("id", "code").distinct()


@query("SELECT DISTINCT id FROM nodes WHERE type = 'Condition' AND function_id IN (SELECT function_id FROM nodes WHERE code LIKE 'memcpy (%' )")
def chain_and(spark, d):
    n = _n(spark, d)
    return lookup.in_functions_of(lookup.conditions(n), n.where(F.col("code").startswith("memcpy ("))).select("id").distinct()


@query("SELECT DISTINCT id FROM nodes WHERE type IN ('Function', 'Condition') AND (function_id IS NULL OR function_id NOT IN (SELECT function_id FROM nodes WHERE code LIKE 'memcpy (%' AND function_id IS NOT NULL))")
def chain_not(spark, d):
    n = _n(spark, d)
    return lookup.not_in_functions_of(n.where("type in ('Function', 'Condition')"), n.where(F.col("code").startswith("memcpy ("))).select("id").distinct()


@query("SELECT DISTINCT id FROM nodes WHERE type = 'GotoStatement' AND code = 'goto out ;'")
def find_by_property(spark, d):
    return lookup.find(_n(spark, d), "GotoStatement", code="goto out ;").select("id").distinct()


@query(WITH + "SELECT id, s AS score FROM (SELECT id, list_contains(string_split(code, ' '), 'memcpy')::INT + list_contains(string_split(code, ' '), 'sizeof')::INT AS s FROM n WHERE code IS NOT NULL) WHERE s > 0")
def lookup_ranked(spark, d):
    return lookup.ranked(_n(spark, d), ["memcpy", "sizeof"])


@query("SELECT DISTINCT function_id, id FROM nodes WHERE is_cfg AND regexp_replace(lower(test_id), '[^a-z0-9]+', '', 'g') = 'testcasesupport'")
def statements_of_case(spark, d):
    case = F.regexp_replace(F.lower("test_id"), "[^a-z0-9]+", "") == "testcasesupport"
    return lookup.statements(_n(spark, d)).where(case).select("function_id", "id").distinct()


# ---- steps


@query(WITH + "SELECT n.id AS id, x.dst AS next FROM n JOIN e x ON x.src = n.id AND x.etype = 'FLOWS_TO' WHERE n.type = 'Condition' GROUP BY 1, 2")
def successors(spark, d):
    g = _g(spark, d)
    flow = g.edge("FLOWS_TO").withColumnRenamed("src", "id")
    return g.node("type", where="type = 'Condition'").join(flow, "id").select("id", F.col("dst").alias("next"))


@query(WITH + "SELECT x.dst AS id, count(*) AS n FROM (SELECT DISTINCT src, dst, flow_label FROM e WHERE etype = 'FLOWS_TO' AND flow_label IN ('True', 'False')) x JOIN n ON n.id = x.src AND n.type = 'Condition' GROUP BY 1")
def labelled_targets(spark, d):
    g = _g(spark, d)
    return steps.out(g, _of(spark, d, "Condition"), "FLOWS_TO", "flow_label", ["True", "False"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT DISTINCT x.src AS id FROM e x JOIN n ON n.id = x.dst AND n.type = 'Condition' WHERE x.etype = 'REACHES' AND x.var IN ('len', 'ptr', 'buf')")
def producers(spark, d):
    return steps.dedup(steps.producers(_g(spark, d), _of(spark, d, "Condition"), ["len", "ptr", "buf"]))


@query(WITH + "SELECT DISTINCT x.dst AS id FROM e x JOIN n ON n.id = x.src AND n.type = 'Parameter' WHERE x.etype = 'REACHES' AND x.var = 'len'")
def users(spark, d):
    return steps.dedup(steps.users(_g(spark, d), _of(spark, d, "Parameter"), "len"))


@query(WITH + "SELECT DISTINCT x.src AS id FROM e x JOIN n ON n.id = x.dst AND n.type = 'ReturnStatement' WHERE x.etype = 'REACHES'")
def sources(spark, d):
    return steps.dedup(steps.sources(_g(spark, d), _of(spark, d, "ReturnStatement")))


@query(WITH + "SELECT DISTINCT x.dst AS id FROM e x JOIN n ON n.id = x.src AND n.type = 'Parameter' WHERE x.etype = 'REACHES'")
def sinks(spark, d):
    return steps.dedup(steps.sinks(_g(spark, d), _of(spark, d, "Parameter")))


@query(WITH + "SELECT DISTINCT z.dst AS id FROM n JOIN (SELECT DISTINCT src, dst FROM e WHERE etype = 'REACHES') y ON y.src = n.id JOIN (SELECT DISTINCT src, dst FROM e WHERE etype = 'FLOWS_TO') z ON z.src = y.dst WHERE n.type = 'Parameter'")
def two_hops(spark, d):
    g = _g(spark, d)
    return steps.dedup(steps.out(g, steps.sinks(g, _of(spark, d, "Parameter")), "FLOWS_TO"))


@query(WITH + "SELECT x.id, count(*) AS n FROM n JOIN n x ON x.function_id = n.function_id AND x.type = 'CFGExitNode' WHERE n.type = 'ReturnStatement' GROUP BY 1")
def exit_of(spark, d):
    return steps.to_exit(_g(spark, d), _of(spark, d, "ReturnStatement")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT DISTINCT function_id AS id FROM n WHERE type = 'GotoStatement' AND function_id IS NOT NULL")
def functions_of_nodes(spark, d):
    return steps.dedup(steps.functions(_g(spark, d), _of(spark, d, "GotoStatement")))


@query(WITH + "SELECT x.id FROM n x WHERE x.is_cfg AND x.function_id IN (SELECT id FROM n WHERE type = 'Function' AND name LIKE 'read%')")
def function_statements(spark, d):
    return steps.function_nodes(_g(spark, d), _pipe(lookup.functions_by_name(_n(spark, d), "read*")), statements_only=True)


@query(WITH + "SELECT n.id, n.code, f.name AS function, n.filepath FROM n LEFT JOIN n f ON f.id = n.function_id AND f.type = 'Function' WHERE n.type = 'Condition'")
def locations(spark, d):
    return steps.locations(_g(spark, d), _of(spark, d, "Condition"))


@query(WITH + "SELECT id FROM n WHERE type = 'Condition' AND hidden IS NOT TRUE AND (function_id IS NULL OR function_id NOT IN (SELECT id FROM n WHERE hidden))")
def visible(spark, d):
    return steps.visible(_g(spark, d), _of(spark, d, "Condition"))


@query(WITH + "SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id")
def degree(spark, d):
    return steps.degree(_g(spark, d))


@query(WITH + "SELECT DISTINCT src, dst, etype FROM (SELECT src, dst, etype FROM e UNION ALL SELECT dst, src, etype FROM e) WHERE etype = 'CONTROLS' AND src IN (SELECT id FROM n WHERE type = 'Condition') ORDER BY src, dst, etype LIMIT 500")
def pattern_bidirectional_limit(spark, d):
    return steps.pattern(_g(spark, d), "CONTROLS", starts=_of(spark, d, "Condition"), bidirectional=True, limit=500)


@query(WITH + "SELECT src AS id, count(*) AS n FROM (SELECT DISTINCT src, dst FROM e WHERE etype = 'CONTROLS' UNION ALL SELECT DISTINCT src, dst FROM e WHERE etype = 'REACHES') GROUP BY src")
def bag_union(spark, d):
    g = _g(spark, d)
    return steps.bag_union(g.edge("CONTROLS"), g.edge("REACHES")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT src AS id, count(*) AS n FROM (SELECT src, dst FROM e WHERE etype IN ('CONTROLS', 'REACHES') GROUP BY 1, 2) GROUP BY src")
def set_union(spark, d):
    g = _g(spark, d)
    return steps.set_union(g.edge("CONTROLS"), g.edge("REACHES")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT n.id, coalesce(k, 0) AS n FROM n LEFT JOIN (SELECT src, count(DISTINCT dst) AS k FROM e WHERE etype = 'CONTROLS' GROUP BY src) c ON c.src = n.id WHERE n.type = 'Condition'")
def controlled_count(spark, d):
    return steps.num_children(_g(spark, d), _of(spark, d, "Condition"), "CONTROLS")


@query("SELECT id, count(*) AS n FROM nodes WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def uniqueness_check(spark, d):
    return table(spark, d, "nodes").where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(WITH + "SELECT type, count(*) AS n, count(DISTINCT function_id) AS n_functions FROM n GROUP BY type")
def nodes_by_type(spark, d):
    return _g(spark, d).node("type", "function_id").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("function_id").alias("n_functions"))


# ---- joins across calls

CALLS = f"""fn AS MATERIALIZED (SELECT test_id, name, min(id) AS callee FROM n WHERE type = 'Function' AND name IS NOT NULL GROUP BY 1, 2),
    tc AS MATERIALIZED (SELECT DISTINCT fn.callee, c.id, c.function_id AS caller FROM (
        SELECT id, function_id, test_id, unnest(list_distinct(list_concat(
            [x FOR x IN regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*) ?\\(', 1) IF x NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'case')],
            [x || ' :: ' || x FOR x IN regexp_extract_all(code, 'new ([A-Za-z_]\\w*)', 1)]))) AS name
        FROM n WHERE is_cfg AND code IS NOT NULL) c JOIN fn ON fn.name = c.name AND fn.test_id = c.test_id WHERE fn.callee <> c.function_id) """


@query(WITH + ", " + CALLS + "SELECT callee, id, caller FROM tc")
def text_calls(spark, d):
    return slices.text_calls(_g(spark, d))


@query(WITH + ", " + CALLS + """, r AS (SELECT id AS root, id, 0 AS hops FROM n WHERE type = 'Function' UNION SELECT r.root, tc.caller, r.hops + 1 FROM r JOIN tc ON tc.callee = r.id WHERE r.hops < 3)
    SELECT root, id, min(hops) AS hops FROM r GROUP BY root, id""")
def callers_within_3(spark, d):
    return slices.callers_within(_g(spark, d), _of(spark, d, "Function"))


@query("SELECT DISTINCT id, type FROM nodes WHERE id IS NOT NULL AND (id IN (SELECT id FROM nodes WHERE type = 'Function' AND name LIKE 'read%') OR function_id IN (SELECT id FROM nodes WHERE type = 'Function' AND name LIKE 'read%'))")
def nodes_of_functions(spark, d):
    g = _g(spark, d)
    return g.of_functions(_pipe(lookup.functions_by_name(g.nodes, "read*"))).node("type")


@query(WITH + """, f AS MATERIALIZED (SELECT id FROM n WHERE id IN (SELECT id FROM nodes WHERE type = 'Function' AND name LIKE 'read%') OR function_id IN (SELECT id FROM nodes WHERE type = 'Function' AND name LIKE 'read%'))
    SELECT DISTINCT src, dst, etype FROM e WHERE src IN (FROM f) AND dst IN (FROM f)""")
def edges_of_functions(spark, d):
    g = _g(spark, d)
    return g.of_functions(_pipe(lookup.functions_by_name(g.nodes, "read*"))).edge(columns=("src", "dst", "etype"))


# ---- dependence and slices


@query(WITH + ", " + PDG + "SELECT src, dst, var FROM pdg")
def dependence_edges(spark, d):
    return slices.dependence_edges(_g(spark, d))


@query(WITH + ", " + PDG + "SELECT DISTINCT src, dst, trim(regexp_replace(var, '\\*\\s*', '', 'g')) AS var FROM pdg WHERE var IS NOT NULL")
def bare_data_edges(spark, d):
    return slices.bare_symbols(slices.without_control(slices.dependence_edges(_g(spark, d))))


@query(WITH + "SELECT DISTINCT src, dst, flow_label FROM e WHERE etype = 'FLOWS_TO' AND src NOT IN (SELECT id FROM n WHERE type = 'CFGErrorNode') AND dst NOT IN (SELECT id FROM n WHERE type = 'CFGErrorNode')")
def flow_edges(spark, d):
    return slices.flow_edges(_g(spark, d))


BACK = "b AS (SELECT k, id FROM pt UNION SELECT b.k, p.src FROM b JOIN pdg p ON p.dst = b.id) "
AHEAD = "a AS (SELECT k, id FROM pt UNION SELECT a.k, p.dst FROM a JOIN pdg p ON p.src = a.id AND p.var IS NOT NULL) "


@query(WITH + ", " + PDG + ", " + POINTS + ", " + BACK + "SELECT id, count(*) AS n_slices FROM b GROUP BY id")
def backward_slices(spark, d):
    found = slices.backward_slice(_g(spark, d), slices.points_of(table(spark, d, "slice_points")))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n_slices"))


@query(WITH + ", " + PDG + ", " + POINTS + ", " + AHEAD + "SELECT id, count(*) AS n_slices FROM a GROUP BY id")
def forward_slices(spark, d):
    found = slices.forward_slice(_g(spark, d), slices.points_of(table(spark, d, "slice_points")))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n_slices"))


def _members(spark, d):
    return slices.program_slice(_g(spark, d), slices.points_of(table(spark, d, "slice_points")))


MEMBERS = WITH + ", " + PDG + ", " + POINTS + ", " + BACK + ", " + AHEAD + ", m AS MATERIALIZED (SELECT k, id FROM a UNION SELECT k, id FROM b), "
LINES = """l AS MATERIALIZED (SELECT k, filepath AS path, line, string_agg(code, ' ' ORDER BY coalesce(col, -1), id, code) AS code FROM m JOIN n USING (id) WHERE line >= 0 AND code IS NOT NULL GROUP BY 1, 2, 3) """


@query(MEMBERS + LINES + "SELECT path, line, code, count(*) AS n FROM l GROUP BY 1, 2, 3")
def slice_lines(spark, d):
    return slices.slice_lines(_g(spark, d), _members(spark, d)).groupBy("path", "line", "code").agg(F.count(F.lit(1)).alias("n"))


@query(MEMBERS + LINES + """SELECT path, start_line, n_lines, text, count(*) AS n FROM (SELECT k, path, min(line) AS start_line, count(*)::INT AS n_lines, string_agg(code || ' ' || line, chr(10) ORDER BY line) AS text
    FROM l GROUP BY k, path) GROUP BY ALL""")
def slice_text(spark, d):
    blocks = slices.rendered(slices.slice_lines(_g(spark, d), _members(spark, d)))
    return blocks.groupBy("path", "start_line", F.size("lines").alias("n_lines"), "text").agg(F.count(F.lit(1)).alias("n"))


@query(MEMBERS + LINES + """SELECT label, n_hits, count(*) AS n FROM (SELECT k, (coalesce(sum(hit), 0) > 0)::INT AS label, coalesce(sum(hit), 0)::BIGINT AS n_hits FROM (SELECT DISTINCT k, path, line FROM l)
    LEFT JOIN (SELECT DISTINCT path, line, 1 AS hit FROM vul_lines) USING (path, line) GROUP BY k) GROUP BY ALL""")
def slice_labels(spark, d):
    labels = slices.label_slices(slices.slice_lines(_g(spark, d), _members(spark, d)), table(spark, d, "vul_lines"))
    return labels.groupBy("label", "n_hits").agg(F.count(F.lit(1)).alias("n"))


@query(MEMBERS + LINES + """SELECT h AS slice_hash, count(*) AS n FROM (SELECT md5(string_agg(code, ' ' ORDER BY line)) AS h FROM l GROUP BY k, path) GROUP BY 1""")
def slice_hashes(spark, d):
    blocks = slices.rendered(slices.slice_lines(_g(spark, d), _members(spark, d)))
    return blocks.select(text.slice_hash(F.col("lines")).alias("slice_hash")).groupBy("slice_hash").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT path, list_sort(list(DISTINCT line)) AS lines FROM vul_lines WHERE path IS NOT NULL AND NOT contains(path, '/shared/') GROUP BY path")
def flawed_lines(spark, d):
    return slices.flawed_lines_by_file(table(spark, d, "vul_lines"))


MERGED = "ml AS MATERIALIZED (SELECT function_id, line, string_agg(code, ' ' ORDER BY coalesce(col, -1), id, code) AS code FROM n WHERE line >= 0 AND code IS NOT NULL AND function_id IS NOT NULL GROUP BY 1, 2) "


@query(WITH + ", " + MERGED + "SELECT * FROM ml")
def merged_lines(spark, d):
    return slices.merge_lines(_g(spark, d).node("line", "col", "code", "function_id", where="line >= 0"))


@query(WITH + ", " + MERGED + "SELECT function_id, min(line) AS first_line, max(line) AS last_line, string_agg(code, chr(10) ORDER BY line) AS code FROM (SELECT *, line - row_number() OVER (PARTITION BY function_id ORDER BY line) AS i FROM ml) GROUP BY function_id, i")
def merged_runs(spark, d):
    return slices.merge_runs(slices.merge_lines(_g(spark, d).node("line", "col", "code", "function_id", where="line >= 0")))


SYMBOLS = """s AS (SELECT DISTINCT q.id, n.function_id, n.start_idx AS pos, q.symbol, q.is_def FROM (SELECT src AS id, var AS symbol, true AS is_def FROM e WHERE etype = 'REACHES'
    UNION SELECT dst, var, false FROM e WHERE etype = 'REACHES') q JOIN n USING (id)) """


def _symbols(g: CodeGraph) -> DataFrame:
    data = g.edge("REACHES", columns=("src", "dst", "var"))
    one = lambda c, is_def: data.select(F.col(c).alias("id"), F.col("var").alias("symbol"), F.lit(is_def).alias("is_def"))
    ends = one("src", True).unionByName(one("dst", False)).distinct()
    return ends.join(g.node("function_id", "start_idx").withColumnRenamed("start_idx", "pos"), "id")


@query(WITH + ", " + SYMBOLS + """SELECT DISTINCT src, id AS dst, symbol AS var FROM (SELECT *, last_value(CASE WHEN is_def THEN id END IGNORE NULLS)
    OVER (PARTITION BY function_id, symbol ORDER BY pos NULLS FIRST, is_def::INT, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM s) WHERE NOT is_def AND src IS NOT NULL AND src <> id""")
def completed_data_edges(spark, d):
    return slices.complete_data_edges(_symbols(_g(spark, d)))


@query(WITH + """SELECT test, branch, id FROM (SELECT src AS test, dst AS id, min(flow_label) AS branch, max(flow_label) AS high FROM e WHERE etype = 'FLOWS_TO' AND flow_label IN ('True', 'False') GROUP BY 1, 2) WHERE branch = high""")
def arms_without_common(spark, d):
    flow = _g(spark, d).edge("FLOWS_TO", columns=("src", "dst", "flow_label")).where(F.col("flow_label").isin("True", "False"))
    return slices.common_to_arms(flow.select(F.col("src").alias("test"), F.col("flow_label").alias("branch"), F.col("dst").alias("id")))


@query()
def if_scopes(spark, d):
    return slices.scopes_of(slices.if_scopes(_g(spark, d)))


@query()
def nearest_conditions(spark, d):
    return arguments.nearest_condition(slices.if_scopes(_g(spark, d)))


@query()
def inlined_slices(spark, d):
    pts = slices.points_of(table(spark, d, "slice_points"))
    return slices.crossing_lines(_g(spark, d), pts)


@query()
def inlined_labels(spark, d):
    labels = slices.crossing_labels(_g(spark, d), slices.points_of(table(spark, d, "slice_points")), table(spark, d, "vul_lines"))
    return labels.groupBy("label", "n_hits").agg(F.count(F.lit(1)).alias("n"))


# ---- reachability, paths, taint


@query(WITH + """, r AS (SELECT id AS root, id, 0 AS hops FROM n WHERE type = 'Parameter' UNION SELECT r.root, x.dst, r.hops + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM e WHERE etype = 'FLOWS_TO') x ON x.src = r.id WHERE hops < 3)
    SELECT root, id, min(hops) AS hops FROM r GROUP BY root, id""")
def bounded_hops_3(spark, d):
    g = _g(spark, d)
    params = _of(spark, d, "Parameter").select(F.col("id").alias("root"), "id")
    return reach.reach(g.edge("FLOWS_TO"), params, 3)


@query(WITH + """, r AS (SELECT id AS root, id FROM n WHERE type = 'CFGEntryNode' UNION SELECT r.root, x.dst FROM r JOIN e x ON x.src = r.id AND x.etype = 'FLOWS_TO') SELECT root, count(*) AS n FROM r GROUP BY root""")
def reachable_from_entry(spark, d):
    entry = _of(spark, d, "CFGEntryNode").select(F.col("id").alias("root"), "id")
    return reach.reach(_g(spark, d).edge("FLOWS_TO"), entry).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + """, c AS (SELECT DISTINCT src, dst FROM e WHERE etype = 'CONTROLS'), r AS (SELECT id AS root, id, 0 AS h FROM n WHERE type = 'ReturnStatement' UNION SELECT r.root, c.src, h + 1 FROM r JOIN c ON c.dst = r.id WHERE h < 2)
    SELECT DISTINCT r.root, r.id FROM r JOIN n ON n.id = r.id AND n.type = 'Condition' WHERE r.id <> r.root""")
def controlling_conditions(spark, d):
    return taint.controlling_conditions(_g(spark, d), _of(spark, d, "ReturnStatement"), 2)


@query(WITH + """, t AS (SELECT DISTINCT dst AS src, src AS dst FROM e WHERE etype = 'REACHES'), r AS (SELECT id AS root, id, 0 AS hops FROM n WHERE type = 'ReturnStatement' UNION SELECT r.root, t.dst, hops + 1 FROM r JOIN t ON t.src = r.id WHERE hops < 4)
    SELECT root, id, min(hops) AS hops FROM r GROUP BY root, id""")
def tainted_by(spark, d):
    return taint.tainted_by(_g(spark, d), _of(spark, d, "ReturnStatement"))


@query(WITH + """, x AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE etype = 'FLOWS_TO'), r AS (SELECT id AS start, id AS "at", [id] AS path FROM n WHERE type = 'Condition'
    UNION ALL SELECT r.start, x.dst, list_append(r.path, x.dst) FROM r JOIN x ON x.src = r."at" WHERE len(r.path) < 20 AND len(list_filter(r.path, lambda p: p = x.dst)) < 2)
    SELECT start, r."at" AS "end", min({'n': len(path), 'path': path}).path AS path FROM r JOIN n ON n.id = r."at" AND n.type = 'ReturnStatement' GROUP BY 1, 2""")
def flow_paths(spark, d):
    n = _n(spark, d)
    starts = lookup.conditions(n).select(F.col("id").alias("start")).distinct()
    ends = lookup.by_type(n, "ReturnStatement").select(F.col("id").alias("end")).distinct()
    return reach.paths_to_any(_g(spark, d).edge("FLOWS_TO"), starts, ends)


@query(WITH + """, c AS (SELECT DISTINCT src, dst FROM e WHERE etype = 'CONTROLS'), r AS (SELECT id AS root, id FROM n WHERE code LIKE 'memcpy (%' UNION SELECT r.root, c.src FROM r JOIN c ON c.dst = r.id)
    SELECT id FROM n WHERE code LIKE 'memcpy (%' AND id NOT IN (SELECT r.root FROM r JOIN n x ON x.id = r.id AND x.type = 'Condition' AND r.id <> r.root AND regexp_full_match(x.code, '.*(<|>).*'))""")
def unchecked_calls(spark, d):
    n = _n(spark, d)
    return taint.unchecked(_g(spark, d), _pipe(n.where(F.col("code").startswith("memcpy ("))), "x", ".*(<|>).*")


@query(WITH + """, x AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE etype = 'REACHES' AND src <> dst), p AS (SELECT id AS g FROM n WHERE type = 'ReturnStatement'), one AS (SELECT p.g, x.src, x.dst FROM p JOIN x ON x.dst = p.g),
    two AS (SELECT DISTINCT one.g, x.src, x.dst FROM one JOIN x ON x.dst = one.src)
    SELECT g AS graphlet, src, dst, 'data' AS kind FROM (SELECT * FROM one UNION SELECT * FROM two)
    UNION ALL SELECT p.g, c.src, p.g, 'condition' FROM p JOIN (SELECT DISTINCT src, dst FROM e WHERE etype = 'CONTROLS') c ON c.dst = p.g JOIN n ON n.id = c.src AND n.type = 'Condition' WHERE c.src <> p.g""")
def local_definition_tree(spark, d):
    return taint.local_definition_tree(_g(spark, d), _of(spark, d, "ReturnStatement"))


@query(WITH + """, l0 AS MATERIALIZED (SELECT id, (list_reduce(list_prepend(0::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(type, '')]), lambda a, c: (a * 31 + c) % 4294967296) & 65535)::INT AS v FROM n),
    c AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE etype = 'CONTROLS'),
    l1 AS MATERIALIZED (SELECT l0.id, xor(((l0.v << 1) | (l0.v >> 15)) & 65535, coalesce(b.x, 0)) AS v FROM l0 LEFT JOIN (SELECT src, bit_xor(v) AS x FROM c JOIN l0 ON l0.id = c.dst GROUP BY src) b ON b.src = l0.id)
    SELECT l1.id, xor(((l1.v << 1) | (l1.v >> 15)) & 65535, coalesce(b.x, 0)) AS label FROM l1 LEFT JOIN (SELECT src, bit_xor(v) AS x FROM c JOIN l1 ON l1.id = c.dst GROUP BY src) b ON b.src = l1.id""")
def neighborhood_hash(spark, d):
    g = _g(spark, d)
    return taint.neighborhood_hash(g.edge("CONTROLS"), g.node("type").select("id", F.col("type").alias("label")))


@query()
def neighborhood_vectors(spark, d):
    g = _g(spark, d)
    state = taint.neighborhood_hash(g.edge("CONTROLS"), g.node("type").select("id", F.col("type").alias("label")))
    return taint.label_histogram(state, g.node("function_id", where="function_id is not null").select("id", F.col("function_id").alias("owner")))


# ---- points of interest

NAMES = "[x FOR x IN regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*) ?\\(', 1) IF x NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'case')]"
SENSITIVE = ", ".join(f"'{x}'" for x in points.SENSITIVE)
KINDS = ", ".join(f"'{x}'" for x in points.STATEMENTS)


@query(WITH + f"SELECT id, function_id, test_id, name FROM (SELECT id, function_id, test_id, unnest(list_distinct({NAMES})) AS name FROM n WHERE type IN ({KINDS}) AND code IS NOT NULL) WHERE name IN ({SENSITIVE})")
def call_points(spark, d):
    return points.call_points(_g(spark, d))


@query(WITH + "SELECT id, function_id, test_id, code FROM n WHERE type IN ('IdentifierDeclStatement', 'Parameter') AND contains(string_split(code, ' = ')[1], '*')")
def pointer_points(spark, d):
    return points.declaration_points(_g(spark, d), "pointer")


@query(WITH + "SELECT id, function_id, test_id, code FROM n WHERE type IN ('IdentifierDeclStatement', 'Parameter') AND contains(string_split(code, ' = ')[1], ' [ ')")
def array_points(spark, d):
    return points.declaration_points(_g(spark, d), "array")


@query(WITH + "SELECT id, function_id, test_id, code FROM n WHERE type = 'ExpressionStatement' AND ((contains(code, ' = ') AND regexp_matches(string_split(code, ' = ')[-1], '[A-Za-z0-9_\\])] (\\+|-|\\*|%) [A-Za-z0-9_(]')) OR regexp_matches(code, ' / [A-Za-z_]'))")
def arithmetic_points(spark, d):
    return points.arithmetic_points(_g(spark, d))


@query(WITH + """SELECT id, arg_max(use, struct_pack(l := line, k := -use)) AS use FROM (SELECT p.id, x.dst AS use, u.line FROM n p JOIN (SELECT DISTINCT src, dst FROM e WHERE etype = 'REACHES') x ON x.src = p.id JOIN n u ON u.id = x.dst
    WHERE p.type IN ('IdentifierDeclStatement', 'Parameter') AND contains(string_split(p.code, ' = ')[1], '*')) GROUP BY id""")
def last_pointer_uses(spark, d):
    return points.last_uses(_g(spark, d), "pointer")


@query(WITH + f"SELECT test_id, count(*) AS n, list_sort(list(DISTINCT id)) AS ids FROM (SELECT id, test_id, unnest(list_distinct({NAMES})) AS name FROM n WHERE type IN ({KINDS}) AND code IS NOT NULL) WHERE name IN ({SENSITIVE}) GROUP BY test_id")
def points_by_case(spark, d):
    return points.points_by_case(points.call_points(_g(spark, d)))


# ---- parsing


@query()
def parsed_calls(spark, d):
    return snippets.calls_in_code(_g(spark, d))


@query()
def rebuilt_nodes(spark, d):
    return snippets.rebuilt(_g(spark, d)).nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query()
def rebuilt_edges(spark, d):
    return snippets.rebuilt(_g(spark, d)).edges.groupBy("etype").agg(F.count(F.lit(1)).alias("n"))


# ---- text on the way to samples


@query(WITH + f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code, '{TOKEN}')) AS token FROM n WHERE is_cfg) GROUP BY token")
def token_counts(spark, d):
    code = _g(spark, d).node("is_cfg", "code", where="is_cfg")
    return code.select(F.explode(text.c_tokens(F.col("code"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query()
def canonical_codes(spark, d):
    code = _g(spark, d).node("code", where="is_cfg and code is not null")
    return code.select("id", F.array_join(text.canonical(text.c_tokens(F.col("code"))), " ").alias("code"))


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.text_words(F.col("text")).alias("words"))


DOC_WORDS = r"""w AS MATERIALIZED (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[\s\v!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+') IF x <> ''] AS words FROM documents WHERE text IS NOT NULL) """


@query("WITH " + DOC_WORDS + "SELECT word, sum(k)::BIGINT AS n, count(*) AS n_docs FROM (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY ALL) GROUP BY word")
def vocabulary(spark, d):
    return text.vocabulary(_docs(spark, d))


@query("WITH " + DOC_WORDS + """, k AS MATERIALIZED (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY ALL), df AS (SELECT word, count(*) AS n FROM k GROUP BY word)
    SELECT doc_id, word, round((1 + ln(k)) * ln(1 + (SELECT count(*) FROM w) / (1 + n)), 9) AS weight FROM k JOIN df USING (word)""")
def tfidf(spark, d):
    return text.tfidf(_docs(spark, d))


@query("WITH " + DOC_WORDS + "SELECT doc_id, [('0x' || substr(md5(x), 1, 15))::BIGINT % 9999 + 1 FOR x IN words] AS ids FROM w")
def hashed_ids(spark, d):
    return _docs(spark, d).select("doc_id", text.hashed_ids(F.col("words"), 10000).alias("ids"))


@query("WITH " + DOC_WORDS + """, i AS (SELECT doc_id, [('0x' || substr(md5(x), 1, 15))::BIGINT % 9999 + 1 FOR x IN words] AS ids FROM w)
    SELECT doc_id, CASE WHEN len(ids) > 50 THEN ids[-50:] ELSE list_concat(list_resize([]::BIGINT[], 50 - len(ids), 0), ids) END AS ids FROM i""")
def padded_ids(spark, d):
    return _docs(spark, d).select("doc_id", text.pad_ids(text.hashed_ids(F.col("words"), 10000), 50).alias("ids"))


@query("WITH " + DOC_WORDS + """, p AS MATERIALIZED (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w)
    SELECT a.word, b.word AS context, count(*) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 2 AND a.i + 2 AND a.i <> b.i GROUP BY ALL""")
def skipgrams(spark, d):
    return text.skipgrams(_docs(spark, d), 2).groupBy("word", "context").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + DOC_WORDS + "SELECT word, doc_id, list(i ORDER BY i)::INT[] AS places FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w) GROUP BY ALL")
def reverse_index(spark, d):
    return text.reverse_index(_docs(spark, d))


@query("WITH h AS (SELECT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS f FROM h) WHERE doc_id <> f")
def later_copies(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"))
    return text.later_copies(rows, "h", "doc_id").select("doc_id")


@query("SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil((SELECT count(*) FROM documents) / 5))::INT AS fold FROM documents")
def folds(spark, d):
    return text.fold(table(spark, d, "documents").select("doc_id"), "doc_id", 5).select("doc_id", "fold")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS chunk FROM documents")
def chunked(spark, d):
    return text.chunks(table(spark, d, "documents").select("doc_id"), "doc_id", 256)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS no, count(*) OVER () AS n FROM documents) WHERE no <= n - n % 32")
def whole_batches(spark, d):
    return text.whole_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 32)


@query("SELECT test_id, CASE WHEN ('0x' || substr(md5(test_id), 1, 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM test_cases")
def split_by_program(spark, d):
    return table(spark, d, "test_cases").select("test_id", slices.split_of_case(F.col("test_id")).alias("split"))


@query(WITH + """, c AS (SELECT function_id, id, row_number() OVER (PARTITION BY function_id ORDER BY id) AS no, type FROM n WHERE function_id IS NOT NULL AND type = 'Condition'),
    r AS (SELECT function_id, id, row_number() OVER (PARTITION BY function_id ORDER BY id) AS no FROM n WHERE function_id IS NOT NULL AND type = 'ExpressionStatement')
    SELECT c.function_id, c.no::INT AS no, c.id AS x, r.id AS y FROM c JOIN r ON r.function_id = c.function_id AND r.no = c.no""")
def zipped_pairs(spark, d):
    of = lambda kind: _n(spark, d).where(F.col("type") == kind).where("function_id is not null").select("function_id", "id").distinct()
    return windows.pairs(of("Condition"), of("ExpressionStatement"), "function_id", "id")


@query(WITH + "SELECT id, lag(id) OVER w AS prior_id, lead(id) OVER w AS next_id FROM n WHERE is_cfg AND function_id IS NOT NULL WINDOW w AS (PARTITION BY function_id ORDER BY start_idx NULLS FIRST, id)")
def siblings(spark, d):
    n = _g(spark, d).node("is_cfg", "function_id", "start_idx", where="is_cfg and function_id is not null")
    return windows.siblings(n, "function_id", "start_idx", "id").select("id", "prior_id", "next_id")


# ---- sources


@query("""WITH p AS (SELECT DISTINCT filepath AS path, string_split(filepath, '/') AS s FROM nodes WHERE filepath IS NOT NULL AND contains(filepath, '/')),
    x AS (SELECT path, array_to_string(s[1:k - 1], '/') AS parent, array_to_string(s[1:k], '/') AS child FROM (SELECT path, s, unnest(range(2, len(s) + 1)) AS k FROM p))
    SELECT DISTINCT parent, child FROM x WHERE parent <> ''""")
def folder_tree(spark, d):
    return folders(table(spark, d, "nodes").select(F.col("filepath").alias("path")).distinct())[1]


@query("SELECT DISTINCT filepath, array_to_string(string_split(filepath, '/')[-4:-2], '') AS folders FROM nodes WHERE filepath IS NOT NULL AND len(string_split(filepath, '/')) >= 4")
def case_of_path(spark, d):
    paths = table(spark, d, "nodes").select("filepath").distinct().where("filepath is not null and size(split(filepath, '/')) >= 4")
    return paths.select("filepath", case_of_folders(F.col("filepath")).alias("folders"))


@query()
def graph_as_text(spark, d):
    g = _g(spark, d)
    return graph_text(g.node("type", "code"), g.edge(columns=("src", "dst", "etype", "var", "flow_label")))


# ---- scores

PAIR = "SELECT l_linestatus AS s, (l_returnflag = 'R')::INT AS y, l_discount * 10 AS p FROM lineitem"
CONFUSION = f"SELECT s AS status, sum((y = 1 AND p >= 0.5)::INT)::BIGINT AS tp, sum((y = 0 AND p >= 0.5)::INT)::BIGINT AS fp, sum((y = 1 AND p < 0.5)::INT)::BIGINT AS fn, sum((y = 0 AND p < 0.5)::INT)::BIGINT AS tn FROM ({PAIR}) GROUP BY s"


def _confusion(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("status"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))
    return scores.confusion(rows, "y", "p", "status")


@query(f"""SELECT status, tp, fp, fn, tn, round(fp / (fp + tn), 9) AS fpr, round(fn / (fn + tp), 9) AS fnr, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
    round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
    round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp)::DOUBLE * (tn + fn)), 9) AS mcc FROM ({CONFUSION})""")
def confusion_rates(spark, d):
    return scores.rates(_confusion(spark, d))


@query(f"SELECT status, round((1 + 4) * p * r / (4 * p + r + 1e-8), 9) AS f_beta FROM (SELECT status, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM ({CONFUSION}))")
def f_beta(spark, d):
    return scores.f_beta(_confusion(spark, d), 2.0).select("status", "f_beta")


@query("""SELECT round(avg((p - y) ** 2), 6) AS mean_squared_error, round(avg(abs(p - y)), 6) AS mean_absolute_error, round(avg(100 * abs((y - p) / greatest(abs(y), 1e-7))), 4) AS mean_absolute_percentage_error,
    round(avg((ln(1 + greatest(p, 1e-7)) - ln(1 + greatest(y, 1e-7))) ** 2), 6) AS mean_squared_logarithmic_error, round(avg(greatest(1 - y * p, 0) ** 2), 6) AS squared_hinge, round(avg(greatest(1 - y * p, 0)), 6) AS hinge,
    round(avg((p - y) + ln(1 + exp(-2 * (p - y))) - ln(2)), 6) AS logcosh, round(avg(-(y * ln(greatest(1e-7, least(1 - 1e-7, p))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, p))))), 6) AS binary_crossentropy,
    round(avg(greatest(1e-7, least(1 - 1e-7, y)) * ln(greatest(1e-7, least(1 - 1e-7, y)) / greatest(1e-7, least(1 - 1e-7, p)))), 6) AS kullback_leibler_divergence, round(avg(p - y * ln(p + 1e-7)), 6) AS poisson
    FROM (SELECT l_tax AS y, l_discount AS p FROM lineitem)""")
def losses(spark, d):
    y, p = F.col("l_tax"), F.col("l_discount")
    digits = {"mean_absolute_percentage_error": 4}
    return table(spark, d, "lineitem").agg(*(F.round(F.avg(f(y, p)), digits.get(k, 6)).alias(k) for k, f in scores.LOSSES.items()))


@query("""SELECT round(sum(x), 4) AS linear, round(sum(greatest(x, 0)), 4) AS relu, round(sum(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END), 4) AS elu,
    round(sum(1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END), 4) AS selu, round(sum(greatest(x, 0) + ln(1 + exp(-abs(x)))), 4) AS softplus, round(sum(x / (1 + abs(x))), 4) AS softsign,
    round(sum((exp(x) - exp(-x)) / (exp(x) + exp(-x))), 4) AS tanh, round(sum(1 / (1 + exp(-x))), 4) AS sigmoid, round(sum(greatest(0, least(1, 0.2 * x + 0.5))), 4) AS hard_sigmoid
    FROM (SELECT value / 50 - 1 AS x FROM events WHERE value IS NOT NULL)""")
def activations(spark, d):
    x = F.col("value") / 50 - 1
    rows = table(spark, d, "events").where("value is not null")
    return rows.agg(*(F.round(F.sum(f(x)), 4).alias(k) for k, f in scores.ACTIVATIONS.items()))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT qid, vid, round(c, 6) AS cos FROM (SELECT q.vec_id AS qid, b.vec_id AS vid, list_cosine_similarity(q.x, b.x) AS c,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.x, b.x), 12) DESC, b.vec_id) AS r FROM v q JOIN v b ON q.vec_id <> b.vec_id AND q.vec_id % 50 = 0) WHERE r <= 10""")
def nearest_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"))
    q = v.where("vid % 50 = 0").select(F.col("vid").alias("qid"), F.col("vec").alias("q"))
    return nearest(v, q, 10).select("qid", "vid", F.round("cos", 6).alias("cos"))


@query("SELECT vec_id, [round(x / sqrt(list_sum([y * y FOR y IN e])), 6) FOR x IN e] AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def unit_vectors(spark, d):
    unit = scores.normalized(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.transform(unit, lambda v: F.round(v, 6)).alias("unit"))


@query("SELECT vec_id, [(i = label)::INT FOR i IN range(0, 10)] AS hot FROM embeddings")
def one_hot_labels(spark, d):
    return table(spark, d, "embeddings").select("vec_id", scores.one_hot(F.col("label"), 10).alias("hot"))


@query()
def word_vectors(spark, d):
    code = _g(spark, d).node("code", where="is_cfg and code is not null")
    vectors = skip_gram(code.select(text.c_tokens(F.col("code")).alias("words")))
    return vectors.select("token", F.col("vec").cast("array<double>").alias("vec"))


@query()
def sample_scores(spark, d):
    """Conditions as samples of 16 tokens of 4 values, scored by a recurrent classifier with seeded weights."""
    code = _g(spark, d).node("type", "code", where="type = 'Condition' and code is not null")
    ids = text.pad_ids(text.hashed_ids(text.c_tokens(F.col("code")), 1000), 16)
    x = F.transform(ids, lambda i: F.when(i == 0, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(F.sin(i), F.cos(i), F.sin(i * 2), F.cos(i * 2))))
    return predict(code.select(F.col("id").alias("sample_id"), x.alias("x")), Classifier.seeded(4, 8))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query(WITH + f"SELECT doc_id, n_tokens FROM (SELECT id AS doc_id, len(regexp_extract_all(code, '{TOKEN}'))::INT AS n_tokens FROM n WHERE is_cfg AND code IS NOT NULL) WHERE n_tokens > 0")
def embedded_statements(spark, d):
    """Statements as sequences of their tokens' vectors: each token has one."""
    code = _g(spark, d).node("code", where="is_cfg and code is not null").select(F.col("id").alias("doc_id"), text.c_tokens(F.col("code")).alias("words"))
    return embedded(code, skip_gram(code)).select("doc_id", F.size("x").alias("n_tokens"))


# ---- functions on code


@query(WITH + r"""SELECT id, [y FOR y IN [regexp_extract(x, '([A-Za-z_][A-Za-z0-9_]*)\s*;?\s*$', 1) FOR x IN string_split(regexp_replace(regexp_replace(code, ' = [^,;]*', '', 'g'), '\[[^\]]*\]', '', 'g'), ',')] IF y <> ''] AS names
    FROM n WHERE type = 'IdentifierDeclStatement' AND code IS NOT NULL""")
def declared_names(spark, d):
    g = _g(spark, d).node("code", where="type = 'IdentifierDeclStatement' and code is not null")
    return g.select("id", codes.declared_names(F.col("code")).alias("names"))


@query(WITH + r"""SELECT id, list_concat([x || ' :: ' || x FOR x IN regexp_extract_all(code, '\bnew ([A-Za-z_]\w*)', 1)], ['delete ' || x FOR x IN regexp_extract_all(code, '\bdelete (?:\[ \] )?([A-Za-z_]\w*)', 1)]) AS calls
    FROM n WHERE is_cfg AND code IS NOT NULL""")
def object_calls(spark, d):
    return _g(spark, d).node("code", where="is_cfg and code is not null").select("id", codes.object_calls(F.col("code")).alias("calls"))


@query()
def written_variables(spark, d):
    code = _g(spark, d).node("code", where="is_cfg and code is not null and instr(code, '(') > 0")
    # Statements that name no such function write nothing: they are left out before anything is cut apart.
    some = "|".join([*codes.WRITES_FIRST, *codes.WRITES_FROM])
    code = code.where(F.col("code").rlike(rf"(?:^|[^A-Za-z0-9_])(?:{some}) ?\("))
    return code.select("id", F.explode(codes.written_by_call(F.col("code"))).alias("name"))


@query(WITH + r"""SELECT id, array_to_string([CASE WHEN regexp_matches(t, '^[0-9]') THEN 'NUM' WHEN regexp_matches(t, '^["\']') THEN 'TEXT' ELSE t END FOR t IN string_split(replace(' ' || code || ' ', ' len ', ' ARG '), ' ')], ' ') AS template
    FROM n WHERE type = 'Condition' AND code IS NOT NULL""".replace("\\'", "''"))
def condition_templates(spark, d):
    code = _g(spark, d).node("code", where="type = 'Condition' and code is not null")
    return code.select("id", checks.normalized_code(F.col("code"), F.lit("len")).alias("template"))


@query()
def similar_functions(spark, d):
    """For each function with an id divisible by 50 the 5 with the most similar calls."""
    code = _g(spark, d).node("code", "function_id", where="is_cfg and code is not null and function_id is not null")
    words = code.select("function_id", F.explode(points.called_names(F.col("code"))).alias("word")).groupBy("function_id").agg(F.collect_list("word").alias("words"))
    v = api_vectors(words, "function_id").select(F.col("function_id").alias("vid"), "vec")
    return nearest(v, v.where("vid % 50 = 0").select(F.col("vid").alias("qid"), F.col("vec").alias("q")), 5)


@query()
def baseline_of_slices(spark, d):
    """A logistic baseline: are the lines of a slice vulnerable, by the mean vectors of its tokens. It learns from the slices of four in five functions
    and scores those of the others."""
    g = _g(spark, d)
    points_ = slices.points_of(table(spark, d, "slice_points"))
    lines = cut(slices.slice_lines(g, slices.program_slice(g, points_)))
    words = lines.groupBy(F.col("slice_id").alias("doc_id")).agg(F.flatten(F.collect_list(text.c_tokens(F.col("code")))).alias("words"))
    means = mean_vectors(words, skip_gram(words))
    samples = means.join(slices.label_slices(lines, table(spark, d, "vul_lines")).withColumnRenamed("slice_id", "doc_id"), "doc_id")
    place = points_.groupBy("slice_id").agg(F.min("function_id").alias("f")).withColumnRenamed("slice_id", "doc_id")
    samples = cut(samples.join(place, "doc_id").select(F.col("doc_id").alias("sample_id"), "vec", "label", (F.pmod(F.xxhash64("f"), F.lit(5)) == 0).alias("held")))
    return baseline_scores(samples.where("not held"), samples.where("held"))
