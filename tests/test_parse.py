"""Parsing and flow analyses on small functions with known results."""

import pytest

from weftgraph.parse import flow
from weftgraph.parse.build import graph_rows, is_source
from weftgraph.parse.lexer import tokens
from weftgraph.parse.syntax import parse, parse_statements


def graph(body, params="void"):
    return flow.control_flow(parse(f"void f({params}) {{ {body} }}")[1][0])


def symbols(body, tainted=None):
    _, block = parse_statements(body)
    return flow.use_def(flow.statement_flow(block), tainted)[2]


@pytest.mark.parametrize(
    ("body", "nodes", "edges", "labels"),
    [
        ("switch(x){case 1:A();case 2:B();case 3:C();}", 9, 11, 4),
        ("switch(x){case 1:A();case 2:B();break;case 3:C();}", 10, 12, 4),
        ("switch(x){case 1:A();case 2:B();default:C();}", 9, 10, 3),
        ("switch(c){case '1':A();case '2':B();case '3':C();}", 9, 11, 4),
        ("again: if(x){goto again;}", 5, 5, 2),
        ("int i; for(i=0;i<10;i++){A();}", 7, 7, 2),
        ("for(;;){A();}", 4, 4, 2),
        ("for(;c;){A();}", 4, 4, 2),
        ("for(;c;e){A();}", 5, 5, 2),
        ("if(foo){bar();}", 4, 4, 2),
        ("while(x){y();}", 4, 4, 2),
        ("do{y();}while(x);", 4, 4, 2),
        ("if(a){b();}else{c();}", 5, 5, 2),
        ("if(a){b();}else if(c){d();}", 6, 7, 4),
        ("while(x){ if (y) break; continue; }", 6, 7, 4),
        ("break;", 4, 3, 0),
    ],
)
def test_control_flow(body, nodes, edges, labels):
    g = graph(body)
    assert (len(g.nodes), len(g.edges), sum(bool(x) for *_, x in g.edges)) == (nodes, edges, labels)


@pytest.mark.parametrize(
    ("body", "uses", "defs"),
    [
        ("total += step;", {"total", "step"}, {"total"}),
        ("box.side = 3;", {"box"}, {"box", "box . side"}),
        ("draw(box.side);", {"draw", "box", "box . side"} - {"draw"}, set()),
        ("int w = box.side;", {"box", "box . side"}, {"w"}),
        ("q->head.next = 1;", {"q", "* q", "q -> head"}, {"* q", "q -> head", "q -> head . next"}),
        ("*(p+off) = 0;", {"p", "off"}, {"* ( p + off )", "* p", "* off"}),
        ("tab[row] = v;", {"tab", "row", "v"}, {"* tab", "* row"}),
        ("n--;", {"n"}, {"n"}),
        ("long w = h;", {"h"}, {"w"}),
        ("return size(q->len);", {"size", "q", "* q", "q -> len"}, set()),
    ],
)
def test_uses_and_definitions(body, uses, defs):
    got = symbols(body)
    assert (got["use"], got["def"]) == (uses, defs)


def test_members_carry_their_base():
    g = graph("box = make(); int w = box.side; show(box.side);")
    found = {(g.nodes[a].code, g.nodes[b].code, s) for a, b, s in flow.reaching(g, flow.use_def(g))}
    assert found == {("box = make ( ) ;", "int w = box . side ;", "box"), ("box = make ( ) ;", "show ( box . side ) ;", "box")}


@pytest.mark.parametrize(
    ("head", "uses", "defs"),
    [
        ("int lo = 0, hi = len; lo < hi; lo++", {"len"}, {"lo", "hi"}),
        ("lo = 0, hi = len; lo < hi; lo++", {"len"}, {"lo", "hi"}),
        ("char *s = text, *e; *s; s++", {"text"}, {"s", "e"}),
    ],
)
def test_heads_of_loops_hold_all_declarators(head, uses, defs):
    got = symbols(f"for({head}) {{ step(); }}")
    assert (got["use"], got["def"]) == (uses, defs)


def test_tainted_arguments_define():
    assert symbols("foo(x);", {"foo": {0}}) == {"use": {"x"}, "def": {"x", "* x"}}
    assert symbols("bar(1, &y);", {"bar": {1}})["def"] == {"y"}


def test_reaching_definitions_and_control():
    g = graph("int x = 0; if (x) { y = x; return; } x = 2; foo(x);")
    found = {(g.nodes[a].code, g.nodes[b].code, s) for a, b, s in flow.reaching(g, flow.use_def(g))}
    assert found == {("int x = 0 ;", "x", "x"), ("int x = 0 ;", "y = x ;", "x"), ("x = 2 ;", "foo ( x ) ;", "x")}
    above = flow.post_dominators(g)
    controls = {(g.nodes[a].code, g.nodes[b].code) for a, b in flow.control_dependence(g, above)}
    assert ("x", "y = x ;") in controls and ("x", "foo ( x ) ;") in controls and ("ENTRY", "int x = 0 ;") in controls
    assert above[1] == 1 and not any(a == b for a, b in flow.control_dependence(g, above))


def test_one_definition_reaches_one_use():
    g = graph("int x = 0; foo(x);")
    assert [(g.nodes[a].code, g.nodes[b].code) for a, b, _ in flow.reaching(g, flow.use_def(g))] == [("int x = 0 ;", "foo ( x ) ;")]


def test_expressions_lean_to_the_right():
    _, block = parse_statements("x = y = a - b - c;")
    outer = block.children[0].children[0]
    assert outer.type == "AssignmentExpr" and outer.children[1].type == "AssignmentExpr"
    minus = outer.children[1].children[1]
    assert minus.code == "a - b - c" and minus.children[0].code == "a" and minus.children[1].code == "b - c"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("(char) x;", "CastExpression"), ("a ? b : c;", "ConditionalExpression"), ("f(a)(b);", "CallExpression"), ("a->b;", "PtrMemberAccess"), ("a.b;", "MemberAccess"),
        ("a[1];", "ArrayIndexing"), ("!a;", "UnaryOp"), ("sizeof(int);", "SizeofExpr"), ("a || b;", "OrExpression"), ("a, b;", "Expression"), ("new C(1);", "CallExpression"), ("x = {1, .a = 2};", "InitializerList"),
    ],
)
def test_kinds_of_expressions(text, kind):
    _, block = parse_statements(text)
    assert kind in {n.type for n in block.walk()}


def test_odd_text_is_kept_as_water():
    toks, items = parse("#define A 1\nint g;\nint f(int a) {\n#if X\n a = 1;\n#else\n a = 2; }\n#endif\n static int q; @ weird ] ; return a; }\nclass C { int x; };\nint C::m() { delete p; }")
    assert [n.type for n in items].count("FunctionDef") == 2 and any(n.type == "ClassDefStatement" for n in items)
    body = items[[n.type for n in items].index("FunctionDef")]
    codes = [n.code for n in body.walk()]
    assert "a = 1 ;" in codes and "a = 2 ;" not in codes
    assert "static" in [n.code for n in body.walk() if n.type == "Statement"]


def test_tokens_have_places():
    found = tokens('int x; /* a */ // b\n  y = "s\\"t" ;')
    assert [t.text for t in found] == ["int", "x", ";", "y", "=", '"s\\"t"', ";"]
    assert (found[3].line, found[3].col, found[3].start) == (2, 2, 22)
    assert tokens("") == [] and tokens("/* open") == []


def test_rows_of_a_file():
    g = graph_rows("/c/t9/a.c", "int f(int a, char *b) { int c = a; if (c) g(c, b); return c; }\nstruct S { int q; } ;\nint z = 3, *y;", "t9")
    kinds = [n["type"] for n in g.nodes]
    assert kinds.count("Function") == 1 and kinds.count("Parameter") == 2 and kinds.count("Decl") == 2 and kinds.count("Class") == 1
    assert len({n["id"] for n in g.nodes}) == len(g.nodes)
    ids = {n["id"] for n in g.nodes}
    assert all(e["src"] in ids and e["dst"] in ids for e in g.edges)
    assert graph_rows("/x.c", "").nodes and graph_rows("/x.c", "}}}}((").nodes
    deep = graph_rows("/deep.c", "int f() { x = " + "(" * 30_000 + "1" + ")" * 30_000 + "; }")
    assert len(deep.nodes) >= 1


def test_names_of_source_files():
    assert is_source("/a/b.c") and is_source("x.hpp") and not is_source("/a.c/readme.txt")
