"""Control flow, use and definition, reaching definitions and control dependence of one function."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from weftgraph.parse.syntax import Node

SIMPLE = {"ExpressionStatement", "IdentifierDeclStatement", "Statement", "ClassDefStatement"}


@dataclass
class Graph:
    """A control flow graph: nodes in order, edges as (source, target, label); 0 is the entry, 1 the exit."""

    nodes: list[Node] = field(default_factory=list)
    edges: list[tuple[int, int, str]] = field(default_factory=list)
    params: list[int] = field(default_factory=list)

    def successors(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.nodes]
        for a, b, _ in self.edges:
            out[a].append(b)
        return out


Ends = list[tuple[int, str]]  # open ends: a node and the label its next edge carries


class Builder:
    """Builds the graph in one walk; ``ends`` are the loose ends that the next node is tied to."""

    def __init__(self) -> None:
        self.g = Graph()
        self.labels: dict[str, int] = {}
        self.gotos: list[tuple[int, str]] = []
        self.breaks: list[Ends] = []
        self.continues: list[Ends] = []
        self.cases: list[list[tuple[int, str]]] = []

    def add(self, node: Node, ends: Ends) -> int:
        node.is_cfg = True
        self.g.nodes.append(node)
        k = len(self.g.nodes) - 1
        self.tie(ends, k)
        return k

    def tie(self, ends: Ends, k: int) -> None:
        self.g.edges.extend((a, k, label) for a, label in ends)

    def function(self, params: Iterable[Node], body: Node) -> Graph:
        entry, leave = Node("CFGEntryNode", body.first, body.first, code="ENTRY"), Node("CFGExitNode", body.last, body.last, code="EXIT")
        self.add(entry, [])
        self.add(leave, [])
        ends: Ends = [(0, "")]
        for p in params:
            k = self.add(p, ends)
            self.g.params.append(k)
            ends = [(k, "")]
        ends = self.walk(body, ends)
        self.tie(ends, 1)
        lost = [k for k, name in self.gotos if name not in self.labels]
        for k, name in self.gotos:
            if name in self.labels:
                self.g.edges.append((k, self.labels[name], ""))
        if lost:
            self.tie([(k, "") for k in lost], self._error())
        self.g.edges = list(dict.fromkeys(self.g.edges))
        return self.g

    def _error(self) -> int:
        for k, n in enumerate(self.g.nodes):
            if n.type == "CFGErrorNode":
                return k
        k = self.add(Node("CFGErrorNode", 0, 0, code="ERROR"), [])
        self.g.edges.append((k, 1, ""))
        return k

    def walk(self, n: Node, ends: Ends) -> Ends:
        kind = n.type
        if kind in ("CompoundStatement", "ElseStatement", "TryStatement", "CatchStatement"):
            for c in n.children:
                ends = self.walk(c, ends)
            return ends
        if kind == "IfStatement":
            k = self.add(n.children[0], ends)
            yes = self.walk(n.children[1], [(k, "True")])
            no = self.walk(n.children[2], [(k, "False")]) if len(n.children) > 2 else [(k, "False")]
            return yes + no
        if kind == "WhileStatement":
            k = self.add(n.children[0], ends)
            return self._loop(n.children[1], [(k, "True")], k) + [(k, "False")] + self.breaks.pop()
        if kind == "DoStatement":
            first = len(self.g.nodes)
            body, test = n.children
            self.breaks.append([])
            self.continues.append([])
            hold = len(self.g.edges)
            out = self.walk(body, ends)
            k = self.add(test, out + self.continues.pop())
            start = first if first < k else k
            del hold
            self.g.edges.append((k, start, "True"))
            return [(k, "False")] + self.breaks.pop()
        if kind == "ForStatement":
            return self._for(n, ends)
        if kind == "SwitchStatement":
            k = self.add(n.children[0], ends)
            self.cases.append([])
            self.breaks.append([])
            out = self.walk(n.children[1], [])
            found = self.cases.pop()
            for label, text in found:
                self.g.edges.append((k, label, text))
            if not any(t == "default" for _, t in found):
                out = out + [(k, "default")]
            return out + self.breaks.pop()
        if kind == "Label":
            k = self.add(n, ends)
            name = n.code.rstrip(":").strip()
            if self.cases and (name.startswith("case") or name == "default"):
                self.cases[-1].append((k, name))
            else:
                self.labels[name] = k
            return [(k, "")]
        if kind == "GotoStatement":
            self.gotos.append((self.add(n, ends), n.children[0].code))
            return []
        if kind == "ReturnStatement":
            self.tie([(self.add(n, ends), "")], 1)
            return []
        if kind in ("BreakStatement", "ContinueStatement"):
            k = self.add(n, ends)
            stack = self.breaks if kind == "BreakStatement" else self.continues
            if stack:
                stack[-1].append((k, ""))
            else:
                self.tie([(k, "")], self._error())
            return []
        return [(self.add(n, ends), "")]

    def _loop(self, body: Node, ends: Ends, back: int) -> Ends:
        """A body whose ends go back; leaves its breaks on the stack."""
        self.breaks.append([])
        self.continues.append([])
        self.tie(self.walk(body, ends) + self.continues.pop(), back)
        return []

    def _for(self, n: Node, ends: Ends) -> Ends:
        shape = n.operator or "---"
        heads = dict(zip((k for k, c in enumerate(shape) if c == "x"), n.children[:-1]))
        if 0 in heads:
            ends = [(self.add(heads[0], ends), "")]
        test = self.add(heads[1] if 1 in heads else Node("InfiniteForNode", n.first, n.first + 1, code="true"), ends)
        self.breaks.append([])
        self.continues.append([])
        out = self.walk(n.children[-1], [(test, "True")]) + self.continues.pop()
        if 2 in heads:
            out = [(self.add(heads[2], out), "")]
        self.tie(out, test)
        return [(test, "False")] + self.breaks.pop()


def control_flow(function: Node) -> Graph:
    """The control flow graph of a FunctionDef, its parameters first."""
    params = next(c for c in function.children if c.type == "ParameterList").children
    return Builder().function(params, function.children[-1])


def statement_flow(block: Node) -> Graph:
    """The control flow graph of a block without parameters."""
    return Builder().function([], block)


class UseDef:
    """The symbols a tree uses and defines; ``seen`` holds (node, symbol, is_def). Symbols are strings of blank-separated tokens.

    ``tainted`` maps a callee to the numbers of the arguments that it defines.
    """

    def __init__(self, tainted: dict[str, set[int]] | None = None) -> None:
        self.tainted = tainted or {}
        self.seen: list[tuple[Node, str, bool]] = []

    def _emit(self, n: Node, symbols: list[str], is_def: bool) -> None:
        self.seen.extend((n, s, is_def) for s in symbols)

    def symbols(self, n: Node) -> list[str]:
        """What a tree passes up to the one above it."""
        kind, kids = n.type, n.children
        if kind == "Identifier":
            return [n.code]
        if kind in ("Condition", "ReturnStatement"):
            for c in kids:
                self._emit(n, self.symbols(c), False)
            return []
        if kind == "AssignmentExpr":
            left, right = self.symbols(kids[0]), self.symbols(kids[1])
            self._emit(kids[0], left, True)
            if n.operator != "=":
                self._emit(kids[0], left, False)
            self._emit(kids[1], right, False)
            return []
        if kind == "IncDecOp":
            target = kids[1] if kids[0].type == "IncDec" else kids[0]
            found = self.symbols(target)
            self._emit(target, found, True)
            self._emit(target, found, False)
            return []
        if kind in ("IdentifierDecl", "Parameter"):
            if len(kids) > 1 and kids[1].type == "Identifier":
                self._emit(kids[1], [kids[1].code], True)
            for c in kids[2:]:
                rest = self.symbols(c)
                if c.type != "AssignmentExpr":
                    self._emit(c, rest, False)
            return []
        if kind == "CallExpression":
            names = self.symbols(kids[0])
            marked = self.tainted.get(kids[0].code, set())
            for args in kids[1:]:
                for i, a in enumerate(args.children):
                    if a.type != "Argument":
                        continue
                    found = [s for c in a.children for s in self.symbols(c)]
                    self._emit(a, found, False)
                    if i in marked:
                        out = []
                        for s in found:
                            out += [s[2:]] if s.startswith("& ") else ["* " + s, s]
                        self._emit(a, out, True)
            return names
        if kind == "PtrMemberAccess":
            left = self.symbols(kids[0])
            self._emit(kids[0], left, False)
            return ["* " + s for s in left] + [n.code]
        if kind == "MemberAccess":
            base = self.symbols(kids[0])
            self._emit(kids[0], base, False)
            return [*base, n.code]
        if kind == "ArrayIndexing":
            out = []
            for c in kids:
                found = self.symbols(c)
                self._emit(c, found, False)
                out += ["* " + s for s in found]
            return out
        if kind == "UnaryOp":
            inner = self.symbols(kids[1])
            if n.operator == "&":
                return ["& " + s for s in inner]
            if n.operator == "*":
                self._emit(kids[1], inner, False)
                return ["* " + s for s in inner] + [n.code]
            return inner
        if kind == "Callee":
            return [s for c in kids for s in self.symbols(c)]
        if len(kids) < 2:
            return list(dict.fromkeys(self.symbols(kids[0]))) if kids else []
        out = []
        for c in kids:
            out += self.symbols(c)
        return list(dict.fromkeys(out))

    def statement(self, n: Node) -> list[tuple[Node, str, bool]]:
        """Uses and definitions of one node of the control flow graph, each once; its parts that have them come with their own node."""
        self.seen = []
        if n.type not in ("Label", "GotoStatement"):
            self.symbols(n)
        return list(dict.fromkeys(self.seen))


def use_def(graph: Graph, tainted: dict[str, set[int]] | None = None, seen: list[list[tuple[Node, str, bool]]] | None = None) -> list[dict[str, set[str]]]:
    """Per node the symbols used and defined; the exit uses ``* p`` for each parameter ``p``. ``seen`` is what ``statement`` says of each node, where
    that is known."""
    out = []
    analyser = UseDef(tainted)
    for found in seen if seen is not None else map(analyser.statement, graph.nodes):
        out.append({"use": {s for _, s, d in found if not d}, "def": {s for _, s, d in found if d}})
    for k in graph.params:
        for s in out[k]["def"]:
            out[1]["use"].add("* " + s)
    return out


def reaching(graph: Graph, symbols: list[dict[str, set[str]]]) -> list[tuple[int, int, str]]:
    """(definition, use, symbol) wherever a definition reaches a use; a definition is killed by one of exactly the same symbol."""
    n = len(graph.nodes)
    succ = graph.successors()
    # A definition is a bit; sets of definitions are integers.
    at: list[int] = []
    of: dict[str, int] = {}
    made = [0] * n
    for k in range(n):
        for s in symbols[k]["def"]:
            bit = 1 << len(at)
            at.append(k)
            of[s] = of.get(s, 0) | bit
            made[k] |= bit
    stays = [-1] * n
    for k in range(n):
        for s in symbols[k]["def"]:
            stays[k] &= ~of[s]
    arrives = [0] * n
    todo, waits = list(range(n))[::-1], [True] * n
    while todo:
        k = todo.pop()
        waits[k] = False
        leaves = arrives[k] & stays[k] | made[k]
        for m in succ[k]:
            if leaves & ~arrives[m]:
                arrives[m] |= leaves
                if not waits[m]:
                    waits[m] = True
                    todo.append(m)
    out = []
    for k in range(n):
        for s in symbols[k]["use"]:
            rest = arrives[k] & of.get(s, 0)
            while rest:
                low = rest & -rest
                out.append((at[low.bit_length() - 1], k, s))
                rest ^= low
    return sorted(out)


def post_dominators(graph: Graph) -> list[int]:
    """The immediate post-dominator of each node; the exit has itself, a node that can't reach the exit -1."""
    n = len(graph.nodes)
    back: list[list[int]] = [[] for _ in range(n)]  # from a node to those before it: the reversed graph's successors
    for a, b, _ in graph.edges:
        back[b].append(a)
    order, seen, stack = [], {1}, [(1, iter(back[1]))]
    while stack:
        x, rest = stack[-1]
        y = next((y for y in rest if y not in seen), None)
        if y is None:
            order.append(x)
            stack.pop()
        else:
            seen.add(y)
            stack.append((y, iter(back[y])))
    rank = {x: i for i, x in enumerate(order)}
    succ = graph.successors()
    above = [-1] * n
    above[1] = 1
    changed = True
    while changed:
        changed = False
        for x in reversed(order[:-1]):
            best = -1
            for y in succ[x]:
                if y not in rank or above[y] < 0:
                    continue
                if best < 0:
                    best = y
                    continue
                p, q = best, y
                while p != q:
                    if rank[p] < rank[q]:
                        p = above[p]
                    else:
                        q = above[q]
                best = p
            if best != above[x]:
                above[x], changed = best, True
    return above


def control_dependence(graph: Graph, above: list[int]) -> list[tuple[int, int]]:
    """(controlling, controlled): the dominance frontier in the reversed graph, with an edge from entry to exit; self edges are dropped."""
    out = set()
    succ = graph.successors()
    succ[0] = [*succ[0], 1]
    for a, targets in enumerate(succ):
        if len(set(targets)) < 2:
            continue
        stop = above[a] if a else 1
        for b in targets:
            x, steps = b, 0
            while x >= 0 and x != stop and steps <= len(succ):
                if x != a:
                    out.add((a, x))
                if above[x] == x:
                    break
                x, steps = above[x], steps + 1
    return sorted(out)
