"""A forgiving recursive-descent parser: functions, statements and expressions as typed trees; what fits nothing is a plain ``Statement``."""

from __future__ import annotations

from dataclasses import dataclass, field

from weftgraph.parse.lexer import Token, tokens, without_else_arms

# Words of the language by their role here.
MODIFIERS = {"inline", "virtual", "explicit", "friend", "static"}
TYPE_WORDS = {"const", "volatile", "unsigned", "signed", "long", "short", "int", "char", "float", "double", "void", "bool", "register", "extern", "auto", "mutable", "wchar_t", "typename"}
TAGS = {"struct", "union", "enum", "class"}
RESERVED = {"if", "else", "for", "while", "do", "switch", "case", "return", "break", "continue", "goto", "sizeof", "new", "delete", "try", "catch", "throw"} | MODIFIERS
ASSIGNMENTS = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
#: Binary operators from the loosest to the tightest, with the type of their node. Chains lean to the right.
LEVELS = [
    ("OrExpression", {"||"}), ("AndExpression", {"&&"}), ("InclusiveOrExpression", {"|"}), ("ExclusiveOrExpression", {"^"}), ("BitAndExpression", {"&"}),
    ("EqualityExpression", {"==", "!="}), ("RelationalExpression", {"<", ">", "<=", ">="}), ("ShiftExpression", {"<<", ">>"}), ("AdditiveExpression", {"+", "-"}),
    ("MultiplicativeExpression", {"*", "/", "%"}),
]
#: The level of each operator.
LEVEL = {op: (level, kind) for level, (kind, ops) in enumerate(LEVELS) for op in ops}
CLOSING = {"(": ")", "[": "]", "{": "}"}


class Unparsable(Exception):
    """What is read here isn't what was expected."""


@dataclass(eq=False, slots=True)
class Node:
    type: str
    first: int  # index of the first token, and of the one behind the last
    last: int
    children: list[Node] = field(default_factory=list)
    operator: str | None = None
    code: str = ""
    is_cfg: bool = False

    def walk(self):
        """The node and those below it in order of the text."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))


class Parser:
    """Reads one list of tokens; positions are indices into it."""

    def __init__(self, toks: list[Token]) -> None:
        self.toks = toks
        self.texts = [t.text for t in toks]
        self.kinds = [t.kind for t in toks]
        self.at = 0
        self.end = len(toks)
        self.closed: dict[int, int] | None = None

    # ---- tokens

    def peek(self, k: int = 0) -> str:
        i = self.at + k
        return self.texts[i] if i < self.end else ""

    def kind(self, k: int = 0) -> str:
        i = self.at + k
        return self.kinds[i] if i < self.end else ""

    def take(self, text: str | None = None) -> Token:
        if self.at >= self.end or text is not None and self.texts[self.at] != text:
            raise Unparsable(f"{text} expected")
        self.at += 1
        return self.toks[self.at - 1]

    def name(self, k: int = 0) -> bool:
        return self.kind(k) == "word" and self.peek(k) not in RESERVED

    def node(self, kind: str, first: int, *children: Node, operator: str | None = None) -> Node:
        return Node(kind, first, self.at, list(children), operator)

    def closing(self, at: int) -> int:
        """The index behind the bracket that closes the one at ``at``."""
        if self.closed is None:
            self.closed = self._brackets()
        found = self.closed.get(at, self.end)
        if found >= self.end:
            raise Unparsable("unbalanced")
        return found + 1

    def _brackets(self) -> dict[int, int]:
        """Where each bracket is closed; each kind is counted on its own."""
        found: dict[int, int] = {}
        for opened, closed in CLOSING.items():
            stack = []
            for i, x in enumerate(self.texts):
                if x == opened:
                    stack.append(i)
                elif x == closed and stack:
                    found[stack.pop()] = i
        return found

    # ---- expressions

    def expression(self) -> Node:
        first = self.at
        left = self.assignment()
        if self.peek() == ",":
            self.take()
            return self.node("Expression", first, left, self.expression(), operator=",")
        return left

    def assignment(self) -> Node:
        first = self.at
        left = self.conditional()
        if self.peek() in ASSIGNMENTS:
            op = self.take().text
            return self.node("AssignmentExpr", first, left, self.assignment(), operator=op)
        return left

    def conditional(self) -> Node:
        first = self.at
        test = self.binary(0)
        if self.peek() != "?":
            return test
        condition = self.node("Condition", first, test)
        self.take("?")
        yes = self.expression() if self.peek() != ":" else self.node("Expression", self.at)
        self.take(":")
        return self.node("ConditionalExpression", first, condition, yes, self.assignment(), operator="?")

    def binary(self, level: int) -> Node:
        first = self.at
        left = self.cast()
        while True:
            op = self.peek()
            own, kind = LEVEL.get(op, (-1, ""))
            if own < level or self.kind() != "op":
                return left
            self.at += 1
            left = self.node(kind, first, left, self.binary(own), operator=op)

    def cast(self) -> Node:
        if self.peek() == "(":
            begin = self.at
            try:
                close = self.closing(self.at)
                target = self._type_between(begin + 1, close - 1)
                self.at = close
                if target and (self.kind() in ("word", "number", "text") and self.peek() not in RESERVED - {"sizeof", "new"} or self.peek() in ("(", "&", "*", "~", "!", "-")):
                    sure = self._is_plain_type(begin + 1, close - 1) or self.kind() in ("word", "number", "text")
                    if sure:
                        return self.node("CastExpression", begin, target, self.cast())
            except Unparsable:
                pass
            self.at = begin
        return self.unary()

    def _is_plain_type(self, low: int, high: int) -> bool:
        texts = [self.toks[i].text for i in range(low, high)]
        return texts[0] in TYPE_WORDS | TAGS or texts[-1] == "*"

    def _type_between(self, low: int, high: int) -> Node | None:
        if low >= high:
            return None
        texts = [self.toks[i] for i in range(low, high)]
        if texts[0].kind != "word" or any(t.kind != "word" and t.text not in ("*", "&", "::", "[", "]") for t in texts) or texts[0].text in RESERVED:
            return None
        words = [t.text for t in texts if t.kind == "word"]
        if len(words) > 1 and not set(words[:-1]) & (TYPE_WORDS | TAGS) and "::" not in [t.text for t in texts]:
            return None
        return Node("CastTarget", low, high)

    def unary(self) -> Node:
        first, t = self.at, self.peek()
        if t in ("++", "--"):
            self.take()
            sign = self.node("IncDec", first)
            return self.node("IncDecOp", first, sign, self.cast(), operator=t)
        if self.kind() == "op" and t in ("&", "*", "+", "-", "~", "!", "&&"):
            self.take()
            sign = self.node("UnaryOperator", first)
            return self.node("UnaryOp", first, sign, self.cast(), operator=t)
        if t == "sizeof":
            self.take()
            word = self.node("Sizeof", first)
            begin = self.at
            if self.peek() == "(":
                self.at = self.closing(self.at)
                return self.node("SizeofExpr", first, word, self.node("SizeofOperand", begin))
            operand = self.unary()
            return self.node("SizeofExpr", first, word, Node("SizeofOperand", begin, self.at, [operand]))
        if t == "new" and self.kind(1) == "word":
            self.take()
            begin = self.at
            kind = self._type_name()
            target = self.node("CastTarget", begin)
            del kind
            rest = [self._arguments()] if self.peek() == "(" else []
            while self.peek() == "[":
                self.take()
                rest.append(self.expression())
                self.take("]")
            return self.node("CallExpression", first, Node("Callee", begin, target.last), *rest, operator="new")
        return self.postfix()

    def postfix(self) -> Node:
        first = self.at
        left = self.primary()
        while True:
            t = self.peek()
            if t == "(":
                callee = Node("Callee", first, self.at, [left])
                left = self.node("CallExpression", first, callee, self._arguments())
                left.last = self.at
            elif t == "[":
                self.take()
                index = self.expression()
                self.take("]")
                left = self.node("ArrayIndexing", first, left, index)
            elif t in (".", "->") and self.kind(1) == "word":
                self.take()
                begin = self.at
                self.take()
                left = self.node("MemberAccess" if t == "." else "PtrMemberAccess", first, left, self.node("Identifier", begin), operator=t)
            elif t in ("++", "--"):
                begin = self.at
                self.take()
                left = self.node("IncDecOp", first, left, self.node("IncDec", begin), operator=t)
            else:
                return left

    def _arguments(self) -> Node:
        begin = self.at
        self.take("(")
        inside = self.at
        items = []
        while self.peek() != ")":
            start = self.at
            value = self.assignment()
            items.append(self.node("Argument", start, value))
            if self.peek() == ",":
                self.take()
            elif self.peek() != ")":
                raise Unparsable("argument")
        found = Node("ArgumentList", inside, self.at, items)
        self.take(")")
        del begin
        return found

    def primary(self) -> Node:
        first, t = self.at, self.peek()
        if t == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            inner.first, inner.last = first, self.at
            return inner
        if t == "{":
            return self._initializers()
        if self.kind() in ("number", "text"):
            kind = self.kind()
            self.take()
            while kind == "text" and self.kind() == "text":
                self.take()
            return self.node("PrimaryExpression", first)
        if t == "::" and self.name(1):
            self.take()
        if self.name():
            self.take()
            while self.peek() == "::" and self.kind(1) == "word":
                self.at += 2
            return self.node("Identifier", first)
        raise Unparsable("expression")

    def _initializers(self) -> Node:
        first = self.at
        self.take("{")
        items = []
        while self.peek() != "}":
            if self.peek() == "." and self.kind(1) == "word":
                self.at += 2
                if self.peek() == "=":
                    self.take()
            items.append(self.assignment())
            if self.peek() == ",":
                self.take()
            elif self.peek() != "}":
                raise Unparsable("initializer")
        self.take("}")
        return self.node("InitializerList", first, *items)

    # ---- declarations

    def _type_name(self) -> None:
        """Move behind the name of a type, without stars."""
        seen = False
        while True:
            t = self.peek()
            if t in TAGS and self.kind(1) == "word":
                self.at += 2
                seen = True
            elif t in TYPE_WORDS:
                self.take()
                seen = seen or t not in ("const", "volatile", "register", "extern", "mutable", "typename")
            elif not seen and self.name():
                self.take()
                while self.peek() == "::" and self.kind(1) == "word":
                    self.at += 2
                if self.peek() == "<":
                    depth, i = 0, self.at
                    while i < self.end and self.toks[i].text not in (";", "{", "(", "&&", "||"):
                        depth += {"<": 1, ">": -1, ">>": -2}.get(self.toks[i].text, 0)
                        i += 1
                        if depth <= 0:
                            break
                    if depth <= 0:
                        self.at = i
                seen = True
            else:
                break
        if not seen:
            raise Unparsable("type")

    def declaration(self) -> Node:
        """``type name [= e], ...;`` as an IdentifierDeclStatement."""
        first = self.at
        decls = self._declarators()
        self.take(";")
        return self.node("IdentifierDeclStatement", first, *decls)

    def _declarators(self) -> list[Node]:
        first = self.at
        self._type_name()
        base = (first, self.at)
        decls = []
        while True:
            begin = self.at
            stars = []
            while self.peek() in ("*", "&", "const", "&&"):
                stars.append(self.at)
                self.take()
            if not self.name():
                raise Unparsable("declarator")
            at = self.at
            self.take()
            while self.peek() == "::" and self.kind(1) == "word":
                self.at += 2
            ident = Node("Identifier", at, self.at)
            extents = []
            while self.peek() == "[":
                extents.append(self.at)
                self.at = self.closing(self.at)
            kids = [Node("IdentifierDeclType", base[0], base[1]), ident]
            kids[0].operator = " ".join(self.toks[i].text for i in stars) + ("[ ]" * bool(extents))
            if extents and self.toks[extents[0] + 1].text != "]":
                resume, stop = self.at, self.end
                self.at, self.end = extents[0] + 1, self.closing(extents[0]) - 1
                try:
                    kids.append(self.expression())
                except Unparsable:
                    pass
                self.at, self.end = resume, stop
            if self.peek() == "=":
                self.take()
                value = self.assignment()
                kids.append(Node("AssignmentExpr", at, self.at, [ident, value], "="))
            elif self.peek() == "(":
                kids.append(self._arguments())
                self.take(")") if self.peek() == ")" and self.toks[self.at - 1].text != ")" else None
            elif self.peek() == ":" and self.kind(1) == "number":
                self.at += 2
            decls.append(Node("IdentifierDecl", begin if decls else at, self.at, kids))
            if self.at >= self.end or self.peek() != ",":
                return decls
            self.take()

    # ---- statements

    def block(self) -> Node:
        first = self.at
        self.take("{")
        body = []
        while self.at < self.end and self.peek() != "}":
            body.append(self.statement())
        if self.at < self.end:
            self.take("}")
        return self.node("CompoundStatement", first, *body)

    def _condition(self, kind: str = "Condition") -> Node:
        self.take("(")
        begin = self.at
        resume = self.at
        close = self.closing(self.at - 1) - 1
        try:
            inner = [self.expression()]
            if self.at != close:
                raise Unparsable("condition")
        except Unparsable:
            inner = []
            try:
                self.at = resume
                inner = [self._within(begin, close, lambda: self._bare_declaration())]
            except Unparsable:
                inner = []
        self.at = close
        found = Node(kind, begin, close, inner)
        self.take(")")
        return found

    def _within(self, low: int, high: int, what):
        stop, self.at, self.end = self.end, low, high
        try:
            return what()
        finally:
            self.end = stop

    def _bare_declaration(self) -> Node:
        """A declaration without its semicolon, as in the head of a loop, up to where the head ends."""
        first = self.at
        decls = self._declarators()
        if self.at != self.end:
            raise Unparsable("declaration")
        return self.node("IdentifierDeclStatement", first, *decls)

    def statement(self) -> Node:
        first, t = self.at, self.peek()
        try:
            found = self._statement(t)
            if self.at > first:
                return found
        except Unparsable:
            pass
        except RecursionError:
            return self._too_deep(first)
        self.at = first
        return self._water()

    def _water(self) -> Node:
        """One token that fits nothing."""
        first = self.at
        self.take()
        return self.node("Statement", first)

    def _too_deep(self, first: int) -> Node:
        """A statement nested too deep to be read, up to its semicolon, as one."""
        self.at = first + 1
        while self.at < self.end and self.toks[self.at - 1].text != ";":
            self.at += 1
        return self.node("Statement", first)

    def _statement(self, t: str) -> Node:
        first = self.at
        if t == "{":
            return self.block()
        if t == ";":
            self.take()
            return self.node("ExpressionStatement", first)
        if t == "if":
            self.take()
            kids = [self._condition(), self.statement()]
            if self.peek() == "else":
                begin = self.at
                self.take()
                kids.append(Node("ElseStatement", begin, begin, [self.statement()]))
                kids[-1].last = self.at
            return self.node("IfStatement", first, *kids)
        if t in ("while", "switch"):
            self.take()
            condition = self._condition()
            return self.node("WhileStatement" if t == "while" else "SwitchStatement", first, condition, self.statement())
        if t == "do":
            self.take()
            body = self.statement()
            self.take("while")
            condition = self._condition()
            self.take(";")
            return self.node("DoStatement", first, body, condition)
        if t == "for":
            return self._for()
        if t in ("case", "default") or self.name() and self.peek(1) == ":" and self.peek(2) != ":":
            return self._label()
        if t in ("break", "continue") and self.peek(1) == ";":
            self.at += 2
            return self.node("BreakStatement" if t == "break" else "ContinueStatement", first)
        if t == "goto" and self.kind(1) == "word" and self.peek(2) == ";":
            self.take()
            begin = self.at
            self.take()
            target = self.node("Identifier", begin)
            self.take(";")
            return self.node("GotoStatement", first, target)
        if t == "return":
            self.take()
            kids = [] if self.peek() == ";" else [self.expression()]
            self.take(";")
            return self.node("ReturnStatement", first, *kids)
        if t == "try" and self.peek(1) == "{":
            self.take()
            return self.node("TryStatement", first, self.block())
        if t == "catch" and self.peek(1) == "(":
            self.take()
            self.at = self.closing(self.at)
            return self.node("CatchStatement", first, self.block())
        if t in TAGS and (self.peek(1) == "{" or self.peek(2) in ("{", ":")):
            return self._class()
        if t in RESERVED - {"sizeof", "new", "throw"}:
            raise Unparsable(t)
        try:
            return self.declaration()
        except Unparsable:
            self.at = first
        value = self.expression()
        self.take(";")
        return self.node("ExpressionStatement", first, value)

    def _class(self) -> Node:
        first = self.at
        self.take()
        kids = []
        if self.kind() == "word":
            begin = self.at
            self.take()
            kids.append(self.node("Identifier", begin))
        while self.peek() not in ("{", ""):
            self.take()
        self.at = self.closing(self.at)
        while self.peek() not in (";", ""):
            self.take()
        self.take(";")
        return self.node("ClassDefStatement", first, *kids)

    def _label(self) -> Node:
        first = self.at
        if self.peek() == "case":
            self.take()
            depth = 0
            while self.at < self.end and (self.peek() != ":" or depth):
                depth += (self.peek() == "?") - (self.peek() == ":")
                if self.peek() in (";", "{", "}"):
                    raise Unparsable("label")
                self.take()
        else:
            self.take()
        self.take(":")
        return self.node("Label", first)

    def _for(self) -> Node:
        first = self.at
        self.take()
        open_ = self.at
        close = self.closing(open_) - 1
        stops = [open_]
        depth = 0
        for i in range(open_ + 1, close):
            x = self.toks[i].text
            depth += (x in "([{") - (x in ")]}")
            if x == ";" and depth == 0:
                stops.append(i)
        if len(stops) != 3:
            raise Unparsable("for")
        cuts = [(stops[0] + 1, stops[1]), (stops[1] + 1, stops[2]), (stops[2] + 1, close)]
        kids: list[Node] = []
        for kind, (low, high) in zip(("ForInit", "Condition", "Expression"), cuts):
            if low == high:
                continue

            def inside() -> Node:
                begin = self.at
                try:
                    if kind == "ForInit":
                        return self._bare_declaration()
                except Unparsable:
                    self.at = begin
                self.at = begin
                found = self.expression()
                if self.at != high:
                    raise Unparsable("head of a loop")
                return found

            try:
                inner = [self._within(low, high, inside)]
            except Unparsable:
                inner = []
            if kind == "Expression" and inner:
                inner[0].first, inner[0].last = low, high
                inner[0].operator = inner[0].operator or ""
                kids.append(inner[0])
                inner[0].is_cfg = True
            else:
                kids.append(Node(kind, low, high, inner))
        self.at = close + 1
        head = len(kids)
        body = self.statement()
        found = self.node("ForStatement", first, *kids, body)
        found.operator = "".join("x" if low != high else "-" for low, high in cuts)
        del head
        return found

    # ---- modules

    def module(self) -> list[Node]:
        """Functions, classes and declarations of a file in order; other tokens are passed over."""
        items = []
        while self.at < self.end:
            first = self.at
            for what in (self.function, self._class, self._outer_declaration):
                self.at = first
                try:
                    if what == self._class and self.peek() not in TAGS:
                        continue
                    items.append(what())
                    break
                except (Unparsable, IndexError):
                    continue
                except RecursionError:
                    self._too_deep(first)
                    break
            else:
                self.at = first + 1
        return items

    def _outer_declaration(self) -> Node:
        while self.peek() in MODIFIERS:
            self.take()
        return self.declaration()

    def function(self) -> Node:
        """``[type] name ( parameters ) ... { body }``."""
        first = self.at
        if self.peek() == "template" and self.peek(1) == "<":
            depth = 0
            self.take()
            while True:
                depth += {"<": 1, ">": -1, ">>": -2}.get(self.peek(), 0)
                self.take()
                if depth <= 0:
                    break
        begin = self.at
        i = self.at
        while i < self.end and self.toks[i].text != "(":
            t = self.toks[i]
            if t.kind not in ("word", "op") or t.text in (";", "{", "}", "=", ")", ",") or t.text in RESERVED - MODIFIERS:
                raise Unparsable("function")
            i += 1
        if i == begin or i >= self.end or self.toks[i - 1].kind != "word":
            raise Unparsable("function")
        name_at = i - 1
        while name_at - 2 >= begin and self.toks[name_at - 1].text == "::":
            name_at -= 2
        name = Node("Identifier", name_at, i)
        kids: list[Node] = []
        if name_at > begin:
            kids.append(Node("ReturnType", begin, name_at))
        close = self.closing(i)
        params = self._parameters(i + 1, close - 1)
        self.at = close
        while self.peek() in ("const", "throw", "override", "noexcept", "final"):
            self.take()
            if self.peek() == "(":
                self.at = self.closing(self.at)
        if self.peek() == ":":
            while self.peek() not in ("{", ";", ""):
                self.take()
        if self.peek() != "{":
            raise Unparsable("function")
        body_end = self.closing(self.at)
        body = self._within(self.at, body_end, self.block)
        self.at = body_end
        return self.node("FunctionDef", first, *kids, name, params, body)

    def _parameters(self, low: int, high: int) -> Node:
        found = Node("ParameterList", low, high)
        cuts, depth, begin = [], 0, low
        for i in range(low, high):
            x = self.toks[i].text
            depth += (x in ("(", "[", "{", "<")) - (x in (")", "]", "}", ">"))
            if x == "," and depth <= 0:
                cuts.append((begin, i))
                begin = i + 1
        if begin < high:
            cuts.append((begin, high))
        for a, b in cuts:
            words = [i for i in range(a, b) if self.toks[i].kind == "word"]
            texts = [self.toks[i].text for i in range(a, b)]
            if texts == ["void"] or texts == ["..."]:
                continue
            stop = next((i for i in range(a, b) if self.toks[i].text in ("[", "=")), b)
            words = [i for i in words if i < stop]
            if not words:
                continue
            named = words[-1] if len(words) > 1 and self.toks[words[-1]].text not in TYPE_WORDS and self.toks[words[-1] - 1].text not in TAGS else None
            kids = [Node("ParameterType", a, named if named is not None else b)]
            if named is not None:
                kids.append(Node("Identifier", named, named + 1))
            found.children.append(Node("Parameter", a, b, kids))
        return found


def parse(text: str) -> tuple[list[Token], list[Node]]:
    """The tokens of a file without else arms, and its items, each node with its code: its tokens joined by single blanks."""
    toks = without_else_arms(tokens(text))
    items = Parser(toks).module()
    texts = [t.text for t in toks]
    for item in items:
        finish(texts, item)
    return toks, items


def parse_statements(text: str) -> tuple[list[Token], Node]:
    """The statements of a snippet as one block."""
    toks = without_else_arms(tokens("{" + text + "}"))
    block = Parser(toks).block()
    finish([t.text for t in toks], block)
    return toks, block


def finish(texts: list[str], root: Node) -> None:
    for n in root.walk():
        n.code = " ".join(texts[n.first : n.last]).replace("\n", "\\n").replace("\t", "\\t")
