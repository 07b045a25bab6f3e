"""Lexer and recursive-descent parser. Trees are tuples: the kind, then its parts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class QueryError(ValueError):
    """A statement that can't be read or bound."""


_LEX = re.compile(
    r"(?P<space>\s+|//[^\n]*)|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d+(?!\w))"
    r"|(?P<id>[^\W\d]\w*)|`(?P<tick>(?:[^`]|``)*)`|\$(?P<param>\w+)"
    r"|(?P<op><=|>=|<>|=~|\.\.|<<|>>|\|\||[-+*/%^=<>()\[\]{},.:;|&~])"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f"}


@dataclass
class Token:
    kind: str
    value: object
    at: int
    end: int


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        if text.startswith("/*", at):
            depth, start = 1, at
            at += 2
            while depth:
                m = re.compile(r"/\*|\*/").search(text, at)
                if not m:
                    raise QueryError(f"comment at {start} doesn't end")
                depth += 1 if m[0] == "/*" else -1
                at = m.end()
            continue
        if text[at] in "'\"":
            quote, start, said = text[at], at, []
            at += 1
            while True:
                if at >= len(text):
                    raise QueryError(f"string at {start} doesn't end")
                c = text[at]
                if c == "\\" and at + 1 < len(text):
                    said.append(_ESCAPES.get(text[at + 1], text[at + 1]))
                    at += 2
                elif c == quote and text[at + 1 : at + 2] == quote:
                    said.append(quote)
                    at += 2
                elif c == quote:
                    at += 1
                    break
                else:
                    said.append(c)
                    at += 1
            out.append(Token("str", "".join(said), start, at))
            continue
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        kind = m.lastgroup
        if kind == "num":
            value = m["num"]
            # 1..3 is a range
            out.append(Token("num", float(value) if re.search(r"[.eE]", value) else int(value), m.start(), m.end()))
        elif kind != "space":
            out.append(Token("id" if kind == "tick" else kind, m[kind].replace("``", "`") if kind == "tick" else m[kind], m.start(), m.end()))
            if kind == "tick":
                out[-1].kind = "tick"
        at = m.end()
    out.append(Token("end", None, at, at))
    return out


@dataclass
class NodePattern:
    var: str | None
    labels: list[str]
    props: list[tuple[str, tuple]]


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    props: list[tuple[str, tuple]]
    direction: str  # "->", "<-" or "--"
    hops: tuple[int, int | None] | None = None


@dataclass
class Path:
    nodes: list[NodePattern]
    rels: list[RelPattern]
    var: str | None = None
    shortest: bool = False


@dataclass
class Body:
    """Projection of RETURN or WITH."""

    items: list[tuple[tuple, str | None]]
    star: bool = False
    distinct: bool = False
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    skip: tuple | None = None
    limit: tuple | None = None
    where: tuple | None = None


_CLAUSE_WORDS = frozenset("match optional where return with order skip limit union unwind create set delete detach merge on call explain as asc desc ascending descending and or xor not in starts ends contains is null case when then else end distinct all yield".split())


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, lex(text), 0

    # -- tokens ------------------------------------------------------------
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def word(self, *words: str, at: int = 0) -> bool:
        t = self.peek(at) if at else self.now
        return t.kind == "id" and t.value.lower() in words

    def take_word(self, *words: str) -> str | None:
        if self.word(*words):
            self.i += 1
            return self.tokens[self.i - 1].value.lower()
        return None

    def op(self, *ops: str, at: int = 0) -> bool:
        t = self.peek(at) if at else self.now
        return t.kind == "op" and t.value in ops

    def take(self, *ops: str) -> str | None:
        if self.op(*ops):
            self.i += 1
            return self.tokens[self.i - 1].value
        return None

    def need(self, what: str) -> None:
        if not (self.take(what) if not what.isalpha() else self.take_word(what)):
            raise QueryError(f"expected {what!r} at {self.now.at}, found {self.text[self.now.at : self.now.end] or 'the end'!r}")

    def name(self) -> str:
        t = self.now
        if t.kind in ("id", "tick"):
            self.i += 1
            return t.value
        raise QueryError(f"expected a name at {t.at}, found {self.text[t.at : t.end] or 'the end'!r}")

    # -- statements ----------------------------------------------------------
    def statement(self) -> tuple:
        out = self._statement()
        self.take(";")
        if self.now.kind != "end":
            raise QueryError(f"unexpected {self.text[self.now.at : self.now.end]!r} at {self.now.at}")
        return out

    def _statement(self) -> tuple:
        if how := self.take_word("explain", "profile"):
            return (how, self._statement())
        if self.word("create") and self.word("node", at=1) and self.word("table", at=2):
            self.i += 3
            return self._create_node_table()
        if self.word("create") and self.word("rel", at=1) and self.word("table", at=2):
            self.i += 3
            return self._create_rel_table()
        if self.word("create") and self.word("macro", at=1):
            self.i += 2
            name = self.name()
            self.need("(")
            args = self._list(self.name, ")")
            self.need("as")
            return ("macro", name, args, self.expr())
        if self.word("drop") and self.word("table", at=1):
            self.i += 2
            return ("drop", self._exists(), self.name())
        if self.word("alter"):
            return self._alter()
        if self.take_word("copy"):
            if self.op("("):
                self.i += 1
                query = self._query()
                self.need(")")
                self.need("to")
                return ("copy_to", query, self.now.value, self._path_options())
            name = self.name()
            if self.take_word("to"):
                return ("copy_to", name, self.now.value, self._path_options())
            self.need("from")
            return ("copy", name, self.expr(), self._options())
        if self.word("load") and self.word("from", at=1):
            self.i += 2
            return ("load", self.expr())
        if self.word("call"):
            begin, out = self.i, self._call()
            if self.now.kind == "end" or self.op(";"):
                return out
            self.i = begin  # clauses follow, so it is the first of a query
        if self.take_word("checkpoint"):
            return ("checkpoint",)
        if self.word("export", "import") and self.word("database", at=1):
            how = self.now.value.lower()
            self.i += 2
            if self.now.kind != "str":
                raise QueryError(f"{how.upper()} DATABASE needs a path")
            self.i += 1
            return (how, self.tokens[self.i - 1].value)
        if self.take_word("begin"):
            self.take_word("transaction")
            if self.take_word("read"):
                self.take_word("only", "write")
            return ("begin",)
        if how := self.take_word("commit", "rollback"):
            self.take_word("transaction")
            return (how,)
        return self._query()

    def _list(self, item, close: str) -> list:
        out = []
        if not self.take(close):
            out.append(item())
            while self.take(","):
                out.append(item())
            self.need(close)
        return out

    def _exists(self, negated: bool = False) -> bool:
        if self.take_word("if"):
            if negated:
                self.need("not")
            self.need("exists")
            return True
        return False

    def _type(self) -> str:
        start = self.now.at
        self.name()
        while True:
            if self.op("(", "["):
                depth = 0
                while True:
                    depth += self.op("(", "[") - self.op(")", "]")
                    self.i += 1
                    if not depth or self.now.kind == "end":
                        break
            else:
                return self.text[start : self.tokens[self.i - 1].end]

    def _create_node_table(self) -> tuple:
        quiet, name, cols, key = self._exists(True), self.name(), [], None
        self.need("(")
        while True:
            if self.word("primary") and self.word("key", at=1):
                self.i += 2
                self.need("(")
                key = self.name()
                self.need(")")
            else:
                col, kind = self.name(), self._type()
                default = self.expr() if self.take_word("default") else None
                if self.word("primary") and self.word("key", at=1):
                    self.i += 2
                    key = col
                cols.append((col, kind, default))
            if not self.take(","):
                break
        self.need(")")
        if key is None:
            raise QueryError(f"node table {name} has no primary key")
        return ("node_table", quiet, name, cols, key)

    def _create_rel_table(self) -> tuple:
        quiet, name, cols = self._exists(True), self.name(), []
        self.need("(")
        self.need("from")
        a = self.name()
        self.need("to")
        b = self.name()
        while self.take(","):
            cols.append((self.name(), self._type(), self.expr() if self.take_word("default") else None))
        self.need(")")
        return ("rel_table", quiet, name, a, b, cols)

    def _alter(self) -> tuple:
        self.need("alter")
        self.need("table")
        name = self.name()
        if self.take_word("add"):
            self.take_word("column")
            return ("alter", name, "add", self.name(), self._type(), self.expr() if self.take_word("default") else None)
        if self.take_word("drop"):
            self.take_word("column")
            return ("alter", name, "drop", self.name())
        if self.take_word("comment"):
            self.take_word("on")
            self.i += 1
            return ("alter", name, "comment", self.tokens[self.i - 1].value)
        self.need("rename")
        if self.take_word("to"):
            return ("alter", name, "rename_table", self.name())
        self.take_word("column")
        old = self.name()
        self.need("to")
        return ("alter", name, "rename", old, self.name())

    def _options(self) -> dict:
        def one():
            key = self.name()
            self.need("=")
            return key.lower(), self.expr()

        return dict(self._list(one, ")")) if self.take("(") else {}

    def _path_options(self) -> dict:
        if self.now.kind != "str":
            raise QueryError(f"expected a path at {self.now.at}")
        self.i += 1
        return self._options()

    def _call(self) -> tuple:
        self.need("call")
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        args = self._list(self._call_arg, ")") if self.take("(") else []
        yields = []
        if self.take_word("yield"):
            yields.append(self._yield())
            while self.take(","):
                yields.append(self._yield())
        return ("call", name, [a for a in args if a[0] != "named"], {a[1]: a[2] for a in args if a[0] == "named"}, yields)

    def _yield(self) -> tuple[str, str]:
        col = self.name()
        return col, self.name() if self.take_word("as") else col

    def _call_arg(self) -> tuple:
        if self.now.kind == "id" and self.op("=", at=1):
            key = self.name()
            self.i += 1
            return ("named", key, self.expr())
        return self.expr()

    def _query(self) -> tuple:
        parts = [("single", self._clauses())]
        while self.take_word("union"):
            every = bool(self.take_word("all"))
            parts.append(("union_all" if every else "union", self._clauses()))
        return ("query", parts)

    def _clauses(self) -> list[tuple]:
        out = []
        while True:
            if self.word("optional") and self.word("match", at=1):
                self.i += 2
                out.append(("match", True, self._paths(), self._where()))
            elif self.take_word("match"):
                out.append(("match", False, self._paths(), self._where()))
            elif self.take_word("unwind"):
                e = self.expr()
                self.need("as")
                out.append(("unwind", e, self.name()))
            elif self.take_word("with"):
                body = self._body()
                body.where = self._where()
                out.append(("with", body))
            elif self.take_word("return"):
                out.append(("return", self._body()))
            elif self.take_word("create"):
                out.append(("create", self._paths()))
            elif self.take_word("merge"):
                path, on = self._path(), {"match": [], "create": []}
                while self.take_word("on"):
                    which = self.take_word("match", "create")
                    if not which:
                        raise QueryError("expected MATCH or CREATE after ON")
                    self.need("set")
                    on[which] += self._sets()
                out.append(("merge", path, on))
            elif self.take_word("set"):
                out.append(("set", self._sets()))
            elif self.word("detach", "delete"):
                detach = bool(self.take_word("detach"))
                self.need("delete")
                names = [self.name()]
                while self.take(","):
                    names.append(self.name())
                out.append(("delete", detach, names))
            elif self.word("call"):
                out.append(self._call())
            else:
                break
        if not out:
            raise QueryError(f"expected a clause at {self.now.at}, found {self.text[self.now.at : self.now.end] or 'the end'!r}")
        return out

    def _sets(self) -> list[tuple[str, str, tuple]]:
        out = []
        while True:
            var = self.name()
            self.need(".")
            prop = self.name()
            self.need("=")
            out.append((var, prop, self.expr()))
            if not self.take(","):
                return out

    def _where(self) -> tuple | None:
        return self.expr() if self.take_word("where") else None

    def _body(self) -> Body:
        body = Body([], distinct=bool(self.take_word("distinct")))
        if self.take("*"):
            body.star = True
            if self.take(","):
                body.items.append(self._item())
        else:
            body.items.append(self._item())
        while self.take(","):
            body.items.append(self._item())
        if self.take_word("order"):
            self.need("by")
            while True:
                e = self.expr()
                down = self.take_word("asc", "ascending", "desc", "descending") or "asc"
                body.order.append((e, down.startswith("asc")))
                if not self.take(","):
                    break
        if self.take_word("skip"):
            body.skip = self.expr()
        if self.take_word("limit"):
            body.limit = self.expr()
        return body

    def _item(self) -> tuple[tuple, str | None]:
        e = self.expr()
        return e, self.name() if self.take_word("as") else None

    # -- patterns ------------------------------------------------------------
    def _paths(self) -> list[Path]:
        out = [self._path()]
        while self.take(","):
            out.append(self._path())
        return out

    def _path(self) -> Path:
        var, shortest = None, False
        if self.now.kind in ("id", "tick") and self.op("=", at=1):
            var = self.name()
            self.i += 1
        if self.word("shortestpath") and self.op("(", at=1):
            self.i += 2
            shortest = True
        path = Path([self._node()], [], var, shortest)
        while self.op("-", "<"):
            path.rels.append(self._rel())
            path.nodes.append(self._node())
        if shortest:
            self.need(")")
        return path

    def _props(self) -> list[tuple[str, tuple]]:
        def one():
            key = self.name()
            self.need(":")
            return key, self.expr()

        return self._list(one, "}") if self.take("{") else []

    def _node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.now.kind in ("id", "tick") else None
        labels = []
        while self.take(":"):
            labels.append(self.name())
        out = NodePattern(var, labels, self._props())
        self.need(")")
        return out

    def _rel(self) -> RelPattern:
        left = bool(self.take("<"))
        self.need("-")
        rel = RelPattern(None, [], [], "--")
        if self.take("["):
            if self.now.kind in ("id", "tick"):
                rel.var = self.name()
            if self.take(":"):
                rel.types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    rel.types.append(self.name())
            if self.take("*"):
                rel.hops = self._hops()
            rel.props = self._props()
            self.need("]")
        self.need("-")
        right = bool(self.take(">"))
        rel.direction = "<-" if left and not right else "->" if right and not left else "--"
        return rel

    def _hops(self) -> tuple[int, int | None]:
        low = high = None
        if self.now.kind == "num":
            low = self.now.value
            self.i += 1
            if not self.op(".."):
                return int(low), int(low)
        if self.take("..") and self.now.kind == "num":
            high = self.now.value
            self.i += 1
        return (1 if low is None else int(low)), (None if high is None else int(high))

    # -- expressions, from the loosest to the tightest -----------------------
    def expr(self) -> tuple:
        return self._left(self._xor, "or")

    def _left(self, inner, word: str) -> tuple:
        e = inner()
        while self.take_word(word):
            e = ("bin", word, e, inner())
        return e

    def _xor(self) -> tuple:
        return self._left(lambda: self._left(self._not, "and"), "xor")

    def _not(self) -> tuple:
        return ("not", self._not()) if self.take_word("not") else self._compare()

    def _compare(self) -> tuple:
        e = self._bits()
        terms, ops = [e], []
        while op := self.take("=", "<>", "<", "<=", ">", ">=", "=~"):
            ops.append(op)
            terms.append(self._bits())
        if not ops:
            return e
        out = ("cmp", ops[0], terms[0], terms[1])
        for k in range(1, len(ops)):
            out = ("bin", "and", out, ("cmp", ops[k], terms[k], terms[k + 1]))
        return out

    def _bits(self) -> tuple:
        e = self._string()
        while op := self.take("<<", ">>", "&", "||") or (self.take("|") if self._bar else None):
            e = ("bin", op, e, self._string())
        return e

    _bar = True

    def _string(self) -> tuple:
        e = self._add()
        while True:
            if self.word("starts", "ends") and self.word("with", at=1):
                op = self.now.value.lower()
                self.i += 2
                e = ("strop", op, e, self._add())
            elif self.take_word("contains"):
                e = ("strop", "contains", e, self._add())
            elif self.take_word("in"):
                e = ("in", e, self._add())
            elif self.word("not") and self.word("in", at=1):
                self.i += 2
                e = ("not", ("in", e, self._add()))
            elif self.word("is") and (self.word("null", at=1) or self.word("not", at=1) and self.word("null", at=2)):
                self.i += 1
                negated = bool(self.take_word("not"))
                self.need("null")
                e = ("isnull", e, negated)
            elif self.op(":") and e[0] == "var" and self.peek().kind in ("id", "tick"):
                labels = []
                while self.take(":"):
                    labels.append(self.name())
                e = ("label", e, labels)
            else:
                return e

    def _add(self) -> tuple:
        e = self._mul()
        while op := self.take("+", "-"):
            e = ("bin", op, e, self._mul())
        return e

    def _mul(self) -> tuple:
        e = self._pow()
        while op := self.take("*", "/", "%"):
            e = ("bin", op, e, self._pow())
        return e

    def _pow(self) -> tuple:
        e = self._unary()
        while self.take("^"):
            e = ("bin", "^", e, self._unary())
        return e

    def _unary(self) -> tuple:
        if op := self.take("-", "+", "~"):
            e = self._unary()
            if op == "-" and e[0] == "lit" and isinstance(e[1], (int, float)) and not isinstance(e[1], bool):
                return ("lit", -e[1])
            return e if op == "+" else ("un", op, e)
        return self._postfix()

    def _postfix(self) -> tuple:
        e = self._primary()
        while True:
            if self.op(".") and self.peek().kind in ("id", "tick"):
                self.i += 1
                e = ("prop", e, self.name())
            elif self.take("["):
                if self.take(".."):
                    e = ("slice", e, None, self.expr())
                else:
                    a = self.expr()
                    if self.take(".."):
                        e = ("slice", e, a, None if self.op("]") else self.expr())
                    else:
                        e = ("index", e, a)
                self.need("]")
            else:
                return e

    def _primary(self) -> tuple:
        t = self.now
        if t.kind in ("num", "str"):
            self.i += 1
            return ("lit", t.value)
        if t.kind == "param":
            self.i += 1
            return ("param", t.value)
        if self.take("("):
            bar, self._bar = self._bar, True
            e = self.expr()
            self._bar = bar
            self.need(")")
            return e
        if self.op("["):
            return self._bracket()
        if self.take("{"):
            def pair():
                key = self.name() if self.now.kind != "str" else self._primary()[1]
                self.need(":")
                return key, self.expr()

            return ("map", self._list(pair, "}"))
        if t.kind == "id":
            low = t.value.lower()
            if low in ("true", "false") and not self.op("(", at=1):
                self.i += 1
                return ("lit", low == "true")
            if low == "null":
                self.i += 1
                return ("lit", None)
            if low == "case":
                return self._case()
            if low in ("exists", "count") and self.op("{", at=1):
                self.i += 2
                self.take_word("match")
                paths = self._paths()
                where = self._where()
                self.need("}")
                return (low, paths, where)
            if low in ("all", "any", "none", "single") and self.op("(", at=1) and self.peek(2).kind == "id" and self.word("in", at=3):
                self.i += 2
                var = self.name()
                self.need("in")
                over = self.expr()
                self.need("where")
                e = ("quant", low, var, over, self.expr())
                self.need(")")
                return e
            if self.op("(", at=1):
                self.i += 2
                if self.take("*"):
                    self.need(")")
                    return ("call", low, [], False, True)
                distinct = bool(self.take_word("distinct"))
                return ("call", low, self._list(self.expr, ")"), distinct, False)
        if t.kind in ("id", "tick"):
            if t.kind == "id" and t.value.lower() in _CLAUSE_WORDS - {"all", "end", "on", "call", "set"}:
                raise QueryError(f"expected an expression at {t.at}, found {t.value!r}")
            self.i += 1
            return ("var", t.value)
        raise QueryError(f"expected an expression at {t.at}, found {self.text[t.at : t.end] or 'the end'!r}")

    def _bracket(self) -> tuple:
        self.need("[")
        if self.now.kind == "id" and self.word("in", at=1):
            var = self.name()
            self.i += 1
            bar, self._bar = self._bar, False
            over = self.expr()
            where = self._where()
            said = self.expr() if self.take("|") else None
            self._bar = bar
            self.need("]")
            return ("comp", var, over, where, said)
        return ("list", self._list(self.expr, "]"))

    def _case(self) -> tuple:
        self.need("case")
        subject = None if self.word("when") else self.expr()
        whens = []
        while self.take_word("when"):
            c = self.expr()
            self.need("then")
            whens.append((c, self.expr()))
        other = self.expr() if self.take_word("else") else ("lit", None)
        self.need("end")
        return ("case", subject, whens, other)


def parse(text: str) -> tuple:
    return Parser(text).statement()
