"""A lexer and a shallow parser of SQL queries: enough to name tables, columns, stars and limits, and to refuse what isn't SQL.

The parser doesn't build a tree. It walks the tokens with one frame for each open query and remembers in which clause it
is, which tables the query reads under which aliases, and which columns its expressions name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")+"|`[^`]+`|\[[^\]\[]+\])
    |(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>[^\W\d]\w*)
    |(?P<mark>[?:@$]\w*)
    |(?P<op><=>|<>|<=|>=|!=|==|\|\||<<|>>|->>|->|[-+*/%=<>(),.;~&|])""",
    re.X | re.S,
)
#: Words that end an alias position or begin a clause; none of them names a column.
CLAUSES = {"select", "from", "where", "group", "having", "order", "limit", "offset", "union", "intersect", "except", "window", "values", "with", "fetch"}
JOINS = {"join", "inner", "left", "right", "full", "outer", "cross", "natural", "on", "using", "lateral", "semi", "anti"}
OPERATORS = {"and", "or", "not", "in", "is", "like", "ilike", "rlike", "between", "exists", "case", "when", "then", "else", "end", "as", "distinct", "all", "any", "asc", "desc", "nulls", "by", "over", "partition", "rows", "range", "filter", "collate", "glob", "regexp", "escape", "cast", "interval", "unbounded", "preceding", "following", "current", "row", "recursive", "first", "last"}
LITERALS = {"null", "true", "false", "current_date", "current_timestamp", "current_time"}
STATEMENTS = {"select", "with", "values", "insert", "update", "delete", "replace", "explain", "pragma", "show", "describe"}


class InvalidSql(ValueError):
    pass


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text

    @property
    def name(self) -> str:
        if self.kind == "quoted":
            return self.text[1:-1].replace('""', '"')
        return self.text


def lex(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise InvalidSql(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup in ("string", "quoted") and "\\" in m[0]:
            raise InvalidSql("a backslash in quotes, which dialects read differently")
        if m[0].startswith("/*") and "/*" in m[0][2:]:
            raise InvalidSql("a comment within a comment, which dialects read differently")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


@dataclass
class TableRef:
    name: str
    alias: str | None
    start: int  # of the name in the text
    end: int  # of name and alias
    is_cte: bool = False
    qualifier: str = ""  # database or catalog, as written


@dataclass
class ColumnRef:
    qualifier: str | None
    name: str
    scope: int


@dataclass
class Analysis:
    statement: str
    tables: list[TableRef] = field(default_factory=list)
    columns: list[ColumnRef] = field(default_factory=list)
    stars: list[str] = field(default_factory=list)  # 'count' or 'select', in order
    aliases: list[dict[str, str]] = field(default_factory=list)  # by scope: alias -> table
    parents: list[int] = field(default_factory=list)  # by scope: the scope around it
    limits: list[tuple[int, int | None, int, int]] = field(default_factory=list)  # depth, value, start and end of the value
    functions: list[str] = field(default_factory=list)  # names of functions called, in lower case
    table_functions: list[str] = field(default_factory=list)  # those that stand for a table
    length: int = 0  # end of the query's text, without a final semicolon

    def resolve(self, qualifier: str, scope: int) -> str:
        """The table that a qualifier stands for, in its query or one around it."""
        while scope >= 0:
            if qualifier in self.aliases[scope]:
                return self.aliases[scope][qualifier]
            scope = self.parents[scope]
        return qualifier


class _Walker:
    def __init__(self, sql: str):
        self.t = lex(sql)
        if not self.t:
            raise InvalidSql("empty")
        while self.t and self.t[-1].text == ";":
            self.t.pop()
        if not self.t or any(x.text == ";" for x in self.t):
            raise InvalidSql("more than one statement")
        first = self.t[0].low
        if first not in STATEMENTS and first != "(":
            raise InvalidSql(f"no statement begins with {self.t[0].text!r}")
        self.i = 0
        self.ctes: frozenset[str] = frozenset()  # names of common table expressions that can be seen here
        self.out = Analysis(first, length=self.t[-1].end)

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].low if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k].kind if self.i + k < len(self.t) else ""

    def is_name(self, k: int = 0) -> bool:
        return self.kind(k) == "quoted" or self.kind(k) == "word" and self.peek(k) not in CLAUSES | JOINS | OPERATORS | LITERALS

    def expect(self, text: str) -> None:
        if self.peek() != text:
            raise InvalidSql(f"{text} is missing before {self.t[self.i].text if self.i < len(self.t) else 'the end'!r}")
        self.i += 1

    def new_scope(self, parent: int) -> int:
        self.out.aliases.append({})
        self.out.parents.append(parent)
        return len(self.out.aliases) - 1

    def run(self) -> Analysis:
        if self.out.statement in ("select", "with", "values", "("):
            self.query(-1, 0)
            if self.i < len(self.t):
                raise InvalidSql(f"unexpected {self.t[self.i].text!r}")
        else:
            self.other()
        return self.out

    def other(self) -> None:
        """A statement other than a query: its tables stand after into, update, from, join or table; the rest is an expression."""
        scope = self.new_scope(-1)
        self.i = 1
        if self.out.statement == "update" and self.is_name():
            self.table(scope)
        while self.i < len(self.t):
            if self.peek() in ("into", "from", "join", "table"):
                self.i += 1
                if self.is_name():
                    self.table(scope)
            elif self.peek() in ("select", "with"):
                self.query(scope, 0)
            elif not self.item(scope, 0):
                self.i += 1

    def query(self, parent: int, depth: int) -> None:
        outer = self.ctes
        if self.peek() == "with":
            self.common_tables(parent, depth)
        self.body(parent, depth)
        self.ctes = outer

    def common_tables(self, parent: int, depth: int) -> None:
        """Each name can be seen from behind its own query on; in it too only where that is recursive."""
        self.i += 1
        recursive = self.peek() == "recursive"
        self.i += recursive
        while True:
            if not self.is_name():
                raise InvalidSql("a common table expression has no name")
            name = {self.t[self.i].name.lower()}
            self.i += 1
            if self.peek() == "(":
                self.skip_parens()
            self.expect("as")
            self.expect("(")
            if recursive:
                self.ctes |= name
            self.query(parent, depth + 1)
            self.ctes |= name
            self.expect(")")
            if self.peek() != ",":
                break
            self.i += 1

    def body(self, parent: int, depth: int) -> None:
        while True:
            if self.peek() == "(":
                self.i += 1
                self.query(parent, depth + 1)
                self.expect(")")
            elif self.peek() == "values":
                self.i += 1
                self.expression(self.new_scope(parent), depth, {"union", "intersect", "except", "order", "limit"})
            else:
                self.select(parent, depth)
            if self.peek() in ("union", "intersect", "except"):
                self.i += 1
                if self.peek() in ("all", "distinct"):
                    self.i += 1
                continue
            break
        self.tail(len(self.out.aliases) - 1 if self.out.aliases else self.new_scope(parent), depth)

    def tail(self, scope: int, depth: int) -> None:
        if self.peek() == "order":
            self.i += 1
            self.expect("by")
            self.some(scope, depth, {"limit", "offset", "fetch"})
        if self.peek() == "limit":
            self.i += 1
            self.limit(depth)
        if self.peek() == "offset":
            self.i += 1
            self.some(scope, depth, {"limit"})
            if self.peek() == "limit":
                self.i += 1
                self.limit(depth)

    def limit(self, depth: int) -> None:
        at = self.i
        while self.i < len(self.t) and self.peek() not in (")", "offset", "union", "intersect", "except"):
            self.i += 1
        if at == self.i:
            raise InvalidSql("LIMIT has no value")
        value = self.t[at : self.i]
        whole = value[0].text.isdigit() and (len(value) == 1 or len(value) == 3 and value[1].text == "," and value[2].text.isdigit())
        use = value[-1]  # of LIMIT offset, count the last
        self.out.limits.append((depth, int(use.text) if whole else None, use.start, use.end))

    def select(self, parent: int, depth: int) -> None:
        self.expect("select")
        scope = self.new_scope(parent)
        if self.peek() in ("distinct", "all"):
            self.i += 1
        ends = {"from", "where", "group", "having", "order", "limit", "offset", "union", "intersect", "except", "window"}
        # Tables are read before the columns that name them are judged, so the order of clauses doesn't matter here.
        self.some(scope, depth, ends)
        if self.peek() == "from":
            self.i += 1
            self.sources(scope, depth)
        for clause in ("where", "group", "having", "window"):
            if self.peek() == clause:
                self.i += 1
                if clause == "group":
                    self.expect("by")
                self.some(scope, depth, ends - {"from", clause})

    def sources(self, scope: int, depth: int) -> None:
        while True:
            if self.peek() == "lateral":
                self.i += 1
            if self.peek() == "(":
                self.i += 1
                if self.peek() in ("select", "with", "values", "("):
                    self.query(scope, depth + 1)
                else:
                    self.sources(scope, depth)
                self.expect(")")
                self.alias()
            elif self.is_name():
                if self.peek(1) == "(":
                    self.out.table_functions.append(self.t[self.i].name.lower())
                    self.item(scope, depth)
                    self.alias()
                else:
                    self.table(scope)
            else:
                raise InvalidSql("FROM has no table")
            while True:
                if self.peek() in ("on",):
                    self.i += 1
                    self.some(scope, depth, CLAUSES | {"join", "inner", "left", "right", "full", "cross", "natural"} - {"with"}, commas=False)
                elif self.peek() == "using":
                    self.i += 1
                    self.skip_parens()
                else:
                    break
            joined = False
            while self.peek() in JOINS - {"on", "using", "lateral"}:
                joined = self.peek() == "join"
                self.i += 1
            if self.peek() == ",":
                self.i += 1
                joined = True
            if not joined:
                return

    def table(self, scope: int) -> None:
        start = self.t[self.i].start
        parts = [self.t[self.i].name]
        self.i += 1
        while self.peek() == "." and self.kind(1) in ("word", "quoted"):
            parts.append(self.t[self.i + 1].name)
            self.i += 2
        end = self.t[self.i - 1].end
        alias = self.alias()
        name = parts[-1].lower()
        if alias:
            end = self.t[self.i - 1].end
        self.out.tables.append(TableRef(name, alias, start, end, len(parts) == 1 and name in self.ctes, ".".join(parts[:-1])))
        self.out.aliases[scope][(alias or name).lower()] = name

    def alias(self) -> str | None:
        if self.peek() == "as":
            self.i += 1
            if not self.is_name():
                raise InvalidSql("AS has no name")
        if self.is_name():
            self.i += 1
            return self.t[self.i - 1].name
        return None

    def skip_parens(self) -> None:
        self.expect("(")
        depth = 1
        while depth:
            if self.i >= len(self.t):
                raise InvalidSql("a parenthesis isn't closed")
            depth += (self.peek() == "(") - (self.peek() == ")")
            self.i += 1

    def some(self, scope: int, depth: int, ends: set[str], commas: bool = True) -> None:
        at = self.i
        self.expression(scope, depth, ends, commas)
        if self.i == at:
            raise InvalidSql(f"an expression is missing before {self.t[self.i].text if self.i < len(self.t) else 'the end'!r}")

    def expression(self, scope: int, depth: int, ends: set[str], commas: bool = True, call: bool = False) -> None:
        """Items up to a word in ends, a closing parenthesis, or the end. Two operands in a row are an alias, three are no SQL.

        call: of a function's arguments or a window, where ORDER and FROM may stand.
        """
        run = 0
        while self.i < len(self.t):
            word = self.peek()
            if word == ")" or word in ends or (word == "," and not commas):
                return
            if call and word in ("order", "from"):
                self.i += 1
                run = 0
            elif word == "as":
                self.i += 1
                if self.kind() not in ("word", "quoted", "string"):
                    raise InvalidSql("AS has no name")
                self.i += 1
                run = 2
            elif run == 1 and self.is_name() and self.peek(1) not in (".", "("):
                self.i += 1  # an alias without AS
                run = 2
            elif self.item(scope, depth):
                run += 1
            else:
                self.i += 1
                run = 0
            if run > 2:
                raise InvalidSql(f"unexpected {self.t[self.i - 1].text!r}")

    def item(self, scope: int, depth: int) -> bool:
        """One operand, or False (nothing read) at an operator."""
        word, kind = self.peek(), self.kind()
        if word == "(":
            self.i += 1
            if self.peek() in ("select", "with", "values"):
                self.query(scope, depth + 1)
            else:
                self.expression(scope, depth, set())
            self.expect(")")
            return True
        if kind in ("string", "number", "mark") or word in LITERALS:
            self.i += 1
            return True
        if word == "*":
            before = self.t[self.i - 1].low if self.i else ""
            if before in ("select", "distinct", "all", "(", ",", "."):
                self.out.stars.append("count" if before == "(" and self.i >= 2 and self.t[self.i - 2].low == "count" else "select")
                self.i += 1
                return True
            return False
        if word == "cast" and self.peek(1) == "(":
            self.i += 2
            self.expression(scope, depth, {"as"})
            self.expect("as")
            while self.i < len(self.t) and self.peek() != ")":
                self.skip_parens() if self.peek() == "(" else setattr(self, "i", self.i + 1)
            self.expect(")")
            return True
        if word in ("case",):
            self.i += 1
            self.expression(scope, depth, {"end"})
            self.expect("end")
            return True
        if kind in ("word", "quoted") and self.peek(1) == "(" and word not in OPERATORS - {"first", "last", "any"} and word not in CLAUSES:
            self.out.functions.append(self.t[self.i].name.lower())
            self.i += 2
            self.expression(scope, depth, set(), call=True)
            self.expect(")")
            if self.peek() in ("over", "filter"):
                over = self.peek() == "over"
                self.i += 1
                if self.peek() == "(":
                    self.i += 1
                    if not over:
                        self.expect("where")
                    self.expression(scope, depth, set(), call=True)
                    self.expect(")")
                elif over and self.is_name():
                    self.i += 1
            return True
        if self.is_name():
            parts = [self.t[self.i].name]
            self.i += 1
            while self.peek() == "." and (self.kind(1) in ("word", "quoted") or self.peek(1) == "*"):
                self.i += 1
                if self.peek() == "*":
                    self.out.stars.append("select")
                    self.i += 1
                    return True
                parts.append(self.t[self.i].name)
                self.i += 1
            self.out.columns.append(ColumnRef(parts[-2].lower() if len(parts) > 1 else None, parts[-1].lower(), scope))
            return True
        if kind == "op" or word in OPERATORS | {"by"} | JOINS:
            return False
        raise InvalidSql(f"unexpected {self.t[self.i].text!r}")


def analyse(sql: str) -> Analysis:
    """What a statement reads; InvalidSql if it isn't one."""
    return _Walker(sql).run()
