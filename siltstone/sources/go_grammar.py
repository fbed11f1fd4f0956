"""A recursive-descent reader of Go files: package name, imports and exported symbols, or where it fails.

Tokens are read once, with the semicolons that line ends stand for; declarations, statements, types and
expressions then follow the language's grammar, going back a few tokens where a name may begin a parameter
or a type. Types are operands of expressions, as conversions and arguments need them. Operator precedence doesn't matter here.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

# Fixed values of the language.
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BINARY = set("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
UNARY = set("+ - ! ^ * & <-".split())
ASSIGN = set(":= = += -= *= /= %= &= |= ^= <<= >>= &^=".split())
ENDS_LINE = {"id", "lit", "str", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
TYPE_STARTS = {"id", "*", "(", "[", "map", "chan", "<-", "func", "struct", "interface"}

TOKEN = re.compile(
    r"""(?P<blank>[ \t\r]+|//[^\n]*)|(?P<comment>/\*.*?\*/)|(?P<line>\n)|(?P<id>[^\W\d]\w*)
    |(?P<str>"(?:\\.|[^"\\\n])*"|`[^`]*`)|(?P<char>'(?:\\[^\n][^'\n]*|[^'\\\n])')
    |(?P<lit>0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?[\d_]+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?i?)
    |(?P<op>\.\.\.|<<=|>>=|&\^=|&\^|<-|\+\+|--|:=|&&|\|\||==|!=|<=|>=|<<|>>|[-+*/%&|^]=|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.X | re.S,
)


class Failed(Exception):
    """The text doesn't follow the grammar."""


def tokens(text: str) -> list[tuple[str, str]]:
    """Kind and text of each token: names, literals and strings by kind, all others by themselves."""
    out, at = [], 0

    def ended() -> None:
        if out and out[-1][0] in ENDS_LINE:
            out.append((";", "\n"))

    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Failed
        at, kind, value = m.end(), m.lastgroup, m.group()
        if kind == "line" or kind == "comment" and "\n" in value:
            ended()
        elif kind == "id":
            out.append((value if value in KEYWORDS else "id", value))
        elif kind in ("str", "lit"):
            out.append((kind, value))
        elif kind == "char":
            out.append(("lit", value))
        elif kind == "op":
            out.append((value, value))
    ended()
    return [*out, ("end", "")]


class Reader:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = tokens(text), 0, 0
        self.package, self.imports, self.symbols = "", [], []
        #: Whether a name before { may begin a composite literal; not so in the head of if, for and switch.
        self.open = True

    # --- tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def ahead(self, n: int) -> str:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)][0]

    def take(self, *kinds: str) -> str:
        kind, value = self.tokens[self.at]
        if kind not in kinds:
            raise Failed
        self.at += 1
        return value

    def met(self, *kinds: str) -> bool:
        if self.kind in kinds:
            self.at += 1
            return True
        return False

    def either(self, first: Callable, second: Callable):
        at, opened, depth = self.at, self.open, self.depth
        try:
            return first()
        except Failed:
            self.at, self.open, self.depth = at, opened, depth
            return second()

    def listed(self, one: Callable, close: str) -> None:
        """Items to close, commas between them and perhaps after the last."""
        held, self.open = self.open, True
        while self.kind != close:
            one()
            if not self.met(","):
                break
        self.take(close)
        self.open = held

    # --- files and declarations

    def file(self) -> None:
        self.take("package")
        self.package = self.take("id")
        self.ends()
        while self.kind == "import":
            self.at += 1
            self.specs(self.import_spec)
            self.ends()
        while self.kind != "end":
            if self.kind == "func":
                self.function()
            else:
                self.declaration(self.symbols)
            self.ends()

    def ends(self) -> None:
        if self.kind not in (")", "}", "end"):
            self.take(";")

    def specs(self, one: Callable) -> None:
        if self.met("("):
            while not self.met(")"):
                one()
                self.ends()
        else:
            one()

    def import_spec(self) -> None:
        self.met("id", ".")
        try:
            self.imports.append(unquoted(self.take("str")))
        except (ValueError, SyntaxError):
            raise Failed from None

    def declaration(self, symbols: list | None = None) -> None:
        word = self.take("const", "var", "type")
        found = [] if symbols is None else symbols

        def value() -> None:
            names = [self.take("id")]
            while self.met(","):
                names.append(self.take("id"))
            typed = self.kind in TYPE_STARTS
            if typed:
                self.type()
            if self.met("="):
                self.expressions()
            elif word == "var" and not typed:
                raise Failed
            found.extend((n, word, "") for n in names)

        def named() -> None:
            name = self.take("id")
            kind = self.either(lambda: (self.type_parameters(), self.met("="), self.type())[-1], lambda: (self.met("="), self.type())[-1]) if self.kind == "[" else (self.met("="), self.type())[-1]
            found.append((name, "interface" if kind == "interface" else "type", ""))

        self.specs(named if word == "type" else value)

    def function(self) -> None:
        self.take("func")
        receiver = None
        if self.kind == "(":
            start = self.at
            self.parameters()
            receiver = owner(self.tokens[start + 1 : self.at - 1])
        name = self.take("id")
        if self.kind == "[":
            self.type_parameters()
        self.signature()
        if self.kind == "{":
            self.block()
        self.symbols.append((name, "func" if receiver is None else "method", receiver or ""))

    # --- types

    def type_parameters(self) -> None:
        self.take("[")

        def one() -> None:
            self.take("id")
            while self.met(","):
                self.take("id")
            self.union()

        if self.kind == "]":
            raise Failed
        self.listed(one, "]")

    def union(self) -> None:
        while True:
            self.met("~")
            self.type()
            if not self.met("|"):
                return

    def type(self) -> str:
        """The kind of token that the type begins with."""
        kind = self.kind
        self.nested(self.type_from, kind)
        return kind

    def nested(self, run: Callable, *args) -> None:
        # what is nested deeper than a person writes counts as an error, not as a crash
        self.depth += 1
        if self.depth > 150:
            raise Failed
        run(*args)
        self.depth -= 1

    def type_from(self, kind: str) -> None:
        self.take(*TYPE_STARTS)
        if kind == "id":
            if self.met("."):
                self.take("id")
            if self.kind == "[" and self.ahead(1) != "]":
                self.either(lambda: (self.take("["), self.listed(self.type, "]")), lambda: None)
        elif kind == "*":
            self.type()
        elif kind == "(":
            self.type()
            self.take(")")
        elif kind == "[":
            if not self.met("]"):
                if not self.met("..."):
                    self.within(self.expression)
                self.take("]")
            self.type()
        elif kind == "map":
            self.take("[")
            self.type()
            self.take("]")
            self.type()
        elif kind in ("chan", "<-"):
            if kind == "<-":
                self.take("chan")
            else:
                self.met("<-")
            self.type()
        elif kind == "func":
            self.signature()
        else:
            self.take("{")
            while not self.met("}"):
                (self.field if kind == "struct" else self.element)()
                self.ends()

    def field(self) -> None:
        def several() -> None:
            self.take("id")
            while self.met(","):
                self.take("id")
            self.type()

        if self.kind == "id" and self.ahead(1) not in (".", ";", "}", "str"):
            self.either(several, self.type)
        else:
            self.type()
        self.met("str")

    def element(self) -> None:
        if self.kind == "id" and self.ahead(1) == "(":
            self.at += 1
            self.signature()
        else:
            self.union()

    def signature(self) -> None:
        self.parameters()
        if self.kind == "(":
            self.parameters()
        elif self.kind in TYPE_STARTS:
            self.type()

    def parameters(self) -> None:
        self.take("(")

        def bare() -> None:
            self.met("...")
            self.type()

        def one() -> None:
            if self.kind == "id" and self.ahead(1) not in (",", ")", "."):
                self.either(lambda: (self.take("id"), bare()), bare)
            else:
                bare()

        self.listed(one, ")")

    # --- expressions

    def within(self, run: Callable) -> None:
        held, self.open = self.open, True
        run()
        self.open = held

    def expressions(self) -> None:
        self.expression()
        while self.met(","):
            self.expression()

    def expression(self) -> None:
        self.nested(self.operands)

    def operands(self) -> None:
        while True:
            while self.met(*UNARY):
                pass
            self.primary()
            if not self.met(*BINARY):
                return

    def primary(self) -> None:
        kind = self.kind
        #: Whether { may follow: after a name where heads allow it, after a type always.
        literal = None
        if kind in ("lit", "str"):
            self.at += 1
        elif kind == "id":
            self.at += 1
            literal = "name"
        elif kind == "(":
            self.at += 1
            self.within(self.expression)
            self.take(")")
        elif kind == "func":
            self.at += 1
            self.signature()
            if self.kind == "{":
                self.within(self.block)
        elif kind in ("[", "map", "chan", "struct", "interface"):
            self.type()
            literal = "type"
        else:
            raise Failed
        while True:
            if self.met("."):
                if self.met("("):
                    if not self.met("type"):
                        self.type()
                    self.take(")")
                    literal = None
                else:
                    self.take("id")
            elif self.kind == "[":
                self.at += 1
                self.within(self.index)
            elif self.met("("):
                self.listed(lambda: (self.expression(), self.met("...")), ")")
                literal = None
            elif self.kind == "{" and (literal == "type" or literal and self.open):
                self.braces()
                literal = None
            else:
                return

    def index(self) -> None:
        if self.kind == "]":
            raise Failed
        while self.kind != "]":
            if self.kind not in (":", ","):
                self.expression()
            if self.kind != "]":
                self.take(":", ",")
        self.take("]")

    def braces(self) -> None:
        self.take("{")

        def value() -> None:
            if self.kind == "{":
                self.nested(self.braces)
            else:
                self.expression()

        def one() -> None:
            value()
            if self.met(":"):
                value()

        self.listed(one, "}")

    # --- statements

    def block(self) -> None:
        self.take("{")
        self.within(lambda: self.nested(self.statements))
        self.take("}")

    def statements(self) -> None:
        while self.kind not in ("}", "case", "default"):
            self.statement()
            if self.kind not in ("}", "case", "default"):
                self.take(";")

    def statement(self) -> None:
        kind = self.kind
        if kind in (";", "}"):
            return
        if kind == "{":
            self.block()
        elif kind in ("const", "var", "type"):
            self.declaration()
        elif kind == "return":
            self.at += 1
            if self.kind not in (";", "}"):
                self.expressions()
        elif kind in ("break", "continue", "goto"):
            self.at += 1
            if kind == "goto" or self.kind == "id":
                self.take("id")
        elif kind == "fallthrough":
            self.at += 1
        elif kind in ("go", "defer"):
            self.at += 1
            self.expression()
        elif kind in ("if", "for", "switch", "select"):
            self.at += 1
            getattr(self, f"{kind}_")()
        elif kind == "id" and self.ahead(1) == ":":
            self.at += 2
            self.statement()
        else:
            self.simple()

    def simple(self, ranged: bool = False) -> bool:
        """Whether it was the range of a loop."""
        self.expressions()
        if self.met("++", "--"):
            return False
        if self.met("<-"):
            self.expression()
            return False
        if self.met(*ASSIGN):
            if ranged and self.met("range"):
                self.expression()
                return True
            self.expressions()
        return False

    def head(self, run: Callable) -> None:
        held, self.open = self.open, False
        run()
        self.open = held

    def if_(self) -> None:
        def head() -> None:
            if not self.met(";"):
                self.simple()
                if not self.met(";"):
                    return
            self.simple()

        self.head(head)
        self.block()
        if self.met("else"):
            if self.met("if"):
                self.nested(self.if_)
            else:
                self.block()

    def for_(self) -> None:
        def head() -> None:
            if self.met("range"):
                self.expression()
                return
            if self.kind != ";" and self.simple(True):
                return
            if self.met(";"):
                if self.kind not in (";", "{"):
                    self.simple()
                if self.met(";") and self.kind != "{":
                    self.simple()

        if self.kind != "{":
            self.head(head)
        self.block()

    def switch_(self) -> None:
        def head() -> None:
            if self.kind != ";":
                self.simple()
            if self.met(";") and self.kind != "{":
                self.simple()

        if self.kind != "{":
            self.head(head)
        self.cases(self.expressions)

    def select_(self) -> None:
        self.cases(self.simple)

    def cases(self, one: Callable) -> None:
        self.take("{")
        held, self.open = self.open, True
        while not self.met("}"):
            if self.take("case", "default") == "case":
                one()
            self.take(":")
            self.nested(self.statements)
        self.open = held


def owner(receiver: list[tuple[str, str]]) -> str:
    """The name of a receiver's type: the last one outside of its type parameters."""
    names, depth = [], 0
    for kind, value in receiver:
        depth += (kind == "[") - (kind == "]")
        if kind == "id" and not depth:
            names.append(value)
    return names[-1] if names else ""


def unquoted(literal: str) -> str:
    return literal[1:-1] if literal[0] == "`" else ast.literal_eval(literal)


QUOTED = re.compile(r'"([^"]+)"')


def imports_of_lines(text: str) -> list[str]:
    """Imports of a file that can't be read, line by line: what is first quoted in single ones and in lines of groups."""
    out, group = [], False
    for line in map(str.strip, text.split("\n")):
        if group and line == ")":
            group = False
        elif not group and line.startswith("import ("):
            group = True
        elif (group or line.startswith("import ")) and (m := QUOTED.search(line)):
            out.append(m[1])
    return out


def read(text: str) -> tuple[str, list[tuple[str, str, str]], list[str], bool]:
    """Package name, exported symbols (name, kind, receiver) in order, sorted imports, and whether it can't be read."""
    try:
        reader = Reader(text.removeprefix("﻿"))
        reader.file()
    except (Failed, RecursionError):
        return "", [], sorted(set(imports_of_lines(text))), True
    return reader.package, [s for s in reader.symbols if s[0][0].isupper()], sorted(set(reader.imports)), False
