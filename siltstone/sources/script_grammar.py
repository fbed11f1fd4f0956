"""A recursive-descent reader of TypeScript and JavaScript modules: symbols and imports, or where it fails.

Tokens know whether a line ends before them, which ends statements where nothing goes on. Module and block
statements, declarations, expressions and types follow the grammar; the insides of classes, of object
literals and of parameters are held to their brackets alone. Markup in scripts (JSX) is read as one operand.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .go_grammar import Failed

# Fixed values of the languages.
RESERVED = set("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split())
PREFIX = set("! ~ + - ++ -- typeof void delete await yield new ...".split())
BINARY = set("+ - * / % ** & | ^ << >> >>> && || ?? == != === !== < > <= >= in instanceof = += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= ,".split()) - {","}
OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
TYPE_PREFIX = set("keyof typeof readonly unique infer asserts new abstract | &".split())

NAME = r"[^\W\d$]|\$"
TOKEN = re.compile(
    rf"""(?P<blank>[ \t\r\v\f ﻿]+|//[^\n]*|\#![^\n]*)|(?P<comment>/\*.*?\*/)|(?P<line>\n)
    |(?P<id>\#?(?:{NAME})(?:[\w$]|‌|‍)*)
    |(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<num>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.()\[\]{{}}@])""",
    re.X | re.S,
)
PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
TAG = re.compile(r"<(?:>|[A-Za-z][\w.:-]*(?=[\s/>]))")


def tokens(text: str, markup: bool, at: int = 0, until: str = "") -> tuple[list[tuple[str, str, bool]], int]:
    """Kind, text and whether a line ends before it, of each token; with until, as far as that bracket closes."""
    out: list[tuple[str, str, bool]] = []
    line, depth = True, 0
    while at < len(text):
        c = text[at]
        operand = not out or not (out[-1][0] in ("id", "str", "num", "template", "regex", "markup") and out[-1][1] not in RESERVED - {"this", "super", "null", "true", "false"} or out[-1][0] in CLOSES)
        if c == "`":
            end = template(text, at, markup)
            kind, value = "template", text[at:end]
        elif c == "/" and operand and (m := PATTERN.match(text, at)):
            kind, value, end = "regex", m.group(), m.end()
        elif c == "<" and markup and operand and TAG.match(text, at):
            end = element(text, at)
            kind, value = "markup", ""
        else:
            m = TOKEN.match(text, at)
            if not m:
                raise Failed
            kind, value, end = m.lastgroup, m.group(), m.end()
            if kind in ("blank", "line", "comment"):
                line |= "\n" in value
                at = end
                continue
            if kind == "op" or kind == "id" and value in RESERVED:
                kind = value
            if until and value == until and not depth:
                return out, end
            depth += (value in OPENS and kind != "str") - (value in CLOSES)
        out.append((kind, value, line))
        line, at = False, end
    if until:
        raise Failed
    return out, at


def template(text: str, at: int, markup: bool) -> int:
    """Where the template that begins at a place ends."""
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            at = tokens(text, markup, at + 2, "}")[1]
        else:
            at += 1
    raise Failed


def element(text: str, at: int) -> int:
    """Where the markup that begins at a place ends."""
    depth = 0
    while at < len(text):
        if text.startswith("</", at):
            at = text.find(">", at) + 1
            depth -= 1
            if not at or depth < 0:
                raise Failed
        elif text[at] == "<":
            at += 1
            while at < len(text) and text[at] != ">":
                if text[at] in "\"'":
                    at = text.find(text[at], at + 1) + 1
                    if not at:
                        raise Failed
                elif text[at] == "{":
                    at = tokens(text, True, at + 1, "}")[1]
                else:
                    at += 1
            depth += text[at - 1 : at] != "/"
            at += 1
        elif text[at] == "{":
            at = tokens(text, True, at + 1, "}")[1]
            continue
        else:
            at += 1
            continue
        if not depth:
            return at
    raise Failed


class Reader:
    def __init__(self, text: str, typed: bool, markup: bool):
        found, _ = tokens(text, markup)
        self.tokens, self.typed, self.at, self.depth = [*found, ("end", "", True)], typed, 0, 0
        self.symbols: list[tuple[str, str, bool]] = []
        self.imports: set[str] = set()
        self.close, open_at = {}, []
        for i, (kind, _, _) in enumerate(self.tokens):
            if kind in OPENS:
                open_at.append(i)
            elif kind in CLOSES:
                if not open_at or OPENS[self.tokens[open_at[-1]][0]] != kind:
                    raise Failed
                self.close[open_at.pop()] = i
        if open_at:
            raise Failed

    # --- tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def value(self) -> str:
        return self.tokens[self.at][1]

    @property
    def line(self) -> bool:
        return self.tokens[self.at][2]

    def says(self, *words: str) -> bool:
        return self.kind == "id" and self.value in words

    def ahead(self, n: int) -> str:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)][1]

    def take(self, *kinds: str) -> str:
        if self.kind not in kinds:
            raise Failed
        self.at += 1
        return self.tokens[self.at - 1][1]

    def met(self, *kinds: str) -> bool:
        if self.kind in kinds:
            self.at += 1
            return True
        return False

    def skip(self, kind: str) -> None:
        """What stands in brackets of a kind, unread."""
        if self.kind != kind:
            raise Failed
        self.at = self.close[self.at] + 1

    def could(self, run: Callable) -> bool:
        at, depth = self.at, self.depth
        try:
            run()
        except Failed:
            self.at, self.depth = at, depth
            return False
        return True

    def ends(self) -> None:
        if not self.met(";") and self.kind not in ("}", "end") and not self.line:
            raise Failed

    # --- modules

    def module(self) -> None:
        while self.kind != "end":
            if self.kind == "import" and self.ahead(1) not in ("(", "."):
                self.imported()
            elif self.kind == "export":
                self.exported()
            else:
                self.statement(lambda n, k: self.symbols.append((n, k, False)), True)

    def names(self) -> None:
        while self.kind in ("id", ",", "*", "{", "}", "default"):
            if self.says("from") and self.tokens[self.at + 1][0] == "str":
                return
            self.at += 1

    def source(self) -> None:
        self.imports.add(self.take("str")[1:-1])
        if self.says("with", "assert") or self.kind == "with":
            self.at += 1
            self.skip("{")

    def imported(self) -> None:
        self.at += 1
        if self.kind == "str":
            self.source()
        else:
            self.names()
            if self.met("="):
                self.expression()
            else:
                if not self.says("from"):
                    raise Failed
                self.at += 1
                self.source()
        self.ends()

    def exported(self) -> None:
        self.take("export")
        if self.met("default"):
            self.symbols.append(("default", self.default(), True))
        elif self.kind in ("*", "{") or self.says("type") and self.ahead(1) in ("{", "*"):
            self.names()
            if self.says("from"):
                self.at += 1
                self.source()
            self.ends()
        elif self.met("="):
            self.expression()
            self.ends()
        elif self.says("as"):
            self.at += 3
            self.ends()
        else:
            self.statement(lambda n, k: self.symbols.append((n, k, True)), True)

    def default(self) -> str:
        start = self.at
        if self.says("async") and self.ahead(1) == "function":
            self.at += 1
        if self.kind == "function":
            generator = self.ahead(1) == "*"
            self.function()
            self.met(";")
            return "var" if generator else "func"
        if self.kind == "class":
            self.class_()
            return "type"
        self.at = start
        if self.says("abstract", "interface"):
            self.statement(lambda n, k: None)
            return "var"
        kind = self.expression()
        self.ends()
        return "func" if kind == "arrow" else "var"

    # --- statements

    def statement(self, found: Callable[[str, str], None] | None = None, top: bool = False) -> None:
        self.depth += 1
        if self.depth > 150:
            raise Failed
        self.statement_of(found or (lambda n, k: None), top)
        self.depth -= 1

    def statement_of(self, found: Callable[[str, str], None], top: bool) -> None:
        kind = self.kind
        while self.kind == "@":
            self.at += 1
            self.postfix()
        if self.says("declare", "abstract", "global") and self.typed and not self.tokens[self.at + 1][2] and (self.ahead(1) in ("function", "class", "const", "let", "var", "enum", "namespace", "module", "interface", "type", "abstract", "global", "{")):
            self.at += 1
            # ambient and abstract declarations are no symbols of the module
            if self.kind == "{":
                self.skip("{")
            else:
                self.statement()
        elif self.met(";"):
            pass
        elif kind == "{":
            self.block()
        elif self.says("async") and self.ahead(1) == "function" or self.kind == "function":
            self.met("id")
            generator = self.ahead(1) == "*"
            name, whole = self.function()
            if whole and not generator:
                found(name, "func")
        elif self.kind == "class":
            found(self.class_(), "type")
        elif self.kind == "enum" or self.kind == "const" and self.ahead(1) == "enum":
            self.met("const")
            self.take("enum")
            self.take("id")
            self.skip("{")
        elif self.typed and self.says("interface") and self.tokens[self.at + 1][0] == "id":
            self.at += 1
            found(self.take("id"), "interface")
            self.generics()
            if self.met("extends"):
                self.type()
                while self.met(","):
                    self.type()
            self.skip("{")
        elif self.typed and self.says("type") and self.tokens[self.at + 1][0] == "id" and self.ahead(2) in ("=", "<"):
            self.at += 1
            name = self.take("id")
            self.generics()
            self.take("=")
            self.type()
            self.ends()
            found(name, "type")
        elif self.typed and self.says("namespace", "module") and self.tokens[self.at + 1][0] in ("id", "str") and not self.tokens[self.at + 1][2]:
            while self.kind != "{":
                self.take("id", "str", ".")
            self.skip("{")
        elif kind in ("const", "var") or self.says("let") and self.tokens[self.at + 1][0] in ("id", "{", "["):
            self.at += 1
            self.variables(found, top)
            self.ends()
        elif kind in ("if", "while", "with"):
            self.at += 1
            self.condition()
            self.statement()
            if kind == "if" and self.met("else"):
                self.statement()
        elif kind == "for":
            self.at += 1
            if self.says("await"):
                self.at += 1
            self.skip("(")
            self.statement()
        elif kind == "do":
            self.at += 1
            self.statement()
            self.take("while")
            self.condition()
            self.met(";")
        elif kind == "switch":
            self.at += 1
            self.condition()
            self.take("{")
            while not self.met("}"):
                if self.met("case"):
                    self.expression()
                    self.take(":")
                elif self.met("default"):
                    self.take(":")
                else:
                    self.statement()
        elif kind == "try":
            self.at += 1
            self.block()
            if self.met("catch"):
                if self.kind == "(":
                    self.skip("(")
                self.block()
                if self.met("finally"):
                    self.block()
            else:
                self.take("finally")
                self.block()
        elif kind in ("return", "throw"):
            self.at += 1
            if not self.line and self.kind not in (";", "}", "end"):
                self.sequence()
            self.ends()
        elif kind in ("break", "continue", "debugger"):
            self.at += 1
            if not self.line:
                self.met("id")
            self.ends()
        elif kind == "id" and self.ahead(1) == ":":
            self.at += 2
            self.statement()
        else:
            start = self.at
            self.sequence()
            if top and not self.typed:
                self.required(start)
            self.ends()

    def block(self) -> None:
        self.take("{")
        while not self.met("}"):
            self.statement()

    def condition(self) -> None:
        self.take("(")
        self.sequence()
        self.take(")")

    def sequence(self) -> None:
        self.expression()
        while self.met(","):
            self.expression()

    def variables(self, found: Callable[[str, str], None], top: bool) -> None:
        while True:
            name = None
            if self.kind in ("{", "["):
                self.skip(self.kind)
            else:
                name = self.take("id")
            if self.typed:
                self.met("!")
                if self.met(":"):
                    self.type()
            kind = None
            if self.met("="):
                start = self.at
                kind = self.expression()
                if top and not self.typed:
                    self.required(start)
            if name:
                found(name, "func" if kind in ("arrow", "function") else "var")
            if not self.met(","):
                return

    def required(self, start: int) -> None:
        """Notes the module if what was read from start is a call of require with one string."""
        here = self.tokens[start : self.at]
        if len(here) == 4 and [t[1] for t in here[:2]] == ["require", "("] and here[2][0] == "str":
            self.imports.add(here[2][1][1:-1])

    def function(self) -> tuple[str, bool]:
        """Name of a function, and whether it has a body."""
        self.take("function")
        self.met("*")
        name = self.take("id") if self.kind == "id" else ""
        self.generics()
        self.skip("(")
        if self.typed and self.met(":"):
            self.type()
        if self.kind == "{":
            self.block()
            return name, True
        if not self.typed:
            raise Failed
        self.ends()
        return name, False

    def class_(self) -> str:
        self.take("class")
        name = self.take("id") if self.kind == "id" and not self.says("implements") else ""
        self.generics()
        if self.met("extends"):
            self.postfix()
            self.generics()
        if self.says("implements"):
            self.at += 1
            self.type()
            while self.met(","):
                self.type()
        self.skip("{")
        return name

    # --- types

    def generics(self) -> None:
        """Type parameters or arguments, if any: what stands between < and its >."""
        if self.kind != "<":
            return
        depth = 0
        while True:
            if self.kind in OPENS:
                self.skip(self.kind)
                continue
            if self.kind in CLOSES or self.kind in ("end", ";") or self.kind in BINARY - {"<", ">", ">>", ">>>", "|", "&", "=", "-", "in"}:
                raise Failed
            depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(self.kind, 0)
            self.at += 1
            if depth <= 0:
                return

    def type(self) -> None:
        self.depth += 1
        if self.depth > 150:
            raise Failed
        while self.kind in TYPE_PREFIX or self.says(*TYPE_PREFIX) and self.tokens[self.at + 1][0] not in (",", ";", ")", "]", "}", ">", "=", "|", "&", "end", "=>", ".", "["):
            self.at += 1
        if self.kind == "<":
            self.generics()
        if self.kind == "(":
            self.skip("(")
            if self.met("=>"):
                self.type()
        elif self.kind in ("{", "["):
            self.skip(self.kind)
        else:
            self.met("-")
            if self.kind == "import":
                self.at += 1
                self.skip("(")
            else:
                self.take("id", "str", "num", "template", "void", "null", "true", "false", "this", "typeof")
            while self.met("."):
                self.take("id", *RESERVED)
            self.generics()
        while self.kind == "[" and not self.line:
            self.skip("[")
        if self.met("|", "&"):
            self.type()
        if self.says("is"):
            self.at += 1
            self.type()
        if self.kind == "extends" and self.could(self.conditional):
            pass
        self.depth -= 1

    def conditional(self) -> None:
        self.take("extends")
        self.type()
        self.take("?")
        self.type()
        self.take(":")
        self.type()

    # --- expressions

    def expression(self) -> str:
        """Kind of the whole: arrow, function, or other."""
        self.depth += 1
        if self.depth > 150:
            raise Failed
        kind = self.expression_of()
        self.depth -= 1
        return kind

    def expression_of(self) -> str:
        if self.arrow():
            return "arrow"
        whole = "function" if self.kind == "function" and self.ahead(1) != "*" or self.says("async") and self.ahead(1) == "function" and self.ahead(2) != "*" else "other"
        while True:
            while self.met(*PREFIX) or self.says("await", "yield") and self.tokens[self.at + 1][0] not in (",", ";", ")", "]", "}", "=>", "=", "."):
                self.at += self.says("await", "yield")
                self.met("*")
                whole = "other"
            if self.arrow():
                return whole if whole == "arrow" else "other"
            start = self.at
            self.postfix()
            if self.at > start + 1 and whole == "function" and self.tokens[self.at - 1][0] != "}":
                whole = "other"
            while self.typed and self.says("as", "satisfies") and not self.line:
                self.at += 1
                if not self.met("const"):
                    self.type()
                whole = "other"
            if self.met("?"):
                whole = "other"
                self.expression()
                self.take(":")
                self.expression()
                return whole
            if not self.met(*BINARY):
                return whole
            whole = "other"

    def arrow(self) -> bool:
        """Reads an arrow function, if one begins here."""

        def head() -> None:
            if self.says("async") and not self.tokens[self.at + 1][2] and self.ahead(1) != "=>":
                self.at += 1
            if self.kind == "id":
                self.at += 1
            else:
                if self.typed:
                    self.generics()
                self.skip("(")
                if self.typed and self.met(":"):
                    self.type()
            self.take("=>")

        if self.kind not in ("id", "(", "<") or not self.could(head):
            return False
        if self.kind == "{":
            self.block()
        else:
            self.expression()
        return True

    def postfix(self) -> None:
        kind = self.kind
        if self.says("async") and self.ahead(1) == "function":
            self.at += 1
            self.function()
        elif kind == "function":
            self.function()
        elif kind == "class":
            self.class_()
        elif kind == "@":
            self.at += 1
            self.postfix()
            return self.postfix()
        elif kind == "(":
            self.at += 1
            self.sequence()
            self.take(")")
        elif kind == "[":
            self.items("]")
        elif kind == "{":
            self.skip("{")
        elif kind == "<" and self.typed:
            self.generics()
            return self.postfix()
        elif kind == "import":
            self.at += 1
        else:
            self.take("id", "str", "num", "template", "regex", "markup", "this", "super", "null", "true", "false")
        while True:
            if self.met(".", "?."):
                if self.kind == "[":
                    self.at += 1
                    self.sequence()
                    self.take("]")
                elif self.kind == "(":
                    self.items(")")
                else:
                    self.take("id", *RESERVED)
            elif self.kind == "[" :
                self.at += 1
                self.sequence()
                self.take("]")
            elif self.kind == "(":
                self.items(")")
            elif self.kind == "template":
                self.at += 1
            elif self.kind in ("++", "--", "!") and not self.line and (self.kind != "!" or self.typed):
                self.at += 1
            elif self.kind == "<" and self.typed and self.could(self.arguments_of_type):
                pass
            else:
                return None

    def arguments_of_type(self) -> None:
        self.generics()
        if self.kind not in ("(", "template", ")", ",", ";", "]", "."):
            raise Failed

    def items(self, close: str) -> None:
        self.at += 1
        while self.kind != close:
            if not self.met(","):
                self.expression()
                if self.kind != close:
                    self.take(",")
        self.take(close)


def read(text: str, typed: bool, markup: bool) -> tuple[list[tuple[str, str, bool]], list[str], bool]:
    """Module-level symbols (name, kind, exported) in order, sorted imports, and whether it can't be read (then neither)."""
    try:
        reader = Reader(text, typed, markup)
        reader.module()
    except (Failed, RecursionError):
        return [], [], True
    return [s for s in reader.symbols if s[0]], sorted(reader.imports - {""}), False
