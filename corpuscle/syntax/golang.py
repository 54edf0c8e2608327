"""Go: recursive-descent declarations and statements, precedence-climbing expressions."""

from __future__ import annotations

import re

from .base import BAD, END, Bad, Lexicon, Parser, lines_of

_NUMBER = r"(?:0[xX](?:_?[\da-fA-F])+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)i?(?!\w)"
_ESC = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8})"
_STRING = rf'"(?:[^"\\\n]|{_ESC})*"'
_RUNE = rf"'(?:[^'\\\n]|{_ESC})'"


def _classify(t: str) -> str | None:
    c = t[0]
    if c == "\n":
        return "\n"
    if t[:2] == "//":
        return ""
    if t[:2] == "/*":
        return BAD if len(t) < 4 else "\n" if "\n" in t else ""
    if c == '"':
        return '"' if len(t) > 1 and re.fullmatch(_STRING, t) else BAD
    if c == "'":
        return "0" if len(t) > 1 and re.fullmatch(_RUNE, t) else BAD
    if c == "`":
        return '"' if len(t) > 1 else BAD
    if c.isdigit() or c == "." and len(t) > 1 and t != "...":
        return "0" if re.fullmatch(_NUMBER, t) else BAD
    if c in "$@#?":
        return BAD
    return None


LEX = Lexicon(
    rf"\n\s*|//[^\n]*|/\*.*?\*/|/\*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)[^'\n]*'|`[^`]*`|[^\W\d]\w*|{_NUMBER}|\d[\w.]*"
    r"|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[+\-*/%&|^]=|<<|>>|&\^|\S",
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^",
    _classify,
)
K = LEX.chars
_SEMI = re.compile('(?<=[a0")\\]}' + re.escape("".join(K[w] for w in "break continue fallthrough return ++ --".split())) + "])\n+|(?<=[a0\")\\]}])\\Z")
ASSIGN = frozenset("=") | LEX.set(":= <<= >>= &^= += -= *= /= %= &= |= ^=")
BINARY = {K["||"]: 1, K["&&"]: 2, K["=="]: 3, K["!="]: 3, "<": 3, K["<="]: 3, ">": 3, K[">="]: 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, K["<<"]: 5, K[">>"]: 5, "&": 5, K["&^"]: 5}
UNARY = frozenset("+-!^*&") | {K["<-"]}
TYPE_START = frozenset("a[*(") | LEX.set("func struct interface map chan <-")
SEEN: set[str] = set()


class Go(Parser):
    no_lit = False  # in the head of if, for and switch a brace begins the block

    def __init__(self, kinds: str):
        super().__init__(kinds)
        self.last = ""

    def semi(self, i: int) -> int:
        if self.s[i] == ";":
            return i + 1
        if self.s[i] in ")}\0":
            return i
        raise Bad(i, "invalid token" if self.s[i] == BAD else "unexpected token")

    # -- file
    def file(self) -> None:
        s, i = self.s, 0
        while s[i] == ";":
            i += 1
        try:
            i = self.semi(self.need(self.need(i, K["package"], "no package clause"), "a"))
            while s[i] == K["import"]:
                i = self.semi(self.group(i + 1, self.import_spec))
        except Bad as e:
            self.errors.append((e.at, e.what))
            i = max(self.sync(e.at), i + 1)
        end = len(s) - 8
        while i < end:
            try:
                i = self.top_decl(i)
            except Bad as e:
                self.errors.append((e.at, e.what))
                i = max(self.sync(e.at), i + 1)

    def group(self, i: int, spec) -> int:
        s = self.s
        if s[i] != "(":
            return spec(i)
        i += 1
        while s[i] != ")":
            i = self.semi(spec(i))
            if s[i] == END:
                raise Bad(i, "missing bracket")
        return i + 1

    def import_spec(self, i: int) -> int:
        if self.s[i] in "a.":
            i += 1
        return self.need(i, '"')

    def top_decl(self, i: int) -> int:
        c = self.s[i]
        if c == ";":
            return i + 1
        if c == K["func"]:
            return self.semi(self.func_decl(i))
        if c in (K["var"], K["const"], K["type"]):
            return self.semi(self.declaration(i))
        raise Bad(i, "invalid token" if c == BAD else "unexpected token")

    def func_decl(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == "(":
            i = self.params(i)
        i = self.need(i, "a")
        if s[i] == "[":
            i = self.type_params(i)
        i = self.signature(i)
        return self.block(i) if s[i] == "{" else i

    def type_params(self, i: int) -> int:
        s = self.s
        i += 1
        while s[i] != "]":
            i = self.need(i, "a")
            while s[i] == ",":
                i = self.need(i + 1, "a")
            i = self.constraint(i)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "]")

    def constraint(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == "~":
                i += 1
            i = self.type(i)
            if s[i] != "|":
                return i
            i += 1

    def signature(self, i: int) -> int:
        i = self.params(i)
        if self.s[i] == "(":
            return self.params(i)
        return self.type(i) if self.s[i] in TYPE_START else i

    def params(self, i: int) -> int:
        """Names and types; all have names or none has."""
        s = self.s
        i = self.need(i, "(")
        named = bare = False
        while s[i] != ")":
            if s[i] == "a" and s[i + 1] not in ",).[" or s[i] == "a" and s[i + 1] == "[" and self.array_after_name(i + 1):
                named = True
                i += 1
                if s[i] == K["..."]:
                    i += 1
                i = self.type(i)
            else:
                if s[i] == K["..."]:
                    i += 1
                    bare = True
                bare = bare or s[i] != "a"
                i = self.type(i)
            if s[i] != ",":
                break
            i += 1
        if named and bare:
            raise Bad(i, "mixed named and unnamed parameters")
        return self.need(i, ")")

    def array_after_name(self, i: int) -> bool:
        """Whether name[...] at a parameter is a name with an array type rather than a generic type."""
        s = self.s
        if s[i + 1] == "]":
            return True
        depth = 0
        while s[i] != END:
            depth += (s[i] == "[") - (s[i] == "]")
            if not depth:
                break
            i += 1
        return s[i + 1] in TYPE_START

    def block(self, i: int) -> int:
        old, self.no_lit = self.no_lit, False
        i = self.need(self.block_items(self.need(i, "{"), self.statement, "}"), "}")
        self.no_lit = old
        return i

    # -- declarations
    def declaration(self, i: int) -> int:
        c = self.s[i]
        return self.group(i + 1, self.var_spec if c == K["var"] else self.const_spec if c == K["const"] else self.type_spec)

    def names(self, i: int) -> int:
        i = self.need(i, "a")
        while self.s[i] == ",":
            i = self.need(i + 1, "a")
        return i

    def var_spec(self, i: int) -> int:
        i = self.names(i)
        if self.s[i] != "=":
            i = self.type(i)
        return self.expr_list(i + 1) if self.s[i] == "=" else i

    def const_spec(self, i: int) -> int:
        i = self.names(i)
        if self.s[i] in TYPE_START:
            i = self.type(i)
        return self.expr_list(i + 1) if self.s[i] == "=" else i

    def type_spec(self, i: int) -> int:
        s = self.s
        i = self.need(i, "a")
        if s[i] == "[" and s[i + 1] == "a" and s[i + 2] not in "]":
            try:
                return self.type(self.type_params(i))
            except Bad:
                pass
        if s[i] == "=":
            i += 1
        return self.type(i)

    def type(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "a":
            i += 1
            if s[i] == ".":
                i = self.need(i + 1, "a")
            if s[i] == "[" and s[i + 1] in TYPE_START:
                i = self.type(i + 1)
                while s[i] == "," and s[i + 1] != "]":
                    i = self.type(i + 1)
                return self.need(i, "]")
            return i
        if c == "*":
            return self.type(i + 1)
        if c == "(":
            return self.need(self.type(i + 1), ")")
        if c == "[":
            if s[i + 1] == "]":
                return self.type(i + 2)
            if s[i + 1] == K["..."]:
                return self.type(self.need(i + 2, "]"))
            old, self.no_lit = self.no_lit, False
            i = self.need(self.expr(i + 1), "]")
            self.no_lit = old
            return self.type(i)
        if c == K["map"]:
            return self.type(self.need(self.type(self.need(i + 1, "[")), "]"))
        if c == K["chan"]:
            return self.type(i + 2 if s[i + 1] == K["<-"] else i + 1)
        if c == K["<-"]:
            return self.type(self.need(i + 1, K["chan"]))
        if c == K["func"]:
            return self.signature(i + 1)
        if c == K["struct"]:
            i = self.need(i + 1, "{")
            while s[i] != "}":
                if s[i] == "*" or s[i] == "a" and s[i + 1] in '.;"}':
                    i = self.type(i + (s[i] == "*"))
                else:
                    i = self.type(self.names(i))
                if s[i] == '"':
                    i += 1
                i = self.semi(i)
                if s[i] == END:
                    raise Bad(i, "missing bracket")
            return i + 1
        if c == K["interface"]:
            i = self.need(i + 1, "{")
            while s[i] != "}":
                if s[i] == "a" and s[i + 1] == "(":
                    i = self.signature(i + 1)
                else:
                    i = self.constraint(i)
                i = self.semi(i)
                if s[i] == END:
                    raise Bad(i, "missing bracket")
            return i + 1
        raise Bad(i, "invalid token" if c == BAD else "unexpected token")

    # -- statements
    def statement(self, i: int) -> int:
        return self.remembered(SEEN, self.statement_, i)

    def statement_(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == ";":
            return i + 1
        w = LEX.names.get(c)
        if c == "{":
            return self.semi(self.block(i))
        if c == "a" and s[i + 1] == ":" and s[i + 2] != "=":
            return self.statement_(i + 2) if s[i + 2] != "}" else i + 2
        if w in ("var", "const", "type"):
            return self.semi(self.declaration(i))
        if w == "return":
            return self.semi(i + 1 if s[i + 1] in ";}" else self.expr_list(i + 1))
        if w == "if":
            return self.semi(self.if_(i))
        if w == "for":
            return self.semi(self.for_(i))
        if w == "switch":
            return self.semi(self.switch(i))
        if w == "select":
            return self.semi(self.cases(self.need(i + 1, "{"), self.simple))
        if w in ("go", "defer"):
            j = self.expr(i + 1)
            if self.last != "call":
                raise Bad(j, "expected a call")
            return self.semi(j)
        if w in ("break", "continue"):
            return self.semi(i + 2 if s[i + 1] == "a" else i + 1)
        if w == "goto":
            return self.semi(self.need(i + 1, "a"))
        if w == "fallthrough":
            return self.semi(i + 1)
        return self.semi(self.simple(i))

    def simple(self, i: int) -> int:
        s = self.s
        start = i
        i = self.expr_list(i)
        c = s[i]
        many = self.many
        if c in ASSIGN:
            if c == K[":="] and (s[start] != "a" or not set(s[start:i]) <= {"a", ","}):
                raise Bad(i, "no new name")
            if s[i + 1] == K["range"]:
                raise Bad(i + 1)
            return self.expr_list(i + 1)
        if c == K["++"] or c == K["--"]:
            return i + 1
        if c == K["<-"]:
            return self.expr(i + 1)
        if many:
            raise Bad(i)
        return i  # an unused value is no matter of syntax

    many = False

    def head(self, i: int) -> int:
        """simple; cond of an if or switch, up to the brace."""
        s = self.s
        old, self.no_lit = self.no_lit, True
        if s[i] != "{":
            if s[i] != ";":
                i = self.head_simple(i)
            if s[i] == ";":
                i += 1
                if s[i] != "{":
                    i = self.head_simple(i)
        self.no_lit = old
        return i

    def head_simple(self, i: int) -> int:
        s = self.s
        i = self.expr_list(i)
        if s[i] in ASSIGN:
            return self.expr_list(i + 1)
        return i + 1 if s[i] == K["++"] or s[i] == K["--"] else i

    def if_(self, i: int) -> int:
        s = self.s
        if s[i + 1] == "{":
            raise Bad(i + 1, "no condition")
        i = self.block(self.head(i + 1))
        if s[i] == K["else"]:
            if s[i + 1] == K["if"]:
                return self.if_(i + 1)
            return self.block(i + 1)
        return i

    def for_(self, i: int) -> int:
        s = self.s
        i += 1
        old, self.no_lit = self.no_lit, True
        if s[i] == K["range"]:
            i = self.expr(i + 1)
        elif s[i] != "{":
            if s[i] != ";":
                i = self.expr_list(i)
                if s[i] in ("=", K[":="]) and s[i + 1] == K["range"]:
                    i = self.expr(i + 2)
                elif s[i] in ASSIGN:
                    i = self.expr_list(i + 1)
                elif s[i] in (K["++"], K["--"]):
                    i += 1
            if s[i] == ";":
                i += 1
                if s[i] not in ";{":
                    i = self.expr(i)
                if s[i] == ";":
                    i += 1
                    if s[i] != "{":
                        i = self.head_simple(i)
                else:
                    raise Bad(i)
        self.no_lit = old
        return self.block(i)

    def switch(self, i: int) -> int:
        return self.cases(self.need(self.head(i + 1), "{"), self.case_list)

    def case_list(self, i: int) -> int:
        while True:
            i = self.expr(i)
            if self.s[i] != ",":
                return i
            i += 1

    def cases(self, i: int, rule) -> int:
        s = self.s
        old, self.no_lit = self.no_lit, False
        while s[i] != "}":
            if s[i] == K["case"]:
                i = rule(i + 1) if rule != self.simple else self.comm(i + 1)
            elif s[i] == K["default"]:
                i += 1
            else:
                raise Bad(i, "missing bracket" if s[i] == END else "unexpected token")
            i = self.need(i, ":")
            while s[i] not in ("}", K["case"], K["default"]):
                if s[i] == END:
                    raise Bad(i, "missing bracket")
                i = self.statement(i)
        self.no_lit = old
        return i + 1

    def comm(self, i: int) -> int:
        i = self.expr_list(i)
        if self.s[i] in ("=", K[":="], K["<-"]):
            i = self.expr(i + 1)
        return i

    # -- expressions
    def expr_list(self, i: int) -> int:
        i = self.expr(i)
        self.many = False
        if self.s[i] == ",":
            while self.s[i] == ",":
                i = self.expr(i + 1)
            self.many = True
        return i

    def expr(self, i: int) -> int:
        return self.binary(i, 1)

    def binary(self, i: int, level: int) -> int:
        s = self.s
        i = self.unary(i)
        while (p := BINARY.get(s[i], 0)) >= level:
            i = self.binary(i + 1, p + 1)
            self.last = "value"
        return i

    def unary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in UNARY:
            if c == K["<-"] and s[i + 1] == K["chan"]:
                return self.primary(i)
            i = self.unary(i + 1)
            self.last = "receive" if c == K["<-"] else "target" if c == "*" else "value"
            return i
        return self.primary(i)

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        self.last = "value"
        literal = False
        if c == "a":
            i += 1
            self.last, literal = "target", True
        elif c == "0" or c == '"':
            i += 1
        elif c == "(":
            old, self.no_lit = self.no_lit, False
            i = self.need(self.expr(i + 1), ")")
            self.no_lit = old
            if self.last == "call":
                self.last = "value"
        elif c == K["func"]:
            i = self.signature(i + 1)
            if s[i] == "{":
                i = self.block(i)
            self.last = "value"
        elif c == "[" or c in (K["map"], K["struct"], K["chan"], K["interface"], K["<-"]):
            i = self.type(i)
            self.last = "type"
            if s[i] == "{":
                i = self.composite(i)
        else:
            raise Bad(i, "invalid token" if c == BAD else "missing bracket" if c == END else "unexpected token")
        while True:
            c = s[i]
            if c == ".":
                if s[i + 1] == "(":
                    i += 2
                    i = self.need(i + 1 if s[i] == K["type"] else self.type(i), ")")
                    self.last, literal = "value", False
                else:
                    i = self.need(i + 1, "a")
                    self.last = "target"
            elif c == "(":
                i = self.call(i)
                self.last, literal = "call", False
            elif c == "[":
                i = self.index(i)
                self.last = "target"
            elif c == "{" and literal and not self.no_lit:
                i = self.composite(i)
                self.last, literal = "value", False
            else:
                return i

    def call(self, i: int) -> int:
        s = self.s
        old, self.no_lit = self.no_lit, False
        i += 1
        while s[i] != ")":
            i = self.expr(i)
            if s[i] == K["..."]:
                i += 1
            if s[i] != ",":
                break
            i += 1
        self.no_lit = old
        return self.need(i, ")")

    def index(self, i: int) -> int:
        s = self.s
        old, self.no_lit = self.no_lit, False
        i += 1
        if s[i] == "]":
            raise Bad(i)
        if s[i] != ":":
            i = self.expr(i)
            while s[i] == "," and s[i + 1] != "]":
                i = self.expr(i + 1)
        for _ in range(2):
            if s[i] == ":":
                i += 1
                if s[i] not in ":]":
                    i = self.expr(i)
        self.no_lit = old
        return self.need(i, "]")

    def composite(self, i: int) -> int:
        s = self.s
        old, self.no_lit = self.no_lit, False
        i += 1
        while s[i] != "}":
            i = self.element(i)
            if s[i] == ":":
                i = self.element(i + 1)
            if s[i] != ",":
                break
            i += 1
        self.no_lit = old
        self.last = "value"
        return self.need(i, "}")

    def element(self, i: int) -> int:
        return self.composite(i) if self.s[i] == "{" else self.expr(i)


def check(text: str) -> list[tuple[int, str]]:
    kinds = LEX.lex(text)
    joined = _SEMI.sub(";", kinds).replace("\n", "")
    p = Go(joined)
    p.file()
    if not p.errors:
        return []
    offs, keep, prev = LEX.offsets(text), [], 0
    for m in _SEMI.finditer(kinds):
        keep += [k for k in range(prev, m.start()) if kinds[k] != "\n"] + [min(m.start(), len(kinds) - 1)]
        prev = m.end()
    keep += [k for k in range(prev, len(kinds)) if kinds[k] != "\n"]
    return list(zip(lines_of(text, [offs[keep[at]] if at < len(keep) else len(text) for at, _ in p.errors]), [what for _, what in p.errors]))
