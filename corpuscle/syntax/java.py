"""Java: recursive-descent declarations and statements, precedence-climbing expressions."""

from __future__ import annotations

import re

from .base import BAD, END, Bad, Lexicon, Parser, lines_of

_NUMBER = r"(?:0[xX][\da-fA-F](?:_*[\da-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?[fFdDlL]?)(?![\w$])"
_ESC = r"\\(?:[btnfrs\"'\\\n]|[0-7]{1,3}|u+[\da-fA-F]{4})"


def _classify(t: str) -> str | None:
    c = t[0]
    if t[:2] == "//":
        return ""
    if t[:2] == "/*":
        return BAD if len(t) < 4 else ""
    if t[:3] == '"""':
        return '"' if len(t) > 5 and re.match(r'"""[ \t\f]*\n', t) else BAD
    if c == '"':
        return '"' if len(t) > 1 and re.fullmatch(rf'"(?:[^"\\\n]|{_ESC})*"', t) else BAD
    if c == "'":
        return '"' if re.fullmatch(rf"'(?:[^'\\\n]|{_ESC})'", t) else BAD
    if c.isdigit() or c == "." and len(t) > 1 and t != "...":
        return "0" if re.fullmatch(_NUMBER, t) else BAD
    if c in "#`\\":
        return BAD
    return None


LEX = Lexicon(
    rf"//[^\n]*|/\*.*?\*/|/\*|\"\"\"[ \t\f]*\n(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)[^'\n]*'|(?:[^\W\d]|\$)[\w$]*|{_NUMBER}|\d[\w.]*"
    r"|>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|[+\-*/%&|^]=|<<|\S",
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null "
    "var record sealed permits yield when non module open",
    ">>>= <<= >>= ... -> :: ++ -- && || == != <= >= += -= *= /= %= &= |= ^= <<",
    _classify,
)
K = LEX.chars
IDENT = frozenset("a") | LEX.set("var record sealed permits yield when non module open")
PRIMITIVE = LEX.set("boolean byte char double float int long short")
MODIFIERS = LEX.set("public protected private static abstract final native synchronized transient volatile strictfp default sealed")
ASSIGN = frozenset("=") | LEX.set(">>>= <<= >>= += -= *= /= %= &= |= ^=")
BINARY = {K["||"]: 1, K["&&"]: 2, "|": 3, "^": 4, "&": 5, K["=="]: 6, K["!="]: 6, "<": 7, ">": 7, K["<="]: 7, K[">="]: 7, K["instanceof"]: 7, K["<<"]: 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
SEEN: set[str] = set()
START_OF_OPERAND = IDENT | frozenset('("0!~') | LEX.set("this super new true false null switch") | PRIMITIVE


class Java(Parser):
    brackets = re.compile(r"[()]")
    last = ""

    # -- compilation unit
    def unit(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == ";":
            return i + 1
        if c == K["package"]:
            return self.need(self.qualified(i + 1), ";")
        if c == K["import"]:
            i += 1
            if s[i] == K["static"]:
                i += 1
            i = self.ident(i)
            while s[i] == ".":
                if s[i + 1] == "*":
                    i += 2
                    break
                i = self.ident(i + 1)
            return self.need(i, ";")
        j = self.modifiers(i)
        if self.starts_type(j):
            return self.type_decl(j)
        if s[i] == "@":
            raise Bad(j)
        raise Bad(j, "invalid token" if s[j] == BAD else "unexpected token")

    def ident(self, i: int) -> int:
        if self.s[i] not in IDENT:
            raise Bad(i, "invalid token" if self.s[i] == BAD else "unexpected token")
        return i + 1

    def qualified(self, i: int) -> int:
        i = self.ident(i)
        while self.s[i] == ".":
            i = self.ident(i + 1)
        return i

    def modifiers(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == "@" and s[i + 1] != K["interface"]:
                i = self.annotation(i)
            elif s[i] == K["non"] and s[i + 1] == "-" and s[i + 2] == K["sealed"]:
                i += 3
            elif s[i] in MODIFIERS and not (s[i] == K["default"] and s[i + 1] in (":", K["->"])) and not (s[i] == K["sealed"] and s[i + 1] not in MODIFIERS and s[i + 1] not in (K["class"], K["interface"])):
                i += 1
            else:
                return i

    def annotation(self, i: int) -> int:
        s = self.s
        i = self.qualified(i + 1)
        if s[i] == "(":
            i += 1
            while s[i] != ")":
                if s[i] in IDENT and s[i + 1] == "=":
                    i += 2
                i = self.element_value(i)
                if s[i] != ",":
                    break
                i += 1
            return self.need(i, ")")
        return i

    def element_value(self, i: int) -> int:
        s = self.s
        if s[i] == "@":
            return self.annotation(i)
        if s[i] == "{":
            i += 1
            while s[i] != "}":
                i = self.element_value(i)
                if s[i] != ",":
                    break
                i += 1
            return self.need(i, "}")
        return self.conditional(i)

    def starts_type(self, i: int) -> bool:
        s = self.s
        c = s[i]
        return c in (K["class"], K["interface"], K["enum"]) or c == "@" and s[i + 1] == K["interface"] or c == K["record"] and s[i + 1] in IDENT and s[i + 2] in "(<"

    def type_decl(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "@":
            i += 1
        i = self.ident(i + 1)
        if s[i] == "<":
            i = self.type_params(i)
        if c == K["record"]:
            i = self.params(i)
        if s[i] == K["extends"]:
            i = self.type_list(i + 1) if c == K["interface"] else self.type(i + 1)
        if s[i] == K["implements"]:
            i = self.type_list(i + 1)
        if s[i] == K["permits"]:
            i = self.type_list(i + 1)
        i = self.need(i, "{")
        if c == K["enum"]:
            i = self.enum_constants(i)
        return self.need(self.block_items(i, self.member, "}"), "}")

    def enum_constants(self, i: int) -> int:
        s = self.s
        while s[i] not in ";}":
            while s[i] == "@":
                i = self.annotation(i)
            i = self.ident(i)
            if s[i] == "(":
                i = self.args(i)
            if s[i] == "{":
                i = self.class_body(i)
            if s[i] != ",":
                break
            i += 1
        if s[i] == ";":
            return i + 1
        if s[i] != "}":
            raise Bad(i)
        return i

    def class_body(self, i: int) -> int:
        return self.need(self.block_items(self.need(i, "{"), self.member, "}"), "}")

    def member(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        if s[i] == "{":
            return self.block(i)
        if s[i] == K["static"] and s[i + 1] == "{":
            return self.block(i + 1)
        i = self.modifiers(i)
        if self.starts_type(i):
            return self.type_decl(i)
        if s[i] == "<":
            i = self.type_params(i)
        if s[i] in IDENT and s[i + 1] == "(":  # constructor
            return self.method_rest(self.params(i + 1), True)
        if s[i] in IDENT and s[i + 1] == "{":  # compact constructor of a record
            return self.block(i + 1)
        if s[i] == K["void"]:
            i = self.ident(i + 1)
            return self.method_rest(self.params(i), False)
        i = self.ident(self.type(i))
        if s[i] == "(":
            return self.method_rest(self.params(i), False)
        return self.need(self.declarators(i), ";")

    def method_rest(self, i: int, must: bool) -> int:
        s = self.s
        while s[i] == "[":
            i = self.need(i + 1, "]")
        if s[i] == K["throws"]:
            i = self.type_list(i + 1)
        if s[i] == K["default"]:
            i = self.element_value(i + 1)
        if s[i] == ";" and not must:
            return i + 1
        return self.block(i)

    def params(self, i: int) -> int:
        s = self.s
        i = self.need(i, "(")
        while s[i] != ")":
            i = self.modifiers(i)
            i = self.type(i)
            if s[i] == "@":
                i = self.annotation(i)
            if s[i] == K["..."]:
                i += 1
            if s[i] == K["this"]:
                i += 1
            else:
                i = self.ident(i)
                if s[i] == "." and s[i + 1] == K["this"]:
                    i += 2
            while s[i] == "[":
                i = self.need(i + 1, "]")
            if s[i] != ",":
                break
            i += 1
            if s[i] == ")":
                raise Bad(i)
        return self.need(i, ")")

    def declarators(self, i: int) -> int:
        """Behind the first name of a field or variable."""
        s = self.s
        while True:
            while s[i] == "[":
                i = self.need(i + 1, "]")
            if s[i] == "=":
                i = self.initializer(i + 1)
            if s[i] != ",":
                return i
            i = self.ident(i + 1)

    def initializer(self, i: int) -> int:
        return self.array_init(i) if self.s[i] == "{" else self.expr(i)

    def array_init(self, i: int) -> int:
        s = self.s
        i += 1
        while s[i] != "}":
            i = self.initializer(i)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "}")

    # -- types
    def type(self, i: int) -> int:
        s = self.s
        while s[i] == "@":
            i = self.annotation(i)
        if s[i] in PRIMITIVE:
            i += 1
        else:
            i = self.ident(i)
            if s[i] == "<":
                i = self.type_args(i)
            while s[i] == "." and (s[i + 1] in IDENT or s[i + 1] == "@"):
                i += 1
                while s[i] == "@":
                    i = self.annotation(i)
                i = self.ident(i)
                if s[i] == "<":
                    i = self.type_args(i)
        while s[i] == "[" and s[i + 1] == "]":
            i += 2
        return i

    def type_args(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == ">":
            return i + 1
        while True:
            while s[i] == "@":
                i = self.annotation(i)
            if s[i] == "?":
                i += 1
                if s[i] in (K["extends"], K["super"]):
                    i = self.type(i + 1)
            else:
                i = self.type(i)
            if s[i] != ",":
                return self.need(i, ">")
            i += 1

    def type_params(self, i: int) -> int:
        s = self.s
        i += 1
        while True:
            while s[i] == "@":
                i = self.annotation(i)
            i = self.ident(i)
            if s[i] == K["extends"]:
                i = self.type(i + 1)
                while s[i] == "&":
                    i = self.type(i + 1)
            if s[i] != ",":
                return self.need(i, ">")
            i += 1

    def type_list(self, i: int) -> int:
        i = self.type(i)
        while self.s[i] == ",":
            i = self.type(i + 1)
        return i

    # -- statements
    def block(self, i: int) -> int:
        return self.need(self.block_items(self.need(i, "{"), self.block_statement, "}"), "}")

    def block_statement(self, i: int) -> int:
        return self.remembered(SEEN, self.block_statement_, i)

    def block_statement_(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in (K["final"], K["abstract"], K["static"], K["strictfp"], "@") or self.starts_type(i) or c == K["sealed"] and s[i + 1] == K["class"]:
            i = self.modifiers(i)
            if self.starts_type(i):
                return self.type_decl(i)
            return self.need(self.declarators(self.ident(self.type(i))), ";")
        if self.is_local(i):
            return self.need(self.declarators(self.ident(self.type(i))), ";")
        return self.statement(i)

    def is_local(self, i: int) -> bool:
        s = self.s
        c = s[i]
        if c in PRIMITIVE:
            return s[i + 1] in IDENT or s[i + 1] == "["
        if c not in IDENT:
            return False
        n = s[i + 1]
        if n in IDENT:
            return not (c == K["yield"])
        if n in "<.[":
            try:
                return s[self.type(i)] in IDENT
            except Bad:
                return False
        return False

    def paren(self, i: int) -> int:
        return self.need(self.expr(self.need(i, "(")), ")")

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == ";":
            return i + 1
        if c == "{":
            return self.block(i)
        if c in IDENT and s[i + 1] == ":":
            return self.statement(i + 2)
        w = LEX.names.get(c)
        if w == "if":
            i = self.statement(self.paren(i + 1))
            return self.statement(i + 1) if s[i] == K["else"] else i
        if w == "while":
            return self.statement(self.paren(i + 1))
        if w == "do":
            i = self.need(self.statement(i + 1), K["while"])
            return self.need(self.paren(i), ";")
        if w == "for":
            return self.for_(i)
        if w == "switch":
            i = self.switch(i)
            return i
        if w == "try":
            return self.try_(i)
        if w == "return":
            return i + 2 if s[i + 1] == ";" else self.need(self.expr(i + 1), ";")
        if w == "throw":
            return self.need(self.expr(i + 1), ";")
        if w in ("break", "continue"):
            return self.need(i + 2 if s[i + 1] in IDENT else i + 1, ";")
        if w == "yield" and s[i + 1] not in ASSIGN and s[i + 1] not in (".", "[", "(", K["++"], K["--"]):
            return self.need(self.expr(i + 1), ";")
        if w == "synchronized":
            return self.block(self.paren(i + 1))
        if w == "assert":
            i = self.expr(i + 1)
            if s[i] == ":":
                i = self.expr(i + 1)
            return self.need(i, ";")
        j = self.expr(i)
        if self.last not in ("call", "assign"):
            raise Bad(j, "not a statement")
        return self.need(j, ";")

    def for_(self, i: int) -> int:
        s = self.s
        i = self.need(i + 1, "(")
        if s[i] != ";":
            j = self.modifiers(i)
            if j > i or self.is_local(i):
                i = self.ident(self.type(j))
                if s[i] == ":":
                    return self.statement(self.need(self.expr(i + 1), ")"))
                i = self.declarators(i)
            else:
                i = self.expr_list(i)
        i = self.need(i, ";")
        if s[i] != ";":
            i = self.expr(i)
        i = self.need(i, ";")
        if s[i] != ")":
            i = self.expr_list(i)
        return self.statement(self.need(i, ")"))

    def expr_list(self, i: int) -> int:
        i = self.expr(i)
        while self.s[i] == ",":
            i = self.expr(i + 1)
        return i

    def try_(self, i: int) -> int:
        s = self.s
        i += 1
        resources = s[i] == "("
        if resources:
            i += 1
            while s[i] != ")":
                j = self.modifiers(i)
                if j > i or self.is_local(i):
                    i = self.expr(self.need(self.ident(self.type(j)), "="))
                else:
                    i = self.expr(i)
                if s[i] != ";":
                    break
                i += 1
            i = self.need(i, ")")
        i = self.block(i)
        if not resources and s[i] not in (K["catch"], K["finally"]):
            raise Bad(i, "try without catch or finally")
        while s[i] == K["catch"]:
            i = self.modifiers(self.need(i + 1, "("))
            i = self.type(i)
            while s[i] == "|":
                i = self.type(i + 1)
            i = self.block(self.need(self.ident(i), ")"))
        return self.block(i + 1) if s[i] == K["finally"] else i

    def switch(self, i: int) -> int:
        s = self.s
        i = self.need(self.paren(i + 1), "{")
        while s[i] != "}":
            if s[i] == K["case"]:
                i += 1
                while True:
                    i = self.label(i)
                    if s[i] != ",":
                        break
                    i += 1
                if s[i] == K["when"]:
                    i = self.expr(i + 1)
            elif s[i] == K["default"]:
                i += 1
            else:
                raise Bad(i, "missing bracket" if s[i] == END else "unexpected token")
            if s[i] == K["->"]:
                i += 1
                if s[i] == "{":
                    i = self.block(i)
                elif s[i] == K["throw"]:
                    i = self.statement(i)
                else:
                    i = self.need(self.expr(i), ";")
                continue
            i = self.need(i, ":")
            while s[i] not in ("}", K["case"]) and not (s[i] == K["default"] and s[i + 1] in (":", K["->"])):
                if s[i] == END:
                    raise Bad(i, "missing bracket")
                i = self.block_statement(i)
        return i + 1

    def label(self, i: int) -> int:
        s = self.s
        if s[i] == K["default"]:
            return i + 1
        if s[i] in IDENT:
            try:
                return self.pattern(i)
            except Bad:
                pass
        old, self.no_lambda = self.no_lambda, True
        i = self.conditional(i)
        self.no_lambda = old
        return i

    no_lambda = False

    def pattern(self, i: int) -> int:
        s = self.s
        i = self.modifiers(i)
        i = self.type(i)
        if s[i] == "(":
            i += 1
            while s[i] != ")":
                i = self.pattern(i)
                if s[i] != ",":
                    break
                i += 1
            i = self.need(i, ")")
            return i + 1 if s[i] in IDENT and s[i] != K["when"] else i
        return self.ident(i)

    # -- expressions
    def expr(self, i: int) -> int:
        s = self.s
        if not self.no_lambda:
            e = self.lambda_(i)
            if e >= 0:
                self.last = "lambda"
                return e
        i = self.conditional(i)
        if s[i] in ASSIGN or s[i] == ">" and s[i + 1] in ">" + K[">="]:
            while s[i] == ">":
                i += 1
            if self.last != "target":
                raise Bad(i, "no target")
            i = self.expr(i + 1)
            self.last = "assign"
        return i

    def lambda_(self, i: int) -> int:
        s = self.s
        if s[i] in IDENT:
            if s[i + 1] != K["->"]:
                return -1
            i += 2
        elif s[i] == "(":
            j = self.partner(i)
            if j < 0:
                return -1
            if s[j + 1] != K["->"]:
                return -1
            k = i + 1
            if s[k] in IDENT and s[k + 1] in ",)":
                while s[k + 1] == ",":
                    k = self.ident(k) + 1
                k = self.need(self.ident(k), ")")
            else:
                k = self.params(i)
            i = self.need(k, K["->"])
        else:
            return -1
        return self.block(i) if s[i] == "{" else self.expr(i)

    def conditional(self, i: int) -> int:
        s = self.s
        i = self.binary(i, 1)
        if s[i] == "?":
            old, self.no_lambda = self.no_lambda, False
            i = self.expr(i + 1)
            self.no_lambda = old
            i = self.need(i, ":")
            e = -1 if self.no_lambda else self.lambda_(i)
            i = e if e >= 0 else self.conditional(i)
            self.last = "value"
        return i

    def binary(self, i: int, level: int) -> int:
        s = self.s
        i = self.unary(i)
        while True:
            c = s[i]
            p = BINARY.get(c, 0)
            if p < level or not p:
                return i
            if c == K["instanceof"]:
                i += 1
                try:
                    i = self.pattern(i)
                except Bad:
                    i = self.type(self.modifiers(i))
                self.last = "value"
                continue
            if c == ">":
                j = i
                while s[j + 1] == ">":
                    j += 1
                if j > i and s[j + 1] == K[">="] or s[i + 1] == K[">="]:
                    return i
                i = j
            i = self.binary(i + 1, p + 1)
            self.last = "value"

    def unary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "!~+-" and c != END:
            i = self.unary(i + 1)
            self.last = "value"
            return i
        if c == K["++"] or c == K["--"]:
            i = self.unary(i + 1)
            if self.last != "target":
                raise Bad(i, "no target")
            self.last = "assign"
            return i
        if c == "(":
            e = self.cast(i)
            if e >= 0:
                self.last = "value"
                return e
        i = self.primary(i)
        if s[i] == K["++"] or s[i] == K["--"]:
            if self.last != "target":
                raise Bad(i, "no target")
            self.last = "assign"
            i += 1
        return i

    def cast(self, i: int) -> int:
        s = self.s
        if s[i + 1] in PRIMITIVE:
            try:
                j = self.type(i + 1)
            except Bad:
                return -1
            return self.unary(j + 1) if s[j] == ")" else -1
        if s[i + 1] not in IDENT and s[i + 1] != "@":
            return -1
        try:
            j = self.type(i + 1)
            while s[j] == "&":
                j = self.type(j + 1)
        except Bad:
            return -1
        if s[j] != ")" or s[j + 1] not in START_OF_OPERAND:
            return -1
        e = self.lambda_(j + 1)
        return e if e >= 0 else self.unary(j + 1)

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        self.last = "value"
        if c in IDENT:
            i += 1
            if s[i] == "(":
                i = self.args(i)
                self.last = "call"
            elif s[i] in "<[" and self.is_ref_type(i - 1):
                i = self.type(i - 1)
                if s[i] == "." and s[i + 1] == K["class"]:
                    return i + 2
                i = self.need(i, K["::"])
                i = i + 1 if s[i] == K["new"] else self.ident(i)
                self.last = "value"
            else:
                self.last = "target"
        elif c in '"0' or c in (K["true"], K["false"], K["null"]):
            i += 1
        elif c == K["this"] or c == K["super"]:
            i += 1
            if s[i] == "(":
                i = self.args(i)
                self.last = "call"
            elif c == K["super"] and s[i] not in (".", K["::"]):
                raise Bad(i)
        elif c == "(":
            old, self.no_lambda = self.no_lambda, False
            i = self.need(self.expr(i + 1), ")")
            self.no_lambda = old
            self.last = "target" if self.last == "target" else "value"
        elif c == K["new"]:
            i = self.new(i)
        elif c == K["switch"]:
            i = self.switch(i)
            return i
        elif c in PRIMITIVE or c == K["void"]:
            i = i + 1 if c == K["void"] else self.type(i)
            if s[i] == "." and s[i + 1] == K["class"]:
                return i + 2
            i = self.need(self.need(i, K["::"]), K["new"])
        else:
            raise Bad(i, "invalid token" if c == BAD else "missing bracket" if c == END else "unexpected token")
        while True:
            c = s[i]
            if c == ".":
                i += 1
                if s[i] == "<":
                    i = self.type_args(i)
                if s[i] in IDENT:
                    i += 1
                    self.last = "target"
                    if s[i] == "(":
                        i = self.args(i)
                        self.last = "call"
                elif s[i] in (K["class"], K["this"]):
                    i += 1
                    self.last = "value"
                elif s[i] == K["super"]:
                    i += 1
                    if s[i] == "(":
                        i = self.args(i)
                        self.last = "call"
                elif s[i] == K["new"]:
                    i = self.new(i)
                else:
                    raise Bad(i)
            elif c == "[":
                if s[i + 1] == "]":
                    raise Bad(i + 1)
                i = self.need(self.expr(i + 1), "]")
                self.last = "target"
            elif c == K["::"]:
                i += 1
                if s[i] == "<":
                    i = self.type_args(i)
                i = i + 1 if s[i] == K["new"] else self.ident(i)
                self.last = "value"
            else:
                return i

    def is_ref_type(self, i: int) -> bool:
        """Whether a generic or array type begins here that a method reference or .class follows."""
        s = self.s
        if s[i + 1] == "[" and s[i + 2] != "]":
            return False
        try:
            j = self.type(i)
        except Bad:
            return False
        return s[j] == K["::"] or s[j - 1] == "]" and s[j] == "." and s[j + 1] == K["class"]

    def new(self, i: int) -> int:
        s = self.s
        i += 1
        while s[i] == "@":
            i = self.annotation(i)
        if s[i] == "<":
            i = self.type_args(i)
        if s[i] in PRIMITIVE:
            i += 1
        else:
            i = self.ident(i)
            if s[i] == "<":
                i = self.type_args(i)
            while s[i] == ".":
                i = self.ident(i + 1)
                if s[i] == "<":
                    i = self.type_args(i)
        if s[i] == "[":
            sized = False
            while s[i] == "[":
                if s[i + 1] == "]":
                    i += 2
                elif s[i - 1] == "]" and not sized:
                    break
                else:
                    i = self.need(self.expr(i + 1), "]")
                    sized = True
            if s[i] == "{" and not sized:
                i = self.array_init(i)
            elif not sized:
                raise Bad(i)
            self.last = "value"
            return i
        i = self.args(i)
        if s[i] == "{":
            i = self.class_body(i)
        self.last = "call"
        return i

    def args(self, i: int) -> int:
        s = self.s
        old, self.no_lambda = self.no_lambda, False
        i = self.need(i, "(")
        if s[i] != ")":
            i = self.expr_list(i)
        self.no_lambda = old
        return self.need(i, ")")


def check(text: str) -> list[tuple[int, str]]:
    p = Java(LEX.lex(text.replace("\r\n", "\n")))
    p.top(p.unit)
    if not p.errors:
        return []
    text = text.replace("\r\n", "\n")
    offs = LEX.offsets(text)
    return list(zip(lines_of(text, [offs[at] if at < len(offs) else len(text) for at, _ in p.errors]), [what for _, what in p.errors]))
