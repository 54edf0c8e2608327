"""Rust 2021: recursive-descent items and statements, precedence-climbing expressions. Macro input is any balanced tree."""

from __future__ import annotations

import re

from .base import BAD, END, Bad, Lexicon, Parser, lines_of

_NUMBER = r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![._a-zA-Z])[\d_]*|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?))(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)"
_STRING = r'b?c?"(?:[^"\\]|\\.)*"'
_CHAR = r"b?'(?:[^'\\\n]|\\(?:[nrt0\\'\"]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,6}\}))'"


def _classify(t: str) -> str | None:
    c = t[0]
    if t[:2] == "//":
        return ""
    if t[:2] == "/*":
        return BAD if len(t) < 4 else ""
    if t[-1] == '"' or t[-1] == "#" and '"' in t:
        return '"' if len(t) > 1 else BAD
    if c == "'" or t[:2] == "b'":
        if len(t) > 2 and t[-1] == "'":
            return '"' if re.fullmatch(_CHAR, t) else BAD
        return "'" if len(t) > 1 else BAD
    if c.isdigit():
        return "0" if re.fullmatch(_NUMBER, t) else BAD
    if t[:2] == "r#":
        return "a"
    if c in "`\\":
        return BAD
    return None


LEX = Lexicon(
    rf"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/|/\*|b?c?r(?P<h>#*)\"(?:.*?)\"(?P=h)|{_STRING}|{_CHAR}|b?'\\[^'\n]*'|'[^\W\d]\w*(?!')|r\#[^\W\d]\w*|[^\W\d]\w*|{_NUMBER}|\d\w*"
    r"|\.\.=|\.\.\.|\.\.|<<=|=>|==|!=|<=|->|::|[+\-*/%&|^]=|\S",
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while "
    "union auto default macro_rules",
    "..= ... .. <<= => == != <= -> :: += -= *= /= %= &= |= ^=",
    _classify,
)
# findall must give whole matches although the pattern has a group
LEX.lex = lambda text: "".join([LEX.kinds[m[0]] for m in LEX.pattern.finditer(text)])  # type: ignore[method-assign]
K = LEX.chars
IDENT = frozenset("a") | LEX.set("union auto default macro_rules")
PATH_START = IDENT | LEX.set("self Self super crate") | {"::"} | {K["::"]}
ASSIGN = frozenset("=") | LEX.set("<<= += -= *= /= %= &= |= ^=")
BINARY = {"*": 10, "/": 10, "%": 10, "+": 9, "-": 9, "<": 5, ">": 5, "&": 7, "^": 6, "|": 5.5, K["=="]: 5, K["!="]: 5, K["<="]: 5}
COMPARE = {"<", ">", K["=="], K["!="], K["<="]}
BLOCK_LIKE = LEX.set("if match while for loop unsafe") | {"{"}
SEEN: set[str] = set()
NO_OPERAND = frozenset(";),]}\0=") | {K["=>"]}


class Rust(Parser):
    no_struct = False

    def item_or_end(self, i: int) -> int:
        return self.item(i)

    def ident(self, i: int) -> int:
        if self.s[i] not in IDENT:
            raise Bad(i, "invalid token" if self.s[i] == BAD else "unexpected token")
        return i + 1

    # -- items
    def attributes(self, i: int) -> int:
        s = self.s
        while s[i] == "#":
            i += 1
            if s[i] == "!":
                i += 1
            if s[i] != "[":
                raise Bad(i)
            i = self.tree(i)
        return i

    def tree(self, i: int) -> int:
        """A balanced token tree."""
        s = self.s
        stack = []
        while True:
            c = s[i]
            if c in "([{":
                stack.append(")]}"["([{".index(c)])
            elif c in ")]}":
                if not stack or stack.pop() != c:
                    raise Bad(i, "missing bracket")
                if not stack:
                    return i + 1
            elif c == END:
                raise Bad(i, "missing bracket")
            elif c == BAD:
                raise Bad(i, "invalid token")
            i += 1

    def visibility(self, i: int) -> int:
        s = self.s
        if s[i] == K["pub"]:
            i += 1
            if s[i] == "(" and s[i + 1] in (K["crate"], K["self"], K["super"], K["in"]):
                i += 1
                i = self.path(i + 1) if s[i] == K["in"] else i + 1
                return self.need(i, ")")
        return i

    def item(self, i: int) -> int:
        s = self.s
        start = i
        i = self.attributes(i)
        if i > start and s[i] in "}\0" and s[start + 1] == "!":
            return i
        i = self.visibility(i)
        if s[i] == K["default"] and s[i + 1] in (K["fn"], K["impl"], K["unsafe"], K["async"], K["const"], K["type"]):
            i += 1
        j = i
        while s[j] in (K["const"], K["async"], K["unsafe"]) or s[j] == K["extern"]:
            if s[j] == K["extern"] and s[j + 1] == '"':
                j += 1
            j += 1
        if s[j] == K["fn"]:
            return self.fn(j)
        c = s[i]
        if c == K["unsafe"] and s[i + 1] in (K["impl"], K["trait"], K["auto"], K["extern"], K["mod"]):
            i += 1
            c = s[i]
        w = LEX.names.get(c)
        if w == "use":
            return self.need(self.use_tree(i + 1), ";")
        if w == "mod":
            i = self.ident(i + 1)
            return i + 1 if s[i] == ";" else self.items_in_braces(i)
        if w in ("struct", "union") and s[i + 1] in IDENT and s[i + 1] != "!":
            return self.struct(i)
        if w == "enum":
            return self.enum(i)
        if w == "auto" and s[i + 1] == K["trait"]:
            w, i = "trait", i + 1
        if w == "trait":
            i = self.generics(self.ident(i + 1))
            if s[i] == ":":
                i = self.bounds(i + 1)
            if s[i] == "=":
                return self.need(self.where(self.bounds(i + 1)), ";")
            return self.items_in_braces(self.where(i))
        if w == "impl":
            i += 1
            if s[i] == "<" and (s[i + 1] in "'#>" or s[i + 1] in IDENT or s[i + 1] == K["const"]):
                i = self.generics(i)
            if s[i] == "!":
                i += 1
            i = self.type(i)
            if s[i] == K["for"]:
                i = self.type(i + 1)
            return self.items_in_braces(self.where(i))
        if w == "type":
            i = self.generics(self.ident(i + 1))
            if s[i] == ":":
                i = self.bounds(i + 1)
            i = self.where(i)
            if s[i] == "=":
                i = self.where(self.type(i + 1))
            return self.need(i, ";")
        if w in ("const", "static"):
            i += 1
            if s[i] == K["mut"]:
                i += 1
            i = self.need(i + 1 if s[i] == "_" else self.ident(i), ":")
            i = self.type(i)
            if s[i] == "=":
                i = self.expr(i + 1)
            return self.need(i, ";")
        if w == "extern":
            i += 1
            if s[i] == K["crate"]:
                i = i + 2 if s[i + 1] == K["self"] else self.ident(i + 1)
                if s[i] == K["as"]:
                    i = self.ident(i + 1)
                return self.need(i, ";")
            if s[i] == '"':
                i += 1
            return self.items_in_braces(i)
        if c in PATH_START:  # macro
            j = self.simple_path(i)
            if s[j] == "!":
                j += 1
                if s[j] in IDENT:
                    j += 1
                brace = s[j] == "{"
                if s[j] not in "([{":
                    raise Bad(j)
                j = self.tree(j)
                return j if brace else self.need(j, ";")
        raise Bad(i, "invalid token" if c == BAD else "unexpected token")

    def simple_path(self, i: int) -> int:
        s = self.s
        if s[i] == K["::"]:
            i += 1
        while True:
            if s[i] not in PATH_START:
                raise Bad(i, "invalid token" if s[i] == BAD else "unexpected token")
            i += 1
            if s[i] != K["::"]:
                return i
            i += 1

    def items_in_braces(self, i: int) -> int:
        i = self.need(i, "{")
        return self.need(self.block_items(i, self.item, "}"), "}")

    def use_tree(self, i: int) -> int:
        s = self.s
        if s[i] == K["::"]:
            i += 1
        while True:
            if s[i] == "*":
                return i + 1
            if s[i] == "{":
                i += 1
                while s[i] != "}":
                    i = self.use_tree(i)
                    if s[i] != ",":
                        break
                    i += 1
                return self.need(i, "}")
            if s[i] not in PATH_START:
                raise Bad(i, "invalid token" if s[i] == BAD else "unexpected token")
            i += 1
            if s[i] == K["as"]:
                return i + 2 if s[i + 1] == "_" else self.ident(i + 1)
            if s[i] != K["::"]:
                return i
            i += 1

    def fn(self, i: int) -> int:
        s = self.s
        i = self.generics(self.ident(i + 1))
        i = self.need(i, "(")
        first = True
        while s[i] != ")":
            i = self.attributes(i)
            j = i
            if s[j] == "&":
                j += 1
                if s[j] == "'":
                    j += 1
            if s[j] == K["mut"]:
                j += 1
            if first and s[j] == K["self"]:
                i = j + 1
                if s[i] == ":":
                    i = self.type(i + 1)
            elif s[i] == K["..."]:
                i += 1
            else:
                i = self.need(self.pattern(i, False), ":")
                i = i + 1 if s[i] == K["..."] else self.type(i)
            first = False
            if s[i] != ",":
                break
            i += 1
        i = self.need(i, ")")
        if s[i] == K["->"]:
            i = self.type(i + 1)
        i = self.where(i)
        return i + 1 if s[i] == ";" else self.block(i)

    def generics(self, i: int) -> int:
        s = self.s
        if s[i] != "<":
            return i
        i += 1
        while s[i] != ">":
            i = self.attributes(i)
            if s[i] == "'":
                i += 1
                if s[i] == ":":
                    i += 1
                    while s[i] in "'+":
                        i += 1
            elif s[i] == K["const"]:
                i = self.type(self.need(self.ident(i + 1), ":"))
                if s[i] == "=":
                    i = self.generic_const(i + 1)
            else:
                i = self.ident(i)
                if s[i] == ":":
                    i = self.bounds(i + 1)
                if s[i] == "=":
                    i = self.type(i + 1)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, ">")

    def generic_const(self, i: int) -> int:
        s = self.s
        if s[i] == "{":
            return self.block(i)
        if s[i] == "-":
            i += 1
        if s[i] in '0"a' or s[i] in (K["true"], K["false"]):
            return i + 1
        raise Bad(i)

    def where(self, i: int) -> int:
        s = self.s
        if s[i] != K["where"]:
            return i
        i += 1
        while s[i] not in "{;=":
            if s[i] == K["for"]:
                i = self.generics(i + 1)
            i = i + 1 if s[i] == "'" else self.type(i)
            i = self.bounds(self.need(i, ":"))
            if s[i] != ",":
                break
            i += 1
        return i

    def bounds(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == "'":
                i += 1
            elif s[i] in "({?~" or s[i] in PATH_START or s[i] == K["for"]:
                paren = s[i] == "("
                i += paren
                if s[i] in "?~":
                    i += 1
                    if s[i] == K["const"]:
                        i += 1
                if s[i] == K["for"]:
                    i = self.generics(i + 1)
                i = self.path(i)
                if paren:
                    i = self.need(i, ")")
            if s[i] != "+":
                return i
            i += 1

    def struct(self, i: int) -> int:
        s = self.s
        i = self.where(self.generics(self.ident(i + 1)))
        if s[i] == ";":
            return i + 1
        if s[i] == "(":
            return self.need(self.where(self.tuple_fields(i)), ";")
        return self.fields(i)

    def tuple_fields(self, i: int) -> int:
        s = self.s
        i = self.need(i, "(")
        while s[i] != ")":
            i = self.type(self.visibility(self.attributes(i)))
            if s[i] != ",":
                break
            i += 1
        return self.need(i, ")")

    def fields(self, i: int) -> int:
        s = self.s
        i = self.need(i, "{")
        while s[i] != "}":
            i = self.ident(self.visibility(self.attributes(i)))
            i = self.type(self.need(i, ":"))
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "}")

    def enum(self, i: int) -> int:
        s = self.s
        i = self.where(self.generics(self.ident(i + 1)))
        i = self.need(i, "{")
        while s[i] != "}":
            i = self.ident(self.visibility(self.attributes(i)))
            if s[i] == "(":
                i = self.tuple_fields(i)
            elif s[i] == "{":
                i = self.fields(i)
            if s[i] == "=":
                i = self.expr(i + 1)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "}")

    # -- types and paths
    def type(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "&":
            i += 1
            if s[i] == "'":
                i += 1
            if s[i] == K["mut"]:
                i += 1
            return self.type(i)
        if c == "*":
            if s[i + 1] not in (K["const"], K["mut"]):
                raise Bad(i + 1)
            return self.type(i + 2)
        if c == "(":
            i += 1
            while s[i] != ")":
                i = self.type(i)
                if s[i] == "+":
                    i = self.bounds(i + 1)
                if s[i] != ",":
                    break
                i += 1
            return self.need(i, ")")
        if c == "[":
            i = self.type(i + 1)
            if s[i] == ";":
                i = self.expr(i + 1)
            return self.need(i, "]")
        if c == "!" or c == "_":
            return i + 1
        if c in (K["dyn"], K["impl"]):
            return self.bounds(i + 1)
        if c == K["for"]:
            return self.type(self.generics(i + 1))
        if c in (K["fn"], K["unsafe"], K["extern"]):
            while s[i] != K["fn"]:
                if s[i] not in (K["unsafe"], K["extern"], '"'):
                    raise Bad(i)
                i += 1
            i = self.need(i + 1, "(")
            while s[i] != ")":
                i = self.attributes(i)
                if (s[i] in IDENT or s[i] == "_") and s[i + 1] == ":":
                    i += 2
                i = i + 1 if s[i] == K["..."] else self.type(i)
                if s[i] != ",":
                    break
                i += 1
            i = self.need(i, ")")
            return self.type(i + 1) if s[i] == K["->"] else i
        if c in PATH_START or c == "<":
            i = self.path(i)
            if s[i] == "!" and s[i + 1] in "([{":
                return self.tree(i + 1)
            return i
        raise Bad(i, "invalid token" if c == BAD else "unexpected token")

    def qself(self, i: int) -> int:
        s = self.s
        i = self.type(i + 1)
        if s[i] == K["as"]:
            i = self.path(i + 1)
        i = self.need(i, ">")
        return self.need(i, K["::"])

    def path(self, i: int, expr: bool = False) -> int:
        """A path; in expressions generic arguments need the double colon."""
        s = self.s
        if s[i] == "<":
            i = self.qself(i)
        elif s[i] == K["::"]:
            i += 1
        while True:
            if s[i] not in PATH_START or s[i] == K["::"]:
                raise Bad(i, "invalid token" if s[i] == BAD else "unexpected token")
            i += 1
            if not expr:
                if s[i] == "<" or s[i] == K["::"] and s[i + 1] == "<":
                    i = self.generic_args(i + (s[i] != "<"))
                elif s[i] == "(":  # Fn(A) -> B
                    i += 1
                    while s[i] != ")":
                        i = self.type(i)
                        if s[i] != ",":
                            break
                        i += 1
                    i = self.need(i, ")")
                    if s[i] == K["->"]:
                        i = self.type(i + 1)
                    return i
            elif s[i] == K["::"] and s[i + 1] == "<":
                i = self.generic_args(i + 1)
            if s[i] != K["::"]:
                return i
            i += 1

    def generic_args(self, i: int) -> int:
        s = self.s
        i += 1
        while s[i] != ">":
            if s[i] == "'":
                i += 1
            elif s[i] in '0"{-' or s[i] in (K["true"], K["false"]):
                i = self.generic_const(i)
            else:
                i = self.type(i)
                if s[i] == "=":
                    i = self.type(i + 1) if s[i + 1] not in '0"{-' else self.generic_const(i + 1)
                elif s[i] == ":":
                    i = self.bounds(i + 1)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, ">")

    # -- patterns
    def pattern(self, i: int, alternatives: bool = True) -> int:
        s = self.s
        if alternatives and s[i] == "|":
            i += 1
        i = self.pattern1(i)
        while alternatives and s[i] == "|":
            i = self.pattern1(i + 1)
        return i

    def pattern1(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "&":
            i += 1
            if s[i] == K["mut"]:
                i += 1
            return self.pattern1(i)
        if c == "_":
            return i + 1
        if c in (K["ref"], K["mut"]):
            i += 1
            if s[i] == K["mut"]:
                i += 1
            i = self.ident(i)
            return self.pattern1(i + 1) if s[i] == "@" else i
        if c in "([":
            close = ")" if c == "(" else "]"
            i += 1
            while s[i] != close:
                i = self.pattern(i)
                if s[i] != ",":
                    break
                i += 1
            return self.need(i, close)
        if c == K[".."]:
            i += 1
            return i + 1 if s[i] in '0"' else i
        if c == K["..="]:
            return self.literal_bound(i + 1)
        if c in '0"-' or c in (K["true"], K["false"]):
            i = self.literal_bound(i)
            return self.range_rest(i)
        if c == K["const"] and s[i + 1] == "{":
            return self.block(i + 1)
        if c in PATH_START or c == "<":
            single = c in IDENT
            start = i
            i = self.path(i, True)
            if s[i] == "!":
                if s[i + 1] not in "([{":
                    raise Bad(i)
                return self.tree(i + 1)
            if s[i] == "@" and single and i == start + 1:
                return self.pattern1(i + 1)
            if s[i] == "(":
                return self.pattern1(i)
            if s[i] == "{":
                i += 1
                while s[i] != "}":
                    i = self.attributes(i)
                    if s[i] == K[".."]:
                        i += 1
                        break
                    if s[i] in (K["ref"], K["mut"]):
                        i = self.pattern1(i)
                    else:
                        i = i + 1 if s[i] == "0" else self.ident(i)
                        if s[i] == ":":
                            i = self.pattern(i + 1)
                    if s[i] != ",":
                        break
                    i += 1
                return self.need(i, "}")
            return self.range_rest(i)
        raise Bad(i, "invalid token" if c == BAD else "unexpected token")

    def range_rest(self, i: int) -> int:
        s = self.s
        if s[i] in (K["..="], K["..."]):
            return self.literal_bound(i + 1)
        if s[i] == K[".."]:
            return self.literal_bound(i + 1) if s[i + 1] in '0"-' or s[i + 1] in PATH_START else i + 1
        return i

    def literal_bound(self, i: int) -> int:
        s = self.s
        if s[i] == "-":
            return self.need(i + 1, "0")
        if s[i] in '0"' or s[i] in (K["true"], K["false"]):
            return i + 1
        return self.path(i, True)

    # -- statements
    def block(self, i: int) -> int:
        s = self.s
        i = self.need(i, "{")
        old, self.no_struct = self.no_struct, False
        i = self.need(self.block_items(i, self.statement, "}"), "}")
        self.no_struct = old
        return i

    def statement(self, i: int) -> int:
        return self.remembered(SEEN, self.statement_, i)

    def statement_(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        i = self.attributes(i)
        c = s[i]
        if c == K["let"]:
            i = self.pattern(i + 1)
            if s[i] == ":":
                i = self.type(i + 1)
            if s[i] == "=":
                i = self.expr(i + 1)
                if s[i] == K["else"]:
                    i = self.block(i + 1)
            return self.need(i, ";")
        if self.is_item(i):
            return self.item(i)
        if c in BLOCK_LIKE or c == "'" and s[i + 1] == ":" or c in (K["async"], K["const"]) and s[i + 1] in ("{", K["move"]):
            j = self.primary(i)
            if s[j] in ".?":
                j = self.expr_from(j)
                if s[j] not in ";}":
                    raise Bad(j)
            return j + 1 if s[j] == ";" else j
        if c in PATH_START:
            j = i
            try:
                j = self.simple_path(i)
            except Bad:
                j = -1
            if j >= 0 and s[j] == "!" and s[j + 1] == "{":
                j = self.tree(j + 1)
                if s[j] not in ".?":
                    return j + 1 if s[j] == ";" else j
                j = self.expr_from(j)
                return j if s[j] == "}" else self.need(j, ";")
        i = self.expr(i)
        if s[i] == ";":
            return i + 1
        if s[i] == "}":
            return i
        raise Bad(i, "invalid token" if s[i] == BAD else "missing bracket" if s[i] == END else "unexpected token")

    def is_item(self, i: int) -> bool:
        s = self.s
        c, n = s[i], s[i + 1]
        if c in (K["fn"], K["struct"], K["enum"], K["trait"], K["impl"], K["mod"], K["use"], K["type"], K["static"], K["pub"]):
            return not (c == K["static"] and n in ("|", K["move"]))
        if c == K["const"]:
            return n not in ("{", K["move"], "|") and not (n == K["async"] and s[i + 2] in ("{", "|"))
        if c in (K["unsafe"], K["async"]):
            return n in (K["fn"], K["impl"], K["trait"], K["extern"], K["unsafe"])
        if c == K["extern"]:
            return True
        if c == K["macro_rules"]:
            return n == "!"
        return c == K["union"] and n in IDENT and s[i + 2] in "{<"

    # -- expressions
    def expr(self, i: int) -> int:
        return self.assign(i)

    def assign(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in (K["return"], K["break"]):
            i += 1
            if c == K["break"] and s[i] == "'":
                i += 1
            if s[i] in NO_OPERAND or s[i] == "{" and self.no_struct:
                return i
            return self.expr(i)
        if c in ("|", K["move"]) or c in (K["static"], K["async"]) and s[i + 1] in ("|", K["move"]) and s[i + 2] != "{":
            return self.closure(i)
        if c == K["async"] and s[i + 1] == "|":
            return self.closure(i)
        i = self.range(i)
        return self.assign_rest(i)

    def assign_rest(self, i: int) -> int:
        s = self.s
        if s[i] in ASSIGN:
            return self.expr(i + 1)
        if s[i] == ">" and s[i + 1] in (">", "=") and s[i + 2] == "=" or s[i] == ">" and s[i + 1] == ">" and s[i + 2] == "=":
            return self.expr(i + 3)
        return i

    def closure(self, i: int) -> int:
        s = self.s
        while s[i] in (K["move"], K["static"], K["async"]):
            i += 1
        i = self.need(i, "|")
        while s[i] != "|":
            i = self.pattern(self.attributes(i), False)
            if s[i] == ":":
                i = self.type(i + 1)
            if s[i] != ",":
                break
            i += 1
        i = self.need(i, "|")
        if s[i] == K["->"]:
            return self.block(self.type(i + 1))
        return self.expr(i)

    def range(self, i: int) -> int:
        s = self.s
        if s[i] in (K[".."], K["..="]):
            i += 1
            return i if s[i] in NO_OPERAND or s[i] == "{" and self.no_struct else self.or_(i)
        i = self.or_(i)
        if s[i] in (K[".."], K["..="]):
            i += 1
            if s[i] in NO_OPERAND or s[i] == "{" and self.no_struct or s[i] == ".":
                return i
            return self.or_(i)
        return i

    def or_(self, i: int) -> int:
        s = self.s
        i = self.and_(i)
        while s[i] == "|" and s[i + 1] == "|":
            i = self.and_(i + 2)
        return i

    def and_(self, i: int) -> int:
        s = self.s
        i = self.let_or(i)
        while s[i] == "&" and s[i + 1] == "&":
            i = self.let_or(i + 2)
        return i

    def let_or(self, i: int) -> int:
        s = self.s
        if s[i] == K["let"]:
            i = self.need(self.pattern(i + 1), "=")
            old, self.no_struct = self.no_struct, True
            i = self.binary(i, 5)
            self.no_struct = old
            return i
        return self.binary(i, 5)

    def binary(self, i: int, level: float) -> int:
        s = self.s
        i = self.unary(i)
        return self.binary_rest(i, level)

    def binary_rest(self, i: int, level: float) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == K["as"]:
                i = self.type(i + 1)
                continue
            p = BINARY.get(c, 0)
            width = 1
            if c in "<>" and s[i + 1] == c:
                if s[i + 2] == "=":
                    return i
                p, width = 8, 2
            elif c == ">" and s[i + 1] == "=":
                p, width = 5, 2
            elif c in "|&" and s[i + 1] == c:
                return i
            if not p or p < level:
                return i
            compare = p == 5
            i = self.binary(i + width, p + 0.25)
            if compare and (s[i] in COMPARE and not (s[i] in "<>" and s[i + 1] == s[i])):
                raise Bad(i, "chained comparison")

    def unary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "-!*":
            return self.unary(i + 1)
        if c == "&":
            i += 1
            if s[i] == K["mut"]:
                i += 1
            return self.unary(i)
        if c in ("|", K["move"], K["return"], K["break"]):
            return self.assign(i)
        return self.suffixes(self.primary(i))

    def expr_from(self, i: int) -> int:
        """Goes on behind a block-like expression that a dot or ? follows."""
        return self.assign_rest(self.binary_rest(self.suffixes(i), 5))

    def suffixes(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == "?":
                i += 1
            elif c == ".":
                i += 1
                if s[i] == K["await"] or s[i] == "0":
                    i += 1
                else:
                    i = self.ident(i) if s[i] not in (K["self"],) else i + 1
                    if s[i] == K["::"]:
                        i = self.generic_args(self.need(i, K["::"]) if s[i + 1] == "<" else i)
            elif c == "(":
                i = self.args(i + 1, ")")
            elif c == "[":
                old, self.no_struct = self.no_struct, False
                i = self.need(self.expr(i + 1), "]")
                self.no_struct = old
            else:
                return i

    def args(self, i: int, close: str) -> int:
        s = self.s
        old, self.no_struct = self.no_struct, False
        while s[i] != close:
            i = self.expr(self.attributes(i))
            if s[i] != ",":
                break
            i += 1
        self.no_struct = old
        return self.need(i, close)

    def condition(self, i: int) -> int:
        old, self.no_struct = self.no_struct, True
        i = self.expr(i)
        self.no_struct = old
        return i

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in '0"' or c in (K["true"], K["false"]):
            return i + 1
        if c == "(":
            return self.args(i + 1, ")")
        if c == "[":
            i += 1
            old, self.no_struct = self.no_struct, False
            if s[i] != "]":
                i = self.expr(i)
                if s[i] == ";":
                    i = self.expr(i + 1)
                else:
                    while s[i] == "," and s[i + 1] != "]":
                        i = self.expr(i + 1)
                    if s[i] == ",":
                        i += 1
            self.no_struct = old
            return self.need(i, "]")
        if c == "{":
            return self.block(i)
        w = LEX.names.get(c)
        if w == "if":
            i = self.block(self.condition(i + 1))
            if s[i] == K["else"]:
                return self.primary(i + 1) if s[i + 1] == K["if"] else self.block(i + 1)
            return i
        if w == "match":
            return self.match(i)
        if c == "'":
            i = self.need(i + 1, ":")
            if s[i] not in (K["loop"], K["while"], K["for"], "{"):
                raise Bad(i)
            return self.primary(i)
        if w == "loop":
            return self.block(i + 1)
        if w == "while":
            return self.block(self.condition(i + 1))
        if w == "for":
            i = self.need(self.pattern(i + 1), K["in"])
            return self.block(self.condition(i))
        if w == "unsafe" or w == "const" and s[i + 1] == "{":
            return self.block(i + 1)
        if w == "async":
            i += 1
            if s[i] == K["move"]:
                i += 1
            return self.block(i)
        if w == "continue":
            return i + 2 if s[i + 1] == "'" else i + 1
        if w in ("return", "break", "move"):
            return self.assign(i)
        if c == "_":
            return i + 1
        if c in PATH_START or c == "<":
            i = self.path(i, True)
            if s[i] == "!" and s[i + 1] in "([{":
                return self.tree(i + 1)
            if s[i] == "{" and not self.no_struct:
                return self.struct_literal(i)
            return i
        raise Bad(i, "invalid token" if c == BAD else "missing bracket" if c == END else "unexpected token")

    def struct_literal(self, i: int) -> int:
        s = self.s
        i += 1
        old, self.no_struct = self.no_struct, False
        while s[i] != "}":
            i = self.attributes(i)
            if s[i] == K[".."]:
                i += 1
                if s[i] != "}":
                    i = self.expr(i)
                break
            i = i + 1 if s[i] == "0" else self.ident(i)
            if s[i] == ":":
                i = self.expr(i + 1)
            if s[i] != ",":
                break
            i += 1
        self.no_struct = old
        return self.need(i, "}")

    def match(self, i: int) -> int:
        s = self.s
        i = self.need(self.condition(i + 1), "{")
        old, self.no_struct = self.no_struct, False
        while s[i] != "}":
            if s[i] == END:
                raise Bad(i, "missing bracket")
            i = self.pattern(self.attributes(i))
            if s[i] == K["if"]:
                i = self.expr(i + 1)
            i = self.need(i, K["=>"])
            block = s[i] == "{"
            i = self.expr(i) if not block else self.primary(i)
            if block and s[i] in ".?":
                i = self.expr_from(i)
                block = False
            if s[i] == ",":
                i += 1
            elif not block and s[i] != "}":
                raise Bad(i)
        self.no_struct = old
        return i + 1


# a lone underscore is a token of its own
LEX.chars["_"] = "_"
LEX.kinds.clear()


def check(text: str) -> list[tuple[int, str]]:
    if text.startswith("#!") and not text.startswith("#!["):
        text = "//" + text
    p = Rust(LEX.lex(text))
    p.top(p.item)
    if not p.errors:
        return []
    offs = LEX.offsets(text)
    return list(zip(lines_of(text, [offs[at] if at < len(offs) else len(text) for at, _ in p.errors]), [what for _, what in p.errors]))
