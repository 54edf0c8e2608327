"""Python 3: logical lines by indentation, statements by recursive descent, expressions by precedence climbing."""

from __future__ import annotations

import re

from .base import BAD, END, Bad, Lexicon, Parser, lines_of

_STRING = r"""(?i:[rbuf]|br|rb|fr|rf)?(?:'''(?:[^'\\]|\\.|'(?!''))*'''|\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'(?!'')(?:[^'\\\n]|\\.)*'|''(?!')|"(?!"")(?:[^"\\\n]|\\.)*"|""(?!"))"""
_NUMBER = r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"


def _width(ws: str) -> int:
    n = 0
    for c in ws:
        n = n + 1 if c == " " else (n // 8 + 1) * 8 if c == "\t" else 0
    return n


def _format_ok(body: str, spec: bool = False) -> bool:
    """Whether the replacement fields of a formatted string are well formed, expressions included."""
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "}":
            if body[i + 1 : i + 2] != "}" or spec:
                return False
            i += 2
            continue
        if c != "{":
            i += 1
            continue
        if body[i + 1 : i + 2] == "{" and not spec:
            i += 2
            continue
        depth, j, quote, cut = 0, i + 1, "", -1
        while j < n:
            d = body[j]
            if quote:
                quote = "" if d == quote else quote
            elif d in "\"'":
                quote = d
            elif d in "([{":
                depth += 1
            elif d in ")]}":
                if not depth and d == "}":
                    break
                depth -= 1
            elif not depth and cut < 0 and (d == ":" or d == "!" and body[j + 1 : j + 2] != "="):
                cut = j
                if d == ":":
                    quote = ""
            j += 1
        if j >= n:
            return False
        expr = body[i + 1 : cut if cut >= 0 else j].strip()
        rest = body[cut:j] if cut >= 0 else ""
        if expr.endswith("=") and expr[-2:-1] not in "=!<>":
            expr = expr[:-1]
        if rest.startswith("!"):
            if not re.match(r"![sra](?::|$)", rest):
                return False
            rest = rest[2:]
        if rest and not _format_ok(rest[1:], True):
            return False
        try:
            p = Line(LEX.lex(expr.replace("\n", " ")))
            p.end(p.yielded(0))
        except Bad:
            return False
        i = j + 1
    return True


def _classify(t: str) -> str | None:
    c = t[0]
    if c == "\n":
        return "\n" + chr(0xE000 + min(_width(t[1:]), 0x1000))
    if c == "\\" or c == "#":
        return ""
    if c in "\"'" or (t[-1] in "\"'" and len(t) > 1):
        if len(t) < 2:
            return BAD
        prefix = re.match(r"\w*", t)[0].lower()
        if "f" in prefix and "{" in t or "f" in prefix and "}" in t:
            body = t[len(prefix) :]
            body = body[3:-3] if body[:3] in ('"""', "'''") else body[1:-1]
            return '"' if _format_ok(body) else BAD
        return '"'
    if c.isdigit() or (c == "." and len(t) > 1 and t != "..."):
        return "0" if re.fullmatch(_NUMBER, t) and not re.fullmatch(r"0[\d_]*[1-9][\d_]*", t) else BAD
    return None


LEX = Lexicon(
    rf"\n[ \t\f]*|\\\r?\n[ \t]*|#[^\n]*|{_STRING}|[^\W\d]\w*|{_NUMBER}|\d[\w.]*|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[+\-*/%&|^@<>=!]=|\*\*|//|<<|>>|[^\s]",
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "**= //= >>= <<= ... -> := += -= *= /= %= &= |= ^= @= <= >= == != ** // << >>",
    _classify,
)
K = LEX.chars
AUG = LEX.set("**= //= >>= <<= += -= *= /= %= &= |= ^= @=")
COMPARE = LEX.set("< > <= >= == != in is not")
BINARY = {"|": 1, "^": 2, "&": 3, K["<<"]: 4, K[">>"]: 4, "+": 5, "-": 5, "*": 6, "/": 6, K["//"]: 6, "%": 6, "@": 6}
ATOMS = frozenset('0"' + K["None"] + K["True"] + K["False"] + K["..."])
SIMPLE_OK: dict[str, int] = {}  # logical line -> what it is, see line()
(PLAIN, DECORATOR, HEAD) = range(3)
SOFT = ("match", "case", "type")


class Line(Parser):
    """One logical line. ``target`` tells whether the expression parsed last may be assigned to."""

    def __init__(self, kinds: str):
        super().__init__(kinds)
        self.target = False

    # -- statements
    def line(self) -> int:
        """PLAIN, DECORATOR, or HEAD + the keyword's code point where an indented block must follow."""
        s = self.s
        c = s[0]
        w = LEX.names.get(c)
        if c == "@":
            self.end(self.named(1))
            return DECORATOR
        if w == "async":
            if LEX.names.get(s[1]) not in ("def", "for", "with"):
                raise Bad(1)
            w, at = LEX.names[s[1]], 1
        else:
            at = 0
        if w in ("if", "while", "elif"):
            return self.head(self.named(at + 1), c)
        if w in ("else", "try", "finally"):
            return self.head(at + 1, c)
        if w == "for":
            i = self.targets(at + 1)
            i = self.need(i, K["in"])
            return self.head(self.star_list(i), c)
        if w == "with":
            return self.head(self.with_items(at + 1), c)
        if w == "except":
            i = at + 1
            if s[i] == "*":
                i += 1
            if s[i] != ":":
                i = self.star_list(i)
                if s[i] == K["as"]:
                    i = self.need(i + 1, "a")
            return self.head(i, c)
        if w == "def":
            i = self.type_params(self.need(at + 1, "a"))
            i = self.params(self.need(i, "("), ")", True)
            i = self.need(i, ")")
            if s[i] == K["->"]:
                i = self.star_list(i + 1)
            return self.head(i, K["def"])
        if w == "class":
            i = self.type_params(self.need(1, "a"))
            if s[i] == "(":
                i = self.args(i)
            return self.head(i, c)
        self.simple_list(0)
        return PLAIN

    def head(self, i: int, c: str) -> int:
        i = self.need(i, ":", "expected ':'")
        if self.s[i] == END:
            return HEAD + ord(c)
        self.simple_list(i)
        return -(HEAD + ord(c))  # the block is on this line

    def end(self, i: int) -> None:
        if self.s[i] != END:
            raise Bad(i)

    def simple_list(self, i: int) -> None:
        while True:
            i = self.simple(i)
            if self.s[i] == ";":
                i += 1
                if self.s[i] == END:
                    return
                continue
            return self.end(i)

    def simple(self, i: int) -> int:
        s = self.s
        w = LEX.names.get(s[i])
        if w in ("pass", "break", "continue"):
            return i + 1
        if w == "return":
            return i + 1 if s[i + 1] in ";\0" else self.star_list(i + 1)
        if w == "raise":
            if s[i + 1] in ";\0":
                return i + 1
            i = self.expr(i + 1)
            return self.expr(i + 1) if s[i] == K["from"] else i
        if w in ("global", "nonlocal"):
            i = self.need(i + 1, "a")
            while s[i] == ",":
                i = self.need(i + 1, "a")
            return i
        if w == "assert":
            i = self.expr(i + 1)
            return self.expr(i + 1) if s[i] == "," else i
        if w == "del":
            return self.targets(i + 1)
        if w == "import":
            while True:
                i = self.dotted(i + 1)
                if s[i] == K["as"]:
                    i = self.need(i + 1, "a")
                if s[i] != ",":
                    return i
        if w == "from":
            i += 1
            dots = 0
            while s[i] == "." or s[i] == K["..."]:
                i += 1
                dots = 1
            if s[i] == "a" or not dots:
                i = self.dotted(i)
            i = self.need(i, K["import"])
            if s[i] == "*":
                return i + 1
            paren = s[i] == "("
            i += paren
            while True:
                i = self.need(i, "a")
                if s[i] == K["as"]:
                    i = self.need(i + 1, "a")
                if s[i] != ",":
                    break
                i += 1
                if paren and s[i] == ")":
                    break
            return self.need(i, ")") if paren else i
        i = self.yielded(i)
        if s[i] == ":":
            if not self.target:
                raise Bad(i, "annotated no target")
            i = self.expr(i + 1)
            return self.yielded(i + 1) if s[i] == "=" else i
        if s[i] in AUG:
            if not self.target or self.tuple_like:
                raise Bad(i, "no target")
            return self.yielded(i + 1)
        while s[i] == "=":
            if not self.target:
                raise Bad(i, "no target")
            i = self.yielded(i + 1)
        return i

    def yielded(self, i: int) -> int:
        return self.yield_(i) if self.s[i] == K["yield"] else self.star_list(i)

    def yield_(self, i: int) -> int:
        s = self.s
        self.target = False
        i += 1
        if s[i] == K["from"]:
            i = self.expr(i + 1)
        elif s[i] not in ";\0)]}=":
            i = self.star_list(i)
        self.target = False
        return i

    def dotted(self, i: int) -> int:
        i = self.need(i, "a")
        while self.s[i] == ".":
            i = self.need(i + 1, "a")
        return i

    def with_items(self, i: int) -> int:
        s = self.s
        if s[i] == "(":  # parenthesised items, if that fits
            try:
                j = i + 1
                while s[j] != ")":
                    j = self.expr(j)
                    if s[j] == K["as"]:
                        j = self.star_target(j + 1)
                    if s[j] != ",":
                        break
                    j += 1
                j = self.need(j, ")")
                if s[j] == ":":
                    return j
            except Bad:
                pass
        while True:
            i = self.expr(i)
            if s[i] == K["as"]:
                i = self.star_target(i + 1)
            if s[i] != ",":
                return i
            i += 1

    def star_target(self, i: int) -> int:
        if self.s[i] == "*":
            i += 1
        j = self.primary(i)
        if not self.target:
            raise Bad(i, "no target")
        return j

    def targets(self, i: int) -> int:
        while True:
            i = self.star_target(i)
            if self.s[i] != ",":
                return i
            i += 1
            if self.s[i] in (K["in"], END, ";", "="):
                return i

    def type_params(self, i: int) -> int:
        s = self.s
        if s[i] != "[":
            return i
        i += 1
        while s[i] != "]":
            while s[i] in ("*", K["**"]):
                i += 1
            i = self.need(i, "a")
            if s[i] == ":":
                i = self.expr(i + 1)
            if s[i] == "=":
                i = self.expr(i + 1)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "]")

    def params(self, i: int, close: str, typed: bool) -> int:
        s, default, star, bare = self.s, False, False, False
        while s[i] != close:
            if s[i] == "/":
                i += 1
            elif s[i] == "*":
                if star:
                    raise Bad(i, "second *")
                star = True
                i += 1
                bare = s[i] == ","
                if s[i] == "a":
                    i += 1
                    if typed and s[i] == ":":
                        i = self.star_expr(i + 1)
                elif not bare:
                    raise Bad(i)
            elif s[i] == K["**"]:
                i = self.need(i + 1, "a")
                if typed and s[i] == ":":
                    i = self.expr(i + 1)
                if s[i] == ",":
                    i += 1
                if s[i] != close:
                    raise Bad(i)
                return i
            else:
                i = self.need(i, "a")
                bare = False
                if typed and s[i] == ":":
                    i = self.expr(i + 1)
                if s[i] == "=":
                    i = self.expr(i + 1)
                    default = True
                elif default and not star:
                    raise Bad(i, "parameter without default after one with it")
            if s[i] != ",":
                break
            i += 1
        if bare:
            raise Bad(i, "named parameters must follow *")
        return i

    # -- expressions
    def star_expr(self, i: int) -> int:
        return self.binary(i + 1, 1) if self.s[i] == "*" else self.named(i)

    def star_list(self, i: int) -> int:
        """One expression, or a tuple without parentheses."""
        i = self.star_expr(i)
        self.tuple_like = False
        if self.s[i] == ",":
            ok = self.target
            while self.s[i] == ",":
                i += 1
                if self.starts(i):
                    i = self.star_expr(i)
                    ok = ok and self.target
                else:
                    break
            self.target, self.tuple_like = ok, True
        return i

    tuple_like = False

    def starts(self, i: int) -> bool:
        c = self.s[i]
        return c in "a([{+-~*" or c in ATOMS or LEX.names.get(c) in ("not", "lambda", "await", "yield")

    def named(self, i: int) -> int:
        if self.s[i] == "a" and self.s[i + 1] == K[":="]:
            i = self.expr(i + 2)
            self.target = False
            return i
        return self.expr(i)

    def expr(self, i: int) -> int:
        s = self.s
        if s[i] == K["lambda"]:
            i = self.params(i + 1, ":", False)
            i = self.expr(self.need(i, ":"))
            self.target = False
            return i
        i = self.logical(i, 0)
        if s[i] == K["if"]:
            i = self.logical(i + 1, 0)
            i = self.expr(self.need(i, K["else"]))
            self.target = False
        return i

    def logical(self, i: int, level: int) -> int:
        s = self.s
        i = self.negated(i)
        while s[i] == K["or"] or s[i] == K["and"]:
            i = self.negated(i + 1)
            self.target = False
        return i

    def negated(self, i: int) -> int:
        s = self.s
        if s[i] == K["not"]:
            i = self.negated(i + 1)
            self.target = False
            return i
        i = self.binary(i, 1)
        while s[i] in COMPARE:
            if s[i] == K["not"]:
                i = self.need(i + 1, K["in"])
            elif s[i] == K["is"] and s[i + 1] == K["not"]:
                i += 2
            else:
                i += 1
            i = self.binary(i, 1)
            self.target = False
        return i

    def binary(self, i: int, level: int) -> int:
        s = self.s
        i = self.unary(i)
        while (p := BINARY.get(s[i], 0)) >= level:
            i = self.binary(i + 1, p + 1)
            self.target = False
        return i

    def unary(self, i: int) -> int:
        s = self.s
        if s[i] in "+-~" and s[i] != END:
            i = self.unary(i + 1)
            self.target = False
            return i
        i = self.primary(i)
        if s[i] == K["**"]:
            i = self.unary(i + 1)
            self.target = False
        return i

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == K["await"]:
            i = self.primary(i + 1)
            self.target = False
            return i
        self.target = False
        if c == "a":
            i += 1
            self.target = True
        elif c == '"':
            while s[i] == '"':
                i += 1
        elif c in ATOMS:
            i += 1
        elif c == "(":
            i = self.group(i + 1, ")")
        elif c == "[":
            i = self.group(i + 1, "]")
        elif c == "{":
            i = self.braces(i + 1)
        else:
            raise Bad(i, "invalid token" if c == BAD else "unexpected token")
        while True:
            c = s[i]
            if c == ".":
                i = self.need(i + 1, "a")
                self.target = True
            elif c == "(":
                i = self.args(i)
                self.target = False
            elif c == "[":
                i = self.subscript(i + 1)
                self.target = True
            else:
                return i

    def group(self, i: int, close: str) -> int:
        """Inside ( or [: empty, one expression, tuple or list, comprehension."""
        s = self.s
        if s[i] == close:
            self.target = True
            return i + 1
        if s[i] == K["yield"] and close == ")":
            return self.need(self.yield_(i), close)
        star = s[i] == "*"
        i = self.star_expr(i)
        ok = self.target
        if s[i] == K["for"] or s[i] == K["async"]:
            i = self.comprehension(i)
            self.target = False
            return self.need(i, close)
        if star and s[i] != "," and close == ")":
            raise Bad(i)
        while s[i] == ",":
            i += 1
            if s[i] == close:
                break
            i = self.star_expr(i)
            ok = ok and self.target
        self.target = ok
        return self.need(i, close)

    def comprehension(self, i: int) -> int:
        s = self.s
        while s[i] == K["for"] or s[i] == K["async"]:
            if s[i] == K["async"]:
                i += 1
            i = self.need(i, K["for"])
            i = self.targets(i)
            i = self.logical(self.need(i, K["in"]), 0)
            while s[i] == K["if"]:
                i = self.logical_named(i + 1)
        return i

    def logical_named(self, i: int) -> int:
        if self.s[i] == "a" and self.s[i + 1] == K[":="]:
            return self.logical(i + 2, 0)
        return self.logical(i, 0)

    def braces(self, i: int) -> int:
        s = self.s
        kind = ""
        while s[i] != "}":
            if s[i] == K["**"]:
                if kind == "set":
                    raise Bad(i)
                kind = "dict"
                i = self.binary(i + 1, 1)
            else:
                star = s[i] == "*"
                i = self.star_expr(i)
                if s[i] == ":" and not star:
                    if kind == "set":
                        raise Bad(i)
                    kind = "dict"
                    i = self.expr(i + 1)
                else:
                    if kind == "dict":
                        raise Bad(i, "expected ':'")
                    kind = "set"
                if s[i] == K["for"] or s[i] == K["async"]:
                    i = self.comprehension(i)
                    break
            if s[i] != ",":
                break
            i += 1
        self.target = False
        return self.need(i, "}")

    def args(self, i: int) -> int:
        s = self.s
        i += 1
        named = False
        while s[i] != ")":
            if s[i] == "*":
                i = self.expr(i + 1)
            elif s[i] == K["**"]:
                i = self.expr(i + 1)
                named = True
            elif s[i] == "a" and s[i + 1] == "=":
                i = self.expr(i + 2)
                named = True
            else:
                at = i
                i = self.named(i)
                if s[i] == K["for"] or s[i] == K["async"]:
                    i = self.comprehension(i)
                elif named:
                    raise Bad(at, "positional argument after a named one")
            if s[i] != ",":
                break
            i += 1
        return self.need(i, ")")

    def subscript(self, i: int) -> int:
        s = self.s
        if s[i] == "]":
            raise Bad(i)
        while s[i] != "]":
            if s[i] == "*":
                i = self.binary(i + 1, 1)
            else:
                if s[i] != ":":
                    i = self.named(i)
                for _ in range(2):
                    if s[i] == ":":
                        i += 1
                        if s[i] not in ":,]":
                            i = self.expr(i)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "]")


FOLLOWS = {  # clause -> what it may follow at its depth
    "elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "try"), "except": ("try", "except"),
    "finally": ("try", "except", "else"),
}

def _split_guard(kinds: str) -> tuple[str, str | None]:
    """A case pattern and its guard: cut at the first ``if`` outside brackets."""
    depth = 0
    for i, c in enumerate(kinds):
        depth += (c in "([{") - (c in ")]}")
        if c == K["if"] and not depth:
            return kinds[:i], kinds[i + 1 :]
    return kinds, None


def _line_kind(kinds: str, words: tuple[str, ...]) -> int:
    """What a logical line is. Soft keywords look at the first word of the line."""
    known = SIMPLE_OK.get(kinds)
    if known is not None:
        return known
    try:
        out = Line(kinds).line()
    except Bad:
        # match and case heads and type aliases begin with what else is a name
        if kinds[0] == "a" and kinds[-1] == ":" and len(kinds) > 2:
            body = kinds[1:-1]
            if words[:1] == ("match",):
                p = Line(body)
                p.end(p.star_list(0))
                return HEAD + ord("m")
            if words[:1] == ("case",):
                pattern, guard = _split_guard(body)
                p = Line(pattern.replace(K["as"] + "a", ""))
                p.end(p.star_list(0))
                if guard is not None:
                    p = Line(guard)
                    p.end(p.named(0))
                return HEAD + ord("c")
        if kinds[:2] == "aa" and words[:1] == ("type",):
            p = Line(kinds)
            i = p.need(p.type_params(2), "=")
            p.end(p.expr(i))
            return PLAIN
        raise
    if len(SIMPLE_OK) < 500_000:
        SIMPLE_OK[kinds] = out
    return out


def check(text: str) -> list[tuple[int, str]]:
    """Errors as (line, cause), in order."""
    kinds = LEX.lex("\n" + text)
    raw = kinds.split("\n")[1:]
    errors: list[tuple[int, str]] = []
    indents, heads = [0], [""]  # depth stack; the last clause at each depth
    expect, decorated = "", False
    at, n = 0, len(raw)
    starts = None

    def fail(index: int, what: str) -> None:
        nonlocal starts
        if starts is None:
            offs = LEX.offsets("\n" + text)
            joined = "\n" + text
            seen, places = 0, []
            for piece in raw:
                places.append(offs[seen] if seen < len(offs) else len(joined) - 1)
                seen += len(piece) + 1
            starts = lines_of(joined, places)
        errors.append((starts[min(index, n - 1)] if starts else 1, what))

    while at < n:
        line = raw[at]
        first = at
        at += 1
        if len(line) < 2:
            continue
        indent, body = ord(line[0]) - 0xE000, line[1:]
        if body[0] == " ":
            continue
        # join physical lines while a bracket is open
        depth = body.count("(") + body.count("[") + body.count("{") - body.count(")") - body.count("]") - body.count("}")
        while depth > 0 and at < n:
            more = raw[at][1:]
            at += 1
            body += more
            depth += more.count("(") + more.count("[") + more.count("{") - more.count(")") - more.count("]") - more.count("}")
        if depth > 0:
            fail(first, "missing bracket")
        # indentation
        if expect:
            if indent > indents[-1]:
                indents.append(indent)
                heads.append("")
            else:
                fail(first, f"expected an indented block after {expect}")
            expect = ""
        elif indent > indents[-1]:
            fail(first, "unexpected indent")
            indents.append(indent)
            heads.append("")
        while indent < indents[-1]:
            indents.pop()
            if heads.pop() == "try":
                fail(first, "try without except or finally")
        if indent != indents[-1]:
            fail(first, "unindent does not match")
            indents.append(indent)
            heads.append("")
        try:
            words: tuple[str, ...] = ()
            if body[0] == "a" and body not in SIMPLE_OK:
                m = _line_text(text, raw, first)
                words = (m,)
            kind = _line_kind(body, words)
        except Bad as e:
            fail(first, e.what)
            heads[-1] = ""
            # a broken head may still open a block
            if body[-1] == ":":
                expect = "statement"
            decorated = False
            continue
        if kind == PLAIN:
            if decorated:
                fail(first, "decorator without definition")
            if heads[-1] == "try":
                fail(first, "try without except or finally")
            heads[-1], decorated = "", False
            continue
        if kind == DECORATOR:
            if heads[-1] == "try":
                fail(first, "try without except or finally")
            heads[-1], decorated = "", True
            continue
        code = chr(abs(kind) - HEAD)
        word = LEX.names.get(code, {"m": "match", "c": "case"}.get(code, ""))
        if word == "async":
            word = "def" if K["def"] in body[:2] else "for"
        if decorated and word not in ("def", "class"):
            fail(first, "decorator without definition")
        decorated = False
        follows = FOLLOWS.get(word)
        if follows and heads[-1] not in follows or word == "else" and heads[-1] == "try":
            fail(first, f"{word} without its beginning")
        elif heads[-1] == "try" and word not in ("except", "finally"):
            fail(first, "try without except or finally")
        heads[-1] = "closed" if word == "finally" or word == "else" and heads[-1] != "except" else "else" if word == "else" else word
        if kind > 0:
            expect = word
    if expect:
        fail(n - 1, f"expected an indented block after {expect}")
    if decorated:
        fail(n - 1, "decorator without definition")
    if "try" in heads:
        fail(n - 1, "try without except or finally")
    return errors


def _line_text(text: str, raw: list[str], index: int) -> str:
    """First word of the line for soft keywords. Lines inside strings make counting inexact, so a search decides."""
    for w in SOFT:
        if w in text and re.search(rf"(?m)^[ \t]*{w}\b[^\n]*", text):
            # position of this logical line among newline tokens
            toks = [m for m in LEX.pattern.finditer("\n" + text) if m[0][0] == "\n"]
            start = toks[index].end() - 1
            return re.match(r"\w*", text[start:])[0]
    return ""
