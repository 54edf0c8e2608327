"""ECMAScript (script or module) and TypeScript: recursive-descent statements, precedence-climbing expressions."""

from __future__ import annotations

import re

from .base import BAD, END, Bad, Lexicon, Parser, lines_of

_ID = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:\w|\$|\\u[0-9a-fA-F]{4})*"
_NUMBER = r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\w$])"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_BEFORE = r"(?:(?<=[=(,:\[!&|?{};+*%<>~^\n-])|(?<=[=(,:\[!&|?{};+*%<>~^-] )|(?<=return )|(?<=typeof )|(?<=case )|(?<=\A))"
_PLAIN_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{))*`"
_HEAD = "\ue010"  # begins a template with substitutions


def _classify(t: str) -> str | None:
    c = t[0]
    if c == "\n":
        return "\n"
    if t[:2] == "//" or t[:2] == "#!":
        return ""
    if t[:2] == "/*":
        return BAD if len(t) < 4 else "\n" if "\n" in t else ""
    if c in "\"'":
        return '"' if len(t) > 1 else BAD
    if c == "`":
        return "`" if len(t) > 1 else BAD
    if c == "/" and len(t) > 2:
        return '"' if re.fullmatch(r".*/[dgimsuvy]*", t, re.S) else BAD
    if c.isdigit() or c == "." and len(t) > 1 and t != "...":
        return "0" if re.fullmatch(_NUMBER, t) else BAD
    if c == "#":
        return "p" if len(t) > 1 else BAD
    if c == "\\":
        return "a" if len(t) > 1 else BAD
    if c == _HEAD:
        return _HEAD
    return None


WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with "
    "let static yield await async of as from get set type interface implements private protected public readonly declare abstract namespace module keyof infer is satisfies asserts override unique global accessor require"
)
OPS = (
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> **"
)
LEX = Lexicon(
    rf"\n\s*|//[^\n]*|/\*.*?\*/|/\*|\A\#![^\n]*|{_QUOTED}|{_PLAIN_TEMPLATE}|{_BEFORE}{_REGEX}|\#?{_ID}|{_NUMBER}|\d[\w.$]*"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[+\-*/%&|^]=|<<|\*\*|\S",
    WORDS, OPS, _classify,
)
K = LEX.chars
CONTEXTUAL = "let static yield await async of as from get set type interface implements private protected public readonly declare abstract namespace module keyof infer is satisfies asserts override unique global accessor require".split()
STRICT_WORDS = set("let static yield implements private protected public interface".split())
IDENT = frozenset("a") | {K[w] for w in CONTEXTUAL}
ANY_WORD = IDENT | {K[w] for w in WORDS.split()}
LITERAL = frozenset('0"') | {K[w] for w in ("true", "false", "null", "this")}
ASSIGN = frozenset("=") | {K[w] for w in ">>>= **= <<= >>= &&= ||= ??= += -= *= /= %= &= |= ^=".split()}
BINARY = {K["??"]: 1, K["||"]: 2, K["&&"]: 3, "|": 4, "^": 5, "&": 6, K["=="]: 7, K["!="]: 7, K["==="]: 7, K["!=="]: 7, "<": 8, ">": 8, K["<="]: 8, K[">="]: 8, K["instanceof"]: 8, K["in"]: 8, K["<<"]: 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
PREFIX = frozenset("!~+-") | {K[w] for w in ("typeof", "void", "delete")}
MODIFIERS = {K[w] for w in "private protected public readonly declare abstract override static accessor".split()}
# newlines that can not end a statement
_NO_END = re.compile(
    "(?<=[" + re.escape("".join(sorted(ASSIGN | set(BINARY) | set("([{,;:?.!~\n") | {K["=>"], K["..."]}))) + "])\n+"
    "|\n+(?=[" + re.escape("".join(sorted((ASSIGN | set(BINARY) | set("()[],;:?.}`") | {K["=>"], K["?."], END}) - {"+", "-"}))) + "])|\n+(?=[+-])|\\A\n+"
)
SEEN: dict[bool, set[str]] = {False: set(), True: set()}


class Script(Parser):
    context = re.compile("[" + "".join(K[w] for w in ("await", "super", "break", "continue")) + "]")

    def __init__(self, kinds: str, ts: bool):
        super().__init__(_NO_END.sub("", kinds))
        self.ts = ts
        self.no_in = False
        self.last = ""  # what the expression parsed last is: t target, p pattern-like literal, c other
        self.in_function = self.in_type = 0
        # what stands around: whether await is an operator (at the top: of a module), super may be used, loops, breakable statements, labels
        self.awaits, self.supers, self.loops, self.breaks, self.labels = True, False, 0, 0, 0

    # -- helpers
    def nl(self, i: int) -> int:
        while self.s[i] == "\n":
            i += 1
        return i

    def semi(self, i: int) -> int:
        c = self.s[i]
        if c == ";" or c == "\n":
            return i + 1
        if c == "}" or c == END:
            return i
        raise Bad(i, "invalid token" if c == BAD else "unexpected token")

    def ident(self, i: int) -> int:
        if self.s[i] not in IDENT:
            raise Bad(i)
        return i + 1

    # -- statements
    def statement(self, i: int) -> int:
        c = self.s[i]
        if c == "\n" or c == ";":
            return i + 1
        if c in SIMPLE_START and not self.ambient:  # what is accepted there may be invalid elsewhere
            return self.remembered(SEEN[self.ts], self.statement_, i)
        return self.statement_(i)

    def statement_(self, i: int) -> int:
        s = self.s
        c = s[i]
        w = LEX.names.get(c)
        if c == "{":
            return self.block(i)
        rule = getattr(self, "s_" + w, None) if w else None
        if rule:
            e = rule(i)
            if e >= 0:
                return e
        if c in IDENT and s[i + 1] == ":":
            self.labels += 1
            try:
                return self.statement(self.nl(i + 2))
            finally:
                self.labels -= 1
        if c == "@":
            i = self.decorators(i)
            if s[i] not in (K["class"], K["export"], K["abstract"]):
                raise Bad(i)
            return self.statement(i)
        return self.semi(self.expression(i))

    def block(self, i: int) -> int:
        i = self.need(self.nl(i), "{")
        return self.need(self.block_items(i, self.statement, "}"), "}")

    def body(self, i: int) -> int:
        """A function body; the caller has set what ``await`` and ``super`` mean in it."""
        self.in_function += 1
        old, self.no_in = self.no_in, False
        around = self.loops, self.breaks, self.labels
        self.loops = self.breaks = self.labels = 0
        try:
            return self.block(i)
        finally:
            self.in_function -= 1
            self.no_in = old
            self.loops, self.breaks, self.labels = around

    def within(self, rule, i: int, awaits: bool, supers: bool | None = None) -> int:
        """``rule`` at i inside a function that is async or not; ``supers`` None keeps what holds around (arrows)."""
        around = self.awaits, self.supers
        self.awaits = awaits
        if supers is not None:
            self.supers = supers
        try:
            return rule(i)
        finally:
            self.awaits, self.supers = around

    def loop(self, i: int) -> int:
        """The statement of a loop."""
        self.loops += 1
        self.breaks += 1
        try:
            return self.sub(i)
        finally:
            self.loops -= 1
            self.breaks -= 1

    def paren(self, i: int) -> int:
        i = self.need(self.nl(i), "(")
        return self.need(self.nl(self.expression(self.nl(i))), ")")

    def sub(self, i: int) -> int:
        i = self.nl(i)
        if self.s[i] in (END, "}"):
            raise Bad(i)
        return self.statement_(i) if self.s[i] != ";" else i + 1

    def s_if(self, i: int) -> int:
        i = self.sub(self.paren(i + 1))
        j = self.nl(i)
        return self.sub(j + 1) if self.s[j] == K["else"] else i

    def s_while(self, i: int) -> int:
        return self.loop(self.paren(i + 1))

    def s_with(self, i: int) -> int:
        return self.sub(self.paren(i + 1))

    def s_do(self, i: int) -> int:
        i = self.nl(self.loop(i + 1))
        i = self.paren(self.need(i, K["while"]))
        return i + 1 if self.s[i] in ";\n" else i

    def s_for(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == K["await"]:
            i += 1
        i = self.need(i, "(")
        self.no_in, old = True, self.no_in
        try:
            if s[i] == ";":
                pass
            elif s[i] in (K["var"], K["const"]) or s[i] == K["let"] and s[i + 1] in IDENT | {"[", "{"}:
                i = self.bindings(i + 1, False)
            else:
                i = self.expression(i)
                if s[i] != ";" and self.last == "c":
                    raise Bad(i)
        finally:
            self.no_in = old
        if s[i] == K["of"]:
            return self.loop(self.need(self.nl(self.assign(i + 1)), ")"))
        if s[i] == K["in"]:
            return self.loop(self.need(self.nl(self.expression(i + 1)), ")"))
        i = self.need(i, ";")
        if s[i] != ";":
            i = self.expression(i)
        i = self.need(i, ";")
        if s[i] != ")":
            i = self.expression(i)
        return self.loop(self.need(self.nl(i), ")"))

    def s_switch(self, i: int) -> int:
        s = self.s
        i = self.nl(self.need(self.nl(self.paren(i + 1)), "{"))
        while s[i] != "}":
            if s[i] == K["case"]:
                i = self.need(self.expression(i + 1), ":")
            elif s[i] == K["default"]:
                i = self.need(i + 1, ":")
            else:
                raise Bad(i)
            stops = ("}", K["case"], K["default"])
            while s[i] not in stops:
                if s[i] == END:
                    raise Bad(i, "missing bracket")
                self.breaks += 1
                try:
                    i = self.statement(i)
                finally:
                    self.breaks -= 1
        return i + 1

    def s_try(self, i: int) -> int:
        s = self.s
        i = self.nl(self.block(i + 1))
        if s[i] not in (K["catch"], K["finally"]):
            raise Bad(i, "try without catch or finally")
        if s[i] == K["catch"]:
            i = self.nl(i + 1)
            if s[i] == "(":
                i = self.binding(i + 1)
                if self.ts and s[i] == ":":
                    i = self.type(i + 1)
                i = self.need(i, ")")
            e = self.block(i)
            i = self.nl(e)
            if s[i] != K["finally"]:
                return e
        return self.block(i + 1)

    def s_return(self, i: int) -> int:
        if not self.in_function:
            raise Bad(i, "return outside a function")
        return self.semi(i + 1) if self.s[i + 1] in ";\n}\0" else self.semi(self.expression(i + 1))

    def s_throw(self, i: int) -> int:
        if self.s[i + 1] in "\n;}":
            raise Bad(i + 1)
        return self.semi(self.expression(i + 1))

    def s_break(self, i: int) -> int:
        if self.s[i + 1] in IDENT:
            if not self.labels:
                raise Bad(i, "break to no label")
            return self.semi(i + 2)
        if not self.breaks:
            raise Bad(i, "break outside a loop or switch")
        return self.semi(i + 1)

    def s_continue(self, i: int) -> int:
        if not self.loops:
            raise Bad(i, "continue outside a loop")
        if self.s[i + 1] in IDENT:
            if not self.labels:
                raise Bad(i, "continue to no label")
            return self.semi(i + 2)
        return self.semi(i + 1)

    def s_debugger(self, i: int) -> int:
        return self.semi(i + 1)

    def s_var(self, i: int) -> int:
        return self.semi(self.bindings(i + 1, False))

    def s_const(self, i: int) -> int:
        if self.ts and self.s[i + 1] == K["enum"]:
            return self.s_enum(i + 1)
        return self.semi(self.bindings(i + 1, True))

    def s_let(self, i: int) -> int:
        return self.semi(self.bindings(i + 1, False)) if self.s[i + 1] in IDENT | {"[", "{"} else -1

    def bindings(self, i: int, must: bool) -> int:
        s = self.s
        while True:
            pattern = s[i] in "[{"
            i = self.binding(self.nl(i))
            if self.ts:
                if s[i] == "!":
                    i += 1
                if s[i] == ":":
                    i = self.type(i + 1)
            if s[i] == "=":
                i = self.assign(i + 1)
            elif (must or pattern) and not self.no_in and not (self.ts and self.ambient):
                raise Bad(i, "missing initializer")
            if s[i] != ",":
                return i
            i += 1

    ambient = 0

    def binding(self, i: int) -> int:
        """A name or a destructuring pattern."""
        s = self.s
        if s[i] in IDENT:
            return i + 1
        if s[i] == "[":
            i = self.nl(i + 1)
            while s[i] != "]":
                if s[i] == ",":
                    i = self.nl(i + 1)
                    continue
                if s[i] == K["..."]:
                    i += 1
                i = self.default(self.binding(i))
                if s[i] != ",":
                    break
                i = self.nl(i + 1)
            return self.need(self.nl(i), "]")
        if s[i] == "{":
            i = self.nl(i + 1)
            while s[i] != "}":
                if s[i] == K["..."]:
                    i = self.ident(i + 1)
                else:
                    name = s[i] in IDENT
                    i = self.key(i)
                    if s[i] == ":":
                        i = self.binding(self.nl(i + 1))
                    elif not name:
                        raise Bad(i)
                    i = self.default(i)
                i = self.nl(i)
                if s[i] != ",":
                    break
                i = self.nl(i + 1)
            return self.need(i, "}")
        raise Bad(i, "invalid token" if s[i] == BAD else "unexpected token")

    def default(self, i: int) -> int:
        return self.assign(i + 1) if self.s[i] == "=" else i

    def key(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in ANY_WORD or c in '"0p':
            return i + 1
        if c == "[":
            old, self.no_in = self.no_in, False
            i = self.need(self.nl(self.assign(self.nl(i + 1))), "]")
            self.no_in = old
            return i
        raise Bad(i, "invalid token" if c == BAD else "unexpected token")

    def s_function(self, i: int) -> int:
        return self.function(i, True)

    def s_async(self, i: int) -> int:
        return self.function(i + 1, True, True) if self.s[i + 1] == K["function"] else -1

    def function(self, i: int, named: bool, awaits: bool = False) -> int:
        s = self.s
        i += 1
        if s[i] == "*":
            i += 1
        if s[i] in IDENT:
            i += 1
        elif named:
            raise Bad(i)
        return self.signature_body(i, named, awaits, False)

    def signature_body(self, i: int, may_lack: bool, awaits: bool, supers: bool) -> int:
        return self.within(lambda i: self.signed_body(i, may_lack), i, awaits, supers)

    def signed_body(self, i: int, may_lack: bool) -> int:
        i = self.signature(i)
        if self.ts and may_lack and self.s[self.nl(i)] != "{":
            return self.semi(i)  # an overload or a declaration
        return self.body(i)

    def signature(self, i: int) -> int:
        s = self.s
        if self.ts and s[i] == "<":
            i = self.type_params(i)
        i = self.params(self.need(self.nl(i), "("))
        if self.ts and s[i] == ":":
            i = self.return_type(i + 1)
        return i

    def params(self, i: int) -> int:
        s = self.s
        i = self.nl(i)
        while s[i] != ")":
            rest = s[i] == K["..."]
            if rest:
                i += 1
            if self.ts:
                if s[i] == "@":
                    i = self.decorators(i)
                while s[i] in MODIFIERS and s[i + 1] in IDENT | {"[", "{"}:
                    i += 1
                if s[i] == K["this"]:
                    i += 1
                else:
                    i = self.binding(i)
                if s[i] == "?":
                    i += 1
                if s[i] == ":":
                    i = self.type(i + 1)
            else:
                i = self.binding(i)
            i = self.nl(self.default(i))
            if s[i] != ",":
                break
            if rest:
                raise Bad(i, "rest parameter must be last")
            i = self.nl(i + 1)
        return self.need(i, ")")

    def s_class(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] in IDENT and s[i] != K["implements"]:
            i += 1
        elif s[i - 2] != K["default"] or i < 2:  # only an export by default may have no name
            raise Bad(i)
        return self.class_rest(i)

    def class_rest(self, i: int) -> int:
        s = self.s
        if self.ts and s[i] == "<":
            i = self.type_params(i)
        i = self.nl(i)
        if s[i] == K["extends"]:
            i = self.lhs(i + 1)
            if self.ts and s[i] == "<":
                i = self.type_args(i)
        i = self.nl(i)
        if self.ts and s[i] == K["implements"]:
            i = self.type_list(i + 1)
        i = self.need(self.nl(i), "{")
        old, self.no_in = self.no_in, False
        i = self.need(self.block_items(i, self.member, "}"), "}")
        self.no_in = old
        return i

    def member(self, i: int) -> int:
        s = self.s
        if s[i] in ";\n":
            return i + 1
        if s[i] == "@":
            i = self.decorators(i)
        if s[i] == K["static"] and s[self.nl(i + 1)] == "{":
            return self.within(self.body, i + 1, False, True)
        ends = "(=;\n}?!:<,"
        while (s[i] in MODIFIERS if self.ts else s[i] in (K["static"], K["accessor"])) and s[i + 1] not in ends:
            i += 1
        awaits = s[i] == K["async"] and s[i + 1] not in ends
        if awaits:
            i += 1
        if s[i] == "*":
            i += 1
        elif s[i] in (K["get"], K["set"]) and s[i + 1] not in ends:
            i += 1
        if self.ts and s[i] == "[" and s[i + 1] in IDENT and s[i + 2] == ":":
            i = self.need(self.type(i + 3), "]")
            return self.semi(self.type(self.need(i, ":")))
        i = self.key(i)
        if self.ts and s[i] in "?!":
            i += 1
        if s[i] == "(" or self.ts and s[i] == "<":
            return self.signature_body(i, self.ts, awaits, True)
        if self.ts and s[i] == ":":
            i = self.type(i + 1)
        if s[i] == "=":
            self.in_function += 1
            i = self.within(self.assign, i + 1, False, True)
            self.in_function -= 1
        return self.semi(i)

    def decorators(self, i: int) -> int:
        while self.s[i] == "@":
            i = self.nl(self.lhs(i + 1))
        return i

    def s_import(self, i: int) -> int:
        s = self.s
        if s[i + 1] in "(.":
            return -1
        i += 1
        if s[i] == '"':
            return self.semi(self.attributes(i + 1))
        if self.ts and s[i] == K["type"] and s[i + 1] in IDENT | {"{", "*"} and not (s[i + 1] == K["from"] and s[i + 2] == '"'):
            i += 1
        if s[i] in IDENT:
            i += 1
            if self.ts and s[i] == "=":
                i += 1
                if s[i] == K["require"]:
                    return self.semi(self.need(self.need(self.need(i + 1, "("), '"'), ")"))
                return self.semi(self.lhs(i))
            if s[i] == ",":
                i += 1
                if s[i] not in "*{":
                    raise Bad(i)
        if s[i] == "*":
            i = self.ident(self.need(i + 1, K["as"]))
        elif s[i] == "{":
            i = self.specifiers(i, True)
        return self.semi(self.attributes(self.need(self.need(i, K["from"]), '"')))

    def attributes(self, i: int) -> int:
        s = self.s
        if s[i] == K["with"] and s[i + 1] == "{":
            return self.primary(i + 1)
        return i

    def specifiers(self, i: int, importing: bool) -> int:
        s = self.s
        i = self.nl(i + 1)
        while s[i] != "}":
            if self.ts and s[i] == K["type"] and s[i + 1] in ANY_WORD and s[i + 1] != K["as"]:
                i += 1
            plain = s[i] in IDENT
            if s[i] not in ANY_WORD and s[i] != '"':
                raise Bad(i, "invalid token" if s[i] == BAD else "unexpected token")
            i += 1
            if s[i] == K["as"]:
                i += 1
                if s[i] not in (IDENT if importing else ANY_WORD | {'"'}):
                    raise Bad(i)
                i += 1
            elif importing and not plain:
                raise Bad(i)
            i = self.nl(i)
            if s[i] != ",":
                break
            i = self.nl(i + 1)
        return self.need(i, "}")

    def s_export(self, i: int) -> int:
        s = self.s
        i += 1
        c = s[i]
        if self.ts and c == K["type"] and s[i + 1] in "{*":
            i, c = i + 1, s[i + 1]
        if c == "*":
            i += 1
            if s[i] == K["as"]:
                if s[i + 1] not in ANY_WORD | {'"'}:
                    raise Bad(i + 1)
                i += 2
            return self.semi(self.attributes(self.need(self.need(i, K["from"]), '"')))
        if c == "{":
            i = self.specifiers(i, False)
            if s[i] == K["from"]:
                i = self.attributes(self.need(i + 1, '"'))
            return self.semi(i)
        if c == K["default"]:
            i += 1
            if s[i] == K["function"]:
                return self.function(i, False) if not self.ts else self.signature_body(self.fname(i), True, False, False)
            if s[i] == K["async"] and s[i + 1] == K["function"]:
                return self.function(i + 1, False, True)
            if s[i] == "@":
                i = self.decorators(i)
            if s[i] == K["class"]:
                return self.s_class(i)
            if self.ts and s[i] in (K["abstract"], K["interface"]) and s[i + 1] in ANY_WORD:
                return self.statement_(i)
            return self.semi(self.assign(i))
        if self.ts and c == "=":
            return self.semi(self.assign(i + 1))
        if self.ts and c == K["as"]:
            return self.semi(self.ident(self.need(i + 1, K["namespace"])))
        if self.ts and c == K["import"]:
            return self.s_import(i)
        if c == "@":
            i = self.decorators(i)
            c = s[i]
        allowed = [K[w] for w in ("var", "let", "const", "function", "async", "class")]
        if self.ts:
            allowed += [K[w] for w in ("interface", "type", "enum", "namespace", "module", "declare", "abstract")]
        if c not in allowed or c == K["async"] and s[i + 1] != K["function"] or c == K["let"] and s[i + 1] not in IDENT | {"[", "{"}:
            raise Bad(i)
        return self.statement_(i)

    def fname(self, i: int) -> int:
        i += 1
        if self.s[i] == "*":
            i += 1
        return i + 1 if self.s[i] in IDENT else i

    # -- TypeScript statements; as plain names in ECMAScript
    def s_interface(self, i: int) -> int:
        s = self.s
        if not self.ts or s[i + 1] not in IDENT:
            return -1
        i += 2
        if s[i] == "<":
            i = self.type_params(i)
        if s[i] == K["extends"]:
            i = self.type_list(i + 1)
        return self.object_type(self.nl(i))

    def s_type(self, i: int) -> int:
        s = self.s
        if not self.ts or s[i + 1] not in IDENT:
            return -1
        i += 2
        if s[i] == "<":
            i = self.type_params(i)
        return self.semi(self.type(self.need(i, "=")))

    def s_enum(self, i: int) -> int:
        s = self.s
        if not self.ts:
            raise Bad(i)
        i = self.nl(self.need(self.ident(i + 1), "{"))
        while s[i] != "}":
            i = self.nl(self.default(self.key(i)))
            if s[i] != ",":
                break
            i = self.nl(i + 1)
        return self.need(i, "}")

    def s_namespace(self, i: int) -> int:
        s = self.s
        if not self.ts or s[i + 1] not in IDENT and s[i + 1] != '"':
            return -1
        i += 2
        while s[i] == ".":
            i = self.ident(i + 1)
        if s[i] != "{":
            return self.semi(i)
        return self.block(i)

    s_module = s_namespace

    def s_global(self, i: int) -> int:
        return self.block(i + 1) if self.ts and self.s[i + 1] == "{" else -1

    def s_declare(self, i: int) -> int:
        if not self.ts or self.s[i + 1] not in ANY_WORD or self.s[i + 1] == K["in"] or self.s[i + 1] == K["instanceof"]:
            return -1
        self.ambient += 1
        try:
            return self.statement_(i + 1)
        finally:
            self.ambient -= 1

    def s_abstract(self, i: int) -> int:
        return self.s_class(i + 1) if self.ts and self.s[i + 1] == K["class"] else -1

    # -- expressions
    def expression(self, i: int) -> int:
        i = self.assign(i)
        while self.s[i] == ",":
            i = self.assign(self.nl(i + 1))
            self.last = "c"
        return i

    def assign(self, i: int) -> int:
        s = self.s
        i = self.nl(i)
        c = s[i]
        if c == K["yield"] and s[i + 1] not in ASSIGN:
            self.last = "c"
            i += 1
            if s[i] == "*":
                return self.assign(i + 1)
            return i if s[i] in ")]},;:\n\0" or s[i] in (K["in"], K["of"]) else self.assign(i)
        if c in IDENT:
            if s[i + 1] == K["=>"]:
                return self.arrow(i + 2, False)
            if c == K["async"]:
                if s[i + 1] in IDENT and s[i + 2] == K["=>"]:
                    return self.arrow(i + 3, True)
                if s[i + 1] in "(<":
                    e = self.try_arrow(i + 1, True)
                    if e >= 0:
                        return e
        elif c == "(" or c == "<" and self.ts:
            e = self.try_arrow(i)
            if e >= 0:
                return e
        i = self.conditional(i)
        if s[i] in ASSIGN:
            if self.last == "c" or self.last == "p" and s[i] != "=":
                raise Bad(i, "no target")
            i = self.assign(i + 1)
            self.last = "c"
        return i

    def try_arrow(self, i: int, awaits: bool = False) -> int:
        """Behind the arrow function that begins at this bracket, or -1."""
        s = self.s
        if s[i] == "(":
            j = self.partner(i)
            if j < 0:
                return -1
            after = s[j + 1]
            if after != K["=>"] and not (self.ts and after == ":"):
                return -1
            if after == ":":
                errors = len(self.errors)
                try:
                    e = self.return_type(self.enter_params(i))
                    if s[e] != K["=>"]:
                        raise Bad(e)
                except Bad:
                    del self.errors[errors:]
                    return -1
                return self.arrow(e + 1, awaits)
            e = self.params(i + 1)
            return self.arrow(self.need(e, K["=>"]), awaits)
        try:
            e = self.type_params(i)
            if s[e] != "(":
                return -1
            e = self.params(e + 1)
            if s[e] == ":":
                e = self.return_type(e + 1)
            if s[e] != K["=>"]:
                return -1
        except Bad:
            return -1
        return self.arrow(e + 1, awaits)

    def enter_params(self, i: int) -> int:
        return self.need(self.params(i + 1), ":")

    def arrow(self, i: int, awaits: bool) -> int:
        i = self.nl(i)
        i = self.within(self.body if self.s[i] == "{" else self.concise, i, awaits)
        self.last = "c"
        return i

    def concise(self, i: int) -> int:
        self.in_function += 1
        try:
            return self.assign(i)
        finally:
            self.in_function -= 1

    def conditional(self, i: int) -> int:
        s = self.s
        i = self.binary(i, 1)
        if s[i] == "?":
            old, self.no_in = self.no_in, False
            i = self.assign(i + 1)
            self.no_in = old
            i = self.assign(self.need(self.nl(i), ":"))
            self.last = "c"
        return i

    def binary(self, i: int, level: int) -> int:
        s = self.s
        i = self.unary(i)
        while True:
            c = s[i]
            p = BINARY.get(c, 0)
            if p < level or not p:
                if self.ts and (c == K["as"] or c == K["satisfies"]) and level <= 8:
                    i = self.type(i + 1) if s[i + 1] != K["const"] else i + 2
                    self.last = "c"
                    continue
                return i
            if c == K["in"] and self.no_in:
                return i
            if c == ">":  # shifts come as single signs
                while s[i + 1] == ">":
                    i += 1
                if s[i + 1] == K[">="]:
                    i += 1
                    i = self.assign(i + 1)
                    self.last = "c"
                    continue
            i = self.binary(self.nl(i + 1), p + 1)
            self.last = "c"

    def unary(self, i: int) -> int:
        s = self.s
        i = self.nl(i)
        c = s[i]
        if c in PREFIX:
            i = self.unary(i + 1)
            self.last = "c"
            if s[i] == K["**"]:
                raise Bad(i)
            return i
        if c == K["await"] and (self.awaits or not self.in_function) and (s[i + 1] in ANY_WORD or s[i + 1] in '("[`{0' or s[i + 1] == _HEAD) and s[i + 1] not in (K["in"], K["of"], K["instanceof"], K["as"]):
            i = self.unary(i + 1)
            self.last = "c"
        elif c == K["++"] or c == K["--"]:
            i = self.unary(i + 1)
            if self.last != "t":
                raise Bad(i, "no target")
            self.last = "c"
        elif c == "<" and self.ts:
            i = self.unary(self.need(self.type(i + 1), ">"))
            self.last = "c"
        else:
            i = self.lhs(i)
            if s[i] == K["++"] or s[i] == K["--"]:
                if self.last != "t":
                    raise Bad(i, "no target")
                i += 1
                self.last = "c"
        if s[i] == K["**"]:
            i = self.unary(i + 1)
            self.last = "c"
        return i

    def lhs(self, i: int) -> int:
        """Member accesses and calls."""
        s = self.s
        i = self.nl(i)
        if s[i] == K["new"]:
            if s[i + 1] == "." and s[i + 2] == "a":
                i += 3
            else:
                i = self.new(i)
            self.last = "c"
        else:
            i = self.primary(i)
        return self.suffixes(i, True)

    def new(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == K["new"]:
            i = self.new(i)
        else:
            i = self.suffixes(self.primary(i), False)
        if self.ts and s[i] == "<":
            j = self.try_type_args(i)
            i = j if j >= 0 else i
        return self.args(i) if s[i] == "(" else i

    def suffixes(self, i: int, calls: bool) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == ".":
                if s[i + 1] not in ANY_WORD and s[i + 1] != "p":
                    raise Bad(i + 1)
                i += 2
                self.last = "t"
            elif c == "(":
                if not calls:
                    return i
                i = self.args(i)
                self.last = "c"
            elif c == "[":
                old, self.no_in = self.no_in, False
                i = self.need(self.nl(self.expression(i + 1)), "]")
                self.no_in = old
                self.last = "t"
            elif c == K["?."]:
                if not calls:
                    raise Bad(i)
                i += 1
                if s[i] == "(":
                    i = self.args(i)
                elif s[i] == "[":
                    i = self.need(self.nl(self.expression(i + 1)), "]")
                elif s[i] in ANY_WORD or s[i] == "p":
                    i += 1
                else:
                    raise Bad(i)
                self.last = "c"
            elif c == "`":
                i += 1
                self.last = "c"
            elif c == _HEAD:
                i = self.template(i)
            elif self.ts and c == "!" and s[i + 1] != "=":
                i += 1
            elif self.ts and c == "<" and calls:
                j = self.try_type_args(i)
                if j < 0 or s[j] not in "(`" and s[j] != _HEAD:
                    return i
                i = j
            else:
                return i

    def args(self, i: int) -> int:
        s = self.s
        old, self.no_in = self.no_in, False
        i = self.nl(i + 1)
        while s[i] != ")":
            if s[i] == K["..."]:
                i += 1
            i = self.nl(self.assign(i))
            if s[i] != ",":
                break
            i = self.nl(i + 1)
        self.no_in = old
        return self.need(i, ")")

    def template(self, i: int) -> int:
        i = self.need(i + 1, "(")
        i = self.expression(i)
        while self.s[self.nl(i)] == ";":
            i = self.expression(self.nl(i) + 1)
        self.last = "c"
        return self.need(self.nl(i), ")")

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in IDENT:
            if c == K["async"] and s[i + 1] == K["function"]:
                i = self.function(i + 1, False, True)
                self.last = "c"
                return i
            self.last = "t"
            return i + 1
        self.last = "c"
        if c in LITERAL or c == "`":
            return i + 1
        if c == "(":
            old, self.no_in = self.no_in, False
            i = self.expression(i + 1)
            self.no_in = old
            if self.last == "p":
                self.last = "c"
            return self.need(self.nl(i), ")")
        if c == "[":
            return self.array(i)
        if c == "{":
            return self.object(i)
        if c == K["function"]:
            i = self.function(i, False)
        elif c == K["class"]:
            i += 1
            if s[i] in IDENT and s[i] != K["implements"]:
                i += 1
            i = self.class_rest(i)
        elif c == _HEAD:
            i = self.template(i)
        elif c == K["super"]:
            if s[i + 1] not in ".[(":
                raise Bad(i + 1)
            if not self.supers:
                raise Bad(i, "super outside a method")
            return i + 1
        elif c == K["import"]:
            if s[i + 1] == "." and s[i + 2] in ANY_WORD:
                return i + 3
            if s[i + 1] != "(":
                raise Bad(i + 1)
            return i + 1
        elif c == "p" and s[i + 1] == K["in"]:
            return i + 1
        elif c == "@":
            return self.primary(self.decorators(i))
        else:
            raise Bad(i, "invalid token" if c == BAD else "unexpected token")
        self.last = "c"
        return i

    def array(self, i: int) -> int:
        s = self.s
        old, self.no_in = self.no_in, False
        i = self.nl(i + 1)
        while s[i] != "]":
            if s[i] == ",":
                i = self.nl(i + 1)
                continue
            if s[i] == K["..."]:
                i += 1
            i = self.nl(self.assign(i))
            if s[i] != ",":
                break
            i = self.nl(i + 1)
        self.no_in = old
        self.last = "p"
        return self.need(i, "]")

    def object(self, i: int) -> int:
        s = self.s
        old, self.no_in = self.no_in, False
        i = self.nl(i + 1)
        while s[i] != "}":
            i = self.nl(self.property(i))
            if s[i] != ",":
                break
            i = self.nl(i + 1)
        self.no_in = old
        self.last = "p"
        return self.need(i, "}")

    def property(self, i: int) -> int:
        s = self.s
        if s[i] == K["..."]:
            return self.assign(i + 1)
        ends = ":,(}=\n" + ("<" if self.ts else "")
        if s[i] == K["async"] and s[i + 1] not in ends:
            i += 1
            if s[i] == "*":
                i += 1
            return self.signature_body(self.key(i), False, True, True)
        if s[i] == "*":
            return self.signature_body(self.key(i + 1), False, False, True)
        if s[i] in (K["get"], K["set"]) and s[i + 1] not in ends:
            return self.signature_body(self.key(i + 1), False, False, True)
        name = s[i] in IDENT
        i = self.key(i)
        if s[i] == ":":
            return self.assign(i + 1)
        if s[i] == "(" or self.ts and s[i] == "<":
            return self.signature_body(i, False, False, True)
        if not name:
            raise Bad(i)
        return self.default(i)  # a default makes it a pattern, which the caller may need

    # -- types
    def type(self, i: int) -> int:
        s = self.s
        i = self.nl(i)
        if s[i] == "<" or s[i] == K["new"] or s[i] == K["abstract"] and s[i + 1] == K["new"]:
            return self.function_type(i)
        if s[i] == "(":
            j = self.partner(i)
            if j < 0:
                raise Bad(len(s) - 8, "missing bracket")
            if s[j + 1] == K["=>"]:
                return self.function_type(i)
        i = self.union(i)
        if s[i] == K["extends"] and not self.no_conditional:
            self.no_conditional += 1
            i = self.type(i + 1)
            self.no_conditional -= 1
            i = self.type(self.need(self.nl(i), "?"))
            i = self.type(self.need(self.nl(i), ":"))
        return i

    no_conditional = 0

    def function_type(self, i: int) -> int:
        s = self.s
        if s[i] == K["abstract"]:
            i += 1
        if s[i] == K["new"]:
            i += 1
        if s[i] == "<":
            i = self.type_params(i)
        i = self.params(self.need(i, "("))
        return self.return_type(self.need(i, K["=>"]))

    def return_type(self, i: int) -> int:
        s = self.s
        i = self.nl(i)
        if s[i] == K["asserts"] and (s[i + 1] in IDENT or s[i + 1] == K["this"]):
            i += 1
            if s[i + 1] != K["is"]:
                return i + 1
        if (s[i] in IDENT or s[i] == K["this"]) and s[i + 1] == K["is"]:
            i += 2
        return self.type(i)

    def union(self, i: int) -> int:
        s = self.s
        if s[i] in "|&":
            i += 1
        i = self.postfix_type(i)
        while s[i] in "|&":
            i = self.postfix_type(self.nl(i + 1))
        return i

    def postfix_type(self, i: int) -> int:
        s = self.s
        i = self.nl(i)
        while s[i] in (K["keyof"], K["readonly"], K["unique"]) and (s[i + 1] in ANY_WORD or s[i + 1] in "[{("):
            i += 1
        if s[i] == K["infer"] and s[i + 1] in IDENT:
            i += 2
        else:
            i = self.primary_type(i)
        while s[i] == "[":
            if s[i + 1] == "]":
                i += 2
            else:
                i = self.need(self.nl(self.type(i + 1)), "]")
        return i

    def primary_type(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in IDENT:
            i += 1
            while s[i] == "." and s[i + 1] in ANY_WORD:
                i += 2
            return self.type_args(i) if s[i] == "<" else i
        if c in '"0`' or c in (K["null"], K["true"], K["false"], K["this"], K["void"]):
            return i + 1
        if c == "-" and s[i + 1] == "0":
            return i + 2
        if c == _HEAD:
            i = self.need(i + 1, "(")
            i = self.type(i)
            while s[i] == ";":
                i = self.type(i + 1)
            return self.need(i, ")")
        if c == "(":
            return self.need(self.nl(self.type(i + 1)), ")")
        if c == "[":
            i = self.nl(i + 1)
            while s[i] != "]":
                if s[i] == K["..."]:
                    i += 1
                if s[i] in ANY_WORD and (s[i + 1] == ":" or s[i + 1] == "?" and s[i + 2] == ":"):
                    i += 2 + (s[i + 1] == "?")
                i = self.type(i)
                if s[i] == "?":
                    i += 1
                i = self.nl(i)
                if s[i] != ",":
                    break
                i = self.nl(i + 1)
            return self.need(i, "]")
        if c == "{":
            return self.object_type(i)
        if c == K["typeof"]:
            if s[i + 1] == K["import"]:
                return self.primary_type(i + 1)
            i += 1
            if s[i] not in IDENT and s[i] != K["this"]:
                raise Bad(i)
            i += 1
            while s[i] == "." and (s[i + 1] in ANY_WORD or s[i + 1] == "p"):
                i += 2
            return self.type_args(i) if s[i] == "<" else i
        if c == K["import"]:
            i = self.need(self.type(self.need(i + 1, "(")), ")")
            while s[i] == "." and s[i + 1] in ANY_WORD:
                i += 2
            return self.type_args(i) if s[i] == "<" else i
        raise Bad(i, "invalid token" if c == BAD else "unexpected token")

    def object_type(self, i: int) -> int:
        s = self.s
        i = self.nl(self.need(i, "{"))
        while s[i] != "}":
            i = self.type_member(i)
            if s[i] in ",;\n":
                i = self.nl(i + 1)
            elif s[i] != "}":
                raise Bad(i, "missing bracket" if s[i] == END else "unexpected token")
        return i + 1

    def type_member(self, i: int) -> int:
        s = self.s
        ends = "(:?;,}<\n"
        if s[i] in "(<":
            i = self.signature(i)
            return i
        if s[i] == K["new"] and s[i + 1] in "(<":
            return self.signature(i + 1)
        if s[i] in "+-" and s[i + 1] == K["readonly"]:
            i += 1
        if s[i] == K["readonly"] and s[i + 1] not in ends:
            i += 1
        if s[i] in (K["get"], K["set"]) and s[i + 1] not in ends:
            i += 1
        if s[i] == "[" and s[i + 1] in IDENT and s[i + 2] in (":", K["in"]):
            i = self.type(i + 3)
            if s[i] == K["as"]:
                i = self.type(i + 1)
            i = self.need(i, "]")
        else:
            i = self.key(i)
        if s[i] in "+-" and s[i + 1] == "?":
            i += 1
        if s[i] == "?":
            i += 1
        if s[i] in "(<":
            return self.signature(i)
        return self.type(i + 1) if s[i] == ":" else i

    def type_list(self, i: int) -> int:
        i = self.postfix_type(i)
        while self.s[i] == ",":
            i = self.postfix_type(i + 1)
        return i

    def type_params(self, i: int) -> int:
        s = self.s
        i = self.nl(i + 1)
        if s[i] == ">":
            raise Bad(i)
        while s[i] != ">":
            while s[i] in (K["const"], K["in"]):
                i += 1
            i = self.ident(i)
            if s[i] == K["extends"]:
                i = self.type(i + 1)
            if s[i] == "=":
                i = self.type(i + 1)
            i = self.nl(i)
            if s[i] != ",":
                break
            i = self.nl(i + 1)
        return self.need(i, ">")

    def type_args(self, i: int) -> int:
        s = self.s
        old, self.no_conditional = self.no_conditional, 0
        i = self.nl(self.type(i + 1))
        while s[i] == ",":
            i = self.nl(self.type(i + 1))
        self.no_conditional = old
        return self.need(i, ">")

    def try_type_args(self, i: int) -> int:
        errors = len(self.errors)
        try:
            return self.type_args(i)
        except Bad:
            del self.errors[errors:]
            return -1


SIMPLE_START = IDENT | LITERAL | frozenset("(`") | {K[w] for w in "var const let new import break continue throw await".split()}
SIMPLE_START -= {K[w] for w in "async type interface declare abstract namespace module global".split()}

_SCAN = re.compile(rf"//[^\n]*|/\*.*?\*/|{_QUOTED}|{_BEFORE}{_REGEX}|`", re.S)
_TPL = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_CODE = re.compile(rf"//[^\n]*|/\*.*?\*/|{_QUOTED}|{_BEFORE}{_REGEX}|[`{{}}]", re.S)


def templates(text: str) -> str:
    """Templates with substitutions rewritten as a marker and a bracket with the substituted expressions."""
    out, pos = [], 0
    while (m := _SCAN.search(text, pos)) is not None:
        if m[0] != "`":
            out.append(text[pos : m.end()])
            pos = m.end()
            continue
        made, end = _template(text, m.end())
        out.append(text[pos : m.start()])
        out.append(made)
        pos = end
    out.append(text[pos:])
    return "".join(out)


def _template(text: str, pos: int) -> tuple[str, int]:
    parts, first = [], True
    while True:
        m = _TPL.match(text, pos)
        if not m:  # never closed
            return ("`" if first else "".join(parts) + ")`"), len(text) if not first else pos
        if m[1] == "`":
            if first:
                return "`" + text[pos : m.end()], m.end()
            return "".join(parts) + ")", m.end()
        parts.append(_HEAD + "(" if first else ";")
        first, pos, depth = False, m.end(), 0
        while True:
            c = _CODE.search(text, pos)
            if not c:
                return "".join(parts) + ")`", len(text)
            if c[0] == "`":
                parts.append(text[pos : c.start()])
                made, pos = _template(text, c.end())
                parts.append(made)
                continue
            if c[0] == "}" and not depth:
                parts.append(text[pos : c.start()])
                pos = c.end()
                break
            depth += (c[0] == "{") - (c[0] == "}")
            parts.append(text[pos : c.end()])
            pos = c.end()


_SCOPES = frozenset("{ } let const class var function".split())


def declared_twice(tokens: list[str]) -> list[int]:
    """Indices of names that a block declares again although one of the declarations is by let, const or class.

    Declarations are told apart by the innermost brace they stand in; heads of loops and patterns are left out.
    """
    scopes: list[dict[str, bool]] = [{}]
    out = []
    for k in [k for k, t in enumerate(tokens) if t in _SCOPES]:
        by = tokens[k]
        if by == "{":
            scopes.append({})
            continue
        if by == "}":
            if len(scopes) > 1:
                scopes.pop()
            continue
        n = _token(tokens, k + 1, 1)
        b = _token(tokens, k - 1, -1)
        name, before = tokens[n] if n < len(tokens) else "", tokens[b] if b >= 0 else ";"
        if name == "*" or not (name[:1].isalpha() or name[:1] in ("_", "$")) or before in ("(", "."):
            continue
        if by in ("class", "function"):
            if before not in (";", "{", "}", "export"):  # an expression
                continue
        elif by == "let":
            after = _token(tokens, n + 1, 1)
            if name in ("of", "in", "instanceof") or after < len(tokens) and tokens[after] not in ("=", ";", ","):
                continue
        scope, lexical = scopes[-1], by in ("let", "const", "class")
        if name in scope and (lexical or scope[name]):
            out.append(n)
        scope[name] = scope.get(name, False) or lexical
    return out


def _token(tokens: list[str], k: int, step: int) -> int:
    """The next token from k on that is no line end and no comment."""
    while 0 <= k < len(tokens) and (tokens[k][0] == "\n" or tokens[k][:2] in ("//", "/*")):
        k += step
    return k


def check(text: str, ts: bool) -> list[tuple[int, str]]:
    if "${" in text and "`" in text:
        text = templates(text)
    tokens = LEX.pattern.findall(text)
    kinds = "".join(map(LEX.kinds.__getitem__, tokens))
    p = Script(kinds, ts)
    p.top(p.statement)
    if not p.errors:
        twice = [] if ts else declared_twice(tokens)  # in TypeScript that is a question of types
        if not twice:
            return []
        places = [m.start() for m in LEX.pattern.finditer(text)]
        return [(n, "declared twice") for n in lines_of(text, [places[k] for k in twice])]
    # positions: the parser dropped newlines, so walk both strings
    offs, keep = LEX.offsets(text), []
    last = 0
    for m in _NO_END.finditer(kinds + END):
        keep += range(last, m.start())
        last = m.end()
    keep += range(last, len(kinds))
    places = [offs[keep[at]] if at < len(keep) else len(text) for at, _ in p.errors]
    return list(zip(lines_of(text, places), [what for _, what in p.errors]))
