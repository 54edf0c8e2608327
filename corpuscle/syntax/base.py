"""Common parts of the recursive-descent parsers.

A text becomes a string of token kinds, one character each: names are 'a', numbers '0', literals '"', punctuation stands
for itself, keywords and longer operators have a character of their own, and what is no token of the language is BAD.
Comments vanish. Parsing functions take a position and return the next one, or raise Bad. Segments that a rule has
accepted whole, ending at its own last token, are remembered by their kinds, across files: a rule is a pure function of
the kinds it consumed, so a segment seen before need not be parsed again. Where it is not (ambient declarations), nothing is remembered.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

END, BAD = "\0", "\x01"


class Bad(Exception):
    def __init__(self, at: int, what: str = "unexpected token"):
        super().__init__(what)
        self.at, self.what = at, what


def lines_of(text: str, offsets: list[int]) -> list[int]:
    """1-based lines of offsets, in one pass over the text."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))] if offsets else []
    return [bisect_right(starts, k) for k in offsets]


class Kinds(dict):
    """Kind of a token text; short ones are remembered, up to a bound."""

    def __init__(self, classify: Callable[[str], str], most: int = 200_000):
        super().__init__()
        self.classify, self.most = classify, most

    def __missing__(self, token: str) -> str:
        kind = self.classify(token)
        if len(token) <= 32:
            if len(self) >= self.most:
                self.clear()
            self[token] = kind
        return kind


class Lexicon:
    """Token pattern of a language, its keywords and its longer operators."""

    def __init__(self, pattern: str, keywords: str, operators: str, classify: Callable[[str], str | None], first: int = 0x100):
        self.pattern = re.compile(pattern, re.S)
        self.chars: dict[str, str] = {}
        self.names: dict[str, str] = {}
        for k, word in enumerate([*keywords.split(), *operators.split()]):
            self.chars[word] = chr(first + k)
            self.names[chr(first + k)] = word
        self.own = classify
        self.kinds = Kinds(self.classify)

    def classify(self, token: str) -> str:
        known = self.chars.get(token)
        if known:
            return known
        kind = self.own(token)
        if kind is not None:
            return kind
        if token[0].isalpha() or token[0] in "_$":
            return "a"
        return token if len(token) == 1 and token in "()[]{}<>;,.:?=+-*/%&|^!~@#" else BAD

    def lex(self, text: str) -> str:
        return "".join(map(self.kinds.__getitem__, self.pattern.findall(text)))

    def offsets(self, text: str) -> list[int]:
        """Where in the text each kind character comes from; only needed when there is an error."""
        out = []
        for m in self.pattern.finditer(text):
            out += [m.start()] * len(self.kinds[m[0]])
        return out

    def __getitem__(self, word: str) -> str:
        return self.chars[word]

    def set(self, words: str) -> frozenset[str]:
        return frozenset(self.chars.get(w, w) for w in words.split())


class Parser:
    """Statement lists with panic-mode recovery, and the memory of accepted segments."""

    OPEN, CLOSE = "([{", ")]}"
    stop = re.compile("[;{}\0]")
    brackets = re.compile(r"[()\[\]{}]")
    context: re.Pattern | None = None  # kinds whose rule depends on what they stand in; segments with one are not remembered

    def __init__(self, kinds: str):
        self.s = kinds + END * 8
        self.errors: list[tuple[int, str]] = []
        self.closes: dict[int, int] = {}

    def partner(self, i: int) -> int:
        """Where the bracket that opens at i is closed, -1 if nowhere. Those inside are matched with it, so none is read twice."""
        found = self.closes.get(i)
        if found is None:
            open_: list[int] = []
            for m in self.brackets.finditer(self.s, i):
                if m[0] in self.OPEN:
                    open_.append(m.start())
                else:
                    self.closes[open_.pop()] = m.start()
                    if not open_:
                        break
            for k in open_:
                self.closes[k] = -1
            found = self.closes[i]
        return found

    def need(self, i: int, kind: str, what: str = "") -> int:
        if self.s[i] != kind:
            raise Bad(i, what or ("missing bracket" if kind in self.CLOSE else "unexpected token"))
        return i + 1

    def remembered(self, known: set[str], rule: Callable[[int], int], i: int) -> int:
        """``rule`` at i, skipped if the kinds up to the next ; { or } were accepted by it, whole, before."""
        j = self.stop.search(self.s, i).end()
        key = self.s[i:j]
        if key in known:
            return j
        e = rule(i)
        if e == j and len(known) < 500_000 and not (self.context and self.context.search(key)):
            known.add(key)
        return e

    def sync(self, i: int) -> int:
        """Panic mode: behind the next ; at this depth, or before the bracket that closes it."""
        s, depth = self.s, 0
        while s[i] != END:
            c = s[i]
            if c == "{":
                depth += 1
            elif c == "}":
                if not depth:
                    return i
                depth -= 1
                if not depth:
                    return i + 1
            elif c == ";" and not depth:
                return i + 1
            i += 1
        return i

    def block_items(self, i: int, item: Callable[[int], int], closers: str) -> int:
        """Items up to a closer (not consumed); errors are stored and parsing goes on behind them."""
        s = self.s
        while s[i] not in closers:
            if s[i] == END:
                raise Bad(i, "missing bracket")
            try:
                i = item(i)
            except Bad as e:
                self.errors.append((e.at, e.what))
                i = max(self.sync(e.at), i + 1)
                if i >= len(s) - 8:
                    return len(s) - 8
        return i

    def top(self, item: Callable[[int], int]) -> None:
        """The whole text as items; a stray closing bracket is an error of its own."""
        i, end = 0, len(self.s) - 8
        while i < end:
            try:
                i = item(i)
            except Bad as e:
                self.errors.append((e.at, e.what))
                i = max(self.sync(e.at), i + 1)
