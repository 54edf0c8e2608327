"""Several grammars in one deterministic automaton.

Each rule is a regular expression of a small dialect: characters, ``[...]`` classes, ``\\x`` escapes, groups, ``|`` and
the repetitions ``? * + {m} {m,} {m,n}``. All rules together become one nondeterministic automaton, whose sets of states
become the states of the deterministic one. Its head, the literal with which each rule begins, is searched for by
Aho-Corasick; its tail is followed from there, one table look-up a character.
"""

from __future__ import annotations

import functools

ASCII = [chr(k) for k in range(128)]
OTHER = "\x80"  # stands for every character beyond ASCII


class Compiler:
    """Rules as fragments (entry, exit) of one nondeterministic automaton."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[str], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def chars(self, chars: frozenset[str]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.steps[a].append((chars, b))
        return a, b

    def repeat(self, source: str, least: int, most: int | None) -> tuple[int, int]:
        start = at = self.state()
        for _ in range(least):
            a, b = self.parse(source)
            self.empty[at].append(a)
            at = b
        if most is None:
            a, b = self.parse(source)
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[loop].append(a)
            self.empty[b].append(loop)
            return start, loop
        end = self.state()
        for _ in range(most - least):
            self.empty[at].append(end)
            a, b = self.parse(source)
            self.empty[at].append(a)
            at = b
        self.empty[at].append(end)
        return start, end

    def parse(self, source: str) -> tuple[int, int]:
        start, end = self.state(), self.state()
        for option in alternatives(source):
            at = start
            for atom, least, most in pieces(option):
                if (least, most) != (1, 1):
                    a, b = self.repeat(atom, least, most)
                elif atom.startswith("("):
                    a, b = self.parse(atom[1:-1])
                else:
                    a, b = self.chars(char_set(atom))
                self.empty[at].append(a)
                at = b
            self.empty[at].append(end)
        return start, end


def alternatives(source: str) -> list[str]:
    out, depth, at, i = [], 0, 0, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = class_end(source, i) - 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            out.append(source[at:i])
            at = i + 1
        i += 1
    return [*out, source[at:]]


def class_end(source: str, i: int) -> int:
    i += 2
    while source[i] != "]":
        i += 2 if source[i] == "\\" else 1
    return i + 1


def atom_end(source: str, i: int) -> int:
    if source[i] == "\\":
        return i + 2
    if source[i] == "[":
        return class_end(source, i)
    if source[i] != "(":
        return i + 1
    depth = 0
    while True:
        if source[i] in "\\[":
            i = atom_end(source, i)
            continue
        depth += (source[i] == "(") - (source[i] == ")")
        i += 1
        if not depth:
            return i


def pieces(source: str):
    """(atom, least, most) of a sequence."""
    i = 0
    while i < len(source):
        j = atom_end(source, i)
        atom, i = source[i:j], j
        c = source[i : i + 1]
        if c == "{":
            j = source.index("}", i)
            least, comma, most = source[i + 1 : j].partition(",")
            yield atom, int(least), int(most) if most else None if comma else int(least)
            i = j + 1
        elif c and c in "?*+":
            yield atom, int(c == "+"), 1 if c == "?" else None
            i += 1
        else:
            yield atom, 1, 1


SHORT = {"d": frozenset("0123456789"), "s": frozenset(" \t\n\r\f\v"), "w": frozenset(c for c in ASCII if c.isalnum() or c == "_") | {OTHER}, "n": frozenset("\n"), "t": frozenset("\t")}


def char_set(atom: str) -> frozenset[str]:
    if atom[0] == "\\":
        return SHORT.get(atom[1], frozenset(atom[1]))
    if atom[0] != "[":
        return frozenset(ASCII) | {OTHER} if atom == "." else frozenset(atom)
    body, out, i = atom[1:-1], set(), 0
    negated = body.startswith("^")
    i = int(negated)
    while i < len(body):
        if body[i] == "\\":
            out |= char_set(body[i : i + 2])
            i += 2
        elif i + 2 < len(body) and body[i + 1] == "-":
            out |= {chr(k) for k in range(ord(body[i]), ord(body[i + 2]) + 1)}
            i += 3
        else:
            out.add(body[i])
            i += 1
    return frozenset(ASCII) - out | {OTHER} if negated else frozenset(out)


class Automaton:
    """``rules``: name -> expression. ``shortest`` names the rules whose first acceptance ends the reading."""

    def __init__(self, rules: dict[str, str], shortest: frozenset[str] = frozenset()):
        nfa = Compiler()
        entry, final = nfa.state(), {}
        for name, source in rules.items():
            a, b = nfa.parse(source)
            nfa.empty[entry].append(a)
            final[b] = name
        order = {name: k for k, name in enumerate(rules)}

        def closed(states) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for s in nfa.empty[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            return frozenset(seen)

        first = closed([entry])
        number = {first: 0}
        todo = [first]
        self.rows: list[dict[str, int]] = []
        self.accept: list[str | None] = []
        while todo:
            states = todo.pop(0)
            reach: dict[str, set[int]] = {}
            for s in states:
                for chars, to in nfa.steps[s]:
                    for c in chars:
                        reach.setdefault(c, set()).add(to)
            row, made = {}, {}
            for c, to in reach.items():
                key = frozenset(to)
                if key not in made:
                    made[key] = closed(key)
                target = made[key]
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                row[c] = number[target]
            self.rows.append(row)
            names = [final[s] for s in states if s in final]
            self.accept.append(min(names, key=order.__getitem__) if names else None)
        self.stop = [name in shortest for name in self.accept]

    def run(self, text: str, at: int, state: int = 0) -> tuple[int, int, int, int]:
        """(state last accepting or -1, where that was, state reached, where reading stopped) from ``at`` on."""
        rows, accept = self.rows, self.accept
        good, end = -1, at
        for i in range(at, len(text)):
            c = text[i]
            to = rows[state].get(c if c < OTHER else OTHER)
            if to is None:
                return good, end, state, i
            state = to
            if accept[state] is not None:
                good, end = state, i + 1
                if self.stop[state]:
                    break
        else:
            return good, end, state, len(text)
        return good, end, state, end


def head(source: str) -> list[str]:
    """The literals with which a rule begins, one for each alternative, in lower case."""
    out = []
    for option in alternatives(source):
        word = ""
        for atom, least, most in pieces(option):
            if (least, most) != (1, 1) or atom[0] in "[(." or atom[0] == "\\" and atom[1] in "dswnt":
                break
            word += atom[-1]
        out.append(word.lower())
    return out


@functools.cache
def compiled(rules: tuple[tuple[str, str], ...], shortest: frozenset[str]) -> Automaton:
    return Automaton(dict(rules), shortest)
