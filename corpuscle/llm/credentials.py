"""Credentials embedded in source code: where each stands, and the content with the values made unreadable.

One deterministic automaton holds all grammars that are regular: token formats, key armor, connection strings and login
headers (``automaton``). Its head, the literals with which they begin, stands in one Aho-Corasick trie together with the
names that mean a credential and the marks of accounts and query parameters. The trie is run over overlapping chunks of
the lower-cased text; what is found twice counts once by its absolute position. From a head the automaton's tail is
followed through the whole text, over the seams of a literal written in pieces too, so no value is cut by a chunk. Names
are followed by the value that is assigned to them. The spans are merged, and placeholders are spliced in for values
only: quotes, armor lines, line ends and everything else stay.

Nothing is looked for in a window: names, types, sentences, lists of pieces and values may be of any length. Places
further on (the next quote, blank, digit, end of line ...) are found once and remembered, lines of code are divided into
strings and comments once, so the time is in proportion to the text, also for a file of a single line.

Cases: null content gives no row. Any file with content is read, whatever its name, language or ``reason``. Values in
pieces count where the first piece stands. Empty values, placeholders, references to an environment or vault, patterns,
digests, identifiers, image data, public keys and prose about passwords are no case. A query parameter's value is not
searched for parameters of its own. Repeated rows of a file give the same findings once each. Texts of any length are
read whole. Other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread
from .automaton import compiled, head

CHUNK, OVERLAP = 1 << 18, 64
MARK = "REDACTED"
FOUND = "ws string, rel string, line_no int, start_off bigint, end_off bigint, kind string"

#: Token formats, case-sensitive.
TOKENS = {
    "aws": r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}", "github": r"ghp_[A-Za-z0-9]{30,}|gho_[A-Za-z0-9]{30,}|ghu_[A-Za-z0-9]{30,}|ghs_[A-Za-z0-9]{30,}|ghr_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}",
    "gitlab": r"glpat-[0-9A-Za-z_-]{16,}|glptt-[0-9A-Za-z_-]{16,}|gldt-[0-9A-Za-z_-]{16,}|glrt-[0-9A-Za-z_-]{16,}",
    "slack": r"xoxb-[0-9A-Za-z-]{20,}|xoxp-[0-9A-Za-z-]{20,}|xoxa-[0-9A-Za-z-]{20,}|xoxr-[0-9A-Za-z-]{20,}|xoxs-[0-9A-Za-z-]{20,}|xapp-[0-9A-Za-z-]{20,}",
    "webhook": r"hooks\.slack\.com/services/T[0-9A-Z]{6,}/B[0-9A-Z]{6,}/[0-9A-Za-z]{16,}|discord\.com/api/webhooks/[0-9]{15,}/[0-9A-Za-z_-]{40,}",
    "google": r"AIza[0-9A-Za-z_-]{33,}|ya29\.[0-9A-Za-z_-]{20,}|GOCSPX-[0-9A-Za-z_-]{20,}",
    "stripe": r"sk_live_[0-9a-zA-Z]{16,}|rk_live_[0-9a-zA-Z]{16,}|sk_test_[0-9a-zA-Z]{16,}|whsec_[0-9A-Za-z+/]{24,}",
    "model": r"sk-proj-[0-9A-Za-z_-]{20,}|sk-ant-[0-9A-Za-z_-]{20,}|sk-svcacct-[0-9A-Za-z_-]{20,}|hf_[A-Za-z0-9]{30,}",
    "package": r"npm_[A-Za-z0-9]{30,}|pypi-[0-9A-Za-z_-]{40,}|dckr_pat_[0-9A-Za-z_-]{20,}|rubygems_[0-9a-f]{40,}", "mail": r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(\.[A-Za-z0-9_-]*)?", "cloud": r"dop_v1_[0-9a-f]{40,}|hvs\.[0-9A-Za-z_-]{24,}|pul-[0-9a-f]{40}|lin_api_[0-9A-Za-z]{32,}|PMAK-[0-9a-f]{24}-[0-9a-f]{34}|NRAK-[0-9A-Z]{27}",
    "shop": r"shpat_[0-9a-fA-F]{20,}|shpss_[0-9a-fA-F]{20,}|shpca_[0-9a-fA-F]{20,}|shppa_[0-9a-fA-F]{20,}|sq0csp-[0-9A-Za-z_-]{22,}|sq0atp-[0-9A-Za-z_-]{22,}",
    "phone": r"SK[0-9a-f]{32}", "age": r"AGE-SECRET-KEY-1[0-9A-Z]{40,}",
}
#: The other regular grammars.
ARMOR = {"armor": r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----"}
LOGINS = {"connection": r"://[^\s/:@\"'`<>?#]*:[^\s\"'`/]+@[\w\[$<{%-]", "basic": r"[Bb][Aa][Ss][Ii][Cc][ \t]+[A-Za-z0-9._~+/=-]{8,}", "bearer": r"[Bb][Ee][Aa][Rr][Ee][Rr][ \t]+[A-Za-z0-9._~+/=-]{8,}"}
HEADS = {"basic": ["basic"], "bearer": ["bearer"]}  # of rules that begin with no literal
SHORTEST = frozenset(["connection"])
EXACT = frozenset(["aws", "phone"])  # formats of one length: no letter or digit may follow

#: Last words of names that stand for a credential, and the words that make one of a following "key".
NOUNS = frozenset("password passwd passwort kennwort pwd pw passphrase passcode secret token apikey bearer contrasena contraseña motdepasse wachtwoord senha haslo lösenord parola authtoken accesstoken apitoken secretkey accesskey privatekey signingkey encryptionkey sessionkey clientsecret".split())
OF_KEY = frozenset("api access secret signing encryption session private account shared master auth service deploy webhook client storage ssh crypt aes hmac jwt admin subscription license licence app application decryption cipher root cookie integration server consumer".split())
HEADER_NAMES = frozenset("xauth xapikey xauthtoken authorization xaccesstoken xtoken".split())
NAME_ANCHORS = sorted({"pass", "key", "x-auth", "authorization"} | {n for n in NOUNS if not any(n != m and m in n for m in NOUNS)} | {"contraseñ", "passe"})

#: Places where a user and its password stand together, one behind the other.
ACCOUNTS = ["-u ", "--user ", "--user=", "login", "logon", "credentials"]

#: What begins, or is, a placeholder.
_PLACE_HEAD = re.compile(r"(?i)(?:replace[_-]?with|your[_-]|insert[_-]|enter[_-]|fill[_-]|example|sample|dummy|placeholder|redacted|x{3,}|\.{3}|\*{2,}|some[_-]|the[_-])")
_PLACE = re.compile(
    r"(?i)(?:change[_-]?me!?|change[_-]?this|replace[_-]?(?:me|this)|my[_-]?(?:password|secret|token|key)|to[_-]?do|tbd|tba|none|null|nil|undefined|true|false|yes|no|on|off|"
    r"n/?a|hidden|masked|removed|secret|password|passwd|passphrase|pass|pwd|token|key|apikey|api[_-]?key|foo|bar|baz|test|default|empty|unset|string|str|text|value|"
    r"[x*.•\-_#?]+|(?:password|secret|token|key)[_-]?(?:here|goes[_-]?here))"
)
#: What is a reference from its first character on, or to its last.
_REFERENCE = re.compile(r"<[^<>]*>|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|%\(?\w*\)?[sd]|\{\w*\}")
_REFERENCE_HEAD = re.compile(r"(?:vault|env|ssm|arn|secret|secrets|op|keyring|file|kms|sops|doppler|awssm|gcpsm|azurekv):|ENC\[")
_REFERENCE_IN = r"\$\{|\$\(|\{\{|\}\}|<%|process\.env|os\.environ|getenv"
_PATTERN_IN = r"\\[dwsb]|\{\d+(?:,\d*)?\}|\(\?|\.\*|\.\+"
_MARKUP = re.compile(r"[!&*@]\w|[|>][-+]?(?=[\s\"'`]|\Z)")  # of values without quotes
_QUOTE = re.compile(r"(?:[rbfuRBFU]{0,2}|r\#+)(\"\"\"|'''|\"|'|`)")
_GLUE = re.compile(r"[ \t]*(?:\\\r?\n|\+|\.|&|,(?=[ \t]*\r?\n)|\r?\n)?[ \t]*(?:\r?\n)?[ \t]*(?:\+|\.)?[ \t]*(?:\r?\n)?[ \t]*(?:[rbfRBF]{0,2})(?P<q>\"\"\"|'''|\"|'|`)")
_ASSIGN = re.compile(
    r"(?P<close>\\?[\"'`]|\])?[ \t]*(?::[ \t]*(?:&(?:'\w+[ \t]*)?(?:mut[ \t]+)?)?[A-Za-z_][\w.<>\[\], |]*?(?==[ \t]*[^=>\s]))?(?P<op>:=|=>|=(?!=)|:(?!:)|[ \t]is[ \t]|,(?=[ \t]*[\"'])|\((?=[ \t]*[\"']))[ \t]*(?P<paren>\([ \t]*\r?\n?[ \t]*)?"
)
_CLOSE_VALUE = {'"': re.compile(r'(?:[^"\\\n]|\\.)*'), "'": re.compile(r"(?:[^'\\\n]|\\.)*"), "`": re.compile(r"[^`]*"), '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*', re.S), "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*", re.S)}
_BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]|]+(?:[;](?=\S))?")
_WORDS = re.compile(r"[ \t]*+(?:[^\W\d_][\w'-]*+[ \t]*+)*+")
_COLON = re.compile(r":[ \t]+")
_ARMOR_BODY = re.compile(r"(?:(?!-----)(?:[\s\"'`+,;.()\\#*/|rn>-]|(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*+))*?[A-Za-z0-9+/=]{16,}")
_PARAM = re.compile(r"[?&](?P<n>[A-Za-z_.-]+)=(?P<v>[^&\s\"'`<>#)\]]+)")
PARAMS = frozenset("key sig signature token accesstoken apikey secret password passwd pwd auth authtoken clientsecret sas sharedaccesssignature accesskey secretkey privatetoken".split())
CODE = {".py": "#", ".js": "//", ".mjs": "//", ".ts": "//", ".go": "//", ".java": "//", ".rs": "//"}


PARAM_ANCHORS = sorted({n + "=" for n in PARAMS if not any(n != m and n.endswith(m) for m in PARAMS)})


def automaton():
    """The automaton of all regular grammars."""
    return compiled(tuple({**TOKENS, **ARMOR, **LOGINS}.items()), SHORTEST)


@functools.cache
def trie():
    """The heads of all grammars in one Aho-Corasick trie; the value of a word is (word, families)."""
    import ahocorasick

    words: dict[str, list[str]] = {}
    for name, rule in {**TOKENS, **ARMOR, **LOGINS}.items():
        for word in HEADS.get(name) or head(rule):
            words.setdefault(word, []).append("grammar")
    for family, many in (("account", ACCOUNTS), ("param", PARAM_ANCHORS), ("name", NAME_ANCHORS)):
        for word in many:
            words.setdefault(word, []).append(family)
    a = ahocorasick.Automaton()
    for word, families in words.items():
        a.add_word(word, (word, tuple(families)))
    a.make_automaton()
    return a


def anchors(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str, tuple[str, ...]]]:
    """(start, word, families) of every head, each once, in order."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer; only ASCII matters here
        lower = re.sub(r"[A-Z]+", lambda m: m[0].lower(), text)
    find = trie().iter
    if len(lower) <= chunk:
        return sorted((end - len(word) + 1, word, families) for end, (word, families) in find(lower))
    seen = set()
    for at in range(0, len(lower), chunk - overlap):
        for end, (word, families) in find(lower[at : at + chunk]):
            seen.add((at + end - len(word) + 1, word, families))
    return sorted(seen)


_WORD = re.compile(r"[^\W\d_]?[^\WA-Z\d_]+|[A-Z]+(?![a-zà-ÿ])|[A-Z]")
LONGEST_NOUN = max(map(len, NOUNS | HEADER_NAMES))


def means_credential(last: list[str], several: bool, joined: str, option: bool) -> bool:
    """By the last (at most three) words of a name, whether it has several, all of them joined, and whether it is an option."""
    if not last:
        return False
    word, before = last[-1], last[-2] if len(last) > 1 else ""
    if word in NOUNS or joined in NOUNS or joined in HEADER_NAMES:
        return not (several and before in ("public", "csrf", "next", "page", "continuation", "cancellation", "cancel", "no", "has", "is"))
    if word == "key" and several:
        return before in OF_KEY
    if word == "pass":  # a word of its own only as a command-line option
        return several and before not in ("render", "first", "second", "next", "last", "one", "two", "by", "bypass", "shader", "sub", "multi") or option
    return last == ["mot", "de", "passe"]


def stands_for_credential(name: str) -> bool:
    """Whether the last words of a name mean a credential."""
    words = [m[0].lower() for m in _WORD.finditer(name)]
    return means_credential(words[-3:], len(words) > 1, "".join(words), name.startswith("--"))


class Ahead:
    """The next place of a pattern at or behind a position. Positions mostly ascend, so a text is searched about once."""

    def __init__(self, text: str, pattern: str):
        self.search, self.text = re.compile(pattern).search, text
        self.asked, self.place = 0, -1  # nothing lies from asked on before place

    def __call__(self, at: int) -> int:
        if at > self.place or at < self.asked:
            known = at <= self.place
            m = self.search(self.text, at, self.asked + 64) if known else self.search(self.text, at)
            if m is not None and not (known and m.start() >= self.asked):
                self.place = m.start()
            elif not known:
                self.place = len(self.text)
            self.asked = at
        return self.place


_NO_SECRET = re.compile(r"\d+(?:st|nd|rd|th|[smhd]|ms|px|%|[kKMG]i?[bB]?)|v\d[\d.]*")
_NO_SECRET_HEAD = re.compile(r"https?://|\w+\(|\d{4}-\d\d-\d\d")
_PUNCTUATED = re.compile(r"[\d.,:/#+-]+")
_BLANKS = re.compile(r"[^\S\n]*")
_SCHEME_ENDS = re.compile(r"(?i)(?:basic|bearer)\s")
AHEAD = {
    "blank": r"[\s\"'`]", "stop": r"[\s\"'`,;<>(){}\[\]|]", "digit": r"\d", "space": " ", "line": r"\n", "colon": r"[:=\n]", "scheme": "://", "begin": "-----BEGIN", "end": "-----END",
    "reference": _REFERENCE_IN, "pattern": _PATTERN_IN, "bracket": r"\[", "close": r"\]", "minus": "-", "body": r"[^\s\"'`]",
}


class Text:
    """A content with what the grammars ask for. Nothing in it is looked for twice."""

    def __init__(self, text: str, rel: str = ""):
        self.text = text
        dot = rel.rfind(".")
        self.mark = CODE.get(rel[dot:].lower()) if dot >= 0 else None
        self.code = self.mark is not None
        self.json = rel.lower().endswith(".json")
        self.starts: list[int] | None = None
        self.lexed = -1
        self.aheads: dict[str, Ahead] = {}
        self.run_at = self.run_end = -1
        self.listed: dict[int, bool] = {}
        self.words_at = self.words_end = -1

    def next(self, what: str, at: int) -> int:
        """Where the next place of a kind in :data:`AHEAD` is, the length of the text if there is none."""
        a = self.aheads.get(what)
        if a is None:
            a = self.aheads[what] = Ahead(self.text, AHEAD[what])
        return a(at)

    # -- lines, strings and comments

    def line(self, at: int) -> int:
        if self.starts is None:
            self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        return bisect_right(self.starts, at)

    def loose(self, at: int) -> str:
        """'' for code proper, else 'config', 'comment' or 'string': places where values need no quotes."""
        if not self.code:
            return "config"
        n = self.line(at)
        a = self.starts[n - 1]
        if a != self.lexed:
            self.lex(a)
        if at >= self.comment:
            return "comment"
        k = bisect_right(self.opens, at - 1) - 1
        return "string" if k >= 0 and at <= self.closes[k] else ""

    def lex(self, a: int) -> None:
        """Divides the line that begins at a: where strings open and close, and where its comment begins."""
        text, mark, b = self.text, self.mark, self.next("line", a)
        self.lexed, self.comment, self.opens, self.closes = a, len(text) + 1, [], []
        first = _BLANKS.match(text, a, b).end()
        if text.startswith(mark, first) or mark == "//" and text.startswith(("*", "/*"), first):
            self.comment = first + 1
            return
        for m in (_LEX_HASH if mark == "#" else _LEX_SLASH).finditer(text, a, b):
            if m[0] == mark:
                self.comment = m.end()
                return
            self.opens.append(m.start())
            self.closes.append(m.end() - 1 if m.end() - m.start() > 1 and m[0][-1] == m[0][0] else b)

    # -- names

    def name(self, at: int) -> tuple[int, int]:
        """Where the name around ``at`` begins (over dots) and ends (before a dot)."""
        text = self.text
        if not self.run_at <= at < self.run_end:
            a = at
            while a and ((c := text[a - 1]).isalnum() or c in "_.-"):
                a -= 1
            self.run_at, self.run_end = a, _RUN.match(text, at).end()
            self.words = self.word_ends = None
        dot = text.find(".", at, self.run_end)
        return self.run_at, dot if dot >= 0 else self.run_end

    def means(self, start: int, stop: int) -> bool:
        """Whether the name of the present run that ends at ``stop``, or its last part, means a credential."""
        text = self.text
        if self.words is None:
            self.words, self.word_ends, self.lengths = [], [], [0]
            for m in _WORD.finditer(text, start, self.run_end):
                self.words.append(m[0].lower())
                self.word_ends.append(m.end())
                self.lengths.append(self.lengths[-1] + len(m[0]))
        n = bisect_right(self.word_ends, stop)
        last = stop
        while last > start and text[last - 1] in "-.":
            last -= 1
        part = text.rfind(".", start, last) + 1
        for begin, k in ((part, bisect_right(self.word_ends, part)) if part > start else (start, 0), (start, 0)):
            size = self.lengths[n] - self.lengths[k]
            joined = "".join(self.words[k:n]) if size <= LONGEST_NOUN else ""
            if means_credential(self.words[max(k, n - 3) : n], n - k > 1, joined, text.startswith("--", begin)):
                return True
        return False

    # -- values, by their places

    def trimmed(self, a: int, b: int) -> tuple[int, int]:
        text = self.text
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        return a, b

    def placeholder(self, a: int, b: int) -> bool:
        text = self.text
        a, b = self.trimmed(a, b)
        if a == b or _PLACE_HEAD.match(text, a, b) or (m := _PLACE.fullmatch(text, a, b)):
            return True
        if _REFERENCE.fullmatch(text, a, b) or _REFERENCE_HEAD.match(text, a, b) or self.next("reference", a) < b or self.next("pattern", a) < b:
            return True
        i = self.next("bracket", a)
        while i < b:  # [...-...], a class of characters
            j = self.next("close", i)
            if j >= b:
                break
            if text.find("-", i, j) >= 0:
                return True
            i = self.next("bracket", j)
        return len(set(text[a : min(b, a + 64)])) <= 2 and len(set(text[a:b])) <= 2

    def secret_like(self, a: int, b: int) -> bool:
        """For values without quotes in prose: long enough, and with a digit among letters or a mark."""
        text = self.text
        if b - a < 6 or self.next("digit", a) >= b or _NO_SECRET_HEAD.match(text, a, b) or _NO_SECRET.fullmatch(text, a, b):
            return False
        m = _PUNCTUATED.match(text, a, b)
        return not (m and m.end() == b)

    def is_value(self, a: int, b: int) -> bool:
        text = self.text
        a, b = self.trimmed(a, b)
        if b - a < 4 or self.placeholder(a, b) or self.next("begin", a) < b or self.next("scheme", a) < b:  # key armor and connection strings have grammars of their own
            return False
        if _SCHEME_ENDS.match(text, a, b):
            return False
        i = self.next("space", a)
        return i >= b or self.next("digit", a) < b and self.next("space", i + 1) >= b

    def rest_of_line(self, at: int) -> int:
        """The first place from ``at`` on that is not blank, -1 if the line ends before."""
        i = _BLANKS.match(self.text, at).end()
        return -1 if i == len(self.text) or self.text[i] == "\n" else i


_RUN = re.compile(r"[\w.-]*")
_LEX_HASH = re.compile(r"\"(?:[^\"\\]|\\.)*+\"?|'(?:[^'\\]|\\.)*+'?|`(?:[^`\\]|\\.)*+`?|#", re.S)
_LEX_SLASH = re.compile(r"\"(?:[^\"\\]|\\.)*+\"?|'(?:[^'\\]|\\.)*+'?|`(?:[^`\\]|\\.)*+`?|//", re.S)


def placeholder(v: str) -> bool:
    return Text(v).placeholder(0, len(v))


def pieces(text: str, at: int) -> tuple[str, list[tuple[int, int]]] | None:
    """The literal whose opening quote stands at ``at``, with the literals glued to it: value and spans."""
    m = _QUOTE.match(text, at)
    if not m:
        return None
    value, spans = [], []
    while True:
        q = m.groupdict().get("q") or m[1]
        body = _CLOSE_VALUE[q].match(text, m.end())
        if not text.startswith(q, body.end()):
            return ("".join(value), spans) if spans else None
        if body.end() > body.start():
            value.append(body[0])
            spans.append((body.start(), body.end()))
        at = body.end() + len(q)
        m = _GLUE.match(text, at)
        if not m or "+" not in m[0] and "\\\n" not in m[0] and not ("\n" in m[0] and _adjacent(text, m)) and not (m[0].strip() in ("\"", "'") and "\n" not in m[0]):
            return "".join(value), spans
        if m[0].lstrip().startswith(","):
            return "".join(value), spans


_KEYED = re.compile(r"\s*[:=]")


def _adjacent(text: str, m: re.Match) -> bool:
    """Literals on successive lines within brackets, as Python joins them."""
    if "," in m[0]:
        return False
    body = _CLOSE_VALUE[m["q"]].match(text, m.end())
    return not _KEYED.match(text, body.end() + len(m["q"]))


def find(text: str, rel: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, group) of every value, in order; the spans of a value in pieces share a group."""
    t = Text(text, rel)
    out: dict[tuple[int, int], tuple[str, int]] = {}
    taken = bytearray(len(text))
    group = 0

    def add(spans: list[tuple[int, int]], kind: str) -> None:
        nonlocal group
        spans = [s for s in spans if s[1] > s[0]]
        if spans and not taken[spans[0][0]]:
            for s in spans:
                out.setdefault(s, (kind, group))
                taken[s[0] : s[1]] = b"\1" * (s[1] - s[0])
            group += 1

    found = anchors(text)
    for at, word, families in found:
        if "grammar" in families and not taken[at]:
            _grammar(t, at, add)
        if "account" in families:
            _account(t, at, add)
    done = last_param = last_name = -1
    for at, word, families in found:
        if "name" not in families and "param" not in families:
            continue
        start, stop = t.name(at)
        if start and text[start - 1] in "?&":
            if start > done and start != last_param:
                done = max(done, _param(t, start - 1, add))
                last_param = start
        elif "name" in families and stop != last_name:
            last_name = stop
            if t.means(start, stop):
                _named(t, start, stop, add)
    return sorted((a, b, k, g) for (a, b), (k, g) in out.items())


def _grammar(t: Text, at: int, add) -> None:
    """Follows the automaton from a head on, and over the seams between the pieces of a literal."""
    text, m = t.text, automaton()
    good, end, state, stop = m.run(text, at)
    spans = [(at, end)]
    if stop < len(text) and text[stop] in "\"'`" and (good < 0 or end == stop):
        read = [(at, stop)]
        for a, b in _glued(t, at, stop):  # lazily: no piece is read that the automaton can not go on into
            g, e, state, stop = m.run(text[a:b], 0, state)
            if g >= 0:
                good, spans = g, [*read, (a, a + e)]
            read.append((a, b))
            if stop < b - a or state < 0:
                break
    if good < 0:
        return
    rule = m.accept[good]
    if rule == "armor":
        if len(spans) == 1:
            _armor(t, at, end, add)
    elif rule == "connection":
        _connection(t, at, end, add)
    elif rule in LOGINS:
        _login(t, rule, at, spans, add)
    else:
        _token(t, rule, at, spans, add)


def _token(t: Text, rule: str, at: int, spans: list[tuple[int, int]], add) -> None:
    text, end = t.text, spans[-1][1]
    if rule == "webhook":
        at = text.find("/", text.find("/", text.find("/", at) + 1) + (1 if text[at] in "dD" else 0)) + 1 if len(spans) == 1 else at
    elif at and (text[at - 1].isalnum() or text[at - 1] in "_+/"):
        if not (text[at - 1] in "nrt" and at > 1 and text[at - 2] == "\\"):
            return
    if rule in EXACT and text[end : end + 1].isalnum():
        return
    value = "".join(text[a:b] for a, b in spans)
    body = re.sub(r"^[A-Za-z]+[_.-]|^(?:AKIA|ASIA|AIza|eyJ|SK)", "", value)
    if len(spans) > 1 or len(set(body)) > 3:
        add([(at, spans[0][1]), *spans[1:]], "token")


def _armor(t: Text, at: int, begun: int, add) -> None:
    text = t.text
    body = _ARMOR_BODY.match(text, begun)
    if not body:
        return
    end = t.next("end", begun)
    if end == len(text) or t.next("begin", begun) < end:
        m = _ARMOR_REST.match(text, begun)
        end = m.end() if m else begun
    spans = [x.span(1) for x in _ARMOR_PART.finditer(text, begun, end) if x[1]]
    add([(at, begun)] + spans, "private key")


_ARMOR_REST = re.compile(_ARMOR_BODY.pattern + r"(?:[A-Za-z0-9+/=]{16,}|[\s\"'`+,\\rn]+)*+")
_ARMOR_PART = re.compile(r"\\[nrt]|(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*|([A-Za-z0-9+/=]{4,})")
_GLUE_LIST = re.compile(r"\s*,\s*(?P<q>\"|')")
_JOINED = re.compile(r"\]\s*\.\s*join\s*\(\s*(?:\"\"|''|``)")


def _in_list(t: Text, at: int, q: str) -> bool:
    """Whether the literal in which ``at`` stands is in a list of pieces that are put together.

    Goes back from literal to literal to the bracket that opens the list; what is known of an earlier one holds for it.
    """
    text, way = t.text, []
    i = text.rfind(q, 0, at)
    while True:
        if i in t.listed:
            found = t.listed[i]
            break
        way.append(i)
        j = i
        while j and text[j - 1].isspace():
            j -= 1
        if j and text[j - 1] == ",":
            j -= 1
            while j and text[j - 1].isspace():
                j -= 1
            if j and text[j - 1] in "\"'":
                k = text.rfind(text[j - 1], 0, j - 1)
                if k >= 0:
                    i = k
                    continue
            found = False
            break
        if j and text[j - 1] == "[":
            before = j - 1
            while before and text[before - 1].isspace():
                before -= 1
            found = text.startswith(('"".join(', "''.join("), max(0, before - 8)) and before >= 8 or bool(_JOINED.match(text, t.next("close", at)))
            break
        if j and text[j - 1] == "(":
            before = j - 1
            while before and text[before - 1].isspace():
                before -= 1
            found = text.endswith(("concat!", "join", "concat"), 0, before)
            break
        found = False
        break
    for i in way:
        t.listed[i] = found
    return found


def _glued(t: Text, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of the literals glued to the one around ``at`` whose closing quote stands at ``end``."""
    text, q, pos = t.text, t.text[end], end + 1
    while True:
        m = _GLUE.match(text, pos)
        if not m or m["q"] != q or "," in m[0]:
            m = _GLUE_LIST.match(text, pos)
            if not m or m["q"] != q or not _in_list(t, at, q):
                return
        elif "+" not in m[0] and "\n" not in m[0] and m[0].strip(" \t") != q:
            return
        body = _CLOSE_VALUE[q].match(text, m.end())
        if not text.startswith(q, body.end()):
            return
        yield body.start(), body.end()
        pos = body.end() + len(q)


_LITERAL_END = re.compile(r"[\"'`\n]")


def _chain(t: Text, at: int) -> tuple[str, list[tuple[int, int]]]:
    """From ``at`` to the end of its literal and on through the literals glued to it."""
    end = _LITERAL_END.search(t.text, at)
    if not end or end[0] == "\n":
        return "", []
    spans = [(at, end.start()), *_glued(t, at, end.start())]
    return "".join(t.text[a:b] for a, b in spans), spans


def _connection(t: Text, at: int, end: int, add) -> None:
    text = t.text
    k = at
    while k and (text[k - 1].isalnum() and text[k - 1] < "\x80" and not text[k - 1].isalpha() or text[k - 1] in "+.-"):
        k -= 1
    if not k or not (text[k - 1].isalpha() and text[k - 1] < "\x80"):
        return
    colon = text.find(":", at + 3)
    a, b, user = colon + 1, end - 2, text[at + 3 : colon]
    if t.placeholder(a, b) or text[a] in "<{$%[" or text[a:b].lower() in (user.lower(), "pw", "pass", "password", "secret"):
        return
    add([(a, b)], "connection string")


def _login(t: Text, scheme: str, at: int, spans: list[tuple[int, int]], add) -> None:
    text = t.text
    if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return
    a = _BLANKS.match(text, at + len(scheme)).end()
    if a >= spans[0][1]:
        return
    spans = [(a, spans[0][1]), *spans[1:]]
    v = "".join(text[i:j] for i, j in spans)
    if scheme == "basic":
        try:
            plain = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
        except (binascii.Error, UnicodeDecodeError, ValueError):
            return
        user, colon, password = plain.partition(":")
        if colon and plain.isprintable() and not placeholder(password):
            add(spans, "login")
    elif len(v) >= 12 and any(c.isdigit() for c in v) and not placeholder(v):
        add(spans, "login")


_USER_OPTION = re.compile(r"(?:-u|--user)[ =]+(?P<q>[\"']?)(?P<user>[\w.@+-]+):(?P<q2>[\"']?)(?=[^\s\"'`])")
_USER_PROSE = re.compile(r"[:=][ \t]*[\"'`]?(?P<user>[\w.@+-]+)[\"'`]?(?:[ \t]*/[ \t]*|[ \t]+|[ \t]*:[ \t]*)[\"'`]?(?=[^\s\"'`])")
_ONE_WORD = re.compile(r"[^\S\n]*[\w.]+[^\S\n]*(?:\n|\Z)")


def _account(t: Text, at: int, add) -> None:
    text = t.text
    if text[at] == "-":
        m = _USER_OPTION.match(text, at)
        if m and (not at or text[at - 1] in " \t\n\"'`(;"):
            b = t.next("blank", m.end())
            if not t.placeholder(m.end(), b):
                add([(m.end(), b)], "account")
        return
    stop = _RUN_WORD.match(text, at).end()
    if text[at:stop].lower() not in ("login", "logon", "credentials"):
        return
    colon = t.next("colon", stop)
    m = _USER_PROSE.match(text, colon) if colon < len(text) else None
    if m and t.loose(at) in ("config", "comment"):
        b = t.next("blank", m.end())
        if t.secret_like(m.end(), b) and not t.placeholder(m.end(), b) and not _ONE_WORD.match(text, b):
            add([(m.end(), b)], "account")


_RUN_WORD = re.compile(r"\w*")
_CALL = re.compile(r"(?:concat!\s*\(|\[|\"\"\.join\(\s*[\[(]|''\.join\(\s*[\[(]|String\.join\(\s*\"\"\s*,|strings\.Join\(\[\]string\{|String\.from\(|new String\()\s*[\"']")
_CALLED = re.compile(r"[\w.]+\(")
_ESCAPED = re.compile(r'[^"\\\n]*')
_DIGITS = re.compile(r"\d+,*")


def _named(t: Text, start: int, stop: int, add) -> None:
    """The value that is assigned to the name from ``start`` to ``stop``."""
    text = t.text
    where = t.loose(start)
    m = _ASSIGN.match(text, stop)
    if m:
        v = m.end()
        c = _CALL.match(text, v)
        if c:
            v = c.end() - 1
            joined, spans = _chain(t, v + 1)
            if len(spans) > 1 and Text(joined).is_value(0, len(joined)):
                return add(spans, "named value")
        if text[v : v + 1] in "\"'`" and v < len(text) or _QUOTE.match(text, v):
            got = pieces(text, v)
            if got and got[1]:
                value, spans = got
                of = (t, *spans[0]) if len(spans) == 1 else (Text(value), 0, len(value))
                if (m["op"] not in (",", "(") or of[0].secret_like(of[1], of[2])) and of[0].is_value(of[1], of[2]):
                    add(spans, "named value")
            if got is None and where == "string":  # an escaped or nested quote
                b = t.next("blank", v + 1)
                if b > v + 1 and t.secret_like(v + 1, b) and not t.placeholder(v + 1, b):
                    add([(v + 1, b)], "named value")
            return
        if text.startswith('\\"', v) and where:
            b = _ESCAPED.match(text, v + 2).end()
            if t.is_value(v + 2, b):
                add([(v + 2, b)], "named value")
            return
        if m["op"].strip() == "is":
            b = t.next("blank", v)
            while b > v and text[b - 1] in ".,;":
                b -= 1
            if where and t.secret_like(v, b) and not t.placeholder(v, b):
                add([(v, b)], "prose")
            return
        if where and m["op"] in ("=", ":", ":=", "=>"):
            if where == "config" and (m["op"] == "=" or not text[v : v + 1].isspace()):
                if t.json:
                    return  # a value without quotes is no string there
                end = t.next("blank", v)
                if m["op"] == ":" and _MARKUP.match(text, v):
                    return
                bare = end
                while bare > v and text[bare - 1] in ",;":
                    bare -= 1
                i = t.rest_of_line(end)
                closed = i >= 0 and text.startswith(("#", ";", "//", ",", "}"), i)
                if end > v and t.is_value(v, bare) and (i < 0 or closed or t.secret_like(v, end)) and not _CALLED.match(text, v, end) and not _DIGITS.fullmatch(text, v, end):
                    add([(v, bare if i < 0 or text[i] in "}#" else end)], "named value")
                return
            b = t.next("stop", v)
            if b > v:
                if text[b : b + 1] == ";" and b + 1 < len(text) and not text[b + 1].isspace():
                    b += 1
                if t.is_value(v, b) and t.secret_like(v, b):
                    add([(v, b)], "named value")
                    return
    if where in ("config", "comment"):
        if not t.words_at <= stop <= t.words_end:
            t.words_at, t.words_end = stop, _WORDS.match(text, stop).end()
        p = _COLON.match(text, t.words_end)
        if p and (t.words_end == stop or text[stop] in " \t"):
            b = end = t.next("blank", p.end())
            while b > p.end() and text[b - 1] in ".,;":
                b -= 1
            if t.secret_like(p.end(), b) and not t.placeholder(p.end(), b) and (where == "comment" or t.rest_of_line(end) < 0):
                add([(p.end(), b)], "prose")


def _param(t: Text, at: int, add) -> int:
    """The parameter that begins at ``at`` with its ? or &; where its value ends, or -1."""
    m = _PARAM.match(t.text, at)
    if not m or m["n"].lower().replace("_", "").replace("-", "") not in PARAMS:
        return -1
    a, b = m.span("v")
    if b - a >= 8 and t.next("digit", a) < b and not t.placeholder(a, b):
        add([(a, b)], "query parameter")
    return b


def lines_found(text: str, rel: str) -> list[tuple[int, int, int, str]]:
    """(line, start, end, kind) of the first piece of each value."""
    t = Text(text, rel)
    seen, out = set(), []
    for a, b, kind, g in find(text, rel):
        if g not in seen:
            seen.add(g)
            out.append((t.line(a), a, b, kind))
    return out


def redact_text(text: str, rel: str) -> tuple[str, int]:
    """The text with a mark for each piece of each value (armor lines stay), and the number of values."""
    out, pos, groups = [], 0, set()
    for a, b, kind, g in find(text, rel):
        groups.add(g)
        if a < pos or kind == "private key" and text.startswith("-----BEGIN", a):
            continue
        out += [text[pos:a], MARK]
        pos = b
    out.append(text[pos:])
    return "".join(out), len(groups)


def find_credentials(files: DataFrame) -> DataFrame:
    """One row per value: line, span of its (first) piece in code points, kind. A narrow map over three columns."""
    names = [c.strip().split(" ")[0] for c in FOUND.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(ws, rel, *x) for ws, rel, text in pdf.itertuples(index=False) for x in lines_found(text, rel or "")]
            yield pd.DataFrame(rows, columns=names)

    return spread(files.select("ws", "rel", "content").where("content IS NOT NULL")).mapInPandas(run, FOUND)


def redact(files: DataFrame) -> DataFrame:
    """(ws, rel, values, content) with all values made unreadable, for files that hold any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ws, rel, text in pdf.itertuples(index=False):
                made, n = redact_text(text, rel or "")
                if n:
                    rows.append((ws, rel, n, made))
            yield pd.DataFrame(rows, columns=["ws", "rel", "values", "content"])

    return spread(files.select("ws", "rel", "content").where("content IS NOT NULL")).mapInPandas(run, "ws string, rel string, values int, content string")


def audit(files: DataFrame) -> DataFrame:
    """(ws, rel, changed, left) of every file with content: lines that hold no value and yet are not the same behind the
    redaction (or a number of lines that differs), and values that are found in the redacted content."""

    def check(text: str, rel: str) -> tuple[int, int]:
        t, spans = Text(text, rel), find(text, rel)
        if not spans:
            return 0, 0
        made, _ = redact_text(text, rel)
        held = {n for a, b, *_ in spans for n in range(t.line(a), t.line(b - 1) + 1)}
        before, after = text.split("\n"), made.split("\n")
        changed = abs(len(before) - len(after)) + sum(x != y and n not in held for n, (x, y) in enumerate(zip(before, after), 1))
        return changed, len(lines_found(made, rel))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(ws, rel, *check(text, rel or "")) for ws, rel, text in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["ws", "rel", "changed", "left"])

    return spread(files.select("ws", "rel", "content").where("content IS NOT NULL")).mapInPandas(run, "ws string, rel string, changed int, `left` int")
