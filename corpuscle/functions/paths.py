"""Paths: languages, textual and secret files, globs, path matchers, ignore files, lexical normalisation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ext_of

TEXT_MAX = 512 * 1024  # the default; ``is_textual`` and the sources take another, or None for no limit

# fixed values: extensions by language
EXT_LANGS = {
    "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .tsx .mts .cts", "python": ".py", "go": ".go", "rust": ".rs", "php": ".php .phtml",
    "java": ".java", "csharp": ".cs", "c": ".c", "cpp": ".h .cpp .cc .cxx .hpp .hh .hxx .ipp", "json": ".json .jsonc", "markdown": ".md .markdown",
    "text": ".txt", "html": ".html .htm .ok", "css": ".css .scss", "yaml": ".yml .yaml", "shell": ".sh .bash", "powershell": ".ps1", "sql": ".sql",
    "xml": ".xml", "svg": ".svg", "csv": ".csv", "toml": ".toml", "ini": ".ini",
}
# fixed values: further textual extensions
TEXT_EXT = ".env .gitignore .editorconfig".split()
# fixed values: files whose content must never be read into an index
SECRET_PATTERNS = [
    r"(^|/)\.env($|\.)", r"(^|/)\.(npmrc|netrc|pgpass|htpasswd)$", r"(^|/)(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(^|/)(credentials|secrets?)(\.[A-Za-z0-9_-]+)?\.(json|ya?ml|ini|txt)$", r"\.(pem|key|p12|pfx|keystore|jks|license)$",
]
# fixed values: directories that a walk leaves out
SKIP_DIRS = "node_modules .git .idea dist build coverage .next vendor".split()
PRUNE_DOT_DIRS = (
    ".git .hg .svn .next .nuxt .svelte-kit .turbo .cache .parcel-cache .venv .tox .mypy_cache .pytest_cache .ruff_cache .gradle .idea "
    ".vs .terraform .serverless .yarn .pnpm-store .expo"
).split()
TRANSIENT = r"(^|/)\.corpuscle-tmp-|\.corpuscle-lock$"
# fixed values: reasons, as stored
OPAQUE_SECRET = "may hold credentials — hashed, never read"
OPAQUE_OTHER = "binary or oversized — hashed, not read"

LANG_OF_EXT = {e: lang for lang, exts in EXT_LANGS.items() for e in exts.split()}


def lang_of(rel: Column) -> Column:
    """Language of a path; 'other' for unknown extensions. One map lookup, no Python."""
    table = F.create_map(*[F.lit(x) for pair in LANG_OF_EXT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext_of(rel)), F.lit("other"))


def is_secret(rel: Column) -> Column:
    return F.regexp_replace(rel, r"\\", "/").rlike("(?i)" + "|".join(f"(?:{p})" for p in SECRET_PATTERNS))


def is_textual(rel: Column, size: Column | None = None, most: int | None = TEXT_MAX) -> Column:
    """Textual by name, not secret, and of at most ``most`` bytes; an unknown size passes."""
    known = ext_of(rel).isin([*LANG_OF_EXT, *TEXT_EXT])
    small = F.lit(True) if size is None or most is None else F.coalesce(size <= most, F.lit(True))
    return known & ~is_secret(rel) & small


def opaque_reason(rel: Column) -> Column:
    return F.when(is_secret(rel), F.lit(OPAQUE_SECRET)).otherwise(F.lit(OPAQUE_OTHER))


def dirname(rel: Column) -> Column:
    """Text before the last slash, '.' for a file at the root and '/' for one directly under it."""
    d = F.regexp_extract(rel, r"^(.*)/[^/]*$", 1)
    return F.when(~rel.contains("/"), F.lit(".")).when(rel.rlike("^/[^/]*$"), F.lit("/")).otherwise(d)


def basename(rel: Column) -> Column:
    return F.regexp_extract(rel, r"([^/]*)$", 1)


def path_ok(rel: Column) -> Column:
    """Relative, no NUL, no parent segment, no drive or backslash root."""
    return ~rel.rlike(r"(^|[/\\])\.\.([/\\]|$)|\x00|^[/\\]|^[A-Za-z]:") & (F.length(rel) > 0)


def clean_path(rel: Column) -> Column:
    """Without empty and '.' segments."""
    return F.array_join(F.filter(F.split(rel, "/"), lambda s: (s != "") & (s != ".")), "/")


def norm(path: Column) -> Column:
    """Posix normalisation of a relative path by a fold over its segments; null if it leaves the root."""
    start = F.array().cast("array<string>")
    step = lambda acc, s: (
        F.when((s == "") | (s == "."), acc)
        .when(s != "..", F.concat(acc, F.array(s)))
        .when(F.size(acc) == 0, F.array(F.lit("..")))
        .when(F.element_at(acc, -1) == "..", F.concat(acc, F.array(F.lit(".."))))
        .otherwise(F.slice(acc, 1, F.size(acc) - 1))
    )
    out = F.aggregate(F.split(path, "/"), start, step)
    return F.when(F.element_at(F.concat(out, F.array(F.lit(""))), 1) == "..", F.lit(None)).otherwise(F.array_join(out, "/"))


# -- globs


#: Kinds of glob tokens, the first that fits, and what each becomes. A brace group is an alternation; one that is never
#: closed goes on to the end, and a closing brace or a comma outside groups is an ordinary character.
_GLOB = re.compile(r"(?P<folders>(?:(?<=/)|\A)\*{2,}/)|(?P<rest>\*{2,}\Z)|(?P<some>\*+)|(?P<one>\?)|\[(?P<no>[!^]?)(?P<set>\]?[^\]]*)\]|(?P<group>\{)|(?P<end>\})|(?P<or>,)|\\(?P<quoted>.)|(?P<plain>.)", re.S)
_GLOB_AS = {"folders": "(?:[^/]*/)*", "rest": ".*", "some": "[^/]*", "one": "[^/]", "group": "(?:", "end": ")", "or": "|"}


def glob_body(glob: str) -> str:
    """A glob as a regular expression over a whole path, without anchors."""
    made = ""
    inside = 0
    for token in _GLOB.finditer(glob):
        kind = token.lastgroup
        if kind == "set":
            chars = token["set"].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            made += f"[{'^' if token['no'] else ''}{chars}]"
        elif kind in _GLOB_AS and (inside or kind not in ("end", "or")):
            made += _GLOB_AS[kind]
            inside += {"group": 1, "end": -1}.get(kind, 0)
        else:
            made += re.escape(token["quoted"] or token[0])
    return made + ")" * inside


def glob_regex(glob: str) -> str:
    """Matches a path, and everything below a directory that matches. Without a slash at any depth, else from the root."""
    glob = glob.removeprefix("./")
    anchored = "/" in glob.rstrip("/")
    return ("^" if anchored else "^(?:.*/)?") + f"(?:{glob_body(glob.strip('/'))})(?:/.*)?$"


_INNERMOST = re.compile(r"\{[^{}]*\}")
_HIDE = str.maketrans("{},", "\ue000\ue001\ue002")
_SHOW = str.maketrans("\ue000\ue001\ue002", "{},")


def split_list(spec: str) -> list[str]:
    """Comma-separated globs. Brace groups are hidden from the innermost outwards, and what follows an open brace with
    them, so that only the commas between globs are left to split at."""
    while _INNERMOST.search(spec):
        spec = _INNERMOST.sub(lambda m: m[0].translate(_HIDE), spec)
    head, brace, tail = spec.partition("{")
    globs = (head + (brace + tail).translate(_HIDE)).split(",")
    return [g.strip().translate(_SHOW) for g in globs if g.strip()]


@dataclass(frozen=True)
class PathMatcher:
    """Below any root, matching any include, and no exclude. Empty lists do not filter."""

    roots: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def column(self, rel: Column) -> Column:
        ok = F.lit(True)
        roots = [r.removeprefix("./").strip("/") for r in self.roots]
        roots = [r for r in roots if not any(r != o and r.startswith(o + "/") for o in roots)]
        if [r for r in roots if r]:
            one = F.lit(False)
            for r in roots:
                one = one | (rel == r) | rel.startswith(r + "/")
            ok = ok & one
        if self.include:
            ok = ok & rel.rlike("|".join(f"(?:{glob_regex(g)})" for g in self.include))
        if self.exclude:
            ok = ok & ~rel.rlike("|".join(f"(?:{glob_regex(g)})" for g in self.exclude))
        return ok


def in_dir(rel: Column, directory: str) -> Column:
    """Below a directory, which is not a string prefix: ``lib`` does not take ``libs/x``."""
    d = directory.removeprefix("./").strip("/")
    return rel.startswith(d + "/") if d and d != "." else F.lit(True)


def gitignore_regex(text: str) -> str | None:
    """The supported subset of an ignore file as one regular expression: no negation, no ``**``, no classes."""
    parts = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!" or "**" in line or "[" in line:
            continue
        body = line.rstrip("/")
        anchored = "/" in body
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in body.lstrip("/"))
        parts.append(("^" if anchored else "(?:^|/)") + body + ("/" if line.endswith("/") else "(?:/|$)"))
    return "|".join(parts) or None


def walk_filter(rel: Column, ignore: str | None = None) -> Column:
    """What a walk of a workspace lists: no skipped or pruned directory above, nothing ignored, nothing transient."""
    dirs = "|".join(re.escape(d) for d in dict.fromkeys([*SKIP_DIRS, *PRUNE_DOT_DIRS]))
    ok = ~rel.rlike(f"(?:^|/)(?:{dirs})/") & ~rel.rlike(TRANSIENT)
    pattern = gitignore_regex(ignore) if ignore else None
    return ok & ~rel.rlike(pattern) if pattern else ok


def library_path(rel: Column) -> Column:
    """Below a skipped directory that is no dot-directory."""
    dirs = "|".join(d for d in SKIP_DIRS if not d.startswith("."))
    return rel.rlike(f"(?:^|/)(?:{dirs})(?:/|$)")
