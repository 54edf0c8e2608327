"""Imports as rows, and their resolution to files: ordered candidates of which the first that exists wins.

Every resolver makes candidate paths with their order, joins them to the file list on (ws, path) and keeps the least order
of each import. All joins are equi joins; longest-prefix and nearest-ancestor rules explode the prefixes of a path, whose
number is its depth.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.text import Offsets
from ..session import ext_of, materialise, table
from . import corpus

# fixed values: order in which a script import is tried
SUFFIXES = ["", ".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".mjs", ".cjs", ".jsx"]
INDEX = ["/index" + s for s in SUFFIXES[1:]]
SCRIPT_EXT = [".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".mts", ".cts"]

FAMILY_OF = {".py": "python", ".go": "go", ".java": "java", ".rs": "rust", ".php": "php", ".phtml": "php", ".cs": "csharp"} | dict.fromkeys(SCRIPT_EXT, "script") | dict.fromkeys([".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".ipp"], "include")

_STR = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
#: What is blanked before statements are looked for: comments, and literals over several lines.
_BLANK = {
    "python": re.compile(rf"(?P<gone>#[^\n]*|\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*+\'\'\')|{_STR}", re.S),
    "script": re.compile(rf"(?P<gone>//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*+`)|{_STR}", re.S),
    "php": re.compile(rf"(?P<gone>//[^\n]*|\#(?!\[)[^\n]*|/\*.*?\*/)|{_STR}", re.S),
    "": re.compile(r"(?P<gone>//[^\n]*|/\*.*?\*/)|\"(?:[^\"\\\n]|\\.)*+\"", re.S),
}
_SCRIPT = re.compile(
    r"""^[ \t]*(?P<by>import|export)\b(?:\s*type\b(?!\s*from))?(?P<what>[^'"();=]*?)\bfrom\s*(?P<q>['"])(?P<spec>[^'"\n]+)(?P=q)|^[ \t]*import\s*(?P<q2>['"])(?P<bare>[^'"\n]+)(?P=q2)|\b(?:require|import)\s*\(\s*(?P<q3>['"])(?P<call>[^'"\n]+)(?P=q3)\s*\)""",
    re.M,
)
_PY_FROM = re.compile(r"^[ \t]*from[ \t]+(?P<spec>\.*[\w.]*)[ \t]+import\b[ \t]*(?P<what>\([^)]*\)|(?:[^\n;\\]|\\\n)*)", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+(?P<what>(?:[^\n;\\]|\\\n)+)", re.M)
_GO = re.compile(r"^import\s*(?:\((?P<block>[^)]*)\)|(?:[\w.]+\s+)?(?P<one>\"[^\"\n]+\"|`[^`\n]+`))", re.M)
_GO_SPEC = re.compile(r"\"([^\"\n]+)\"|`([^`\n]+)`")
_JAVA = re.compile(r"^[ \t]*import\s+(?:static\s+)?(?P<spec>[\w.]+(?:\.\*)?)\s*;", re.M)
_RUST = re.compile(r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?(?:use\s+(?P<tree>[^;]+);|mod\s+(?P<mod>\w+)\s*;)", re.M)
_PHP = re.compile(r"^[ \t]*use\s+(?:function\s+|const\s+)?(?P<tree>[\w\\][^;(]*);", re.M)
_INCLUDE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*(?:\"(?P<own>[^\"\n]+)\"|<(?P<angled>[^>\n]+)>)", re.M)
_USING = re.compile(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:[\w]+\s*=\s*)?(?P<spec>[\w.]+)\s*;", re.M)
_ALIAS = re.compile(r"\s+as\s+[\w$]+\s*$")


def _listed(what: str) -> list[str]:
    """Names of a comma-separated list, without aliases and marks."""
    names = (_ALIAS.sub("", x.strip()).removeprefix("type ").strip() for x in what.replace("\\\n", " ").strip("() \t\n").split(","))
    return [n for n in names if re.fullmatch(r"[\w$.]+", n)]


def _tree(text: str, sep: str) -> list[str]:
    """Paths of a use tree: groups in braces are multiplied out, a group's ``self`` is the path before it."""
    text = text.strip()
    brace = text.find("{")
    if brace < 0:
        path = re.sub(r"\s", "", _ALIAS.sub("", text))
        return [path.removesuffix(sep + "self")] if path else []
    head, parts, depth, begin = re.sub(r"\s", "", text[:brace]), [], 0, brace + 1
    for k in range(brace, len(text)):
        c = text[k]
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 1 or c == "}" and not depth:
            parts.append(text[begin:k])
            begin = k + 1
        if not depth:
            break
    out = [head + p for part in parts for p in _tree(part, sep)]
    return [head.removesuffix(sep) if p == head + "self" else p for p in out]


def statements_of(family: str, source: str) -> list[tuple[int, str, bool, list[str], bool, bool]]:
    """(line, spec, re-export, names, is_mod, angled) of every import in a text; a statement may take several lines."""
    bare = _BLANK.get(family, _BLANK[""]).sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m["gone"] else m[0], source)
    at = Offsets(bare)
    out = []

    def add(pos: int, spec: str, reexport: bool = False, names=(), is_mod: bool = False, angled: bool = False) -> None:
        out.append((at.line_col(pos)[0], spec, reexport, list(names), is_mod, angled))

    if family == "script":
        for m in _SCRIPT.finditer(bare):
            what = m["what"] or ""
            names = _listed(what[what.find("{") + 1 : what.find("}")]) if "{" in what else []
            if m["by"] and names and re.match(r"\s*[\w$]+\s*,", what):
                names.append("default")
            add(m.start() + len(m[0]) - len(m[0].lstrip()), m["spec"] or m["bare"] or m["call"], m["by"] == "export", names)
    elif family == "python":
        for m in _PY_FROM.finditer(bare):
            add(m.start(), m["spec"], names=_listed(m["what"]))
        for m in _PY_IMPORT.finditer(bare):
            for name in _listed(m["what"]):
                add(m.start(), name)
    elif family == "go":
        for m in _GO.finditer(bare):
            for x in _GO_SPEC.finditer(bare, *m.span("block" if m["block"] is not None else "one")):
                add(x.start(), x[1] or x[2])
    elif family == "rust":
        for m in _RUST.finditer(bare):
            for spec in [m["mod"]] if m["mod"] else _tree(m["tree"], "::"):
                add(m.start(), spec, reexport=not m["mod"] and m[0].lstrip().startswith("pub"), is_mod=bool(m["mod"]))
    elif family == "php":
        for m in _PHP.finditer(bare):
            for part in re.split(r",(?![^{]*\})", m["tree"]):
                for spec in _tree(part, "\\"):
                    add(m.start(), spec.lstrip("\\"))
    elif family == "include":
        for m in _INCLUDE.finditer(bare):
            add(m.start(), m["own"] or m["angled"], angled=bool(m["angled"]))
    else:
        for m in {"java": _JAVA, "csharp": _USING}[family].finditer(bare):
            add(m.start(), m["spec"])
    return sorted(out)


STATEMENTS = "ws string, rel string, ln int, family string, spec string, reexport boolean, names array<string>, is_mod boolean, angled boolean"


def statements(files: DataFrame) -> DataFrame:
    """(ws, rel, ln, family, spec, reexport, names, is_mod, angled) read from content. A narrow map over the files whose
    content holds a word that imports."""
    import pandas as pd

    family = F.create_map(*[F.lit(x) for pair in FAMILY_OF.items() for x in pair])
    c = corpus.content(files).select("ws", "rel", F.try_element_at(family, ext_of(F.col("rel"))).alias("family"), "content")
    c = c.where(F.col("family").isNotNull() & F.col("content").rlike(r"\b(?:import|from|require|use|mod|using|include)\b"))

    def run(batches):
        for pdf in batches:
            rows = [(ws, rel, ln, fam, *rest) for ws, rel, fam, source in pdf.itertuples(index=False) for ln, *rest in statements_of(fam, source)]
            yield pd.DataFrame(rows, columns=["ws", "rel", "ln", "family", "spec", "reexport", "names", "is_mod", "angled"])

    return c.mapInPandas(run, STATEMENTS).distinct()


def imports(files: DataFrame) -> DataFrame:
    """The stored import rows, one each."""
    i = files.select("ws", "rel", F.explode("imports").alias("i")).select("ws", "rel", "i.spec", "i.line", "i.kind")
    return i.distinct()


def _first(cands: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``cands`` has keys, an array ``c`` of paths in order; gives keys and the first that is a file."""
    known = files.select("ws", F.col("rel").alias("to_rel")).distinct()
    each = cands.select(*keys, F.posexplode("c").alias("pos", "to_rel")).where(F.col("to_rel").isNotNull())
    return each.join(known, ["ws", "to_rel"]).groupBy(*keys).agg(F.min_by("to_rel", "pos").alias("to_rel"))


def _beside(rel: Column, spec: Column) -> Column:
    d = paths.dirname(rel)
    return paths.norm(F.when(d == ".", spec).otherwise(F.concat(d, F.lit("/"), spec)))


def script_candidates(base: Column) -> Column:
    return F.transform(F.array(*[F.lit(x) for x in [*SUFFIXES, *INDEX]]), lambda s: F.concat(base, s))


KEYS = ["ws", "rel", "ln", "spec"]


def resolve_script(st: DataFrame, files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Relative specifiers; with ``configs`` (ws, dir, pos, prefix, suffix, target) also path aliases of the nearest one."""
    s = st.where("family = 'script'").select(*KEYS).distinct()
    rel = s.where(F.col("spec").rlike(r"^\.{1,2}(?:/|$)")).select(*KEYS, script_candidates(_beside(F.col("rel"), F.col("spec"))).alias("c"))
    out = _first(rel, files, KEYS)
    if configs is None:
        return out
    bare = s.where(~F.col("spec").startswith("."))
    up = bare.select(*KEYS, F.explode(ancestors(F.col("rel"))).alias("dir"))
    near = up.join(configs.select("ws", "dir").distinct(), ["ws", "dir"]).groupBy(*KEYS).agg(F.max_by("dir", F.length("dir")).alias("dir"))
    m = near.join(configs, ["ws", "dir"]).where(F.col("spec").startswith(F.col("prefix")) & F.col("spec").endswith(F.col("suffix")) & (F.length("spec") >= F.length("prefix") + F.length("suffix")))
    star = F.expr("substring(spec, length(prefix) + 1, length(spec) - length(prefix) - length(suffix))")
    target = paths.norm(F.concat(F.when(F.col("dir") == "", F.lit("")).otherwise(F.concat("dir", F.lit("/"))), F.replace(F.col("target"), F.lit("*"), star)))
    c = m.groupBy(*KEYS).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", target.alias("t")))), lambda x: script_candidates(x["t"]))).alias("c"))
    return out.unionByName(_first(c, files, KEYS))


def ancestors(rel: Column) -> Column:
    """Directories above a path, the root as ''."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def resolve_python(st: DataFrame, files: DataFrame) -> DataFrame:
    """Relative modules climb from the package; absolute ones are tried under the roots: the parents of top packages, src, the root.

    A module without such a file may name submodules: ``from .pkg import name`` resolves to pkg/name.py.
    """
    s = st.where("family = 'python'").select(*KEYS, "names").distinct()
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    tail = F.regexp_replace(F.regexp_replace("spec", r"^\.+", ""), r"\.", "/")
    up = F.concat(F.lit("."), F.repeat(F.lit("/.."), dots - 1))
    base = _beside(F.col("rel"), F.when(tail == "", up).otherwise(F.concat(up, F.lit("/"), tail)))
    first_names = lambda b: F.flatten(F.transform("names", lambda n: F.array(F.concat(b, F.lit("/"), n, F.lit(".py")), F.concat(b, F.lit("/"), n, F.lit("/__init__.py")))))
    tries = lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")))
    relative = s.where(dots > 0).select(*KEYS, F.concat(F.transform(F.array(base), lambda b: F.concat(b, F.lit(".py"))), F.transform(first_names(base), lambda x: F.regexp_replace(x, "^/", "")), F.array(F.regexp_replace(F.concat(base, F.lit("/__init__.py")), "^/", ""))).alias("c"))
    out = _first(relative, files, KEYS)
    init = files.where(F.col("rel").endswith("__init__.py")).select("ws", paths.dirname(F.col("rel")).alias("dir")).distinct()
    above = init.select("ws", F.when(F.col("dir").contains("/"), F.regexp_replace("dir", "/[^/]*$", "")).otherwise(F.lit("")).alias("root"), "dir")
    tops = above.join(init.select("ws", F.col("dir").alias("root")), ["ws", "root"], "left_anti").select("ws", "root").distinct()
    # each file under the roots above it, by the module it is there: joined on the module, not on all roots of a workspace
    py = files.where(F.col("rel").endswith(".py")).select("ws", F.col("rel").alias("to_rel"), F.explode(ancestors(F.col("rel"))).alias("root")).distinct()
    known = py.join(tops.withColumn("top", F.lit(True)), ["ws", "root"], "left").where(F.col("top") | F.col("root").isin("", "src"))
    inner = F.when(F.col("root") == "", F.col("to_rel")).otherwise(F.expr("substring(to_rel, length(root) + 2)"))
    known = known.select("ws", "root", "to_rel", F.regexp_replace(inner, r"(?:/__init__)?\.py$", "").alias("module"), F.col("to_rel").endswith("__init__.py").alias("package"))
    own = s.where(dots == 0)
    path = F.replace(F.col("spec"), F.lit("."), F.lit("/"))
    asked = own.select(*KEYS, F.explode(F.concat(F.array(F.struct(F.lit(0).alias("pos"), path.alias("module"))), F.transform("names", lambda n: F.struct(F.lit(1).alias("pos"), F.concat(path, F.lit("/"), n).alias("module"))))).alias("a")).select(*KEYS, "a.pos", "a.module")
    rank = F.struct(F.when((F.col("pos") == 0) & F.col("package"), 2).otherwise(F.col("pos")).alias("pos"), "root", "package", "to_rel")
    got = asked.join(known, ["ws", "module"]).groupBy(*KEYS).agg(F.min(rank).alias("b"))
    return out.unionByName(got.select(*KEYS, "b.to_rel"))


def resolve_go(st: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """``modules`` (ws, dir, module): the longest module that is a prefix gives a directory, and that all its files but tests."""
    s = st.where("family = 'go'").select(*KEYS).distinct()
    parts = F.split("spec", "/")
    pre = s.select(*KEYS, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("module"))
    best = pre.join(modules, ["ws", "module"]).groupBy(*KEYS).agg(F.max_by(F.struct("module", "dir"), F.length("module")).alias("m"))
    rest = F.expr("substring(spec, length(m.module) + 2)")
    target = F.when(rest == "", F.col("m.dir")).when(F.col("m.dir") == "", rest).otherwise(F.concat("m.dir", F.lit("/"), rest))
    go = files.where(F.col("rel").endswith(".go") & ~F.col("rel").endswith("_test.go")).select("ws", F.col("rel").alias("to_rel"), F.regexp_replace(paths.dirname(F.col("rel")), r"^\.$", "").alias("target")).distinct()
    return best.select(*KEYS, target.alias("target")).join(go, ["ws", "target"]).select(*KEYS, "to_rel")


def java_classes(files: DataFrame) -> DataFrame:
    """(ws, fqcn, pkg, to_rel): the package clause and the name of the file."""
    j = corpus.content(files).where(F.col("rel").endswith(".java"))
    pkg = F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    name = F.regexp_extract("rel", r"([^/]+)\.java$", 1)
    rows = j.select("ws", F.col("rel").alias("to_rel"), pkg.alias("pkg"), F.explode(F.array_distinct(F.concat(F.array(name), F.regexp_extract_all("content", F.lit(r"(?m)^(?:(?:public|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)"), F.lit(1))))).alias("name"))
    return rows.select("ws", "to_rel", "pkg", F.when(F.col("pkg") == "", F.col("name")).otherwise(F.concat("pkg", F.lit("."), "name")).alias("fqcn")).distinct()


def resolve_java(st: DataFrame, files: DataFrame) -> DataFrame:
    """A class by its full name; a star by package, 1:N; static and nested names lose segments from the right, longest first."""
    s = st.where("family = 'java'").select(*KEYS).distinct()
    classes = java_classes(files)
    star = s.where(F.col("spec").endswith(".*")).withColumn("pkg", F.regexp_replace("spec", r"\.\*$", "")).join(classes.select("ws", "pkg", "to_rel").distinct(), ["ws", "pkg"]).select(*KEYS, "to_rel")
    parts = F.split(F.regexp_replace("spec", r"\.\*$", ""), r"\.")
    pre = s.select(*KEYS, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("fqcn"))
    named = pre.join(classes.select("ws", "fqcn", "to_rel"), ["ws", "fqcn"]).groupBy(*KEYS).agg(F.max_by("to_rel", F.length("fqcn")).alias("to_rel"))
    return star.unionByName(named).distinct()


def rust_modules(files: DataFrame, st: DataFrame) -> DataFrame:
    """(ws, crate, mod, rel) of the module tree: a file counts if every ``mod`` on the way from main.rs or lib.rs is declared.

    The module path of a file follows from its place below the crate root, so reachability is a count of declared
    prefixes against the depth: no recursion and no loop.
    """
    rs = files.where(F.col("rel").endswith(".rs")).select("ws", "rel").distinct()
    roots = rs.where(F.col("rel").rlike(r"(?:^|/)(?:main|lib)\.rs$")).select("ws", F.regexp_replace("rel", r"(?:^|/)[^/]*$", "").alias("crate")).distinct()
    up = rs.select("ws", "rel", F.explode(ancestors(F.col("rel"))).alias("crate")).join(roots, ["ws", "crate"])
    near = up.groupBy("ws", "rel").agg(F.max_by("crate", F.length("crate")).alias("crate"))
    inner = F.expr("CASE WHEN crate = '' THEN rel ELSE substring(rel, length(crate) + 2) END")
    mod = F.when(inner.isin("main.rs", "lib.rs"), "").otherwise(F.replace(F.regexp_replace(F.regexp_replace(inner, r"/mod\.rs$", ".rs"), r"\.rs$", ""), F.lit("/"), F.lit("::")))
    placed = near.select("ws", "crate", "rel", mod.alias("mod"))
    declared = st.where("family = 'rust' AND is_mod").select("ws", "rel", "spec").distinct().join(placed, ["ws", "rel"])
    child = declared.select("ws", "crate", F.when(F.col("mod") == "", F.col("spec")).otherwise(F.concat("mod", F.lit("::"), "spec")).alias("prefix")).distinct()
    parts = F.split("mod", "::")
    need = placed.where("mod <> ''").select("ws", "crate", "rel", "mod", F.size(parts).alias("depth"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "::"))).alias("prefix"))
    good = need.join(child, ["ws", "crate", "prefix"]).groupBy("ws", "crate", "rel", "mod", "depth").agg(F.count("*").alias("n")).where("n = depth")
    return placed.where("mod = ''").unionByName(good.select("ws", "crate", "rel", "mod"))


def resolve_rust(st: DataFrame, files: DataFrame) -> DataFrame:
    """``mod x;`` and ``use crate::``, ``self::``, ``super::`` against the module tree: the full path, then without its last segment."""
    tree = rust_modules(files, st)
    s = st.where("family = 'rust'").select(*KEYS, "is_mod").distinct().join(tree, ["ws", "rel"])
    parent = F.regexp_replace("mod", r"(?:^|::)[^:]*$", "")
    spec = F.col("spec")
    join = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("::"), b))
    full = F.when(F.col("is_mod"), join(F.col("mod"), spec)).when(spec.startswith("crate::"), F.substring(spec, 8, 1 << 20)).when(spec.startswith("self::"), join(F.col("mod"), F.substring(spec, 7, 1 << 20))).when(spec.startswith("super::"), join(parent, F.substring(spec, 8, 1 << 20)))
    full = F.regexp_replace(full, r"::$", "")
    c = s.withColumn("full", full).where("full IS NOT NULL").select(*KEYS, "crate", F.posexplode(F.array(F.col("full"), F.regexp_replace("full", r"(?:^|::)[^:]*$", ""))).alias("pos", "mod"))
    got = c.join(tree.select("ws", "crate", "mod", F.col("rel").alias("to_rel")), ["ws", "crate", "mod"])
    return got.groupBy(*KEYS).agg(F.min_by("to_rel", "pos").alias("to_rel"))


def psr4_of(files: DataFrame) -> DataFrame:
    """(ws, prefix, dir) of the autoload rules of every composer.json, directories from the root of the workspace."""
    c = corpus.searchable_or_plain(files).where(paths.basename(F.col("rel")) == "composer.json")
    rules = lambda key: F.map_entries(F.coalesce(F.from_json(F.get_json_object("content", f"$.{key}"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    each = c.select("ws", "rel", F.explode(F.concat(rules("autoload.psr-4"), rules("autoload-dev.psr-4"))).alias("e"))
    return each.select("ws", F.col("e.key").alias("prefix"), F.coalesce(_beside(F.col("rel"), F.concat(F.regexp_replace("e.value", "/+$", ""), F.lit("/"))), F.lit("")).alias("dir")).distinct()


def resolve_csharp(st: DataFrame, files: DataFrame) -> DataFrame:
    """A namespace stands for every file that declares it; a static or aliased name for the file of the type, else of its
    longest prefix that is a type."""
    s = st.where("family = 'csharp'").select(*KEYS).distinct()
    c = corpus.content(files).where(F.col("rel").endswith(".cs")).select("ws", F.col("rel").alias("to_rel"), "content")
    spaces = c.select("ws", "to_rel", "content", F.regexp_extract_all("content", F.lit(r"(?m)^\s*namespace\s+([\w.]+)"), F.lit(1)).alias("ns"))
    named = spaces.select("ws", "to_rel", F.explode("ns").alias("spec")).distinct()
    types = spaces.select("ws", "to_rel", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[^/\n\"]*\b(?:class|struct|interface|record|enum)\s+(\w+)"), F.lit(1))).alias("t"), F.coalesce(F.try_element_at("ns", F.lit(1)), F.lit("")).alias("n"))
    types = types.select("ws", "to_rel", F.when(F.col("n") == "", F.col("t")).otherwise(F.concat("n", F.lit("."), "t")).alias("type")).distinct()
    parts = F.split("spec", r"\.")
    pre = s.select(*KEYS, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("type"))
    typed = pre.join(types, ["ws", "type"]).groupBy(*KEYS).agg(F.max_by("to_rel", F.struct(F.length("type"), "to_rel")).alias("to_rel"))
    return s.join(named, ["ws", "spec"]).select(*KEYS, "to_rel").unionByName(typed).distinct()


def resolve_php(st_php: DataFrame, files: DataFrame, psr4: DataFrame) -> DataFrame:
    """``psr4`` (ws, prefix, dir): the longest namespace prefix gives the directory of the class file."""
    parts = F.split("spec", r"\\")
    pre = st_php.select(*KEYS, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "\\"), F.lit("\\")))).alias("prefix"))
    best = pre.join(psr4, ["ws", "prefix"]).groupBy(*KEYS).agg(F.max_by(F.struct("prefix", "dir"), F.length("prefix")).alias("m"))
    path = F.concat(F.regexp_replace("m.dir", "/?$", "/"), F.replace(F.expr("substring(spec, length(m.prefix) + 1)"), F.lit("\\"), F.lit("/")), F.lit(".php"))
    return _first(best.select(*KEYS, F.array(paths.norm(path)).alias("c")), files, KEYS)


def resolve_include(st_c: DataFrame, files: DataFrame) -> DataFrame:
    """C and C++: beside the file, then from the root, then under directories named include; ``<x>`` only the last."""
    s = st_c.select(*KEYS, "angled").distinct()
    near = s.where(~F.col("angled")).select(*KEYS, F.array(_beside(F.col("rel"), F.col("spec")), paths.norm(F.col("spec"))).alias("c"))
    direct = _first(near, files, KEYS)
    # what stands below a directory named include, by its path from there; a path may lie below several
    parts = F.split("rel", "/")
    under = files.select("ws", F.col("rel").alias("to_rel"), parts.alias("p")).distinct().select("ws", "to_rel", "p", F.posexplode("p").alias("k", "d")).where((F.col("d") == "include") & (F.col("k") < F.size("p") - 1))
    under = under.select("ws", "to_rel", F.array_join(F.slice("p", F.lit(1), F.col("k") + 1), "/").alias("root"), F.expr("array_join(slice(p, k + 2, size(p)), '/')").alias("spec"))
    rest = s.join(direct, KEYS, "left_anti").join(under, ["ws", "spec"]).groupBy(*KEYS).agg(F.min(F.struct("root", "to_rel")).alias("b"))
    return direct.unionByName(rest.select(*KEYS, "b.to_rel"))


def configs_of(files: DataFrame) -> DataFrame:
    """Path aliases of every tsconfig.json as rows (ws, dir, pos, prefix, suffix, target), of the nearest kind for
    ``resolve_script``. ``extends`` is followed one hop to another tsconfig.json of the corpus; ``baseUrl`` alone lets any
    bare name resolve below it."""
    import pandas as pd

    def parse(batches):
        for pdf in batches:
            rows = []
            for ws, rel, source in pdf.itertuples(index=False):
                c = text.jsonc(source)
                c = c if isinstance(c, dict) else {}
                o = c.get("compilerOptions") or {}
                d = rel.rpartition("/")[0]
                own = [(k, v) for k, v in (o.get("paths") or {}).items() if isinstance(v, list)]
                base = o.get("baseUrl")
                ext = c.get("extends") if isinstance(c.get("extends"), str) and c["extends"].startswith(".") else None
                pos = 0
                for pattern, targets in own:
                    pre, star, suf = pattern.partition("*")
                    for t in targets:
                        rows.append((ws, d, pos, pre, suf if star else "", "/".join(x for x in ((base or "").removeprefix("./").strip("/"), t.removeprefix("./")) if x and x != "."), ext))
                        pos += 1
                if base is not None:
                    b = base.removeprefix("./").strip("/")
                    rows.append((ws, d, pos, "", "", f"{b}/*" if b and b != "." else "*", ext))
                elif not own and ext:
                    rows.append((ws, d, None, None, None, None, ext))
            yield pd.DataFrame(rows, columns=["ws", "dir", "pos", "prefix", "suffix", "target", "ext"]).astype({"pos": "Int32"})

    raw = corpus.content(files).where(paths.basename(F.col("rel")) == "tsconfig.json")
    rows = raw.mapInPandas(parse, "ws string, dir string, pos int, prefix string, suffix string, target string, ext string")
    own = rows.where("pos IS NOT NULL").drop("ext")
    # a file without rules of its own takes those of the one it extends, targets moved to where that stands
    bare = rows.where("pos IS NULL").select("ws", "dir", paths.norm(F.concat_ws("/", F.nullif("dir", F.lit("")), F.regexp_replace("ext", "(?:/?tsconfig)?(?:\\.json)?$", ""))).alias("from"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    taken = bare.join(own.withColumnRenamed("dir", "from"), ["ws", "from"])
    taken = taken.select("ws", "dir", "pos", "prefix", "suffix", F.concat(F.repeat(F.lit("../"), depth), F.when(F.col("from") == "", F.lit("")).otherwise(F.concat("from", F.lit("/"))), "target").alias("target"))
    return own.unionByName(taken)


def go_modules_of(files: DataFrame) -> DataFrame:
    """(ws, dir, module) of every go.mod."""
    c = corpus.searchable_or_plain(files).where(paths.basename(F.col("rel")) == "go.mod")
    name = F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1)
    return c.select("ws", F.regexp_replace(paths.dirname(F.col("rel")), r"^\.$", "").alias("dir"), name.alias("module")).where("module <> ''")


def module_kind(files: DataFrame) -> DataFrame:
    """(ws, rel, kind) of script files: by extension, else by the type of the nearest package.json, else ambiguous."""
    ext = ext_of(F.col("rel"))
    scripts = files.where(ext.isin(SCRIPT_EXT)).select("ws", "rel").distinct()
    m = corpus.content(files).where(paths.basename(F.col("rel")) == "package.json")
    types = m.select("ws", F.regexp_replace(paths.dirname(F.col("rel")), r"^\.$", "").alias("dir"), F.coalesce(F.get_json_object("content", "$.type"), F.lit("commonjs")).alias("type"))
    near = scripts.select("ws", "rel", F.explode(ancestors(F.col("rel"))).alias("dir")).join(types, ["ws", "dir"]).groupBy("ws", "rel").agg(F.max_by("type", F.length("dir")).alias("type"))
    kind = F.when(ext.isin(".mjs", ".mts"), "module").when(ext.isin(".cjs", ".cts"), "commonjs").otherwise(F.coalesce("type", F.lit("ambiguous")))
    return scripts.join(near, ["ws", "rel"], "left").select("ws", "rel", kind.alias("kind"))


FAMILIES = ("script", "python", "java", "rust", "go", "php", "include", "csharp")


def edges(files: DataFrame, configs: DataFrame | None = None, modules: DataFrame | None = None, families: tuple[str, ...] = FAMILIES, psr4: DataFrame | None = None) -> DataFrame:
    """(ws, rel, ln, spec, to_rel, reexport, names) of every import that resolves. Settings that are not given are read from the
    tsconfig.json, go.mod and composer.json of the corpus."""
    # the resolvers all read the statements, so these are read from content once
    st = materialise(statements(files), "imports")
    names = files.select("ws", "rel")
    configs = configs_of(files) if configs is None else configs
    modules = go_modules_of(files) if modules is None else modules
    psr4 = psr4_of(files) if psr4 is None else psr4
    make = {
        "script": lambda: resolve_script(st, names, configs), "python": lambda: resolve_python(st, names), "java": lambda: resolve_java(st, files), "rust": lambda: resolve_rust(st, names),
        "go": lambda: resolve_go(st, names, modules), "php": lambda: resolve_php(st.where("family = 'php'"), names, psr4), "include": lambda: resolve_include(st.where("family = 'include'"), names),
        "csharp": lambda: resolve_csharp(st, files),
    }
    there = {r["family"] for r in st.select("family").distinct().collect()}  # one row a family
    out = spark_empty = files.sparkSession.createDataFrame([], "ws string, rel string, ln int, spec string, to_rel string")
    for f in families:
        if f in there:
            out = make[f]() if out is spark_empty else out.unionByName(make[f]())
    return out.distinct().join(st.select(*KEYS, "reexport", "names").dropDuplicates(KEYS), KEYS)


def importers(e: DataFrame) -> DataFrame:
    """(ws, target, file, line, via): direct ones, and through one re-export of the name (or of everything)."""
    direct = e.select("ws", F.col("to_rel").alias("target"), F.col("rel").alias("file"), F.col("ln").alias("line"), F.lit(None).cast("string").alias("via"), "names")
    hop = e.where("reexport").select("ws", F.col("rel").alias("via"), F.col("to_rel").alias("target"), F.col("names").alias("passed"))
    through = direct.where("via IS NULL").select("ws", F.col("target").alias("via"), "file", "line", "names").join(hop, ["ws", "via"])
    fits = (F.size("passed") == 0) | (F.size("names") == 0) | F.arrays_overlap("passed", "names")
    indirect = through.where(fits & (F.col("file") != F.col("target"))).select("ws", "target", "file", "line", "via")
    return direct.select("ws", "target", "file", "line", "via").unionByName(indirect).distinct()


# -- queries


def imports_table(spark: SparkSession, sf: str) -> DataFrame:
    return imports(table(spark, sf, "files"))


def imports_by_spec(spark: SparkSession, sf: str) -> DataFrame:
    i = imports(table(spark, sf, "files"))
    return i.groupBy("ws", "spec").agg(F.count("*").alias("n")).groupBy("spec").agg(F.sum("n").alias("imports"), F.count("*").alias("workspaces"))


def import_statements(spark: SparkSession, sf: str) -> DataFrame:
    st = statements(table(spark, sf, "files"))
    return st.groupBy("ws", "family").agg(F.count("*").alias("statements"), F.countDistinct("rel").alias("files"))


def edges_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return edges(table(spark, sf, "files")).select("ws", "rel", "ln", "spec", "to_rel")


def generated_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus in which every customer is a file of one of nine languages that imports the one 45 keys on."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(F.concat(F.lit("w"), F.floor((k % 45) / 9)).alias("ws"), (k % 9).alias("f"), k.cast("string").alias("k"), (k + 45).cast("string").alias("t"))
    say = lambda template: F.replace(F.replace(F.lit(template), F.lit("@K"), F.col("k")), F.lit("@T"), F.col("t"))
    kinds = [
        ("src/c@K.js", "import {\n  a@T,\n  b as c,\n} from './c@T';\n"), ("src/c@K.ts", "// import x from './c1'\nexport * from './c@T';\n"), ("pkg/c@K.py", "\'\'\'\nimport pkg.c0\n\'\'\'\nimport os, pkg.c@T as d\n"),
        ("c@K/x.go", 'package a\n\nimport (\n\t"fmt"\n\tq "ex.org/m/c@T"\n)\n\nvar s = `\n"ex.org/m/c@K"\n`\n'), ("p/C@K.java", "package p;\nimport p.C@T;\nclass C@K {}\n"), ("rs/src/c@K.rs", "use crate::{c@T::{f, g}};\n"),
        ("lib/C@K.php", "<?php\nuse App\\{C@T, Other as O};\n"), ("inc/c@K.h", '#include <stdio.h>\n#include "c@T.h"\n'), ("cs/C@K.cs", "using N@T;\nnamespace N@K;\nclass X@K { }\n"),
    ]
    rel = content = F.lit(None).cast("string")
    for n, (r, t) in enumerate(kinds):
        rel, content = F.when(F.col("f") == n, say(r)).otherwise(rel), F.when(F.col("f") == n, say(t)).otherwise(content)
    own = c.select("ws", rel.alias("rel"), content.alias("content"))
    mods = c.where("f = 5").groupBy("ws").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("mod c"), "k", F.lit(";")))), "\n").alias("content")).select("ws", F.lit("rs/src/main.rs").alias("rel"), "content")
    each = c.select("ws").distinct()
    fixed = [each.select("ws", F.lit(r).alias("rel"), F.lit(t).alias("content")) for r, t in (("go.mod", "module ex.org/m\n"), ("composer.json", '{"autoload": {"psr-4": {"App\\\\": "lib/"}}}'))]
    out = own.unionByName(mods)
    for x in fixed:
        out = out.unionByName(x)
    return out.withColumn("indexed", F.lit(True))


def edges_generated(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(materialise(generated_corpus(spark, sf), "corpus"))
    return e.where("rel <> 'rs/src/main.rs'").select("ws", "rel", "ln", "spec", "to_rel", "reexport")


def importers_generated(spark: SparkSession, sf: str) -> DataFrame:
    """Who imports each script of the generated corpus, directly or through one re-export."""
    return importers(edges(materialise(generated_corpus(spark, sf), "corpus"), families=("script",)))


def java_class_map(spark: SparkSession, sf: str) -> DataFrame:
    return java_classes(table(spark, sf, "files"))


def import_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """For each relative script import the directory it points into and how many files stand there."""
    files = table(spark, sf, "files")
    i = imports(files).where(F.col("spec").startswith("./")).select("ws", "rel", "spec", "line", paths.dirname(_beside(F.col("rel"), F.col("spec"))).alias("dir"))
    there = corpus.file_rows(files).groupBy("ws", paths.dirname(F.col("rel")).alias("dir")).agg(F.count("*").alias("files"))
    return i.join(there, ["ws", "dir"], "left").select("ws", "rel", "spec", "line", "dir", F.coalesce("files", F.lit(0)).alias("files"))


def module_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return module_kind(table(spark, sf, "files")).groupBy("ws", "kind").agg(F.count("*").alias("files"))


QUERIES = {f.__name__: f for f in (module_kinds, imports_table, imports_by_spec, import_statements, edges_resolved, edges_generated, importers_generated, java_class_map, import_candidates)}
_I = "I AS (SELECT DISTINCT ws, rel, i.spec AS spec, i.line AS line, i.kind AS kind FROM (SELECT ws, rel, unnest(imports) AS i FROM files))"
_REL = "CASE f WHEN 0 THEN 'src/c' || {k} || '.js' WHEN 1 THEN 'src/c' || {k} || '.ts' WHEN 2 THEN 'pkg/c' || {k} || '.py' WHEN 3 THEN 'c' || {k} || '/x.go' WHEN 4 THEN 'p/C' || {k} || '.java' WHEN 5 THEN 'rs/src/c' || {k} || '.rs' WHEN 6 THEN 'lib/C' || {k} || '.php' WHEN 7 THEN 'inc/c' || {k} || '.h' ELSE 'cs/C' || {k} || '.cs' END"
_G = f"WITH c AS (SELECT 'w' || ((c_custkey % 45) // 9) AS ws, c_custkey % 9 AS f, c_custkey AS k, c_custkey + 45 AS t FROM customer), G AS (SELECT a.ws, a.f, a.t, {_REL.format(k='a.k').replace('CASE f', 'CASE a.f')} AS rel, {_REL.format(k='a.t').replace('CASE f', 'CASE a.f')} AS to_rel FROM c a JOIN c b ON a.t = b.k)"
ORACLE = {
    "module_kinds": "SELECT ws, CASE WHEN rel LIKE '%.mjs' THEN 'module' ELSE 'ambiguous' END AS kind, count(DISTINCT rel) AS files FROM files WHERE regexp_matches(rel, '\\.(m?js|ts)$') GROUP BY 1, 2",
    "imports_table": f"WITH {_I} SELECT * FROM I",
    "imports_by_spec": f"WITH {_I} SELECT spec, count(*) AS imports, count(DISTINCT ws) AS workspaces FROM I GROUP BY spec",
    "java_class_map": f"""WITH {corpus.SEARCHABLE_SQL}, J AS (SELECT ws, rel, content, regexp_extract(content, '(?m)^\\s*package\\s+([\\w.]+)\\s*;', 1) AS pkg FROM C WHERE rel LIKE '%.java'),
 N AS (SELECT ws, rel, pkg, unnest(list_distinct(list_concat([regexp_extract(rel, '([^/]+)\\.java$', 1)], regexp_extract_all(content, '(?m)^(?:(?:public|final|abstract)\\s+)*(?:class|interface|enum|record)\\s+(\\w+)', 1)))) AS name FROM J)
 SELECT DISTINCT ws, rel AS to_rel, pkg, CASE WHEN pkg = '' THEN name ELSE pkg || '.' || name END AS fqcn FROM N""",
    "import_candidates": f"""WITH {_I}, {corpus.FILES_SQL}, D AS (SELECT ws, dir, count(*) AS files FROM F GROUP BY ws, dir),
 X AS (SELECT ws, rel, spec, line, CASE WHEN rel LIKE '%/%' THEN regexp_extract(rel, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir FROM I WHERE spec LIKE './%')
 SELECT X.ws, X.rel, X.spec, X.line, X.dir, coalesce(D.files, 0) AS files FROM X LEFT JOIN D ON X.ws = D.ws AND X.dir = D.dir""",
    "import_statements": f"""WITH {corpus.SEARCHABLE_SQL}, L AS (SELECT ws, rel, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM C WHERE regexp_matches(rel, '\\.(m?js|ts|py|go|java|rs)$')),
 S AS (SELECT ws, rel, ln, CASE WHEN rel LIKE '%.py' THEN 'python' WHEN rel LIKE '%.go' THEN 'go' WHEN rel LIKE '%.java' THEN 'java' WHEN rel LIKE '%.rs' THEN 'rust' ELSE 'script' END AS family, line FROM L),
 M AS (SELECT ws, rel, ln, family, CASE family WHEN 'python' THEN nullif(concat(regexp_extract(line, '^[ \\t]*from[ \\t]+(\\.*[\\w.]*)[ \\t]+import\\b', 1), regexp_extract(line, '^[ \\t]*import[ \\t]+([\\w.]+)', 1)), '')
  WHEN 'go' THEN nullif(regexp_extract(line, '^(?:import[ \\t]+|\\t)"([^"]+)"\\r?$', 1), '') WHEN 'java' THEN nullif(regexp_extract(line, '^[ \\t]*import\\s+(?:static\\s+)?([\\w.]+(?:\\.\\*)?)\\s*;', 1), '')
  WHEN 'rust' THEN nullif(regexp_extract(line, '^[ \\t]*(?:pub\\s+)?(?:use|mod)\\s+([\\w:]+)', 1), '') ELSE nullif(regexp_extract(line, '^[ \\t]*(?:import|export)\\b[^''"]*\\bfrom\\s*[''"]([^''"]+)[''"]|\\brequire\\([''"]([^''"]+)[''"]\\)', 1)
  || regexp_extract(line, '\\brequire\\([''"]([^''"]+)[''"]\\)', 1) || regexp_extract(line, '^[ \\t]*import\\s*[''"]([^''"]+)[''"]', 1), '') END AS spec FROM S)
 SELECT ws, family, count(*) AS statements, count(DISTINCT rel) AS files FROM (SELECT DISTINCT * FROM M WHERE spec IS NOT NULL) GROUP BY ws, family""".replace("\\\\", "\\"),
    "edges_generated": f"""{_G} SELECT ws, rel, CAST(CASE f WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 0 THEN 1 WHEN 5 THEN 1 WHEN 8 THEN 1 ELSE 2 END AS INTEGER) AS ln,
 CASE f WHEN 0 THEN './c' || t WHEN 1 THEN './c' || t WHEN 2 THEN 'pkg.c' || t WHEN 3 THEN 'ex.org/m/c' || t WHEN 4 THEN 'p.C' || t WHEN 5 THEN 'crate::c' || t || '::' || x WHEN 6 THEN 'App\\C' || t WHEN 7 THEN 'c' || t || '.h' ELSE 'N' || t END AS spec,
 to_rel, f = 1 AS reexport FROM G, (VALUES ('f'), ('g')) v(x) WHERE f = 5 OR x = 'f'""",
    "importers_generated": f"""{_G} SELECT ws, to_rel AS target, rel AS file, CAST(f + 1 AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS via FROM G WHERE f < 2
 UNION ALL SELECT a.ws, b.to_rel, a.rel, CAST(2 AS INTEGER), b.rel FROM G a JOIN G b ON a.ws = b.ws AND a.to_rel = b.rel WHERE a.f = 1""",
}
