from corpuscle.operators import edges as E
from corpuscle.sources.workspace import from_map


def imp(spark, files, target, family, **kw):
    e = E.edges(from_map(spark, files).cache(), families=(family,), **kw)
    return sorted((r["file"], r["via"]) for r in E.importers(e).where(E.F.col("target") == target).collect())


def test_script_barrel_and_package_relative_python(spark):
    files = {
        "util.mjs": "export function helper() { return 1; }\n", "barrel.mjs": "export * from './util.mjs';\n", "index.mjs": "import { helper } from './barrel.mjs';\n", "unrelated.mjs": "// helper\n",
        "dir/index.ts": "export const x = 1;\n", "use.ts": "import { x } from './dir';\n",
        "pkg/__init__.py": "\n", "pkg/util.py": "def helper():\n    return 1\n", "pkg/main.py": "from .util import helper\n", "top.py": "import pkg.util\nfrom pkg import util\n",
    }
    e = E.edges(from_map(spark, files).cache(), families=("script", "python")).cache()
    got = {(r["rel"], r["spec"]): r["to_rel"] for r in e.collect()}
    assert got[("barrel.mjs", "./util.mjs")] == "util.mjs" and got[("use.ts", "./dir")] == "dir/index.ts"
    assert got[("pkg/main.py", ".util")] == "pkg/util.py" and got[("top.py", "pkg.util")] == "pkg/util.py"
    i = sorted((r["file"], r["via"] or "") for r in E.importers(e).where("target = 'util.mjs'").collect())
    assert i == [("barrel.mjs", ""), ("index.mjs", "barrel.mjs")]


def test_aliases_of_the_nearest_config(spark):
    files = {"src/app/widget.ts": "export const a = 1;\n", "src/index.ts": "import { a } from '@app/widget';\n"}
    configs = spark.createDataFrame([("memory", "", 0, "@app/", "", "src/app/*")], "ws string, dir string, pos int, prefix string, suffix string, target string")
    assert imp(spark, files, "src/app/widget.ts", "script", configs=configs) == [("src/index.ts", None)]


def test_go_longest_module(spark):
    files = {"a/x.go": "package a\n", "a/x_test.go": "package a\n", "main.go": 'package main\n\nimport (\n\t"ex.org/m/a"\n)\n'}
    modules = spark.createDataFrame([("memory", "", "ex.org/m"), ("memory", "zzz", "ex.org")], "ws string, dir string, module string")
    assert imp(spark, files, "a/x.go", "go", modules=modules) == [("main.go", None)]
    assert imp(spark, files, "a/x_test.go", "go", modules=modules) == []


def test_rust_module_tree(spark):
    files = {"src/main.rs": "mod a;\nuse crate::a::b::thing;\n", "src/a/mod.rs": "pub mod b;\n", "src/a/b.rs": "pub fn thing() {}\n", "src/lost.rs": "use crate::a::b;\n"}
    assert imp(spark, files, "src/a/b.rs", "rust") == [("src/a/mod.rs", None), ("src/main.rs", None)]  # lost.rs is in no tree
    assert imp(spark, files, "src/a/mod.rs", "rust") == [("src/main.rs", None)]


def test_java_forms(spark):
    files = {
        "p/A.java": "package p;\npublic class A { public static int f; }\n", "p/B.java": "package p;\nclass B {}\n",
        "q/One.java": "package q;\nimport p.A;\n", "q/Star.java": "package q;\nimport p.*;\n", "q/Stat.java": "package q;\nimport static p.A.f;\n",
    }
    assert imp(spark, files, "p/A.java", "java") == [("q/One.java", None), ("q/Star.java", None), ("q/Stat.java", None)]
    assert imp(spark, files, "p/B.java", "java") == [("q/Star.java", None)]


def test_php_and_includes(spark):
    f = from_map(spark, {"src/App/Model/User.php": "<?php\n", "include/lib/x.h": "\n", "src/x.h": "\n", "src/a.c": "\n"})
    k = "ws string, rel string, ln int, spec string"
    php = spark.createDataFrame([("memory", "index.php", 1, "App\\Model\\User")], k)
    psr4 = spark.createDataFrame([("memory", "App\\", "src/App/"), ("memory", "App\\Model\\", "nowhere")], "ws string, prefix string, dir string")
    assert E.resolve_php(php, f, psr4.where("dir <> 'nowhere'")).first()["to_rel"] == "src/App/Model/User.php"
    assert E.resolve_php(php, f, psr4).count() == 0  # the longest prefix decides
    inc = spark.createDataFrame([("memory", "src/a.c", 1, "x.h", False), ("memory", "src/a.c", 2, "lib/x.h", True), ("memory", "src/a.c", 3, "x.h", True)], k + ", angled boolean")
    assert sorted((r["ln"], r["to_rel"]) for r in E.resolve_include(inc, f).collect()) == [(1, "src/x.h"), (2, "include/lib/x.h")]


def test_configs_modules_and_kinds_from_files(spark):
    files = {
        "tsconfig.json": '{ // c\n"compilerOptions": {"baseUrl": "./src", "paths": {"@app/*": ["app/*"],}}}', "pkg/a/tsconfig.json": '{"extends": "../../tsconfig.json"}',
        "src/app/widget.ts": "export const a = 1;\n", "src/index.ts": "import { a } from '@app/widget';\n", "pkg/a/use.ts": "import { a } from '@app/widget';\n",
        "x/package.json": '{"type": "module"}', "x/y/m.js": "1\n", "z.js": "1\n", "w.cjs": "1\n",
    }
    f = from_map(spark, files).cache()
    c = E.configs_of(f).cache()
    e = E.edges(f, configs=c, families=("script",))
    assert {r["rel"]: r["to_rel"] for r in e.collect()} == {"src/index.ts": "src/app/widget.ts", "pkg/a/use.ts": "src/app/widget.ts"}
    k = {r["rel"]: r["kind"] for r in E.module_kind(f).collect()}
    assert (k["x/y/m.js"], k["z.js"], k["w.cjs"]) == ("module", "ambiguous", "commonjs")
    m = spark.createDataFrame([("w", "svc/go.mod", "module ex.org/m\n\ngo 1.22\n", True)], "ws string, rel string, content string, indexed boolean")
    assert [tuple(r) for r in E.go_modules_of(m).collect()] == [("w", "svc", "ex.org/m")]


def test_statements_over_several_lines():
    st = lambda fam, source: [(ln, spec, names) for ln, spec, _, names, *_ in E.statements_of(fam, source)]
    assert st("script", "import d, {\n a,\n b as c,\n} from './b'\n// import x from './no'\nconst s = `\nimport y from './no'\n`;\nexport { e } from './f';\nimport './g';\nconst h = require('./i');\nimport type { T } from \"./t\";\n") == [
        (1, "./b", ["a", "b", "default"]), (9, "./f", ["e"]), (10, "./g", []), (11, "./i", []), (12, "./t", ["T"]),
    ]
    assert st("python", '"""\nimport no\n"""\nimport a, b.c as d\nfrom .x import (\n    e,\n    f as g,  # why\n)\nfrom y import h, \\\n    i\nfrom z import *\n') == [(4, "a", []), (4, "b.c", []), (5, ".x", ["e", "f"]), (9, "y", ["h", "i"]), (11, "z", [])]
    assert st("go", 'package a\nimport q "one"\nimport (\n\t"two"\n\t_ `three`\n)\nvar x = []string{\n\t"four",\n}\nconst y = "five"\n') == [(2, "one", []), (4, "two", []), (5, "three", [])]
    assert st("rust", "use crate::a::{b, c::{d as e, self}, f::*};\npub use self::g;\nmod h;\n// use no::x;\n") == [(1, "crate::a::b", []), (1, "crate::a::c", []), (1, "crate::a::c::d", []), (1, "crate::a::f::*", []), (2, "self::g", []), (3, "h", [])]
    assert st("php", "<?php\nuse A\\B, C\\D as E;\nuse F\\{G, H\\I};\nuse function J\\k;\n") == [(2, "A\\B", []), (2, "C\\D", []), (3, "F\\G", []), (3, "F\\H\\I", []), (4, "J\\k", [])]
    assert st("csharp", "using A.B;\nusing static C.D;\nusing E = F.G;\nusing (var x = y) {}\n") == [(1, "A.B", []), (2, "C.D", []), (3, "F.G", [])]
    assert st("include", '#include <a/b.h>\n# include "c.h"\n/* #include "no.h" */\n') == [(1, "a/b.h", []), (2, "c.h", [])]


def test_all_families_from_their_settings(spark):
    files = {
        "composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/App/"}}}', "src/App/Model/User.php": "<?php\n", "web/index.php": "<?php\nuse App\\Model\\User;\n",
        "a/One.cs": "namespace N.M;\npublic class One { }\n", "a/Two.cs": "namespace N.M {\n class Two { }\n}\n", "b/Use.cs": "using N.M;\nusing T = N.M.Two;\nusing System;\n", "include/x/y.h": "\n", "c/z.c": "#include <x/y.h>\n#include <stdio.h>\n",
        "lib/deep/pkg/__init__.py": "\n", "lib/deep/pkg/mod.py": "\n", "main.py": "import pkg.mod\nfrom pkg import mod, other\n",
    }
    e = E.edges(from_map(spark, files).cache())
    assert sorted((r["rel"], r["ln"], r["to_rel"]) for r in e.collect()) == [
        ("b/Use.cs", 1, "a/One.cs"), ("b/Use.cs", 1, "a/Two.cs"), ("b/Use.cs", 2, "a/Two.cs"), ("c/z.c", 1, "include/x/y.h"), ("main.py", 1, "lib/deep/pkg/mod.py"), ("main.py", 2, "lib/deep/pkg/mod.py"), ("web/index.php", 2, "src/App/Model/User.php"),
    ]
    assert E.edges(from_map(spark, {"a.txt": "x"})).count() == 0
