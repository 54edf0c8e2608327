import pytest
from pyspark.sql import functions as F

from corpuscle.functions import match, paths, text


def keep(spark, rels, col):
    df = spark.createDataFrame([(r,) for r in rels], "rel string")
    return [r["rel"] for r in df.where(col(F.col("rel"))).collect()]


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("*.js", ["a.js", "x/y/a.js"], ["a.jsx", "js"]),
        ("src/*.js", ["src/a.js"], ["lib/src/a.js", "src/x/a.js"]),
        ("src/**/a.js", ["src/a.js", "src/x/y/a.js"], ["a.js"]),
        ("lib/**", ["lib/a", "lib/x/y"], ["libs/a"]),
        ("test", ["test/a.js", "x/test/b"], ["tests/a"]),
        ("*.{js,ts}", ["a.js", "b.ts"], ["c.py"]),
        ("a?c[!x]", ["abcd"], ["abcx", "a/cd"]),
        (r"a\*b", ["a*b"], ["axb"]),
    ],
)
def test_globs(spark, glob, yes, no):
    m = paths.PathMatcher(include=(glob,))
    assert keep(spark, yes + no, m.column) == yes


def test_path_matcher_roots_are_no_prefixes(spark):
    m = paths.PathMatcher(roots=("lib", "lib/inner"), exclude=("*.md",))
    assert keep(spark, ["lib/a.js", "libs/a.js", "lib/x.md", "lib"], m.column) == ["lib/a.js", "lib"]


def test_walk_filter_and_secrets(spark):
    ignore = "*.log\n/session-state/\n!keep.log\ncache*/\n"
    rels = ["a.log", "lib/math.js", "session-state/k.json", "node_modules/w/i.js", ".cache/b.js", "x/cache1/y", "dist.js", "package.json"]
    assert keep(spark, rels, lambda c: paths.walk_filter(c, ignore)) == ["lib/math.js", "dist.js", "package.json"]
    assert keep(spark, [".env", ".env.local", "env.js", "a/.npmrc", "id_rsa", "id_rsa.pub", "secrets.yml", "x.pem", "monkey.js"], paths.is_secret) == [".env", ".env.local", "a/.npmrc", "id_rsa", "id_rsa.pub", "secrets.yml", "x.pem"]


def test_norm_and_names(spark):
    rows = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../x",), ("./a//b",)], "p string")
    assert [r[0] for r in rows.select(paths.norm(F.col("p"))).collect()] == ["a/c", None, None, "a/b"]
    d = spark.createDataFrame([("a.js",), ("/x",), ("a/b/c",)], "p string")
    assert [r[0] for r in d.select(paths.dirname(F.col("p"))).collect()] == [".", "/", "a/b"]
    assert keep(spark, ["a/b", "../a", "/a", "a/../b", "c:x", "a..b"], paths.path_ok) == ["a/b", "a..b"]


def test_matchers(spark):
    lines = ["Foo bar", "foo(BAR)", "été", "ÉTÉ", "a.b", "axb"]
    hit = lambda m: keep(spark, lines, m.test)
    assert hit(match.compile_matcher("foo")) == ["Foo bar", "foo(BAR)"]
    assert hit(match.compile_matcher("Foo", case="smart")) == ["Foo bar"]
    assert hit(match.compile_matcher("été")) == ["été", "ÉTÉ"]
    assert hit(match.compile_matcher("a.b", case=True)) == ["a.b"]
    assert hit(match.compile_matcher("a.b", regex=True)) == ["a.b", "axb"]
    assert match.compile_matcher("abc", regex=True).literal == "abc"
    for bad in ("", "a\nb"):
        with pytest.raises(match.BadPattern):
            match.compile_matcher(bad)
    with pytest.raises(match.BadPattern):
        match.compile_matcher("(", regex=True)


def test_regex_dialect():
    assert match.script_regex("[^]x[]") == r"[\s\S]x(?!)"
    assert match.script_regex(r"\u{1F600}a{b") == r"\x{1F600}a\{b"
    assert match.script_regex("a{2,3}") == "a{2,3}"


def test_terms():
    assert match.index_terms("(alpha beta") == ["alpha", "beta"]
    assert match.index_terms("alpha beta(") == ["beta"]
    assert match.index_terms(" th") == [] and match.index_terms(" the ") == []
    assert match.query_terms("How does the Parser_x work $y1?") == ["parser_x", "work", "$y1"]


def test_text_helpers():
    assert text.jsonc('{"a": "x // y", /* c */ "b": [1,2,],}') == {"a": "x // y", "b": [1, 2]}
    assert text.utf16("a😀b", 2) == 3
    at = text.Offsets("ab\r\ncd\n")
    assert at.line_col(4) == (2, 1) and at.offset(2, 2) == 5 and at.line_range(1, 1) == (0, 2)
    h = text.hunks("1\n2\n3\n4\n5\n", [(4, 5, "x\ny")], 1)
    assert h[0]["old"] == "2\n3\n4" and h[0]["new"] == "2\nx\ny\n4"


def test_lines_have_no_phantom(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None), (4, "x\n\n"), (5, "z")], "id int, content string")
    rows = [(r["id"], r["ln"], r["line"]) for r in text.with_lines(df).orderBy("id", "ln").collect()]
    assert rows == [(1, 1, "a"), (1, 2, "b"), (4, 1, "x"), (4, 2, ""), (5, 1, "z")]
