"""Documents, chunks, extraction, validation and edits: no Spark needed."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.functions.text import sha1_text
from corpuscle.operators import documents as D
from corpuscle.operators import edit, extract, lookup, validate
from corpuscle.operators import vector as V

MD = "Fetched from https://example.test/guide\n\n# Guide\n\nintro\n## Install\n\nrun it\n\n## Usage\n```sh\n# no heading\n```\n\n# Appendix\nend"


def spans(rel, text, **kw):
    return [(k, a, b, lv) for k, _, lv, a, b in D.regions(rel, text, **kw)]


def test_regions():
    assert spans("g.md", MD) == [("section", 1, 1, 0), ("heading", 3, 13, 1), ("heading", 6, 8, 2), ("heading", 10, 13, 2), ("heading", 15, 16, 1)]
    assert [r[3:] for r in D.regions("run.txt", "\n".join(f"step {i}" for i in range(450)))] == [(1, 200), (201, 400), (401, 450)]
    assert D.regions("n.txt", "First para\nstill first\n\nSecond para\n\n\nThird\n") == [("paragraph", "First para", 0, 1, 7)]
    assert [(r[1], *r[3:]) for r in D.regions("n.txt", "a\n\nb\n", 1)] == [("a", 1, 1), ("b", 3, 3)]
    assert [(r[0], r[1], *r[3:]) for r in D.regions("d.json", '{\n  "name": "x",\n  "versions": [\n    1,\n    2,\n    3\n  ],\n  "config": {\n    "a": 1\n  }\n}')] == [("member", "name", 2, 2), ("member", "versions", 3, 7), ("member", "config", 8, 10)]
    assert [r[1] for r in D.regions("a.json", '[\n {"x": 1},\n {"x": 2},\n {"x": 3}\n]')] == ["[0]–[2]"]
    assert [(r[0], r[1], *r[3:]) for r in D.regions("d.txt", "one\ntext\n\fsecond page\nmore\n\fthird\n")] == [("page", "page 1", 1, 2), ("page", "page 2", 3, 4), ("page", "page 3", 5, 5)]
    assert [(r[1], *r[3:]) for r in D.regions("p.html", "<p>x</p>\n<h1>Top <b>news</b></h1>\n<p>y</p>\n<h2>Sub</h2>\nz\n")] == [("<p>x</p>", 1, 1), ("Top news", 2, 5), ("Sub", 4, 5)]
    assert D.regions("x.js", "const a = 1;\n") is None and D.regions("x.txt", " \n") == []
    assert [r[3] for r in D.section_of(D.regions("g.md", MD), "## usage")] == [10]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab {}\n#\"x", max_size=300).map(lambda s: s * 40), st.sampled_from(["a.js", "a.md", "a.json", "a.txt", "a.py", "a.html"]))
def test_chunks_cover_once(text, rel):
    c = D.chunks(rel, text)
    assert "".join(text[a:b] for a, b in c) == text and all(0 < b - a <= D.CHUNK_MAX for a, b in c)
    assert not text or c


def test_extraction_by_language():
    def got(rel, text):
        s, reason = extract.extract(rel, text, [])
        return reason, [(x.path, x.kind, x.line_start, x.line_end, x.exported) for x in s]

    assert got("a.py", '"""d"""\nMAX = 1\n@dec\nclass A:\n    """doc"""\n    def m(self):\n        def inner():\n            pass\n\ndef _p():\n    pass\n')[1] == [
        ("MAX", "constant", 2, 2, True), ("A", "class", 4, 8, True), ("A.m", "method", 6, 8, False), ("A.m.inner", "function", 7, 8, False), ("_p", "function", 10, 11, False)]
    js = "// says\nexport function f(a) {\n  return '}';\n}\nclass B {\n  /** d */\n  m(x) { return `}`; }\n}\nconst g = async (a) => {\n};\n"
    assert got("a.js", js)[1] == [("f", "function", 2, 4, True), ("B", "class", 5, 8, False), ("B.m", "method", 7, 7, False), ("g", "function", 9, 10, False)]
    assert extract.extract("a.js", js, [])[0][0].doc == "says" and extract.extract("a.js", js, [])[0][0].signature == "export function f(a)"
    assert got("a.go", "package a\n\n// T is\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Do() int {\n\treturn 1\n}\n")[1] == [("T", "class", 4, 6, True), ("Do", "method", 8, 10, True)]
    assert got("a.rs", "pub struct S { a: u8 }\nimpl S {\n    pub fn f<'a>(&'a self) -> u8 { b'}' }\n}\n")[1][1][:2] == ("f", "function")
    assert [x[:2] for x in got("A.java", "public class A {\n  @Override\n  public int f(int a) throws E {\n    return 1;\n  }\n}\n")[1]] == [("A", "class"), ("A.f", "method")]
    assert got("a.py", "def f(:\n")[0].startswith("syntax:")
    assert got("a.bin", "x") == (None, [])


def test_extension_registry():
    extract.register_extractor("t", lambda rel: rel.endswith(".tst"), lambda rel, text: [extract.Symbol("x", "function", 0, 1, 1, 1, "x", "", True, "x")], "2")
    extract.register_extractor("broken", lambda rel: 1 // 0, lambda rel, text: [], "1")
    try:
        assert extract.extract("a.tst", "y")[0][0].name == "x" and "t:2" in extract.analyzer_version()
        assert extract.extract("a.js", "")[1].startswith("extension:")
    finally:
        extract._REGISTRY.clear()


def test_diagnostics():
    assert validate.diagnose("a.py", "def f(:\n")[0][6] == 1
    assert validate.diagnose("a.js", "f(')', /[(]/);\n") == []
    assert [(d[0], d[6]) for d in validate.diagnose("a.ts", "x;\nf((1);\n")] == [("syntax", 2)]
    assert [d[3] for d in validate.diagnose("a.c", "f((1);\n")] == ["( is never closed"]
    assert [validate.rgb_of(c) for c in ("#fff", "#0a0B0c80", "rgb(1, 2,3)", "red", None, "#12345")] == [(255, 255, 255), (10, 11, 12), (1, 2, 3), None, None, None]
    assert [m for _, m, _, _ in validate.template_balance("x = `<b><i>${a ? '<u>' : ''}</b></i>`")][:1] == ["</b> closes nothing that is open"]
    assert validate.template_balance("x = `<b>`; y = `<br><img src=\"a>b\"/><p>x</p>`; // `</i><b>`") == []


def test_edits(tmp_path):
    src = "def f():\r\n    return 1\r\n"
    (tmp_path / "a.py").write_bytes(src.encode())
    a, b = edit.anchor(src, "return 1")
    got = edit.edit_file(str(tmp_path), "a.py", [edit.Edit(a, b, "x = 2\n    return x")], sha1_text(src))
    assert got["outcome"] == "written" and (tmp_path / "a.py").read_bytes() == b"def f():\r\n    x = 2\r\n    return x\r\n"
    with pytest.raises(edit.EditRefused, match="stale"):
        edit.edit_file(str(tmp_path), "a.py", [edit.Edit(0, 0, "#")], sha1_text(src))
    now = (tmp_path / "a.py").read_bytes().decode()
    with pytest.raises(edit.EditRefused, match="new diagnostics"):
        edit.edit_file(str(tmp_path), "a.py", [edit.Edit(0, 3, "de")], sha1_text(now))
    with pytest.raises(edit.EditRefused, match="overlap"):
        edit.compose("abcdef", [edit.Edit(0, 3, "x"), edit.Edit(2, 4, "y")])
    with pytest.raises(edit.EditRefused, match="found 2 times"):
        edit.anchor("a\nb\na\nc", "a")
    p = str(tmp_path / "n")
    assert edit.write(p, b"1") == "missing" and edit.write(p, b"1", create=True) == "ok" and edit.write(p, b"2", create=True) == "exists"
    os.symlink(p, p + "l")
    assert edit.write(p + "l", b"3") == "symlink" and edit.write(p, b"3", expected="AB") == "stale"
    assert not [f for f in os.listdir(tmp_path) if "tmp" in f]


def test_limits_ranges_and_declarations():
    assert lookup.parse_range("a/b.js:12-30") == ("a/b.js", 12, 30) and lookup.parse_range("a.js#7") == ("a.js", 7, 7) and lookup.parse_range("a#b") is None
    assert (lookup.limit_of("find", None), lookup.limit_of("find", 0), lookup.limit_of("files", "x"), lookup.limit_of("refs", 0), lookup.limit_of("refs", 7)) == (20, 0, None, 40, 7)
    assert lookup.declared({"devDependencies": {"b": 1}, "dependencies": {"a": 1, "b": 2}}) == ["a", "b"]
    from corpuscle.operators import extract

    assert [s.name for s in extract.python("try:\n    def a(): pass\nexcept E:\n    def b(): pass\nmatch x:\n    case 1:\n        def c(): pass\n")] == ["a", "b", "c"]
    names, members, hops = lookup.members_of_declarations("export declare class W {\n  run(a: string): void;\n  size?: number;\n}\nexport { x as y } from './z';\nexport * from './w';\n")
    assert names == ["W", "y"] and members == ["W.run", "W.size"] and hops == ["./z", "./w"]


def test_identity():
    i = V.identity("openai", "http://x", "text-embed", 8)
    assert i == '["openai","http://x","text-embed",8]' and V.pipeline_name(i).startswith("code_text_embed_8_")
    e = V.bag_of_words(["one two three three", "", None])
    assert abs((e[0] ** 2).sum() - 1) < 1e-6 and not e[1].any()


def test_further_languages():
    def got(rel, text):
        return [(x.path, x.kind) for x in extract.extract(rel, text, [])[0]]

    assert got("a.php", "<?php\nfinal class A {\n  const X = 1;\n  public function f(int $a): int { return 1; }\n}\nfunction g() { }\n") == [("A", "class"), ("A.X", "constant"), ("A.f", "method"), ("g", "function")]
    assert got("a.cs", "namespace N {\n  public class A {\n    public async Task<List<int>> F(int a) { return null; }\n  }\n}\n") == [("N", "module"), ("N.A", "class"), ("N.A.F", "method")]
    assert got("a.c", "#define MAX 3\nstruct S { int a; };\nstatic int f(int a, char *b)\n{\n  return g(a);\n}\n") == [("MAX", "constant"), ("S", "class"), ("f", "function")]
    assert got("a.cpp", "namespace n {\nint a;\n}\nint A::f(const std::string& s) const {\n  if (x) { }\n}\n") == [("n", "module"), ("A::f", "function")]


def test_render_stops_at_the_budget():
    from corpuscle import tools

    text = tools.render(range(100), lambda r: "x" * 9, 250, 50, 100)
    assert text.count("x" * 9) == 10 and text.endswith("250 in all; go on with offset 60")
