"""Syntax checkers: early errors of scripts, depth, and lines of errors."""

import time

import pytest

from corpuscle.syntax import script, syntax_errors

VALID = [
    "function f(){ for(;;){ break; } while(1) continue; a: { break a } switch(x){case 1: break} }", "async function f(){ await x; const g = async () => await y; for await (const z of w) {} }", "await x",
    "class A extends B { m(){ super.x(); const f = () => super.y(); } constructor(){super()} static { super.z } p = super.q }", "({m(){ super.x }, get a(){return super.b}})", "let a=1; { let a=2; } for (let a of b) {} for (let a of b) {}",
    "var a; var a; function a(){}", "let x = class a {}; let y = class a {}", "const f = async x => { await x }; f(async (a) => await a)", "if (a) { let b } else { let b }", "x = { f() { let a }, g() { let a } }", "function f(){ var await; await = 1 }",
]
INVALID = [
    "function f(){ await x; }", "break;", "continue;", "if (a) break", "function f(){ super.x(); }", "super.x", "let a=1; let a=2;", "const f = () => { await x }", "class A { m(){ await x } }", "for(;;){ function g(){ break } }", "let a; var a;",
    "class A{} let A = 1", "x: for(;;){ (() => { break x })() }", "async function f(){ function g(){ await x } }", "switch(x){ case 1: continue }",
]


def test_early_errors():
    for _ in range(2):  # what is remembered of the first round does not change the second
        for text in VALID:
            assert syntax_errors("javascript", text) == [], text
        for text in INVALID:
            assert syntax_errors("javascript", text), text


@pytest.mark.parametrize("lang, head, tail", [("javascript", "x=", ""), ("typescript", "x=", ""), ("java", "class A { int x = ", "; }"), ("python", "x=", "\n"), ("go", "package a\nvar x = ", "\n"), ("rust", "const X: u8 = ", ";")])
def test_deep_brackets_take_linear_time(lang, head, tail):
    begun = time.process_time()
    assert syntax_errors(lang, head + "(" * 30000 + "1" + ")" * 30000 + tail) == []
    assert time.process_time() - begun < 10


def test_lines_of_many_errors():
    text = "".join(f"a{k} b\n;\n" for k in range(3000))
    assert [n for n, _ in syntax_errors("javascript", text)][:3] == [1, 3, 5]
    with pytest.raises(KeyError):
        syntax_errors("cobol", "")


@pytest.mark.parametrize("around", ["declare namespace N {\n%s\n}\n", "declare module 'm' {\n%s\n}\n", "declare global {\n%s\n}\n"])
def test_ambient_declarations_are_not_remembered(monkeypatch, around):
    monkeypatch.setattr(script, "SEEN", {False: set(), True: set()})
    assert not syntax_errors("typescript", around % "const a: number;")
    assert syntax_errors("typescript", "const limit: number;\n")
