from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.functions import match
from corpuscle.operators import grep
from corpuscle.sources.workspace import from_map

FILES = {
    "src/app.js": "const Needle = 1;\nfunction needle() {}\nneedle(); Needle;\n// end",
    "src/app.test.js": "needle\n",
    "docs/notes.md": "a needle here\r\nand none\r\n",
    ".env": "needle=1\n",
    "dist/bundle.js": "other\n",
}


def test_counts_and_tally(spark):
    f = from_map(spark, FILES)
    hits = grep.matching_lines(f, match.compile_matcher("needle"))
    assert hits.count() == 5  # never the secret file
    t = {r["text"]: (r["count"], r["lines"], r["files"]) for r in grep.tally(f, match.compile_matcher("needle", case=True)).collect()}
    assert t == {"needle": (4, 4, 3)}
    assert grep.tally(f, match.compile_matcher("x*", regex=True)).count() == 0 or all(r["text"] for r in grep.tally(f, match.compile_matcher("x*", regex=True)).collect())


def test_context_has_no_phantom_line(spark):
    f = from_map(spark, FILES)
    rows = grep.with_context(f, match.compile_matcher("and none"), 2, 2).collect()
    assert [(list(r["before"]), list(r["after"])) for r in rows] == [(["a needle here"], [])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 7), st.integers(1, 4))
def test_pages_concatenate(counts, most, files):
    named = [(f"f{i:02d}", n) for i, n in enumerate(counts)]
    seen = {}
    for page in range(1, 200):
        w = grep.assign_pages(named, page, most, files, 10**9)
        if not w:
            break
        assert len(w) <= files and sum(n for _, n in w.values()) <= most
        for rel, (a, n) in w.items():
            assert seen.get(rel, 0) == a
            seen[rel] = a + n
    assert seen == dict(named)


def test_a_capped_file_is_passed_over():
    assert grep.assign_pages([("a", 5), ("b", 1)], 1, 10, 10, 2) == {"a": (0, 2), "b": (0, 1)}
    assert grep.assign_pages([("a", 5), ("b", 1)], 2, 10, 10, 2) == {}


def test_page_totals_are_exact(spark):
    f = from_map(spark, {f"f{i}.txt": "x word\n" * (i + 1) for i in range(6)})
    rows, page = [], 1
    while page:
        p = grep.grep_page(f, "memory", match.compile_matcher("word"), page, max_matches=4, max_files=3)
        assert (p.total, p.files) == (21, 6)
        rows += [(r["rel"], r["ln"]) for r in p.rows.collect()]
        page = p.next
    assert len(rows) == len(set(rows)) == 21


def test_references(spark):
    from corpuscle.operators import extract

    f = from_map(spark, {"util.mjs": "export function helper() { return 1; }\n", "index.mjs": "import { helper } from './util.mjs';\nfunction run() { return helper(); }\n", "notes.mjs": "export const notes = 'helper';\n"})
    s = extract.extract_files(f)
    got = {(r["rel"], r["ln"]): (r["label"], r["call"], r["owner"]) for r in grep.references(f, s, "helper").collect()}
    assert got == {("index.mjs", 1): ("imported", False, "(top level)"), ("index.mjs", 2): ("imported", True, "run"), ("notes.mjs", 1): ("textual", False, "notes")}


def test_pages_of_a_file_that_goes_on_alone():
    rows = list(grep.page_rows([("a", 3), ("b", 12), ("c", 1)], 5, 10, 100))
    assert rows == [(1, "a", 0, 3), (1, "b", 0, 2), (2, "b", 2, 5), (3, "b", 7, 5), (4, "c", 0, 1)]
    assert list(grep.page_rows([("a", 3), ("b", 12), ("c", 1)], 5, 10, 4)) == [(1, "a", 0, 3), (1, "b", 0, 2), (2, "b", 2, 4), (2, "c", 0, 1)]


def test_columns_with_back_references_and_escaped_names(spark):
    df = spark.createDataFrame([("foo bar",), ("😀 oo",), ("oo",)], "line string")
    m = match.compile_matcher(r"(o)\1", regex=True)
    assert [r[0] for r in df.select(m.column(df.line)).collect()] == [2, 3, 1]
    from corpuscle.operators import extract

    f = from_map(spark, {"a.js": "foo$bar(1)\nfoo.bar(2)\n"})
    assert [(r["ln"], r["call"]) for r in grep.references(f, extract.extract_files(f), "foo$bar").collect()] == [(1, True)]


def test_running_totals_over_a_group_of_any_size(spark):
    from corpuscle import tools
    from corpuscle.operators import ordered

    rows = [("hot", f"{i:04d}", i % 3) for i in range(900)] + [(None, "a", 1), (None, "b", None), ("x", "a", 5)]
    df = spark.createDataFrame(rows, "g string, k string, v int")
    got = {(r["g"], r["k"]): r["before"] for r in ordered.before(df, ["g"], ["k"], df.v).collect()}
    assert len(got) == 903 and got[(None, "b")] == 1 and got[("x", "a")] == 0
    assert all(got[("hot", f"{i:04d}")] == sum(j % 3 for j in range(i)) for i in (0, 1, 450, 899))
    assert ordered.before(df.limit(0), ["g"], ["k"]).count() == 0
    assert tools.within_budget(df, ["k", "g"], "k", budget=17).count() == 3
