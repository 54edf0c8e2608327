"""Full-text search over the stored index, hits on files, and runs of the index."""

from corpuscle.operators import fulltext, search, sync
from corpuscle.operators.store import Store
from corpuscle.session import shared_dir
from corpuscle.sources.workspace import from_map

TEXTS = [(1, "red green red"), (2, "green blue"), (3, "reddish"), (4, None), (5, ""), (6, "the of")]


def test_the_index_answers_as_the_scan_does(spark):
    d = spark.createDataFrame(TEXTS, "id int, t string").where("t IS NOT NULL")
    index = fulltext.build(d, ["id"], "t", shared_dir(spark, "ft"), buckets=4)
    assert (index.texts, index.terms) == (5, 6)
    for terms, mode, prefix in ((["red"], "and", False), (["red", "green"], "and", False), (["red", "blue"], "or", False), (["red", "gr"], "and", True), (["zzz"], "or", False), ([], "and", False), (["red", "zzz"], "and", False)):
        a = sorted((r["id"], round(r["relevance"], 9)) for r in fulltext.search(index, terms, mode, prefix).collect())
        b = sorted((r["id"], round(r["relevance"], 9)) for r in search.bm25(d, "t", terms, mode, prefix).collect())
        assert a == b, terms
    plan = fulltext.search(index, ["red"])._jdf.queryExecution().toString()
    assert "postings" in plan and "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan
    empty = fulltext.build(d.limit(0), ["id"], "t", shared_dir(spark, "ft"))
    assert fulltext.search(empty, ["red"]).count() == 0


def test_terms_are_counted_in_the_row(spark):
    d = spark.createDataFrame(TEXTS, "id int, t string")
    got = {r["id"]: {x["term"]: x["tf"] for x in r["c"]} if r["c"] is not None else None for r in d.select("id", fulltext.counted_terms(d.t).alias("c")).collect()}
    assert got[1] == {"red": 2, "green": 1} and got[5] == {} and got[6] == {}


def test_a_file_is_found_by_its_path(spark):
    f = from_map(spark, {"lib/widget_cache.js": "export const x = 1;\n", "b.js": "// about the widget_cache here\n"})
    s = spark.createDataFrame([], "ws string, file string, path string, name string, kind string, line_start int, line_end int, ord int, doc string, signature string")
    got = {(r["file"], r["line"]) for r in search.find(f, s, "widget_cache").collect()}
    assert got == {("lib/widget_cache.js", None), ("b.js", 1)}
    assert search.find(f, s, "the").count() == 0


def test_sync_analyses_only_what_changed(spark):
    store = Store(spark, shared_dir(spark, "sync"))
    one = {"a.py": "import b\n\ndef f():\n    return 1\n", "b.py": "def g():\n    return 2\n", "c.md": "# t\n"}
    assert sync.sync(store, from_map(spark, one)) == {"new": 3}
    assert sync.sync(store, from_map(spark, one)).get("new") is None and store.current() == 0
    two = {**one, "b.py": "def h():\n    return 3\n", "d.py": "x = 1\n"}
    del two["c.md"]
    got = sync.sync(store, from_map(spark, two))
    assert {k: v for k, v in got.items() if k in ("new", "changed", "removed")} == {"new": 1, "changed": 1, "removed": 1}
    assert sorted(r["name"] for r in store.load("symbols").collect()) == ["f", "h"]
    assert sorted(r["rel"] for r in store.load("files").collect()) == ["a.py", "b.py", "d.py"]
    assert store.load("imports").count() == 1 and store.load("tokens").where("rel = 'c.md'").count() == 0 and store.load("tokens").where("term = 'g'").count() == 0
