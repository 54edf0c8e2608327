"""Operators over tables: scan states, store, vectors, reading, sources, streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import lookup, scan, store, vector
from corpuscle.session import shared_dir
from corpuscle.sources import workspace
from corpuscle.streaming import changes

LISTING = "ws string, rel string, size bigint, mtime double, hash string, gone boolean, seen_at timestamp"


def at(n):
    return dt.datetime(2031, 1, 1) + dt.timedelta(minutes=n)


def test_scan_states(spark):
    listings = spark.createDataFrame([("w", "new", 1, 1.0, "1", False, at(1)), ("w", "same", 1, 1.0, "0A", False, at(1)), ("w", "touch", 1, 9.0, "a", False, at(1)), ("w", "chg", 2, 9.0, "b", False, at(1)), ("w", "gone", None, None, None, True, at(2)), ("w", "nohash", 3, 1.0, None, False, at(1)), ("w", "absent", 1, 1.0, "1", True, at(1)), ("w", "old", 1, 1.0, "a", False, at(1))], LISTING)
    files = spark.createDataFrame([("w", r, 1, 1.0, "A", v) for r, v in (("same", "2"), ("touch", "2"), ("chg", "2"), ("gone", "2"), ("nohash", "2"), ("left", "2"), ("old", "1"))], "ws string, rel string, size bigint, mtime double, hash string, analyzer_version string")
    got = {r["rel"]: r["state"] for r in scan.diff(listings, files, version="2").collect()}
    assert got == {"new": "new", "same": "unchanged", "touch": "touched", "chg": "changed", "gone": "removed", "nohash": "changed", "left": "removed", "old": "stale"}


def test_generations(spark):
    s = store.Store(spark, shared_dir(spark, "s"))
    with pytest.raises(LookupError):
        s.load("files")
    df = spark.createDataFrame([("w", "a", 1), ("w", "b", 1)], "ws string, rel string, v int")
    assert s.save({"files": df}) == 0
    new = spark.createDataFrame([("w", "b", 2), ("w", "c", 2)], "ws string, rel string, v int")
    assert s.save({"other": df.limit(1)}) == 1  # the first table is carried on
    assert s.upsert("files", new, ["ws", "rel"]) == 2 and s.load("other").count() == 1
    assert sorted((r["rel"], r["v"]) for r in s.load("files").collect()) == [("a", 1), ("b", 2), ("c", 2)]
    assert s.load("files", 0).count() == 2
    far = spark.createDataFrame([("x", "z", 5)], "ws string, rel string, v int")
    s.upsert("files", far, ["ws", "rel"])
    assert s.remove("files", df.where("rel = 'a'"), ["ws", "rel"]) == 4
    assert sorted((r["rel"], r["v"]) for r in s.load("files").collect()) == [("b", 2), ("c", 2), ("z", 5)]
    assert s.change({"files": (None, df.limit(0), ["ws", "rel"])}) == 5 and s.load("files").count() == 3
    with pytest.raises(ValueError):
        s.save({"files": df.withColumn("content", F.lit("x"))})


def test_nearest_is_exact_and_the_index_recalls(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "vec_id bigint, embedding array<float>")
    q = df.where("vec_id % 20 = 0")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in vector.nearest(df, q, 5).collect():
        got.setdefault(r["q"], {})[r["rank"]] = r["key"]
    for i in range(0, 400, 20):
        want = np.argsort(-(u @ u[i]), kind="stable")[:5].tolist()
        assert [got[i][k] for k in range(1, 6)] == want
    c = vector.fit_centroids(df, 8)
    found = vector.indexed_nearest(vector.index_vectors(df, c), c, q, 5, 6).select("q", "key").collect()
    hit = sum(r["key"] in got[r["q"]].values() for r in found)
    assert hit / (20 * 5) >= 0.9
    assert vector.nearest(df, df.where("vec_id < 0"), 3).count() == 0


def test_reading(spark):
    f = workspace.from_map(spark, {"lib/math.js": "// adds\nfunction add(a) {\n  return a;\n}\n", "doc/guide.md": "# A\n\nx\n\n## B\n\ny\n"}).cache()
    from corpuscle.operators import extract

    s = extract.extract_files(f).cache()
    assert lookup.file_of(f, "MATH.js") is None and lookup.file_of(f, "LIB/math.js") == "lib/math.js" and lookup.file_of(f, "math.js") == "lib/math.js"
    assert lookup.read(f, s, "add")["text"].startswith("function add") and lookup.read(f, s, "guide.md#B")["line_start"] == 5
    assert lookup.read(f, s, "math.js:2-99")["line_end"] == 5
    with pytest.raises(ValueError, match="stale"):
        lookup.read_range(f, "lib/math.js", 1, 2, "00")
    with pytest.raises(LookupError, match="no symbol"):
        lookup.read(f, s, "math.js#nope")
    assert lookup.outline(f, s, "lib/math.js")[0] == "symbols" and lookup.outline(f, s, "doc/guide.md")[0] == "sections"


def test_folder_source(spark, tmp_path):
    for rel, body in {"a.js": b"x\n", "src/b.py": b"y\xff\n", "node_modules/w/i.js": b"z", ".env": b"K=1", "c.bin": b"\0", "skip.log": b"l", ".gitignore": b"*.log\n"}.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    rows = {r["rel"]: r for r in workspace.from_folder(spark, str(tmp_path), "w").collect()}
    assert set(rows) == {"a.js", "src/b.py", ".env", "c.bin", ".gitignore"}
    assert rows[".env"]["content"] is None and "credentials" in rows[".env"]["reason"] and rows["c.bin"]["indexed"] is False
    assert rows["src/b.py"]["lossless"] is False and rows["a.js"]["hash"] == "6FCF9DFBD479ED82697FEE719B9F8C610A11FF2A"
    workspace.register(spark)
    got = [r["path"] for r in spark.read.format("workspace_files").option("root", str(tmp_path)).load().orderBy("path").collect()]
    assert got == [".env", ".gitignore", "a.js", "c.bin", "skip.log", "src/b.py"]
    assert spark.read.format("workspace_files").option("root", str(tmp_path)).option("limit", 2).load().count() == 2
    assert [r["rel"] for r in workspace.read_paths(spark, str(tmp_path), ["a.js", "missing", "../x"]).collect()] == ["a.js"]


def test_change_feed(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    batches = [
        [("w", "a", 1, 1.0, "1", False, at(1)), ("w", "b", 1, 1.0, "1", False, at(1))],
        [("w", "a", 1, 9.0, "01", False, at(2)), ("w", "b", 1, 1.0, "2", False, at(2)), ("w", "a", 1, 1.0, "7", False, at(0))],
        [("w", "b", None, None, None, True, at(3)), ("w", "b", 1, 1.0, "3", False, at(1))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(LISTING).parquet(src)
        changes.feed(changes.detect_changes(stream), str(tmp_path / "cp"), lambda df, b: out.append(sorted((r["rel"], r["change"]) for r in df.collect()))).awaitTermination()
    assert [x for x in out if x] == [[("a", "new"), ("b", "new")], [("b", "changed")], [("b", "removed")]]
