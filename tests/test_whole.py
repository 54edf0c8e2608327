"""Queries over the whole of their job, each against SQL of its own over the smoke tables or against rows made here."""

import pytest

from corpuscle.operators import corpus, lookup, scan, vector
from tests.compare import same


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_compare_asks_every_twentieth_vector(spark, sf):
    profile = lambda kind, dims: f"'{vector.identity('table', '', kind, dims)}' AS profile,"
    half = vector._knn_sql("a.vec_id % 20 = 0", 2, profile("half", 32)).replace("a.embedding AS", "a.embedding[1:32] AS").replace("b.embedding AS", "b.embedding[1:32] AS")
    same(vector.knn_compare(spark, sf), vector._knn_sql("a.vec_id % 20 = 0", 2, profile("full", 64)) + " UNION ALL " + half, sf)


def test_best_per_group_asks_every_twentieth_vector(spark, sf):
    same(vector.knn_best_per_group(spark, sf), f"""SELECT a.vec_id AS q, b.label, first(b.vec_id ORDER BY round({vector._COS}, 12) DESC, b.vec_id) AS vec_id, round(max({vector._COS}), 6) AS score
     FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id, b.label""", sf)


@pytest.mark.parametrize("block", [2048, 2])
def test_best_per_group_without_vector_0(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK", block)
    rows = [(20, [1.0, 0.0], 1), (40, [0.0, 1.0], None), (60, [0.0, 2.0], None), (80, None, 2), (90, [3.0, 0.0], 1)]
    at = write(spark, tmp_path, embeddings=(rows, "vec_id bigint, embedding array<float>, label int"))
    got = sorted((r["q"], r["label"] or 0, r["vec_id"], r["score"]) for r in vector.knn_best_per_group(spark, at).collect())
    assert got == [(20, 0, 40, 0.0), (20, 1, 20, 1.0), (40, 0, 40, 1.0), (40, 1, 20, 0.0), (60, 0, 40, 1.0), (60, 1, 20, 0.0)]
    only = write(spark, tmp_path / "none", embeddings=([(1, [1.0], 1)], "vec_id bigint, embedding array<float>, label int"))
    assert vector.knn_best_per_group(spark, only).count() == 0


ADDRESSED = """WITH s AS (SELECT DISTINCT ws, file, path, name FROM symbols), p AS (SELECT path, string_split(path, '.') AS a FROM s),
 e AS (SELECT array_to_string(a[i:], '.') AS q FROM (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM p)),
 a AS (SELECT name AS q FROM s UNION SELECT path FROM s UNION SELECT split_part(path, '.', 1) FROM s UNION SELECT q FROM e WHERE contains(q, '.')),
 b AS (SELECT q, ws, file, path, min(CASE WHEN path = q THEN 0 WHEN contains(q, '.') AND ends_with(path, '.' || q) THEN 1 ELSE 2 END) AS tier
  FROM s JOIN a ON path = q OR contains(q, '.') AND ends_with(path, '.' || q) OR name = q GROUP BY ALL),
 m AS (SELECT q, min(tier) AS tier FROM b GROUP BY q) SELECT b.q, CAST(b.tier AS INTEGER) AS tier, count(*) AS candidates FROM b JOIN m ON b.q = m.q AND b.tier = m.tier GROUP BY ALL"""


def test_every_name_and_path_end_is_asked(spark, sf, tmp_path):
    same(corpus.addressing(spark, sf), ADDRESSED, sf)
    rows = [("w", "f", "A.b.c", "c"), ("w", "f", "X.b.c", "c"), ("w", "f", "b", "b"), ("w", "g", "b.c", "c"), ("w", "g", "Q.d", "d"), ("w", "g", "R.e.d", "d")]
    at = write(spark, tmp_path, symbols=(rows, "ws string, file string, path string, name string"))
    got = {r["q"]: (r["tier"], r["candidates"]) for r in corpus.addressing(spark, at).collect()}
    assert got == {"A.b.c": (0, 1), "X.b.c": (0, 1), "b": (0, 1), "b.c": (0, 1), "Q.d": (0, 1), "R.e.d": (0, 1), "e.d": (1, 1), "c": (2, 3), "d": (2, 2)}
    same(corpus.addressing(spark, at), ADDRESSED, at)


def test_code_of_every_language_without_symbols_is_orphaned(spark, tmp_path):
    rels = ["a.py", "a.js", "a.mjs", "a.ts", "a.go", "a.java", "a.rs", "a.json", "a.md", "known.go"]
    files = [("w", rel, "x") for rel in rels] + [("w", "null.rs", None)]
    at = write(spark, tmp_path, files=(files, "ws string, rel string, content string"), symbols=([("w", "known.go"), ("w", "lost.ts")], "ws string, file string"))
    got = {(r["rel"], r["side"]) for r in scan.orphaned_symbols(spark, at).collect()}
    assert got == {(rel, "files") for rel in rels[:7]} | {("lost.ts", "symbols")}


def test_symbols_of_every_kind_are_read(spark, sf):
    cols = lambda more: f"WITH {corpus.SEARCHABLE_SQL}, S AS (SELECT DISTINCT ws, file AS rel, line_start, {more} FROM symbols)"
    same(lookup.read_symbols(spark, sf), cols("path, line_end") + """ SELECT ws, rel, path, line_start, md5(array_to_string((string_split(content, chr(10)))[line_start:line_end], chr(10))) AS md5
     FROM S JOIN C USING (ws, rel)""", sf)
    same(lookup.symbol_offsets(spark, sf), cols("name, start_off, end_off") + """ SELECT ws, rel, name, line_start, CAST(start_off - len(replace(left(content, start_off), chr(10), '')) + 1 AS INTEGER) AS line,
     md5(substring(content, start_off + 1, end_off - start_off)) AS md5 FROM S JOIN C USING (ws, rel) WHERE start_off IS NOT NULL""", sf)
    same(corpus.symbols_table(spark, sf), "SELECT DISTINCT ws, file, name, path, parent, line_start, line_end, left(doc, 160) AS doc, coalesce(exported, false) AS exported FROM symbols", sf)
