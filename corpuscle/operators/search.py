"""Full-text search and ranking: BM25 over documents and symbols, AND / OR / prefix, the score ladder, fused answers.

``fulltext`` answers from a stored index. ``bm25`` here is the same without one, for small or fleeting tables: a text is
reduced to its length and its frequency of each term by higher-order functions, and both passes (statistics, scores) are
narrow scans. Statistics are one row.

BM25: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.2, b = 0.75, ``relevance`` is the sum over the terms.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import match, text
from ..session import table
from . import corpus, fulltext, grep

K1, B = 1.2, 0.75


def frequencies(docs: DataFrame, body: str, terms: list[str], prefix: bool = False) -> DataFrame:
    """``docs`` without the body, with ``dl`` and an array ``tf`` in the order of the terms."""
    words = F.col("_w")
    same = (lambda t: lambda w: w.startswith(t)) if prefix else (lambda t: lambda w: w == t)
    tf = F.array(*[F.size(F.filter(words, same(t))) for t in terms]) if terms else F.array().cast("array<int>")
    kept = [c for c in docs.columns if c != body]
    return docs.withColumn("_w", match.term_array(F.col(body))).select(*kept, F.size("_w").alias("dl"), tf.alias("tf"))


def bm25(docs: DataFrame, body: str, terms: list[str], mode: str = "and", prefix: bool = False) -> DataFrame:
    """Rows of ``docs`` that hold all terms (``and``) or any (``or``), with their relevance."""
    if not terms:
        return frequencies(docs, body, terms).withColumn("relevance", F.lit(0.0)).drop("dl", "tf").limit(0)
    f = frequencies(docs, body, terms, prefix)
    stats = f.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    hit = [F.col("tf")[i] > 0 for i in range(len(terms))]
    keep = functools.reduce(lambda a, b: a & b if mode == "and" else a | b, hit)

    def part(i: int) -> Column:
        tf, df = F.col("tf")[i].cast("double"), stats[f"df{i}"]
        idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))

    score = functools.reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))])
    return f.where(keep).withColumn("relevance", score).drop("dl", "tf")


def quote_lines(docs: DataFrame, key: list[str], body: str, terms: list[str], most: int = 3) -> DataFrame:
    """The lines of each text that hold the most terms, earlier ones first among equals; ``n`` from 1."""
    any_term = functools.reduce(lambda a, b: a | b, [F.lower(F.col(body)).contains(t) for t in terms])
    lines = text.with_lines(docs.where(any_term).select(*key, body), body)
    count = functools.reduce(lambda a, b: a + b, [F.lower("line").contains(t).cast("int") for t in terms])
    scored = lines.withColumn("terms", count).where("terms > 0").distinct()
    w = Window.partitionBy(*key).orderBy(F.desc("terms"), "ln")
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def name_score(name: Column, path: Column, q: str) -> Column:
    """100 exact, 70 prefix, 50 substring, the better of name and path."""
    q = q.lower()

    def one(c: Column) -> Column:
        c = F.lower(c)
        return F.when(c == q, 100).when(c.startswith(q), 70).when(c.contains(q), 50).otherwise(0)

    return F.greatest(one(name), one(path))


def symbol_body() -> Column:
    return F.concat_ws(" ", "name", "path", "doc", "signature")


HIT = ["ws", "file", "path", "name", "kind", "line_start", "line_end"]


def symbol_rows(symbols: DataFrame) -> DataFrame:
    return symbols.select(*HIT, "doc", "signature").distinct()


def symbol_index(symbols: DataFrame) -> fulltext.Index:
    """The stored index of name, path, doc and signature."""
    return fulltext.stored(symbols, symbol_rows(symbols).withColumn("_b", symbol_body()), HIT, "_b", "symbols")


def content_index(files: DataFrame) -> fulltext.Index:
    """The stored index of path and content of the searchable files, one text a file."""
    rows = corpus.content(files).dropDuplicates(["ws", "rel"])
    return fulltext.stored(files, rows.withColumn("_b", F.concat_ws(" ", "rel", "content")), ["ws", "rel"], "_b", "content")


def find_symbols(symbols: DataFrame, q: str, loose: bool = False, index: fulltext.Index | None = None) -> DataFrame:
    """Symbols by the ladder: name 100 / 70 / 50, all terms in name, path, doc or signature 40 (any term 18), doc 25."""
    terms = match.query_terms(q)
    s = symbol_rows(symbols)
    ladder = name_score(F.col("name"), F.col("path"), q)
    how = "or" if loose else "and"
    prose = fulltext.search(index, terms, how) if index else bm25(s.withColumn("_b", symbol_body()), "_b", terms, how)
    fts = prose.select(*HIT, F.lit(18 if loose else 40).alias("score"), "relevance", F.lit("fts~" if loose else "fts").alias("via"))
    by_name = s.withColumn("score", F.when(ladder > 0, ladder).when(F.lower("doc").contains(q.lower()), 25).otherwise(0)).where("score > 0")
    by_name = by_name.select(*HIT, "score", F.lit(0.0).alias("relevance"), F.lit(None).cast("string").alias("via"))
    return fts.unionByName(by_name)


def find_content(files: DataFrame, symbols: DataFrame, q: str, loose: bool = False, index: fulltext.Index | None = None) -> DataFrame:
    """The content eye: files that hold all terms, their best lines by owner symbol. A file that no line of its own speaks
    for, as its path does, is a hit without a line."""
    terms = match.query_terms(q)
    if not terms:
        return _no_content(files)
    how = "or" if loose else "and"
    if index:
        hits = fulltext.search(index, terms, how)
    else:
        docs = corpus.content(files).withColumn("_b", F.concat_ws(" ", "rel", "content")).select("ws", "rel", "_b")
        hits = bm25(docs, "_b", terms, how).groupBy("ws", "rel").agg(F.max("relevance").alias("relevance"))
    quotes = quote_lines(corpus.content(files).join(hits.select("ws", "rel"), ["ws", "rel"], "left_semi"), ["ws", "rel"], "content", terms)
    sy = symbols.select("ws", "file", "name", "path", "line_start", "line_end", "ord").distinct()
    owned = grep.owners(quotes.drop("n"), sy).join(hits, ["ws", "rel"])
    best = owned.groupBy("ws", "rel", "owner").agg(F.max_by(F.struct("ln", "line", "relevance", "owner_name"), F.struct("terms", (-F.col("ln")).alias("l"))).alias("b"))
    silent = hits.join(best.select("ws", "rel").distinct(), ["ws", "rel"], "left_anti")
    best = best.unionByName(silent.select("ws", "rel", F.lit(None).cast("string").alias("owner"), F.struct(F.lit(None).cast("int").alias("ln"), F.lit(None).cast("string").alias("line"), "relevance", F.lit(None).cast("string").alias("owner_name")).alias("b")))
    return best.select(
        "ws", F.col("rel").alias("file"), F.col("owner").alias("path"), F.col("b.owner_name").alias("name"), F.lit(16 if loose else 35).alias("score"),
        F.col("b.relevance").alias("relevance"), F.lit("content~" if loose else "content").alias("via"), F.col("b.ln").alias("line"), F.substring(F.trim("b.line"), 1, 200).alias("quote"),
    )


def _no_content(files: DataFrame) -> DataFrame:
    return files.sparkSession.createDataFrame([], "ws string, file string, path string, name string, score int, relevance double, via string, line int, quote string")


def find(files: DataFrame, symbols: DataFrame, q: str, kind: str | None = None, where=None, indexes: tuple[fulltext.Index, fulltext.Index] | None = None) -> DataFrame:
    """Ranked hits of both eyes merged by file and path: the best score, the union of ``via``, a quote if any has one.

    AND first; only if neither eye finds anything and the query has several words, OR. The order is total:
    score, relevance, span, file, path.
    """
    both = _eyes(files, symbols, q, False, indexes)
    if len(q.split()) > 1 and both.where("via IS NOT NULL").isEmpty():
        both = _eyes(files, symbols, q, True, indexes)
    if kind is not None:
        both = both.where((F.col("kind") == kind) | F.col("via").startswith("content"))
    if where is not None:
        both = both.where(where.column(F.col("file")))
    best = F.struct("score", "relevance")
    merged = both.groupBy("ws", "file", "path").agg(
        F.max(best).alias("b"), F.array_sort(F.collect_set("via")).alias("via"), F.max("name").alias("name"), F.max("kind").alias("kind"),
        F.max("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.min(F.when(F.col("quote").isNotNull(), F.struct("line", "quote"))).alias("q"),
    )
    span = F.coalesce(F.col("line_end") - F.col("line_start"), F.lit(1 << 30))
    return merged.select("ws", "file", "path", "name", "kind", "line_start", "line_end", "b.score", "b.relevance", "via", "q.line", "q.quote").orderBy(F.desc("score"), F.desc("relevance"), span, "ws", "file", "path")


def _eyes(files: DataFrame, symbols: DataFrame, q: str, loose: bool, indexes) -> DataFrame:
    of_symbols, of_content = indexes or (None, None)
    a = find_symbols(symbols, q, loose, of_symbols).withColumns({"line": F.lit(None).cast("int"), "quote": F.lit(None).cast("string")})
    b = find_content(files, symbols, q, loose, of_content)
    return a.unionByName(b, allowMissingColumns=True)


# -- queries


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")


def document_index(spark: SparkSession, sf: str) -> fulltext.Index:
    return fulltext.stored(table(spark, sf, "documents"), _docs(spark, sf), ["doc_id"], "text", "documents")


def fts_scan(spark: SparkSession, sf: str) -> DataFrame:
    """``fts_and`` without an index."""
    return bm25(_docs(spark, sf), "text", match.query_terms("the missing manifest on disk"), "and").select("doc_id", F.round("relevance", 6).alias("relevance"))


def fts_and(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.search(document_index(spark, sf), match.query_terms("the missing manifest on disk")).select("doc_id", F.round("relevance", 6).alias("relevance"))


def fts_or_loose(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.search(document_index(spark, sf), match.query_terms("Fassade scanner caché"), "or").select("doc_id", F.round("relevance", 6).alias("relevance"))


def fts_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the documents that hold words with all prefixes, unranked and complete."""
    return fulltext.search(document_index(spark, sf), ["sign", "col"], prefix=True).select("doc_id")


def fts_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.search(symbol_index(table(spark, sf, "symbols")), match.query_terms("oldest open")).select("ws", "file", "path", F.round("relevance", 6).alias("relevance"))


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    q = quote_lines(_docs(spark, sf), ["doc_id"], "text", ["cache", "manifest", "second"])
    return q.select("doc_id", "ln", "terms", "n", F.substring("line", 1, 200).alias("quote"))


def name_ladder(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "symbols").select("ws", "file", "path", "name").distinct()
    return s.withColumn("score", name_score(F.col("name"), F.col("path"), "Seal")).where("score > 0")


def find_ranked(spark: SparkSession, sf: str) -> DataFrame:
    files, symbols = table(spark, sf, "files"), table(spark, sf, "symbols")
    return find(files, symbols, "drop older day", indexes=(symbol_index(symbols), content_index(files))).drop("relevance")


def find_by_ladder(spark: SparkSession, sf: str) -> DataFrame:
    s = find_symbols(table(spark, sf, "symbols"), "tracer")
    return s.groupBy("ws", "file", "path").agg(F.max("score").alias("score"))


def _begins(term: str):
    return lambda w: w.startswith(term)


def grep_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Grep narrowed by index terms first, with the predicate applied again: the same rows as a scan."""
    literal = " trellis: not found"
    m = match.compile_matcher(literal, case=True)
    f = table(spark, sf, "files")
    need = match.index_terms(literal)
    vouched = F.lit(True)
    words = match.term_array(F.col("content"))
    for t in need:
        vouched = vouched & F.exists(words, _begins(t))
    return grep.matching_lines(f.where(vouched), m).select("ws", "rel", "ln", "line")


QUERIES = {f.__name__: f for f in (fts_and, fts_scan, fts_or_loose, fts_prefix, fts_symbols, quotes, name_ladder, find_ranked, find_by_ladder, grep_indexed)}

_T = corpus.TERMS_SQL


def _bm25_sql(terms: list[str], how: str, source: str = _T, key: str = "doc_id", docs: str = "documents WHERE text IS NOT NULL") -> str:
    lst = ", ".join(repr(t) for t in terms)
    need = len(terms) if how == "and" else 1
    return f"""WITH {source}, N AS (SELECT count(*) AS n FROM {docs}), DL AS (SELECT {key}, count(*) AS dl FROM K GROUP BY {key}),
 A AS (SELECT sum(dl) / (SELECT n FROM N) AS avgdl FROM DL), TF AS (SELECT {key}, term, count(*) AS tf FROM K WHERE term IN ({lst}) GROUP BY ALL),
 DF AS (SELECT term, count(*) AS df FROM TF GROUP BY term), H AS (SELECT {key} FROM TF GROUP BY {key} HAVING count(DISTINCT term) >= {need})
 SELECT {{k}}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS relevance
 FROM TF JOIN DF USING (term) JOIN DL USING ({key}) JOIN H USING ({key}), N, A GROUP BY {{k}}"""


_SYM = f"""S AS (SELECT DISTINCT ws, file, path, name, kind, line_start, line_end, doc, signature FROM symbols), R AS (SELECT row_number() OVER () AS id, * FROM S),
 T AS (SELECT id, left(unnest(regexp_extract_all(lower(concat_ws(' ', name, path, doc, signature)), '[\\p{{L}}\\p{{N}}_]+')), 64) AS term FROM R),
 K AS (SELECT id, term FROM T WHERE len(term) >= 2 AND term NOT IN ({corpus.STOP_SQL}))"""
ORACLE = {
    "fts_and": _bm25_sql(match.query_terms("the missing manifest on disk"), "and").replace("{k}", "doc_id"),
    "fts_scan": _bm25_sql(match.query_terms("the missing manifest on disk"), "and").replace("{k}", "doc_id"),
    "fts_or_loose": _bm25_sql(match.query_terms("Fassade scanner caché"), "or").replace("{k}", "doc_id"),
    "fts_prefix": f"WITH {_T} SELECT doc_id FROM K GROUP BY doc_id HAVING count(*) FILTER (term LIKE 'sign%') > 0 AND count(*) FILTER (term LIKE 'col%') > 0",
    "fts_symbols": "SELECT ws, file, path, relevance FROM (" + _bm25_sql(match.query_terms("oldest open"), "and", _SYM, "id", "R").replace("{k}", "id") + ") JOIN (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT ws, file, path, name, kind, line_start, line_end, doc, signature FROM symbols)) USING (id)",
    "quotes": """WITH D AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, -1) ELSE text END, chr(10)) AS a FROM documents WHERE len(text) > 0),
 U AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS ln FROM D), L AS (SELECT doc_id, CAST(ln AS INTEGER) AS ln, CASE WHEN raw LIKE '%' || chr(13) THEN left(raw, -1) ELSE raw END AS line FROM U),
 S AS (SELECT *, CAST(contains(lower(line), 'cache') AS INTEGER) + CAST(contains(lower(line), 'manifest') AS INTEGER) + CAST(contains(lower(line), 'second') AS INTEGER) AS terms FROM L)
 SELECT doc_id, ln, terms, CAST(row_number() OVER w AS INTEGER) AS n, left(line, 200) AS quote FROM S WHERE terms > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY terms DESC, ln) QUALIFY row_number() OVER w <= 3""",
    "name_ladder": """WITH s AS (SELECT DISTINCT ws, file, path, name FROM symbols), t AS (SELECT *, greatest(CASE WHEN lower(name) = 'seal' THEN 100 WHEN starts_with(lower(name), 'seal') THEN 70 WHEN contains(lower(name), 'seal') THEN 50 ELSE 0 END,
 CASE WHEN lower(path) = 'seal' THEN 100 WHEN starts_with(lower(path), 'seal') THEN 70 WHEN contains(lower(path), 'seal') THEN 50 ELSE 0 END) AS score FROM s) SELECT ws, file, path, name, score FROM t WHERE score > 0""",
    "find_by_ladder": f"""WITH {_SYM}, F AS (SELECT DISTINCT id FROM K WHERE term = 'tracer'), X AS (SELECT R.*, CASE WHEN lower(name) = 'tracer' OR lower(path) = 'tracer' THEN 100 WHEN starts_with(lower(name), 'tracer') OR starts_with(lower(path), 'tracer') THEN 70
 WHEN contains(lower(name), 'tracer') OR contains(lower(path), 'tracer') THEN 50 WHEN contains(lower(doc), 'tracer') THEN 25 ELSE 0 END AS a, CASE WHEN F.id IS NOT NULL THEN 40 ELSE 0 END AS b FROM R LEFT JOIN F ON R.id = F.id)
 SELECT ws, file, path, max(greatest(a, b)) AS score FROM X WHERE greatest(a, b) > 0 GROUP BY ALL""",
    "grep_indexed": f"WITH {corpus.LINES_SQL} SELECT ws, rel, ln, line FROM L WHERE contains(line, ' trellis: not found')",
}
