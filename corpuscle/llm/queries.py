"""Queries of the operators in this package, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import TABLE_LANGS, table, table_lang
from . import bpe, credentials, docpairs, languages, pack, parses, split


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf_dir, "files")).select("ws", "rel", "name", "line_start").distinct()


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs themselves, code as a digest."""
    pairs = docpairs.documented_functions(table(spark, sf_dir, "files"))
    return pairs.select("ws", "rel", "lang", "name", "line_start", "line_end", "signature", "doc", F.md5("code").alias("code_md5")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_oversized(table(spark, sf_dir, "files"), table(spark, sf_dir, "size_limits"))
    found = pieces.where("piece_no = 0").select("ws", "rel", F.explode(F.concat(F.array(F.lit(0)), "long_lines")).alias("line_no"))
    return found.distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized file, its text as a digest."""
    pieces = split.split_oversized(table(spark, sf_dir, "files"), table(spark, sf_dir, "size_limits"))
    return pieces.select("ws", "rel", "n_chars", "piece_no", "n_pieces", "start_off", "end_off", "cut_kind", F.md5("text").alias("text_md5"))


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each file put together again, and how many are too large or overlap by anything but what was asked."""
    limits = table(spark, sf_dir, "size_limits")
    pieces = split.split_oversized(table(spark, sf_dir, "files"), limits).withColumn("lang", table_lang(F.col("rel")))
    by_lang = split.read_limits(limits, "file", "chars")
    rows = [(lang, *by_lang.get(lang, by_lang.get("*", (0, 0)))) for lang in ["*", *sorted(set(TABLE_LANGS.values()))]]
    known = spark.createDataFrame(rows, "lang string, max_size bigint, overlap bigint")
    n, lap = F.col("end_off") - F.col("start_off"), F.col("cut_at") - F.col("start_off")
    part = F.struct("piece_no", F.expr("substring(text, cast(cut_at - start_off as int) + 1)").alias("part"))
    return (
        pieces.join(F.broadcast(known), "lang")  # nine rows
        .groupBy("ws", "rel")
        .agg(
            F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "")).alias("content_md5"),
            F.count_if((n > F.col("max_size")) | (n != F.length("text"))).alias("wrong_size"),
            F.count_if(lap != F.least("overlap", "cut_at")).alias("wrong_overlap"),
        )
    )


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all files: lines without a value that redaction changed, and values that are found again behind it."""
    a = credentials.audit(table(spark, sf_dir, "files")).distinct()
    return a.agg(F.count("*").alias("files"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"), F.coalesce(F.sum("left"), F.lit(0)).alias("left"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf_dir, "files")).select("ws", "rel", "line_no").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that holds a credential, with how many and the redacted content as a digest."""
    made = credentials.redact(table(spark, sf_dir, "files"))
    return made.select("ws", "rel", "values", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parses.check_syntax(table(spark, sf_dir, "files")).where("NOT valid").select("ws", "rel").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of invalid files per workspace and language, with totals."""
    return parses.rates(parses.check_syntax(table(spark, sf_dir, "files")))


def p5_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON files among the invalid ones, which SQL can judge too."""
    checked = parses.check_syntax(table(spark, sf_dir, "files").where("lower(rel) LIKE '%.json'"))
    return checked.where("NOT valid").select("ws", "rel").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_limits"))
    return placed.where("n_pieces > 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document with its container."""
    return pack.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_limits"))


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents: how many are placed whole, how many take no room, and how many containers are too full."""
    documents, limits = table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_limits")
    placed = pack.pack_documents(documents, limits)
    cap = pack.container_capacity(limits)
    of_doc = placed.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("n_pieces").alias("n_pieces"), F.countDistinct("piece_no").alias("pieces"), F.sum("size").alias("size"),
        F.max(F.col("start_tok") + F.col("size")).alias("upto"), F.count_if(F.col("container_id") > 0).alias("inside"),
    )
    whole = (F.col("n") == F.col("n_pieces")) & (F.col("n") == F.col("pieces")) & (F.col("size") == F.col("upto"))
    docs = of_doc.agg(F.count_if(whole).alias("whole"), F.count_if(F.col("inside") == 0).alias("empty"))
    full = placed.where("container_id > 0").groupBy("container_id").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > cap).alias("too_full"))
    return docs.join(full, F.lit(True))  # one row and one row


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled, over all of them."""
    limits = table(spark, sf_dir, "size_limits")
    placed = pack.pack_documents(table(spark, sf_dir, "documents"), limits)
    per = placed.where("container_id > 0").groupBy("container_id").agg(F.sum("size").alias("used"))
    cap = pack.container_capacity(limits)
    return per.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count("*") * cap), 6).alias("unused_share"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled(table(spark, sf_dir, "documents"))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of one language, with its confidence."""
    return languages.language_segments(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p4_found": p4_found, "p4_redacted": p4_redacted, "p4_kept": p4_kept, "p5_found": p5_found, "p5_rates": p5_rates, "p5_json": p5_json, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rejoined": p3_rejoined, "p6_ids": p6_ids, "p7_found": p7_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_whole": p7_whole, "p8_found": p8_found, "p8_segments": p8_segments}

_LANG = """CASE WHEN lower(rel) LIKE '%.py' THEN 'python' WHEN lower(rel) LIKE '%.js' OR lower(rel) LIKE '%.mjs' THEN 'javascript'
 WHEN lower(rel) LIKE '%.ts' THEN 'typescript' WHEN lower(rel) LIKE '%.go' THEN 'go' WHEN lower(rel) LIKE '%.java' THEN 'java'
 WHEN lower(rel) LIKE '%.rs' THEN 'rust' WHEN lower(rel) LIKE '%.json' THEN 'json' ELSE '*' END"""

ORACLE = {
    "p3_found": f"""
WITH f AS (SELECT DISTINCT ws, rel, content, {_LANG} AS l FROM files WHERE content IS NOT NULL),
m AS (SELECT f.*, coalesce(a.max_size, b.max_size) AS max_size FROM f
  LEFT JOIN size_limits a ON a.item = 'file' AND a.unit = 'chars' AND a.lang = f.l
  LEFT JOIN size_limits b ON b.item = 'file' AND b.unit = 'chars' AND b.lang = '*'),
big AS (SELECT * FROM m WHERE len(content) > max_size),
x AS (SELECT ws, rel, max_size, string_split(content, chr(10)) AS ls FROM big),
u AS (SELECT ws, rel, max_size, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS k FROM x)
SELECT DISTINCT ws, rel, CAST(0 AS INTEGER) AS line_no FROM big
UNION SELECT DISTINCT ws, rel, CAST(n AS INTEGER) FROM u
WHERE len(CASE WHEN n < k AND line LIKE '%' || chr(13) THEN left(line, -1) ELSE line END) > max_size""",
    "p3_rejoined": f"""
WITH f AS (SELECT DISTINCT ws, rel, content, {_LANG} AS l FROM files WHERE content IS NOT NULL)
SELECT ws, rel, md5(content) AS content_md5, 0 AS wrong_size, 0 AS wrong_overlap FROM f
  LEFT JOIN size_limits a ON a.item = 'file' AND a.unit = 'chars' AND a.lang = f.l
  LEFT JOIN size_limits b ON b.item = 'file' AND b.unit = 'chars' AND b.lang = '*' WHERE len(content) > coalesce(a.max_size, b.max_size)""",
    "p4_kept": "SELECT count(*) AS files, 0 AS changed, 0 AS left FROM (SELECT DISTINCT ws, rel FROM files WHERE content IS NOT NULL)",
    # json_valid lets a comma at the end pass
    "p5_json": '''SELECT DISTINCT ws, rel FROM files WHERE lower(rel) LIKE '%.json' AND content IS NOT NULL AND (NOT json_valid(content)
 OR regexp_matches(regexp_replace(content, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}\\]]'))''',
    "p7_whole": "SELECT count(*) AS whole, count(*) FILTER (coalesce(text, '') = '') AS empty, 0 AS too_full FROM documents",
}
