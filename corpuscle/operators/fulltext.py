"""The stored full-text index: postings of terms that are counted inside each row, and queries that read postings only.

``postings``: the keys of a text, its length ``dl`` in terms, ``term`` and ``tf``, partitioned by a hash bucket of the term
and sorted by term inside, so a query opens the files of its few terms, and a prefix prunes by the terms that a file
begins and ends with. ``totals``: one row with the number of texts and of terms. Repeated keys are texts of their own
only if the table has them more than once; texts without a term have no posting but count.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import match
from ..session import app_dir, observed
from .ledger import _Fs

SALTS, BUCKET_BYTES = 4, 64 << 20  # a bucket is made for so many bytes of input
K1, B = 1.2, 0.75


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once and not at each mention."""
    return F.transform(F.array(value), then)[0]


def counted_terms(body: Column) -> Column:
    """Array of (term, tf), by runs of equal terms in the sorted array: a text is counted within its row."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (w[i] != w[F.greatest(i - 1, F.lit(0))]))).otherwise(F.array().cast("array<int>"))
        return once(starts, lambda s: F.transform(s, lambda at, k: F.struct(w[at].alias("term"), (F.coalesce(F.get(s, k + 1), n) - at).alias("tf"))))

    return once(F.array_sort(match.term_array(body)), runs)


TOTALS = "texts bigint, terms bigint, buckets int"


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    texts: int
    terms: int
    buckets: int
    schema: StructType  # of the keys

    def postings(self) -> DataFrame:
        key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self.spark.read.schema(f"{key}, dl int, term string, tf int, bucket int").parquet(f"{self.path}/postings")


def build(docs: DataFrame, keys: list[str], body: str, path: str, buckets: int = 64) -> Index:
    """Write the index of ``body`` below ``path``: one pass over the texts, one exchange of postings."""
    watch = Observation()
    each = docs.select(*keys, counted_terms(F.col(body)).alias("t"))
    length = F.aggregate("t", F.lit(0), lambda a, x: a + x["tf"])
    each = each.withColumn("dl", length).observe(watch, F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
    p = each.select(*keys, "dl", F.inline("t")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # a frequent term is spread by its texts
    p = p.repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(SALTS))).sortWithinPartitions("bucket", "term")
    p.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    n, dl = observed(watch, "n"), observed(watch, "dl")
    n = docs.count() if n is None else n
    docs.sparkSession.createDataFrame([(n, dl or 0, buckets)], TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return Index(docs.sparkSession, path, tuple(keys), n, dl or 0, buckets, docs.select(*keys).schema)


def stored(source: DataFrame, docs: DataFrame, keys: list[str], body: str, label: str) -> Index:
    """The index of ``docs``, which is a function of the files under ``source`` and named by ``label``: built for the first
    query of the application that asks for it, and read by the others until those files change."""
    spark = source.sparkSession
    # one row, whatever the number of files: what they are, and how large together
    read = source.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("m")).distinct()
    state = read.agg(F.bit_xor(F.xxhash64("p", "s", "m")), F.count("*"), F.sum("s")).first()
    path = f"{app_dir(spark)}/fulltext-{label}-{hashlib.sha1(repr((tuple(state), keys)).encode()).hexdigest()}"
    buckets = max(4, min(1 << 16, (state[2] or 0) // BUCKET_BYTES))
    there = _Fs(spark, path).exists(f"{path}/totals/_SUCCESS")
    t = spark.read.schema(TOTALS).parquet(f"{path}/totals").first() if there else None
    return Index(spark, path, tuple(keys), t["texts"], t["terms"], t["buckets"], docs.select(*keys).schema) if t else build(docs, keys, body, path, buckets)


def search(index: Index, terms: list[str], mode: str = "and", prefix: bool = False) -> DataFrame:
    """(keys, relevance) of the texts that hold all terms (``and``) or any (``or``): BM25 as in ``search``."""
    p = index.postings()
    if not terms:
        return p.select(*index.keys, F.lit(0.0).alias("relevance")).limit(0)
    if prefix:  # every term that begins so counts for it; a term may begin with several
        begins = functools.reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in terms])
        hits = p.where(begins).select(*index.keys, "dl", "tf", F.explode(F.array_compact(F.array(*[F.when(F.col("term").startswith(t), F.lit(t)) for t in terms]))).alias("term"))
    else:
        buckets = [r[0] for r in p.sparkSession.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(index.buckets)).cast("int") for t in terms]))).collect()]
        hits = p.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).select(*index.keys, "dl", "tf", "term")
    hits = hits.groupBy(*index.keys, "dl", "term").agg(F.sum("tf").alias("tf"))
    df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row a term of the query
    if mode == "and" and len(df) < len(set(terms)) or not df:
        return p.select(*index.keys, F.lit(0.0).alias("relevance")).limit(0)
    n, avg = index.texts, index.terms / max(1, index.texts) or 1.0
    idf = F.create_map(*[F.lit(x) for t, d in sorted(df.items()) for x in (t, d)])[F.col("term")].cast("double")
    part = F.log(1 + (n - idf + 0.5) / (idf + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avg)))
    found = hits.groupBy(*index.keys).agg(F.sum(part).alias("relevance"), F.count("*").alias("_n"))
    return (found.where(F.col("_n") == len(set(terms))) if mode == "and" else found).drop("_n")
