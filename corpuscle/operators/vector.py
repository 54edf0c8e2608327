"""Vectors: profiles and their identity, embedding, exact and indexed nearest neighbours, fused answers.

Search takes a set of query vectors against all rows. Queries are sent in blocks of at most ``BLOCK`` vectors; each batch
of rows is one matrix product with a block, and only its best k per query leave the task, so what is shuffled is
(tasks x queries x k) rows, never pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import match
from ..session import table
from . import fulltext, search

BLOCK = 2048


def identity(kind: str, endpoint: str, model: str, dims: int) -> str:
    """What tells vector spaces apart; vectors of different identities are never compared."""
    return json.dumps([kind, endpoint, model, dims], separators=(",", ":"))


def pipeline_name(ident: str) -> str:
    kind, _, model, dims = json.loads(ident)
    slug = re.sub(r"[^a-z0-9_]", "_", model.lower())[:40] or kind
    return f"code_{slug}_{dims}_{hashlib.sha1(ident.encode()).hexdigest()[:8]}"


# -- embedding

_EMBEDDERS: dict[str, tuple[Callable[[list[str]], np.ndarray], int]] = {}


def register_embedder(name: str, fn: Callable[[list[str]], np.ndarray], dims: int) -> None:
    """A function from texts to vectors. It is shipped to the executors with the plan that uses it."""
    _EMBEDDERS[name] = (fn, dims)


def bag_of_words(texts: list[str], dims: int = 64) -> np.ndarray:
    """The default: words of three letters and more hashed by FNV-1a into ``dims`` buckets, length one."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W_]{3,}", (t or "").lower()):
            h = 2166136261
            for b in w.encode():
                h = ((h ^ b) * 16777619) & 0xFFFFFFFF
            out[i, h % dims] += 1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


register_embedder("bag_of_words", bag_of_words, 64)


def embed(df: DataFrame, text: str, profile: str = "bag_of_words", out: str = "embedding") -> DataFrame:
    fn, _ = _EMBEDDERS[profile]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(fn(s.tolist())))

    return df.withColumn(out, run(F.col(text)))


# -- exact search


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _blocks(queries: DataFrame, key: str, value: str) -> Iterator[tuple[list, np.ndarray]]:
    """Keys and unit vectors of the queries, block by block in hash order; a block has a fixed size, whatever their number."""
    numbered = queries.select(F.col(key).alias("q"), F.col(value).alias("v")).where(F.col(value).isNotNull())
    blocks = max(1, -(-numbered.count() // BLOCK))
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        rows = part.collect()  # about BLOCK vectors
        if rows:
            yield [r["q"] for r in rows], _unit(np.array([r["v"] for r in rows], np.float64))


def best_of_rows(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row, ties by key. Only what reaches a row's k-th score is sorted."""
    r = np.round(scores, 12)
    least = np.partition(r, r.shape[1] - k, axis=1)[:, r.shape[1] - k] if r.shape[1] > k else np.full(len(r), -np.inf)
    at, col = np.nonzero(r >= least[:, None])
    order = np.lexsort((keys[col], -r[at, col], at))
    at, col = at[order], col[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], col[rank < k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(q, key, score, rank) of the k most similar rows of each query by cosine; ties by key. Exact."""
    spark = vectors.sparkSession
    out = None
    for block in _blocks(queries, key, value):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf["key"].to_numpy()
                s = m @ _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64)).T
                at, col = best_of_rows(s, own, k)
                yield pd.DataFrame({"q": np.asarray(ids)[at], "key": own[col], "score": s[at, col]})

        found = vectors.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("v")).mapInPandas(run, "q bigint, key bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "q bigint, key bigint, score double, rank int")
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 12)), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_per_group(vectors: DataFrame, queries: DataFrame, group: str, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(q, group, key, score) of the most similar row of each group for each query; ties by key. Exact.

    Sent in blocks like ``nearest``; each batch of rows gives its best of every group, so (batches x queries x groups) rows are shuffled at most.
    """
    spark = vectors.sparkSession
    out = None
    for block in _blocks(queries, key, value):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                pdf = pdf.sort_values("key", kind="stable")  # of equal scores argmax takes the first
                own = pdf["key"].to_numpy()
                s = m @ _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64)).T
                codes, labels = pd.factorize(pdf["g"], use_na_sentinel=False)
                for c, label in enumerate(labels):
                    at = np.flatnonzero(codes == c)
                    best = at[np.round(s[:, at], 12).argmax(1)]
                    yield pd.DataFrame({"q": ids, "g": pd.Series([None if pd.isna(label) else label] * len(ids), dtype=object), "key": own[best], "score": s[np.arange(len(ids)), best]})

        rows = vectors.where(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(key).alias("key"), F.col(value).alias("v"))
        found = rows.mapInPandas(run, "q bigint, g string, key bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "q bigint, g string, key bigint, score double")
    order = F.struct(F.round("score", 12).alias("s"), (-F.col("key")).alias("i"))
    best = out.groupBy("q", "g").agg(F.max_by("key", order).alias("key"), F.max_by("score", order).alias("score"))
    return best.select("q", F.col("g").cast(vectors.schema[group].dataType).alias(group), "key", "score")


# -- an index: inverted lists of a coarse quantiser


def _sample(vectors: DataFrame, most: int, key: str, value: str) -> np.ndarray:
    """Unit vectors of at most ``most`` rows, by hash of the key."""
    total, scale = vectors.count(), 1 << 50
    share = max(1, int(min(1.0, most / max(1, total)) * scale))
    rows = vectors.where(F.col(value).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(scale)) < share)).select(value).limit(most).collect()
    return _unit(np.array([r[value] for r in rows], np.float64)) if rows else np.zeros((0, 0))


def fit_centroids(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 8, key: str = "vec_id", value: str = "embedding", seed: int = 3) -> np.ndarray:
    """k-means on a bounded sample by hash of the key (at most ``sample`` vectors)."""
    x = _sample(vectors, sample, key, value)
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))]))
    return c


def choose_probes(vectors: DataFrame, centroids: np.ndarray, k: int = 10, goal: float = 0.95, sample: int = 20_000, key: str = "vec_id", value: str = "embedding") -> int:
    """The least number of lists in which ``goal`` of the k nearest of sampled vectors lie, measured within a bounded sample."""
    if not len(centroids):
        return 1
    x = _sample(vectors, sample, key, value)
    lists = (x @ centroids.T).argmax(1)
    q = x[:256]
    near = np.argsort(-(q @ x.T), axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(rank, lists[near], 1), goal)) + 1


def index_vectors(vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """Every row with its list; written partitioned by list it is the index. Without centroids all rows lie in list 0."""
    if not len(centroids):
        return vectors.where(F.col(value).isNotNull()).select(key, value, F.lit(0).alias("list"))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series((_unit(np.stack(s.to_numpy()).astype(np.float64)) @ shared.value.T).argmax(1).astype(np.int32))

    return vectors.where(F.col(value).isNotNull()).select(key, value, lists(value).alias("list"))


def indexed_nearest(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """As ``nearest``, looking into the ``probes`` closest lists of each query: an equi join on the list and on a salt of the
    row, so that a list of any size is spread over ``SPREAD`` tasks; the few queries are repeated for each."""
    if not len(centroids):
        return nearest(index, queries, k, key, value)
    shared = index.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            sims = _unit(np.stack(s.to_numpy()).astype(np.float64)) @ shared.value.T
            yield pd.Series(list(np.argsort(-sims, axis=1)[:, :probes].astype(np.int32)))

    q = queries.where(F.col(value).isNotNull()).select(F.col(key).alias("q"), F.col(value).alias("qv"), F.explode(probe(value)).alias("list"))
    q = q.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    pairs = q.join(index.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int")), ["list", "_s"])
    dot = F.aggregate(F.zip_with("qv", value, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda a, b: a + b))
    scored = pairs.select("q", F.col(key).alias("key"), (dot / (norm(F.col("qv")) * norm(F.col(value)))).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 12)), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# -- fusion


SPREAD = 8


def semantic_score(s) -> F.Column:
    """Similarity on the ladder: between 20 and 40, so below names and amid prose."""
    return (F.lit(20) + F.floor(F.lit(20) * s + 0.5)).cast("int")


def ask(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both answers: lexical hits, and vector hits that are not among them."""
    vec = semantic.join(lexical.select("doc_id"), "doc_id", "left_anti").select("doc_id", semantic_score(F.col("score")).alias("score"), F.round("score", 6).alias("relevance"), F.lit("vector").alias("via"))
    lex = lexical.select("doc_id", F.lit(35).alias("score"), F.round("relevance", 6).alias("relevance"), F.lit("content").alias("via"))
    return lex.unionByName(vec)


# -- queries


def _vec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest of every vector whose id is divisible by 20, against all rows."""
    v = _vec(spark, sf)
    return nearest(v, v.where("vec_id % 20 = 0"), 3).select("q", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def knn_best_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The best row of each label for every vector whose id is divisible by 20, the earlier of equal ones."""
    v = _vec(spark, sf)
    return nearest_per_group(v, v.where("vec_id % 20 = 0"), "label").select("q", "label", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


def knn_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of ``knn_topk`` in two profiles, all dimensions and the first half of them."""
    v = _vec(spark, sf)
    half = v.withColumn("embedding", F.slice("embedding", 1, 32))
    a = nearest(v, v.where("vec_id % 20 = 0"), 2).withColumn("profile", F.lit(identity("table", "", "full", 64)))
    b = nearest(half, half.where("vec_id % 20 = 0"), 2).withColumn("profile", F.lit(identity("table", "", "half", 32)))
    return a.unionByName(b).select("profile", "q", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def knn_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the index against the exact answer, over all queries."""
    v = _vec(spark, sf)
    q = v.where("vec_id % 20 = 0")
    c = fit_centroids(v, max(16, round(v.count() ** 0.5)))
    exact = nearest(v, q, 10).select("q", "key")
    found = indexed_nearest(index_vectors(v, c), c, q, 10, choose_probes(v, c)).select("q", "key").withColumn("hit", F.lit(1))
    j = exact.join(found, ["q", "key"], "left")
    return j.agg(F.count("*").alias("wanted"), (F.count("hit") / F.count("*") >= 0.9).alias("recall_ok"))


def ask_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for two words and the vector of document 0, vectors being keyed by document."""
    lex = fulltext.search(search.document_index(spark, sf), match.query_terms("signature column")).select("doc_id", "relevance")
    v = _vec(spark, sf)
    sem = nearest(v, v.where("vec_id = 0"), 8).select(F.col("key").alias("doc_id"), "score")
    return ask(lex, sem)


def embedding_status(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with and without a vector, and vectors without a document."""
    d = table(spark, sf, "documents").select("doc_id")
    v = _vec(spark, sf).select(F.col("vec_id").alias("doc_id"))
    j = d.withColumn("d", F.lit(1)).join(v.withColumn("v", F.lit(1)), "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("d").isNotNull() & F.col("v").isNotNull()).alias("done"), F.count_if(F.col("v").isNull()).alias("pending"), F.count_if(F.col("d").isNull()).alias("orphaned"))


QUERIES = {f.__name__: f for f in (knn_topk, knn_best_per_group, knn_compare, knn_indexed, ask_fused, embedding_status)}

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _knn_sql(where: str, k: int, extra: str = "") -> str:
    return f"""SELECT {extra} a.vec_id AS q, b.vec_id, round({_COS}, 6) AS score, CAST(row_number() OVER w AS INTEGER) AS rank FROM embeddings a, embeddings b WHERE {where}
 WINDOW w AS (PARTITION BY a.vec_id ORDER BY round({_COS}, 12) DESC, b.vec_id) QUALIFY row_number() OVER w <= {k}"""


_HALF = _knn_sql("a.vec_id % 20 = 0", 2, f"'{identity('table', '', 'half', 32)}' AS profile,").replace("a.embedding AS", "a.embedding[1:32] AS").replace("b.embedding AS", "b.embedding[1:32] AS")
ORACLE = {
    "knn_indexed": "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) * least(10, (SELECT count(*) FROM embeddings)) AS wanted, true AS recall_ok",
    "knn_topk": _knn_sql("a.vec_id % 20 = 0", 3),
    "knn_best_per_group": f"SELECT a.vec_id AS q, b.label, first(b.vec_id ORDER BY round({_COS}, 12) DESC, b.vec_id) AS vec_id, round(max({_COS}), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id, b.label",
    "knn_compare": _knn_sql("a.vec_id % 20 = 0", 2, f"'{identity('table', '', 'full', 64)}' AS profile,") + " UNION ALL " + _HALF,
    "ask_fused": f"""WITH lex AS ({search._bm25_sql(match.query_terms('signature column'), 'and').replace('{k}', 'doc_id')}),
 sem AS (SELECT b.vec_id AS doc_id, {_COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY round(s, 12) DESC, doc_id LIMIT 8)
 SELECT doc_id, 35 AS score, relevance, 'content' AS via FROM lex UNION ALL
 SELECT doc_id, CAST(20 + floor(20 * s + 0.5) AS INTEGER), round(s, 6), 'vector' FROM sem WHERE doc_id NOT IN (SELECT doc_id FROM lex)""",
    "embedding_status": """SELECT count(*) FILTER (d.doc_id IS NOT NULL AND v.vec_id IS NOT NULL) AS done, count(*) FILTER (v.vec_id IS NULL) AS pending, count(*) FILTER (d.doc_id IS NULL) AS orphaned
 FROM documents d FULL OUTER JOIN embeddings v ON d.doc_id = v.vec_id""",
}
