"""Filling fixed-capacity containers: minimum bin slack over the histogram of item sizes.

The packing works on counts of sizes, of which there are at most ``capacity``, never on the items. For each container
the largest size left is taken as seed; a bitset subset-sum over the sizes that are left (each as often as it is left)
finds the fullest feasible combination that holds it. That combination is then removed as many times as the counts
allow, so one round stands for many containers and every round uses up a size. Items are then numbered within their size
and find their container by that number.

Cases: null and empty texts have size 0 and lie in container 0, where they take no room. An item of exactly the capacity
is not split. An item beyond it, and only that, is cut into full pieces and a rest; the full pieces fill containers of
their own. Repeated ids are items of their own; equal rows may swap places. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_rows, materialise
from . import bpe
from .split import read_limits


def fullest(sizes: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the largest sum within ``room``; each size at most as often as counted. Sizes descend."""
    reach, steps, goal = 1, [], 1 << room
    mask = (1 << (room + 1)) - 1
    for s in sizes:
        left = counts[s]
        if s > room or not left:
            continue
        left, part = min(left, room // s), 1
        while left:  # binary splitting of the multiplicity
            take = min(part, left)
            new = (reach | reach << (s * take)) & mask
            if new != reach:
                steps.append((s, take, reach))
                reach = new
            left -= take
            part *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for s, take, before in reversed(steps):
        if not before >> total & 1:
            out[s] = out.get(s, 0) + take
            total -= s * take
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, how many, copies by size) of each combination, in order.

    A round ends with one size left fewer times than the combination needs, and a size s can limit a combination at
    most 1 + capacity / s times more, so there are O(capacity log capacity) rounds however many items there are.
    """
    counts = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(counts, reverse=True)
    out, first = [], 1
    while sizes:
        seed = sizes[0]
        counts[seed] -= 1
        combo = fullest(sizes, counts, capacity - seed)
        counts[seed] += 1
        combo[seed] = combo.get(seed, 0) + 1
        times = min(counts[s] // k for s, k in combo.items())
        for s, k in combo.items():
            counts[s] -= k * times
        out.append((first, times, combo))
        first += times
        sizes = [s for s in sizes if counts[s]]
    return out


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", rows_per_bucket: int = 250_000) -> DataFrame:
    """(key, piece_no, n_pieces, start_tok, size, container_id) for each piece of each item in ``sizes``.

    ``sizes`` is read twice, so it should be a written table. Numbering within a size is done per (size, hash bucket)
    with bucket offsets; there are as many buckets as the number of items asks for, so even a size that all of them share
    is numbered in parts of about ``rows_per_bucket``. Items of size 0 are not numbered at all. What is sent to the
    executors is the list of combinations, bounded by the capacity alone.
    """
    spark = sizes.sparkSession
    buckets = max(64, -(-sizes.count() // rows_per_bucket))  # a count of a written table, read from its footers
    items = sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_n"))
    n = F.col("_n")
    full = F.floor(F.greatest(n - 1, F.lit(0)) / capacity)  # pieces before the rest; 0 for what is not split
    items = items.select(key, "_n", full.alias("_full"), (n - full * capacity).alias("_rest"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b"))
    by_bucket = items.where("_rest > 0").groupBy("_rest", "_b").agg(F.count("*").alias("_c"))
    by_bucket = materialise(by_bucket, "sizes")  # at most capacity x buckets rows
    hist = {r["_rest"]: r["n"] for r in bounded_rows(by_bucket.groupBy("_rest").agg(F.sum("_c").alias("n")), capacity, "sizes")}
    plan = minimum_bin_slack(hist, capacity)
    used = max((f + t for f, t, _ in plan), default=1)
    # by size: for runs of numbers the first number, the first container and the copies in each
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    for first, times, combo in plan:
        for s, k in combo.items():
            runs.setdefault(s, []).append((seen.get(s, 0), first, k))
            seen[s] = seen.get(s, 0) + k * times
    table = spark.sparkContext.broadcast({s: np.array(r, np.int64).T for s, r in runs.items()})

    before = Window.partitionBy("_rest").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("_rest", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("_rest", "_b").orderBy(key)
    numbered = items.where("_rest > 0").withColumn("_i", F.row_number().over(inner) - 1).join(offsets, ["_rest", "_b"], "left")
    numbered = numbered.withColumn("_no", F.col("_i") + F.coalesce("_o", F.lit(0)))

    @F.pandas_udf("bigint")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        runs = table.value
        for rest, no in batches:
            rest, no = rest.to_numpy(), no.to_numpy()
            out = np.zeros(len(rest), np.int64)
            for s in np.unique(rest):
                if s > 0:
                    at = rest == s
                    begin, first, copies = runs[int(s)]
                    j = np.searchsorted(begin, no[at], "right") - 1
                    out[at] = first[j] + (no[at] - begin[j]) // copies[j]
            yield pd.Series(out)

    nothing = items.where("_rest = 0").select(key, F.col("_full"), F.col("_rest"), F.lit(0).cast("bigint").alias("container_id"))
    rests = numbered.select(key, F.col("_full"), F.col("_rest"), place("_rest", "_no").alias("container_id")).unionByName(nothing)
    # full pieces have containers of their own, numbered from the last of the rests on
    whole = items.where("_full > 0")
    per = materialise(whole.groupBy("_b").agg(F.sum("_full").alias("_c")), "full")
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    at = per.select("_b", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_o"))
    own = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        whole.withColumn("_p", F.coalesce(F.sum("_full").over(own), F.lit(0)))
        .join(at, "_b")
        .select(key, "_full", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)).alias("_k"), (F.col("_p") + F.col("_o") + used).alias("_at"))
        .select(
            key, F.col("_k").cast("int").alias("piece_no"), (F.col("_full") + 1).cast("int").alias("n_pieces"), (F.col("_k") * capacity).alias("start_tok"),
            F.lit(capacity).cast("bigint").alias("size"), (F.col("_at") + F.col("_k")).alias("container_id"),
        )
    )
    return rests.select(
        key, F.col("_full").cast("int").alias("piece_no"), (F.col("_full") + 1).cast("int").alias("n_pieces"), (F.col("_full") * capacity).alias("start_tok"),
        F.col("_rest").alias("size"), "container_id",
    ).unionByName(pieces)


def container_capacity(limits: DataFrame) -> int:
    return read_limits(limits, "container", "tokens")["*"][0]


def pack_documents(documents: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", vocab_file: str = "byte_bpe_50k.tiktoken", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """Containers for the texts of ``documents``, measured in tokens, by the container row of ``limits``."""
    sizes = materialise(bpe.count_tokens(documents, key, text, vocab_file, folder), "tokens")
    return pack(sizes, container_capacity(limits), key, "n_tokens")
