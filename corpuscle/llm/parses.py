"""Source files that do not parse: a flag, all errors and the first cause per file, and rates.

Each file is parsed whole by the recursive-descent parser of the language that its extension names (``corpuscle.syntax``),
whatever ``lang``, ``parsed`` and ``reason`` say. No other parser has a say.

Cases: null content is not judged and gives no row, and neither do files of other extensions. Empty content is valid but
in Go (no package clause) and JSON (no value). A byte order mark is skipped, but not in JSON. Nesting of any depth is
parsed. Repeated (ws, rel) rows come out once each if they say the same. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, table_lang
from ..syntax import syntax_errors

SCHEMA = "ws string, rel string, lang string, valid boolean, first_line int, first_cause string, errors array<struct<line:int,cause:string>>"


def check_syntax(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` with content and one of the eight extensions. A narrow map over three columns."""
    todo = files.select("ws", "rel", table_lang(F.col("rel")).alias("lang"), "content").where("lang <> '*' AND content IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ws, rel, lang, text in pdf.itertuples(index=False):
                e = syntax_errors(lang, text)
                rows.append((ws, rel, lang, not e, e[0][0] if e else None, e[0][1] if e else None, [{"line": a, "cause": c} for a, c in e]))
            out = pd.DataFrame(rows, columns=["ws", "rel", "lang", "valid", "first_line", "first_cause", "errors"])
            out["first_line"] = out["first_line"].astype("Int32")
            yield out

    return spread(todo).mapInPandas(run, SCHEMA)


def rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and the rate per workspace and language, with totals over each and over all (null)."""
    per = checked.groupBy("ws", "rel", "lang").agg(F.min("valid").alias("valid"))
    out = per.cube("ws", "lang").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.round(1 - F.avg(F.col("valid").cast("int")), 6).alias("rate"),
    )
    return out
