"""``python -m corpuscle.cli``: the verbs over a folder or over parquet tables."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .functions import match, paths
from .operators import corpus, edges, extract, grep, lookup, search
from .session import local_session, table
from .sources import workspace


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpuscle")
    p.add_argument("--root", help="a folder to search")
    p.add_argument("--tables", help="a folder of parquet tables")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, args in {
        "files": ["--dir"], "glob": ["pattern"], "grep": ["pattern", "--glob", "--regex", "--case", "--output"], "find": ["query", "--kind"], "refs": ["name"], "importers": ["file"],
        "symbols": ["file"], "outline": ["file"], "read": ["target"], "stats": [], "structure": [], "packages": [],
    }.items():
        s = sub.add_parser(verb)
        for a in args:
            s.add_argument(a, **({"action": "store_true"} if a in ("--regex", "--case") else {}))
        s.add_argument("--limit", type=int)
        s.add_argument("--offset", type=int, default=0)
    a = p.parse_args(argv)
    if not a.root and not a.tables:
        p.error("--root or --tables is needed")
    spark = local_session()
    if a.root:
        files = workspace.from_folder(spark, a.root, "root").withColumn("symbols", F.lit(None).cast("array<struct<name:string>>")).withColumn("parsed", F.lit(None).cast("boolean")).cache()
        symbols = extract.extract_files(files).where("reason IS NULL").cache()
    else:
        files, symbols = table(spark, a.tables, "files"), table(spark, a.tables, "symbols")
    limit = lookup.limit_of(a.verb, a.limit)
    rel = F.col("rel")
    if a.verb == "read":
        out = [lookup.read(files, symbols, a.target)]
    elif a.verb == "outline":
        by, rows = lookup.outline(files, symbols, lookup.file_of(files, a.file) or a.file)
        out = [{"by": by, "rows": rows[: limit or None]}]
    else:
        df = {
            "files": lambda: files.select("ws", "rel", "size", "lines", "lang").distinct().where(paths.in_dir(rel, a.dir) if a.dir else F.lit(True)).orderBy("ws", "rel"),
            "glob": lambda: files.select("ws", "rel", "size").distinct().where(paths.PathMatcher(include=tuple(paths.split_list(a.pattern))).column(rel)).orderBy("ws", "rel"),
            "grep": lambda: _grep(files, a),
            "find": lambda: search.find(files, symbols, a.query, a.kind),
            "refs": lambda: grep.references(files, symbols, a.name).orderBy(F.expr("array_position(array('local', 'imported', 'textual'), label)"), "ws", "rel", "ln"),
            "importers": lambda: edges.importers(edges.edges(files).cache()).where(F.col("target") == a.file).orderBy("file", "line"),
            "symbols": lambda: symbols.where(F.col("file") == a.file).select("name", "kind", "path", "line_start", "line_end", "signature").distinct().orderBy("line_start", "path"),
            "stats": lambda: files.select("rel", "indexed").distinct().groupBy(paths.lang_of(rel).alias("lang")).agg(F.count("*").alias("files")).orderBy("lang"),
            "structure": lambda: corpus.content(files).groupBy(paths.dirname(rel).alias("dir")).agg(F.count("*").alias("files")).orderBy("dir"),
            "packages": lambda: lookup.packages(files).orderBy("name"),
        }[a.verb]()
        pg = lookup.page(df, limit, a.offset)
        out = [r.asDict(True) for r in pg.rows]
        print(f"{pg.total} in all" + (f", next from {pg.next}" if pg.next is not None else ""), file=sys.stderr)
    for row in out:
        print(json.dumps(row, ensure_ascii=False, default=str) if a.json else "\t".join(str(v) for v in row.values() if v is not None))
    return 0


def _grep(files, a):
    m = match.compile_matcher(a.pattern, a.regex, a.case or False)
    where = paths.PathMatcher(include=tuple(paths.split_list(a.glob))) if a.glob else None
    if a.output == "matches":
        return grep.tally(files, m).orderBy(F.desc("count"), "text")
    hits = grep.matching_lines(files, m, where)
    return hits.groupBy("ws", "rel").agg(F.count("*").alias("count")).orderBy("ws", "rel") if a.output == "files" else hits.orderBy("ws", "rel", "ln")


if __name__ == "__main__":
    sys.exit(main())
