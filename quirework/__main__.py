"""Command line: ``python -m quirework run|query|queries``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, fields, replace
from pathlib import Path

from pyspark.sql import functions as F

from quirework.config import RunConfig
from quirework.functions.tokens import bpe_counter, word_counter
from quirework.operators.generate import extractive_generator, http_generator
from quirework.plans import catalog
from quirework.plans.pipeline import Engine
from quirework.session import build_session, ship
from quirework.sources import documents


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirework", description="Paged documents to instruction-tuning datasets.")
    p.add_argument("--master", help="Spark master; the default is that of the environment")
    todo = p.add_subparsers(dest="todo", required=True)
    run = todo.add_parser("run", help="a whole run")
    run.add_argument("paths", nargs="*", help="PDF files")
    run.add_argument("--pages", help="a parquet table of pages (source_doc, page_num, text, tables) instead of files")
    run.add_argument("--generator", choices=["extractive", "http"], default="extractive")
    run.add_argument("--ranks", help="byte-pair ranks by which tokens are counted; words without")
    run.add_argument("--parts", help="shared folder for part files instead of single files")
    run.add_argument("--ignore-errors", action="store_true", help="go on past files that cannot be read")
    run.add_argument("--document-block", type=int)
    run.add_argument("--chunk-block", type=int)
    for f in fields(RunConfig):
        if f.type in ("str", "int", "float"):
            run.add_argument("--" + f.name.replace("_", "-"), type={"str": str, "int": int, "float": float}[f.type])
    todo.add_parser("queries", help="names of the queries")
    query = todo.add_parser("query", help="one query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--out", help="parquet folder for the result; without, 20 rows are shown")
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    found = catalog.queries()
    if a.todo == "queries":
        print("\n".join(sorted(found)))
        return 0
    if a.todo == "query" and a.name not in found:
        print(f"no query {a.name}", file=sys.stderr)
        return 2
    spark = ship(build_session("quirework", a.master))
    if a.todo == "query":
        df = found[a.name](spark, a.folder)
        if a.out:
            df.write.parquet(a.out)
        else:
            df.show(20, truncate=80)
        return 0
    if bool(a.paths) == bool(a.pages):
        print("name either files or a table of pages", file=sys.stderr)
        return 2
    given = {f.name: getattr(a, f.name) for f in fields(RunConfig) if getattr(a, f.name, None) is not None}
    config = replace(RunConfig(), **given)
    if a.paths:
        docs = documents.queue(spark, a.paths)
        read = documents.read_pdf(spark, docs, ignore_errors=a.ignore_errors)
        pages = documents.raw_pages(read)
        for row in documents.failed_files(read).toLocalIterator():
            print(f"{row['path']}: {row['error']}", file=sys.stderr)
    else:
        table = spark.read.parquet(a.pages)
        names = table.select("source_doc").where("source_doc IS NOT NULL").distinct().withColumn("path", F.col("source_doc"))
        docs = names.withColumn("doc_seq", (F.dense_rank().over(documents.by_name()) - 1).cast("int"))
        pages = documents.read_pages(table)
    engine = Engine(spark, config, generator=http_generator if a.generator == "http" else extractive_generator, count=bpe_counter(a.ranks) if a.ranks else word_counter)
    tell = lambda event: print(event.stage, event.current_task, json.dumps(event.counts), file=sys.stderr)
    result = engine.run(pages, docs, progress=tell, document_block=a.document_block, chunk_block=a.chunk_block, parts_dir=a.parts and (a.parts if "://" in a.parts else f"file://{Path(a.parts).resolve()}"))
    print(json.dumps(asdict(result)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
