"""Sources: document lists, paged documents, the generation service's models, and accelerator memory."""

from __future__ import annotations

import json
import subprocess
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quirework.functions import text as T


def queue(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``DOCUMENTS`` of the distinct paths, in the order in which they were first named."""
    rows = list(enumerate(dict.fromkeys(paths)))
    return spark.createDataFrame(rows, "doc_seq int, path string").withColumn("source_doc", T.base_name(F.col("path")))


def distinct_documents(files: DataFrame, order: str = "doc_seq", path: str = "path") -> DataFrame:
    """One row a path, with the smallest position; for queues that are tables."""
    return files.groupBy(path).agg(F.min(order).alias(order)).withColumn("source_doc", T.base_name(F.col(path)))


def by_name():
    """Documents in the order of their names, for page tables without a queue (one short row a document)."""
    return Window.orderBy("source_doc")


def read_pages(pages: DataFrame, order: str | None = None) -> DataFrame:
    """``source_doc, page_num, raw_text, tables`` of a page table; pages delivered twice count once.

    With ``order``, pages are numbered within their document by that column instead of ``page_num``.
    """
    if order:
        pages = pages.withColumn("page_num", F.row_number().over(Window.partitionBy("source_doc").orderBy(order)))
    return pages.dropDuplicates(["source_doc", "page_num"]).select("source_doc", F.col("page_num").cast("int"), F.col("text").alias("raw_text"), "tables")


def read_pdf(spark: SparkSession, documents: DataFrame, *, ignore_errors: bool = False, count_only: bool = False) -> DataFrame:
    """``doc_seq, source_doc`` of ``DOCUMENTS`` with the pages of their files (``page_num, page_count, blocks, tables, error``).

    An unreadable file fails the read, or with ``ignore_errors`` gives one row with its error. ``count_only`` opens
    the files but reads no page.
    """
    spark.dataSource.register(PdfSource)
    paths = json.dumps([r["path"] for r in documents.select("path").toLocalIterator()])
    read = spark.read.format("pages").option("paths", paths).option("ignore_errors", str(ignore_errors).lower()).option("count_only", str(count_only).lower()).load()
    return documents.select("doc_seq", "path", "source_doc").join(read, "path")


def raw_pages(read: DataFrame) -> DataFrame:
    """``RAW_PAGES`` (tables as texts) of ``read_pdf``: blocks that no kept table's box overlaps, in their order, and tables of
    at least two rows. All on the row of a page."""
    kept = F.filter("tables", lambda t: F.size(t["rows"]) >= 2)
    over = lambda b, t: (b["x0"] < t["x1"]) & (t["x0"] < b["x1"]) & (b["y0"] < t["y1"]) & (t["y0"] < b["y1"])
    free = F.filter("blocks", lambda b: ~F.exists("__kept", lambda t: over(b, t)))
    pages = read.where("error IS NULL AND page_num IS NOT NULL").withColumn("__kept", kept)
    ordered = F.transform(F.array_sort(F.transform(free, lambda b: F.struct(b["block_no"].alias("k"), b["text"].alias("t")))), lambda b: b["t"])
    tables = F.transform("__kept", lambda t: T.table_text(t["rows"]))
    return pages.select("doc_seq", "source_doc", "page_num", F.array_join(ordered, "\n").alias("raw_text"), tables.alias("tables"))


def failed_files(read: DataFrame) -> DataFrame:
    """``doc_seq, path, error`` of the files that could not be read."""
    return read.where("error IS NOT NULL").select("doc_seq", "path", "error")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PdfSource(DataSource):
    """``spark.read.format("pages")``: pages of PDF files, one task a file; needs the optional library ``pymupdf``.

    Options: ``paths`` (a JSON list), ``ignore_errors``, ``count_only``. Columns: path, page_num, page_count, blocks, tables,
    error. Unreadable files fail the read unless ``ignore_errors`` is ``true``; then they give a row with the error. With
    ``count_only`` there is one row a file, with its number of pages, and no page is parsed.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return (
            "path string, page_num int, page_count int, blocks array<struct<block_no:int,x0:double,y0:double,x1:double,y1:double,text:string>>, "
            "tables array<struct<x0:double,y0:double,x1:double,y1:double,rows:array<array<string>>>>, error string"
        )

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PdfReader(self.options)


class _PdfReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options.get("paths", "[]"))
        self.ignore = options.get("ignore_errors", "false").lower() == "true"
        self.count_only = options.get("count_only", "false").lower() == "true"

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        import pymupdf

        try:
            with pymupdf.open(partition.path) as doc:
                if self.count_only:
                    yield partition.path, None, doc.page_count, [], [], None
                    return
                for page in doc:
                    yield partition.path, page.number + 1, doc.page_count, self.blocks(page), self.tables(page), None
        except Exception as error:
            if not self.ignore:
                raise
            yield partition.path, None, None, [], [], f"{type(error).__name__}: {error}"

    @staticmethod
    def blocks(page) -> list[tuple]:
        return [(k, *map(float, b[:4]), b[4]) for k, b in enumerate(page.get_text("blocks"))]

    @staticmethod
    def tables(page) -> list[tuple]:
        """Tables that can be read; one that cannot is left out."""
        found = []
        try:
            tables = page.find_tables().tables
        except Exception:
            return found
        for table in tables:
            try:
                found.append((*map(float, table.bbox), table.extract()))
            except Exception:
                continue
        return found


def page_counts(pages: DataFrame) -> DataFrame:
    """``path, page_count`` from a read of the page source, best one with ``count_only``."""
    return pages.where("error IS NULL").groupBy("path").agg(F.max("page_count").alias("page_count"))


def is_reachable(host: str, timeout: float = 3.0) -> bool:
    try:
        with urllib.request.urlopen(f"{host}/api/tags", timeout=timeout) as response:
            return response.status < 400
    except OSError:
        return False


def list_models(host: str) -> list[str]:
    """Names of the models that the service offers; none if it cannot be asked."""
    try:
        with urllib.request.urlopen(f"{host}/api/tags", timeout=10) as response:
            return [m["name"] for m in json.loads(response.read()).get("models", [])]
    except OSError:
        return []


def model_names(responses: DataFrame, column: str = "raw") -> DataFrame:
    """``name`` of each model in a table of such answers; malformed ones have none."""
    parsed = F.from_json(column, "models array<struct<name:string>>")
    return responses.select(F.explode(parsed["models"]["name"]).alias("name"))


def sum_memory(lines: DataFrame, column: str = "value") -> DataFrame:
    """``used_mb, total_mb`` over lines ``used, total``; lines of another form are skipped, and nothing is
    returned where the total is not positive."""
    cells = F.transform(F.split(column, ","), lambda c: F.trim(c).try_cast("double"))
    good = lines.select(cells.alias("c")).where((F.size("c") == 2) & F.col("c")[0].isNotNull() & F.col("c")[1].isNotNull())
    return good.agg(F.sum(F.col("c")[0]).alias("used_mb"), F.sum(F.col("c")[1]).alias("total_mb")).where("total_mb > 0")


def read_memory(spark: SparkSession) -> tuple[float, float] | None:
    """Memory of the driver's accelerators, or none."""
    try:
        found = subprocess.run(["nvidia-smi", "--query-gpu=memory.used,memory.total", "--format=csv,noheader,nounits"], capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return None
    if found.returncode:
        return None
    row = sum_memory(spark.createDataFrame([(x,) for x in found.stdout.splitlines()] or [("",)], "value string")).first()
    return (row["used_mb"], row["total_mb"]) if row else None

