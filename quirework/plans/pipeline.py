"""The whole run: pages to chunks to records to splits to files."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.config import RunConfig
from quirework.functions.tokens import Counter, word_counter
from quirework.operators import chunks as C
from quirework.operators import gate as G
from quirework.operators.generate import Generator, build_candidates, extractive_generator
from quirework.operators.pages import clean_pages
from quirework.operators.split import split_counts, split_records
from quirework.session import cut_lineage
from quirework.sinks import export


@dataclass
class Progress:
    """``counts``: pages_done, documents_done, chunks_created, done and total (chunks), examples_generated, tokens_used,
    qc_passed, qc_rejected, as far as they are known."""

    stage: str
    current_task: str = ""
    counts: dict = field(default_factory=dict)


@dataclass
class RunResult:
    total_pages: int = 0
    total_chunks: int = 0
    total_examples_generated: int = 0
    total_qc_passed: int = 0
    total_qc_rejected: int = 0
    total_tokens_used: int = 0
    split_counts: dict = field(default_factory=dict)
    output_dir: str = ""
    review_workbook_path: str = ""
    stopped: bool = False


def with_documents(raw_pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages with their ``doc_seq``. Pages that know their file by name only belong to every document of that name."""
    return raw_pages if "doc_seq" in raw_pages.columns else raw_pages.join(documents.select("doc_seq", "source_doc"), "source_doc")


class Engine:
    """Composes the stages. Every stage is lazy but for chunking and generation, which are written once."""

    def __init__(self, spark: SparkSession, config: RunConfig = RunConfig(), *, generator: Generator = extractive_generator, count: Counter = word_counter, split_mode: str = "hash"):
        self.spark, self.config, self.generator, self.count, self.split_mode = spark, config, generator, count, split_mode

    def chunks(self, raw_pages: DataFrame, documents: DataFrame) -> DataFrame:
        pages = clean_pages(with_documents(raw_pages, documents), self.config)
        return C.number_chunks(C.chunk_pages(pages, self.config, self.count), documents)

    def run(
        self, raw_pages: DataFrame, documents: DataFrame, *, progress: Callable[[Progress], None] | None = None, stop: threading.Event | None = None,
        document_block: int | None = None, chunk_block: int | None = None, parts_dir: str | None = None,
    ) -> RunResult:
        """All stages and all files.

        A set ``stop`` ends extraction or generation before its next block, and what is done by then is gated, split
        and exported; work that runs is cancelled by the caller through Spark's job tags. ``document_block`` and
        ``chunk_block`` are the numbers of documents and of chunks of a block (all at once by default). With
        ``parts_dir``, a folder that all executors share, the training files are part files there and no row passes
        the driver; without it they are single files and a workbook in the run's folder. Rejected records and skipped
        chunks are part files with their reasons, beside the training files.
        """
        tell, stop = progress or (lambda event: None), stop or threading.Event()
        ordered = documents.orderBy("doc_seq").select("path")
        paths = lambda: (r["path"] for r in ordered.toLocalIterator())
        result = RunResult(output_dir=export.create_run_dir(self.config.output_dir, paths(), self.config.model_name))
        counts: dict = {"pages_done": 0, "documents_done": 0, "chunks_created": 0}
        raw, packed = with_documents(raw_pages, documents), []
        for low, high in self._blocks(documents, "doc_seq", document_block):
            if stop.is_set():
                result.stopped = True
                break
            pages = cut_lineage(clean_pages(raw.where(F.col("doc_seq").between(low, high - 1)), self.config))
            counts["pages_done"] += pages.count()
            tell(Progress("extract", "pages", dict(counts)))
            packed.append(cut_lineage(C.chunk_pages(pages, self.config, self.count)))
            counts["chunks_created"] += packed[-1].count()
            counts["documents_done"] += documents.where(F.col("doc_seq").between(low, high - 1)).count()
            tell(Progress("extract", "chunks", dict(counts)))
        if not packed:
            packed.append(cut_lineage(C.chunk_pages(clean_pages(raw.where("false"), self.config), self.config, self.count)))
        made = cut_lineage(C.number_chunks(reduce(DataFrame.unionByName, packed), documents))
        result.total_pages, result.total_chunks = counts["pages_done"], counts["chunks_created"]
        counts |= {"done": 0, "total": result.total_chunks, "examples_generated": 0, "tokens_used": 0}
        told, asked = [], []
        for low, high in self._blocks(made, "chunk_seq", chunk_block):
            if stop.is_set():
                result.stopped = True
                break
            candidates, primary = build_candidates(made.where(F.col("chunk_seq").between(low, high - 1)), self.config, self.generator)
            told.append(cut_lineage(candidates))
            asked.append(primary)
            done = primary.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
            counts["done"], counts["tokens_used"] = counts["done"] + done["n"], counts["tokens_used"] + done["tokens"]
            counts["examples_generated"] += told[-1].count()
            tell(Progress("generate", "chunks", dict(counts)))
        if not told:
            candidates, primary = build_candidates(made.where("false"), self.config, self.generator)
            told, asked = [candidates], [primary]
        judged = cut_lineage(G.verdicts(reduce(DataFrame.unionByName, told), self.config, self.count))
        row = judged.agg(F.count("*").alias("n"), F.count_if(F.col("reject_reason").isNull()).alias("ok")).first()
        result.total_examples_generated, result.total_qc_passed = row["n"], row["ok"]
        result.total_qc_rejected = row["n"] - row["ok"]
        result.total_tokens_used = counts["tokens_used"]
        tell(Progress("generate", "gate", counts | {"qc_passed": result.total_qc_passed, "qc_rejected": result.total_qc_rejected}))
        accepted = judged.where("reject_reason IS NULL").drop("reject_reason", "q_norm", "a_norm", "chunk_token_count")
        split = cut_lineage(split_records(accepted, self.config, self.split_mode))
        beside = parts_dir or f"file://{result.output_dir}"
        if parts_dir:
            export.write_distributed(split, parts_dir)
        else:
            export.write_jsonl(split, result.output_dir)
            result.review_workbook_path = export.write_workbook(split, result.output_dir)
        judged.where("reject_reason IS NOT NULL").select("record_seq", "chunk_id", "question", "answer", "reject_reason").write.json(f"{beside}/rejected")
        reduce(DataFrame.unionByName, asked).where("skip_reason IS NOT NULL").select("chunk_seq", "chunk_id", "skip_reason").write.json(f"{beside}/skipped")
        result.split_counts = {r["split"]: r["n"] for r in split_counts(split).collect()}
        export.write_run_info(result.output_dir, self.config, paths(), {
            "pages": result.total_pages, "chunks": result.total_chunks, "examples_generated": result.total_examples_generated, "qc_passed": result.total_qc_passed,
            "qc_rejected": result.total_qc_rejected, "tokens_used": result.total_tokens_used, "split_counts": result.split_counts,
        })
        return result

    @staticmethod
    def _blocks(df: DataFrame, key: str, size: int | None) -> Iterator[tuple[int, int]]:
        """Ranges of ``key`` that together hold all rows."""
        ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        if ends["low"] is None:
            return
        step = size or ends["high"] - ends["low"] + 1
        yield from ((low, min(low + step, ends["high"] + 1)) for low in range(ends["low"], ends["high"] + 1, step))
