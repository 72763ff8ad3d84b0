"""Hard sections, atoms, packing with overlap, and chunk ids.

A document is told by ``doc_seq`` where pages have it, so that two files of one name stay apart; else by ``source_doc``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import RunConfig
from quirework.functions import text as T
from quirework.functions.tokens import Counter, word_counter
from quirework.session import cut_lineage

#: Pages, sections or documents of one bucket of a prefix sum.
BUCKET = 1024


def document_columns(df: DataFrame) -> list[str]:
    """The key of a document first, then its label."""
    return [c for c in ("doc_seq", "source_doc") if c in df.columns]


def prefix_sums(df: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, by ``order`` (a whole number), within each group.

    Rows are summed within buckets of the order, and the buckets' sums are added up, so that a group of any size
    is spread over tasks.
    """
    bucketed = df.withColumn("__bucket", F.floor(F.col(order) / BUCKET))
    keys = [*group, "__bucket"]
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    moved = bucketed.groupBy(*keys).agg(F.sum(value).alias("__sum")).withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    moved = moved.select(*[F.col(c).alias(f"__of_{c}") for c in keys], "__offset")
    inner = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = bucketed.withColumn("__here", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return here.join(moved, same_keys(keys)).select(*df.columns, (F.col("__here") + F.col("__offset")).alias(name))


def same_keys(keys: list[str]) -> Column:
    """The condition that columns ``c`` and ``__of_c`` are equal or both null."""
    found = F.lit(True)
    for c in keys:
        found = found & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return found


def hard_sections(pages: DataFrame, config: RunConfig = RunConfig(), order: str = "page_num") -> DataFrame:
    """Document, ``section_id, page_num, piece, para, text``: paragraphs with the section they belong to.

    A cut closes a section only between pieces of one page, so sections run over page ends. The id is the number of
    cuts before, dense in order but not in value: a page's pieces count from the cuts of the pages before it. Only
    these counts are summed over a document.
    """
    doc = document_columns(pages)
    pattern = r"(?U)" + config.hard_cut_pattern.replace(r"\s", T.SPACE)
    cut = T.with_computed(pages.select(*doc, F.col(order).alias("page_num"), "text"), {"__pieces": F.split(T.mark_hard_cuts(F.coalesce("text", F.lit(""))), pattern, -1)}).drop("text")
    per_page = cut.groupBy(doc[0], "page_num").agg(F.sum(F.size("__pieces") - 1).alias("__cuts"))
    offsets = prefix_sums(per_page, [doc[0]], "page_num", "__cuts", "__before")
    offsets = offsets.select(F.col(doc[0]).alias(f"__of_{doc[0]}"), F.col("page_num").alias("__of_page_num"), "__before")
    numbered = cut.join(offsets, same_keys([doc[0], "page_num"]))
    pieces = numbered.select(*doc, "page_num", "__before", F.posexplode("__pieces").alias("piece", "body"))
    return pieces.select(*doc, (F.col("__before") + F.col("piece")).cast("int").alias("section_id"), "page_num", "piece", F.posexplode(T.paragraphs(F.col("body"))).alias("para", "text"))


def atoms(paragraphs: DataFrame, config: RunConfig = RunConfig(), count: Counter = word_counter) -> DataFrame:
    """Paragraphs as they are if within the target, else their sentences, else their lines.

    Columns of ``paragraphs`` stay; ``sent`` and ``line`` order the atoms, ``n`` is their token count. Two narrow
    stages: counts are columns of exploded rows, so any counter, also one in Python, serves.
    """
    target = config.target_chunk_tokens
    counted = T.with_computed(paragraphs, {"n": count(F.col("text"))})
    counted = T.with_computed(counted, {"said": F.when(F.col("n") > target, T.sentences(F.col("text")))})

    def by_lines(part: Column) -> Column:
        found = T.lines(part)
        return F.when(F.size(found) > 1, found).otherwise(F.array(part))

    said = F.col("said")
    first = F.when(F.col("n") <= target, F.array("text")).when(F.size(said) <= 1, by_lines(F.col("text"))).otherwise(said)
    kept = [c for c in counted.columns if c not in ("text", "n", "said")]
    level = T.with_computed(counted.select(*kept, (F.col("n") > target).alias("cut"), F.when(F.col("n") > target, F.size(said) > 1).otherwise(False).alias("many"), F.posexplode(first).alias("sent", "text")), {"n": count(F.col("text"))})
    second = F.when(F.col("cut") & F.col("many") & (F.col("n") > target), by_lines(F.col("text"))).otherwise(F.array("text"))
    return level.select(*kept, "sent", F.posexplode(second).alias("line", "text")).withColumn("n", count(F.col("text")))


class Packer:
    """Greedy packing of units ``(page, text, n)`` in order. A full chunk is closed, and the next begins with its longest
    tail of at most ``overlap`` tokens, but with one unit at least. It holds no more than one chunk."""

    def __init__(self, target: int, overlap: int):
        self.target, self.overlap = target, overlap
        self.units: list[tuple[int, str, int]] = []
        self.total = 0

    def add(self, page: int, text: str, n: int) -> tuple[int, int, str] | None:
        """The chunk that the unit closes, if any."""
        full = self.close() if self.units and self.total + n > self.target else None
        if full:
            keep, room = 1, self.overlap - self.units[-1][2]
            while keep < len(self.units) and room >= (size := self.units[-1 - keep][2]):
                keep, room = keep + 1, room - size
            self.units = self.units[-keep:]
            self.total = sum(u[2] for u in self.units)
        self.units.append((page, text, n))
        self.total += n
        return full

    def close(self) -> tuple[int, int, str] | None:
        return (self.units[0][0], self.units[-1][0], " ".join(u[1] for u in self.units)) if self.units else None


def pack_sections(units: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """Document, ``section_id, pos, page_start, page_end, text`` of the chunks of each section.

    Rows stream through a task in their order; a task holds one open chunk, so a section of any length is no
    burden, and the sections of a document are spread over tasks.
    """
    doc = document_columns(units)
    order = [c for c in ("page_num", "piece", "para", "sent", "line", "pos") if c in units.columns]
    target, overlap = config.target_chunk_tokens, config.overlap_tokens
    kinds = dict(units.dtypes)
    names = [*doc, "section_id", "pos", "page_start", "page_end", "text"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in doc) + ", section_id int, pos int, page_start int, page_end int, text string"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packer, pos, kept = None, None, 0, []
        types = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def keep(chunk) -> None:
            nonlocal pos
            if chunk:
                kept.append((*key, pos, *chunk))
                pos += 1

        for batch in batches:
            types = [*(batch.column(k).type for k in range(len(doc))), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                own, (page, text, n) = row[: len(doc) + 1], row[len(doc) + 1 :]
                if own != key:
                    if packer:
                        keep(packer.close())
                    key, packer, pos = own, Packer(target, overlap), 0
                keep(packer.add(page, text, n))
            if kept:
                yield batch_of(kept)
                kept.clear()
        if packer:
            keep(packer.close())
            if kept:
                yield batch_of(kept)

    sorted_units = units.repartition(doc[0], "section_id").sortWithinPartitions(doc[0], "section_id", *order)
    return sorted_units.select(*doc, F.col("section_id").cast("int"), F.col("page_num").cast("int"), "text", F.col("n").cast("int")).mapInArrow(pack, schema)


def table_chunks(pages: DataFrame) -> DataFrame:
    """One candidate chunk for each table, never cut or overlapped."""
    return pages.select(*document_columns(pages), "page_num", F.posexplode("tables").alias("pos", "text"))


def chunk_pages(pages: DataFrame, config: RunConfig = RunConfig(), count: Counter = word_counter) -> DataFrame:
    """``CHUNKS`` without ``chunk_seq``: tables first, then sections; counts within bounds; dense ids per document.

    What is packed and counted is written once; numbering reads it from there.
    """
    doc = document_columns(pages)
    tables = table_chunks(pages).select(*doc, F.lit(True).alias("is_table"), F.col("page_num").cast("int").alias("k1"), F.col("pos").alias("k2"), F.col("page_num").cast("int").alias("page_start"), F.col("page_num").cast("int").alias("page_end"), "text")
    packed = pack_sections(atoms(hard_sections(pages, config), config, count), config)
    texts = packed.select(*doc, F.lit(False).alias("is_table"), F.col("section_id").alias("k1"), F.col("pos").alias("k2"), "page_start", "page_end", "text")
    kept = T.with_computed(tables.unionByName(texts), {"token_count": count(F.col("text"))}).where(F.col("token_count").between(config.min_chunk_tokens, config.max_chunk_tokens))
    numbered = _rows_of_documents(cut_lineage(kept), doc[0])
    named = numbered.withColumn("chunk_id", F.format_string("%s_c%05d", T.stem(F.col("source_doc")), F.col("row")))
    return named.select("chunk_id", *doc, "page_start", "page_end", "text", "is_table", "token_count", "row")


def _rows_of_documents(kept: DataFrame, key: str) -> DataFrame:
    """``row`` from 1 within each document: tables first, then by ``k1, k2``. Only counts by ``k1`` are summed over a document."""
    places = kept.groupBy(key, "is_table", "k1").agg(F.count("*").alias("__n"))
    tables = places.where("is_table").groupBy(F.col(key).alias(f"__of_{key}")).agg(F.sum("__n").alias("__tables"))
    before = prefix_sums(places, [key, "is_table"], "k1", "__n", "__before").join(tables, same_keys([key]), "left")
    offset = F.col("__before") + F.when(F.col("is_table"), 0).otherwise(F.coalesce("__tables", F.lit(0)))
    keys = [key, "is_table", "k1"]
    offsets = before.select(*[F.col(c).alias(f"__of_{c}") for c in keys], offset.alias("__offset"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy("k2"))
    return kept.withColumn("__row", inner).join(offsets, same_keys(keys)).drop(*[f"__of_{c}" for c in keys]).withColumn("row", (F.col("__row") + F.col("__offset")).cast("int")).drop("__row", "__offset")


def number_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunk_seq`` over all documents, in document order: a prefix sum over per-document counts (one row a
    document) added to the number within the document, so that no sort of all chunks is needed."""
    key = document_columns(chunks)[0]
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    if key != "doc_seq":
        counts = counts.join(documents.groupBy(key).agg(F.min("doc_seq").alias("doc_seq")), key)
    counts = counts.withColumn("__all", F.lit(0))
    offsets = prefix_sums(counts, ["__all"], "doc_seq", "chunks", "__offset").select(key, "__offset")
    return chunks.join(offsets, key).withColumn("chunk_seq", F.col("__offset") + F.col("row") - 1).drop("__offset", "row")
