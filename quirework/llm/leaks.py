"""Problem 8: evaluation passages inside training text, by suffix arrays over corpus shards.

Every task cuts its documents into shards of bounded word count, builds a word-level suffix array of each
shard, and binary-searches every suffix of every evaluation item in it. The range of corpus suffixes that
agree on the first ``min_words`` words gives all locations; each left-maximal one is extended to its longest
verbatim match. The suffix order needs no more depth than the longest item, so prefix doubling stops there.
Words are compared as 64-bit hashes.

Defined cases: null, empty and short texts and items give no match; matches never run across documents;
repeated documents each count under their own id; an item delivered twice counts once; a document longer
than a shard is cut into windows that overlap by the longest item, which loses no match; empty tables give
no rows.

The items are a stated query set against all rows: they are sent in blocks of bounded size, and each shard's array is
built once and searched for all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import words

MIN_WORDS = 10
#: Words of one shard; a worker holds about 60 bytes for each.
SHARD_WORDS = 1_000_000
#: Words of evaluation items that one broadcast holds.
BLOCK_WORDS = 2_000_000
#: Locations that are extended at once.
EXTEND_ROWS = 200_000


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``tokens`` (non-negative), sorted by their first ``depth`` tokens or more."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order] = np.concatenate([[1], 1 + np.cumsum(tokens[order[1:]] != tokens[order[:-1]])])
    step = 1
    while step < depth and rank[order[-1]] < n:
        key = rank * (n + 1)
        key[:-step] += rank[step:]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        step *= 2
    return order


class Items:
    """Evaluation items as one token array with the start of every suffix of at least ``min_words`` words."""

    def __init__(self, ids: list, tokens: list[np.ndarray], min_words: int):
        keep = [k for k, t in enumerate(tokens) if len(t) >= min_words]
        self.ids = [ids[k] for k in keep]
        lengths = np.array([len(tokens[k]) for k in keep], np.int64)
        self.tokens = np.concatenate([tokens[k] for k in keep]) if keep else np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        self.depth = int(lengths.max()) if keep else 0
        self.at = np.concatenate([np.arange(a, b - min_words + 1) for a, b in zip(starts, ends)]) if keep else np.zeros(0, np.int64)
        self.item = np.searchsorted(ends, self.at, side="right")
        self.start, self.end = starts[self.item] if keep else starts, ends[self.item] if keep else ends


def _bound(prefix: np.ndarray, flat: np.ndarray, order: np.ndarray, upper: bool) -> np.ndarray:
    """For each row of ``prefix`` the first place in ``order`` whose suffix is not smaller (or is greater)."""
    width = np.arange(prefix.shape[1])
    lo, hi = np.zeros(len(prefix), np.int64), np.full(len(prefix), len(order), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        found = flat[order[np.minimum(mid, len(order) - 1)][:, None] + width]
        differs = found != prefix
        first = differs.argmax(1)
        row = np.arange(len(prefix))
        sign = np.where(differs.any(1), np.sign(found[row, first] - prefix[row, first]), 0)
        right = (sign <= 0) if upper else (sign < 0)
        lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


class Shard:
    """Documents as one array of ranks with its suffix array, built once for all items."""

    def __init__(self, docs: list[np.ndarray], depth: int):
        self.lengths = np.array([len(d) for d in docs], np.int64)
        text = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.int64))])
        real = np.ones(len(text), bool)
        self.ends = np.cumsum(self.lengths + 1)
        real[self.ends - 1] = False
        self.known = np.unique(text[real])
        self.flat = np.zeros(len(text) + depth + 1, np.int64)
        self.flat[: len(text)][real] = 2 * (np.searchsorted(self.known, text[real]) + 1)
        self.order = suffix_array(self.flat[: len(text)], depth)


def search_shard(shard: Shard, items: Items, min_words: int, extend_rows: int = EXTEND_ROWS) -> Iterator[tuple[np.ndarray, ...]]:
    """``doc index, item index, words, word of the document, word of the item`` of left-maximal matches."""
    if not len(items.at) or not len(shard.known):
        return
    flat, order, known, lengths, ends = shard.flat, shard.order, shard.known, shard.lengths, shard.ends
    near = np.searchsorted(known, items.tokens)
    hit = (near < len(known)) & (known[np.minimum(near, len(known) - 1)] == items.tokens)
    query = np.where(hit, 2 * (near + 1), 2 * near + 1)
    whole = np.concatenate([[0], np.cumsum(hit)])
    live = np.flatnonzero(whole[items.at + min_words] - whole[items.at] == min_words)
    if not len(live):
        return
    prefix = query[items.at[live][:, None] + np.arange(min_words)]
    lo, hi = _bound(prefix, flat, order, False), _bound(prefix, flat, order, True)
    live, lo, hi = live[hi > lo], lo[hi > lo], hi[hi > lo]
    counts = hi - lo
    block = 0
    while block < len(live):
        stop = max(block + 1, int(np.searchsorted(np.cumsum(counts[block:]), extend_rows)) + block)
        for shift in range(0, int(counts[block:stop].max()), extend_rows):
            size = np.clip(counts[block:stop] - shift, 0, extend_rows)
            which = np.repeat(live[block:stop], size)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pos = order[np.repeat(lo[block:stop] + shift, size) + inner]
            at, begin, end = items.at[which], items.start[which], items.end[which]
            left = (at > begin) & (pos > 0) & (flat[pos - 1] == query[at - 1])
            which, pos, at, begin, end = which[~left], pos[~left], at[~left], begin[~left], end[~left]
            length = np.full(len(pos), min_words, np.int64)
            grows = np.arange(len(pos))
            while len(grows):
                here = at[grows] + length[grows]
                inside = here < end[grows]
                grows = grows[inside]
                here = here[inside]
                grows = grows[flat[pos[grows] + length[grows]] == query[here]]
                length[grows] += 1
            doc = np.searchsorted(ends, pos, side="right")
            yield doc, items.item[which], length, pos - (ends[doc] - lengths[doc] - 1), at - begin
        block = stop


def _best(found: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The longest match of each document and item, the first of equals; columns as they come."""
    best = tuple(np.zeros(0, np.int64) for _ in range(5))
    for columns in found:
        doc, item, n, at_doc, at_item = (np.concatenate(pair) for pair in zip(best, columns))
        order = np.lexsort((at_item, at_doc, -n, item, doc))
        doc, item = doc[order], item[order]
        first = np.ones(len(order), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        kept = order[first]
        best = (doc[first], item[first], n[kept], at_doc[kept], at_item[kept])
    return best


def _blocks(items: DataFrame, item_id: str, min_words: int, block_words: int) -> Iterator[Items]:
    ids, tokens, held = [], [], 0
    for row in items.toLocalIterator():
        if held + len(row["__words"]) > block_words and ids:
            yield Items(ids, tokens, min_words)
            ids, tokens, held = [], [], 0
        ids.append(row[item_id])
        tokens.append(np.array(row["__words"], np.int64))
        held += len(row["__words"])
    if ids:
        yield Items(ids, tokens, min_words)


def find_leaks(corpus: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, extend_rows: int = EXTEND_ROWS) -> DataFrame:
    """``doc_id, item_id, match_words, doc_word, item_word``: the longest verbatim match of each document
    with each item that shares at least ``min_words`` consecutive words, and where it begins in both."""
    spark = corpus.sparkSession
    hashed = lambda df, key: df.select(F.col(key), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("__words")).where(F.size("__words") >= min_words)
    docs = hashed(corpus, doc_id)
    id_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{doc_id}` {id_type}, `{item_id}` {item_type}, match_words int, doc_word int, item_word int"
    sent, depth = [], 0
    for block in _blocks(hashed(items.dropDuplicates([item_id]), item_id), item_id, min_words, block_words):
        sent.append(spark.sparkContext.broadcast(block))
        depth = max(depth, block.depth)
    width = max(shard_words, 4 * depth)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []
        shifts: list[int] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            shard = Shard(parts, depth)
            for block in sent:
                doc, item, n, at_doc, at_item = _best(search_shard(shard, block.value, min_words, extend_rows))
                if len(doc):
                    own = pa.array(block.value.ids)
                    columns = [pa.array(ids, kinds[0]).take(pa.array(doc)), own.take(pa.array(item)), *(pa.array(c.astype(np.int32)) for c in (n, np.array(shifts)[doc] + at_doc, at_item))]
                    yield pa.RecordBatch.from_arrays(columns, [doc_id, item_id, "match_words", "doc_word", "item_word"])

        for batch in batches:
            kinds = [batch.column(0).type]
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            for k, key in enumerate(batch.column(0).to_pylist()):
                own = values[offsets[k] : offsets[k + 1]]
                for a in range(0, max(1, len(own) - depth), width - depth):
                    part = own[a : a + width]
                    if held + len(part) > width and parts:
                        yield from flush()
                        ids, parts, shifts, held = [], [], [], 0
                    ids.append(key)
                    parts.append(part)
                    shifts.append(a)
                    held += len(part)
        if parts:
            yield from flush()

    result = docs.mapInArrow(search, schema) if depth else spark.createDataFrame([], schema)
    best = F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    return result.groupBy(doc_id, item_id).agg(best.alias("m")).select(doc_id, item_id, "m.match_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def remove_leaks(corpus: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The corpus without the affected documents."""
    return corpus.join(found.select(doc_id).distinct(), doc_id, "left_anti")


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")


def p8_found(spark, sf_dir: str) -> DataFrame:
    return find_leaks(*_tables(spark, sf_dir)).select("doc_id", "item_id")


def p8_items(spark, sf_dir: str) -> DataFrame:
    """Which items leaked: documents that hold them and the longest passage."""
    return find_leaks(*_tables(spark, sf_dir)).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("match_words").alias("longest"))


def p8_clean(spark, sf_dir: str) -> DataFrame:
    """Ids of the documents that stay."""
    corpus, items = _tables(spark, sf_dir)
    return remove_leaks(corpus, find_leaks(corpus, items)).select("doc_id")


_GRAMS = """
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) FROM eval_items),
g AS (
  SELECT DISTINCT side, id, array_to_string(list_slice(ws, s, s + 9), ' ') AS gram
  FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 8)) AS s FROM w WHERE len(ws) >= 10)),
hit AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.gram = i.gram AND d.side = 'd' AND i.side = 'i')
"""
#: Runs of matching grams on a diagonal; a run of k grams is a passage of k + 9 words.
P8_ITEMS_SQL = """
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS ws FROM documents
  UNION ALL
  SELECT DISTINCT 'i', item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) FROM eval_items),
g AS (SELECT side, id, s, array_to_string(list_slice(ws, s, s + 9), ' ') AS gram FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 8)) AS s FROM w WHERE len(ws) >= 10)),
m AS (SELECT d.id AS doc_id, i.id AS item_id, d.s, d.s - i.s AS diagonal FROM g d JOIN g i ON d.gram = i.gram AND d.side = 'd' AND i.side = 'i'),
r AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY s) AS run FROM m),
l AS (SELECT doc_id, item_id, count(*) + 9 AS n FROM r GROUP BY doc_id, item_id, diagonal, run)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n)::INT AS longest FROM l GROUP BY 1"""
P8_FOUND_SQL = _GRAMS + "SELECT doc_id, item_id FROM hit"
P8_CLEAN_SQL = _GRAMS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)"
