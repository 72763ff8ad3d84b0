"""Problem 3: the same or nearly the same records across splits.

Records of val and test are indexed by the prefixes of their word sets, rare words first; train records probe
the index with length and position filters, and candidates are verified. Records of the same chunk are
found by an equi-join whose hot keys are salted. All overlaps come out as record pairs, and are counted by split and source.

Defined cases: a null answer adds no words; an empty set is similar to nothing; a null ``chunk_id`` equals
nothing; a null ``record_seq`` or a split other than train, val and test forms no pair; rows delivered
twice count once; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import spread_join
from quirework.llm.setjoin import Plan, hashed_words, similar_sets

PLAN = Plan(Fraction(4, 5), shingle=1, depth=2)
#: Side 0 probes, side 1 is indexed.
SIDE = "CAST(CASE WHEN split_name = 'train' THEN 0 WHEN split_name IN ('val', 'test') THEN 1 END AS TINYINT)"


def cross_split_pairs(records: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``train_seq, eval_seq, same_chunk, near_text`` of every overlap."""
    sided = records.withColumn("__side", F.expr(SIDE)).where("__side IS NOT NULL AND record_seq IS NOT NULL")
    both = F.concat_ws(" ", "question", "answer")
    members, pairs = similar_sets(sided.select(F.col("record_seq").cast("long").alias("id"), F.col("__side").alias("side"), hashed_words(both).alias("hashes")), plan, two_sides=True)
    of = lambda side, s, c: members.where(F.col("side") == side).select(F.col("set").alias(s), F.col("id").alias(c))
    near = pairs.join(of(0, "a", "train_seq"), "a").join(of(1, "b", "eval_seq"), "b").select("train_seq", "eval_seq")
    equal = spread_join(of(0, "a", "train_seq"), of(1, "a", "eval_seq"), "a", "train_seq").select("train_seq", "eval_seq")
    text = near.unionByName(equal).withColumns({"same_chunk": F.lit(False), "near_text": F.lit(True)})
    blank = r"(?U)^[\s\x{00a0}\x{200b}\x{feff}]+|[\s\x{00a0}\x{200b}\x{feff}]+$"
    chunk = F.lower(F.regexp_replace("chunk_id", blank, ""))
    keyed = sided.select(F.col("record_seq").cast("long").alias("id"), "__side", chunk.alias("chunk")).where("chunk IS NOT NULL").distinct()
    end = lambda side, c: keyed.where(F.col("__side") == side).select("chunk", F.col("id").alias(c))
    same = spread_join(end(0, "train_seq"), end(1, "eval_seq"), "chunk", "train_seq").select("train_seq", "eval_seq", F.lit(True).alias("same_chunk"), F.lit(False).alias("near_text"))
    found = text.unionByName(same).where("train_seq <> eval_seq")
    return found.groupBy("train_seq", "eval_seq").agg(F.max("same_chunk").alias("same_chunk"), F.max("near_text").alias("near_text"))


def overlap_report(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``split_name, source_doc, n_records, n_same_chunk, n_near_text, n_pairs`` of the evaluation records with an overlap."""
    by = pairs.groupBy(F.col("eval_seq").alias("record_seq")).agg(
        F.count("*").alias("pairs"), F.max(F.col("same_chunk").cast("int")).alias("chunk"), F.max(F.col("near_text").cast("int")).alias("text")
    )
    named = records.where("split_name IN ('val', 'test')").select("record_seq", "split_name", "source_doc").distinct()
    sums = [F.count("*").alias("n_records"), F.sum("chunk").alias("n_same_chunk"), F.sum("text").alias("n_near_text"), F.sum("pairs").alias("n_pairs")]
    return named.join(by, "record_seq").groupBy("split_name", "source_doc").agg(*sums)


def _records(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/validated_records.parquet").select("record_seq", "question", "answer", "chunk_id", "split_name", "source_doc")


def p3_found(spark, sf_dir: str) -> DataFrame:
    pairs = cross_split_pairs(_records(spark, sf_dir))
    return pairs.select(F.least("train_seq", "eval_seq").alias("id_a"), F.greatest("train_seq", "eval_seq").alias("id_b"))


def p3_report(spark, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return overlap_report(records, cross_split_pairs(records))


_PAIRS_SQL = """
WITH r AS (SELECT DISTINCT record_seq AS id, question, answer, lower(trim(chunk_id)) AS chunk, split_name, source_doc FROM validated_records),
s AS (SELECT id, split_name = 'train' AS tr, list_distinct(list_transform(regexp_extract_all(concat_ws(' ', question, answer), '[\\p{L}\\p{N}]+'), lambda x: lower(x))) AS w FROM r),
t AS (SELECT id, tr, len(w) AS n, unnest(w) AS x FROM s),
m AS (
  SELECT a.id AS train_seq, b.id AS eval_seq, a.n + b.n AS n, count(*) AS k FROM t a JOIN t b
  ON a.x = b.x AND a.tr AND NOT b.tr AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY ALL),
p AS (
  SELECT train_seq, eval_seq, false AS same_chunk, true AS near_text FROM m WHERE 5 * k >= 4 * (n - k)
  UNION ALL SELECT a.id, b.id, true, false FROM r a JOIN r b ON a.chunk = b.chunk AND a.split_name = 'train' AND b.split_name <> 'train'),
pairs AS (SELECT train_seq, eval_seq, bool_or(same_chunk) AS same_chunk, bool_or(near_text) AS near_text FROM p GROUP BY ALL)
"""
P3_FOUND_SQL = _PAIRS_SQL + "SELECT least(train_seq, eval_seq) AS id_a, greatest(train_seq, eval_seq) AS id_b FROM pairs"
P3_REPORT_SQL = (
    _PAIRS_SQL
    + """, by_record AS (SELECT eval_seq, count(*) AS pairs, max(same_chunk::INT) AS c, max(near_text::INT) AS t FROM pairs GROUP BY 1)
SELECT split_name, source_doc, count(*) AS n_records, sum(c)::BIGINT AS n_same_chunk, sum(t)::BIGINT AS n_near_text, sum(pairs)::BIGINT AS n_pairs
FROM by_record JOIN (SELECT DISTINCT id, split_name, source_doc FROM r) ON id = eval_seq GROUP BY 1, 2"""
)
