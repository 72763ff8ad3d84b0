"""The quality gate: ordered row checks and exact first-accepted dedup.

Row checks do not depend on other rows, and only rows that pass all of them claim a key. So the sequential
rule "a key is taken by the first accepted row" is a minimum over the rows of a key that pass. It is summed up before
any shuffle, so neither a hot key nor the rows that fail early gather in one task, and there is no total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.config import RunConfig
from quirework.functions import text as T
from quirework.functions.tokens import Counter, word_counter
from quirework.session import cut_lineage

# Words that point at a passage, and the ways in which a question is led in.
_NOUNS = "context|text|passage|document|snapshot|excerpt"
_LEADS = "according to|as (?:stated|described|mentioned|shown) in|based on|per|from"


def strip_preamble(question: Column, strict: bool = False) -> Column:
    """Drop a lead-in such as "according to the text," and capitalise what follows. Without ``strict`` the noun
    may be the beginning of a longer word."""
    s, end = T.SPACE, T.AFTER_WORD if strict else ""
    lead = rf"(?iuU)\A{s}*(?:{_LEADS}){s}+(?:the{s}+)?(?:{_NOUNS}){end}(?:{s}+above)?{s}*[,:]?{s}*"
    bare = F.regexp_replace(question, lead, "")
    return F.when((bare != question) & (bare != ""), F.concat(F.upper(F.substring(bare, 1, 1)), bare.substr(F.lit(2), F.length(bare)))).otherwise(bare)


def is_meta(question: Column) -> Column:
    return question.rlike(rf"(?iu){T.BEFORE_WORD}(?:{_NOUNS}){T.AFTER_WORD}")


def normal_key(text: Column) -> Column:
    """Lower case, only ``a-z``, digits and blanks, blanks outside stripped."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", ""))


def row_checks(records: DataFrame, config: RunConfig = RunConfig(), count: Counter = word_counter) -> DataFrame:
    """``records`` with their stored fields, ``q_norm``, ``a_norm``, and the reasons of the checks before and after dedup
    (``__early``, ``__late``; both null: the row may claim its key). Narrow."""
    asked = F.coalesce("question", F.lit(""))
    bare = strip_preamble(asked, config.strict_preamble) if config.strip_meta_questions else asked
    df = records.withColumns({"__asked": asked, "__bare": bare})
    fields = ["system", "question", "answer", "source_doc", "chunk_id"]
    df = df.withColumn("question", F.col("__bare")).withColumns({f: T.py_strip(F.coalesce(f, F.lit(""))) for f in fields if f != "question"})
    changed = F.col("__bare") != F.col("__asked")
    short = changed & (F.size(T.py_words(F.col("__bare"))) < 4) if config.strip_meta_questions else F.lit(False)
    meta = is_meta(F.col("__bare")) if config.strip_meta_questions else F.lit(False)
    df = df.withColumns({"__short": short, "__meta": meta, "question": T.py_strip(F.col("__bare"))})
    blank = F.lit(False)
    for f in fields:
        blank = blank | (F.col(f) == "")
    df = df.withColumns({"q_norm": normal_key(F.col("question")), "a_norm": normal_key(F.col("answer"))})
    early = (
        F.when(F.col("__short"), "question too short after meta strip").when(F.col("__meta"), "meta-referential question").when(blank, "failed validation")
        .when((F.col("q_norm") == "") | (F.col("a_norm") == ""), "empty after normalization")
    )
    df = df.withColumn("__early", early)
    # token counts are the costly part: they are computed for rows that the cheap checks leave only
    counted = lambda f: F.when(F.col("__early").isNull(), count(F.col(f)))
    df = df.withColumns({"__a": counted("answer"), "__total": counted("system") + counted("question") + counted("answer")})
    late = (
        F.when(F.col("__a") < config.min_answer_tokens, F.format_string("answer too short (%d < %d)", F.col("__a"), F.lit(config.min_answer_tokens)))
        .when((F.coalesce("chunk_token_count", F.lit(0)) != 0) & (F.col("__a") > F.col("chunk_token_count") * config.length_ratio_limit), "answer implausibly long vs source chunk")
        .when(F.col("__total") > config.max_seq_tokens, F.format_string("exceeds max_seq_tokens (%d > %d)", F.col("__total"), F.lit(config.max_seq_tokens)))
    )
    return df.withColumn("__late", late).drop("__asked", "__bare", "__short", "__meta", "__a", "__total")


def verdicts(records: DataFrame, config: RunConfig = RunConfig(), count: Counter = word_counter) -> DataFrame:
    """``records`` with their stored fields, ``q_norm``, ``a_norm`` and ``reject_reason`` (null: accepted). The checked rows
    are written once; claims and verdicts read them from there."""
    df = cut_lineage(row_checks(records, config, count))
    # only keys that repeat and are claimed come back: few rows, mostly sent to all tasks by the adaptive plan
    claims = df.where("__early IS NULL").groupBy("q_norm", "a_norm").agg(F.min(F.when(F.col("__late").isNull(), F.col("record_seq"))).alias("__first"), F.count("*").alias("__n"))
    claims = claims.where("__n > 1 AND __first IS NOT NULL").select(F.col("q_norm").alias("__q"), F.col("a_norm").alias("__k"), "__first")
    df = df.join(claims, (F.col("q_norm") == F.col("__q")) & (F.col("a_norm") == F.col("__k")) & F.col("__early").isNull(), "left")
    reason = F.coalesce("__early", F.when(F.col("__first") < F.col("record_seq"), "duplicate question/answer pair"), "__late")
    return df.withColumn("reject_reason", reason).drop("__early", "__late", "__q", "__k", "__first")


def gate(records: DataFrame, config: RunConfig = RunConfig(), count: Counter = word_counter) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; rejected rows keep their reason."""
    judged = verdicts(records, config, count)
    return judged.where("reject_reason IS NULL").drop("reject_reason", "q_norm", "a_norm", "chunk_token_count"), judged.where("reject_reason IS NOT NULL")
