"""Candidate records from chunks, by a generator behind one interface.

A generator turns requests ``(request_id, system, prompt)`` into responses ``(request_id, raw, tokens, failed)``. Responses
are external and may differ between runs, so they are written once and read from there on.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.config import RunConfig
from quirework.functions import text as T
from quirework.operators import prompts
from quirework.session import cut_lineage

Generator = Callable[[DataFrame, RunConfig], DataFrame]
RESPONSES = "request_id string, object map<string,string>, tokens long"


def python_text(value) -> str:
    """How Python prints a JSON value: null is ``None``, booleans are capitalised, lists as literals."""
    return str(value).strip()


def ask(call: Callable[[str, str], tuple[str, int]], system: str, prompt: str) -> tuple[dict | None, int]:
    """Up to two attempts; ``call`` returns text and tokens, or raises ``OSError``. A response that is no JSON is
    asked for again with a correction, one that is no object with the same prompt."""
    used = 0
    for _ in range(2):
        try:
            raw, tokens = call(system, prompt)
        except OSError:
            continue
        used += tokens
        try:
            found = json.loads(raw)
        except ValueError:
            prompt += prompts.CORRECTION
            continue
        if isinstance(found, dict):
            return found, used
    return None, used


def _stage(requests: DataFrame, make_call: Callable[[], Callable[[str, str, str], tuple[str, int]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_call()
        for batch in batches:
            rows = []
            for request_id, system, prompt in batch[["request_id", "system", "prompt"]].itertuples(index=False):
                found, tokens = ask(lambda s, p, r=request_id: call(r, s, p), system, prompt)
                fields = None if not found else {k: python_text(found[k]) for k in ("question", "answer") if k in found}
                rows.append((request_id, fields, tokens))
            yield pd.DataFrame(rows, columns=["request_id", "object", "tokens"])

    return requests.select("request_id", "system", "prompt").mapInPandas(run, RESPONSES)


def http_generator(requests: DataFrame, config: RunConfig) -> DataFrame:
    """Asks the generation service; partitions bound the number of calls at a time."""

    def make_call():
        def call(request_id: str, system: str, prompt: str) -> tuple[str, int]:
            body = {
                "model": config.model_name, "prompt": prompt, "system": system, "format": "json", "stream": False,
                "options": {"temperature": config.temperature, "num_predict": config.max_new_tokens},
            }
            request = urllib.request.Request(f"{config.ollama_host}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=config.request_timeout_s) as response:
                data = json.loads(response.read())
            return data.get("response", ""), (data.get("prompt_eval_count") or 0) + (data.get("eval_count") or 0)

        return call

    return _stage(requests, make_call)


def replay_generator(recorded: dict[str, list[tuple[str | None, int]]]) -> Generator:
    """Answers from recorded attempts by request id, for tests; a null response is a failed request."""

    def generate(requests: DataFrame, config: RunConfig) -> DataFrame:
        def make_call():
            left = {k: list(v) for k, v in recorded.items()}

            def call(request_id: str, system: str, prompt: str) -> tuple[str, int]:
                raw, tokens = left[request_id].pop(0) if left.get(request_id) else (None, 0)
                if raw is None:
                    raise OSError("no response")
                return raw, tokens

            return call

        return _stage(requests, make_call)

    return generate


def extractive_generator(requests: DataFrame, config: RunConfig) -> DataFrame:
    """Offline and deterministic, all on the JVM: asks what the source says and answers with the context itself."""
    body = F.regexp_extract("prompt", r"(?s)=== BEGIN CONTEXT[^\n]*===\n(.*)\n=== END CONTEXT ===", 1)
    asked = F.regexp_extract("prompt", r"(?s)\nQUESTION: (.*?)\nANSWER: ", 1)
    words = F.array_join(F.slice(T.py_words(body), 1, 6), " ")
    question = F.when(asked != "", F.concat(F.lit("In short, "), F.lower(F.substring(asked, 1, 1)), asked.substr(F.lit(2), F.length(asked)))).otherwise(F.concat(F.lit("What is stated about "), words, F.lit("?")))
    return requests.select("request_id", F.create_map(F.lit("question"), question, F.lit("answer"), T.py_strip(body)).alias("object"), F.lit(0).cast("long").alias("tokens"))


def lacks_context(answer: Column) -> Column:
    low = F.lower(T.py_strip(answer))
    return low.contains("insufficient context") | low.contains("not enough information")


def skip_reason(found: Column) -> Column:
    """Why a primary response is not used, in order; null if it is."""
    question, answer = F.coalesce(found["question"], F.lit("")), F.coalesce(found["answer"], F.lit(""))
    return F.when(found.isNull() | (F.size(found) == 0), "generation failed").when((question == "") | (answer == ""), "missing question/answer field").when(lacks_context(answer), "insufficient context")


def build_candidates(chunks: DataFrame, config: RunConfig = RunConfig(), generator: Generator = extractive_generator) -> tuple[DataFrame, DataFrame]:
    """``(candidates, primary)``: raw records with ``record_seq``, and every primary response with its skip reason.

    Requests are told by chunk number and variant, since chunks of two files of one name share their ids.
    Paraphrases are asked for from the question as generated, also where the primary later fails the gate; those
    that are empty or equal the question but for case are left out.
    """
    asked = chunks.withColumns({
        "system": prompts.system_prompt(F.col("chunk_seq")), "prompt": prompts.primary_prompt(F.col("text"), F.col("is_table")), "request_id": F.concat(F.col("chunk_seq").cast("string"), F.lit("#0")),
    })
    primary = cut_lineage(generator(asked, config)).join(asked.drop("text", "prompt"), "request_id").withColumn("skip_reason", skip_reason(F.col("object")))
    used = primary.where("skip_reason IS NULL").withColumns({"question": F.col("object")["question"], "answer": F.col("object")["answer"]})
    keep = ["system", "question", "answer", "source_doc", "page_start", "page_end", "chunk_id", F.col("token_count").alias("chunk_token_count"), "is_table"]
    n = config.variants_per_chunk
    seq = lambda v: (F.col("chunk_seq") * (n + 1) + v).cast("long").alias("record_seq")
    records = used.select(seq(F.lit(0)), *keep)
    if n > 0:
        again = used.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(n))))
        again = again.withColumns({"prompt": prompts.paraphrase_prompt(F.col("question"), F.col("answer")), "request_id": F.concat(F.col("chunk_seq").cast("string"), F.lit("#"), F.col("variant").cast("string"))}).drop("object", "tokens")
        told = cut_lineage(generator(again, config)).select("request_id", F.coalesce(F.col("object")["question"], F.lit("")).alias("__told"))
        varied = again.join(told, "request_id").where((F.col("__told") != "") & (F.lower("__told") != F.lower("question")))
        records = records.unionByName(varied.withColumn("question", F.col("__told")).select(seq(F.col("variant")), *keep))
    return records, primary
