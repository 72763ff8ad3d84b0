"""Prompt texts and their rotation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The system prompts, in rotation order, the grounding rules and the frames around a context.
SYSTEM_PROMPTS = [
    "You are a transportation engineering assistant. Answer clearly and precisely, using only the information you have been given.",
    "You are a senior transportation engineer mentoring a junior colleague. Explain concepts accurately and cite specifics (numbers, criteria, standards) when given.",
    "You are a concise technical reference assistant for transportation engineering. Give direct, factual answers without speculation.",
    "You are a transportation engineering instructor helping a student understand textbook material. Be accurate and avoid inventing facts not provided to you.",
]
GROUNDING = (
    "Use ONLY the information in the CONTEXT below to answer. Do not use outside knowledge, do not invent facts, names, dates, standards, or numbers that are not "
    "present in the CONTEXT. If the CONTEXT does not contain enough information to answer, respond with exactly: \"insufficient context\". Preserve hedging language "
    "from the CONTEXT (e.g. \"may\", \"could\", \"typically\") rather than turning it into an absolute statement. Do not invent author names or institutional affiliations."
)
ANSWER_SHAPE = '\n\nRespond with ONLY a JSON object in this exact shape, no extra commentary:\n{"question": "...", "answer": "..."}\n'
QUESTION_SHAPE = '\n\nRespond with ONLY a JSON object in this exact shape, no extra commentary:\n{"question": "..."}\n'
TEXT_FRAME = (
    "\n\nCONTEXT:\n=== BEGIN CONTEXT ===\n",
    "\n=== END CONTEXT ===\n\nTask: Write ONE reading-comprehension question that is answerable solely from the CONTEXT above, and a grounded answer to that question "
    "using only facts stated in the CONTEXT." + ANSWER_SHAPE,
)
TABLE_FRAME = (
    "\n\nThe CONTEXT below is a data table extracted from a transportation engineering document.\n\n=== BEGIN CONTEXT (TABLE) ===\n",
    "\n=== END CONTEXT ===\n\nTask: Write ONE question that asks about a specific value, row, or relationship in this table, and a grounded answer using only the data shown." + ANSWER_SHAPE,
)
PARAPHRASE_FRAME = (
    "\n\nHere is a question and its correct grounded answer, both derived from a technical context you cannot see directly, but must treat as authoritative:\n\nQUESTION: ",
    "\nANSWER: ",
    "\n\nTask: Write ONE realistic, differently-phrased user question that a real person might type to ask for the SAME answer above. Vary wording, phrasing, and level of "
    "formality (a slightly messy or casual phrasing is fine), but keep it a genuine, sensible question. Do NOT change what is being asked, and do NOT change the answer." + QUESTION_SHAPE,
)
CORRECTION = "\n\nYour previous response was not valid JSON. Respond with ONLY the JSON object and nothing else."


def system_prompt(chunk_seq: Column) -> Column:
    """The prompt of a chunk, by its global number."""
    return F.element_at(F.array(*map(F.lit, SYSTEM_PROMPTS)), (F.pmod(chunk_seq, F.lit(len(SYSTEM_PROMPTS))) + 1).cast("int"))


def primary_prompt(text: Column, is_table: Column) -> Column:
    framed = lambda frame: F.concat(F.lit(GROUNDING + frame[0]), text, F.lit(frame[1]))
    return F.when(is_table, framed(TABLE_FRAME)).otherwise(framed(TEXT_FRAME))


def paraphrase_prompt(question: Column, answer: Column) -> Column:
    return F.concat(F.lit(GROUNDING + PARAPHRASE_FRAME[0]), question, F.lit(PARAPHRASE_FRAME[1]), answer, F.lit(PARAPHRASE_FRAME[2]))
