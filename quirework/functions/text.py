"""Text expressions with Unicode semantics that do not depend on the engine's regex defaults."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes. WORD is a Unicode word character, SPACE any Unicode white space.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f]"
BEFORE_WORD, AFTER_WORD = rf"(?<!{WORD})", rf"(?!{WORD})"

# What is masked, in this order. What may not stand before a match is looked up after its first signs, so that
# a text is scanned for these and not for the places before them.
MASKS = {
    # a run of address signs is read once, from its beginning or from where the last match ended
    "email": (rf"(?:\G|(?<![\p{{L}}\p{{N}}_.+\-]))[\p{{L}}\p{{N}}_.+\-]++@[\p{{L}}\p{{N}}_\-]+\.[\p{{L}}\p{{N}}_.\-]+", "[EMAIL]"),
    "phone": (rf"(?U)\p{{Nd}}{{3}}(?<!{WORD}\p{{Nd}}{{3}})[-.\s\x1c-\x1f]\p{{Nd}}{{3}}[-.\s\x1c-\x1f]\p{{Nd}}{{4}}{AFTER_WORD}", "[PHONE]"),
    "ssn": (rf"\p{{Nd}}{{3}}(?<!{WORD}\p{{Nd}}{{3}})-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}{AFTER_WORD}", "[SSN]"),
    "aws": (rf"AKIA(?<!{WORD}AKIA)[0-9A-Z]{{16}}{AFTER_WORD}", "[AWS_KEY]"),
    "secret": (rf"[sp]k-(?<!{WORD}[sp]k-)[A-Za-z0-9]{{16,}}{AFTER_WORD}", "[SECRET]"),
}
#: What a text must hold (any of it) to be scanned for a mask at all.
SIGNS = {"email": ["@"], "aws": ["AKIA"], "secret": ["sk-", "pk-"]}


def let(value: Column, function) -> Column:
    """``function`` of a value that is computed once, however often the function names it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once: they come out of a generator, which the optimizer neither
    merges with later projections nor moves filters below."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))


def py_strip(text: Column) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def py_words(text: Column) -> Column:
    """Pieces between runs of white space, without empty ones."""
    return F.filter(F.split(text, rf"(?U){SPACE}+", -1), lambda w: w != "")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition. Texts that are pure ASCII go to Python's normaliser as nulls, and stay as they are."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", " ")


def mask(text: Column, kind: str) -> Column:
    pattern, placeholder = MASKS[kind]
    if kind not in SIGNS:
        return F.regexp_replace(text, pattern, placeholder)

    def masked(t: Column) -> Column:
        held = t.contains(SIGNS[kind][0])
        for sign in SIGNS[kind][1:]:
            held = held | t.contains(sign)
        return F.when(held, F.regexp_replace(t, pattern, placeholder)).otherwise(t)

    return let(text, masked)


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def collapse_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def clean_text(text: Column) -> Column:
    """All cleaning steps in their order."""
    return clean_composed(nfkc(text))


def clean_composed(text: Column) -> Column:
    """The cleaning steps after Unicode composition."""
    text = strip_tags(text)
    for kind in MASKS:
        text = mask(text, kind)
    return py_strip(collapse_lines(collapse_blanks(text)))


def cut_boilerplate(text: Column, titles: tuple[str, ...]) -> Column:
    """The lines before the first line that is a back-matter title; the text unchanged if there is none."""
    lines = F.split(text, "\n", -1)

    def is_title(line: Column) -> Column:
        bare = F.lower(F.regexp_replace(py_strip(line), r"\A:+|:+\z", ""))
        return (F.length(bare) < 40) & bare.isin(list(titles))

    hit = F.array_position(F.transform(lines, is_title), True)
    return F.when(hit > 0, py_strip(F.array_join(F.slice(lines, F.lit(1), (hit - 1).cast("int")), "\n"))).otherwise(text)


def table_text(rows: Column) -> Column:
    """Cells stripped and joined by `` | ``, rows by line breaks; a null cell is empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: py_strip(F.coalesce(c, F.lit("")))), " | ")), "\n")


def paragraphs(text: Column) -> Column:
    parts = F.split(text, rf"(?U)\n{SPACE}*\n", -1)
    return F.filter(F.transform(parts, py_strip), lambda p: p != "")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), py_strip), lambda p: p != "")


# Abbreviations after which a sentence goes on.
ABBREVIATIONS = "mr mrs ms dr prof sr jr vs etc fig no approx st ave eq sec ch vol pp p e.g i.e".split()
_ABBREVIATED = rf"(?iuU){BEFORE_WORD}(?:{'|'.join(a.replace('.', chr(92) + '.') for a in ABBREVIATIONS)})\.{SPACE}*\z"


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` before an ASCII capital, a digit or a quote; a piece that ends in an
    abbreviation is joined to the next by one space."""
    pieces = F.split(py_strip(text), rf"(?U)(?<=[.!?]){SPACE}+(?=[A-Z0-9\"'])", -1)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, piece: Column) -> Column:
        joined = F.coalesce(F.concat(state["open"], F.lit(" "), piece), piece)
        goes_on = joined.rlike(_ABBREVIATED)
        done = F.when(goes_on, state["done"]).otherwise(F.concat(state["done"], F.array(joined)))
        return F.struct(done.alias("done"), F.when(goes_on, joined).alias("open"))

    whole = F.aggregate(pieces, empty, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.filter(F.transform(whole, py_strip), lambda s: s != "")


def mark_hard_cuts(text: Column) -> Column:
    """Three line breaks before each chapter or section heading, then before each all-capitals line."""
    text = F.regexp_replace(text, rf"(?imuUd)^(chapter|section){SPACE}+\p{{Nd}}+", "\n\n\n$0")
    return F.regexp_replace(text, r"(?md)^[A-Z][A-Z0-9 \-:]{4,59}$", "\n\n\n$0")


#: What is replaced in names, in this order.
SAFE_STEPS = [(r'[<>:"/\\|?*\x00-\x1f]', "_"), (r"[\s\x1c-\x1f]+", "_"), (r"_{2,}", "_")]


def sanitize_name(name: Column, limit: int) -> Column:
    """A name that is safe in paths, cut at ``limit``; ``run`` if nothing is left."""
    for pattern, put in SAFE_STEPS:
        name = F.regexp_replace(name, f"(?U){pattern}", put)
    name = F.substring(F.regexp_replace(name, r"\A[._]+|[._]+\z", ""), 1, limit)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("run"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Base name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+\z", "")


def elapsed(seconds: Column) -> Column:
    """``mm:ss`` with minutes beyond 59."""
    whole = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))
