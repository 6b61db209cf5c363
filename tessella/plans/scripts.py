"""Tokens of other scripts: the documents' words, letter by letter in eight scripts, under every profile of the tokenizer."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from tessella.functions import tokenizer
from tessella.functions.text import ascii_tokens
from tessella.scratch import parallel
from tessella.session import table

#: Where the 26 letters that stand for a to z begin in each script; Arabic skips what is no letter.
STARTS = {"Han": 0x4E00, "Thai": 0x0E01, "Hangul": 0xAC00, "Cyrillic": 0x0430, "Greek": 0x03B1, "Hebrew": 0x05D0, "Arabic": None, "Devanagari": 0x0915}
ALPHABETS = {s: "".join(map(chr, range(at, at + 26) if at else [*range(0x0626, 0x063B), *range(0x0645, 0x064A)])) for s, at in STARTS.items()}


def _written(text, number):
    """The words of ASCII letters of a text in the script of that number."""
    words = F.array_join(F.filter(ascii_tokens(text), lambda w: ~w.rlike("[0-9]")), " ")
    out = words
    for i, letters in enumerate(ALPHABETS.values()):
        out = F.when(number % len(ALPHABETS) == i, F.translate(words, string.ascii_lowercase, letters)).otherwise(out)
    return out


def script_tokens(spark, sf_dir):
    """(doc_id, script, profile, tokens, distinct_tokens, digest) of all documents under all profiles; the digest is that of
    the sorted distinct tokens."""
    d = F.col("doc_id")
    rows = parallel(table(spark, sf_dir, "documents")).select(d, _written(F.col("text"), d).alias("t"))
    # Every text has a summary for each profile. An inner explode() would be filtered by its size first, and summarized twice.
    return rows.select("doc_id", tokenizer.text_script(F.col("t")).alias("script"), tokenizer.summaries(F.col("t")).alias("x")).select("doc_id", "script", F.explode_outer("x").alias("x")).select("doc_id", "script", "x.*")


QUERIES = {f.__name__: f for f in (script_tokens,)}


def _tokens(p: tokenizer.Profile) -> str:
    """The tokens of one word w of a script, as a list."""
    folded = "w"
    for folds in (tokenizer.GREEK_FOLDS, tokenizer.ARABIC_FOLDS, tokenizer.HEBREW_FOLDS):
        for a, b in folds.items():
            folded = f"replace({folded}, '{a}', '{b}')"
    forms = f"list_distinct([w, {folded}])" if p.folds == "multilingual" else "[w]"
    grams = lambda widths: " || ".join(["[]::varchar[]", *[f"flatten(list_transform({forms}, lambda f: list_transform(range(1, length(f) - {n} + 2), lambda i: substring(f, i, {n}))))" for n in widths]])
    names = lambda some: "(" + ", ".join(f"'{s}'" for s in ALPHABETS if s in some) + ")"
    compact = grams((2, 3) if p.compact else ())
    return f"list_filter(case when script in {names(tokenizer.COMPACT)} then {compact} else {forms} || (case when script in {names(tokenizer.INFLECTED)} then {grams(p.inflected)} else [] end) end, lambda x: length(x) > 1)"


def _twin() -> str:
    letters = " ".join(f"when {i} then '{a}'" for i, a in enumerate(ALPHABETS.values()))
    names = " ".join(f"when {i} then '{s}'" for i, s in enumerate(ALPHABETS))
    n = len(ALPHABETS)
    base = f"with a as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: not regexp_matches(w, '[0-9]')) as ws from documents), b as (select doc_id, list_transform(ws, lambda w: translate(w, '{string.ascii_lowercase}', case doc_id % {n} {letters} end)) as ws, case when len(ws) > 0 then case doc_id % {n} {names} end end as script from a)"
    each = " union all ".join(f"select doc_id, script, '{p.name}' as profile, flatten(list_transform(ws, lambda w: {_tokens(p)})) as t from b" for p in tokenizer.PROFILES.values())
    return f"{base}, e as ({each}) select doc_id, script, profile, len(t) as tokens, len(list_distinct(t)) as distinct_tokens, sha256(coalesce(array_to_string(list_sort(list_distinct(t)), ' '), '')) as digest from e"


ORACLES = {"script_tokens": _twin()}
