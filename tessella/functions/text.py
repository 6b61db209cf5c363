"""Column expressions over text: tokens, n-grams, estimates, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII tokens of the minimal profile.
ASCII_TOKEN = "[a-z0-9]+"
#: Fixed value: characters that count as one token each (Han, kana, Hangul).
WIDE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, with repeats; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ASCII_TOKEN), F.lit(0))


def first_line(text: Column) -> Column:
    return F.split_part(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(1))


def ngrams(tokens: Column, n: int, glue: str = " ") -> Column:
    """Joined n-grams of a token array; fewer than n tokens give none. The array is bound once."""
    return F.transform(F.array(tokens), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), glue))).otherwise(F.array().cast("array<string>")))[0]


def character_trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case ASCII letters and digits."""
    flat = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    grams = F.transform(F.array(flat), lambda s: F.when(F.length(s) >= 3, F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, 3))).otherwise(F.array().cast("array<string>")))[0]
    return F.array_distinct(grams)


def token_estimate(text: Column) -> Column:
    """Wide characters count one token each, the rest one per four UTF-8 bytes, rounded up. Null counts 0."""
    text = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(text, WIDE, "")
    return (F.length(text) - F.length(rest) + F.ceil(F.octet_length(rest) / 4)).cast("long")


def truncate(text: Column, most: int) -> Column:
    """White space collapsed; longer texts are cut to `most` characters including the ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def path_suffixes(path: Column) -> Column:
    """The path and all that follows one of its slashes, as they stand; empty ones are left out."""
    suffixes = F.transform(F.array(F.split(path, "/")), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/")))[0]
    return F.array_distinct(F.filter(suffixes, lambda x: x != ""))


def edit_budget(word: Column) -> Column:
    """Edits that a word may differ by: two from nine characters on, else one."""
    return F.when(F.length(word) >= 9, 2).otherwise(1)


#: Words up to this length are found by deletions, longer ones by pieces: both ways take a bounded number of keys.
LONG_WORD = 24


def _deleted(words: Column) -> Column:
    """Each word without one of its characters."""
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))


def deletions(word: Column, k: Column) -> Column:
    """The word and all that is left of it after 1..k deletions, k being 1 or 2; distinct. Two words at most k edits apart
    have one of these in common."""
    once = F.transform(F.array(F.array(word)), _deleted)[0]
    return F.array_distinct(F.concat(F.array(word), F.transform(F.array(once), lambda x: F.when(k >= 2, F.concat(x, _deleted(F.filter(x, lambda w: w != "")))).otherwise(x))[0]))


def _piece(word: Column, n: Column, part: int, shift: Column) -> Column:
    """Key of the part-th third of a word of n characters, read from another word `shift` places on."""
    lo, hi = F.floor(n * part / 3), F.floor(n * (part + 1) / 3)
    return F.xxhash64(n, F.lit(part), F.substring(word, (lo + shift + 1).cast("int"), (hi - lo).cast("int")))


def edit_keys(word: Column) -> Column:
    """Keys under which an indexed word is found within its neighbours' edit budgets: deletions of short words, the three
    thirds of long ones (of two edits at least one third stays whole)."""
    n = F.length(word)
    short = F.transform(deletions(word, F.when(n >= 7, 2).otherwise(1)), lambda w: F.xxhash64(w))
    return F.when(n <= LONG_WORD, F.when(n > 0, short)).otherwise(F.array(*[_piece(word, n, i, F.lit(0)) for i in range(3)]))


def edit_lookups(word: Column) -> Column:
    """The keys that a word within its edit budget may be indexed under: its own deletions, and for lengths of long words
    near its own every place where a third of them may stand."""
    n, k = F.length(word), edit_budget(word)
    short = F.when((n > 0) & (n <= LONG_WORD + 2), F.transform(deletions(word, k), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>"))
    lengths = F.filter(F.sequence(n - 2, n + 2), lambda m: m > LONG_WORD)
    places = F.sequence(F.lit(-2), F.lit(2))

    def third(i: int) -> Column:
        of = lambda m: F.transform(places, lambda x: F.when(F.floor(m * i / 3) + x >= 0, _piece(word, m, i, x)))
        return F.flatten(F.transform(lengths, of))

    thirds = F.concat(*[third(i) for i in range(3)])
    return F.array_distinct(F.concat(short, F.filter(F.when(n >= LONG_WORD - 1, thirds).otherwise(F.array().cast("array<long>")), lambda x: x.isNotNull())))


def redact(text: Column) -> Column:
    """Replace what looks like a key or bearer token."""
    return F.regexp_replace(text, r"(?i)\b(?:bearer\s+|sk-|key-)[A-Za-z0-9._-]{8,}", "[redacted]")
