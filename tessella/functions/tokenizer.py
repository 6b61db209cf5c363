"""The Unicode tokenizer and its profiles.

NFKC, camel-case split, lower case, format characters dropped; then ASCII compounds (whole, path segments and parts) and
words by script: compact scripts give grapheme n-grams only, morphological scripts the word and its n-grams, others the
word and its folded form. Texts of ASCII and accented Latin letters are tokenized by JVM expressions; only the others
pass through an Arrow UDF.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scripts in the order in which they are looked for (Han and kana before these), which of them are compact
#: (no spaces between words) and which inflect.
SCRIPTS = ("Thai", "Lao", "Khmer", "Myanmar", "Hangul", "Arabic", "Hebrew", "Cyrillic", "Greek", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Ethiopic", "Armenian", "Georgian", "Latin")
COMPACT = frozenset("Han Japanese Thai Lao Khmer Myanmar".split())
INFLECTED = frozenset("Arabic Armenian Bengali Cyrillic Devanagari Ethiopic Georgian Greek Gujarati Gurmukhi Hebrew Kannada Hangul Malayalam Sinhala Tamil Telugu".split())
#: Letters that fold into others beyond canonical decomposition, by script.
LATIN_FOLDS = {"ı": "i", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ø": "o", "æ": "ae", "œ": "oe", "ß": "ss"}
ARABIC_FOLDS = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ک": "ك", "ـ": ""}
HEBREW_FOLDS = {"ך": "כ", "ם": "מ", "ן": "נ", "ף": "פ", "ץ": "צ"}
GREEK_FOLDS = {"ς": "σ"}
#: ASCII compounds and what parts them. A compound stands next to no other letter, mark or number.
COMPOUND = r"[a-z0-9]+(?:[._:/\\-][a-z0-9]+)*"
SEGMENTS, PARTS = r"[/\\]+", r"[._:-]+"

_CAMEL = regex.compile(r"([a-z0-9])([A-Z])")
_FORMAT = regex.compile(r"\p{Cf}+")
_COMPOUND = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){COMPOUND}(?![\p{{L}}\p{{M}}\p{{N}}])")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_ASCII = regex.compile(r"[a-z0-9]+")
_ANY_ASCII = re.compile("[a-z0-9]")
_HAN, _KANA = regex.compile(r"\p{Script=Han}"), regex.compile(r"[\p{Script=Hiragana}\p{Script=Katakana}]")
_SCRIPT = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPTS]
_RANKED = [("Japanese", _KANA), ("Han", _HAN), *_SCRIPT]
_LATIN_WORD = regex.compile(r"\p{Script=Latin}[\p{Script=Latin}\p{M}\p{N}]*")
_GRAPHEME = regex.compile(r"\X")
#: Characters of which each is a grapheme by itself where all are of these.
_LONE = regex.compile(r"[\p{GCB=Other}\p{GCB=LV}\p{GCB=LVT}]*")
_MARKS = regex.compile(r"\p{M}+")


@dataclass(frozen=True)
class Profile:
    """folds: none, latin or all scripts; compact: n-grams of compact scripts; inflected: n-gram widths of inflected ones."""

    name: str
    folds: str = "multilingual"
    compact: bool = True
    inflected: tuple[int, ...] = (3,)


DEFAULT = "adaptive-script-v2"
#: The profiles and their switches.
PROFILES = {
    p.name: p
    for p in (
        Profile("unicode-word-no-fold-v1", "none", False, ()),
        Profile("unicode-word-fold-v1", "multilingual", False, ()),
        Profile("legacy-compact-v1", "latin", True, ()),
        Profile("adaptive-no-fold-v2", "none", True, (3,)),
        Profile(DEFAULT),
        Profile("broad-bigram-v2", "multilingual", True, (2, 3)),
    )
}


def normalize(text: str | None) -> str:
    """NFKC and lower case."""
    return unicodedata.normalize("NFKC", text or "").lower()


@lru_cache(None)
def _rank(character: str) -> int:
    """Place of a character's script in the order in which scripts are looked for."""
    return next((i for i, (_, pattern) in enumerate(_RANKED) if pattern.search(character)), len(_RANKED))


def script_of(word: str) -> str | None:
    """Japanese (any kana), Han, or the first of SCRIPTS that occurs anywhere in the word; None for other scripts."""
    at = min(map(_rank, word), default=len(_RANKED))
    return _RANKED[at][0] if at < len(_RANKED) else None


def fold(word: str, script: str | None = None) -> str:
    """A word without marks, ligatures and final forms, as its script has them; the word itself where there is none."""
    script = script or script_of(word)
    swap = lambda table, s: "".join(table.get(c, c) for c in s)
    if script == "Latin":
        return swap(LATIN_FOLDS, _MARKS.sub("", unicodedata.normalize("NFKD", word))) if _LATIN_WORD.fullmatch(word) else word
    if script == "Greek":
        return swap(GREEK_FOLDS, word)
    if script == "Arabic":
        return swap(ARABIC_FOLDS, _MARKS.sub("", word))
    if script == "Hebrew":
        return swap(HEBREW_FOLDS, _MARKS.sub("", word))
    return word


def word_forms(word: str, profile: Profile = PROFILES[DEFAULT]) -> list[str]:
    """The word and, where the profile folds its script, its folded form."""
    script = script_of(word)
    if profile.folds == "none" or profile.folds == "latin" and script != "Latin":
        return [word]
    folded = fold(word, script)
    return [word, folded] if folded and folded != word else [word]


def graphemes(word: str, widths: tuple[int, ...]) -> list[str]:
    if _LONE.fullmatch(word):
        return [word[i : i + n] for n in widths for i in range(len(word) - n + 1)]
    parts = _GRAPHEME.findall(word)
    return ["".join(parts[i : i + n]) for n in widths for i in range(len(parts) - n + 1)]


@lru_cache(1 << 16)
def word_tokens(word: str, profile: Profile = PROFILES[DEFAULT]) -> tuple[str, ...]:
    """The tokens of one word with a character beyond ASCII letters and digits. Texts repeat their words, so the latest ones
    are remembered."""
    script, forms = script_of(word), word_forms(word, profile)
    if script in COMPACT:
        out = [g for f in forms for g in graphemes(f, (2, 3))] if profile.compact else []
    else:
        out = forms + ([g for f in forms for g in graphemes(f, profile.inflected)] if script in INFLECTED else [])
    return tuple(t for t in out if len(t) > 1)


@lru_cache(1 << 16)
def compound_tokens(whole: str) -> tuple[str, ...]:
    """An ASCII compound, its path segments and their parts."""
    out = [whole]
    for segment in filter(None, regex.split(SEGMENTS, whole)):
        if segment != whole:
            out.append(segment)
        out += [p for p in regex.split(PARTS, segment) if p and p not in (segment, whole)]
    return tuple(out)


def _parts(text: str | None) -> tuple[list[str], list[str]]:
    """(tokens of a text's ASCII compounds, its other words in order): the same under every profile."""
    flat = unicodedata.normalize("NFKC", text or "")
    flat = _FORMAT.sub("", _CAMEL.sub(r"\1 \2", flat).lower())
    out: list[str] = []
    for whole in _COMPOUND.findall(flat) if _ANY_ASCII.search(flat) else ():
        out += (whole,) if whole.isalnum() else compound_tokens(whole)
    return [t for t in out if len(t) > 1], [w for w in _WORD.findall(flat) if not w.isascii()]


def tokenize(text: str | None, profile: Profile = PROFILES[DEFAULT]) -> list[str]:
    """The multiset of tokens of a text, in order; null gives none. Tokens have two characters at least."""
    out, words = _parts(text)
    for word in words:
        out += word_tokens(word, profile)
    return out


@lru_cache(1)
def _swaps() -> dict[str, dict[int, str | None]]:
    """From the rule: what fold() makes of each character of the scripts that fold by characters; these lose their marks too,
    but for Greek."""
    return {script: str.maketrans(folds) for script, folds in (("Greek", GREEK_FOLDS), ("Arabic", ARABIC_FOLDS), ("Hebrew", HEBREW_FOLDS))}


def _grams(joined: str, width: int) -> set[str]:
    """The distinct runs of two or three characters of a string that hold no space."""
    import numpy as np

    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if len(codes) < width:
        return set()
    runs = np.lib.stride_tricks.sliding_window_view(codes, width)
    keys = np.unique((runs[(runs != 32).all(1)].astype(np.uint64) << np.arange(0, 21 * width, 21, dtype=np.uint64)).sum(1))
    found = (keys[:, None] >> np.arange(0, 21 * width, 21, dtype=np.uint64) & np.uint64((1 << 21) - 1)).astype(np.uint32)
    return set(found.view(f"<U{width}")[:, 0].tolist())


class _Words:
    """Distinct words of one script with their numbers, and what they give under any profile. Words are joined by a space, which
    none of them holds, so that grams of all of them are cut at once."""

    def __init__(self, script: str | None, counted: dict[str, int]):
        self.script, self.words, self.times = script, list(counted), list(counted.values())
        self.folded: list[tuple[str, int]] = []
        if script == "Latin":
            self.folded = [(f, n) for w, n in counted.items() if (f := fold(w, script)) not in ("", w)]
        elif script in _swaps():
            joined = " ".join(self.words)
            flat = (joined if script == "Greek" else _MARKS.sub("", joined)).translate(_swaps()[script])
            if flat != joined:
                self.folded = [(f, n) for w, f, n in zip(self.words, flat.split(" "), self.times, strict=True) if f not in ("", w)]
        self.done: dict[tuple[bool, int], tuple[set[str], int]] = {}

    def _forms(self, folded: bool) -> tuple[list[str], list[int]]:
        return ([f for f, _ in self.folded], [n for _, n in self.folded]) if folded else (self.words, self.times)

    def found(self, folded: bool, width: int) -> tuple[set[str], int]:
        """(distinct, number) of the words or the folded forms (width 0), or of their grams of a width."""
        if (folded, width) not in self.done:
            import numpy as np

            words, times = self._forms(folded)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            total = int((np.maximum(sizes - max(width, 2) + 1, 0) if width else sizes > 1) @ np.array(times, np.int64)) if words else 0
            if not width:
                out = {w for w in words if len(w) > 1}, total
            elif _LONE.fullmatch(joined := " ".join(words)):
                out = _grams(joined, width), total
            else:
                each = [graphemes(w, (width,)) for w in words]
                out = set().union(*each), sum(n * len(g) for g, n in zip(each, times, strict=True))
            self.done[folded, width] = out
        return self.done[folded, width]

    def parts(self, p: Profile) -> tuple[tuple[bool, int], ...]:
        """What a profile takes of the words, in terms of found()."""
        folds = p.folds == "multilingual" or p.folds == "latin" and self.script == "Latin"
        if self.script in COMPACT:
            widths = (2, 3) if p.compact else ()
        else:
            widths = (0, *(p.inflected if self.script in INFLECTED else ()))
        return tuple((f, w) for f in (False, True) if not f or folds and self.folded for w in widths)


def _by_script(words: list[str]) -> list[_Words]:
    """Words by their script. Where all their characters are of one, no word is looked at by itself."""
    counted = Counter(words)
    ranks = set(map(_rank, set("".join(counted))))
    if len(ranks) == 1 and (at := ranks.pop()) < len(_RANKED):
        return [_Words(_RANKED[at][0], counted)]
    groups: dict[str | None, dict[str, int]] = {}
    for word, n in counted.items():
        groups.setdefault(script_of(word), {})[word] = n
    return [_Words(s, g) for s, g in groups.items()]


def summarize(text: str | None, profiles: list[Profile]) -> list[dict]:
    """What tokenize() gives under each profile: name, tokens, distinct tokens, and the SHA-256 of the sorted distinct ones. The
    text is cut once, its words' forms and grams are made once for all profiles, and profiles that take the same of them share
    their result."""
    plain, words = _parts(text)
    groups, own = _by_script(words) if words else [], set(plain)
    done: dict[tuple, dict] = {}
    out = []
    for p in profiles:
        kind = tuple(g.parts(p) for g in groups)
        if kind not in done:
            each = [g.found(*part) for g, parts in zip(groups, kind, strict=True) for part in parts]
            distinct = own.union(*[t for t, _ in each])
            done[kind] = {"tokens": len(plain) + sum(n for _, n in each), "distinct_tokens": len(distinct), "digest": hashlib.sha256(" ".join(sorted(distinct)).encode()).hexdigest()}
        out.append({"profile": p.name} | done[kind])
    return out


#: Characters whose texts the JVM tokenizes: ASCII, Latin letters that NFKC leaves alone, and common signs.
PLAIN = r"\A[\x00-\x7F]*+(?:[\x{A1}-\x{A7}\x{A9}\x{AB}\x{AC}\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{12F}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{2013}\x{2014}\x{2018}-\x{201E}\x{20AC}][\x00-\x7F]*+)*+\z"
#: A word with a letter beyond ASCII, in a plain text in lower case; it begins where no letter or digit stands before.
ACCENTED = r"(?<![a-z0-9])[a-z0-9]*+[\x{DF}-\x{F6}\x{F8}-\x{17E}][a-z0-9\x{DF}-\x{F6}\x{F8}-\x{17E}]*+"


#: The same in Python's own engine, which is several times as fast on a whole text as `regex`.
_OWN = lambda pattern: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern))
_BEYOND_PLAIN = _OWN("[^\x00-\x7F" + "".join(re.findall(r"\[(\\x\{.*?)\]\[", PLAIN)) + "]")
_PLAIN_ACCENTED, _PLAIN_CAMEL = _OWN(f"({ACCENTED})"), _OWN("[A-Z](?<=[a-z0-9][A-Z])")
#: Compounds of two characters at least, and where two parts of one meet.
_PLAIN_COMPOUND, _PLAIN_JOINED = _OWN(r"[a-z0-9]{2,}+(?:[._:/\\-][a-z0-9]++)*+|[a-z0-9](?:[._:/\\-][a-z0-9]++)++"), _OWN(r"[._:/\\-](?<=[a-z0-9].)[a-z0-9]")


def count_tokens(text: str | None, profile: Profile = PROFILES[DEFAULT]) -> Counter:
    """tokenize() as the number of times that each token occurs. A plain text's words are counted before they are cut into
    parts, so repeated words are cut once."""
    text = text or ""
    if not text.isascii() and _BEYOND_PLAIN.search(text):
        return Counter(tokenize(text, profile))
    flat = _PLAIN_CAMEL.sub(r" \g<0>", text).lower()
    accented: list[str] = []
    if not flat.isascii():
        cut = _PLAIN_ACCENTED.split(flat)
        flat, accented = "\x01".join(cut[::2]), cut[1::2]
    out = Counter(_PLAIN_COMPOUND.findall(flat))
    if _PLAIN_JOINED.search(flat):
        for whole in [w for w in out if not w.isalnum()]:
            for part in compound_tokens(whole)[1:]:
                if len(part) > 1:
                    out[part] += out[whole]
    if accented and profile.folds != "none":
        words = Counter(accented)
        for (word, n), folded in zip(words.items(), "\x01".join(words).translate(_accents()).split("\x01"), strict=True):
            if len(word) > 1:
                out[word] += n
            if folded != word and len(folded) > 1 and word[0] not in "0123456789":
                out[folded] += n
        return out
    for word, n in Counter(accented).items():
        for form in word_tokens(word, profile):
            out[form] += n
    return out


#: ASCII letters and digits stay, the rest parts words.
_RUNS = bytes(c if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))


def encoded_tokens(text: str | None) -> list[bytes]:
    """tokenize() as UTF-8, several times as fast on plain texts."""
    text = text or ""
    if beyond_plain(text):
        return [t.encode() for t in tokenize(text)]
    flat = _PLAIN_CAMEL.sub(r" \g<0>", text).lower()
    accented: list[str] = []
    if not flat.isascii():
        cut = _PLAIN_ACCENTED.split(flat)
        flat, accented = "\x01".join(cut[::2]), cut[1::2]
    if _PLAIN_JOINED.search(flat):
        out = [t.encode() for w in _PLAIN_COMPOUND.findall(flat) for t in ((w,) if w.isalnum() else compound_tokens(w)) if len(t) > 1]
    else:
        out = [w for w in flat.encode("ascii", "replace").translate(_RUNS).split() if len(w) > 1]
    if accented:
        words = list(set(accented))
        forms = {}
        for word, folded in zip(words, "\x01".join(words).translate(_accents()).split("\x01"), strict=True):
            both = (word, folded) if folded != word and word[0] not in "0123456789" else (word,)
            forms[word] = [f.encode() for f in both if len(f) > 1]
        for word in accented:
            out += forms[word]
    return out


@lru_cache(1)
def _accents() -> dict[int, str]:
    """From the rule: what the letters of accented words of plain texts fold into, each by itself."""
    return {c: fold(chr(c)) for c in [*range(0xDF, 0xF7), *range(0xF8, 0x17F)]}


@lru_cache(1)
def _latin_folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """From the rule: letters that fold into one (as two aligned strings) and those that fold into two."""
    single, double = {}, []
    for c in map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x17F)]):
        to = fold(c)
        if c.islower() and to != c:
            single[c] = to if len(to) == 1 else single.get(c)
            if len(to) > 1:
                double.append((c, to))
                single.pop(c)
    return "".join(single), "".join(single.values()), tuple(double)


def fold_latin(word: Column) -> Column:
    """fold() of a word of a plain text, in the JVM: a word that begins with a digit is no Latin word."""
    before, after, double = _latin_folds()
    folded = word
    for c, to in double:
        folded = F.replace(folded, F.lit(c), F.lit(to))
    return F.when(word.rlike("^[0-9]"), word).otherwise(F.translate(folded, before, after))


def _plain_tokens(text: Column, profile: Profile) -> Column:
    """tokenize() of a plain text, in the JVM. Intermediate values are bound once, as lambda variables."""
    flat = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))

    def parts(whole: Column) -> Column:
        segments = F.filter(F.split(whole, SEGMENTS), lambda s: s != "")
        each = F.transform(segments, lambda s: F.concat(F.when(s != whole, F.array(s)).otherwise(F.array().cast("array<string>")), F.filter(F.split(s, PARTS), lambda p: (p != "") & (p != s) & (p != whole))))
        return F.concat(F.array(whole), F.when(whole.rlike(r"[._:/\\-]"), F.flatten(each)).otherwise(F.array().cast("array<string>")))

    def forms(word: Column) -> Column:
        return F.array(word) if profile.folds == "none" else F.array_distinct(F.array(word, fold_latin(word)))

    def found(t: Column) -> Column:
        ascii_only, none = F.octet_length(t) == F.length(t), F.array().cast("array<string>")
        accented = F.when(ascii_only, none).otherwise(F.regexp_extract_all(t, F.lit(ACCENTED), F.lit(0)))
        compounds = F.regexp_extract_all(F.when(ascii_only, t).otherwise(F.regexp_replace(t, ACCENTED, "\x01")), F.lit(COMPOUND), F.lit(0))
        return F.filter(F.concat(F.flatten(F.transform(compounds, parts)), F.flatten(F.transform(accented, forms))), lambda x: F.length(x) > 1)

    return F.transform(F.array(flat), found)[0]


def beyond_plain(text: str) -> bool:
    """Not is_plain(), of a string in Python."""
    return not text.isascii() and _BEYOND_PLAIN.search(text) is not None


def is_plain(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) == F.length(text)) | text.rlike(PLAIN)


def plain_tokens(text: Column, profile: str = DEFAULT) -> Column:
    """Tokens of texts that are known to be plain (is_plain); null gives none. No Python."""
    return _plain_tokens(F.coalesce(text.cast("string"), F.lit("")), PROFILES[profile])


def tokens(text: Column, profile: str = DEFAULT) -> Column:
    """Token arrays; null gives an empty one. Plain texts stay in the JVM: the Arrow UDF sees null in their place."""
    from pyspark.sql.pandas.functions import pandas_udf

    chosen = PROFILES[profile]

    @pandas_udf("array<string>")
    def run(values):
        return values.map(lambda v: tokenize(v, chosen), na_action="ignore")

    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(is_plain(text), _plain_tokens(text, chosen)).otherwise(run(F.when(~is_plain(text), text)))


#: So many documents are counted at a time.
BATCH = 256


def posting_batches(batches, names: list[str], profile: Profile = PROFILES[DEFAULT], only=None):
    """Record batches of a key and a document's fields to such of its postings (term, key, field, len, tf, first, head), a row
    per field and distinct token. first: no earlier field of the document holds the token; head: see heads().

    `only`: tokens of which alone there are rows; then a row without term and key gives the len of each field over a batch's
    documents, those included that hold none of these tokens."""
    import numpy as np
    import pyarrow as pa

    names, key = pa.array(names), None
    only = only and sorted(only)
    for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
        key = batch.schema.names[0]
        rows, size, term, tf, first = [], [], [], [], []
        for fields in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            seen: set[str] = set()
            for place, text in enumerate(fields):
                counted = count_tokens(text, profile) if text else {}
                size.append(sum(counted.values()))
                if only is not None:
                    counted = {t: counted[t] for t in only if t in counted}
                rows.append(len(counted))
                term += counted
                tf += counted.values()
                first += [t not in seen for t in counted] if seen else [True] * len(counted)
                if place + 1 < len(fields):
                    seen.update(counted)
        at = np.repeat(np.arange(len(rows)), rows)
        terms = pa.array(term, pa.string())
        keys = batch.column(0)
        columns = [terms, keys.take(pa.array(at // len(names))), names.take(pa.array(at % len(names))), pa.array(np.array(size, np.int64)[at]), pa.array(tf, pa.int64()), pa.array(first, pa.bool_()), pa.array(heads(terms))]
        if only is not None:
            n, whole = len(names), np.array(size, np.int64).reshape(-1, len(names)).sum(0)
            totals = [pa.nulls(n, terms.type), pa.nulls(n, keys.type), names, pa.array(whole), pa.array([0] * n, pa.int64()), pa.array([False] * n), pa.array([0] * n, pa.int64())]
            columns = [pa.concat_arrays(pair) for pair in zip(columns, totals, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["term", key, "field", "len", "tf", "first", "head"])


def heads(terms):
    """The first seven bytes of each string of an Arrow array as a number, shorter ones filled with zeros: in the order of the
    strings as far as seven bytes tell, and sorted without comparing strings."""
    import numpy as np

    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
    data = np.append(np.frombuffer(terms.buffers()[2] or b"", np.uint8), np.zeros(7, np.uint8)).astype(np.int64)
    out, size = np.zeros(len(terms), np.int64), np.diff(ends)
    for i in range(7):
        out = out << 8 | np.where(size > i, data[ends[:-1] + i], 0)
    return out


def summaries(text: Column, profiles=tuple(PROFILES)) -> Column:
    """summarize() as an array of (profile, tokens, distinct_tokens, digest); a null text counts as empty. Only the counts
    leave Python, not the tokens."""
    from pyspark.sql.pandas.functions import pandas_udf

    chosen = [PROFILES[p] for p in profiles]

    @pandas_udf("array<struct<profile:string,tokens:int,distinct_tokens:int,digest:string>>")
    def run(values):
        return values.map(lambda v: summarize(v, chosen))

    return run(text.cast("string"))


def batch_tokenizer(batch: DataFrame, text: str, profile: str = DEFAULT):
    """The tokenizer for a small batch (queries): without any Python where all its texts are plain."""
    return (lambda c: plain_tokens(c, profile)) if batch.filter(~is_plain(F.col(text))).isEmpty() else (lambda c: tokens(c, profile))


def normalized(text: Column) -> Column:
    """NFKC and lower case; plain text is lowered in the JVM and only the rest is normalized in Python."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(values):
        return values.map(normalize, na_action="ignore")

    return F.when(is_plain(text), F.lower(text)).otherwise(run(F.when(~is_plain(text), text)))


def text_script(text: Column) -> Column:
    """script_of() in Arrow batches, for whole texts: each distinct character is looked up, no text is searched script by script."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(values):
        return values.map(lambda v: script_of("".join(set(v))), na_action="ignore")

    return run(text.cast("string"))


def script(word: Column) -> Column:
    """script_of() in the JVM."""
    out = F.lit(None).cast("string")
    for name in reversed(SCRIPTS):
        out = F.when(word.rlike(rf"\p{{Is{name}}}"), F.lit(name)).otherwise(out)
    return F.when(word.rlike(r"\p{IsHiragana}|\p{IsKatakana}"), F.lit("Japanese")).when(word.rlike(r"\p{IsHan}"), F.lit("Han")).otherwise(out)


def sql_tokens(column: str) -> str:
    """The default tokens of a plain text as a DuckDB expression (RE2 has no look-around, so accented words are cut out)."""
    accented = "[a-z0-9]*[\\x{DF}-\\x{F6}\\x{F8}-\\x{17E}][a-z0-9\\x{DF}-\\x{F6}\\x{F8}-\\x{17E}]*"
    compound, segments, parts = COMPOUND, SEGMENTS, PARTS
    folded = "strip_accents(w)"
    for c, to in LATIN_FOLDS.items():
        folded = f"replace({folded}, '{c}', '{to}')"
    folded = f"case when regexp_matches(w, '^[0-9]') then w else {folded} end"
    return f"""list_transform([lower(regexp_replace(coalesce({column}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))], lambda t: list_filter(
  flatten(list_transform(regexp_extract_all(regexp_replace(t, '{accented}', chr(1), 'g'), '{compound}'), lambda w: [w] || flatten(list_transform(list_filter(string_split_regex(w, '{segments}'), lambda s: s <> ''),
    lambda s: (case when s <> w then [s] else [] end) || list_filter(string_split_regex(s, '{parts}'), lambda p: p <> '' and p <> s and p <> w)))))
  || flatten(list_transform(regexp_extract_all(t, '{accented}'), lambda w: case when {folded} <> w then [w, {folded}] else [w] end)), lambda x: length(x) > 1))[1]"""
