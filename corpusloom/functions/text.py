"""Text functions as Column expressions: cleaning, normalization, tokens, shingles, paragraph insertion.

One LanguageProfile drives both tracks. Only Unicode NFKC, HTML entities and morphological segmentation, which Spark has
no function for, run in Python.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and word lists that results depend on.
EN_PATTERNS = {
    "reply": r"(?imsdU)^on .+? wrote:\s*$.*\z",
    "quoted": r"(?mdU)^\s*>.*(?:\n|$)",
    "signature": r"(?msdU)^\s*--\s*$.*\z",
    "header": r"(?imdU)^(?:from|to|cc|bcc|subject|date|sent|reply-to):[^\n]*(?:\n|$)",
    "html": r"(?sd)<[^>]+>",
    "url": r"(?iU)\b(?:https?://|www\.)[^\s<>]+",
    "email": r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
}
JA_PATTERNS = {
    "reply": r"(?imsdU)^[^\n]*次のように(?:書きました|送信しました)[:：].*\z",
    "quoted": r"(?mdU)^\s*[>＞].*(?:\n|$)",
    "signature": r"(?msdU)^\s*--\s*$.*\z",
    "header": r"(?imdU)^(?:差出人|宛先|件名|送信日時|Cc|Bcc)[:：][^\n]*(?:\n|$)",
    "html": r"(?sd)<[^>]+>",
    "url": r"(?i)(?:https?://|www\.)[A-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+",
    "email": r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
}
TOKEN = r"<(?:[Uu][Rr][Ll]|[Ee][Mm][Aa][Ii][Ll])>|[\p{L}\p{N}]++(?:'[\p{L}\p{N}]++)?+"
PUNCTUATION = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-"}
STOP_WORDS = ("a", "an", "and", "are", "at", "for", "from", "in", "is", "of", "on", "or", "please", "the", "to", "with")
NEGATIONS = ("not", "no", "never", "without", "cannot")
VERSION = "1.0.0"
STEPS = ("reply", "quoted", "signature", "header", "html", "url", "email")


@dataclass(frozen=True)
class LanguageProfile:
    name: str
    patterns: dict = field(hash=False)
    spaced: bool = True  # words are separated by blanks


EN = LanguageProfile("en", EN_PATTERNS)
JA = LanguageProfile("ja", JA_PATTERNS, spaced=False)


@dataclass(frozen=True)
class CleanConfig:
    """Every cleaning step can be left out. version: only VERSION is known."""

    profile: LanguageProfile = EN
    steps: tuple[str, ...] = STEPS
    unicode: bool = True
    lowercase: bool = True
    remove_stop_words: bool = False
    protect_negations: bool = True
    lemmatize: bool = False
    version: str = VERSION

    def __post_init__(self):
        if self.version != VERSION:
            raise ValueError(f"unsupported preprocessing version {self.version!r}")
        if self.lemmatize:
            raise NotImplementedError("lemmatization")
        if unknown := set(self.steps) - set(STEPS):
            raise ValueError(f"unknown steps {sorted(unknown)}")

    def without(self, *steps: str) -> "CleanConfig":
        return replace(self, steps=tuple(s for s in self.steps if s not in steps))


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# By rows, in batches of a hundred: an Arrow batch would hold ten thousand texts, whatever their length.
@F.udf(T.StringType(), useArrow=False)
def unescape_html(x: str | None) -> str | None:
    return None if x is None else html.unescape(x)


@F.udf(T.StringType(), useArrow=False)
def nfkc(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKC", x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once. Inside f's lambdas a plain expression would be computed for every element,
    since Spark evaluates what a lambda refers to where it stands."""
    return F.transform(F.array(value), f)[0]


def clean(c: Column | str, config: CleanConfig = CleanConfig()) -> Column:
    """Remove reply blocks, quotes, signatures and headers, strip tags, mask URLs and addresses, in this order."""
    out, p = _text(c), config.profile.patterns
    for step in STEPS:
        if step not in config.steps:
            continue
        if step == "html":
            out = F.regexp_replace(out, p["html"], " ")
            out = unescape_html(out) if config.unicode else out
        else:
            out = F.regexp_replace(out, p[step], {"url": "<URL>", "email": "<EMAIL>"}.get(step, ""))
    return out


def normalize(c: Column | str, config: CleanConfig = CleanConfig()) -> Column:
    """NFKC, plain punctuation, single blanks, lower case. Without config.unicode all of it is JVM-side."""
    out = nfkc(_text(c)) if config.unicode else _text(c)
    if not config.profile.spaced:
        out = F.regexp_replace(out, "ー+", "ー")
        wide = r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}ー]"
        out = F.regexp_replace(F.regexp_replace(out, rf"(?<={wide}) +", ""), rf" +(?={wide})", "")
    out = F.translate(out, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    out = F.replace(out, F.lit("…"), F.lit("..."))
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.lower(out) if config.lowercase else out


def tokens(c: Column | str, config: CleanConfig = CleanConfig()) -> Column:
    """<URL>, <EMAIL> and words of letters and digits with an inner apostrophe; stop words go, negations stay."""
    found = F.regexp_extract_all(_text(c), F.lit(TOKEN), F.lit(0))
    if not config.remove_stop_words:
        return found
    gone = [w for w in STOP_WORDS if not (config.protect_negations and w in NEGATIONS)]
    return F.filter(found, lambda t: ~F.lower(t).isin(gone))


#: Segmenters by name: functions of a pandas Series of texts to a Series of token lists. A morphological analyser can be
#: registered here; its instance belongs in a module variable so that each worker makes it once.
SEGMENTERS: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register_segmenter(name: str, function: Callable[[pd.Series], pd.Series]) -> None:
    SEGMENTERS[name] = function


def segment(c: Column | str, name: str = "char2") -> Column:
    """Tokens of unspaced text by a registered segmenter, else character n-grams ("char" and n)."""
    if name in SEGMENTERS:
        return F.pandas_udf(SEGMENTERS[name], T.ArrayType(T.StringType()))(_text(c))
    if name.startswith("char"):
        return char_shingles(F.regexp_replace(_text(c), r"(?U)\s+", ""), int(name[4:]), distinct=False)
    raise ValueError(f"unknown segmenter {name!r}")


def preprocess(raw: Column | str, config: CleanConfig = CleanConfig()) -> Column:
    """struct(raw_text, clean_text, tokens, stats) of a text column."""
    raw = _text(raw)
    cleaned = normalize(clean(raw, config), config)
    toks = tokens(cleaned, config) if config.profile.spaced else segment(cleaned)
    return F.struct(raw.alias("raw_text"), cleaned.alias("clean_text"), toks.alias("tokens"), text_stats(raw, cleaned, toks, config).alias("stats"))


def text_stats(raw: Column, cleaned: Column, toks: Column, config: CleanConfig = CleanConfig()) -> Column:
    p = config.profile.patterns
    count = lambda step: F.regexp_count(raw, F.lit(p[step])) if step in config.steps else F.lit(0)
    lines = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(F.regexp_replace(c, r"\n\z", ""), "\n")))
    return F.struct(
        F.length(raw).alias("raw_characters"), F.length(cleaned).alias("clean_characters"),
        F.greatest(F.length(raw) - F.length(cleaned), F.lit(0)).alias("removed_characters"),
        lines(raw).alias("raw_lines"), lines(cleaned).alias("clean_lines"), F.size(toks).alias("tokens"),
        count("url").alias("urls"), count("email").alias("emails"),
    )


def casefold(c: Column | str) -> Column:
    """Lower case with ß as ss."""
    return F.replace(F.lower(_text(c)), F.lit("ß"), F.lit("ss"))


def contains_any(c: Column | str, needles: tuple[str, ...]) -> Column:
    """Any needle as a substring of the casefolded text."""
    return let(casefold(c), lambda folded: F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(folded, n)))


def _rolling(n: Column, k: int, part: Callable[[Column], Column]) -> Column:
    """part(i) for every start i of k neighbours among n, at least one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), part)


def _none() -> Column:
    return F.array().cast("array<string>")


def _neighbours(w: Column, k: int) -> Column:
    """Every k neighbouring words of a list of k at least, joined by blanks."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))


def word_shingles(words: Column, k: int = 3) -> Column:
    """Distinct k-word shingles joined by blanks; a shorter text is one shingle, an empty one has none."""
    return let(words, lambda w: F.when(F.size(w) >= k, F.array_distinct(_neighbours(w, k))).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(_none()))


def char_shingles(c: Column | str, k: int = 5, distinct: bool = True) -> Column:
    """k neighbouring characters; a shorter text is one shingle, an empty one has none. Of an array of characters, as finding the i-th one
    in a string takes i steps."""
    def of(t: Column) -> Column:
        rolling = _rolling(F.size(t), k, lambda i: F.array_join(F.slice(t, i, F.lit(k)), ""))
        return F.when(F.size(t) > 0, F.array_distinct(rolling) if distinct else rolling).otherwise(_none())
    return let(F.filter(F.split(_text(c), ""), lambda x: x != ""), of)


def word_ngrams(words: Column, n: int) -> Column:
    return let(words, lambda w: F.when(F.size(w) >= n, _neighbours(w, n)).otherwise(_none()))


def _part(text: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.substring(text, i, F.lit(n))


def char_wb_ngrams(words: Column, low: int = 2, high: int = 3) -> Column:
    """Character n-grams inside words padded with a blank on both sides."""
    def of(padded: Column) -> Column:
        return F.concat(*[F.when(F.length(padded) >= n, _rolling(F.length(padded), n, _part(padded, n))).otherwise(_none()) for n in range(low, high + 1)])
    return F.flatten(F.transform(words, lambda word: let(F.concat(F.lit(" "), word, F.lit(" ")), of)))


def char_wb_joined(words: Column, low: int = 2, high: int = 3) -> Column:
    """The n-grams of char_wb_ngrams in another order, found by a pattern in all words at once: no window over two blanks or from inside a
    surrogate pair is one."""
    def of(joined: Column) -> Column:
        return F.concat(*[F.regexp_extract_all(joined, F.lit(rf"(?s)(?![\uDC00-\uDFFF]|.{{0,{n - 2}}}  )(?=(.{{{n}}}))"), F.lit(1)) for n in range(low, high + 1)])
    return let(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")), of)


def salted_hash(shingle: Column, seed: Column | int, salt: Column | int) -> Column:
    """First 64 bits of the SHA-256 of "seed:salt:shingle" as 16 hex digits, whose order is that of the numbers."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(F.sha2(F.concat_ws(":", lit(seed).cast("string"), lit(salt).cast("string"), shingle), 256), 1, 16)


def least_hash(shingles: Column, prefix: Column) -> Column:
    """The least `salted_hash` of a list of shingles, prefix being "seed:salt:"; whole digests are compared, and one is cut."""
    return F.substring(F.array_min(F.transform(shingles, lambda s: F.sha2(F.concat(prefix, s), 256))), 1, 16)


POSITIONS = ("early", "mid", "end")


def insert_paragraph(body: Column | str, sentence: Column, position: Column) -> Column:
    """Insert a sentence as a paragraph: after the first (early), in the middle (mid), or last (end)."""
    parts = F.split(_text(body), r"\n[ \t]*\n")
    n = F.size(parts)
    at = F.when(position == "early", F.least(F.lit(1), n)).when(position == "mid", F.greatest(F.lit(1), F.floor(n / 2).cast("int"))).when(position == "end", n)
    at = F.coalesce(at, F.raise_error(F.concat(F.lit("unknown position "), F.coalesce(position, F.lit("null")))).cast("int"))
    before = F.slice(parts, F.lit(1), at)
    after = F.slice(parts, at + 1, F.greatest(n - at, F.lit(0)))
    return F.array_join(F.concat(before, F.array(sentence), after), "\n\n")


def splice_body(raw: Column | str, body: Column | str, new_body: Column) -> Column:
    """raw with its part `body` replaced; an error where raw does not contain it."""
    raw, body = _text(raw), _text(body)
    at = F.position(body, raw)
    missing = F.raise_error(F.lit("the body is not part of the raw text")).cast("string")
    return F.when(at > 0, F.concat(F.substring(raw, F.lit(1), at - 1), new_body, F.substring(raw, at + F.length(body), F.length(raw)))).otherwise(missing)
