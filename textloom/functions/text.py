"""Column expressions over text: cleaning, keys, words, sentences, shingles.

White space is what Python's str.split() splits at, spelled out as a character
class that Java and RE2 both read; their ``\\s`` is ASCII only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ODD = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = rf"[\x09-\x0D\x1C-\x20{_ODD}]"
SPACE_IN_LINE = rf"[\x09\x0B-\x0D\x1C-\x20{_ODD}]"

#: A run of signs before an @ is looked at from its start only, or from where the last match ended.
EMAIL = r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]+\.[\w.]+"

SHORT_BELOW, MEDIUM_BELOW = 120, 350
SHINGLE, SKETCH = 5, 128


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it, also inside of other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def blank(c: Column) -> Column:
    """Null, or nothing but white space: ends at the first sign."""
    return ~F.coalesce(c.rlike(rf"[^{SPACE[1:-1]}]"), F.lit(False))


def clean(c: Column) -> Column:
    """Line ends to LF, no white space at line ends or around the text; null stays null."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), rf"{SPACE_IN_LINE}+(?=\n|\z)", ""))


def dedup_key(c: Column) -> Column:
    """Lower case, one space for each run of white space, none around."""
    return F.regexp_replace(F.lower(strip(c)), rf"{SPACE}+", " ")


def words(c: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), rf"{SPACE}+"), "")


def word_count(c: Column) -> Column:
    n = lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, rf"{SPACE}+")))
    return bind(strip(F.coalesce(c, F.lit(""))), n).cast("long")


def length_bucket(n_words: Column, given: Column | None = None) -> Column:
    """short, medium or long by number of words; a given value stays."""
    bucket = F.when(n_words < SHORT_BELOW, "short").when(n_words < MEDIUM_BELOW, "medium").otherwise("long")
    return bucket if given is None else F.coalesce(given, bucket)


def alpha_words(c: Column) -> Column:
    """Lower-case runs of ASCII letters and apostrophes that begin with a letter."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z][a-z']*"), 0)


def shingles(c: Column, n: int = SHINGLE) -> Column:
    """Distinct CRC-32 of the character n-grams of the key; at most n characters: one hash of them; empty: none."""

    def of(t: Column) -> Column:
        grams = F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1)
        some = F.when(F.length(t) <= n, F.array(t)).otherwise(grams)
        return F.when(t == "", F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(some, lambda g: F.crc32(F.encode(g, "UTF-8")))))

    return bind(dedup_key(F.coalesce(c, F.lit(""))), of)


def sketch(hashes: Column, k: int = SKETCH) -> Column:
    """The k least hashes, ascending."""
    return F.slice(F.array_sort(hashes), 1, k)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    share = lambda both: both / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(bind(F.size(F.array_intersect(a, b)), share))


#: Abbreviations after which a sentence goes on, besides single letters.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e", "fig", "vol", "no", "approx", "cf", "al")
#: Not a character, so in no text.
_CUT = "\ufdd0"
#: White space after a stop; what is before it is looked at from white space only.
_STOP = r"""\s(?<=[.!?]["'’”)\]]{0,3}\s)\s*"""


def sentences(c: Column) -> Column:
    """Sentences of a text: cut at white space after a stop, unless an abbreviation or a single letter is before it."""
    pieces = F.split(strip(F.coalesce(c, F.lit(""))), _STOP)
    last = lambda s: F.lower(F.regexp_replace(F.regexp_extract(s, r"\S+\z", 0), r"""[.!?"'’”)\]]+\z|\A["'“‘(\[]+""", ""))
    goes_on = lambda s: s.endswith(".") & bind(last(s), lambda x: x.isin(*ABBREVIATIONS) | x.rlike(r"\A[a-z]\z"))

    full = lambda p: F.split(F.array_join(F.transform(p, lambda s: F.concat(s, F.when(goes_on(s), " ").otherwise(_CUT))), ""), _CUT)
    return F.filter(F.transform(bind(pieces, lambda p: F.when(F.exists(p, goes_on), full(p)).otherwise(p)), lambda s: F.rtrim(s)), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, without white space around them."""
    return F.filter(F.transform(F.split(clean(F.coalesce(c, F.lit(""))), r"\n[^\S\n]*\n\s*"), strip), lambda p: p != "")


def any_of(phrases: Iterable[str]) -> str:
    """A pattern of any of the phrases, the longest first: alternatives part where their letters do, so a place is looked at once."""
    tree: dict = {}
    for p in phrases:
        at = tree
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(node: dict) -> str:
        parts = [re.escape(c) + of(node[c]) for c in sorted(node) if c]
        if not parts:
            return ""
        one = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return one + "?" if "" in node else one

    return of(tree)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern)).cast("long")


def match_case(like: Column, new: Column) -> Column:
    """new in the case of like: all capitals (two letters or more), first capital, or as it is."""

    def cased(n: Column) -> Column:
        first = F.substring(like, 1, 1)
        capital = F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1_000_000))
        shout = (F.length(like) > 1) & (like == F.upper(like)) & (like != F.lower(like))
        return F.when(shout, F.upper(n)).when((first == F.upper(first)) & (first != F.lower(first)), capital).otherwise(n)

    return bind(new, cased)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of the parts: the same in every partitioning, and in SQL by md5."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    joined = reduce(lambda a, b: F.concat(a, F.lit("|"), b.cast("string")), cols[1:], cols[0].cast("string"))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def uniform_sql(*parts: str) -> str:
    """The DuckDB expression equal to uniform(); parts are SQL expressions."""
    joined = " || '|' || ".join(f"({p})::varchar" for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::bigint / 4294967296.0::double)"


def derive_seed(seed: Column, label: Column) -> Column:
    """(seed * 1000003 + crc32(label)) mod 2^32."""
    return F.pmod(seed.cast("long") * F.lit(1000003) + F.crc32(F.encode(label, "UTF-8")), F.lit(1 << 32))
