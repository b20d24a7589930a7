"""Text predicates and normalisation as Column expressions.

Everything except composition to NFC and tone marks is a built-in expression and stays inside the JVM. The character classes are
spelled out because the shorthand classes of regex dialects differ.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from topicweave.functions.fixed_values import CODAS, NUCLEI, ONSETS, TEXT_SEPARATOR, TONED_VOWELS
from topicweave.operators.grams import chunks, cut, glued

SPACE = r"[\s\x1c-\x1f]"  # with (?U): all Unicode whitespace plus the four separator controls
NOT_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f]"
# Characters below U+0300, precomposed Latin and plain punctuation are stable under NFC when no mark follows them.
MAY_COMPOSE = r"[^\x{0}-\x{2ff}\x{1e00}-\x{1eff}\x{2010}-\x{2027}\x{2030}-\x{205e}]"


def is_blank(col: Column) -> Column:
    """Null or nothing but whitespace. Never null itself, so its negation is the exact complement."""
    return col.isNull() | F.coalesce(col.rlike(rf"(?U)^{SPACE}*\z"), F.lit(False))


def squeeze(col: Column) -> Column:
    """Whitespace runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(col, rf"(?U){SPACE}+", " "))


def words(col: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    return F.filter(F.split(F.regexp_replace(col, rf"(?U){SPACE}+", " "), " "), lambda w: w != "")


def clean(col: Column) -> Column:
    """Anything that is neither letter, number, underscore nor space becomes a space; then squeeze."""
    return squeeze(F.regexp_replace(col, rf"(?U){NOT_WORD}", " "))


def has_invalid_char(col: Column) -> Column:
    return col.rlike(rf"(?U){NOT_WORD}")


def has_extra_space(col: Column) -> Column:
    """A run of two or more whitespace characters, or whitespace at either end."""
    return col.rlike(rf"(?U){SPACE}{{2,}}|\A{SPACE}|{SPACE}\z")


def lower(col: Column) -> Column:
    return F.lower(col)


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(col: Column) -> Column:
    """Canonical composition. Only texts holding a character that can change travel to Python."""
    return F.coalesce(_compose(F.when(col.rlike(MAY_COMPOSE), col)), col)


def drop_words(col: Column, stop: Sequence[str]) -> Column:
    """Remove listed words, exact case; repeats and order of the others stay. For short lists (see also
    ``operators.lexicon.remove_stopwords``)."""
    listed = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.array_join(F.filter(words(col), lambda w: ~F.array_contains(listed, w)), " ")


def assemble(parts: Sequence[Column], sep: str = TEXT_SEPARATOR) -> Column:
    """Join parts; a missing part counts as empty text and keeps its separator."""
    out = F.coalesce(parts[0], F.lit(""))
    for part in parts[1:]:
        out = F.concat(out, F.lit(sep), F.coalesce(part, F.lit("")))
    return out


def first_sentence(col: Column) -> Column:
    """Up to and including the first sentence mark that is followed by whitespace."""
    return F.regexp_extract(col, r"(?s)\A(.*?[.!?…](?=\s)|.*)", 1)


VOWELS = "".join(TONED_VOWELS)
_BASES = "".join(v[0] * len(v) for v in TONED_VOWELS)
_TONES = "012345" * len(TONED_VOWELS)
# The same vowels as regex classes: the block U+1EA0-U+1EF9 as one range keeps matching fast.
_ANY_VOWEL = "aeiouyàáâãèéêìíòóôõùúýăĩũơư\u1ea0-\u1ef9"
_TONED = "àáãèéìíòóõùúýĩũ\u1ea0-\u1ef9"


def _either(parts: Sequence[str]) -> str:
    return "|".join(sorted(parts, key=lambda p: (-len(p), p)))


NEXT_TO_VOWEL = f"[{_ANY_VOWEL}][{_TONED}]|[{_TONED}][{_ANY_VOWEL}]"
SYLLABLE = re.compile(f"({_either(ONSETS)})?([{_ANY_VOWEL}]{{2,3}})({_either(CODAS)})?")
_TO_TONE, _TO_BASE = str.maketrans(VOWELS, _TONES), str.maketrans(VOWELS, _BASES)
_OWN_MARK = str.maketrans("ăâêôơưaeiouy", "111111000000")


@lru_cache(1 << 16)
def place_tone(word: str) -> str:
    """Move the tone mark of a lower-case Vietnamese syllable to its customary vowel; any other word is unchanged.

    The mark belongs on the vowel with a diacritic of its own (the later one if there are two); else, before a final
    consonant, on the last vowel; else on the first of two or the middle one of three vowels.
    """
    found = SYLLABLE.fullmatch(word)
    if not found:
        return word
    onset, vowels, coda = (part or "" for part in found.groups())
    base, tone = vowels.translate(_TO_BASE), vowels.translate(_TO_TONE).replace("0", "")
    # "gi" is one onset, so an i after g is not part of the vowel cluster
    if base not in NUCLEI or len(tone) != 1 or (onset == "g" and base.startswith("i")):
        return word
    own_mark = base.translate(_OWN_MARK).rfind("1")
    at = own_mark if own_mark >= 0 else len(base) - 1 if coda else 1 if len(base) == 3 else 0
    # in the vowel table a vowel without tone is followed by its five toned forms
    return f"{onset}{base[:at]}{VOWELS[VOWELS.index(base[at]) + int(tone)]}{base[at + 1:]}{coda}"


@F.arrow_udf(StringType())
def _toned(texts: pa.Array) -> pa.Array:
    """Only the distinct words of some texts with a toned vowel next to another vowel are looked at one by one."""
    parts = []
    for some in chunks(texts):
        c = cut(some, clauses=False)
        at = pc.match_substring_regex(c.listed, NEXT_TO_VOWEL)
        if pc.any(at).as_py():
            placed = pa.array([place_tone(w) for w in c.listed.filter(at).to_pylist()], pa.string())
            c.words = pc.replace_with_mask(c.listed, at, placed).take(pa.array(c.code))
        parts.append(glued(c, np.zeros(len(c.first), bool)))
    return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), pa.concat_arrays(parts) if parts else texts)


def normalize_tone(col: Column) -> Column:
    """Tone placement for every word of a lower-case text; words end up separated by single spaces."""
    return _toned(col)
