"""Text analysis as column expressions: tokens, stop words, stems, trigrams.

All of it runs on the array of tokens inside one row, so analysing a document
never shuffles. Corpora are stemmed by distinct word in Arrow batches. The same
rules exist as column steps, for vocabularies: each step is its own `transform`,
which binds the previous step's word to a lambda variable and keeps the plan
linear in size.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LANGUAGES = {
    "en": "english", "fr": "french", "de": "german", "es": "spanish",
    "it": "italian", "pt": "portuguese", "nl": "dutch", "ru": "russian",
    "ar": "arabic", "zh": "chinese",
}

_MARK = "\u001f"

# Porter (1980). A word is [C](VC)^m[V]; `y` is a consonant only at the start
# (held as `Y` while stemming) or after a vowel.
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
M_GT_0 = f"^(?:{_C})?{_V}{_C}"
M_EQ_1 = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
M_GT_1 = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^(?:{_C})?[aeiouy]"
CVC = f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(?:" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxy") + ")$"

# Suffix and replacement of steps 2 and 3, suffixes of step 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

# Light suffix stripping for the other languages: (pattern, kept part).
LIGHT_RULES = {
    "french": [("^(.{3,}?)aux$", "al"), ("^(.{3,}?)(?:es|[xseé])$", "")],
    "german": [("^(.{4,}?)(?:ern|em|er|en|es|[ens])$", "")],
    "spanish": [("^(.{3,}?)(?:os|as|es|[soae])$", "")],
    "italian": [("^(.{3,}?)[aeio]$", "")],
    "portuguese": [("^(.{3,}?)(?:os|as|es|[soae])$", "")],
    "dutch": [("^(.{4,}?)(?:en|e|s)$", "")],
    "russian": [("^(.{3,}?)(?:иями|ями|ами|ого|его|ому|ему|ыми|ими|ах|ях|ов|ев|ей|ой|ый|ий|ая|яя|ое|ее|ые|ие|ам|ям|ом|ем|ых|их|ую|юю|[аяоеыиуюьй])$", "")],
    "arabic": [("^(?:وال|بال|كال|فال|ال|لل)(.{3,})$", ""), ("^(.{3,}?)(?:ات|ون|ين|ان|ها|ية|[هةي])$", "")],
    # Written without blanks: tokens are runs of signs and stay as they are.
    "chinese": [],
}


def full_language(code: str) -> str:
    """The name of a language; one without rules is refused here, not in a running job."""
    name = LANGUAGES.get(code, code)
    if name != "simple" and name not in LIGHT_RULES and name != "english":
        raise ValueError(f"no text analysis for {code!r}: use one of {', '.join([*LANGUAGES, *LANGUAGES.values(), 'simple'])}")
    return name


@lru_cache(maxsize=None)
def stop_words(language: str) -> tuple[str, ...]:
    """The stop words of a language; `simple` has none.

    Fixed values: the public lists that Spark ML ships, one word a line.
    """
    name = full_language(language)
    if name == "simple":
        return ()
    with open(os.path.join(os.path.dirname(__file__), "stopwords", f"{name}.txt"), encoding="utf-8") as f:
        return tuple(w for w in f.read().split("\n") if w.strip())


def split_pattern(separators: tuple[str, ...] = (), symbols: tuple[str, ...] = ()) -> str:
    """Regex of what lies between tokens.

    Letters and digits make tokens; `symbols` are kept inside tokens as well,
    `separators` always split.
    """
    kept = "".join(re.escape(s) for s in symbols)
    outside = f"[^\\p{{L}}\\p{{N}}{kept}]"
    if not separators:
        return outside + "+"
    return f"(?:{outside}|[{''.join(re.escape(s) for s in separators)}])+"


def tokens(text: Column, separators: tuple[str, ...] = (), symbols: tuple[str, ...] = ()) -> Column:
    return F.filter(F.split(F.lower(text), split_pattern(separators, symbols)), lambda t: t != "")


def _replace_suffix(word: Column, pattern: str, suffixes: dict[str, str]) -> Column:
    stem = F.regexp_extract(word, pattern, 1)
    suffix = F.regexp_extract(word, pattern, 2)
    new = F.lit("")
    for old, rep in suffixes.items():
        if rep:
            new = F.when(suffix == old, rep).otherwise(new)
    return F.when(stem.rlike(M_GT_0), F.concat(stem, new)).otherwise(word)


def _porter_steps():
    """The steps in order, each a function word -> word."""
    def start(w):
        return F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substr(w, F.lit(2)))).otherwise(w)

    def plural(w):
        short = F.length(w) < 3
        return (
            F.when(short | ~w.endswith("s") | w.endswith("ss"), w)
            .when(w.rlike("^.+(?:ss|i)es$"), F.substr(w, F.lit(1), F.length(w) - 2))
            .otherwise(F.substr(w, F.lit(1), F.length(w) - 1))
        )

    def past(w):
        eed = F.regexp_extract(w, "^(.+?)eed$", 1)
        stem = F.regexp_extract(w, "^(.+?)(?:ed|ing)$", 1)
        return (
            F.when(~(w.endswith("ed") | w.endswith("ing")), w)
            .when(w.rlike("^.+eed$"), F.when(eed.rlike(M_GT_0), F.concat(eed, F.lit("ee"))).otherwise(w))
            .when(stem.rlike(HAS_VOWEL), F.concat(stem, F.lit(_MARK)))
            .otherwise(w)
        )

    def past_tidy(w):
        stem = F.substr(w, F.lit(1), F.length(w) - 1)
        return (
            F.when(~w.endswith(_MARK), w)
            .when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike(DOUBLE), F.substr(stem, F.lit(1), F.length(stem) - 1))
            .when(stem.rlike(M_EQ_1) & stem.rlike(CVC), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    def final_y(w):
        stem = F.substr(w, F.lit(1), F.length(w) - 1)
        return F.when(w.endswith("y") & (F.length(w) > 2) & stem.rlike(HAS_VOWEL),
                      F.concat(stem, F.lit("i"))).otherwise(w)

    def long_suffix(w):
        pattern = "^(.+?)(" + "|".join(STEP2) + ")$"
        return F.when(F.substring(w, -1, 1).isin(*sorted({s[-1] for s in STEP2})),
                      _replace_suffix(w, pattern, STEP2)).otherwise(w)

    def short_suffix(w):
        pattern = "^(.+?)(" + "|".join(STEP3) + ")$"
        return F.when(F.substring(w, -1, 1).isin(*sorted({s[-1] for s in STEP3})),
                      _replace_suffix(w, pattern, STEP3)).otherwise(w)

    def last_suffix(w):
        plain = F.regexp_extract(w, "^(.+?)(?:" + "|".join(STEP4) + ")$", 1)
        ion = F.regexp_extract(w, "^(.+?[st])ion$", 1)
        return (
            F.when(plain != "", F.when(plain.rlike(M_GT_1), plain).otherwise(w))
            .when(ion.rlike(M_GT_1), ion)
            .otherwise(w)
        )

    def final_e(w):
        stem = F.substr(w, F.lit(1), F.length(w) - 1)
        return F.when(
            w.endswith("e") & (stem.rlike(M_GT_1) | (stem.rlike(M_EQ_1) & ~stem.rlike(CVC))), stem
        ).otherwise(w)

    def double_l(w):
        return F.when(w.endswith("ll") & w.rlike(M_GT_1),
                      F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    def finish(w):
        return F.when(w.startswith("Y"), F.concat(F.lit("y"), F.substr(w, F.lit(2)))).otherwise(w)

    return (start, plural, past, past_tidy, final_y, long_suffix, short_suffix,
            last_suffix, final_e, double_l, finish)


def porter(word: str) -> str:
    """Porter's algorithm for one word, by the same rule tables as the column steps."""
    if len(word) < 3:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if w.endswith("s"):  # step 1a
        if w.endswith(("sses", "ies")) and len(w) > (4 if w.endswith("sses") else 3):
            w = w[:-2]
        elif not w.endswith("ss"):
            w = w[:-1]
    if w.endswith("eed") and len(w) > 3:  # step 1b
        w = w[:-1] if _M_GT_0(w[:-3]) else w
    elif w.endswith(("ed", "ing")):
        stem = w[:-2] if w.endswith("ed") else w[:-3]
        if stem and _HAS_VOWEL(stem):
            if stem.endswith(("at", "bl", "iz")):
                stem += "e"
            elif _DOUBLE(stem):
                stem = stem[:-1]
            elif _M_EQ_1(stem) and _CVC(stem):
                stem += "e"
            w = stem
    if w.endswith("y") and len(w) > 2 and _HAS_VOWEL(w[:-1]):  # step 1c
        w = w[:-1] + "i"
    for suffixes, find in ((STEP2, _LONG), (STEP3, _SHORT)):  # steps 2 and 3
        m = find(w)
        if m and _M_GT_0(m[1]):
            w = m[1] + suffixes[m[2]]
    m = _PLAIN(w)  # step 4
    if m:
        w = m[1] if _M_GT_1(m[1]) else w
    elif (m := _ION(w)) and _M_GT_1(m[1]):
        w = m[1]
    if w.endswith("e") and (_M_GT_1(w[:-1]) or (_M_EQ_1(w[:-1]) and not _CVC(w[:-1]))):  # step 5
        w = w[:-1]
    if w.endswith("ll") and _M_GT_1(w):
        w = w[:-1]
    return "y" + w[1:] if w[:1] == "Y" else w


def _rule(pattern: str):
    return re.compile(pattern).search


_M_GT_0, _M_EQ_1, _M_GT_1, _HAS_VOWEL, _CVC, _DOUBLE = map(_rule, (M_GT_0, M_EQ_1, M_GT_1, HAS_VOWEL, CVC, DOUBLE))
_LONG, _SHORT = (_rule("^(.+?)(" + "|".join(s) + ")$") for s in (STEP2, STEP3))
_PLAIN, _ION = _rule("^(.+?)(?:" + "|".join(STEP4) + ")$"), _rule("^(.+?[st])ion$")

#: Stems remembered by a worker.
STEMS_KEPT = 1_000_000


@lru_cache(maxsize=1)
def _known_stems() -> dict[str, str]:
    return {}


def stem_lists(words: pa.Array) -> pa.Array:
    """Arrays of words to arrays of stems: every different word of a batch is stemmed once."""
    coded = words.flatten().dictionary_encode()
    known = _known_stems()
    if len(known) > STEMS_KEPT:
        known.clear()
    stemmed = []
    for w in coded.dictionary.to_pylist():
        s = known.get(w)
        if s is None:
            s = known[w] = porter(w)
        stemmed.append(s)
    values = pa.array(stemmed, pa.string()).take(coded.indices)
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    mask = words.is_null() if words.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def english_stems(words: Column) -> Column:
    """`stems` for English by distinct words, for whole corpora."""
    return F.arrow_udf(stem_lists, ArrayType(StringType()))(words)


def stems(words: Column, language: str) -> Column:
    """Stem every word of an array, in the JVM; null entries stay null."""
    name = full_language(language)
    if name == "simple":
        return words
    if name == "english":
        for step in _porter_steps():
            words = F.transform(words, step)
        return words
    for pattern, ending in LIGHT_RULES.get(name, []):
        words = F.transform(words, lambda w: F.regexp_replace(w, pattern, "$1" + ending))
    return words


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms. `simple`: no stop words, no stemming."""

    language: str = "english"
    separators: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()

    def unstemmed(self, text: Column) -> Column:
        """One entry per token: the token, or null for a stop word."""
        words = tokens(text, self.separators, self.symbols)
        stop = stop_words(self.language)
        return F.transform(words, lambda t: F.when(~t.isin(*stop), t)) if stop else words

    def marked(self, text: Column) -> Column:
        """One entry per token: its stem, or null for a stop word."""
        words = self.unstemmed(text)
        return english_stems(words) if full_language(self.language) == "english" else stems(words, self.language)

    def terms(self, text: Column) -> Column:
        """Stems in text order, stop words left out."""
        return F.filter(self.marked(text), lambda t: t.isNotNull())

    def occurrences(self, text: Column) -> Column:
        """Sorted array of (term, 1-based position); stop words keep their place."""
        at = F.transform(self.marked(text), lambda t, i: F.struct(t.alias("term"), (i + 1).alias("pos")))
        return F.array_sort(F.filter(at, lambda o: o["term"].isNotNull()))


def by_language(lang: Column, text: Column, languages=("en", "fr", "de", "es")) -> Column:
    """Terms by the language named in each row; other languages are `simple`."""
    out = Analyzer("simple").terms(text)
    for code in reversed(languages):
        out = F.when(lang == code, Analyzer(code).terms(text)).otherwise(out)
    return out


def without_stop_words(lang: Column, words: Column, languages=("en", "fr", "de", "es")) -> Column:
    out = words
    for code in reversed(languages):
        stop = stop_words(code)
        kept = F.filter(words, lambda t: ~t.isin(*stop))
        out = F.when(lang == code, kept).otherwise(out)
    return out


def trigrams(word: Column) -> Column:
    """Distinct character trigrams of a word padded with two blanks and one."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3)))
    )
