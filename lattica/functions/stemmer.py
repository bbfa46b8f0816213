"""Porter's stemmer as a Column expression: suffixes rewritten in ordered steps, each under a condition on what is left.

The conditions look at a word as vowels and consonants: its measure is how often a
vowel is followed by a consonant. The form is the one that ROUGE scorers use, with
its few irregular words and its rules for short words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.text import let

#: Words with a stem of their own, and the suffixes of the second to fourth step with what replaces them.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
SECOND = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

Rule = tuple[str, str, Callable[[Column], Column] | None]


def shape(word: Column) -> Column:
    """The word with v for vowels and c for consonants; a y after a consonant is a vowel."""
    step = lambda seen, c: F.concat(seen, F.when(c.isin(*"aeiou") | ((c == "y") & seen.endswith("c")), "v").otherwise("c"))
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(""), step)


def measure(word: Column) -> Column:
    return let(shape(word), lambda s: (F.length(s) - F.length(F.replace(s, F.lit("vc"), F.lit("")))) / 2)


def has_vowel(word: Column) -> Column:
    return F.contains(shape(word), F.lit("v"))


def doubled(word: Column) -> Column:
    """Ends in one consonant twice."""
    return (F.length(word) >= 2) & (F.substring(word, -1, 1) == F.substring(word, -2, 1)) & shape(word).endswith("c")


def short_end(word: Column) -> Column:
    """Ends in consonant, vowel and a consonant other than w, x or y; of two letters, in vowel and consonant."""
    return let(shape(word), lambda s: (s.endswith("cvc") & ~F.substring(word, -1, 1).isin("w", "x", "y")) | (s == "vc"))


def _rewrite(word: Column, rules: list[Rule]) -> Column:
    """The first rule whose suffix the word has decides: the suffix is replaced if its condition holds for what is left."""
    out = word
    for suffix, instead, condition in reversed(rules):
        left = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        new = F.concat(left, F.lit(instead))
        out = F.when(word.endswith(suffix), new if condition is None else F.when(condition(left), new).otherwise(word)).otherwise(out)
    return out


def _positive(left: Column) -> Column:
    return measure(left) > 0


def _plural(w: Column) -> Column:
    return F.when(w.endswith("ies") & (F.length(w) == 4), F.substring(w, F.lit(1), F.lit(3))).otherwise(_rewrite(w, [("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None)]))


def _past(w: Column) -> Column:
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)

    def mended(left: Column) -> Column:
        last = F.substring(left, -1, 1)
        single = F.when(doubled(left) & ~last.isin("l", "s", "z"), F.substring(left, F.lit(1), F.length(left) - 1))
        e = F.when((measure(left) == 1) & short_end(left), F.concat(left, F.lit("e")))
        return F.when(left.rlike("(at|bl|iz)$"), F.concat(left, F.lit("e"))).otherwise(F.when(doubled(left), F.coalesce(single, left)).otherwise(F.coalesce(e, left)))

    ied = F.when(F.length(w) == 4, F.concat(cut(3), F.lit("ie"))).otherwise(F.concat(cut(3), F.lit("i")))
    eed = F.when(measure(cut(3)) > 0, F.concat(cut(3), F.lit("ee"))).otherwise(w)
    drop = lambda n: let(cut(n), lambda left: F.when(has_vowel(left), mended(left)).otherwise(w))
    return F.when(w.endswith("ied"), ied).when(w.endswith("eed"), eed).when(w.endswith("ed"), drop(2)).when(w.endswith("ing"), drop(3)).otherwise(w)


def _y(w: Column) -> Column:
    left = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when(w.endswith("y") & (F.length(left) > 1) & shape(left).endswith("c"), F.concat(left, F.lit("i"))).otherwise(w)


def _second(w: Column) -> Column:
    rules: list[Rule] = [(s, r, _positive) for s, r in SECOND]
    rules.append(("logi", "log", lambda left: measure(F.concat(left, F.lit("l"))) > 0))
    # what ends in -alli is read again once it ends in -al
    again = let(_rewrite(w, [("alli", "al", _positive)]), lambda x: F.when(x != w, _rewrite(x, rules)).otherwise(_rewrite(w, rules)))
    return F.when(w.endswith("alli"), again).otherwise(_rewrite(w, rules))


def _fourth(w: Column) -> Column:
    twice = lambda left: measure(left) > 1
    return _rewrite(w, [(s, "", (lambda left: (measure(left) > 1) & left.rlike("[st]$")) if s == "ion" else twice) for s in FOURTH])


def _last_e(w: Column) -> Column:
    left = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when(w.endswith("e"), let(measure(left), lambda m: F.when((m > 1) | ((m == 1) & ~short_end(left)), left).otherwise(w))).otherwise(w)


def _last_l(w: Column) -> Column:
    left = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when(w.endswith("ll") & (measure(left) > 1), left).otherwise(w)


def stem(word: Column | str) -> Column:
    """The stem of a lower-case word; a word of at most two letters is its own, null stays null."""
    word = F.col(word) if isinstance(word, str) else word
    steps = (_plural, _past, _y, _second, lambda w: _rewrite(w, [(s, r, _positive) for s, r in THIRD]), _fourth, _last_e, _last_l)

    def run(w: Column) -> Column:
        out = w
        for step in steps:
            out = let(out, step)
        known = F.lit(None).cast("string")
        for form, own in IRREGULAR.items():
            known = F.when(w == form, own).otherwise(known)
        return F.when(F.length(w) <= 2, w).otherwise(F.coalesce(known, out))

    return let(word, run)
