"""Text normalisers and comparisons as Column expressions; null counts as the empty string."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width characters, and words that lexical comparison leaves out.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
STOP_WORDS = ("the", "a", "an", "of", "in", "on", "at", "for", "to", "from", "by", "with", "is", "was", "were", "are", "be", "been", "being", "and", "or", "that", "this", "these", "those", "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "as", "into", "about")
#: Printable ASCII with single blanks between words; ASCII letters and digits with single blanks; the first without parentheses and with a letter or digit.
PLAIN = r"\A[!-~]+(?: [!-~]+)*\z"
SIMPLE_NAME = r"\A[A-Za-z0-9]+(?: [A-Za-z0-9]+)*\z"
PLAIN_NAME = r"\A(?=[^A-Za-z0-9]*[A-Za-z0-9])[!-'*-~]+(?: [!-'*-~]+)*\z"
#: Endings of names that make an alias without them; punctuation that answers lose; articles.
NAME_ENDINGS = ("jr", "sr", "ii", "iii", "iv")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")


def let(value: Column, body) -> Column:
    """Bind ``value`` once for several uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Characters whose case-folding isn't their lower case: one-to-one ones, and those that become several."""
    ones, to, many = [], [], {}
    for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x1F000)]):
        for low in {c, c.lower()}:
            if len(low) == 1 and (folded := low.casefold()) != low.lower():
                if len(folded) == 1:
                    if low not in ones:
                        ones.append(low)
                        to.append(folded)
                else:
                    many[low] = folded
    return "".join(ones), "".join(to), many


def casefold(c: Column | str) -> Column:
    """Unicode case-folding. ASCII text only pays for lower()."""
    ones, to, many = _fold_table()
    text = _text(c)
    low = F.lower(text)
    single = F.translate(low, ones, to)
    several = single
    for k, v in many.items():
        several = F.replace(several, F.lit(k), F.lit(v))
    return F.when(text.rlike(r"\A\p{ASCII}*\z"), low).when(single.rlike("[" + "".join(many) + "]"), several).otherwise(single)


def _is(c: Column | str, pattern: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string").rlike(pattern)


def normalize_text(c: Column | str) -> Column:
    """Without zero-width characters; runs of white space as one blank; trimmed. Printable ASCII with single blanks is what it gives, and only pays for the look."""
    return F.when(_is(c, PLAIN), _text(c)).otherwise(_normalized(c))


def _normalized(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.translate(_text(c), ZERO_WIDTH, ""), r"(?U)\s+", " "))


def canonical_entity_key(c: Column | str) -> Column:
    """Case-folded letters and digits of what stands outside parentheses; ``symbol:`` and the text where none are left."""

    def keyed(text: Column) -> Column:
        key = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
        return F.when(key == "", F.concat(F.lit("symbol:"), text)).otherwise(key)

    plain = F.trim(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9]+", " "))
    return F.when(_is(c, SIMPLE_NAME), F.lower(_text(c))).when(_is(c, PLAIN_NAME), plain).otherwise(let(casefold(F.regexp_replace(normalize_text(c), r"\([^)]*\)", "")), keyed))


def canonical_relation(c: Column | str) -> Column:
    return casefold(normalize_text(c))


def content_hash(*parts: Column | str) -> Column:
    """SHA-256 of the normalised parts, joined by the unit separator."""
    return normal_hash(*[normalize_text(p) for p in parts])


def normal_hash(*parts: Column | str) -> Column:
    """content_hash of parts that are normalised already."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def balanced_text(c: Column | str) -> Column:
    """normalize_text with missing closing parentheses added and surplus ones at the end taken off."""

    def balance(text: Column) -> Column:
        count = lambda p: F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))
        more = count("(") - count(")")
        tail = F.length(F.regexp_extract(text, r"\)*$", 0))
        return F.when(more > 0, F.concat(text, F.repeat(F.lit(")"), more))).when(more < 0, F.substring(text, F.lit(1), F.length(text) - F.least(-more, tail))).otherwise(text)

    return let(normalize_text(c), balance)


def lexical_tokens(c: Column | str) -> Column:
    """Lower-case ASCII words without stop words, in order."""
    words = F.split(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9\s]+", " "), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def normalize_lex(c: Column | str) -> Column:
    return F.array_join(lexical_tokens(c), " ")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def jaccard(a: Column | str, b: Column | str) -> Column:
    return overlap(lexical_tokens(a), lexical_tokens(b))


def char_grams(c: Column | str, n: int = 3) -> Column:
    """Distinct n-grams of the lexical text without blanks; a shorter text is its own gram."""
    return let(
        F.replace(normalize_lex(c), F.lit(" "), F.lit("")),
        lambda s: F.when(s == "", F.array().cast("array<string>")).when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n))))),
    )


def char_gram_jaccard(a: Column | str, b: Column | str, n: int = 3) -> Column:
    return overlap(char_grams(a, n), char_grams(b, n))


def alias_keys(c: Column | str) -> Column:
    """The key of a name, the key without its last word where it has three words or more, and without a name ending."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(balanced_text(c), r"\([^)]*\)", "")), r"[^a-z0-9\s]+", " "), r"\s+", " "))

    def keys(k: Column) -> Column:
        words = F.split(k, " ")
        shorter = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
        cut = (F.size(words) >= 3) | ((F.size(words) >= 2) & F.element_at(words, -1).isin(*NAME_ENDINGS))
        return F.when(cut, F.array_distinct(F.array(k, shorter))).otherwise(F.array(k))

    return let(key, keys)


def contains_mention(question: Column | str, name: Column | str) -> Column:
    """The name's lexical form, its first two words, or its only word of five letters or more stands in the question's."""

    def found(q: Column, t: Column) -> Column:
        whole = F.array_join(t, " ")
        return (F.size(t) > 0) & (F.contains(q, whole) | ((F.size(t) >= 2) & F.contains(q, F.array_join(F.slice(t, 1, 2), " "))))

    return let(normalize_lex(question), lambda q: let(lexical_tokens(name), lambda t: found(q, t)))


def value_matches(value: Column, answer: Column) -> Column:
    """Either text holds the other; an empty one never matches."""
    return (value != "") & (answer != "") & (F.contains(value, answer) | F.contains(answer, value))


def answer_text(c: Column | str) -> Column:
    """Lower-case, without ASCII punctuation, blanks collapsed: the form that answer metrics compare."""
    return F.trim(F.regexp_replace(F.translate(F.lower(_text(c)), PUNCTUATION, ""), r"(?U)\s+", " "))


def passage_text(c: Column | str) -> Column:
    """Lower-case, punctuation as blanks, without articles: the form that passage recall compares."""
    bare = F.regexp_replace(F.lower(_text(c)), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(" + "|".join(ARTICLES) + r")\b", " "), r"(?U)\s+", " "))


def relation_phrase(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(_text(c)), "_-", "  "), r"\s+", " "))


def anchor_tokens(c: Column | str) -> Column:
    """Words of more than one character outside parentheses, without stop words."""
    words = F.split(F.regexp_replace(F.lower(F.regexp_replace(_text(c), r"\([^)]*\)", " ")), "[^0-9a-z]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def sentences(c: Column | str) -> Column:
    """Cut after ., ! or ? and white space."""
    return F.filter(F.transform(F.split(_text(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def clauses(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(_text(c), r"[;:]\s+|\s+and\s+|\s+but\s+"), lambda s: F.trim(s)), lambda s: s != "")


def years(c: Column | str) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(r"\b(1[0-9]{3}|20[0-9]{2})\b"), F.lit(1))


def numbers(c: Column | str) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(r"\b([0-9]+(?:\.[0-9]+)?)\b"), F.lit(1))


def is_attribute_like(triple_type: Column, dst: Column) -> Column:
    """ATTRIBUTE, or a digit in the object, or an object of at most two words that is all lower case."""
    words = F.size(F.split(F.trim(dst), r"\s+"))
    return (F.upper(triple_type) == "ATTRIBUTE") | dst.rlike("[0-9]") | ((words <= 2) & (dst == F.lower(dst)) & (dst != ""))


def name_reasons(name: Column | str) -> Column:
    """Why a name is suspicious: very_short, numeric_only, symbol_only, very_long."""
    text = normalize_text(name)
    reasons = [(F.length(text) <= 1, "very_short"), (text.rlike(r"^[0-9\s.,%-]+$"), "numeric_only"), (~text.rlike(r"[\p{L}\p{N}]"), "symbol_only"), (F.length(text) > 120, "very_long")]
    return F.array_compact(F.array(*[F.when(test, F.lit(why)) for test, why in reasons]))
