"""Phrases of edges, paths, prompts and edits as Column expressions; null counts as the empty string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.text import canonical_entity_key, let, normalize_text

#: What a question asks for, by words that all stand in it; the first that fits, else OTHER_RELATION.
QUESTION_RELATIONS = (
    ("birth date", ("when", "born")), ("release date", ("when", "release")), ("release date", ("when", "published")), ("date", ("when",)), ("located in", ("where",)),
    ("person", ("who",)), ("capital", ("capital",)), ("population", ("population",)), ("language", ("language",)), ("genre", ("genre",)),
)
OTHER_RELATION = "related to"
#: Words for a role that are no name by themselves; marks in the outputs of models.
ROLE_WORDS = ("director", "mother", "father", "husband", "wife", "composer", "performer")
ANSWER_MARK, END_MARK, STOP_MARK, CUT_MARK = "The answer to the question is:", "<|im_end|>", "<|endoftext|>", "<|object_ref_end|>"
#: How a model's prompt frames its question.
PROMPTS = {"plain": "%s", "chat": "<|user|>\n%s\n<|assistant|>\n", "instruct": "[INST] %s [/INST]"}


def text_of(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def kv_direction(key: Column | str, value: Column | str, src: Column | str, dst: Column | str) -> Column:
    """forward where the value is the target, backward where it is the source; else by which end alone the key holds; else unknown."""
    low = lambda c: F.lower(normalize_text(c))
    k, v, s, d = low(key), low(value), low(src), low(dst)
    holds = lambda end: (end != "") & F.contains(k, end)
    return F.when(v == d, "forward").when(v == s, "backward").when(holds(s) & ~holds(d), "forward").when(holds(d) & ~holds(s), "backward").otherwise("unknown")


def edge_text(src: Column | str, relation: Column | str, dst: Column | str, key: Column | str | None = None, value: Column | str | None = None) -> Column:
    """The parts of an edge that aren't empty, joined by `` ; ``."""
    parts = [text_of(c) for c in (src, relation, dst, key, value) if c is not None]
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p != ""), " ; ")


def is_attribute_key(key: Column | str) -> Column:
    """A key of the form ``the x of y``."""
    low = F.lower(text_of(key))
    return low.startswith("the ") & F.contains(low, F.lit(" of "))


def path_text(name: Column | str, relation1: Column | str, relation2: Column | str, attribute1: Column, attribute2: Column) -> Column:
    """What two edges in a row ask for from the first one's source, in words, by which of the two are attributes."""
    n, r1, r2 = (text_of(c) for c in (name, relation1, relation2))
    first = F.when(attribute1, F.concat(F.lit("the "), r1, F.lit(" of "), n))
    both = F.concat(F.lit("the "), r2, F.lit(" of "), first)
    ends = F.concat(F.lit("the "), r2, F.lit(" of which "), n, F.lit(" "), r1)
    begins = F.concat(F.lit("the "), r2, F.lit(" related to "), first)
    return F.when(attribute1 & attribute2, both).when(attribute2, ends).when(attribute1, begins).otherwise(F.concat_ws(" ", n, r1, r2))


def question_relation(c: Column | str) -> Column:
    """The relation that a question asks for by its words."""
    low = F.lower(normalize_text(c))
    told = [F.when(reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in words]), F.lit(relation)) for relation, words in QUESTION_RELATIONS]
    return F.coalesce(*told, F.lit(OTHER_RELATION))


def answer_of_output(c: Column | str) -> Column:
    """What a model's output gives as its answer: what follows the answer mark up to the end mark, else the last line before the end mark that isn't empty."""

    def told(out: Column) -> Column:
        until = lambda x: F.regexp_replace(F.element_at(F.split(x, END_MARK.replace("|", r"\|")), 1), r"^\s+|\s+$", "")
        marked = F.when(F.contains(out, F.lit(ANSWER_MARK)), until(F.element_at(F.split(out, ANSWER_MARK), -1)))
        lines = F.filter(F.transform(F.split(until(out), "\n"), lambda x: F.trim(x)), lambda x: x != "")
        return F.coalesce(F.nullif(marked, F.lit("")), F.element_at(F.concat(F.array(F.lit("")), lines), -1))

    return let(F.trim(F.replace(text_of(c), F.lit(STOP_MARK), F.lit(""))), told)


def should_regenerate(c: Column | str) -> Column:
    """An output that stops at a reference before it gives an answer."""
    out = text_of(c)
    return out.endswith(CUT_MARK) & ~F.contains(out, F.lit(ANSWER_MARK))


def chunks(tokens: Column, size: int) -> Column:
    """Runs of ``size`` tokens; the last one may be shorter."""
    return F.when(F.size(tokens) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(tokens), F.lit(size)), lambda i: F.slice(tokens, i, size)))


def changed_tokens(old: Column, new: Column, size: int) -> Column:
    """Tokens of the chunks of ``new`` that differ from the chunk of ``old`` at their place."""

    def count(a: Column, b: Column) -> Column:
        return F.aggregate(F.transform(b, lambda chunk, i: F.when(F.get(a, i).eqNullSafe(chunk), 0).otherwise(F.size(chunk))), F.lit(0).cast("long"), lambda n, x: n + x)

    return let(chunks(old, size), lambda a: let(chunks(new, size), lambda b: count(a, b)))


def edited(tokens: Column, seed: Column, insert: bool, word: str = "edited") -> Column:
    """Tokens with one replaced by ``word``, or ``word`` put in, at a place that the seed's hash gives."""
    at = F.pmod(F.conv(F.substring(F.md5(seed.cast("string")), 1, 8), 16, 10).cast("long"), F.size(tokens) + (1 if insert else 0)).cast("int")
    cut = at if insert else at + 1
    changed = F.concat(F.slice(tokens, 1, at), F.array(F.lit(word)), F.slice(tokens, cut + 1, F.size(tokens)))
    return changed if insert else F.when(F.size(tokens) == 0, tokens).otherwise(changed)


def context_set_size(step: Column, every: int = 100, first: int = 4) -> Column:
    """How large a knowledge base a training step sees: ``first`` more after each ``every`` steps."""
    return first * (F.floor(step / every) + 1)


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts as compact JSON with sorted field names."""
    return F.sha2(canonical_json(**{f"p{i}": (F.col(p) if isinstance(p, str) else p) for i, p in enumerate(parts)}), 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of the fields in order of their names, nulls included."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def prompt(question: Column | str, family: str) -> Column:
    return F.format_string(PROMPTS[family], text_of(question))


def typed_triples(c: Column | str) -> Column:
    """Lines ``TYPE|subject|relation|object`` as structs; lines of another form, another type or an empty field are left out."""
    fields = F.transform(F.split(text_of(c), "\n"), lambda line: F.transform(F.split(line, r"\|"), lambda f: F.trim(f)))
    good = F.filter(fields, lambda f: (F.size(f) >= 4) & F.upper(F.get(f, 0)).isin("RELATION", "ATTRIBUTE") & (F.get(f, 1) != "") & (F.get(f, 2) != "") & (F.get(f, 3) != ""))
    return F.transform(good, lambda f: F.struct(F.upper(f[0]).alias("triple_type"), f[1].alias("subject"), f[2].alias("predicate"), f[3].alias("object")))


def linearised_triples(c: Column | str) -> Column:
    """Triples of text in the form ``<triplet> head <subj> tail <obj> relation``; a head may have several pairs."""

    def of_head(chunk: Column) -> Column:
        parts = F.split(chunk, "<subj>")
        head = F.trim(F.get(parts, 0))
        pairs = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.split(p, "<obj>"))
        whole = F.filter(pairs, lambda p: (F.size(p) >= 2) & (F.trim(p[0]) != "") & (F.trim(F.get(p, 1)) != "") & (head != ""))
        return F.transform(whole, lambda p: F.struct(head.alias("subject"), F.trim(p[1]).alias("predicate"), F.trim(p[0]).alias("object")))

    bare = F.regexp_replace(text_of(c), "<s>|</s>|<pad>", "")
    heads = F.split(bare, "<triplet>")
    return F.flatten(F.transform(F.slice(heads, 2, F.size(heads)), of_head))


def is_value_like(name: Column | str) -> Column:
    """A text that reads like a value, not a name: with a digit, or of at most three words beginning in lower case."""
    return let(normalize_text(name), lambda t: t.rlike("[0-9]") | (t.rlike(r"^\p{Ll}") & (F.size(F.split(t, " ")) <= 3)))


def is_value_like_node(name: Column | str, n_in: Column, n_in_attributes: Column) -> Column:
    """A value by its text, or half of a node's in-edges, one at least, are attributes."""
    return is_value_like(name) | ((n_in > 0) & (n_in_attributes >= F.greatest(F.lit(1), F.floor(n_in / 2))))


def object_reasons(name: Column | str, generic: tuple[str, ...] = ()) -> Column:
    """Why the object of a relation is suspicious: a generic term, a phrase of up to three words in lower case, a role word alone."""

    def reasons(text: Column) -> Column:
        words = F.split(canonical_entity_key(text), " ")
        plain = (F.size(words) <= 3) & F.forall(words, lambda w: w.rlike(r"^\p{L}+$")) & (text == F.lower(text))
        tests = [(canonical_entity_key(text).isin(*generic) if generic else F.lit(False), "generic_term_lexicon"), (plain, "lowercase_common_phrase"), ((F.size(words) == 1) & words[0].isin(*ROLE_WORDS), "singleton_role_word")]
        return F.array_compact(F.array(*[F.when(test, F.lit(why)) for test, why in tests]))

    return let(normalize_text(name), reasons)


def prompt_lines(items: Column, heading: str) -> Column:
    """A heading and the items as numbered lines; the empty text for no items."""
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.size(items) == 0, F.lit("")).otherwise(F.concat(F.lit(heading + "\n"), F.array_join(lines, "\n")))


def templated_question(name: Column | str, relation: Column | str, seed: Column, templates: tuple[str, ...]) -> Column:
    """One of some templates (with two places, relation and name), picked by the seed's hash."""
    made = F.array(*[F.format_string(t, text_of(relation), text_of(name)) for t in templates])
    at = F.pmod(F.conv(F.substring(F.md5(seed.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(len(templates))).cast("int")
    return F.get(made, at)


def without_anchor(key: Column, anchor: Column) -> Column:
    """A key without its anchor: the first that applies of ``of anchor``, ``anchor's``, the anchor at an end, the anchor anywhere; blanks cleaned."""
    a = normalize_text(anchor)
    k = normalize_text(key)
    quoted = F.regexp_replace(a, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    forms = [F.concat(F.lit(r"(?i)\s+of\s+"), quoted, F.lit(r"\b")), F.concat(F.lit(r"(?i)\b"), quoted, F.lit(r"'s\b")), F.concat(F.lit(r"(?i)^"), quoted, F.lit(r"\b|\b"), quoted, F.lit(r"$")), F.concat(F.lit("(?i)"), quoted)]
    out = k
    for form in reversed(forms):
        out = F.when(F.regexp_like(k, form), F.regexp_replace(k, form, F.lit(" "))).otherwise(out)
    return F.when(a == "", k).otherwise(normalize_text(out))
