"""The stemmer against published examples and against a plain reading of its rules."""

import itertools

from lattica.functions import stemmer

PUBLISHED = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi relational relat conditional condit rational ration
valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll ties tie died die flies fli dying die skies sky news news""".split()


def plain(word):
    """The same rules, letter by letter."""
    if word in stemmer.IRREGULAR:
        return stemmer.IRREGULAR[word]
    if len(word) <= 2:
        return word

    def cons(w, i):
        return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not cons(w, i - 1))

    def m(w):
        kinds = [k for k, _ in itertools.groupby(cons(w, i) for i in range(len(w)))]
        return sum(1 for a, b in itertools.pairwise(kinds) if not a and b)

    def cvc(w):
        if len(w) == 2:
            return not cons(w, 0) and cons(w, 1)
        return len(w) > 2 and cons(w, len(w) - 3) and not cons(w, len(w) - 2) and cons(w, len(w) - 1) and w[-1] not in "wxy"

    def first(w, rules):
        for suffix, new, test in rules:
            if w.endswith(suffix):
                left = w[: len(w) - len(suffix)]
                return left + new if test(left) else w
        return w

    w = word
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    else:
        w = first(w, [("sses", "ss", bool), ("ies", "i", lambda _: True), ("ss", "ss", lambda _: True), ("s", "", lambda _: True)])
    if w.endswith("ied"):
        w = w[:-3] + ("ie" if len(w) == 4 else "i")
    elif w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                left = w[: -len(end)]
                if any(not cons(left, i) for i in range(len(left))):
                    w = left
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1):
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif m(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and len(w) > 2 and cons(w, len(w) - 2):
        w = w[:-1] + "i"
    second = [(s, r, lambda left: m(left) > 0) for s, r in stemmer.SECOND] + [("logi", "log", lambda left: m(left + "l") > 0)]
    if w.endswith("alli") and m(w[:-4]) > 0:
        w = first(w[:-2], second)
    else:
        w = first(w, second)
    w = first(w, [(s, r, lambda left: m(left) > 0) for s, r in stemmer.THIRD])
    w = first(w, [(s, "", (lambda left: m(left) > 1 and left[-1:] in ("s", "t")) if s == "ion" else (lambda left: m(left) > 1)) for s in stemmer.FOURTH])
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and m(w[:-1]) > 1:
        w = w[:-1]
    return w


def test_published_examples_and_a_vocabulary(spark):
    want = dict(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
    assert {w: plain(w) for w in want} == want
    roots = ["", "a", "by", "toy", "sky", "hop", "plan", "relat", "gener", "oxygen", "yell", "str", "eye", "commun", "pr", "fizz", "roll", "syzyg"]
    ends = ["", "s", "es", "ies", "ied", "y", "ing", "ed", "eed", *[s for s, _ in stemmer.SECOND], "logi", *[s for s, _ in stemmer.THIRD], *stemmer.FOURTH, "sion", "e", "ll", "alli", "ationalli"]
    words = sorted({r + e for r in roots for e in ends} - {""} | want.keys() | {"x1", "1234", "año"})
    assert len(words) > 1000
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stemmer.stem("w").alias("s")).collect()}
    assert got == {w: plain(w) for w in words}
    assert spark.createDataFrame([(None,), ("",)], "w string").select(stemmer.stem("w").alias("s")).collect() == [(None,), ("",)]
