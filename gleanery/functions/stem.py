"""Porter's second English stemmer (the Snowball `english` algorithm, from its published description), applied to a vocabulary."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiouy"
#: Fixed values of the published algorithm.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


ENDS_2, ENDS_3 = tuple(s for s, _ in STEP_2), tuple(s for s, _ in STEP_3)
#: Patterns of the steps.
AFTER, HEAD, SHORT = re.compile(f"[{VOWELS}][^{VOWELS}]"), re.compile("gener|commun|arsen"), re.compile(rf"([^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$")
CONSONANT_Y, POSSESSIVE, VOWEL, DOUBLED = re.compile(rf"(^|(?<=[{VOWELS}]))y"), re.compile("('s'|'s|')$"), re.compile(f"[{VOWELS}]"), re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
STEP_1B, STEP_1B_EE = re.compile("(ingly|edly|ing|ed)$"), re.compile("(eedly|eed)$")


def regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant that follows a vowel, and again from there."""

    def after(at: int) -> int:
        m = AFTER.search(w, at)
        return m.end() if m else len(w)

    head = HEAD.match(w)
    r1 = head.end() if head else after(0)
    return r1, after(r1)


def is_short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(SHORT.search(w))


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.lstrip("'")
    w = CONSONANT_Y.sub("Y", w) if "y" in w else w
    r1, r2 = regions(w)
    w = POSSESSIVE.sub("", w) if "'" in w else w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if m := STEP_1B_EE.search(w) if w.endswith(("eed", "eedly")) else None:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := STEP_1B.search(w) if w.endswith(("ed", "ing", "ly")) else None) and VOWEL.search(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif DOUBLED.search(w):
            w = w[:-1]
        elif is_short(w, r1):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for suffix, new in STEP_2 if w.endswith(ENDS_2) else ():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for suffix, new in STEP_3 if w.endswith(ENDS_3) else ():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for suffix in STEP_4 if w.endswith(STEP_4) else ():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not is_short(w[:-1], len(w)))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def with_stems(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """Adds `stem`; each distinct term is stemmed once, and the vocabulary joined back."""

    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(stem, na_action="ignore")

    vocabulary = terms.select(F.col(term_col).alias("_t")).where("_t is not null").distinct().withColumn("stem", stems("_t"))
    return terms.join(vocabulary, terms[term_col] == F.col("_t"), "left").drop("_t")
