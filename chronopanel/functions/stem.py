"""English stems (Porter's second algorithm) of words in lower case, each distinct word once a worker."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm: endings and what they become, longest first in each step.
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
VOWELS = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 start: after the first consonant that follows a vowel, and again from there."""
    m = re.match(r"gener|commun|arsen", w)
    after = lambda at: at + x.end() if (x := re.search(rf"[{VOWELS}][^{VOWELS}]", w[at:])) else len(w)
    r1 = m.end() if m else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", w)) or bool(re.fullmatch(rf"[{VOWELS}][^{VOWELS}]", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    w = word.lstrip("'")
    w = re.sub(rf"(?<=[{VOWELS}])y|^y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s?'?$", "", w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{VOWELS}].+s$", w):
        w = w[:-1]
    # 1b: past and present forms
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end.startswith("eed"):
                w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
            elif re.search(f"[{VOWELS}]", w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                    w = w[:-1]
                elif _short_end(w) and len(w) <= r1:
                    w += "e"
            break
    # 1c, 2, 3, 4, 5
    w = re.sub(rf"(?<=.)(?<=[^{VOWELS}])[yY]$", "i", w)
    for end in sorted(STEP2, key=len, reverse=True):
        if w.endswith(end):
            w = w[: -len(end)] + STEP2[end] if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end in sorted(STEP3, key=len, reverse=True):
        if w.endswith(end):
            w = w[: -len(end)] + STEP3[end] if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stems(words: Column) -> Column:
    """Stems of an array of words; null for null."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [stem(w) for w in x])

    return run(words)
