"""The english analyzer: stop words and the Porter2 stemming algorithm, after its published description."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published algorithm: exceptional words and suffix lists.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(w, start)
        return m.end() if m else len(w)

    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            return len(head), after(len(head))
    r1 = after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.fullmatch("[aeiouy][^aeiouy]", w) or re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w))


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    w = word.lstrip("'")
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    if w in INVARIANT:
        return w
    w = re.sub("(^|(?<=[aeiouy]))y", "Y", w)
    r1, r2 = _regions(w.replace("Y", "\x01"))
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    m = re.search("(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[0].startswith("eed"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for a, b in STEP_2:
        if w.endswith(a):
            w = w[: -len(a)] + b if len(w) - len(a) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for a, b in STEP_3:
        if w.endswith(a):
            w = w[: -len(a)] + b if len(w) - len(a) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for a in STEP_4:
        if w.endswith(a):
            w = w[: -len(a)] if len(w) - len(a) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


def english_tokens(text: str, stop: frozenset) -> list[str]:
    return [stem(t) for t in re.split(r"[^\w']+|_", text.lower()) if t.strip("'") and t not in stop]
