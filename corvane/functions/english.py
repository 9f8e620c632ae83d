"""English words as lexemes: stop words and the Porter2 ("English") stemmer of the Snowball family.

A small helper for vocabularies: texts are cut into words by Spark or in batches, and each different word is stemmed once
a task. The stemmer is a fixed sequence of steps; each looks for the longest of its endings and acts on that one alone.
"""

from __future__ import annotations

import re

# The stop words of the English text search configuration.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can "
    "will just don should now".split()
)
# Words with stems of their own, words that stay, and words that stay after the first step.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
IRREGULAR |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
FINISHED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Endings and what takes their place, by step.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

VOWEL = "[aeiouy]"
_WORD = re.compile(r"[^\W_]+")
_VOWEL = re.compile(VOWEL)
_CONSONANT_Y = re.compile(f"(^|{VOWEL})y")
_REGION = re.compile(f"{VOWEL}[^aeiouy]")
_SHORT_END = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _after(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins, from `start` on."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


class _Endings:
    """Endings of which a word's longest is looked up by length, from the longest on."""

    def __init__(self, endings):
        self.held, self.last = frozenset(endings), frozenset(e[-1] for e in endings)
        self.sizes = sorted({len(e) for e in endings}, reverse=True)

    def of(self, word: str) -> str | None:
        if word[-1:] in self.last:
            for n in self.sizes:
                if word[-n:] in self.held:
                    return word[-n:]
        return None


_PAST, _STEP2, _STEP3, _STEP4 = map(_Endings, (("eed", "eedly", "ed", "edly", "ing", "ingly"), STEP2, STEP3, STEP4))


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _PAST.of(w)
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if end is None or not _VOWEL.search(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if len(w) <= r1 and _SHORT_END.search(w) else w


def _stays(word: str) -> bool:
    """Whether a word's last letters are such that no step acts on it."""
    last = word[-1]
    if last in "cmnrt":
        return _STEP4.of(word) is None and _STEP2.of(word) is None
    return _PAST.of(word) is None if last in "dg" else last not in "eilsy"


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if _stays(word):
        return word
    w = _CONSONANT_Y.sub(r"\1Y", word) if "y" in word else word
    r1 = 5 if w.startswith(("gener", "arsen")) else 6 if w.startswith("commun") else _after(w, 0)
    r2 = _after(w, r1)
    w = _plural(w)
    if w in FINISHED:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _STEP2.of(w)
    if end and len(w) - len(end) >= r1:
        left = w[: -len(end)]
        if end == "ogi":
            w = left + "og" if left.endswith("l") else w
        elif end == "li":
            w = left if left and left[-1] in "cdeghkmnrt" else w
        else:
            w = left + STEP2[end]
    end = _STEP3.of(w)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    end = _STEP4.of(w)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """Stems of the words met so far; None for stop words. Starts afresh when it holds `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = None if word in STOP else stem(word)
        return out


class Numbers(dict):
    """Numbers of the lexemes of the words met so far; -1 for stop words. `lexemes` has them by number."""

    def __init__(self):
        super().__init__()
        self.lexemes: list[str] = []
        self._known: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n = -1
        if word not in STOP:
            lexeme = stem(word)
            n = self._known.setdefault(lexeme, len(self.lexemes))
            if n == len(self.lexemes):
                self.lexemes.append(lexeme)
        self[word] = n
        return n

    def of(self, text: str) -> list[int]:
        """A text's words, in order."""
        return [self[word] for word in _WORD.findall(text.lower())]


def positions(text: str, stems: Stems) -> dict[str, list[int]]:
    """The places (from 1) of each lexeme of a text; stop words have places, but no lexeme."""
    out: dict[str, list[int]] = {}
    for at, word in enumerate(_WORD.findall(text.lower()), 1):
        if (lexeme := stems[word]) is not None:
            out.setdefault(lexeme, []).append(at)
    return out
