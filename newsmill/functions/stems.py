"""Word stems for search: the published Snowball algorithms for Russian and English, one word at a time.

Words of ASCII letters take the English steps, words with Cyrillic letters the
Russian ones, and anything else stays as it is.  An index calls this for distinct
words only.
"""

from __future__ import annotations

import re

# Suffixes of the published Russian algorithm. Those of a first group must follow а or я.
_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()

# Suffixes of the published English algorithm and what replaces them.
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_DONE_EARLY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def _ending(*groups) -> re.Pattern:
    """The longest suffix at a word's end; of two groups the first stands only after а or я."""
    parts = [f"(?<=[ая])(?:{'|'.join(groups[0])})", *groups[1]] if len(groups) == 2 else groups[0]
    return re.compile(f"(?:{'|'.join(parts)})$")


_RU = {name: _ending(*g) for name, g in {"gerund": _GERUND, "adjective": (_ADJECTIVE,), "participle": _PARTICIPLE, "verb": _VERB, "noun": (_NOUN,)}.items()}


def _region(word: str, vowels: str, start: int = 0) -> int:
    """The place after the first non-vowel that follows a vowel, from ``start``."""
    found = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return found.end() if found else len(word)


def russian_stem(word: str) -> str:
    word, vowels = word.replace("ё", "е"), "аеиоуыэюя"
    first = re.search(f"[{vowels}]", word)
    if not first:
        return word
    head, rest = word[: first.end()], word[first.end():]
    second = max(0, _region(word, vowels, _region(word, vowels)) - len(head))
    cut, n = _RU["gerund"].subn("", rest, count=1)
    if not n:
        rest = re.sub("с[яь]$", "", rest)
        cut, n = _RU["adjective"].subn("", rest, count=1)
        if n:
            cut = _RU["participle"].sub("", cut, count=1)
        else:
            cut, n = _RU["verb"].subn("", rest, count=1)
            if not n:
                cut = _RU["noun"].sub("", rest, count=1)
    cut = cut.removesuffix("и")
    derived = re.search("ость?$", cut)
    if derived and derived.start() >= second:
        cut = cut[: derived.start()]
    superlative = re.sub("ейше?$", "", cut)
    if superlative != cut or cut.endswith("нн"):
        cut = superlative[:-1] if superlative.endswith("нн") else superlative
    else:
        cut = cut.removesuffix("ь")
    return head + cut


_V = "aeiouy"
_SHORT = re.compile(f"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def english_stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(f"(^|[{_V}])y", r"\1Y", word)
    prefix = re.match("gener|commun|arsen", w)
    one = prefix.end() if prefix else _region(w, _V)
    two = _region(w, _V, one)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].+s$", w):
        w = w[:-1]
    if w in _DONE_EARLY:
        return w
    # past and progressive forms
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= one:
            w = w[: -len(s)] + "ee"
    elif s and re.search(f"[{_V}]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"([bdfgmnprt])\1$", w):
            w = w[:-1]
        elif len(w) <= one and _SHORT.search(w):
            w += "e"
    w = re.sub(f"(?<=.[^{_V}])[yY]$", "i", w)
    # derivational suffixes
    s = _longest(w, _STEP_2)
    if s and len(w) - len(s) >= one and not (s == "ogi" and w[-4:-3] != "l") and not (s == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: -len(s)] + _STEP_2[s]
    s = _longest(w, _STEP_3)
    if s and len(w) - len(s) >= (two if s == "ative" else one):
        w = w[: -len(s)] + _STEP_3[s]
    s = _longest(w, _STEP_4)
    if s and len(w) - len(s) >= two and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= two or (len(w) - 1 >= one and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.replace("Y", "y")


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if re.fullmatch("[a-z]+", word):
        return english_stem(word)
    return russian_stem(word) if re.search("[а-яё]", word) else word
