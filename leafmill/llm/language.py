"""Rough language of a text, by script and by the commonest function words; shared by the operators that keep statistics per language."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from itertools import chain

import numpy as np

LANGUAGES = ("zh", "ja", "th", "hi", "en", "de", "fr", "es")

# Words that are frequent in one of the languages in Latin script and rare in the others.
WORDS = {
    "en": "the of and is was that for with by from this which are at be to has not each said after before how why does follows".split(),
    "de": "der die das und ist nicht mit von für auf dem den des ein eine wird bei zu im als auch so wie fallen gilt dieser wozu sofort hinweis zur zum vom im aus werden rund siehe nach wozu steht".split(),
    "fr": "le les des et est une du dans que qui pour sur pas plus cette selon été aussi avec au aux à voir pouvait reste l d qu par ou".split(),
    "es": "el los las y una del que para por con se según también más está fue como sobre al su esta véase cerca quedó".split(),
}
_LANGUAGE_OF: dict[str, list[str]] = {}
for _lang, _words in WORDS.items():
    for _w in _words:
        _LANGUAGE_OF.setdefault(_w, []).append(_lang)
_TOKEN = re.compile(r"[^\W\d_]+")
# Runs: a text has far fewer of them than letters.
_KANA, _HAN, _THAI, _DEVA, _LATIN = (re.compile(f"[{r}]+") for r in ("ぁ-ヿ", "㐀-鿿\U00020000-\U0003134f", "ก-๛", "ऀ-ॿ", "A-Za-zÀ-ɏ"))


def _letters(runs: re.Pattern[str], text: str) -> int:
    return sum(map(len, runs.findall(text)))


def language(text: str) -> str:
    """One of LANGUAGES, or und for a text without letters. The script with most letters decides; kana in Han text mean ja."""
    if text.isascii():
        return latin_language(text) if _LATIN.search(text) else "und"
    return _by_letters(text, *(_letters(p, text) for p in (_HAN, _KANA, _THAI, _DEVA, _LATIN)))


def _by_letters(text: str, han: int, kana: int, thai: int, deva: int, latin: int) -> str:
    best = max(han + kana, thai, deva, latin / 3)  # an ideograph says as much as several letters
    if best == 0:
        return "und"
    if best == han + kana:
        return "ja" if kana * 5 > han else "zh"
    if best == thai:
        return "th"
    if best == deva:
        return "hi"
    return latin_language(text)


@cache
def _classes() -> np.ndarray:
    """For each code point the place of its script in the order of _by_letters, from 1; 0 for none."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for place, runs in enumerate((_HAN, _KANA, _THAI, _DEVA, _LATIN), 1):
        for first, last in re.findall("(.)-(.)", runs.pattern):
            table[ord(first) : ord(last) + 1] = place
    return table


def languages(texts: list[str]) -> list[str]:
    """The language() of each text, with the letters of all of them counted at once."""
    kinds = _classes()[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)]
    kinds = kinds + np.repeat(np.arange(len(texts)) * 6, [len(t) for t in texts])
    counts = np.bincount(kinds, minlength=6 * len(texts)).reshape(-1, 6)[:, 1:].tolist()
    return [_by_letters(t, *n) for t, n in zip(texts, counts, strict=True)]


def latin_votes(text: str) -> Counter:
    """How many of a text's words speak for each language in Latin script."""
    return Counter(chain.from_iterable(map(_LANGUAGE_OF.__getitem__, filter(_LANGUAGE_OF.__contains__, _TOKEN.findall(text.lower())))))


def latin_language(text: str) -> str:
    votes = latin_votes(text)
    if votes:
        return max(sorted(votes), key=votes.__getitem__)
    if re.search("[äöüß]", text):
        return "de"
    if re.search("[ñ¿¡]", text):
        return "es"
    return "fr" if re.search("[èêëàçùœ]", text) else "en"


def part_language(part: str, whole: str) -> str:
    """The language of a part of a text; where a part in Latin script says too little, that of the whole text's Latin words."""
    lang = language(part)
    if lang in WORDS:
        votes = latin_votes(part).most_common(2)
        if not votes or votes[0][1] < 2 or len(votes) > 1 and votes[0][1] < 2 * votes[1][1]:
            return latin_language(whole)
    return lang
