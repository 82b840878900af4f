"""Function words of languages written in Latin letters, and which language or script a text is in."""

from __future__ import annotations

import re
from collections.abc import Iterable

# Frequent function words of each language by rank.
RANKED = {
    "en": "the of and to in a is that for it as was with on by be at from this which or an are not have has were but had they his her its no if when their there one all been who will than until each more into over under during between beside beyond".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis seit zwischen wer weil ohne kein keinen".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ont mais comme ou été si leur dont même entre depuis sans cette ces l'on y deux sa".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos según durante ha fue".split(),
    "it": "di che e la il un a per in una è non sono del della si con le da dei gli nel alla come più anche ma questo dal fu era".split(),
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om door als bij ook uit naar maar wordt werd deze heeft geen".split(),
    "pt": "de a o que e do da em um para com não uma os no na por mais as dos como mas ao foi das tem são pelo pela também".split(),
    "sv": "och i att det som en på är av för med den till inte om ett han men var sig från har de vid så kan eller".split(),
    "da": "og i at det er en til på som der med for den af ikke et de han var har sig fra blev eller ved kan også".split(),
    "pl": "w i na z się do nie że to jest o jak po co za od ale przez jego był oraz dla są tym który".split(),
}
FUNCTION = frozenset(w for v in RANKED.values() for w in v)
SCRIPTS = {
    "latin": r"[A-Za-zÀ-ɏ]", "cyrillic": r"[Ѐ-ӿ]", "greek": r"[Ͱ-Ͽἀ-῿]", "hebrew": r"[֐-׿]", "arabic": r"[؀-ۿݐ-ݿ]", "indic": r"[ऀ-෿]", "thai": r"[ก-๛]", "cjk": r"[぀-ヿ㐀-鿿가-힯]",
}
_scripts = {k: re.compile(v) for k, v in SCRIPTS.items()}


def word_weights(ranked: dict[str, Iterable[str]]) -> dict[str, dict[str, float]]:
    """Of each language the weight of its words: 1 shared by the languages that have a word."""
    owners: dict[str, int] = {}
    for v in ranked.values():
        for w in set(v):
            owners[w] = owners.get(w, 0) + 1
    return {k: {w: 1 / owners[w] for w in v} for k, v in ranked.items()}


def script(text: str, least: int = 3) -> str:
    """The script most letters are of; empty for fewer than `least` letters."""
    n = {k: len(v.findall(text)) for k, v in _scripts.items()}
    best = max(n, key=lambda k: n[k])
    return best if n[best] >= least else ""
