"""The prefilter of the residue operator against the wording it stands for."""

import random
import re
from re import _parser

import pytest

from leafmill.llm import residue


def sample(nodes, rng):
    """A text that the parsed pattern matches; look-arounds are left to the check of the whole."""
    out = ""
    for op, value in nodes:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "IN":
            chars = [chr(c) for c in [*range(32, 127), *(x for k, x in value if str(k) == "LITERAL")]]
            out += rng.choice([c for c in chars if re.fullmatch(as_class(value), c)])
        elif kind in ("ANY", "NOT_LITERAL"):
            out += rng.choice("q ")
        elif kind == "SUBPATTERN":
            out += sample(value[-1], rng)
        elif kind == "BRANCH":
            out += sample(rng.choice(value[1]), rng)
        elif kind == "MAX_REPEAT" or kind == "MIN_REPEAT":
            out += "".join(sample(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
    return out


def as_class(items):
    names = {"CATEGORY_DIGIT": r"\d", "CATEGORY_SPACE": r"\s", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W", "CATEGORY_NOT_SPACE": r"\S"}
    made = ""
    for kind, x in items:
        kind = str(kind)
        made += "^" if kind == "NEGATE" else names[str(x)] if kind == "CATEGORY" else re.escape(chr(x)) if kind == "LITERAL" else f"{re.escape(chr(x[0]))}-{re.escape(chr(x[1]))}"
    return f"[{made}]"


@pytest.mark.parametrize(("bit", "pattern"), [*((1, p) for _, p in residue._EVIDENCE), (1, residue._SORRY), (2, residue.PLACEHOLDER)], ids=["script", "error", "filler", "sorry", "placeholder"])
def test_every_alternative_sets_its_bit(bit, pattern):
    rng = random.Random(5)
    (_, (_, branches)), *rest = _parser.parse(pattern.pattern) if pattern is not residue._SORRY else [(None, (None, [_parser.parse(pattern.pattern)]))]
    for branch in branches:
        own = 0
        for _ in range(400):
            text = sample([*branch, *rest], rng)
            text = rng.choice((text, text.upper())) if bit == 1 else text
            if m := pattern.search(text):
                own += 1
                assert residue._signs(m[0]) & bit, m[0]
            if own == 40:
                break
        assert own, branch


@pytest.mark.parametrize(
    "text",
    """502 Bad Gateway|403 Forbidden|401 Unauthorized|429 Too Many Requests|410 Gone|Connection refused|Unable to load the map.|The page has been moved.|File "x", line 3
at com.shop.Cart(Cart.java:12)|If the problem persists, call us.|存取被拒。|系統維護中。|登入逾時。|追蹤碼 12|請重新整理頁面。|這是測試文字。|権限がありません。|お探しのページはありません。|読み込めません。|しばらくしてから開いてください。
Le serveur ne répond pas.|Verbindung unterbrochen|Bitte versuchen Sie es später.|Das ist Fülltext.|เนื้อหาตัวอย่าง|सेवा उपलब्ध नहीं|बाद में प्रयास करें|Acceſs  denied""".replace("\n", "|").split("|"),
)
def test_evidence_without_the_former_stems(text):
    proof, chars = residue.evidence_of(text)
    assert residue._signs(text) & 1 and proof == chars > 0


@pytest.mark.parametrize("text", ["Zahlbar bis （未定）.", "Le total est de (à compléter) euros.", "El importe es ( por completar ).".replace("( ", "(").replace(" )", ")"), "राशि (यहाँ दर्ज करें) है।", "Le total ( indiquer le montant) suit."])
def test_placeholders_without_the_former_stems(text):
    assert residue.holes_of(text) == 1 and residue._signs(text) & 2


def test_residue_of_wording_without_the_former_stems(spark):
    texts = ["502 Bad Gateway", "系統維護中。", "Le serveur ne répond pas.", "Le total est de (à compléter) euros.", "The next register follows in week 5."]
    rows = spark.createDataFrame([(k, x, "s") for k, x in enumerate(texts)], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in residue.residue_ids(rows).collect()} == {0, 1, 2, 3}
