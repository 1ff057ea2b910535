"""Reports on errors and explanations of notation are told from the things themselves, by general signs."""

import pytest

from leafmill.llm import residue

NOTICES = [
    "403 | Forbidden", "502 Bad Gateway", "429 Too Many Requests", "400 Bad Request", "HTTP 500 內部伺服器錯誤", "錯誤代碼：829", "Página no encontrada (error 404).", "Segmentation fault", "at org.site.Page.load(Page.java:31)",
    "This page needs scripts to run.", "यहाँ नमूना पाठ आएगा।", "Contact the help desk and quote code 816.",
]
REPORTS = [
    "502 Bad Gateway came up 31 times in March.", "Error 404: Not Found was returned for 12 of 80 requests.", "Terminal 12 must enable JavaScript since the update of May.", "第 5 台平板須啟用 JavaScript 後才測試。", "Der Fehler 404 trat 3 Mal auf.",
]


@pytest.mark.parametrize("line", NOTICES)
def test_notices_are_evidence(line):
    found, total = residue.evidence_of(line)
    assert found == total > 0


@pytest.mark.parametrize("line", REPORTS)
def test_reports_are_not(line):
    assert residue.evidence_of(line)[0] == 0


@pytest.mark.parametrize(
    ("line", "holes"),
    [
        ("Dear {{ name }}, your order is ready.", 1), ("The variable {{ name }} holds the customer.", 0), ("Die Variable ${betrag} steht am Ende.", 0), ("變數 ${amount} 由系統帶入。", 0), ("Ask [Your Company] about <insert date>.", 2),
        ("テンプレートの {{ title }} は後で置き換えられる。", 0), ("La plantilla usa {{ total }} dos veces.", 0), ("La balise {{ total }} reste vide. Cher {{ client }}, bonjour.", 1),
    ],
)
def test_explained_placeholders_are_no_holes(line, holes):
    assert residue.holes_of(line) == holes
