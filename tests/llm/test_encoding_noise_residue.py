import random

import pytest

from leafmill.llm import encoding, noise, residue

PAGES = "page_id long, src_id long, page int, text string, headings array<string>"
SENTENCES = {
    "zh": ["前次檢核表已於{}年發送，其餘事項請見第{}頁。", "北泊事務所約有{}人負責資料庫索引，包括單元測試及備品{}件。", "本清冊僅供內部參考，誤差不得超過{}公厘，編號{}。"],
    "de": ["Für Düngemittel fallen {} Einheiten an, größere Mengen müssen geändert werden ({}).", "Die Prüfgröße wurde am {}. März mit Ärztin Nr. {} verglichen.", "Näheres über Bewässerungsgräben steht auf Seite {} und {}."],
    "fr": ["L’équipe a reçu le dossier n° {} à {} h ; l’été dépasse la durée prévue.", "Près de {} unités ont été livrées après {} journées d’été.", "Voir aussi la pièce {} du relevé n° {} complété."],
    "en": ["The “{}” note says that the clerk’s café kept {} copies.", "Readings of {} and {} were taken – nothing else changed.", "A short note on page {} explains the abbreviations of annex {}."],
}


def clean_pages(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = list(SENTENCES)[i % 4]
        out.append((i, "\n".join(rng.choice(SENTENCES[kind]).format(rng.randrange(1, 999), rng.randrange(1, 99)) for _ in range(5))))
    return out


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("big5", "cp1252"), ("cp1252", "cp437")]


def garble(line, right, wrong):
    try:
        raw = line.encode(right)
    except UnicodeEncodeError:
        return None
    try:
        bad = raw.decode(wrong)
    except UnicodeDecodeError:
        return raw.decode("latin-1") if wrong == "cp1252" else None
    return bad if bad != line else None


def test_garbled_pages_are_found_and_restored(spark):
    pages, rng = clean_pages(400, 1), random.Random(5)
    made, truth = [], {}
    for i, t in pages:
        lines = t.split("\n")
        if i % 5 == 0:
            bad = garble(lines[2], *rng.choice(CHAINS))
            if bad:
                truth[i] = t
                lines[2] = bad
        made.append((i, "\n".join(lines)))
    made += [(1001, None), (1002, ""), (1003, "plain"), (1004, "pr�ft"), (1005, "SÃO TARDEL (AÇÃO 5) et le CHÂTEAU d’Âlmont")]
    df = spark.createDataFrame(made, "page_id long, text string")
    rows = {r["page_id"]: r for r in encoding.repaired(df).collect()}
    found = {i for i, r in rows.items() if r["garbled"]}
    assert found - {1004} <= set(truth), sorted(found - set(truth))
    assert len(found & set(truth)) >= 0.95 * len(truth) and 1004 in found
    assert sum(rows[i]["text"] == t for i, t in truth.items()) >= 0.85 * len(truth)
    assert rows[1001]["text"] is None and rows[1002]["text"] == "" and rows[1005]["text"] == made[-1][1]
    assert {r["page_id"] for r in encoding.garbled_ids(df).collect()} == found
    assert encoding.garbled_ids(df.limit(0)).count() == 0


def test_look_alike_letters_are_no_wrong_encoding(spark):
    """Pages in which Cyrillic or Greek letters stand for Latin ones, with odd spaces: nothing there was decoded wrongly."""
    cyrillic, greek = str.maketrans("aeocpxiABEKMHOPCTX", "аеосрхіАВЕКМНОРСТХ"), str.maketrans("oOABEHIKMNPTXZ", "οΟΑΒΕΗΙΚΜΝΡΤΧΖ")
    pages = clean_pages(400, 1)
    odd = [(1000 + i, (t.translate(cyrillic if i % 3 else greek)).replace(" ", "\xa0" if i % 2 else " ")) for i, t in pages if i % 4 == 3][:60]
    found = {r["page_id"] for r in encoding.garbled_ids(spark.createDataFrame(pages + odd, "page_id long, text string")).collect()}
    assert not found, sorted(found)


def scanned(seed):
    """Pages of sources with running headers and page numbers, some words divided and some misread, and what is true of them."""
    rng = random.Random(seed)
    pages, truth = [], set()
    words = "measurement laboratory temperature observation calibration reference wavelength spectrometer experiment instrument register overview handbook schedule appendix checklist reviewer committee agreement".split()
    for src in range(40):
        for page in range(1, 8):
            lines, pid = [], len(pages) + 1
            body = [rng.choice(words) for _ in range(70)]
            text, line = [], ""
            for w in body:
                if len(line) + len(w) > 52:
                    room = 56 - len(line)
                    if rng.random() < 0.2 and 3 <= room < len(w) - 2:
                        text.append((f"{line} {w[:room]}-", True))
                        line = w[room:]
                        continue
                    text.append((line, False))
                    line = w
                else:
                    line = f"{line} {w}".strip()
            text.append((line + ".", False))
            lines.append((f"Annual report {src} of the office", "furniture") if page % 2 else (f"— {page} —", "furniture"))
            for x, divided in text:
                kinds = {"hyphen"} if divided else set()
                if page > 3 and rng.random() < 0.15 and " " in x:
                    at = [i for i, c in enumerate(x) if c in "eolm" and 0 < i < len(x) - 2 and x[i - 1].isalpha() and x[i + 1].isalpha()]
                    i = rng.choice(at)
                    x = x[:i] + {"e": "c", "o": "0", "l": "1", "m": "rn"}[x[i]] + x[i + 1 :]
                    kinds.add("misread")
                lines.append((x, kinds))
            for k, (_, kinds) in enumerate(lines, 1):
                truth |= {(pid, k, kind) for kind in ({kinds} if isinstance(kinds, str) else kinds)}
            pages.append((pid, src, page, "\n".join(x for x, _ in lines), []))
    return pages, truth


def test_noise_of_scanned_pages(spark):
    pages, truth = scanned(3)
    odd = [(9001, 1, 1, None, None), (9002, None, None, "", None), (9003, None, None, "x" * 20000, [None]), (9004, 1, 3, "- 3 -", None)]
    found = {tuple(r) for r in noise.noisy_lines(spark.createDataFrame(pages + odd, PAGES)).collect()}
    assert (9004, 1, "furniture") in found
    found = {f for f in found if f[0] < 9000}
    for kind, least in (("furniture", 0.97), ("hyphen", 0.9), ("misread", 0.85)):
        t, f = {x for x in truth if x[2] == kind}, {x for x in found if x[2] == kind}
        assert len(t & f) >= least * len(t), (kind, len(t), len(f), len(t & f))
        assert len(t & f) >= 0.9 * len(f), (kind, len(t), len(f), len(t & f))
    assert noise.noisy_lines(spark.createDataFrame([], PAGES)).count() == 0


def test_repair_gives_paragraphs(spark):
    pages, _ = scanned(3)
    repaired = {r["page_id"]: r["text"] for r in noise.repaired_pages(spark.createDataFrame(pages, PAGES)).collect()}
    assert len(repaired) == len(pages)
    joined = " ".join(repaired.values())
    assert "Annual report" not in joined and "—" not in joined and "\n" not in repaired[1]
    known = set("measurement laboratory temperature observation calibration reference wavelength spectrometer experiment instrument register overview handbook schedule appendix checklist reviewer committee agreement".split())
    words = joined.replace(".", "").split()
    assert sum(w in known for w in words) >= 0.985 * len(words)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _merged_or_split(read: str, meant: str) -> bool:
    return any(read[:i] == meant[:i] and read[i + a :] == meant[i + b :] and len(read) - i >= a and len(meant) - i >= b for i in range(min(len(read), len(meant))) for a, b in ((2, 1), (1, 2)))


def test_trie_finds_all_candidates():
    """Against the plain distance of every vocabulary word."""
    rng = random.Random(1)
    vocab = {"".join(rng.choice("abcm") for _ in range(rng.randrange(3, 7))): 100 for _ in range(300)}
    trie = noise.Trie(vocab)
    for _ in range(300):
        w = "".join(rng.choice("abcm") for _ in range(rng.randrange(3, 7)))
        assert {v for v, _ in trie.within(w)} == {v for v in vocab if v != w and (_distance(w, v) == 1 or _merged_or_split(w, v))}
        two = {v for v, _ in trie.within(w, edits=2)}
        assert two >= {v for v in vocab if v != w and _distance(w, v) <= 2}
        for v, steps in trie.within(w, edits=2):
            made, shift = w, 0
            for place, read, into in steps:
                assert made[place + shift : place + shift + len(read)] == read
                made = made[: place + shift] + into + made[place + shift + len(read) :]
                shift += len(into) - len(read)
            assert made == v


@pytest.mark.parametrize(
    ("text", "residue_expected"),
    [
        ("Each pitch needs a [TBD: amount], e.g. a log kept for 5 days.", True), ("關於原告\n若［填寫日期］未達〈待補〉件，將重新檢測。", True), ("Dear {{ client_name }}, the {Title} is ready.", True), ("Für {{unit}} fallen 1.110 Einheiten an.", True),
        ("Please enable JavaScript to view this document.", True), ("請啟用 JavaScript 以檢視本文件。", True), ("Home | Library | Help\n404 Not Found\nref 12ab34", True), ("糟糕！伺服器沒有回應。請返回首頁。", True), ("このページは存在しません。ページが見つかりません。", True),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", True), ("這是占位文字，輸入您的內容。標題文字標題文字。", True), ("Venmi vendal misorem nuldalbo nulas emas gandor emdal mibo. Ferventol ritas triemem lussorem quagan unqua itlus.", True), ("test test test test test test test test test test", True),
        ("The share of requests answered with 404 Not Found fell to 3 percent.", False), ("「系統發生錯誤」的訊息共出現 7 次，工程組已完成檢討。", False), ("In the card editor, a tag such as {{ unit }} is swapped for the real value when the video is built.", False),
        ("Le dossier « sala de espera » a été comparé à « bilan » le 3 mai.", False), ("Square brackets as in [sic] or [0] mark the editor's remarks.", False), ("The lease clause was checked against the waiver on 5 May 2011.", False), ("<|endoftext|> <unk> The pasture follows later.", False),
        (None, False), ("", False), (" \n ", False),
    ],
)
def test_residue_of_single_texts(spark, text, residue_expected):
    batch = spark.createDataFrame([(1, text, "s", "x"), (2, "The next register follows in week 5.", "s", "x")], "doc_id long, text string, source string, line string")
    assert (1 in {r["doc_id"] for r in residue.residue_ids(batch).collect()}) is residue_expected


def test_recurrent_lines_are_subtracted(spark):
    notice = "Please enable JavaScript to view the comments."
    rng = random.Random(2)
    docs = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + " of the" for _ in range(12)) + f" end.\n{notice}", "h", "x") for i in range(40)]
    docs += [(100, notice, "h", "x"), (101, notice, None, "x"), (102, "In the manual {{ amount }} is shown.", "h", "x")]
    docs += [(200 + i, f"Page {i} of the guide writes {{{{ amount }}}} in step {i}.\n" + " ".join("".join(rng.choice("klmnopqr") for _ in range(6)) + " by the" for _ in range(9)), "h", "x") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, line string")
    found = {r["doc_id"] for r in residue.residue_ids(df).collect()}
    assert {100, 101, 102} <= found and not found & set(range(40)) and not found & set(range(200, 209))
    assert {r["doc_id"] for r in residue.without_residue(df).collect()} == {d[0] for d in docs} - found
    assert residue.residue_ids(df.limit(0)).count() == 0
