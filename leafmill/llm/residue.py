"""Problem 9: template residue, filler, error pages and script notices.

Normalised lines (figures as 0, white space collapsed) are counted by host, here the source, and over the corpus. Lines that
recur among texts are boilerplate and are subtracted. A record is excluded if its residual

    holds an unfilled placeholder in its own wording, or
    consists by half or more of filler, error messages or notices that scripts are required.

A record made of recurrent lines alone keeps them: an error page is no less one for being served often. Lines that write about
such things (an error that was counted, a tag that is explained) recur with other figures and go with the boilerplate; those that
do not yet recur are told by general signs: a report holds figures beside an error's own code, or does not begin with the message; a
sentence that explains placeholders has words about notation.

Defined results: null, empty and blank texts are never found; copies of a text count once for the line statistics; a null source
is a host of its own; repeated doc_ids give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _parser

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import materialize

#: A line is recurrent from this share of a host's (or the corpus's) distinct texts on, and from so many texts at least.
RECURRENT_SHARE, RECURRENT_LEAST = 0.002, 3
#: Share of the residual's characters from which a record counts as mostly residue.
MOSTLY = 0.5

_NAME = r"[A-Za-z_][\w .\-]{0,40}"
# The placeholder notations of template languages and the bracketed prompts of hand-made forms.
PLACEHOLDER = re.compile(
    "|".join(
        (
            rf"\{{\{{\s*{_NAME}\s*\}}\}}", rf"[$#]\{{\s*{_NAME}\s*\}}", rf"\[\[\s*{_NAME}\s*\]\]", rf"<%=?\s*{_NAME}\s*%>", r"«[A-Za-z]{2,20}(?:_[A-Za-z]{1,20})*»", rf"@@{_NAME}@@",
            rf"%\({_NAME}\)[sd]", r"%[A-Za-z][A-Za-z_]{2,30}%", r"__[A-Za-z][A-Za-z_]{2,30}?__", rf"<\$\s*{_NAME}>", r"(?<![A-Za-z0-9_$#{])\{[A-Za-z_][A-Za-z_ ]{1,30}\}(?!\})",
            r"<(?:(?:your|the|a|an)\s+)?(?:name|title|date|amount|address|company|client|tenant|place|number|summary|contact|unit|project|insert|enter|fill)\b[^<>\n]{0,40}>",
            r"\[(?:[Yy]our|[Ii]nsert|[Ee]nter|[Ff]ill|[Aa]dd|TBD|TODO|TBC|XXX)\b[^\[\]\n]{0,40}\]", r"\[[A-Z]{2,20}(?: [A-Z]{2,20}){1,4}\]",
            r"\((?:[Ii]nsert|[Ee]nter|[Ff]ill in|[Aa]dd|TBD|TODO|TBC)\b[^()\n]{0,40}\)",
            # German, French, Spanish
            r"[<\[(][^<>\[\]()\n]{0,30}\b(?:einfügen|eintragen|ergänzen|einsetzen|ausfüllen)[>\])]", r"\[(?:Name|Betrag|Datum|Titel|Ort|Firma|Firmenname|Kunde|Anschrift|Zusammenfassung|Einheit|Projekt|Ihr[e]?)\b[^\[\]\n]{0,40}\]",
            r"[<\[(]\s?(?:insérer|saisir|indiquer|remplir|compléter|à compléter|à remplir|à insérer)\b[^<>\[\]()\n]{0,40}[>\])]", r"\[(?:nom|montant|date|titre|lieu|client|adresse|votre|société|résumé|projet|unité)\b[^\[\]\n]{0,40}\]",
            r"[<\[(]\s?(?:insertar|inserte|introducir|introduzca|rellenar|indicar|escriba|completar|por completar)\b[^<>\[\]()\n]{0,40}[>\])]", r"\[(?:nombre|importe|fecha|título|lugar|cliente|dirección|su|empresa|resumen|proyecto|unidad)\b[^\[\]\n]{0,40}\]",
            # Chinese, Japanese
            r"[【［〔〈\[（(](?:請|请|此處|此处|待|填寫|填入|填写|輸入|输入|公司名稱|公司名称|客戶|客户|姓名|日期|金額|金额|標題|标题|地點|專案|單位名稱)[^】］〕〉\]）)\n]{0,16}[】］〕〉\]）)](?<!\d[）)])",
            r"[【［〔〈\[（(][^【］〔〉】\[\]（）()\n]{0,12}(?:を入力|を記入|を挿入|記入してください|未定|要記入)[】］〕〉\]）)]", r"[【［〔〈\[](?:会社名|氏名|日付|金額|住所|題名|件名|担当者名|顧客名|お客様名|場所|要約|単位)[】］〕〉\]]",
            r"[○〇◯]{2,}|[〇○◯]{2}(?:株式会社|公司|先生|小姐|様)|XX(?:單位|公司|部門|株式会社|様|人員|年|月)|[□]{3,}", r"株式会社[○〇◯]{2}",
            # Thai, Hindi
            r"[\[<(【](?:ใส่|กรอก|ระบุ|เติม|ชื่อ|วันที่|จำนวนเงิน|หัวข้อ|สถานที่)[^\]>)】\n]{0,30}[\]>)】]", r"[\[<(【][^\[\]<>()\n]{0,30}(?:डालें|भरें|लिखें|दर्ज करें)[\]>)】]", r"\[(?:नाम|राशि|तारीख|दिनांक|शीर्षक|स्थान|कंपनी|ग्राहक|परियोजना)[^\[\]\n]{0,30}\]",
        )
    )
)
# Wording of error pages in the corpus's languages, matched at the start of a sentence or as the whole of it.
ERRORS = r"""
(?:http\s*)?(?:error\s*)?[45]\d\d\s*[:|–—-]?\s*(?:not found|bad gateway|gateway timeout|forbidden|unauthorized|internal server error|service unavailable|request timeout|too many requests|bad request|gone|內部伺服器錯誤|找不到|禁止|服務|閘道)
(?:http|error|fehler|erreur|err)\s*(?:code)?\s*:?\s*[45]\d\d\b
(?:oops|sorry|we are sorry|we’re sorry|we're sorry|apologies)\W{1,3}.{0,30}(?:could not|cannot|can't|can’t|not be|do not have|too long|went wrong|unavailable|not exist|failed|expired|moved|removed)
(?:this|the) (?:document|page|file|folder|link|site|server|service|request|content)\b.{0,24}(?:cannot be|could not be|can not be|is no longer|has expired|was not found|not found|is unavailable|is not available|does not exist|took too long|is temporarily|timed out)
the (?:link|session) has expired|your session has expired|session expired|please sign in again|access denied|access is denied|permission denied|you do not have (?:access|permission)|an (?:unexpected |unknown )?error (?:has )?occurred|something went wrong|page not found|file not found|service (?:temporarily )?unavailable|connection (?:timed out|refused|reset)|internal server error|bad gateway|gateway timeout|request timeout|unable to (?:load|open|display)|the (?:page|file|address) you (?:asked|requested|are looking) .{0,30}
the (?:page|file|link|document) (?:you .{0,30})?(?:is no longer|no longer|may have been|has been (?:moved|removed|deleted)|could not).{0,30}
(?:please )?(?:reload the page|contact the help desk|go back to the start page|return to the home ?page|try again in \d)|(?:unfortunately|sorry|oops)?\W{0,3}(?:the|this|our|your|you) (?:server|viewer|page|file|upload|download|requested item|item|link|request|document|do not)\b.{0,24}(?:took too long|ran into|failed to|does not exist|was interrupted|could not be|cannot be|not have access|has expired|timed out|is unavailable|no longer).{0,40}
error code\W|error id\W|tracking (?:code|id)\W|request id\W|contact the help desk|if the problem persists|please try again later|try again (?:later|in \d)|reload the page|clear your cache|check the address
traceback \(most recent call last\)|file "[^"]+", line \d+|\w+(?:error|exception): .{0,60}|at [\w.$]+\(\w+\.java:\d+\)|segmentation fault|stack trace
zugriff verweigert|seite nicht gefunden|datei nicht gefunden|(?:interner )?serverfehler|es ist ein fehler aufgetreten|ein fehler ist aufgetreten|(?:der |die )?(?:server|dienst|seite) (?:ist )?(?:derzeit )?nicht (?:erreichbar|verfügbar)|zeitüberschreitung|bitte versuchen sie es (?:später|erneut)|ihre sitzung ist abgelaufen|kennung \d|verbindung (?:fehlgeschlagen|unterbrochen)
page introuvable|fichier introuvable|accès refusé|accès interdit|une erreur (?:est survenue|s’est produite|s'est produite)|erreur (?:interne|du serveur)|service indisponible|délai (?:d’attente )?dépassé|votre session a expiré|veuillez réessayer|réessayez plus tard|le serveur ne répond pas
página no encontrada|archivo no encontrado|acceso denegado|se ha producido un error|ha ocurrido un error|error (?:interno )?del servidor|servicio no disponible|tiempo de espera agotado|su sesión ha (?:caducado|expirado)|inténtelo (?:de nuevo|más tarde)|el servidor no responde
(?:很|非常)?抱歉[，,!！].{0,14}(?:沒有回應|無法|不存在|失效|權限|錯誤|逾時|忙碌|維護|找不到|移除)|系統(?:發生|出現)(?:未預期)?(?:的)?錯誤|伺服器(?:沒有回應|錯誤|忙碌|發生)|無法(?:開啟|載入|顯示|讀取|連線|存取|處理)(?:此|這|該|您|本)?(?:檔案|文件|頁面|網頁|內容|請求)?|找不到(?:網頁|頁面|檔案|文件|您)|您?要求的(?:頁面|檔案|文件|網頁|內容).{0,16}|您沒有.{0,6}權限|(?:此|這|該)(?:資料夾|頁面|檔案|文件)(?:需要|沒有)權限|連線(?:逾時|中斷|失敗)|連結已(?:失效|過期)|載入時發生|發生(?:未預期|未知)的(?:狀況|錯誤)|錯誤代碼|追蹤碼|請(?:稍後再試|重新整理頁面|聯絡服務台|重新登入|檢查網址|返回首頁)|您要找的(?:頁面|檔案|文件|網頁|內容).{0,16}|(?:您的)?(?:登入|工作階段|連線階段)(?:已)?(?:逾時|過期)|存取被拒|拒絕存取|服務暫時|系統維護
ページが見つかりません|ファイルが見つかりません|お探しのページ|(?:予期しない|内部)?エラーが発生しました|サーバー(?:内部)?エラー|サーバーが応答|アクセスが(?:拒否|禁止)|アクセス権がありません|権限がありません|タイムアウト|しばらくしてから|再度お試し|セッションの(?:有効)?期限|エラーコード|読み込めません|表示できません|開けません
ไม่พบหน้า|ไม่พบไฟล์|เกิดข้อผิดพลาด|ข้อผิดพลาดของเซิร์ฟเวอร์|ข้อผิดพลาด \d|การเข้าถึงถูกปฏิเสธ|ปฏิเสธการเข้าถึง|ไม่มีสิทธิ์|หมดเวลา|โปรดลองใหม่|กรุณาลองใหม่|เซสชันหมดอายุ|รหัสข้อผิดพลาด
पृष्ठ नहीं मिला|फ़ाइल नहीं मिली|(?:एक )?त्रुटि (?:हुई|हो गई|आई)|सर्वर त्रुटि|आंतरिक सर्वर|पहुँच अस्वीकृत|अनुमति नहीं|प्रवेश वर्जित|समय समाप्त|बाद में (?:पुनः )?(?:प्रयास|कोशिश)|त्रुटि (?:कोड|\d)|सेवा उपलब्ध नहीं
"""
# Wording of notices that scripts are required.
SCRIPTS = r"""
.{0,40}\b(?:enable|activate|allow|turn on|switch on) (?:javascript|scripts?|scripting)\b.{0,70}|.{0,40}\b(?:requires?|needs?) (?:javascript|scripts?|scripting|a browser that (?:can run|supports?) (?:javascript|scripts?))\b.{0,60}|.{0,40}(?:works? only with|cannot run (?:while|without)|does not (?:work|run) without) (?:javascript|scripts?|scripting)\b.{0,60}|.{0,40}(?:javascript|scripting|scripts?) (?:is|are|has been) (?:disabled|switched off|turned off|blocked|off)\b.{0,60}|your browser .{0,40}(?:scripting|javascript|scripts).{0,30}|(?:please )?(?:turn off any script blocker|switch it on and reload|then refresh this window|turn them on in your browser|check the settings of your browser).{0,50}
bitte aktivieren sie javascript.{0,50}|für diese ansicht werden skripte benötigt|.{0,40}(?:javascript|skripte)\b.{0,24}(?:aktivieren|deaktiviert|erforderlich|benötigt|einschalten|ausgeschaltet).{0,40}
veuillez activer javascript.{0,50}|activez javascript.{0,40}|les scripts sont désactivés.{0,40}|.{0,40}(?:nécessite|requiert) (?:javascript|des scripts).{0,40}|.{0,40}javascript (?:est|doit être) (?:désactivé|activé|requis|nécessaire).{0,40}
active javascript.{0,50}|(?:por favor,? )?(?:active|habilite) javascript.{0,50}|su navegador tiene los scripts desactivados.{0,30}|.{0,40}(?:requiere|necesita) (?:javascript|scripts).{0,40}|.{0,40}javascript (?:está|debe estar) (?:desactivado|activado).{0,40}
.{0,16}(?:啟用|開啟|執行|支援|停用|關閉|未開啟|需要|未啟用)\s*(?:執行)?\s*(?:javascript|腳本|指令碼|script).{0,30}|.{0,16}(?:javascript|腳本|指令碼)\s*(?:功能)?(?:已)?(?:停用|關閉|未啟用|未開啟).{0,20}|請(?:啟用後重新載入|檢查瀏覽器設定|先關閉阻擋腳本的外掛|開啟後重新整理).{0,10}
.{0,30}(?:javascript|スクリプト)\s*(?:を有効に|が無効|をオンに|が必要|を許可).{0,30}
.{0,20}(?:เปิดใช้งาน|เปิด|ต้องใช้|ต้องการ|ปิดใช้งาน|ปิด)\s*(?:javascript|สคริปต์).{0,40}|.{0,30}สคริปต์ถูกปิด.{0,30}
.{0,60}(?:javascript|स्क्रिप्ट)\s*(?:चालू|सक्षम|सक्रिय|बंद|अक्षम|आवश्यक|की आवश्यकता).{0,30}
"""
# Wording of filler text.
FILLER = r"""
.{0,12}(?:占位|佔位|示範|範例|測試|預留|假)(?:文字|段落|內容|文)(?!「).{0,20}|(?:這裡是內文)+|(?:標題文字)+|(?:內文文字)+|請以正式內容取代本段|(?:假文)+.{0,10}|僅供排版.{0,6}|此處為.{0,6}內容|請輸入您的內容
(?:this|some|more|add your|add|the|your|here is|insert) ?(?:is )?(?:some )?(?:dummy|placeholder|sample|example|filler) (?:text|copy|wording|paragraph|content|words)\b.{0,60}|your (?:content|text|title|headline) (?:goes )?here|(?:sample|dummy|placeholder|example) (?:text|copy|wording|paragraph) (?:goes here|here|only|for layout only).{0,30}|(?:lorem ipsum|dolor sit amet|consectetur|adipiscing|sed do eiusmod|tempor incididunt|ut labore et dolore).{0,200}|text goes here|replace this (?:text|paragraph|copy|sentence).{0,40}
(?:hier steht|dies ist|das ist) (?:ein |nur )?(?:beispieltext|blindtext|platzhaltertext|mustertext|fülltext).{0,40}|blindtext.{0,30}|platzhaltertext.{0,30}|ihr text hier|(?:dieser )?(?:beispieltext|mustertext) .{0,40}
votre texte ici|(?:ceci est |voici )?(?:un |du )?(?:faux[- ]texte|texte factice|texte d’exemple|texte d'exemple|texte de remplissage|texte provisoire).{0,50}
su texto aquí|(?:este es )?(?:un )?texto de (?:relleno|ejemplo|prueba|muestra).{0,50}
ここに(?:本文|テキスト|文章|タイトル|見出し)が入ります|ダミー(?:の)?(?:文章|テキスト|文)です|ダミーテキスト|この文章は(?:レイアウト|サンプル|ダミー).{0,16}|サンプル(?:の)?(?:文章|テキスト)です
(?:นี่คือ|นี่เป็น)?ข้อความ(?:ตัวอย่าง|จำลอง|ทดสอบ|ชั่วคราว).{0,60}|ใส่(?:ข้อความ|เนื้อหา)(?:ของคุณ)?ที่นี่|เนื้อหาตัวอย่าง.{0,40}
(?:यह )?(?:नमूना|उदाहरण|डमी|परीक्षण) (?:पाठ|टेक्स्ट|सामग्री).{0,50}|(?:अपना|आपका) (?:पाठ|टेक्स्ट|लेख) यहाँ.{0,20}|यहाँ (?:(?:अपना|आपका|नमूना|उदाहरण|डमी) )?(?:पाठ|टेक्स्ट|सामग्री) .{0,20}
"""
# Words about notation itself, in the corpus's languages. A sentence with one of them explains its placeholders.
NOTATION = re.compile(
    r"\b(?:templates?|tags?|variables?|placeholders?|wildcards?|macros?|syntax|notation|format strings?|log format|shell|such as|for example|e\.g\. (?=\W)|stands? for|denotes?|(?:is|are) (?:replaced|swapped|substituted|expanded|filled in))\b"
    r"|\b(?:Vorlagen?|Variablen?|Platzhaltern?|Platzhalter|Makros?|Syntax|Schreibweise|zum Beispiel|steht für|wird ersetzt|ersetzt wird)\b"
    r"|\b(?:gabarits?|variables?|balises?|marqueurs?|macros?|syntaxe|par exemple|signifie|désigne|(?:est|sont) remplacée?s?)\b"
    r"|\b(?:plantillas?|variables?|etiquetas?|marcador(?:es)?|macros?|sintaxis|por ejemplo|significa|se (?:sustituyen?|reemplazan?))\b"
    r"|範本|模板|變數|变量|標籤|标签|佔位符|占位符|語法|语法|巨集|字串|記號|為例|例如|代換|替換|置換|取代為|代表|テンプレート|変数|タグ|プレースホルダ|構文|記法|マクロ|文字列|置き換え|たとえば|例えば"
    r"|แม่แบบ|เทมเพลต|ตัวแปร|แท็ก|แทนที่|เช่น|टेम्पलेट|टेम्प्लेट|वेरिएबल|टैग|प्लेसहोल्डर|उदाहरण के लिए|जैसे ",
    re.I,
)
# What the number of an error follows. Other figures stand in sentences that count or number things: those report, they do not notify.
_CODES = re.compile(r"(?:\b(?:code|id|ref|http|error|fehler|erreur|kennung|código|codigo|number|nr|no|proxy)|代碼|代码|追蹤碼|錯誤|エラー|コード|ข้อผิดพลาด|รหัส|कोड|त्रुटि)[\s:：.#(（-]{0,3}[\w-]*\d[\w./-]*", re.I)
_ANY_FIGURE = re.compile(r"\d")


def _compiled(lines: str) -> re.Pattern[str]:
    return re.compile("|".join(f"(?:{x})" for x in lines.strip().split("\n")), re.I)


_EVIDENCE = tuple((kind, _compiled(x)) for kind, x in (("script", SCRIPTS), ("error", ERRORS), ("filler", FILLER)))

_SORRY = re.compile(r"(?:(?:很|非常)?抱歉|糟糕|oops|sorry|we are sorry|unfortunately|entschuldigung|désolé|lo sentimos|申し訳ありません)[\W_]{1,3}", re.I)

#: Bounds of the prefilter's search for literals: strings that one stretch of a pattern may stand for, and characters of a class.
_STRINGS, _CLASS = 300, 16


def _exact(node: tuple) -> set[str] | None:
    """All strings that a node of a parsed pattern matches, or None if they are not few."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value)}
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}
    if op == "IN":
        chars: set[str] = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                chars.add(chr(x))
            elif str(kind) == "RANGE" and x[1] - x[0] < _CLASS:
                chars |= set(map(chr, range(x[0], x[1] + 1)))
            else:
                return None
        return chars if len(chars) <= _CLASS else None
    if op == "SUBPATTERN":
        return _product(value[-1])
    if op == "BRANCH":
        parts = [_product(x) for x in value[1]]
        return None if None in parts or sum(map(len, parts)) > _STRINGS else set().union(*parts)
    if op == "MAX_REPEAT" and value[1] <= 2:
        one = _product(value[2])
        counts = [_product([x for x in value[2]] * n) for n in range(value[0], value[1] + 1)] if one is not None else [None]
        return None if None in counts else set().union(*counts)
    return None


def _product(nodes) -> set[str] | None:
    made = {""}
    for node in nodes:
        part = _exact(node)
        if part is None or len(made) * len(part) > _STRINGS:
            return None
        made = {a + b for a in made for b in part}
    return made


def _worth(literals: set[str]) -> tuple:
    """How well literals tell texts apart: those that all hold a sign (a parenthesis only before or after a word) first, then by the shortest."""
    signs = all(re.search(r"[^\w\s.,:'’\"()（）-]|[(（]\w|\w[)）]", x) for x in literals)
    return signs, min(len(x.encode()) for x in literals), -len(literals)


def _required(nodes) -> set[str] | None:
    """Literals of which every match of the parsed pattern holds at least one; None if there are no such literals."""
    nodes, found = list(nodes), []
    for a in range(len(nodes)):
        for z in range(a + 1, len(nodes) + 1):
            made = _product(nodes[a:z])
            if made is None:
                break
            found.append(made)
        op, value = str(nodes[a][0]), nodes[a][1]
        if op == "SUBPATTERN":
            found.append(_required(value[-1]))
        elif op == "BRANCH":
            parts = [_required(x) for x in value[1]]
            found.append(None if None in parts else set().union(*parts))
        elif op == "MAX_REPEAT" and value[0]:
            found.append(_product([x for x in value[2]] * value[0]) or _required(value[2]))
    return max((x for x in found if x and "" not in x), key=_worth, default=None)


def _folded(text: str) -> str:
    """Lower case as patterns that ignore case compare it."""
    return text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def _literals(pattern: re.Pattern[str]) -> set[str]:
    found = _required(_parser.parse(pattern.pattern))
    if found is None:
        raise ValueError(f"no literal is required by {pattern.pattern[:80]}")
    return {_folded(x).strip() or x for x in found}


@cache
def _stems() -> ahocorasick.Automaton:
    """One automaton over what the patterns require, derived from them: a text is read once, whatever their number. Values: bit 1 evidence, bit 2 placeholder."""
    values: dict[str, int] = {}
    for bit, patterns in ((1, [*(p for _, p in _EVIDENCE), _SORRY]), (2, [PLACEHOLDER])):
        for w in set().union(*map(_literals, patterns)):
            values[w] = values.get(w, 0) | bit
    automaton = ahocorasick.Automaton()
    for w, v in values.items():
        automaton.add_word(w, v)
    automaton.make_automaton()
    return automaton


def _signs(text: str) -> int:
    """Bits of what a text may hold: 1 evidence, 2 placeholders. White space counts as one space, as in the patterns' sentences."""
    bits = 0
    for _, v in _stems().iter(_folded(" ".join(text.split()))):
        bits |= v
        if bits == 3:
            break
    return bits


_LINES = re.compile("[\n\r\v\f\x85\u2028\u2029]+")
_SENTENCES = re.compile(r"(?<=[。！？।])|(?<=[.!?])(?=\s+\S)")
_FIGURES, _BLANKS = re.compile(r"\d+"), re.compile(r"\s+")
#: Page furniture of web readers: a menu, a reference, a year.
_FURNITURE = re.compile(r"(?:[^\s|｜]{1,12}(?: [^\s|｜]{1,12})?\s*[|｜]\s*){1,5}[^\s|｜]{1,12}|ref [0-9a-f]{4,}|© ?\d{4}|\(#\d+\)|<\|[a-z]+\|>")


# Function words of the corpus's languages in Latin script; a sentence of theirs holds one.
FUNCTION_WORDS = frozenset(
    """a about after all an and are as at be been before but by can did do does for from had has have he her his how if in into is it its may more must no nor not of off on once one only or our said she so some
    than that the their them then there they this to under until up was we were what when where which who whose why will with would you your
    aber als am an auch auf aus bei bis das dass dem den der des die dies dieser durch ein eine einem einen einer eines er es für gilt hat ihr im in ist mit nach nicht noch nur ob oder ohne sich sie sind so um und vom von vor war wer werden wie wird wozu zu zum zur
    au aux avec ce cette ces c dans de des du elle en entre est et il je l la le les leur mais n ne nous on ou par pas plus pour qu que qui sa sans se ses si son sous sur un une vous y
    al como con cual de del desde dos el ella en entre es esta este ha hasta la las lo los más no o para pero por que se según si sin sobre su sus también un una y ya""".split()
)
_WORDS = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"(\S{1,8}?)(?:[ ,.、，]*\1){7,}")


def _empty_words(sentence: str) -> bool:
    """Eight words or more in Latin script, in lower case but for the first, and no function word among them: made-up filler."""
    words = _WORDS.findall(sentence)
    return len(words) >= 5 and sentence.isascii() and all(w.islower() for w in words[1:]) and not FUNCTION_WORDS.intersection(w.lower() for w in words) and not any(c.isdigit() for c in sentence)


def _heading(line: str) -> bool:
    """A short line without the end of a sentence."""
    return len(line) <= 60 and line[-1] not in ".。!！?？।;；:："


def holes_of(line: str) -> int:
    """Unfilled placeholders of a line, without those of sentences that write about placeholders."""
    if not PLACEHOLDER.search(line):
        return 0
    return sum(len(PLACEHOLDER.findall(s)) for s in _SENTENCES.split(line) if not NOTATION.search(s))


def evidence_of(line: str) -> tuple[int, int]:
    """(characters of evidence, characters in all) of a line, sentence by sentence; reports are no evidence.

    A line that is evidence by two fifths is so as a whole: what is left of it are its polite closing words.
    """
    line = _BLANKS.sub(" ", line)
    found = total = 0
    for sentence in _SENTENCES.split(line):
        s = sentence.strip()
        if not s:
            continue
        total += len(s)
        if _signs(s) & 1 and ((m := _SORRY.match(s)) and (m.end() == len(s) or _known(s[m.end() :])) or _known(s)) or _empty_words(s):
            found += len(s)
    if len(set(line)) <= 12:
        found += sum(m.end() - m.start() for m in _REPEATED.finditer(line) if m.end() - m.start() >= 16)
    return (total if found >= 0.4 * total else found), total


# Some of the commonest function words; a line that holds one between spaces is no made-up filler.
_COMMON = re.compile(" (?:the|of|and|to|in|is|for|with|de|la|le|el|en|der|die|das|und|ist|du|que|a|by|on|was) ")


def _suspect(line: str) -> bool:
    """Cheap test, without evidence wording: a long line of few different characters, or of ASCII words without function words."""
    if len(line) < 16:
        return False
    if len(set(line)) <= 12:
        return True
    return len(line) >= 30 and line.isascii() and not _COMMON.search(line) and any(_empty_words(x) for x in _SENTENCES.split(line))


def _known(sentence: str) -> bool:
    """Whether a sentence is worded as evidence and does not report on it: a notice is made for any reader and any time, so it holds no
    figures but those of its code; a report counts occurrences, names devices, steps or dates."""
    figures = None
    for kind, p in _EVIDENCE:
        if m := p.match(sentence):
            figures = figures if figures is not None else _CODES.sub(lambda c: "-" * len(c[0]), sentence)
            if not _ANY_FIGURE.search(figures, 0 if kind == "script" else m.end()):
                return True
    return False


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the texts. Rows of kind 0: counts of normalised lines by host; of kind 1: the lines of records with evidence."""
    columns = ["kind", "host", "line", "n", "doc_id", "line_no", "holes", "proof", "chars", "head"]
    for pdf in batches:
        counts: dict[tuple, int] = {}
        out = []
        for doc_id, host, text in zip(pdf["doc_id"], pdf["source"], pdf["text"], strict=True):
            lines = [x for x in (line.strip() for line in _LINES.split(text)) if x]
            if not lines:
                continue
            marks = [xxhash.xxh3_64_intdigest(_BLANKS.sub(" ", _FIGURES.sub("0", x))) - 2**63 for x in lines]
            copy = xxhash.xxh3_64_intdigest("\n".join(lines)) - 2**63
            for m in {*marks}:
                counts[(host, m, copy)] = 1
            signs = _signs(text)
            if not signs and not any(map(_suspect, lines)):
                continue
            rows, any_ = [], False
            for no, (x, m) in enumerate(zip(lines, marks, strict=True)):
                furniture = _FURNITURE.fullmatch(x) is not None and not _known(x)
                bits = 0 if furniture else _signs(x)
                holes = holes_of(x) if bits & 2 else 0
                proof, chars = (0, 0) if furniture else evidence_of(x) if bits & 1 or _suspect(x) else (0, len(x))
                any_ |= bool(holes or proof)
                rows.append((1, host, m, 0, doc_id, no, holes, proof, chars, no == 0 and len(lines) > 1 and not proof and _heading(x)))
            if any_:
                out += rows
        out += [(0, h, m, c, None, None, None, None, None, None) for h, m, c in counts]
        yield pd.DataFrame(out, columns=columns)


def residue_records(documents: DataFrame, share: float = RECURRENT_SHARE, least: int = RECURRENT_LEAST) -> DataFrame:
    """One row per document with evidence: doc_id, holes, proof_chars, residual_chars, residue (the decision)."""
    rows = documents.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    schema = "kind int, host string, line long, n long, doc_id long, line_no int, holes int, proof int, chars int, head boolean"
    scanned = materialize(rows.mapInPandas(_scan, schema), "residue-lines")
    own = scanned.filter("kind = 1").drop("kind", "n")
    # Copies of a text count once: n holds the text's hash, counted after the lines that matter are known.
    wanted = own.select("line").distinct()
    per_line = scanned.filter("kind = 0").join(wanted, "line", "left_semi")
    per_host = per_line.groupBy("host", "line").agg(F.count_distinct("n").alias("host_n"))
    overall = per_host.groupBy("line").agg(F.sum("host_n").alias("all_n"))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"))
    total = sizes.agg(F.sum("host_docs").alias("all_docs"))
    lines = own.join(per_host, ["host", "line"]).join(overall, "line").join(sizes.withColumnRenamed("source", "host"), "host").join(F.broadcast(total))
    recurs = (F.col("host_n") >= F.greatest(F.lit(least), F.col("host_docs") * share)) | (F.col("all_n") >= F.greatest(F.lit(least), F.col("all_docs") * share))
    lines = lines.withColumn("recurs", recurs)
    real = F.sum(F.when(~F.col("recurs") & ~F.col("head"), F.col("chars") - F.col("proof")).otherwise(0))
    per_doc = lines.groupBy("doc_id").agg(
        F.sum(F.when(~F.col("recurs"), F.col("holes")).otherwise(0)).alias("holes"),
        F.sum("holes").alias("all_holes"),
        F.sum("proof").alias("proof_chars"),
        (F.sum("proof") + real).alias("residual_chars"),
        real.alias("real_chars"),
    )
    mostly = (F.col("proof_chars") > 0) & (F.col("proof_chars") >= MOSTLY * F.col("residual_chars"))
    alone = (F.col("all_holes") > 0) & (F.col("real_chars") == 0)
    return per_doc.withColumn("residue", (F.col("holes") > 0) | mostly | alone)


def residue_ids(documents: DataFrame) -> DataFrame:
    return residue_records(documents).filter("residue").select("doc_id")


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are not found."""
    return documents.join(residue_ids(documents), "doc_id", "left_anti")
