"""Queries over pages, chunks, images and documents, and their DuckDB SQL. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import numeric, text
from leafmill.operators import budget, classify, extract, figures, ground, quality, sequence, state, storyboard
from leafmill.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def sql(pattern: str) -> str:
    """A pattern as a DuckDB string literal; code points as RE2 writes them."""
    return "'" + pattern.replace("'", "''") + "'"


WS = text.WS
STRIP = f"regexp_replace(%s, {sql(f'^{WS}+|{WS}+$')}, '', 'g')"
HEADING = "|".join(f"(?:{p})" for p in text.HEADINGS)
MARKS = text.SENTENCE_MARKS
TRIM = "".join({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c) for c in text.TRIMMED_MARKS)


def sql_strip(x: str) -> str:
    return STRIP % x


def sql_trim(x: str, most: int) -> str:
    s = f"regexp_replace(regexp_replace({x}, {sql(f'^{WS}*[{TRIM}]*{WS}*')}, ''), {sql(f'{WS}*[{TRIM}]*{WS}*$')}, '')"
    return f"CASE WHEN length({s}) <= {most} THEN {s} ELSE regexp_replace(substring({s}, 1, {most}), {sql(f'[{TRIM}]+$')}, '') END"


SQL_SENTENCES = f"list_filter(list_transform(regexp_extract_all(regexp_replace({sql_strip('text')}, {sql(WS + '*\\n' + WS + '*')}, '', 'g'), {sql(f'[^{MARKS}]*[{MARKS}]|[^{MARKS}]+')}), lambda s: {sql_strip('s')}), lambda s: length(s) > 0)"


# ---------------------------------------------------------------- text


@query(f"SELECT page_id, len(regexp_extract_all(text, {sql('[' + text.CJK + ']')}))::INTEGER AS cjk, length(text)::INTEGER AS chars FROM pdf_pages")
def cjk_and_char_counts(spark, d):
    return table(spark, d, "pdf_pages").select("page_id", text.cjk_char_count(F.col("text")).alias("cjk"), F.length("text").alias("chars"))


@query(f"""SELECT page_id, {sql_strip("regexp_replace(regexp_replace(nfc_normalize(text), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS clean FROM pdf_pages""")
def normalise_text(spark, d):
    return table(spark, d, "pdf_pages").select("page_id", text.normalise_text(F.col("text")).alias("clean"))


@query(f"""SELECT page_id, unnest(list_transform(list_filter(string_split(text, chr(10))[1:80], lambda x: length({sql_strip('x')}) BETWEEN 1 AND 60 AND regexp_matches({sql_strip('x')}, {sql(HEADING)})), lambda x: {sql_strip('x')})) AS heading FROM pdf_pages""")
def heading_lines(spark, d):
    return table(spark, d, "pdf_pages").select("page_id", F.explode(text.extract_headings(F.col("text"), 80)).alias("heading"))


@query(f"SELECT page_id, (n - 1)::INTEGER AS sentence_no, s[n] AS sentence FROM (SELECT page_id, {SQL_SENTENCES} AS s FROM pdf_pages WHERE text IS NOT NULL) t, unnest(range(1, len(s) + 1)) u(n)")
def sentence_split(spark, d):
    return extract.sentences(table(spark, d, "pdf_pages"), "page_id").select("page_id", F.col("sentence_no").cast("int").alias("sentence_no"), "sentence")


RISK_WORDS = "風險 警告 注意 禁止 不得 賠償 違約 逾期 warning caution risk".split()


@query(f"SELECT page_id, (n - 1)::INTEGER AS sentence_no, substring(s[n], 1, 140) AS sentence FROM (SELECT page_id, {SQL_SENTENCES} AS s FROM pdf_pages WHERE text IS NOT NULL) t, unnest(range(1, len(s) + 1)) u(n) WHERE regexp_matches(s[n], {sql('|'.join(RISK_WORDS))})")
def risk_sentences(spark, d):
    return extract.keyword_sentences(table(spark, d, "pdf_pages"), "page_id", words=RISK_WORDS).select("page_id", F.col("sentence_no").cast("int").alias("sentence_no"), "sentence")


CUES = r"[^。．.!?！？\n]{0,21}[。．.!?！？\n]|[^。．.!?！？\n]{22}|[^。．.!?！？\n]+"


@query(f"SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, {sql(CUES)}), lambda c: {sql_strip('c')}), lambda c: length(c) > 0)) AS cue FROM documents WHERE text IS NOT NULL")
def subtitle_cues(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(text.subtitle_cues(F.col("text"))).alias("cue"))


@query()
def speech_pieces(spark, d):
    """Order-dependent packing: checked against brute force in the tests."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(text.speech_pieces(F.col("text"))).alias("piece_no", "piece"))


@query()
def spoken_text(spark, d):
    """Numerals in words: checked against brute force in the tests."""
    return table(spark, d, "documents").select("doc_id", text.spoken_text(F.col("text")).alias("spoken"))


TOKENS = r"list_distinct(list_filter(regexp_extract_all(lower(%s), '[\p{L}\p{N}_]+'), lambda t: length(t) >= 2))"


@query(f"""WITH t AS (SELECT chunk_key, {TOKENS % "coalesce(array_to_string(headings, ' '), '')"} AS h, {TOKENS % "coalesce(text, '')"} AS w FROM pdf_chunks)
    SELECT chunk_key, len(h)::INTEGER AS heading_tokens, len(list_intersect(h, w))::INTEGER AS shared FROM t""")
def token_overlap(spark, d):
    c = table(spark, d, "pdf_chunks").select("chunk_key", text.word_tokens(F.coalesce(F.array_join("headings", " "), F.lit(""))).alias("h"), text.word_tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return c.select("chunk_key", F.size("h").alias("heading_tokens"), F.size(F.array_intersect("h", "w")).alias("shared"))


@query()
def narration_overlap(spark, d):
    """Tokens with glued words and pairs and triples of characters: checked against brute force in the tests."""
    c = table(spark, d, "pdf_chunks").filter("text IS NOT NULL").select("chunk_key", text.overlap_tokens(F.coalesce(F.array_join("headings", "\n"), F.lit(""))).alias("h"), text.overlap_tokens(F.col("text")).alias("w"))
    return c.select("chunk_key", text.overlap_share(F.col("h"), F.col("w")).alias("share"))


@query("""WITH p AS (SELECT DISTINCT src_id, page FROM pdf_pages WHERE list_count(headings) > 0), r AS (SELECT src_id, page, page - row_number() OVER (PARTITION BY src_id ORDER BY page) AS g FROM p)
    SELECT src_id, min(page)::INTEGER AS "first", max(page)::INTEGER AS "last" FROM r GROUP BY src_id, g""")
def source_page_runs(spark, d):
    pages = table(spark, d, "pdf_pages").filter(F.size("headings") > 0)
    return sequence.page_islands(pages, "src_id", "page")


@query("""WITH p AS (SELECT chunk_key, unnest(range(start_page, end_page + 1, 2)) AS page FROM pdf_chunks)
    SELECT chunk_key, string_agg(page::VARCHAR, ',' ORDER BY page) AS source_ref FROM p GROUP BY chunk_key""")
def source_refs(spark, d):
    """Every second page of each chunk as a reference; the runs of single pages."""
    c = table(spark, d, "pdf_chunks").filter("start_page <= end_page")
    return c.select("chunk_key", text.page_runs(F.sequence("start_page", "end_page", F.lit(2))).alias("source_ref"))


@query("""SELECT chunk_key, start_page::VARCHAR || CASE WHEN end_page > start_page THEN '-' || end_page::VARCHAR ELSE '' END AS source_ref, sha256('{"v":' || src_id || '}' || '␟' || '{"v":"' || chunk_id || '"}') AS hash FROM pdf_chunks WHERE start_page <= end_page""")
def chunk_refs_and_hashes(spark, d):
    c = table(spark, d, "pdf_chunks").filter("start_page <= end_page")
    return c.select("chunk_key", text.page_runs(F.sequence("start_page", "end_page")).alias("source_ref"), text.stable_hash(F.col("src_id"), F.col("chunk_id")).alias("hash"))


# ---------------------------------------------------------------- facts


def _fact_sql(columns: str, tail: str = "") -> str:
    """One SELECT per pattern over the pages, spans from the gaps between matches, the first pattern of a span kept."""
    parts = []
    for no, p in enumerate(extract.PATTERNS):
        x = sql(p.expression)
        parts.append(
            f"SELECT page_id, text, {no} AS pattern_no, '{p.kind}' AS kind, '{p.label}' AS label, '{p.importance}' AS importance, "
            f"(list_sum(list_transform(g[1:n], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:n - 1], lambda y: length(y))), 0))::INTEGER AS start, m[n] AS hit, v[n] AS val "
            f"FROM (SELECT page_id, text, string_split_regex(text, {x}) AS g, regexp_extract_all(text, {x}) AS m, regexp_extract_all(text, {x}, 1) AS v FROM pdf_pages WHERE text IS NOT NULL AND regexp_matches(text, {x})) t, unnest(range(1, len(m) + 1)) u(n)"
        )
    around = (
        f"regexp_extract(substring(text, greatest(start - 60, 0) + 1, least(start, 60)), {sql(f'([^{MARKS}]*)$')}, 1) || hit || "
        f"regexp_extract(substring(text, start + length(hit) + 1, 60), {sql(f'^([^{MARKS}]*[{MARKS}]?)')}, 1)"
    )
    return f"""WITH s AS ({' UNION ALL '.join(parts)}), d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page_id, start, length(hit) ORDER BY pattern_no) = 1),
        q AS (SELECT *, {sql_trim('val', 40)} AS value, {around} AS around FROM d), f AS (SELECT *, {sql_trim('around', 80)} AS quote FROM q)
        SELECT {columns} FROM f WHERE length(value) > 0 AND length(quote) > 0 {tail}"""


@query(_fact_sql("page_id, pattern_no, kind, label, importance, start, value, quote"))
def fact_spans(spark, d):
    return extract.facts(table(spark, d, "pdf_pages"), "page_id")


@query(_fact_sql("label, kind, count(*)::BIGINT AS facts, count(DISTINCT page_id)::BIGINT AS pages, count(DISTINCT value)::BIGINT AS distinct_values", "GROUP BY label, kind"))
def fact_label_counts(spark, d):
    f = extract.facts(table(spark, d, "pdf_pages"), "page_id")
    return f.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("page_id").alias("pages"), F.count_distinct("value").alias("distinct_values"))


@query(f"""WITH f AS ({_fact_sql("page_id, pattern_no, label, start, value, quote")}), c AS (SELECT *, strpos(quote, value) AS pos FROM f WHERE label IN ('百分比', '金額', '數量')),
    x AS (SELECT page_id, pattern_no, label, start, value, quote, CASE WHEN pos > 0 THEN substring(quote, greatest(pos - 21, 0) + 1, pos - 1 - greatest(pos - 21, 0) + length(value) + 30) ELSE quote END AS near FROM c)
    SELECT page_id, label, value, {sql_trim('near', 60)} AS context, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pattern_no, start) AS rank FROM x) WHERE rank <= 6""")
def key_numbers(spark, d):
    """The first six key numbers of each page, with their context: a top-k report."""
    from pyspark.sql import Window

    f = extract.contexts(extract.facts(table(spark, d, "pdf_pages"), "page_id").filter(F.col("label").isin("百分比", "金額", "數量")))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pattern_no", "start"))
    return f.withColumn("rank", rank).filter("rank <= 6").select("page_id", "label", "value", "context", "rank")


# What a condition and a value look like, most specific first, and the words of sentences that state them.
CONDITIONS = (
    rf"((?:郵輪|旅遊)?出發前{WS}*\p{{Nd}}+{WS}*(?:-|~|–|—|至){WS}*\p{{Nd}}+{WS}*(?:天|日)(?:以上|以內|內|前)?)",
    rf"((?:郵輪|旅遊)?出發前{WS}*\p{{Nd}}+{WS}*(?:天|日)(?:（含{WS}*\p{{Nd}}+{WS}*(?:天|日)內）)?(?:以上|以內|內|前)?)",
    rf"(\p{{Nd}}+{WS}*(?:-|~|–|—|至){WS}*\p{{Nd}}+{WS}*(?:天|日)(?:以上|以內|內|前)?)",
    rf"(\p{{Nd}}+{WS}*(?:天|日)(?:以上|以內|內|前))",
)
VALUES = (
    "(全額訂(?:金|⾦))",
    rf"(全額(?:船艙|艙房|團費)?費用之{WS}*\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}+)?{WS}*%)",
    rf"(\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}+)?{WS}*%)",
    rf"((?:NT\$|NTD|新台幣|新臺幣|台幣|臺幣){WS}*\$?{WS}*[\p{{Nd}},]+(?:\.\p{{Nd}}+)?{WS}*(?:元|圓)?)",
    rf"(\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})+{WS}*(?:元|圓|塊))",
    "(不予退款|恕不退還|無退費義務|不得要求[^，。；;]*退[^，。；;]*|恕無法更動[^，。；;]*|無法更動[^，。；;]*)",
)
CONDITION_WORDS = storyboard.PENALTY


def _first_sql(patterns, x="s[n]") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {sql(p)}) THEN regexp_extract({x}, {sql(p)}, 1)" for p in patterns) + " ELSE '' END"


@query(f"""WITH r AS (SELECT page_id, (n - 1)::INTEGER AS sentence_no, s[n] AS sent, {_first_sql(CONDITIONS)} AS c, {_first_sql(VALUES)} AS v FROM (SELECT page_id, {SQL_SENTENCES} AS s FROM pdf_pages WHERE text IS NOT NULL) t, unnest(range(1, len(s) + 1)) u(n) WHERE regexp_matches(s[n], {sql('|'.join(CONDITION_WORDS))}))
    SELECT page_id, sentence_no, {sql_trim('c', 52)} AS condition, {sql_trim('v', 28)} AS value, {sql_trim('sent', 160)} AS sentence FROM r WHERE length(c) > 0 AND length(v) > 0""")
def condition_rows(spark, d):
    rows = extract.condition_rows(table(spark, d, "pdf_pages"), "page_id", words=CONDITION_WORDS, conditions=CONDITIONS, values=VALUES)
    return rows.withColumn("sentence_no", F.col("sentence_no").cast("int"))


# ---------------------------------------------------------------- grounding

FORM = f"translate(regexp_replace(nfc_normalize(%s), {sql(WS + '+')}, '', 'g'), '‘’“”，。！？：；／（）', '''''\"\",.!?:;/()')"


def _ratio_sql(q: str, p: str) -> str:
    steps = " ".join(
        f"WHEN floor(length({q}) * {s})::INTEGER >= 6 AND len(list_filter(range(0, length({q}) - floor(length({q}) * {s})::INTEGER + 1, greatest(1, (floor(length({q}) * {s})::INTEGER // 4))), lambda i: contains({p}, substring({q}, i::INTEGER + 1, floor(length({q}) * {s})::INTEGER)))) > 0 THEN floor(length({q}) * {s})::INTEGER / length({q})::DOUBLE"
        for s in (0.9, 0.75, 0.6, 0.45, 0.3)
    )
    return f"CASE WHEN length({q}) = 0 OR length({p}) = 0 THEN 0.0 WHEN contains({p}, {q}) THEN 1.0 {steps} ELSE 0.0 END"


@query(f"""WITH f AS ({_fact_sql("page_id, pattern_no, start, quote")}), p AS (SELECT page_id, {FORM % "coalesce(text, '')"} AS form FROM pdf_pages),
    q AS (SELECT page_id, pattern_no, start, {FORM % "quote"} AS q, {FORM % "substring(quote, 1, length(quote) // 2) || '※' || substring(quote, length(quote) // 2 + 2)"} AS broken FROM f),
    r AS (SELECT q.page_id, pattern_no, start, {_ratio_sql('q', 'p.form')} AS ratio, {_ratio_sql('broken', 'p.form')} AS broken_ratio, n.form IS NOT NULL AS has_next, CASE WHEN n.form IS NOT NULL THEN {_ratio_sql('q', 'n.form')} END AS next_ratio FROM q JOIN p ON p.page_id = q.page_id LEFT JOIN p n ON n.page_id = q.page_id + 1)
    SELECT page_id, pattern_no, start, floor(ratio * 1000 + 0.5)::BIGINT AS ratio_milli, floor(broken_ratio * 1000 + 0.5)::BIGINT AS broken_milli, floor(next_ratio * 1000 + 0.5)::BIGINT AS next_milli, CASE WHEN NOT has_next THEN 'bad_page' WHEN next_ratio < 0.55 THEN 'quote_mismatch' ELSE 'grounded' END AS next_verdict FROM r""")
def evidence_grounding(spark, d):
    """Every quoted fact against the page it comes from, in a damaged copy, and against the next page as a wrong citation."""
    pages = table(spark, d, "pdf_pages")
    quotes = extract.facts(pages, "page_id").select("page_id", "pattern_no", "start", "quote")
    half = F.floor(F.length("quote") / 2).cast("int")
    quotes = quotes.withColumn("broken", F.concat(F.substring("quote", F.lit(1), half), F.lit("※"), F.substring("quote", half + 2, F.length("quote")))).withColumn("next_id", F.col("page_id") + 1)
    forms = ground.page_forms(pages, "page_id")
    rows = ground.grounded(ground.grounded(quotes, forms, ["page_id"]), forms, ["page_id"], "broken", "broken_ratio")
    rows = ground.grounded(rows, forms.withColumnRenamed("page_id", "next_id"), ["next_id"], "quote", "next_ratio")
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    verdict = F.when(F.col("next_ratio").isNull(), "bad_page").when(F.col("next_ratio") < ground.LEAST_RATIO, "quote_mismatch").otherwise("grounded")
    return rows.select("page_id", "pattern_no", "start", milli("ratio").alias("ratio_milli"), milli("broken_ratio").alias("broken_milli"), milli("next_ratio").alias("next_milli"), verdict.alias("next_verdict"))


@query()
def verbatim_overlap(spark, d):
    """Each page against the one read before it; the scan jumps after a hit, so it is checked against brute force in the tests."""
    pages = table(spark, d, "pdf_pages").select("page_id", "text").filter("text IS NOT NULL")
    other = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("text").alias("before"))
    return pages.join(other, "page_id").select("page_id", F.floor(text.verbatim_overlap(F.col("text"), F.col("before")) * 1000 + 0.5).cast("long").alias("overlap_milli"))


@query("SELECT chunk_id || '@' || src_id AS id, count(*)::BIGINT AS n FROM pdf_chunks GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return ground.duplicate_ids(table(spark, d, "pdf_chunks").select(F.concat_ws("@", "chunk_id", F.col("src_id").cast("string")).alias("id")), "id")


# ---------------------------------------------------------------- classification


def _count_sql(x: str, words) -> str:
    return " + ".join(f"((length({x}) - length(replace({x}, {sql(w)}, ''))) // {len(w)})" for w in words)


_SIGNALS = ", ".join([*(f"sum({_count_sql('low', w)})::BIGINT AS hits_{k}" for k, w in classify.LEXICON.items()), *(f"sum({' + '.join(f'len(regexp_extract_all(txt, {sql(p)}))' for p in ps)})::BIGINT AS {k}" for k, ps in classify.COUNTED.items()), f"sum({_count_sql('low', classify.TUTORIAL_TERMS)})::BIGINT AS tutorial"])
SIGNALS_SQL = f"SELECT src_id, count(*)::BIGINT AS pages, sum(coalesce(cjk_char_count, 0))::BIGINT AS cjk_chars, sum(coalesce(len(headings), 0))::BIGINT AS heading_count, {_SIGNALS} FROM (SELECT *, lower(coalesce(text, '')) AS low, coalesce(text, '') AS txt FROM pdf_pages) GROUP BY src_id"


@query(SIGNALS_SQL)
def text_signals(spark, d):
    return classify.text_signals(table(spark, d, "pdf_pages"), "src_id")


# ---------------------------------------------------------------- figures

_ANY = lambda terms: sql("|".join(t.lower() for t in terms))
_LATEST = "SELECT src_id, page, (arg_max(struct_pack(text := text, headings := headings, width := width, height := height, tr := text_area_ratio, ir := image_area_ratio, cjk := cjk_char_count), struct_pack(a := ingested_at, b := page_id))) AS r FROM pdf_pages GROUP BY src_id, page"
_ROLE = "CASE WHEN regexp_matches(blob, '簽名|signature') THEN 'signature' WHEN regexp_matches(blob, '印章|圖章|seal|stamp') THEN 'seal' WHEN regexp_matches(blob, 'logo|標誌') AND area < 0.12 THEN 'logo' WHEN repeated AND area < 0.06 THEN 'decorative' " + " ".join(f"WHEN regexp_matches(blob, {_ANY(t)}) THEN '{n}'" for n, t in classify.ROLE_TERMS) + " WHEN area >= 0.16 THEN 'source_photo' WHEN small THEN 'decorative' ELSE 'unknown' END"
INVENTORY_SQL = f"""WITH p AS ({_LATEST}), c AS (SELECT src_id, sha256, count(*) AS copies FROM pdf_images GROUP BY 1, 2),
    j AS (SELECT i.image_id, i.src_id, i.page, i.pixel_count, i.bbox, coalesce(i.caption_hint, '') AS caption, copies > 2 AS repeated, r.width AS pw, r.height AS ph, coalesce(r.text, '') AS txt, coalesce(r.headings, []) AS hs FROM pdf_images i JOIN c ON c.src_id = i.src_id AND c.sha256 = i.sha256 JOIN p ON p.src_id = i.src_id AND p.page = i.page WHERE i.pixel_count IS NOT NULL),
    k AS (SELECT *, CASE WHEN pw <> 0 AND ph <> 0 AND bbox IS NOT NULL THEN greatest(0.0, least(1.0, (bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) / greatest(1.0, pw * ph))) ELSE 0.0 END AS area,
        substring(coalesce(list_filter(list_transform(hs, lambda h: {sql_strip('h')}), lambda h: length(h) > 0)[1], list_filter(list_transform(string_split(txt, chr(10)), lambda x: {sql_strip('x')}), lambda x: length(x) BETWEEN 4 AND 80)[1]), 1, 80) AS heading,
        array_to_string(list_filter(list_transform(string_split(txt, chr(10)), lambda x: {sql_strip('x')}), lambda x: length(x) > 0), ' ') AS clean FROM j),
    n AS (SELECT *, CASE WHEN length(caption) > 0 AND strpos(clean, caption) > 0 THEN substring({sql_strip("substring(clean, greatest(strpos(clean, caption) - 121, 0) + 1, strpos(clean, caption) - 1 - greatest(strpos(clean, caption) - 121, 0) + length(caption) + 160)")}, 1, 300) ELSE substring(clean, 1, 300) END AS nearby FROM k),
    b AS (SELECT *, lower(caption || ' ' || coalesce(heading, '') || ' ' || nearby) AS blob, coalesce(bbox IS NOT NULL AND pw <> 0 AND ph <> 0 AND bbox.x1 - bbox.x0 < pw * 0.25 AND bbox.y1 - bbox.y0 < ph * 0.18, false) AS small,
        coalesce(bbox IS NOT NULL AND pw <> 0 AND ph <> 0 AND area < 0.05 AND (bbox.y1 < ph * 0.18 OR bbox.y0 > ph * 0.82) AND bbox.x1 - bbox.x0 < pw * 0.35, false) AS edge FROM n),
    v AS (SELECT *, {_ROLE} AS visual_role FROM b),
    e AS (SELECT *, visual_role IN ('decorative', 'logo', 'seal', 'signature') OR (regexp_matches(blob, {_ANY(classify.DECORATIVE_TERMS)}) AND area < 0.12) OR (repeated AND area < 0.08) OR edge AS is_decorative FROM v),
    u AS (SELECT *, NOT is_decorative AND visual_role NOT IN ('decorative', 'logo', 'seal', 'signature') AND (area >= 0.045 OR pixel_count >= 90000 OR length(caption) > 0) AS likely_useful,
        greatest(0.0, least(4.0, area * 12.0) + least(2.0, pixel_count / 500000.0::DOUBLE) + CASE WHEN length(caption) > 0 THEN 0.8::DOUBLE ELSE 0.0 END + CASE WHEN length(heading) > 0 THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN visual_role IN ('source_table', 'source_screenshot', 'source_chart', 'source_diagram', 'source_photo') THEN 1.0 ELSE 0.0 END - CASE WHEN repeated THEN 0.8::DOUBLE ELSE 0.0 END - CASE WHEN is_decorative THEN 3.0::DOUBLE ELSE 0.0 END) AS score FROM e)"""


@query(INVENTORY_SQL + " SELECT image_id, src_id, page, pixel_count, caption, visual_role, is_decorative, likely_useful, repeated, floor(score * 1000 + 0.5)::BIGINT AS salience_milli, floor(area * 10000 + 0.5)::BIGINT AS area_e4 FROM u")
def visual_inventory(spark, d):
    return figures.inventory(table(spark, d, "pdf_images"), table(spark, d, "pdf_pages"))


_PAGE_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(low, {_ANY(t)}) THEN '{n}'" for n, t in classify.ROLE_TERMS[:4]) + " ELSE 'source_page_crop' END"


@query(INVENTORY_SQL + f""", s AS (SELECT src_id, page, lower(coalesce(r.text, '')) AS low, coalesce(r.ir, 0.0) AS ir, coalesce(r.tr, 0.0) AS tr, coalesce(len(r.headings), 0) > 0 AS headed, coalesce(r.cjk, 0) < 450 AS few FROM p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.likely_useful AND u.src_id = p.src_id AND u.page = p.page)),
    t AS (SELECT *, few AND (headed OR ir > 0.12) AS sparse FROM s), w AS (SELECT src_id, page, {_PAGE_ROLE} AS visual_role, floor((least(4.0, ir * 9.0) + CASE WHEN sparse THEN 1.0 ELSE 0.0 END + CASE WHEN headed THEN 0.5 ELSE 0.0 END) * 1000 + 0.5)::BIGINT AS salience_milli FROM t WHERE ir >= 0.18 OR (sparse AND tr < 0.55))
    SELECT src_id, page, visual_role, salience_milli, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY salience_milli DESC, page) AS rank FROM w) WHERE rank <= 60""")
def page_candidates(spark, d):
    pages = table(spark, d, "pdf_pages")
    useful = figures.inventory(table(spark, d, "pdf_images"), pages).filter("likely_useful")
    return figures.page_candidates(pages, useful)


PASSAGE_WORDS = TOKENS % "coalesce(array_to_string(headings, ' '), '')"
SCORES_SQL = f"""WITH c AS (SELECT chunk_key AS passage_id, src_id, start_page, {PASSAGE_WORDS} AS words, unnest(range(start_page - 1, end_page + 2)) AS page FROM pdf_chunks),
    i AS (SELECT *, {TOKENS % "coalesce(caption_hint, '')"} AS tokens FROM pdf_images), s AS (SELECT passage_id, image_id, floor((CASE abs(c.page - start_page) WHEN 0 THEN 5.0 WHEN 1 THEN 2.5 WHEN 2 THEN 1.0 ELSE 0.0 END + least(3.0, len(list_intersect(words, tokens)) * 0.6::DOUBLE) + greatest(0.0, least(2.0, (pixel_count - 40000) / 600000.0::DOUBLE))) * 1000 + 0.5)::BIGINT AS score_milli FROM c JOIN i ON i.src_id = c.src_id AND i.page = c.page)"""


def _passages(spark, d):
    c = table(spark, d, "pdf_chunks")
    return c.select(F.col("chunk_key").alias("passage_id"), "src_id", "start_page", "end_page", text.word_tokens(F.coalesce(F.array_join("headings", " "), F.lit(""))).alias("words"))


@query(SCORES_SQL + " SELECT passage_id, image_id, score_milli FROM s WHERE score_milli >= 3000 QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY score_milli DESC, image_id) = 1")
def best_figures(spark, d):
    return figures.best_figures(figures.figure_scores(_passages(spark, d), table(spark, d, "pdf_images")))


@query()
def figure_assignment(spark, d):
    """Greedy with a penalty for reuse: checked against the sequential procedure in the tests."""
    return figures.spread_figures(figures.figure_scores(_passages(spark, d), table(spark, d, "pdf_images")))


KINDS_SQL_ROOT = "greatest(1.0, sqrt(pages))"


def _kind_sql() -> str:
    s = {k: f"hits_{k} / {KINDS_SQL_ROOT}" for k in classify.LEXICON}
    return f"""{INVENTORY_SQL}, g AS ({SIGNALS_SQL}), fv AS (SELECT src_id, count(*) AS image_count, count(*) FILTER (WHERE likely_useful) AS useful, count(*) FILTER (WHERE is_decorative) AS decorative, count(DISTINCT page) FILTER (WHERE likely_useful AND floor(area * 10000 + 0.5) >= 1200) AS large_pages FROM u GROUP BY 1),
        a AS (SELECT g.*, coalesce(image_count, 0) AS image_count, coalesce(useful, 0) AS useful, coalesce(decorative, 0) AS decorative, coalesce(large_pages, 0) AS large_pages FROM g LEFT JOIN fv USING (src_id)),
        r0 AS (SELECT *, cjk_chars / pages::DOUBLE AS cjk, heading_count / pages::DOUBLE AS heads, image_count / pages::DOUBLE AS imgs, useful / pages::DOUBLE AS upp, large_pages / pages::DOUBLE AS lpr FROM a),
        r1 AS (SELECT *, round(greatest(0.0, (CASE WHEN useful >= 3 THEN 1.0 ELSE 0 END + CASE WHEN upp >= 0.20 THEN 1.5 ELSE 0 END + CASE WHEN upp >= 0.45 THEN 1.0 ELSE 0 END + CASE WHEN lpr >= 0.18 THEN 1.5 ELSE 0 END + CASE WHEN lpr >= 0.40 THEN 1.0 ELSE 0 END + CASE WHEN imgs >= 0.45 THEN 0.8 ELSE 0 END + CASE WHEN cjk < 550 AND (upp >= 0.15 OR heads >= 0.6) THEN 0.8 ELSE 0 END + CASE WHEN tutorial >= 4 THEN 0.8 ELSE 0 END + CASE WHEN tutorial >= 10 THEN 0.8 ELSE 0 END - CASE WHEN decorative > useful AND useful < 3 THEN 1.5 ELSE 0 END)::DOUBLE), 3) AS rich FROM r0),
        r2 AS (SELECT *, {s['contract']} + (CASE WHEN deadlines >= 3 THEN 1.5::DOUBLE ELSE 0.0 END + CASE WHEN amounts >= 2 THEN 1.0::DOUBLE ELSE 0.0 END + CASE WHEN shares >= 3 THEN 0.8::DOUBLE ELSE 0.0 END) AS contract, {s['form']} AS form, {s['policy']} AS policy FROM r1),
        r3 AS (SELECT *, contract < 2.0 AND form < 2.0 AND policy < 2.0 AS free FROM r2),
        r4 AS (SELECT *, CASE WHEN hits_paper < 2 THEN {s['paper']} * 0.6::DOUBLE ELSE {s['paper']} END AS paper, {s['manual']} + CASE WHEN free THEN least(3.0, tutorial / greatest(2.0, sqrt(pages)) * 0.8::DOUBLE) + CASE WHEN rich >= 3.0 AND tutorial >= 2 THEN 1.5::DOUBLE ELSE 0.0 END ELSE 0.0 END AS manual, {s['report']} + CASE WHEN contract < 1.0 AND shares + amounts >= 5 THEN 1.5::DOUBLE ELSE 0.0 END AS report,
            CASE WHEN heads < 0.5 AND imgs < 0.3 THEN 0.0::DOUBLE ELSE CASE WHEN cjk < 250 THEN 2.0::DOUBLE ELSE 0.0 END + CASE WHEN heads >= 0.7 THEN 1.5::DOUBLE ELSE 0.0 END + CASE WHEN imgs >= 0.4 THEN 1.0::DOUBLE ELSE 0.0 END END + CASE WHEN free AND rich >= 3.0 AND cjk < 300 THEN 1.0::DOUBLE ELSE 0.0 END AS slides FROM r3),
        l AS (SELECT src_id, rich, useful, {', '.join(f'hits_{k}' for k in classify.LEXICON)}, list_sort([{', '.join(f"struct_pack(m := -({k})::DOUBLE, i := {i}, k := '{k}')" for i, k in enumerate([*classify.LEXICON, 'slides']))}]) AS t FROM r4)
        SELECT src_id, CASE WHEN t[1].m >= 0 THEN 'unknown' ELSE t[1].k END AS doc_kind, CASE WHEN t[1].m >= 0 THEN 0 ELSE floor(greatest(0.0, least(1.0, (t[2].m - t[1].m) / -t[1].m)) * 1000 + 0.5)::BIGINT END AS confidence_milli, rich AS visual_rich_score, useful, {', '.join(f'hits_{k}' for k in classify.LEXICON)} FROM l"""


@query(_kind_sql())
def doc_profile(spark, d):
    pages = table(spark, d, "pdf_pages")
    inv = figures.inventory(table(spark, d, "pdf_images"), pages)
    seen = inv.groupBy("src_id").agg(F.count(F.lit(1)).alias("image_count"), F.count_if("likely_useful").alias("useful"), F.count_if("is_decorative").alias("decorative"), F.count_distinct(F.when(F.col("likely_useful") & (F.col("area_e4") >= 1200), F.col("page"))).alias("large_pages"))
    rows = classify.text_signals(pages, "src_id").join(seen, "src_id", "left").na.fill(0, ["image_count", "useful", "decorative", "large_pages"])
    return classify.document_kinds(classify.document_scores(rows), "src_id")


# ---------------------------------------------------------------- sequences and budgets


@query("""WITH RECURSIVE p AS (SELECT src_id, page, sum(coalesce(cjk_char_count, 0))::BIGINT AS c, row_number() OVER (PARTITION BY src_id ORDER BY page) AS n FROM pdf_pages GROUP BY src_id, page),
    w AS (SELECT src_id, page, c AS buf, 1 AS chunk_no, n FROM p WHERE n = 1 UNION ALL SELECT p.src_id, p.page, CASE WHEN w.buf + p.c > 6000 THEN p.c ELSE w.buf + p.c END, CASE WHEN w.buf + p.c > 6000 THEN w.chunk_no + 1 ELSE w.chunk_no END, p.n FROM w JOIN p ON p.src_id = w.src_id AND p.n = w.n + 1)
    SELECT src_id, page::BIGINT AS page, chunk_no::BIGINT AS chunk_no FROM w""")
def chunk_packing(spark, d):
    sizes = table(spark, d, "pdf_pages").groupBy("src_id", "page").agg(F.sum(F.coalesce("cjk_char_count", F.lit(0))).alias("size"))
    return sequence.pack(sizes, "src_id", "page", "size", 6000)


@query("SELECT chunk_key, src_id || '_sc_' || lpad(row_number() OVER (PARTITION BY src_id ORDER BY chunk_key)::VARCHAR, greatest(3, length(row_number() OVER (PARTITION BY src_id ORDER BY chunk_key)::VARCHAR))::INTEGER, '0') AS new_id FROM pdf_chunks")
def renumbered_ids(spark, d):
    return sequence.renumbered(table(spark, d, "pdf_chunks").select("chunk_key", "src_id"), "src_id", ["chunk_key"]).select("chunk_key", "new_id")


@query("""WITH c AS (SELECT chunk_key, src_id, CASE WHEN chunk_key % 7 = 0 THEN 'intro' ELSE replace(chunk_id, 'chunk_', 'ch_') END AS raw, 'ch_' || lpad(row_number() OVER (PARTITION BY src_id ORDER BY chunk_key)::VARCHAR, greatest(3, length(row_number() OVER (PARTITION BY src_id ORDER BY chunk_key)::VARCHAR))::INTEGER, '0') AS pos FROM pdf_chunks),
    k AS (SELECT *, CASE WHEN regexp_matches(raw, '^ch_[0-9]{3,}$') THEN raw ELSE pos END AS kept FROM c), n AS (SELECT src_id, max(n) AS most FROM (SELECT src_id, kept, count(*) AS n FROM k GROUP BY ALL) GROUP BY 1)
    SELECT chunk_key, CASE WHEN most > 1 THEN pos ELSE kept END AS canonical_id FROM k JOIN n USING (src_id)""")
def canonical_chapter_ids(spark, d):
    """Chunk ids as chapter ids, every seventh of a form that is not canonical."""
    c = table(spark, d, "pdf_chunks").select("chunk_key", "src_id", F.when(F.col("chunk_key") % 7 == 0, "intro").otherwise(F.replace("chunk_id", F.lit("chunk_"), F.lit("ch_"))).alias("raw"))
    return sequence.canonical_ids(c, "src_id", "chunk_key", "raw").select("chunk_key", "canonical_id")


SCENES_SQL = f"""WITH sc AS (SELECT src_id, page_id AS seq, CASE WHEN page = 1 THEN 'cover' WHEN regexp_matches(coalesce(text, ''), '賠償|違約|不得') THEN 'risk_warning' WHEN regexp_matches(coalesce(text, ''), '[0-9]%') THEN 'key_number' WHEN coalesce(len(headings), 0) > 0 THEN 'section_intro' ELSE 'paragraph_card' END AS kind, len(regexp_extract_all(coalesce(text, ''), '[0-9]+%')) AS facts, coalesce(len(headings), 0) AS spans FROM pdf_pages),
    sd AS (SELECT *, CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in budget.SECONDS.items())} ELSE 22.0 END::DOUBLE AS seconds, (CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in budget.PRIORITY.items())} ELSE 30 END + least(10, 2 * facts) + CASE WHEN spans > 0 THEN 5 ELSE 0 END)::INTEGER AS score FROM sc)"""


def _scenes(spark, d):
    t, heads = F.coalesce("text", F.lit("")), F.greatest(F.lit(0), F.coalesce(F.size("headings"), F.lit(0)))
    kind = F.when(F.col("page") == 1, "cover").when(t.rlike("賠償|違約|不得"), "risk_warning").when(t.rlike("[0-9]%"), "key_number").when(heads > 0, "section_intro").otherwise("paragraph_card")
    p = table(spark, d, "pdf_pages").select("src_id", F.col("page_id").alias("seq"), kind.alias("kind"), F.regexp_count(t, F.lit("[0-9]+%")).alias("facts"), heads.alias("spans"))
    return p.select("src_id", "seq", "kind", "facts", budget.scene_seconds(F.col("kind"), F.lit(None).cast("double")).alias("seconds"), budget.scene_score(F.col("kind"), F.lit(None).cast("string"), F.col("facts"), F.col("spans")).alias("score"))


@query(SCENES_SQL + """, t AS (SELECT src_id, sum(seconds) AS total, count(*) AS n FROM sd GROUP BY 1), o AS (SELECT src_id, seq, coalesce(sum(seconds) OVER w, 0) AS gone, count(*) OVER w AS dropped FROM sd WHERE kind NOT IN ('cover', 'recap_card') WINDOW w AS (PARTITION BY src_id ORDER BY score, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT src_id, seq FROM o JOIN t USING (src_id) WHERE total - gone > 150 AND n - dropped > 3) SELECT src_id, seq, kind, facts::INTEGER AS facts, seconds, score FROM sd WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.src_id = sd.src_id AND x.seq = sd.seq)""")
def budget_trim(spark, d):
    return budget.trimmed(_scenes(spark, d), "src_id", 150.0)


@query(SCENES_SQL + """, t AS (SELECT src_id, sum(seconds) AS total FROM sd GROUP BY 1), s AS (SELECT src_id, seq, score, ceil((300 - total) / 18)::INTEGER AS room, least(facts, 8) AS cap FROM sd JOIN t USING (src_id) WHERE total < 240 AND facts > 0), e AS (SELECT src_id, seq, score, room, unnest(range(0, cap)) AS item FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY item, score DESC, seq) AS slot FROM e) SELECT src_id, slot::INTEGER AS slot, seq, item::INTEGER AS item FROM r WHERE slot <= room""")
def budget_pad_slots(spark, d):
    s = _scenes(spark, d)
    totals = s.groupBy("src_id").agg(F.sum("seconds").alias("total"))
    return budget.padding(s.withColumn("capacity", F.least(F.col("facts"), F.lit(8))), totals, "src_id", 240.0, 300.0)


@query(f"""WITH s AS (SELECT src_id, page_id, page, greatest(12.0, least(120.0, coalesce(cjk_char_count, 0) / 240.0::DOUBLE * 60.0 + 0.6::DOUBLE)) AS sec, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), {sql(CUES)}), lambda c: {sql_strip('c')}), lambda c: length(c) > 0) AS cues FROM pdf_pages),
    o AS (SELECT *, coalesce(sum(floor(sec * 1000 + 0.5)::BIGINT) OVER (PARTITION BY src_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms, floor(sec * 1000 + 0.5)::BIGINT AS ms FROM s)
    SELECT page_id, (n - 1)::INTEGER AS cue_no, cues[n] AS cue, (start_ms + ms * (n - 1) // len(cues))::BIGINT AS begin_ms FROM o, unnest(range(1, len(cues) + 1)) u(n)""")
def subtitle_timeline(spark, d):
    """Cues of all pages on the time line of their source, in whole milliseconds."""
    seconds = numeric.scene_seconds(F.coalesce("cjk_char_count", F.lit(0)))
    rows = table(spark, d, "pdf_pages").select("src_id", "page_id", F.floor(seconds * 1000 + 0.5).cast("long").alias("ms"), text.subtitle_cues(F.coalesce("text", F.lit(""))).alias("cues"))
    rows = sequence.running_sum(rows, ["src_id"], "page_id", F.col("ms"), "start_ms")
    one = rows.select("page_id", "start_ms", "ms", F.size("cues").alias("n"), F.posexplode("cues").alias("cue_no", "cue"))
    return one.select("page_id", "cue_no", "cue", (F.col("start_ms") + F.floor(F.col("ms") * F.col("cue_no") / F.col("n"))).cast("long").alias("begin_ms"))


@query("""SELECT src_id, pages, greatest(3.0, least(120.0, round_even(cjk / 2200.0::DOUBLE, 0))) AS minutes_plain, CASE WHEN pages > 300 AND heads > 15 THEN greatest(45.0, least(90.0, greatest(3.0, least(120.0, round_even(cjk / 2200.0::DOUBLE, 0))))) ELSE greatest(3.0, least(120.0, round_even(cjk / 2200.0::DOUBLE, 0))) END AS minutes FROM (SELECT src_id, count(*)::BIGINT AS pages, sum(coalesce(cjk_char_count, 0)) AS cjk, sum(coalesce(len(headings), 0)) AS heads FROM pdf_pages GROUP BY src_id)""")
def target_minutes(spark, d):
    s = table(spark, d, "pdf_pages").groupBy("src_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("cjk_char_count", F.lit(0))).alias("cjk"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("headings"), F.lit(0)))).alias("heads"))
    plain = numeric.target_minutes(F.col("cjk"), F.lit(0), F.lit(0))
    return s.select("src_id", "pages", plain.alias("minutes_plain"), numeric.target_minutes(F.col("cjk"), F.col("pages"), F.col("heads")).alias("minutes"))


# ---------------------------------------------------------------- quality and state


@query("""WITH q AS (SELECT src_id, count(*) AS n, count(*) FILTER (WHERE text_source = 'empty') AS e, count(*) FILTER (WHERE text_source = 'ocr') AS o, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) = 0) AS b FROM pdf_pages GROUP BY src_id)
    SELECT src_id, 'empty_pdf_pages' AS code, 'warning' AS severity, e::DOUBLE AS measure FROM q WHERE e > 0 UNION ALL SELECT src_id, 'ocr_pages', 'info', o::DOUBLE FROM q WHERE o > 0 UNION ALL SELECT src_id, 'many_empty_pages', 'error', e::DOUBLE FROM q WHERE e >= 0.2 * n UNION ALL SELECT src_id, 'blank_text_with_source', 'warning', (b - e)::DOUBLE FROM q WHERE b > e""")
def page_quality_issues(spark, d):
    return quality.broken_rules(quality.page_quality(table(spark, d, "pdf_pages"), "src_id"), ["src_id"], quality.page_rules())


@query("""SELECT s.src_id, max(s.page_count)::INTEGER AS page_count, count(DISTINCT p.page)::BIGINT AS pages_seen, count(DISTINCT p.page) FILTER (WHERE length(trim(coalesce(p.text, ''))) > 0)::BIGINT AS pages_with_text, coalesce(sum(p.cjk_char_count), 0)::BIGINT AS cjk FROM (SELECT src_id, max(page_count) AS page_count FROM pdf_sources GROUP BY 1) s LEFT JOIN pdf_pages p ON p.src_id = s.src_id GROUP BY s.src_id""")
def coverage_metrics(spark, d):
    sources = table(spark, d, "pdf_sources").groupBy("src_id").agg(F.max("page_count").alias("page_count"))
    seen = table(spark, d, "pdf_pages").groupBy("src_id").agg(F.count_distinct("page").alias("pages_seen"), F.count_distinct(F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, F.col("page"))).alias("pages_with_text"), F.sum("cjk_char_count").alias("cjk"))
    return sources.join(seen, "src_id", "left").na.fill(0, ["pages_seen", "pages_with_text", "cjk"])


NEEDLES = {"contract": {"parties": ["甲方", "承租人"], "deadline": ["日內", "期限"], "penalty": ["賠償", "違約"]}, "report": {"growth": ["成長", "growth", "rose"], "share": ["%"]}, "manual": {"step": ["步驟", "step"], "warning": ["停用", "stop"]}}


@query("WITH n AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, '{f}', '{'|'.join(w)}')" for k, facts in NEEDLES.items() for i, (f, w) in enumerate(facts.items())) + """) v(doc_kind, i, fact, words)), j AS (SELECT doc_id, n.doc_kind, i, fact, regexp_matches(lower(coalesce(text, '')), words) AS hit FROM documents d JOIN n ON n.doc_kind = d.doc_kind)
    SELECT doc_id, doc_kind, coalesce(string_agg(fact, ',' ORDER BY i) FILTER (WHERE hit), '') AS found, coalesce(string_agg(fact, ',' ORDER BY i) FILTER (WHERE NOT hit), '') AS missing FROM j GROUP BY ALL""")
def expected_terms(spark, d):
    rows = quality.expected_terms(table(spark, d, "documents"), "doc_id", "doc_kind", "text", NEEDLES)
    return rows.select("doc_id", "doc_kind", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"))


@query("SELECT src_id, count(*)::BIGINT AS versions, " + ", ".join(f"arg_max({c}, ingested_at) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("project", "source_pdf", "pdf_sha256", "lang", "page_count", "cjk_char_count")) + " FROM pdf_sources GROUP BY src_id")
def source_upsert(spark, d):
    events = table(spark, d, "pdf_sources").select("src_id", "project", "source_pdf", "pdf_sha256", "lang", "page_count", "cjk_char_count", "ingested_at")
    return state.upserted(events, "src_id", ["ingested_at"]).drop("ingested_at")


@query("SELECT src_id, page, count(*)::BIGINT AS versions, arg_min(sha256(text), struct_pack(a := ingested_at, b := page_id)) IS DISTINCT FROM arg_max(sha256(text), struct_pack(a := ingested_at, b := page_id)) AS changed FROM pdf_pages WHERE text IS NOT NULL GROUP BY src_id, page")
def reread_pages(spark, d):
    return state.unchanged_since(table(spark, d, "pdf_pages").filter("text IS NOT NULL"), ["src_id", "page"], ["ingested_at", "page_id"], F.col("text"))


@query("""WITH a AS (SELECT page_id, sha256(text) AS h FROM pdf_pages), m AS (SELECT page_id + 1 AS page_id, sha256(text) AS h FROM pdf_pages) SELECT a.page_id FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = a.page_id AND m.h = a.h)""")
def stale_artifacts(spark, d):
    """Pages whose hash differs from that of the row before: those that an incremental run over the shifted table makes again."""
    a = table(spark, d, "pdf_pages").select("page_id", F.sha2("text", 256).alias("h"))
    return state.stale(a, a.select((F.col("page_id") + 1).alias("page_id"), "h"), ["page_id"], "h").select("page_id")


@query("""WITH e AS (SELECT event_type AS stage, ts AS created_at, event_id FROM events WHERE value < 5), f AS (SELECT event_type AS stage, max(ts) AS done FROM events WHERE value > 95 GROUP BY 1) SELECT e.stage, count(*)::BIGINT AS errors, count(*) FILTER (WHERE done IS NULL OR created_at > done)::BIGINT AS active FROM e LEFT JOIN f USING (stage) GROUP BY 1""")
def error_resolution(spark, d):
    e = table(spark, d, "events")
    errors = e.filter("value < 5").select(F.col("event_type").alias("stage"), F.col("ts").alias("created_at"))
    done = e.filter("value > 95").select(F.col("event_type").alias("stage"), F.col("ts").alias("finished_at"))
    return state.error_status(errors, done).groupBy("stage").agg(F.count(F.lit(1)).alias("errors"), F.count_if("active").alias("active"))


# ---------------------------------------------------------------- storyboards

_W = lambda words: sql("|".join(words))
_SENT = f"SELECT p.src_id, s0.page_id, (n - 1)::INTEGER AS sentence_no, s[n] AS sentence FROM (SELECT page_id, {SQL_SENTENCES} AS s FROM pdf_pages WHERE text IS NOT NULL) s0 JOIN pdf_pages p ON p.page_id = s0.page_id, unnest(range(1, len(s) + 1)) u(n)"
_RISK = " + ".join(f"CASE WHEN regexp_matches(sentence, {_W(w)}) THEN {k} ELSE 0 END" for k, w in storyboard.RISK_WEIGHTS)


def _ranked_sql(rows: str, kind: str, slot: str, order: str, text_: str, value: str = "''", condition: str = "''") -> str:
    return f"SELECT src_id, '{kind}' AS scene_kind, '{slot}' AS slot, ordinal::INTEGER AS ordinal, page_id, {text_} AS text, {value} AS value, {condition} AS condition FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY {order}) AS ordinal FROM {rows}) WHERE ordinal <= 6"


_LABELS = lambda names: ", ".join(f"'{n}'" for n in names)
_NEAR = "CASE WHEN strpos(quote, value) > 0 THEN substring(quote, greatest(strpos(quote, value) - 21, 0) + 1, strpos(quote, value) - 1 - greatest(strpos(quote, value) - 21, 0) + length(value) + 30) ELSE quote END"
ITEMS_SQL = f"""WITH f0 AS ({_fact_sql("page_id, pattern_no, label, start, value, quote")}), f1 AS (SELECT p.src_id, f0.*, {_NEAR} AS near, strpos(p.text, value) > 0 AND regexp_matches(substring(p.text, greatest(strpos(p.text, value) - 41, 0) + 1, strpos(p.text, value) - 1 - greatest(strpos(p.text, value) - 41, 0) + length(value) + 40), {_W(storyboard.PENALTY)}) AS around_it FROM f0 JOIN pdf_pages p ON p.page_id = f0.page_id), f AS (SELECT *, {sql_trim('near', 60)} AS ctx FROM f1), st AS ({_SENT}),
    c0 AS (SELECT src_id, page_id, sentence_no, sentence AS sent, {_first_sql(CONDITIONS, 'sentence')} AS c, {_first_sql(VALUES, 'sentence')} AS v FROM st WHERE regexp_matches(sentence, {_W(CONDITION_WORDS)})),
    du AS (SELECT * FROM f WHERE regexp_matches(quote, {_W(storyboard.OBLIGATION)})), en AS (SELECT src_id FROM du GROUP BY 1 HAVING count(*) >= 3),
    li AS (SELECT src_id, 0 AS part, page_id, pattern_no, start, ctx AS text, value FROM du UNION ALL SELECT src_id, 1, page_id, sentence_no, 0, substring(sentence, 1, 60), '' FROM st WHERE regexp_matches(sentence, {_W(storyboard.OBLIGATION)}) AND src_id NOT IN (SELECT src_id FROM en)),
    pr AS (SELECT src_id, 0 AS part, page_id, sentence_no AS pattern_no, 0 AS start, {sql_trim('c', 52)} AS condition, {sql_trim('v', 28)} AS value, {sql_trim('sent', 160)} AS text FROM c0 WHERE length(c) > 0 AND length(v) > 0 UNION ALL SELECT src_id, 1, page_id, pattern_no, start, ctx, value, quote FROM f WHERE label IN ({_LABELS(storyboard.SHARE_LABELS)}) AND (regexp_matches(quote, {_W(storyboard.PENALTY)}) OR around_it)),
    pd AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY src_id, page_id, condition, value ORDER BY part, pattern_no, start) = 1),
    it AS ({_ranked_sql(f"(SELECT * FROM f WHERE label IN ({_LABELS(storyboard.TIMELINE_LABELS)}))", 'deadline_timeline', 'events', 'page_id, pattern_no, start', 'ctx', 'value')}
    UNION ALL {_ranked_sql(f"(SELECT * FROM f WHERE label IN ({_LABELS(storyboard.NUMBER_LABELS)}))", 'key_number', 'items', 'page_id, pattern_no, start', 'ctx', 'value')}
    UNION ALL {_ranked_sql('li', 'checklist', 'items', 'part, page_id, pattern_no, start', 'text', 'value')} UNION ALL {_ranked_sql('pd', 'penalty_table', 'rows', 'part, page_id, pattern_no, start', 'text', 'value', 'condition')}
    UNION ALL {_ranked_sql(f"(SELECT *, {_RISK} AS sc FROM st WHERE regexp_matches(sentence, {_W(storyboard.RISK)}))", 'risk_warning', 'items', 'sc DESC, page_id, sentence_no', 'substring(sentence, 1, 140)')}
    UNION ALL {_ranked_sql(f"(SELECT * FROM st WHERE regexp_matches(sentence, {_W(storyboard.PROHIBITED)}))", 'do_dont', 'dont', 'page_id, sentence_no', 'substring(sentence, 1, 60)')}
    UNION ALL {_ranked_sql(f"(SELECT * FROM st WHERE NOT regexp_matches(sentence, {_W(storyboard.PROHIBITED)}) AND regexp_matches(sentence, {_W(storyboard.WANTED)}))", 'do_dont', 'do', 'page_id, sentence_no', 'substring(sentence, 1, 60)')})"""


def _items(spark, d):
    pages = table(spark, d, "pdf_pages")
    rows = extract.condition_rows(pages, "src_id", "page_id", words=CONDITION_WORDS, conditions=CONDITIONS, values=VALUES)
    return storyboard.scene_items(extract.facts(pages, "src_id", "page_id", near=storyboard.PENALTY), extract.sentences(pages, "src_id", "page_id"), rows, "src_id")


@query(ITEMS_SQL + " SELECT * FROM it")
def scene_items(spark, d):
    return _items(spark, d)


_LINES = "list_filter(list_transform(string_split(%s, chr(10)), lambda x: " + sql_strip("x") + "), lambda x: %s)"
OUTLINE_SQL = f"""WITH oc AS (SELECT * FROM pdf_chunks QUALIFY row_number() OVER (PARTITION BY src_id, chunk_id ORDER BY chunk_key) = 1), on1 AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY chunk_key) AS rn, count(*) OVER (PARTITION BY src_id) AS n FROM oc),
    ob AS (SELECT *, ((rn - 1) // ceil(n / least(4, n))::BIGINT + 1)::INTEGER AS chapter_no, substring(list_filter(list_transform(coalesce(headings, []), lambda h: {sql_strip('h')}), lambda h: length(h) > 0)[1], 1, 40) AS hd, substring(({_LINES % ("coalesce(text, '')", "length(x) BETWEEN 4 AND 60")})[1], 1, 40) AS ln,
        ({_LINES % ("replace(coalesce(text, ''), '。', '。' || chr(10))", "length(x) >= 8")})[1:3] AS pts FROM on1),
    oh AS (SELECT src_id, chapter_no, coalesce(arg_min(hd, rn) FILTER (WHERE hd IS NOT NULL), arg_min(ln, rn) FILTER (WHERE ln IS NOT NULL), '第 ' || chapter_no || ' 段重點') AS title, arg_min(start_page, rn) AS first_page, arg_max(end_page, rn) AS last_page FROM ob GROUP BY 1, 2),
    op AS (SELECT src_id, chapter_no, rn, i, substring(pts[i], 1, 80) AS point FROM ob, unnest(range(1, len(pts) + 1)) u(i) QUALIFY row_number() OVER (PARTITION BY src_id, chapter_no ORDER BY rn, i) <= 3),
    ol AS (SELECT oh.*, coalesce(ps, '') AS points, coalesce(np, 0) AS np FROM oh LEFT JOIN (SELECT src_id, chapter_no, string_agg(point, chr(10) ORDER BY rn, i) AS ps, count(*) AS np FROM op GROUP BY 1, 2) q USING (src_id, chapter_no))"""


@query(OUTLINE_SQL + " SELECT src_id, chapter_no, title, first_page, last_page, points FROM ol")
def outline(spark, d):
    return storyboard.outline(table(spark, d, "pdf_chunks"), 6.0).withColumn("points", F.array_join("points", "\n"))


KINDS = ["deadline_timeline", "penalty_table", "checklist", "risk_warning", "do_dont", "key_number"]


@query(ITEMS_SQL + ", " + OUTLINE_SQL.removeprefix("WITH ") + f""", sb AS (SELECT DISTINCT src_id, 0 AS part, 0 AS chapter_no, 0 AS kind_no, 'cover' AS scene_kind, 0::BIGINT AS items FROM ol UNION ALL SELECT src_id, 1, chapter_no, 0, 'section_intro', np FROM ol
    UNION ALL SELECT src_id, 2, 0, list_position([{_LABELS(KINDS)}], scene_kind)::INTEGER, scene_kind, count(*) FROM it GROUP BY src_id, scene_kind UNION ALL SELECT DISTINCT src_id, 3, 0, 0, 'recap_card', 0 FROM ol) SELECT src_id, part, chapter_no, kind_no, scene_kind, items::BIGINT AS items FROM sb""")
def storyboard_scenes(spark, d):
    return storyboard.storyboard(storyboard.outline(table(spark, d, "pdf_chunks"), 6.0), _items(spark, d), "src_id", KINDS)


_TOPIC = f"SELECT src_id, page, row_number() OVER (PARTITION BY src_id ORDER BY page, salience_milli DESC, image_id) AS rank, substring(coalesce(nullif(caption, ''), visual_role), 1, 18) AS topic FROM (SELECT *, floor(score * 1000 + 0.5)::BIGINT AS salience_milli FROM u WHERE likely_useful)"


def _topics(spark, d):
    """Useful figures of each source in the order of their pages, numbered block by block, with a topic."""
    inv = figures.inventory(table(spark, d, "pdf_images"), table(spark, d, "pdf_pages")).filter("likely_useful")
    topic = F.substring(F.coalesce(F.when(F.length("caption") > 0, F.col("caption")), F.col("visual_role")), 1, 18)
    rows = inv.select("src_id", "page", "image_id", (-F.col("salience_milli")).alias("_less"), topic.alias("topic"))
    return sequence.numbered(rows, "src_id", ["page", "_less", "image_id"], "rank", block=16)


@query(INVENTORY_SQL + f", tc AS ({_TOPIC}), tf AS (SELECT *, rank = min(rank) OVER (PARTITION BY src_id, topic) AS first FROM tc), tk AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY rank) AS place FROM tf WHERE rank <= 3 OR first) SELECT DISTINCT src_id, page FROM tk WHERE place <= 6")
def topic_anchors(spark, d):
    return storyboard.topic_anchors(_topics(spark, d), 6)


@query("WITH t AS (SELECT src_id, page_id, page_id AS seq, trim(list_extract(string_split(h, '·'), -1)) AS b FROM (SELECT src_id, page_id, headings[1] AS h FROM pdf_pages WHERE len(headings) > 0) WHERE length(trim(list_extract(string_split(h, '·'), -1))) > 0), g AS (SELECT src_id, b, min(seq) AS seq, arg_min(page_id, seq) AS page_id FROM t GROUP BY 1, 2) SELECT src_id, ordinal::INTEGER AS ordinal, substring(b, 1, 24) AS text, page_id FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY seq) AS ordinal FROM g) WHERE ordinal <= 5")
def recap_items(spark, d):
    p = table(spark, d, "pdf_pages").filter(F.size("headings") > 0)
    scenes = p.select("src_id", "page_id", F.col("page_id").alias("seq"), F.get("headings", F.lit(0)).alias("title"), F.lit("section").alias("scene_kind"))
    return storyboard.recap_items(scenes, "src_id", ["cover", "recap_card"])


@query("SELECT src_id, page_id FROM (SELECT src_id, page_id, row_number() OVER (PARTITION BY src_id ORDER BY page_id) - 1 AS no FROM pdf_pages) WHERE no > 0 AND no % 8 = 0")
def recap_places(spark, d):
    return storyboard.every_kth(table(spark, d, "pdf_pages").select("src_id", "page_id"), "src_id", "page_id")


@query(f"""WITH i AS (SELECT src_id, image_id AS id, page, coalesce(caption_hint, '') AS blob, row_number() OVER (PARTITION BY src_id ORDER BY page, image_id) AS idx FROM pdf_images),
    n AS (SELECT a.src_id, a.idx, a.id AS left_id, b.id AS right_id FROM i a JOIN i b ON b.src_id = a.src_id AND b.idx = a.idx + 1 WHERE b.page - a.page <= 2 AND regexp_matches(a.blob || ' ' || b.blob, {_W([*storyboard.CONTRAST, '與', 'and'])})),
    r AS (SELECT *, idx - row_number() OVER (PARTITION BY src_id ORDER BY idx) AS run FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY src_id, run ORDER BY idx) AS k FROM r) SELECT src_id, left_id, right_id FROM p WHERE k % 2 = 1""")
def comparison_pairs(spark, d):
    """Neighbouring images whose captions name two things."""
    images = table(spark, d, "pdf_images").select("src_id", F.col("image_id").alias("id"), "page", F.coalesce("caption_hint", F.lit("")).alias("blob"))
    placed = sequence.numbered(images, "src_id", ["page", "id"], "idx", block=16)
    return storyboard.comparison_pairs(placed, "src_id", [*storyboard.CONTRAST, "與", "and"])
