"""Queries of the subpackage llm and their DuckDB SQL."""

from leafmill.llm import encoding, lookalike, mixing, noise, residue, sentences, split, subject, tokens
from leafmill.sources.tables import table


def p1_found(spark, d):
    pages = table(spark, d, "pdf_pages")
    sample = sentences.items(table(spark, d, "sentence_sample"), pages, table(spark, d, "pdf_chunks"))
    return sentences.units(sample, sentences.learn(pages)).select("item_kind", "item_id", "end_char")


def p1_units(spark, d):
    pages = table(spark, d, "pdf_pages")
    return sentences.units(pages, sentences.learn(pages), key="page_id", extra=()).select("page_id", "unit_no", "end_char", "unit")


def p2_found(spark, d):
    return split.oversized(table(spark, d, "pdf_chunks"), table(spark, d, "split_specs"))


def p2_pieces(spark, d):
    return split.split_pieces(table(spark, d, "pdf_chunks"), table(spark, d, "split_specs"), table(spark, d, "pdf_pages"))


def p3_profiles(spark, d):
    names = ("pdf_sources", "pdf_pages", "pdf_chunks", "subject_labels", "subject_areas")
    return subject.subject_profiles(*(table(spark, d, n) for n in names))


def p3_found(spark, d):
    return subject.subjects(p3_profiles(spark, d))


def p4_found(spark, d):
    return noise.noisy_lines(table(spark, d, "pdf_pages"))


def p4_repaired(spark, d):
    return noise.repaired_pages(table(spark, d, "pdf_pages"))


def p5_found(spark, d):
    return lookalike.identical_pairs(table(spark, d, "pdf_pages"))


def p5_normalised(spark, d):
    return lookalike.normalised(table(spark, d, "pdf_pages").select("page_id", "text", "headings"), "text", "headings").drop("text", "headings")


def p5_classes(spark, d):
    return lookalike.look_classes(table(spark, d, "pdf_pages"))


def p6_found(spark, d):
    return encoding.garbled_ids(table(spark, d, "pdf_pages"))


def p6_restored(spark, d):
    return encoding.repaired(table(spark, d, "pdf_pages"))


def p7_ids(spark, d):
    return tokens.token_ids(table(spark, d, "documents"))


def p8_mix(spark, d):
    targets = table(spark, d, "mix_targets")
    return mixing.mix(mixing.sized(table(spark, d, "documents"), targets), targets)


def p8_report(spark, d):
    targets = table(spark, d, "mix_targets")
    sizes = mixing.sized(table(spark, d, "documents"), targets)
    return mixing.report(sizes, targets, mixing.mix(sizes, targets))


def p9_found(spark, d):
    return residue.residue_ids(table(spark, d, "documents"))


def p9_clean(spark, d):
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "source", "text")


QUERIES = {"p1_found": p1_found, "p1_units": p1_units, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_profiles": p3_profiles, "p4_found": p4_found, "p4_repaired": p4_repaired, "p5_found": p5_found, "p5_normalised": p5_normalised, "p5_classes": p5_classes, "p6_found": p6_found, "p6_restored": p6_restored, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_clean": p9_clean}

ORACLES = {
    "p2_found": r"""
        SELECT c.chunk_key, CASE WHEN list_max(list_transform(regexp_split_to_array(c.text, '[\s\p{Z}\x0b\x85\p{P}]+'), lambda x: length(x))) > s.max_chars
                            THEN 'forced' ELSE 'plain' END AS case_kind
        FROM pdf_chunks c JOIN split_specs s ON s.spec_id = coalesce(c.spec_id, 1)
        WHERE length(c.text) > s.max_chars""",
}
