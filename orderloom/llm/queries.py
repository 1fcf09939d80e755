"""The queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from . import decontam, exact_dedup, filter_audit, fim, html_extract, katz, line_dedup, mixing, quality, simhash, substring_dedup, url_filter, warc


def queries() -> dict:
    return {
        "op1_katz": katz.op1_katz,
        "op2_simhash": simhash.op2_simhash,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_mix": mixing.op6_mix,
        "op7_html_text": html_extract.op7_html_text,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_quality": quality.op9_quality,
        "op10_warc": warc.op10_warc,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_substring_dedup": substring_dedup.op12_substring_dedup,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.SQL, "op8_line_dedup": line_dedup.SQL, "op10_warc": warc.SQL, "op11_fill_in_middle": fim.SQL, "op12_substring_dedup": substring_dedup.SQL, "op13_filter_audit": filter_audit.SQL}
