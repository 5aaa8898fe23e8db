"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from plumbline.llm import (
    curve_search, dom_tree, mix_cube, ngram_matrix, quality_subword, secret_forest, template_decon, token_planes, url_reputation, warc_revisit,
)


def queries() -> dict:
    return {
        "op1_dom_tree": dom_tree.query,
        "op2_warc_revisit": warc_revisit.query,
        "op3_url_reputation": url_reputation.query,
        "op4_mix_cube": mix_cube.query,
        "op5_token_planes": token_planes.query,
        "op6_curve_search": curve_search.query,
        "op7_secret_forest": secret_forest.query,
        "op8_quality_subword": quality_subword.query,
        "op9_template_decon": template_decon.query,
        "op10_ngram_matrix": ngram_matrix.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisit": warc_revisit.oracle_sql(), "op3_url_reputation": url_reputation.oracle_sql(), "op9_template_decon": template_decon.oracle_sql()}
