"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, collocations, decontaminate, exact_dedup, fuzzy_lines, hard_negatives, kd_shards, ngram_join, poisson_mix, quality, secret_scan, topk, url_filter

QUERIES = {
    "op1_fuzzy_lines": fuzzy_lines.query,
    "op2_url_filter": url_filter.query,
    "op3_kd_shards": kd_shards.query,
    "op4_byte_bpe": bpe.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_top_k": topk.query,
    "op7_secret_scan": secret_scan.query,
    "op8_quality": quality.query,
    "op9_poisson_mix": poisson_mix.query,
    "op10_ngram_join": ngram_join.query,
    "op11_decontaminate": decontaminate.query,
    "op12_collocations": collocations.query,
    "op13_hard_negatives": hard_negatives.query,
}
SQL = {"op5_exact_dedup": exact_dedup.SQL, "op6_top_k": topk.SQL, "op9_poisson_mix": poisson_mix.SQL, "op11_decontaminate": decontaminate.SQL, "op12_collocations": collocations.SQL, "op13_hard_negatives": hard_negatives.SQL}
