"""The queries of the text operators and their SQL."""

from __future__ import annotations

from veritab.llm import collocations, decontaminate, lines, mixing, quality, repeats, secrets, sharding, simhash, tokens, toxicity, urls, whitening

QUERIES = {
    "op1_histogram_shards": sharding.op1_histogram_shards,
    "op2_markov_secrets": secrets.op2_markov_secrets,
    "op3_simhash_leaks": decontaminate.op3_simhash_leaks,
    "op4_vantage_simhash": simhash.op4_vantage_simhash,
    "op5_noisy_channel": toxicity.op5_noisy_channel,
    "op6_water_fill": mixing.op6_water_fill,
    "op7_line_chunks": lines.op7_line_chunks,
    "op8_risk_controlled": quality.op8_risk_controlled,
    "op9_url_filter": urls.op9_url_filter,
    "op10_bucket_pointers": repeats.op10_bucket_pointers,
    "op11_pair_collocations": collocations.op11_pair_collocations,
    "op12_welford_whitening": whitening.op12_welford_whitening,
    "op13_overlap_tokens": tokens.op13_overlap_tokens,
}
SQL = {
    "op3_simhash_leaks": decontaminate.OP3_SQL,
    "op6_water_fill": mixing.OP6_SQL,
    "op8_risk_controlled": quality.OP8_SQL,
    "op9_url_filter": urls.OP9_SQL,
    "op10_bucket_pointers": repeats.OP10_SQL,
    "op11_pair_collocations": collocations.OP11_SQL,
}
