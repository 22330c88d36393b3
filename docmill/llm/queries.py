"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from docmill.llm import decontamination, language_id, lexical_search, licenses, lm_scoring, mixing, pii, pipeline, resharding, secret_scan, simhash, spelling, toxicity, vector_search

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_language_id": language_id.op2_language_id,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_nearest": vector_search.op8_nearest,
    "op9_simhash": simhash.op9_simhash,
    "op10_personal_data": pii.op10_personal_data,
    "op11_ranked_search": lexical_search.op11_ranked_search,
    "op12_resharding": resharding.op12_resharding,
    "op13_spelling": spelling.op13_spelling,
    "pipeline": pipeline.run,
}
ORACLES = {
    "op1_lm_scoring": lm_scoring.LM_SQL,
    "op4_mix_sources": mixing.MIX_SQL.format(rows="documents"),
    "op5_license_scan": licenses.LICENSE_SQL,
    "op8_nearest": vector_search.NEAREST_SQL,
    "op11_ranked_search": lexical_search.RANKED_SQL,
    "op12_resharding": resharding.op12_resharding,
    "op13_spelling": spelling.SPELLING_SQL,
}
