"""Queries of the llm operators and their DuckDB twins."""

from tessera.llm import centroids, decontaminate, katz, langid, media, mixing, neighbours, pii, resampling, sharding, simhash, token_counts, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_pii": pii.op4_pii,
    "op5_katz": katz.op5_katz,
    "op6_warc": warc.op6_warc,
    "op7_language_id": langid.op7_language_id,
    "op8_shards": sharding.op8_shards,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_media": media.op11_media,
    "op12_resampling": resampling.op12_resampling,
    "op13_exponion": centroids.op13_exponion,
}

ORACLES: dict[str, str] = {"op2_mixing": mixing.oracle(), "op6_warc": warc.ORACLE, "op10_decontaminate": decontaminate.oracle(), "op11_media": media.oracle(), "op12_resampling": resampling.oracle(), "op13_exponion": centroids.oracle()}
