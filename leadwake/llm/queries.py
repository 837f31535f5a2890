"""The registered queries of this subpackage and the SQL that must agree with them, where SQL can say it."""

import corpus_pipeline
from leadwake.llm import conversations, decontaminate, jaccard_join, ledger, metric_join, mixing, ordinal, pieces, pii, suffix_dedup, toxicity, variants, warc

QUERIES = {
    "op1_piece_encoding": pieces.op1, "op2_ordinal_quality": ordinal.op2, "op3_source_mixing": mixing.op3,
    "op4_rule_ledger": ledger.op4, "op5_toxicity": toxicity.op5, "op6_suffix_dedup": suffix_dedup.op6,
    "op7_warc": warc.op7, "op8_jaccard_join": jaccard_join.op8,
    "op9_metric_join": metric_join.op9, "op10_personal_data": pii.op10, "op11_spelling_variants": variants.op11, "op12_decontamination": decontaminate.op12, "op13_conversation_repair": conversations.op13,
    "pipeline": corpus_pipeline.run}
ORACLES = {"op3_source_mixing": mixing.SQL, "op4_rule_ledger": ledger.SQL, "op7_warc": warc.SQL, "op9_metric_join": metric_join.SQL,
           "op12_decontamination": decontaminate.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
