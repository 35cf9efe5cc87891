"""The thin queries, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from veilspark.llm.ann import op9_ann
from veilspark.llm.bpe import op4_bpe
from veilspark.llm.brown_lm import op7_brown_lm
from veilspark.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from veilspark.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from veilspark.llm.html_extract import op1_html
from veilspark.llm.line_dedup import OP2_SQL, op2_line_dedup
from veilspark.llm.merkle import OP13_SQL, op13_merkle_manifest
from veilspark.llm.mixing import op10_mixing
from veilspark.llm.near_dedup import op5_near_dedup
from veilspark.llm.quality import op8_quality
from veilspark.llm.quality_rules import OP11_SQL, op11_quality_rules
from veilspark.llm.toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_html, op2_line_dedup, op3_toxicity, op4_bpe, op5_near_dedup, op6_exact_dedup, op7_brown_lm, op8_quality, op9_ann, op10_mixing, op11_quality_rules, op12_hard_negatives, op13_merkle_manifest)}
ORACLES = {"op2_line_dedup": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op11_quality_rules": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
