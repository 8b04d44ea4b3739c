"""Queries and SQL of the text operators."""

from tillroll.llm.op01_suffix_dedup import op1_suffix_dedup
from tillroll.llm.op02_line_dedup import OP2_SQL, op2_line_dedup
from tillroll.llm.op03_packing import op3_packing
from tillroll.llm.op04_decontamination import op4_decontamination
from tillroll.llm.op05_secrets import op5_secrets
from tillroll.llm.op06_quality import op6_quality
from tillroll.llm.op07_toxicity import op7_toxicity
from tillroll.llm.op08_embeddings import OP8_SQL, op8_embeddings
from tillroll.llm.op09_language import op9_language
from tillroll.llm.op10_ngram_join import OP10_SQL, op10_ngram_join
from tillroll.llm.op11_divergence import OP11_SQL, op11_divergence
from tillroll.llm.op12_byte_bpe import op12_byte_bpe
from tillroll.llm.op13_hard_negatives import OP13_SQL, op13_hard_negatives

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_line_dedup, op3_packing, op4_decontamination, op5_secrets, op6_quality, op7_toxicity, op8_embeddings, op9_language, op10_ngram_join, op11_divergence, op12_byte_bpe, op13_hard_negatives)}
ORACLES = {"op2_line_dedup": OP2_SQL, "op8_embeddings": OP8_SQL, "op10_ngram_join": OP10_SQL, "op11_divergence": OP11_SQL, "op13_hard_negatives": OP13_SQL}
