"""The queries of this subpackage and the SQL that reproduces them."""

from __future__ import annotations

import importlib

from sentrella.llm.bpe import op4_bpe
from sentrella.llm.conversations import OP11_SQL, op11_conversation_repair
from sentrella.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from sentrella.llm.language_model import op5_language_model
from sentrella.llm.line_dedup import OP7_SQL, op7_line_dedup
from sentrella.llm.mixing import OP9_SQL, op9_mixing
from sentrella.llm.nearest import op8_nearest
from sentrella.llm.negatives import OP12_SQL, op12_hard_negatives
from sentrella.llm.packing import op13_packing
from sentrella.llm.quality import op10_quality
from sentrella.llm.simhash import op3_simhash
from sentrella.llm.token_files import op2_token_files
from sentrella.llm.toxicity import op1_toxicity


def queries() -> dict:
    own = (op1_toxicity, op2_token_files, op3_simhash, op4_bpe, op5_language_model, op6_exact_dedup, op7_line_dedup, op8_nearest, op9_mixing, op10_quality, op11_conversation_repair, op12_hard_negatives, op13_packing)
    return {f.__name__: f for f in own} | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL, "op9_mixing": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_hard_negatives": OP12_SQL}
