"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, divergence, negatives
from .bpe import op9_byte_bpe
from .chat import op13_chat_trees
from .decontam import op2_decontamination
from .divergence import op12_source_divergence
from .html_main import op7_html_main
from .mixing import op3_context_mixing
from .negatives import op11_hard_negatives
from .pii import op8_pii
from .secrets import op6_secrets
from .simhash import op10_simhash
from .sketch import op4_scaled_sketch
from .suffix import op5_suffix_dedup
from .toxicity import op1_toxicity

OPERATORS = (
    op1_toxicity, op2_decontamination, op3_context_mixing, op4_scaled_sketch, op5_suffix_dedup,
    op6_secrets, op7_html_main, op8_pii, op9_byte_bpe, op10_simhash,
    op11_hard_negatives, op12_source_divergence, op13_chat_trees,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLES: dict[str, str] = {"op11_hard_negatives": negatives.SQL, "op12_source_divergence": divergence.SQL, "op13_chat_trees": chat.SQL}
