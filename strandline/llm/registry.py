"""Every query of this package with its SQL, where SQL can express it."""

from __future__ import annotations

from .op01_lm import op1_lm_score
from .op02_secrets import OP2_SQL, op2_secrets
from .op03_quality import op3_quality
from .op04_chat import OP4_SQL, op4_chat
from .op05_warc import OP5_SQL, op5_warc
from .op06_decontaminate import OP6_SQL, op6_decontaminate
from .op07_vectors import OP7_SQL, op7_near_vectors
from .op08_jaccard import op8_jaccard_join
from .op09_toxicity import op9_toxicity
from .op10_bpe import op10_bpe

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_near_vectors": op7_near_vectors,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
}
SQL = {
    "op2_secrets": OP2_SQL,
    "op4_chat": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op6_decontaminate": OP6_SQL,
    "op7_near_vectors": OP7_SQL,
}
