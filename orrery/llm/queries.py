"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from .bpe import op10_byte_bpe
from .chat import OP1_SQL, op1_chat_snapshot_collapse
from .decontamination import op7_spaced_seed_decontamination
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .html_extract import op6_template_extraction
from .near_dedup import op9_bottom_k_near_dedup
from .pii import op2_pii_surrogates
from .quality import op4_quality_discriminant
from .sharding import op3_jump_sharding
from .suffix_dedup import op8_bwt_repeats

QUERIES = {
    "op1_chat_snapshot_collapse": op1_chat_snapshot_collapse,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_jump_sharding": op3_jump_sharding,
    "op4_quality_discriminant": op4_quality_discriminant,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_template_extraction": op6_template_extraction,
    "op7_spaced_seed_decontamination": op7_spaced_seed_decontamination,
    "op8_bwt_repeats": op8_bwt_repeats,
    "op9_bottom_k_near_dedup": op9_bottom_k_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {"op1_chat_snapshot_collapse": OP1_SQL, "op5_exact_dedup": OP5_SQL}
