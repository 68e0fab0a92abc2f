"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as pipeline

from .jaccard_join import op9_chosen_path_join
from .licenses import OP8_SQL, op8_license_scan
from .lm_scores import op6_cross_entropy
from .matroska import op4_matroska
from .mixing import OP2_SQL, op2_mix_schedule
from .packing import op3_pack_dominance
from .quality import op1_divergence
from .token_counts import op10_token_counts
from .token_files import op5_token_files
from .toxicity import op7_toxicity

QUERIES = {
    "pipeline": pipeline,
    "op1_divergence": op1_divergence,
    "op2_mix_schedule": op2_mix_schedule,
    "op3_pack_dominance": op3_pack_dominance,
    "op4_matroska": op4_matroska,
    "op5_token_files": op5_token_files,
    "op6_cross_entropy": op6_cross_entropy,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_chosen_path_join": op9_chosen_path_join,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op2_mix_schedule": OP2_SQL,
    "op8_license_scan": OP8_SQL,
    **({"pipeline": PIPELINE_SQL} if PIPELINE_SQL else {}),
}
