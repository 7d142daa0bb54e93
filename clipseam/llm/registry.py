"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op2_bpe_codec
from .embeddings import OP3_SQL, op3_embedding_near_dedup
from .importance import OP12_SQL, op12_importance_resampling
from .licenses import OP13_SQL, op13_license_scan
from .mixing import OP1_SQL, op1_mix_sources
from .ppm import op4_ppm_scores
from .quality import op10_quality
from .runs import op11_periodic_runs
from .secrets import op7_secret_scan
from .simhash import op9_simhash
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op5_token_counts
from .toxicity import op8_toxicity

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_ppm_scores": op4_ppm_scores,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_license_scan": op13_license_scan,
}
SQL = {"op1_mix_sources": OP1_SQL, "op3_embedding_near_dedup": OP3_SQL, "op12_importance_resampling": OP12_SQL, "op13_license_scan": OP13_SQL}
