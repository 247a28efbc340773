"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .decontamination import OP13_SQL, op13_prefix_filtered_decontamination
from .fingerprints import op10_order_minhash_fingerprints
from .lm import op8_elias_fano_lm_scores
from .near import OP5_SQL, op5_minhash_near_duplicates
from .packing import op7_linear_grouping_packs
from .quality import OP2_BASE_SQL, quality_base_columns, op2_importance_quality
from .ranking import OP11_SQL, op11_impact_ranked_search
from .sampling import op9_gumbel_segmentations
from .sharding import op1_hypergeometric_shards
from .substrings import OP4_SQL, op4_repeated_substrings
from .tokens import OP6_BYTES_SQL, token_byte_counts, op6_prefix_token_counts
from .toxicity import op3_subsequence_kernel_toxicity
from .whitening import OP12_BASE_SQL, embedding_deviations, op12_gramian_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_hypergeometric_shards,
        op2_importance_quality,
        op3_subsequence_kernel_toxicity,
        op4_repeated_substrings,
        op5_minhash_near_duplicates,
        op6_prefix_token_counts,
        op7_linear_grouping_packs,
        op8_elias_fano_lm_scores,
        op9_gumbel_segmentations,
        op10_order_minhash_fingerprints,
        op11_impact_ranked_search,
        op12_gramian_whitening,
        op13_prefix_filtered_decontamination,
        # what SQL can state of three of them
        quality_base_columns,
        token_byte_counts,
        embedding_deviations,
    )
}

ORACLES = {
    "op4_repeated_substrings": OP4_SQL,
    "op5_minhash_near_duplicates": OP5_SQL,
    "op11_impact_ranked_search": OP11_SQL,
    "op13_prefix_filtered_decontamination": OP13_SQL,
    "quality_base_columns": OP2_BASE_SQL,
    "token_byte_counts": OP6_BYTES_SQL,
    "embedding_deviations": OP12_BASE_SQL,
}
