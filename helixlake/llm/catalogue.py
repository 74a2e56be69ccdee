"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from .bpe import op9_bpe_prefix_dp
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .language_id import op1_language_id
from .merkle import OP11_SQL, op11_merkle_manifest
from .near_dedup import op5_minhash_near_dedup
from .packing import op4_vector_packing
from .quality import op3_quality_pu
from .ranked_search import OP13_SQL, op13_ranked_search
from .secrets import op8_secret_scan
from .suffix_dedup import op7_suffix_dedup
from .syncmers import op2_closed_syncmers
from .toxicity import op6_toxicity_ftrl
from .warc import OP12_SQL, op12_warc


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_closed_syncmers": op2_closed_syncmers,
        "op3_quality_pu": op3_quality_pu,
        "op4_vector_packing": op4_vector_packing,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_toxicity_ftrl": op6_toxicity_ftrl,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_secret_scan": op8_secret_scan,
        "op9_bpe_prefix_dp": op9_bpe_prefix_dp,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_warc": op12_warc,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict:
    return {"op10_exact_dedup": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_warc": OP12_SQL, "op13_ranked_search": OP13_SQL}
