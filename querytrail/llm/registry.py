"""The queries of this package and their SQL."""

from __future__ import annotations

from .attention import op13_attention_quality
from .decontamination import op1_latent_decontamination
from .jaccard import op6_bayes_jaccard_join
from .language import op3_segmentation_language
from .merkle import op11_merkle_climb
from .mixing import op4_raking_mixture
from .pii import op9_semicrf_pii
from .quality import op7_line_first_quality
from .ranking import op12_nra_search
from .redirects import op8_redirect_equivalence
from .secrets import op2_randomness_secrets
from .sharding import op5_prefix_sum_shards
from .statements import STATEMENTS
from .warc import op10_seekable_warc

QUERIES = {
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_randomness_secrets": op2_randomness_secrets,
    "op4_raking_mixture": op4_raking_mixture,
    "op5_prefix_sum_shards": op5_prefix_sum_shards,
    "op3_segmentation_language": op3_segmentation_language,
    "op6_bayes_jaccard_join": op6_bayes_jaccard_join,
    "op7_line_first_quality": op7_line_first_quality,
    "op8_redirect_equivalence": op8_redirect_equivalence,
    "op9_semicrf_pii": op9_semicrf_pii,
    "op10_seekable_warc": op10_seekable_warc,
    "op11_merkle_climb": op11_merkle_climb,
    "op12_nra_search": op12_nra_search,
    "op13_attention_quality": op13_attention_quality,
}

ORACLES = dict(STATEMENTS)
