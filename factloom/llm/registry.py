"""The queries of the training-data operators."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_phrase_collocations
from .decontaminate import op8_template_decontamination
from .embedding_dedup import op2_embedding_dedup
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_extract import op1_html_extraction
from .language_id import op12_language_id
from .packing import op10_best_fit_packing
from .pii import op7_pii
from .quality import op5_quality_classifier
from .sentence_dedup import op9_sentence_span_dedup
from .sharding import op6_jump_hash_sharding
from .simhash_dedup import op3_simhash_dedup
from .url_filter import OP4_SQL, op4_url_filter

QUERIES = {
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op1_html_extraction": op1_html_extraction,
    "op4_url_filter": op4_url_filter,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_jump_hash_sharding": op6_jump_hash_sharding,
    "op7_pii": op7_pii,
    "op8_template_decontamination": op8_template_decontamination,
    "op9_sentence_span_dedup": op9_sentence_span_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_language_id": op12_language_id,
    "op13_hard_negatives": op13_hard_negatives,
}
#: DuckDB SQL; the other operators are beyond SQL and held against brute force in the tests.
ORACLES = {"op4_url_filter": OP4_SQL, "op11_phrase_collocations": OP11_SQL, "op13_hard_negatives": OP13_SQL}
