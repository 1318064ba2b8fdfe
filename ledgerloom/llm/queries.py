"""Registered queries of the training-data operators and the SQL that some of them are checked against."""

from __future__ import annotations

from .decontaminate import OP2_SQL, op2_decontaminate
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .mixing import OP10_SQL, op10_mixing
from .jaccard_join import op1_jaccard_join
from .language_id import op8_language_id
from .period_runs import op13_period_runs
from .pii import op9_pii
from .quality import op4_quality
from .spelling import OP11_SQL, op11_spelling_variants
from .suffix_dedup import op5_suffix_dedup
from .token_output import op7_token_output
from .url_filter import OP3_SQL, op3_url_filter
from .vector_search import op12_nearest_vectors

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_output": op7_token_output,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_nearest_vectors": op12_nearest_vectors,
    "op13_period_runs": op13_period_runs,
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_mixing": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
}
