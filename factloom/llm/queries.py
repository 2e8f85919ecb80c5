"""The queries of this subpackage by name, and SQL for DuckDB where SQL can express one."""

from __future__ import annotations

from . import audit, exact, importance, neardup_vectors, warc
from .audit import op12_filter_audit
from .cotraining import op3_quality_classifier
from .exact import op13_exact_dedup
from .importance import op11_importance_resampling
from .jaccard import op5_jaccard_join
from .langid import op4_language_id
from .mixing import op1_source_mix
from .neardup_vectors import op7_near_vectors
from .packing import op2_best_fit_packing
from .quality import op10_quality_rules
from .sharding import op8_uniform_shards
from .substrings import op6_substring_dedup
from .warc import op9_warc_round_trip

QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_best_fit_packing, op3_quality_classifier, op4_language_id, op5_jaccard_join, op6_substring_dedup,
        op7_near_vectors, op8_uniform_shards, op9_warc_round_trip, op10_quality_rules, op11_importance_resampling,
        op12_filter_audit, op13_exact_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op7_near_vectors": neardup_vectors.ORACLE, "op9_warc_round_trip": warc.ORACLE, "op11_importance_resampling": importance.ORACLE,
    "op12_filter_audit": audit.ORACLE, "op13_exact_dedup": exact.ORACLE,
}
