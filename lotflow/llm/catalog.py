"""Every query of this subpackage."""

from lotflow.llm import (  # noqa: F401
    query_bpe,
    query_chat,
    query_exact,
    query_mix,
    query_near_dup,
    query_pii,
    query_quality,
    query_records,
    query_runs,
    query_vectors,
    query_web,
)
from lotflow.llm.registry import ORACLES, QUERIES  # noqa: F401
