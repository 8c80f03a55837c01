"""All queries of the engine and, where SQL can state them, the same in SQL."""

from . import eval_queries, model_queries, record_queries, stream_queries, text_queries  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
