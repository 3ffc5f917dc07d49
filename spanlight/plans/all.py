"""All queries of the library's own operators."""

from spanlight.plans import ablation, evidence, functions, graph, metrics, models, packages, sources, splits, windows  # noqa: F401
from spanlight.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
