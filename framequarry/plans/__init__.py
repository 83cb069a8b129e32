"""The registered queries: importing this package fills the registry."""

from framequarry.plans import compare, decode, folds, formats, learn, models, profile, protocols, store, streams  # noqa: F401
from framequarry.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
