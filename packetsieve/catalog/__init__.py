from .oracle import ORACLES
from .queries import QUERIES, WITHOUT_SQL

__all__ = ["ORACLES", "QUERIES", "WITHOUT_SQL"]
