"""Every query of the engine by name, and the SQL that checks it."""

from . import extended, live, recordings, significance, telephony  # noqa: F401  (they add their queries)
from .catalogue import QUERIES, SQL

FLAGSHIP = "sprt_verdicts"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
