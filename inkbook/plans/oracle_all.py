"""Import every oracle family so ORACLE is complete."""
from inkbook.plans import oracle_cadence, oracle_misc, oracle_ops, oracle_quote, oracle_season, oracle_text, oracle_value  # noqa: F401
from inkbook.plans import oracle_findings  # noqa: F401,E402
from inkbook.plans.oracle import ORACLE

__all__ = ["ORACLE"]
