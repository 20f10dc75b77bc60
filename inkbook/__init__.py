"""inkbook: order-book analytics for print jobs, expressed as lazy Spark DataFrames.

Every mart takes the derived jobs frame and optional extra grouping keys
``by`` (for example ``("report_id",)``), so one Spark job analyses many
reports or tenants at once.
"""

from inkbook.config import Config

__all__ = ["Config"]
