"""Import every catalogue module, so their queries register."""

from segue.catalog import gridding, matching, measuring, merging, publishing, reporting, scalars, slotting, sourcing  # noqa: F401
from segue.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
