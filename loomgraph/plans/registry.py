"""All queries over the reference's own operators, by their inventory ids."""

from __future__ import annotations

from loomgraph.plans import file_queries, graph_queries, image_queries, pairs, text_queries  # noqa: F401
from loomgraph.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
