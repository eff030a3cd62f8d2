"""Named queries over the driver tables, each with equivalent SQL where SQL can state it."""

from tabsieve.queries import (attacks, clusters, comparison, metrics, neighbourhoods, sources, summaries,  # noqa: F401
                              transforms)
from tabsieve.queries.registry import QUERIES, SQL  # noqa: F401
