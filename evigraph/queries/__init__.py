"""All registered queries and their SQL."""
from . import composed, graph, more, search, text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (graph, text, search, more, composed):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
