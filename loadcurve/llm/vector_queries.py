"""Query of the vector search. A graph may miss neighbours, so no SQL gives its rows; tests measure recall against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcurve.llm import vector_search
from loadcurve.llm.registry import query, table


@query("op13_graph_search")
def _(spark, sf_dir):
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
