"""Connected components of an undirected graph, staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.components import components as settle
from .common import stage_table


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (u long, v long); label: the component's least node.

    Every table of a round is written, which cuts the lineage.
    """
    return settle(edges, lambda df: stage_table(df, "components"))
