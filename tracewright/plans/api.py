"""The service's requests as plain calls."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import drawing, model_graph, program, solver, traverse
from ..operators.flow_graph import FlowGraph
from ..operators.reach import Timelines
from ..sources.documents import Tables
from ..sources.store import to_json


class Engine:
    """Graphs over one provenance store. generate rebuilds; otherwise the last result is returned,
    or None before the first build. A flow graph, its solution and its index of timelines may be given
    where they are built already. Errors are exceptions."""

    def __init__(self, tables: Tables, position: str = "exact", max_vars: int = 4000, flow: FlowGraph | None = None, chosen: DataFrame | None = None, timelines: Timelines | None = None) -> None:
        self.tables, self.position, self.max_vars = tables, position, max_vars
        self._flow, self._chosen, self._timelines = flow, chosen, timelines
        self._model_graph = self._path = None

    def model_graph(self, generate: bool = False) -> DataFrame | None:
        """(name, periods)"""
        if generate:
            self._model_graph = model_graph.graph(self.tables)
        return self._model_graph

    def model_graph_response(self) -> DataFrame:
        """(json): ``response`` of the model graph built anew, put together as text: a result of very
        many connectors never stands in memory as records."""
        return model_graph.graph_json(self.tables)

    def flow_graph(self, generate: bool = False) -> FlowGraph:
        if generate or self._flow is None:
            self._flow, self._chosen, self._path, self._timelines = FlowGraph(self.tables), None, None, None
        return self._flow

    def chosen(self) -> DataFrame:
        """(var_ord, total): the program's solution."""
        if self._chosen is None:
            self._chosen = solver.solve(self.flow_graph().rows, self.position, self.max_vars)
        return self._chosen

    def optimal_path(self, generate: bool = False) -> DataFrame | None:
        """(edge_ord, pos, dsir_id)"""
        if generate:
            self.flow_graph(generate=True)
        if generate or (self._path is None and self._chosen is not None):
            self._path = model_graph.optimal_path(self.tables, program.variables(self._flow.rows), self.chosen())
        return self._path

    def timeline(self, node_id: str, as_shipped: bool = False) -> DataFrame:
        """(node_id): the model nodes before and after a model node, looked up in an index that the
        first request builds; as_shipped walks."""
        if not as_shipped:
            if self._timelines is None:
                self._timelines = Timelines(self.flow_graph().rows)
            return self._timelines.model_timeline(node_id)
        return traverse.model_timeline(self.flow_graph().rows, node_id, as_shipped=as_shipped)

    def drawing(self, optimal: bool = False) -> DataFrame:
        return drawing.edge_list(self.flow_graph().rows, self.chosen() if optimal else None)

    def response(self, df: DataFrame) -> DataFrame:
        """(json): a result as the service writes it."""
        return to_json(df)
