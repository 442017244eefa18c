"""Run read statements against a view; parsed statements are kept."""

from __future__ import annotations

import copy
from collections import OrderedDict
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from ..errors import PlanError
from ..model import GraphView
from .compile import Diagnostic, Planner, Rows
from .syntax import Statement, parse


class PlanCache:
    """Syntax trees by text, the most recent ``size`` of them."""

    def __init__(self, size: int = 64) -> None:
        self.size, self.kept, self.hits = size, OrderedDict(), 0

    def get(self, text: str) -> Statement:
        if text in self.kept:
            self.hits += 1
            self.kept.move_to_end(text)
        else:
            self.kept[text] = parse(text)
            while len(self.kept) > self.size:
                self.kept.popitem(last=False)
        return copy.deepcopy(self.kept[text])  # planning names anonymous nodes


CACHE = PlanCache()


def run(view: GraphView, text: str, params: Mapping[str, Any] | None = None, *, strict: bool = False, max_hops: int | None = None, on_diagnostic: Callable[[Diagnostic], None] | None = None, cache: PlanCache = CACHE) -> DataFrame:
    """The result of a read query as a lazy DataFrame."""
    s = cache.get(text)
    if s.kind != "match" or s.mutations:
        raise PlanError("a view can only be read; writes need a Graph")
    return Rows(Planner(view, s, params or {}, strict, max_hops, on_diagnostic)).result()


def explain(view: GraphView, text: str, params: Mapping[str, Any] | None = None) -> str:
    return Planner(view, CACHE.get(text), params or {}).explain()
