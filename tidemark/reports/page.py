"""Pages of named queries that build on one another."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import shared

Query = str | Callable[..., DataFrame]


@dataclass
class Page:
    """Tables and named queries. A query is SQL with {name} for a table or another query and :name for an input, or a function of
    frames by parameter name. Inputs are single values, lists (used as array_contains(:names, column)) and date ranges, whose ends are
    :name_start and :name_end. A query that several others use is computed once and written to the shared folder; the others stay lazy."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    queries: dict[str, Query]
    inputs: dict[str, object] = field(default_factory=dict)

    def arguments(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for name, v in self.inputs.items():
            if isinstance(v, tuple) and len(v) == 2 and all(isinstance(d, dt.date) for d in v):
                out |= {f"{name}_start": v[0], f"{name}_end": v[1]}
            else:
                out[name] = list(v) if isinstance(v, (list, set, tuple)) else v
        return out

    def uses(self, name: str) -> list[str]:
        """The tables and queries that a query names."""
        q = self.queries[name]
        if callable(q):
            found = [p for p in q.__code__.co_varnames[: q.__code__.co_argcount]]
        else:
            found = list(dict.fromkeys(f for _, f, _, _ in Formatter().parse(q) if f))
        unknown = [f for f in found if f not in self.queries and f not in self.tables]
        if unknown:
            raise KeyError(f"{name} uses {', '.join(unknown)}, which the page does not hold")
        return found

    def order(self, wanted: tuple[str, ...]) -> list[str]:
        """The wanted queries and all that they build on, each after those that it uses; a circle is an error."""
        out: list[str] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"{' uses '.join((*above[above.index(name) :], name))}")
            if name in self.queries and name not in out:
                for u in self.uses(name):
                    visit(u, (*above, name))
                out.append(name)

        for name in wanted:
            if name not in self.queries:
                raise KeyError(f"the page holds no query {name}")
            visit(name, ())
        return out

    def run(self, *wanted: str) -> dict[str, DataFrame]:
        """The wanted queries' frames, all queries of the page by default."""
        wanted = wanted or tuple(self.queries)
        names = self.order(wanted)
        times = Counter(u for n in names for u in self.uses(n))
        times.update(wanted)
        frames = dict(self.tables)
        given = self.arguments()
        for n in names:
            q, own = self.queries[n], {u: frames[u] for u in self.uses(n)}
            if callable(q):
                frames[n] = q(**own)
            else:
                used = {k: v for k, v in given.items() if f":{k}" in q}
                frames[n] = self.spark.sql(q, args=used or None, **own)
            if times[n] > 1:
                frames[n] = shared.written(frames[n], "page")
        return {n: frames[n] for n in wanted}
