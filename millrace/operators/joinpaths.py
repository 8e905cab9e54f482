"""Join-path synthesis: the smallest set of foreign-key joins that connects the wanted tables.

The graph holds every foreign key (several between two tables are kept; the preferred one is
used). For each connected component the tree is the usual approximation of a Steiner
tree: a minimum spanning tree over the shortest paths between the wanted tables.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, ForeignKey


@dataclass
class JoinPath:
    tables: list[str]
    edges: list[ForeignKey]

    def sql(self) -> str:
        """FROM and JOIN text in an order in which each table joins one that is there."""
        if not self.tables:
            return ""
        lines = [f"FROM {self.tables[0]}"]
        for table, key in self.steps():
            on = " AND ".join(f"{key.from_table}.{a} = {key.to_table}.{b}" for a, b in zip(key.from_columns, key.to_columns, strict=True))
            lines.append(f"JOIN {table} ON {on}" + (f" AND {key.condition}" if key.condition else ""))
        return "\n".join(lines)

    def steps(self) -> list[tuple[str, ForeignKey]]:
        seen, left, out = {self.tables[0]} if self.tables else set(), list(self.edges), []
        while left:
            k = next((k for k in left if (k.from_table in seen) != (k.to_table in seen)), None)
            if k is None:
                break
            table = k.to_table if k.from_table in seen else k.from_table
            seen.add(table)
            out.append((table, k))
            left.remove(k)
        return out


class JoinGraph:
    def __init__(self, keys: list[ForeignKey], tables: list[str]):
        self.tables = set(tables)
        self.edges: dict[str, dict[str, ForeignKey]] = defaultdict(dict)
        for k in sorted(keys, key=lambda k: (k.priority, k.from_columns)):
            if not k.self_referential and k.from_table in self.tables and k.to_table in self.tables:
                self.edges[k.from_table].setdefault(k.to_table, k)
                self.edges[k.to_table].setdefault(k.from_table, k)

    @classmethod
    def of(cls, catalog: Catalog, more: tuple[ForeignKey, ...] = ()) -> JoinGraph:
        """``more``: declared virtual edges, with composite keys or conditions."""
        return cls([*catalog.foreign_keys, *more], list(catalog.tables))

    def _shortest(self, start: str) -> dict[str, tuple[int, int, tuple[str, ...]]]:
        """{table: (joins, priorities, path)}; ties by declared priority, then by names."""
        best: dict[str, tuple] = {}
        heap = [(0, 0, (start,))]
        while heap:
            d, p, path = heapq.heappop(heap)
            if path[-1] in best:
                continue
            best[path[-1]] = (d, p, path)
            for nxt, key in self.edges[path[-1]].items():
                if nxt not in best:
                    heapq.heappush(heap, (d + 1, p + key.priority, (*path, nxt)))
        return best

    def neighbours(self, tables: list[str]) -> set[str]:
        return {n for t in tables for n in self.edges[t]}

    def path(self, wanted: list[str]) -> list[JoinPath]:
        """One path for each connected component that holds two wanted tables or more; unknown tables are left out."""
        seeds = list(dict.fromkeys(t for t in wanted if t in self.tables))
        if len(seeds) < 2:
            return []
        near = {s: self._shortest(s) for s in seeds}
        pairs = sorted(
            (near[a][b][0], near[a][b][1], i, j, near[a][b][2])
            for i, a in enumerate(seeds)
            for j, b in enumerate(seeds)
            if i < j and b in near[a]
        )
        group = {s: s for s in seeds}
        chosen: dict[str, list[ForeignKey]] = defaultdict(list)
        find = lambda s: s if group[s] == s else find(group[s])
        used: set[tuple[str, str]] = set()
        edges: list[tuple[str, ForeignKey]] = []
        for _, _, i, j, path in pairs:
            a, b = find(seeds[i]), find(seeds[j])
            if a == b:
                continue
            group[b] = a
            for x, y in zip(path, path[1:]):
                if (x, y) not in used and (y, x) not in used:
                    used.add((x, y))
                    edges.append((a, self.edges[x][y]))
        for a, key in edges:
            if key not in chosen[find(a)]:
                chosen[find(a)].append(key)
        out = []
        for root, keys in chosen.items():
            keys = self._tree(keys)
            start = next(s for s in seeds if find(s) == find(root))
            p = JoinPath([start], keys)
            p.tables = [start, *[t for t, _ in p.steps()]]
            out.append(p)
        return out

    @staticmethod
    def _tree(keys: list[ForeignKey]) -> list[ForeignKey]:
        """Without the edges that would close a cycle."""
        up: dict[str, str] = {}

        def find(x: str) -> str:
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        out = []
        for k in keys:
            a, b = find(k.from_table), find(k.to_table)
            if a != b:
                up[a] = b
                out.append(k)
        return out


def join_tables(path: JoinPath, load: Callable[[str], DataFrame]) -> DataFrame:
    """The chained inner joins of a path; Catalyst chooses how each is made. Equal column names are kept apart by table alias."""
    out = load(path.tables[0]).alias(path.tables[0])
    for table, key in path.steps():
        on = reduce(
            lambda a, b: a & b,
            [F.col(f"{key.from_table}.{a}") == F.col(f"{key.to_table}.{b}") for a, b in zip(key.from_columns, key.to_columns, strict=True)],
        )
        if key.condition:
            on = on & F.expr(key.condition)
        out = out.join(load(table).alias(table), on)
    return out
