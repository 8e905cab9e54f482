"""The declared schema: tables, columns, keys, relationships, vocabularies, and their drift hashes.

Parquet carries no keys, so what rules and join paths rely on is declared here (or parsed from
DDL, see ``sources.ddl``) and can be verified against the data by the profiling jobs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ForeignKey:
    from_table: str
    from_columns: tuple[str, ...]
    to_table: str
    to_columns: tuple[str, ...]
    priority: int = 0  # lower is preferred where several join two tables
    condition: str = ""  # extra predicate of a conditional (polymorphic) edge
    role: str = ""  # "column=VALUE": the kind of row it refers to

    @property
    def self_referential(self) -> bool:
        return self.from_table == self.to_table


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    primary: bool = False
    default: str = ""
    comment: str = ""
    allowed: frozenset[str] | None = None  # exhaustive, of a CHECK; None: unknown
    observed: frozenset[str] | None = None  # seen in seed rows: evidence only

    @property
    def family(self) -> str:
        return type_family(self.type)


@dataclass
class Index:
    columns: tuple[str, ...]
    unique: bool = False
    partial: bool = False
    method: str = "btree"
    condition: str = ""


@dataclass
class Table:
    name: str
    columns: dict[str, Column] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    comment: str = ""
    is_view: bool = False
    partition_of: str = ""
    tenant_column: str = ""
    sensitive: frozenset[str] = frozenset()
    seed: list[dict] = field(default_factory=list)

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns.values() if c.primary)

    def unique_sets(self) -> list[tuple[str, ...]]:
        """The primary key and the columns of complete (not partial) unique indexes."""
        found = [self.primary_key] if self.primary_key else []
        return found + [i.columns for i in self.indexes if i.unique and not i.partial]

    def is_unique(self, columns: set[str]) -> bool:
        return any(set(u) <= columns for u in self.unique_sets())


#: PostgreSQL type names by family. Fixed values.
FAMILIES = {
    "integer": "bigserial bigint integer int smallint serial smallserial int2 int4 int8 long short byte tinyint",
    "numeric": "decimal numeric float real double float4 float8",
    "string": "varchar text char character citext uuid inet name string",
    "date": "date timestamp timestamptz time timetz interval timestamp_ntz datetime",
    "boolean": "boolean bool",
    "skip": "json jsonb bytea xml binary variant vector",
}
_FAMILY = {name: family for family, names in FAMILIES.items() for name in names.split()}


def type_family(name: str) -> str:
    """integer, numeric, string, date, boolean, or skip (arrays, JSON, unknown types)."""
    name = name.strip().lower()
    if name.endswith("[]") or name.startswith("array"):
        return "skip"
    return _FAMILY.get(name.split("(")[0].split()[0] if name else "", "skip")


class Catalog:
    def __init__(self, tables: list[Table]):
        self.tables = {t.name: t for t in tables}

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    @property
    def foreign_keys(self) -> list[ForeignKey]:
        return [k for t in self.tables.values() for k in t.foreign_keys]

    def integers(self) -> frozenset[str]:
        """Columns that are integers wherever the name occurs."""
        kinds: dict[str, set[str]] = {}
        for t in self.tables.values():
            for c in t.columns.values():
                kinds.setdefault(c.name, set()).add(c.family)
        return frozenset(n for n, k in kinds.items() if k == {"integer"})

    def fingerprints(self) -> dict[str, str]:
        """A structural SHA-256 for each table: changes with columns, types, keys, vocabularies and indexes, not with order."""
        out = {}
        for t in self.tables.values():
            lines = [f"c|{c.name}|{c.type.lower()}|{c.nullable}|{c.primary}|{sorted(c.allowed or ())}" for c in t.columns.values()]
            lines += [f"f|{k.from_columns}|{k.to_table}|{k.to_columns}|{k.condition}" for k in t.foreign_keys]
            lines += [f"i|{i.columns}|{i.unique}|{i.partial}|{i.method}|{i.condition}" for i in t.indexes]
            out[t.name] = hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
        return out

    def drift(self, stored: dict[str, str]) -> dict[str, str]:
        """new, changed, removed or same, for each table of the stored hashes and of this catalog."""
        now = self.fingerprints()
        state = lambda t: "removed" if t not in now else "new" if t not in stored else "same" if now[t] == stored[t] else "changed"
        return {t: state(t) for t in sorted({*now, *stored})}

    def column_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t.name, c.name, c.type, c.family, c.nullable, c.primary, sorted(c.allowed) if c.allowed is not None else None)
            for t in self.tables.values()
            for c in t.columns.values()
        ]
        return spark.createDataFrame(
            rows, "table_name string, column_name string, type string, family string, nullable boolean, is_pk boolean, allowed array<string>"
        )

    def key_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k.from_table, list(k.from_columns), k.to_table, list(k.to_columns), k.condition) for k in self.foreign_keys]
        return spark.createDataFrame(
            rows, "from_table string, from_columns array<string>, to_table string, to_columns array<string>, condition string"
        )


def _table(name: str, spec: str, keys: dict[str, str] | None = None, vocab: dict[str, str] | None = None, **more) -> Table:
    """A table from "column type, ..." (a star marks the primary key), {column: "table.column"} and {column: "A B"}."""
    columns = {}
    for part in spec.split(","):
        col, kind = part.split()
        primary = col.endswith("*")
        col = col.rstrip("*")
        allowed = frozenset((vocab or {})[col].split()) if col in (vocab or {}) else None
        columns[col] = Column(col, kind, nullable=not primary, primary=primary, allowed=allowed)
    fks = [ForeignKey(name, (c,), *_target(t), priority=k) for k, (c, t) in enumerate((keys or {}).items())]
    return Table(name, columns, fks, **more)


def _target(spec: str) -> tuple[str, tuple[str, ...]]:
    table, column = spec.split(".")
    return table, (column,)


def driver_catalog() -> Catalog:
    """The tables of the data folders. ``lineitem`` has no natural key."""
    return Catalog(
        [
            _table("region", "r_regionkey* int, r_name string"),
            _table("nation", "n_nationkey* int, n_name string, n_regionkey int", {"n_regionkey": "region.r_regionkey"}),
            _table(
                "customer", "c_custkey* bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                {"c_nationkey": "nation.n_nationkey"}, tenant_column="c_nationkey", sensitive=frozenset({"c_acctbal"}),
            ),
            _table("supplier", "s_suppkey* bigint, s_name string, s_nationkey int, s_acctbal double", {"s_nationkey": "nation.n_nationkey"}, sensitive=frozenset({"s_acctbal"})),
            _table("part", "p_partkey* bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
            _table(
                "orders", "o_orderkey* bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                {"o_custkey": "customer.c_custkey"}, {"o_orderstatus": "O F P"},
            ),
            _table(
                "lineitem",
                "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"},
                {"l_returnflag": "A N R", "l_linestatus": "O F"},
            ),
            _table("events", "event_id* bigint, ts timestamp, user_id bigint, event_type string, value double, props string", None, {"event_type": "view signup error click purchase"}),
            _table("documents", "doc_id* bigint, text string, lang string, source string, n_chars bigint", None, {"lang": "en fr de es"}),
            _table("labels", "doc_id* bigint, quality int, toxic int", {"doc_id": "documents.doc_id"}),
            _table("benchmark", "item_id* bigint, text string"),
            _table("pages", "page_id* bigint, url string, html string"),
            _table("conversations", "conv_id* bigint, turn* bigint, role string, text string", None, {"role": "user assistant system"}),
            _table("embeddings", "vec_id* bigint, embedding array<float>, label int"),
        ]
    )
