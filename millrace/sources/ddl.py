"""PostgreSQL DDL to a catalog, in passes: tables and views, foreign keys, indexes, comments, seed rows.

Statements that can't be read are skipped, never fatal.
"""

from __future__ import annotations

import re

from ..catalog import Catalog, Column, ForeignKey, Index, Table
from ..sqlx import tokens
from ..sqlx.tokens import Token


def statements(text: str) -> list[str]:
    """The statements of a script; semicolons inside strings, comments and $$ bodies don't split."""
    out, now = [], []
    for t in tokens.tokenize(text):
        if t.text == ";":
            out.append(tokens.text(now).strip())
            now = []
        elif t.kind != "comment":
            now.append(t)
    out.append(tokens.text(now).strip())
    return [s for s in out if s]


def _name(s: str) -> str:
    return s.split(".")[-1].strip().strip('"').lower()


def _columns(s: str) -> tuple[str, ...]:
    return tuple(_name(c) for c in s.split(","))


def _strings(s: str) -> list[str]:
    return [m.replace("''", "'") for m in re.findall(r"'((?:[^']|'')*)'", s)]


_KEY = re.compile(r"foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w.\"]+)\s*(?:\(([^)]*)\))?", re.I)


def _items(body: list[Token]) -> list[str]:
    return [tokens.text(x).strip() for x in tokens.split(body) if tokens.text(x).strip()]


def _column(item: str, table: Table) -> None:
    m = re.match(r'"?(\w+)"?\s+((?:character varying|double precision|timestamp with(?:out)? time zone|time with(?:out)? time zone|\w+)\s*(?:\([^)]*\))?(?:\s*\[\s*\])?)', item, re.I)
    if not m:
        return
    rest = item[m.end() :]
    kind = re.sub(r"\s+", " ", m[2].strip().lower()).replace("character varying", "varchar").replace(" [", "[")
    kind = "timestamptz" if kind.startswith("timestamp with time") else "timestamp" if kind.startswith("timestamp without") else kind
    c = Column(m[1].lower(), kind, nullable=not re.search(r"(?i)\bnot\s+null\b|\bprimary\s+key\b", rest), primary=bool(re.search(r"(?i)\bprimary\s+key\b", rest)))
    if d := re.search(r"(?i)\bdefault\s+('(?:[^']|'')*'|[\w.]+(?:\([^)]*\))?)", rest):
        c.default = d[1]
    if v := _vocabulary(rest):
        c.allowed = v[1]
    table.columns[c.name] = c
    if re.search(r"(?i)\bunique\b", rest):
        table.indexes.append(Index((c.name,), unique=True))
    if f := re.search(r"(?i)\breferences\s+([\w.\"]+)\s*(?:\(([^)]*)\))?", rest):
        table.foreign_keys.append(ForeignKey(table.name, (c.name,), _name(f[1]), _columns(f[2]) if f[2] else ("id",)))


def _vocabulary(text: str) -> tuple[str, frozenset[str]] | None:
    """(column, values) of CHECK (col IN (..)) or CHECK (col = ANY (ARRAY[..])); None for any other check."""
    m = re.search(r"(?is)check\s*\(+\s*\(*\s*\"?(\w+)\"?\)*(?:::\w+)?\s*(?:in\s*\(([^)]*)\)|=\s*any\s*\(+\s*array\s*\[([^\]]*)\])", text)
    if not m:
        return None
    return m[1].lower(), frozenset(_strings(m[2] or m[3]))


def _create_table(s: str, found: dict[str, Table]) -> None:
    m = re.match(r"(?is)create\s+(?:unlogged\s+|temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)\s*(.*)$", s)
    if not m:
        return
    t = Table(_name(m[1]))
    if p := re.match(r"(?is)partition\s+of\s+([\w.\"]+)", m[2]):
        t.partition_of = _name(p[1])
    ts = tokens.tokenize(m[2])
    if ts and ts[0].text == "(":
        for item in _items(ts[1 : tokens.closing(ts, 0)]):
            head = re.sub(r'(?i)^constraint\s+"?\w+"?\s+', "", item)
            if k := re.match(r"(?i)primary\s+key\s*\(([^)]*)\)", head):
                for c in _columns(k[1]):
                    if c in t.columns:
                        t.columns[c].primary, t.columns[c].nullable = True, False
            elif k := _KEY.match(head):
                t.foreign_keys.append(ForeignKey(t.name, _columns(k[1]), _name(k[2]), _columns(k[3]) if k[3] else ("id",)))
            elif k := re.match(r"(?i)unique\s*\(([^)]*)\)", head):
                t.indexes.append(Index(_columns(k[1]), unique=True))
            elif re.match(r"(?i)(check|exclude|like)\b", head):
                v = _vocabulary(head)
                if v and v[0] in t.columns:
                    t.columns[v[0]].allowed = v[1]
            else:
                _column(item, t)
    found[t.name] = t


def parse(text: str) -> Catalog:
    found: dict[str, Table] = {}
    script = statements(text)
    for s in script:
        _create_table(s, found)
        if v := re.match(r"(?is)create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+([\w.\"]+)", s):
            found[_name(v[1])] = Table(_name(v[1]), is_view=True)
    for s in script:
        if m := re.match(r"(?is)alter\s+table\s+(?:only\s+)?([\w.\"]+)\s+add\s+(?:constraint\s+\"?\w+\"?\s+)?(.*)$", s):
            t = found.get(_name(m[1]))
            if t and (k := _KEY.match(m[2])):
                t.foreign_keys.append(ForeignKey(t.name, _columns(k[1]), _name(k[2]), _columns(k[3]) if k[3] else ("id",)))
            elif t and (k := re.match(r"(?i)primary\s+key\s*\(([^)]*)\)", m[2])):
                for c in _columns(k[1]):
                    if c in t.columns:
                        t.columns[c].primary, t.columns[c].nullable = True, False
        elif m := re.match(r"(?is)create\s+(unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?[\w.\"]*\s*on\s+(?:only\s+)?([\w.\"]+)\s*(?:using\s+(\w+)\s*)?\((.*?)\)\s*(?:where\s+(.*))?$", s):
            if t := found.get(_name(m[2])):
                cols = tuple(_name(re.sub(r"(?i)\s+(asc|desc|nulls|\w+_ops).*$", "", c.strip())) for c in m[4].split(","))
                t.indexes.append(Index(cols, bool(m[1]), bool(m[5]), (m[3] or "btree").lower(), m[5] or ""))
        elif m := re.match(r"(?is)comment\s+on\s+(table|view|column)\s+([\w.\"]+)\s+is\s+(.*)$", s):
            text_ = (_strings(m[3]) or [""])[0]
            if m[1].lower() == "column":
                *_, table, column = (x.strip('"').lower() for x in m[2].split("."))
                if table in found and column in found[table].columns:
                    found[table].columns[column].comment = text_
            elif _name(m[2]) in found:
                found[_name(m[2])].comment = text_
        elif m := re.match(r"(?is)insert\s+into\s+([\w.\"]+)\s*\(([^)]*)\)\s*values\s*(.*)$", s):
            if t := found.get(_name(m[1])):
                _seed(t, _columns(m[2]), m[3])
    return Catalog(list(found.values()))


def _seed(t: Table, columns: tuple[str, ...], values: str) -> None:
    """Literal rows of an INSERT: co-occurring facts, and observed values of text columns."""
    ts, i = tokens.tokenize(values), 0
    while i < len(ts):
        if ts[i].text == "(":
            end = tokens.closing(ts, i)
            cells = _items(ts[i + 1 : end])
            if len(cells) == len(columns):
                row = {}
                for c, v in zip(columns, cells, strict=True):
                    if v.startswith("'"):
                        row[c] = _strings(v)[0]
                    elif re.fullmatch(r"-?\d+(\.\d+)?|(?i:true|false)", v):
                        row[c] = v
                t.seed.append(row)
            i = end
        i += 1
    for c in columns:
        seen = {r[c] for r in t.seed if c in r}
        if c in t.columns and t.columns[c].family == "string" and seen:
            t.columns[c].observed = frozenset(seen)
