"""Preparing question/SQL pairs: sources of one shape, leak removal, the quality gate, envelopes, manifests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import stage
from ..sqlx import tokens

LEAK = 0.85
#: Words of a question and of a statement. Fixed values.
MIN_WORDS, MIN_SQL, MAX_SQL = 4, 10, 800
#: Templates of broken joins; wordings that ask for every one of something, and those that don't ask for all; wordings of an average duration. Fixed values.
GARBAGE_JOIN = r"(?i)SELECT\s+\w+\.\*\s*,\s*\w+\.\*"
EACH, NOT_ALL, DURATION = r" per | for each |including those with none", r" with | that have | assigned to ", "(average|avg) (duration|time)"
#: Prompt styles that are trained on. Fixed values.
CATEGORIES = ("Business Question → SQL", "")
PAIR = ("nl_query", "sql", "reasoning", "source", "category", "line_no")


def pairs(df: DataFrame, source: str, nl: str, sql: str, **more: str) -> DataFrame:
    """One source as pairs; ``more`` names the columns of reasoning, category and line_no, where it has them."""
    col = lambda name: F.col(more[name]) if name in more else F.lit(None)
    return df.select(
        F.col(nl).cast("string").alias("nl_query"), F.col(sql).cast("string").alias("sql"), col("reasoning").cast("string").alias("reasoning"),
        F.lit(source).alias("source"), col("category").cast("string").alias("category"), col("line_no").cast("long").alias("line_no"),
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def dedup_exact(df: DataFrame, text: Column, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each normalised text."""
    w = Window.partitionBy("_norm").orderBy(*order)
    return df.withColumn("_norm", T.normalise(text)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_norm", "_n")


def near_leaks(left: DataFrame, right: DataFrame, threshold: float = LEAK) -> DataFrame:
    """(id, match_id, jaccard): the pairs of (id, text) rows whose token sets have Jaccard ``threshold`` or more.

    Both sides are indexed by their rarest tokens, of n the first n - ceil(threshold * n) + 1 in order of
    frequency over both; two sets that match share one of these, so nothing is lost and frequent words join nothing.
    """
    a = left.select(F.col("id"), T.token_set(F.col("text")).alias("s")).filter("size(s) > 0")
    b = right.select(F.col("id"), T.token_set(F.col("text")).alias("s")).filter("size(s) > 0")
    words = a.select(F.explode("s").alias("t")).unionByName(b.select(F.explode("s").alias("t")))
    often = words.groupBy("t").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame) -> DataFrame:
        n = F.size("s")
        listed = side.select("id", n.alias("n"), F.explode("s").alias("t")).join(often, "t")
        ranked = listed.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("df", "t")))
        return ranked.filter(F.col("_r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("id", "n", "t")

    p, q = prefix(a).alias("p"), prefix(b).alias("q")
    sizes = F.least("p.n", "q.n") >= F.lit(threshold) * F.greatest("p.n", "q.n") - 1e-9
    found = p.join(q, (F.col("p.t") == F.col("q.t")) & sizes).select(F.col("p.id").alias("id"), F.col("q.id").alias("match_id")).distinct()
    scored = found.join(a.withColumnRenamed("s", "x"), "id").join(b.select(F.col("id").alias("match_id"), F.col("s").alias("y")), "match_id")
    return scored.select("id", "match_id", T.jaccard(F.col("x"), F.col("y")).alias("jaccard")).filter(F.col("jaccard") >= threshold)


#: Words whose hashes a worker remembers; bits of a hash that words are counted by; parities of a set by hash, as words of 64 bits; bits of :func:`_told`.
_MEMO, _COUNTED, _PARITIES, _BITS = 100_000, 20, 4, 1 << 23
#: Sizes of two sets together from which their pair is looked at by 256 counts of a byte as well.
_LARGE = 1200
_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


class _Hashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest())
        if len(self) >= _MEMO:
            self.clear()
        self[word] = value
        return value


def _small_batches(df: DataFrame) -> None:
    """Bounds what an Arrow batch may hold, as long texts and pairs of large sets would fill a Python worker; smaller bounds of the session are kept."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        have = conf.get(f"spark.sql.execution.arrow.{name}")
        if not have.isdigit() or not 0 < int(have) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def word_sets(df: DataFrame) -> DataFrame:
    """(id, key, words) of (id, text) rows, read once: a digest of the normalised text (empty for none), the sorted 64-bit hashes of its distinct words."""
    _small_batches(df)
    kind = dict(df.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            keys, sets = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").translate(_WORDS).split()
                keys.append(b"" if text is None else hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                own = set(words)
                sets.append(np.unique(np.fromiter(map(known.__getitem__, own), np.uint64, len(own))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["id", "key", "words"])

    return df.select("id", F.lower("text").alias("text")).mapInArrow(run, f"id {kind}, key binary, words binary")


def repeats(sets: DataFrame) -> DataFrame:
    """(key, id, n): the rows of :func:`word_sets` but the first of each normalised text, null ids last; n where they repeat."""
    each = sets.groupBy("key", "id").agg(F.count("*").alias("c"))
    least = F.min(F.struct(F.col("id").isNull().alias("z"), "id")).alias("f")
    first = each.groupBy("key").agg(least, F.sum("c").alias("m")).filter("m > 1").select("key", F.col("f.id").alias("first"))
    left = F.col("c") - F.col("id").eqNullSafe(F.col("first")).cast("long")
    return each.join(first, "key").select("key", "id", left.alias("n"), F.col("id").eqNullSafe(F.col("first")).alias("leads"))


def _told(rows: DataFrame, some: DataFrame, on: list[str], kept: bool) -> DataFrame:
    """Where ``kept``, the rows whose ``on`` is among ``some``, else the others. A bitmap of ``_BITS`` bits tells most rows at once; only the rest is shuffled and joined."""
    at, names = F.pmod(F.xxhash64(*on), F.lit(_BITS)).cast("int").alias("_at"), rows.columns
    words = some.select(at).groupBy(F.shiftright("_at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, _at & 63)")).alias("b")).toArrow()
    bits = np.zeros(_BITS >> 6, dtype=np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def those(may: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(len(names)).to_numpy()
                yield batch.filter(pa.array(((held.value[x >> 6] >> (x & 63).astype(np.int64)) & 1).astype(bool) == may)).select(names)

        return rows.select(*names, at).mapInArrow(run, rows.schema)

    if kept:
        return those(True).join(some, on, "left_semi")
    return those(False).unionByName(those(True).join(some, on, "left_anti").select(*names))


def nearest_before(sets: DataFrame, again: DataFrame, threshold: float = LEAK) -> DataFrame:
    """(id, jaccard): for each row of staged (id, key, words), see :func:`word_sets`, but the (key, id) of ``again``, the greatest Jaccard with a row of lesser id, where that is ``threshold`` or more.

    Of two sets that match, the longer one's first n - ceil(t * n) + 1 and the shorter one's first n - ceil(2t / (1 + t) * n) + 1 words in
    one order of all words have the first common word: they meet there if sizes, what can follow that word, and parities of words by hash
    allow it (sets differ in as many words as parities, at least). The order is by counts of hash buckets, rare ones first; it bears on the
    work alone. Parities bound a pair's Jaccard from above: of each row's pairs the one with the greatest bound is verified on the complete sets, then those
    whose bound is above what that gave. Of large sets counts by hash are compared before.
    """
    _small_batches(sets)
    spark, kind, share = sets.sparkSession, dict(sets.dtypes)["id"], threshold / (1 + threshold)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << _COUNTED, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n[(np.frombuffer(x, np.uint64) >> np.uint64(64 - _COUNTED)).astype(np.int64)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["at", "n"])

    rows = sets.select("words").mapInArrow(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << _COUNTED, dtype=np.int64)
    often[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    held = spark.sparkContext.broadcast(often)
    names, firsts = [f"s{k}" for k in range(_PARITIES)], _told(sets.filter("id is not null").select("id", "key", "words"), again, ["key", "id"], False)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.uint64(64 * _PARITIES - 1)
        for batch in batches:
            words, sizes, inner, odd, at, lengths = [], [], [], [], [], []
            for k, x in enumerate(batch.column(1).to_pylist()):
                h = np.frombuffer(x, np.uint64)
                if not len(h):
                    continue
                first = np.lexsort((h, held.value[(h >> np.uint64(64 - _COUNTED)).astype(np.int64)]))[: len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1]
                words.append(h[first])
                lengths.append(len(first))
                sizes.append(len(h))
                inner.append(len(h) - int(np.ceil(2 * share * len(h) - 1e-9)) + 1)
                odd.append(np.bincount((h & many).astype(np.int64), minlength=64 * _PARITIES) & 1)
                at.append(k)
            if not at:
                continue
            bits = np.packbits(np.array(odd, dtype=np.uint8), axis=1).view(np.int64)
            pos = np.concatenate([np.arange(n) for n in lengths])
            own = np.repeat(np.arange(len(at)), lengths)
            columns = [batch.column(0).take(pa.array(np.array(at)[own])), pa.array(np.concatenate(words).view(np.int64)), pa.array(np.array(sizes, dtype=np.int32)[own]), pa.array(pos.astype(np.int32)), pa.array(pos < np.array(inner)[own])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(bits[own, j]) for j in range(_PARITIES)], names=["id", "t", "n", "pos", "inner", *names])

    schema = f"id {kind}, t long, n int, pos int, inner boolean, " + ", ".join(f"{x} long" for x in names)
    entries = stage(firsts.select("id", "words").mapInArrow(prefixes, schema), "set-prefixes")
    a, b = entries.alias("a"), entries.filter("inner").alias("b")
    both = F.col("a.n") + F.col("b.n")
    apart = sum((F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in names), F.lit(0))
    meets = (
        (F.col("a.t") == F.col("b.t"))
        & ((F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") > F.col("b.id"))))
        & (F.col("a.id") != F.col("b.id"))
        & (F.col("b.n") >= F.lit(threshold) * F.col("a.n") - 1e-9)
        & (F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= F.lit(share) * both - 1e-6)
        & (apart <= F.lit(1 - 2 * share) * both + 1e-6)
    )
    found = a.join(b, meets).select(F.greatest("a.id", "b.id").alias("id"), F.least("a.id", "b.id").alias("match_id"), both.alias("size"), apart.alias("apart"))
    found = stage(found, "set-met")  # a pair as often as it meets
    ids = lambda df: df.select("id").unionByName(df.select(F.col("match_id").alias("id"))).distinct()
    of = lambda df: _told(_told(sets, ids(df), ["id"], True).select("id", "key", "words"), again, ["key", "id"], False).select("id", "words")
    large = found.filter(F.col("size") >= _LARGE).distinct()

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.minimum(np.bincount(np.frombuffer(x, np.uint64).view(np.uint8)[::8], minlength=256), 255).astype(np.uint8).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "x"])

    def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for k in (4, 5))
            fine = np.maximum(np.abs(x - y).sum(axis=1), batch.column(3).to_numpy()).astype(np.int32)
            ok = pa.array(fine <= (1 - 2 * share) * batch.column(2).to_numpy() + 1e-6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fine)], names=["id", "match_id", "size", "apart"]).filter(ok)

    counts = stage(of(large).mapInArrow(finer, f"id {kind}, x binary"), "set-counts")
    pairs = large.join(counts, "id").join(counts.select(F.col("id").alias("match_id"), F.col("x").alias("y")), "match_id").select("id", "match_id", "size", "apart", "x", "y")
    pairs = pairs.mapInArrow(nearer, f"id {kind}, match_id {kind}, size int, apart int").unionByName(found.filter(F.col("size") < _LARGE))
    pairs = stage(pairs.select("id", "match_id", ((F.col("size") - F.col("apart")) / (F.col("size") + F.col("apart"))).alias("most")), "set-pairs")
    held_sets = stage(of(pairs), "set-words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            js = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                js.append(shared / ((len(x) + len(y)) // 8 - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(js, pa.float64())], names=["id", "match_id", "jaccard"])

    def scored(some: DataFrame) -> DataFrame:
        x, y = held_sets.withColumnRenamed("words", "x"), held_sets.select(F.col("id").alias("match_id"), F.col("words").alias("y"))
        return some.join(x, "id").join(y, "match_id").select("id", "match_id", "x", "y").mapInArrow(verify, f"id {kind}, match_id {kind}, jaccard double")

    best = stage(pairs.groupBy("id").agg(F.max(F.struct("most", "match_id")).alias("m")).select("id", "m.match_id", "m.most"), "set-best")
    first = stage(scored(best), "set-first")
    # A bound that is met can't be passed by the row's other pairs.
    below = stage(first.join(best.select("id", "most"), "id").filter("most > jaccard + 1e-12").select("id", F.col("match_id").alias("tried"), "jaccard"), "set-below")
    left = _told(pairs, below.select("id"), ["id"], True).join(below, "id").filter("most > jaccard + 1e-12 and match_id <> tried").select("id", "match_id").distinct()
    every = first.unionByName(scored(left)).filter(F.col("jaccard") >= threshold)
    return every.groupBy("id").agg(F.max("jaccard").alias("jaccard"))


def deleak(train: DataFrame, test: DataFrame, threshold: float = LEAK) -> DataFrame:
    """``train`` (id, text) with ``reason``: exact, jaccard=0.xxx, or null where nothing leaks. An exact match comes first."""
    keys = test.select(T.normalise(F.col("text")).alias("_norm")).distinct().withColumn("_exact", F.lit(True))
    near = near_leaks(train, test, threshold).groupBy("id").agg(F.max("jaccard").alias("_j"))
    marked = train.withColumn("_norm", T.normalise(F.col("text"))).join(keys, "_norm", "left").join(near, "id", "left")
    reason = F.when(F.col("_exact"), "exact").when(F.col("_j").isNotNull(), F.format_string("jaccard=%.3f", "_j"))
    return marked.withColumn("reason", reason).drop("_norm", "_exact", "_j")


def gate(df: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``df`` (nl_query, sql, category) with its binds settled in ``sql`` and ``reason``: the first failing test, null for what passes.

    The tests, in order: category, empty, prose, SELECT a.*, b.*, binds that can neither be given a literal nor be left out with their
    predicate, the question's and the statement's lengths in words, neither SELECT nor WITH, and what the guard would refuse for this question.
    """
    raw, nl = F.trim(F.coalesce("sql", F.lit(""))), F.trim(F.coalesce("nl_query", F.lit("")))
    settled = df.withColumn("_raw", raw).withColumn("_b", settled_binds(raw))
    sql = F.col("_b.sql")
    count = lambda c: F.size(F.array_remove(F.split(F.trim(c), r"\s+"), ""))
    begins = F.lower(F.regexp_extract(F.col("_raw"), r"^(\w+)", 1))
    reason = (
        F.when(~F.coalesce("category", F.lit("")).isin(*categories), "off_task_category")
        .when(F.col("_raw") == "", "empty_sql")
        .when(~begins.startswith("select") & ~begins.startswith("with"), "prose_no_sql")
        .when(F.col("_raw").rlike(GARBAGE_JOIN), "garbage_join")
        .when(F.col("_b.status").startswith("reject"), F.col("_b.status"))
        .when(nl == "", "empty_nl")
        .when(count(nl) < MIN_WORDS, "short_nl")
        .when(count(sql) < MIN_SQL, "short_sql")
        .when(count(sql) > MAX_SQL, "long_sql")
        .when(~F.lower(sql).startswith("select") & ~F.lower(sql).startswith("with"), "not_select")
        .when(contract_broken(nl, sql), "semantic_contract")
    )
    return settled.withColumn("reason", reason).withColumn("sql", F.when(F.col("reason").isNull(), sql).otherwise(F.col("sql"))).drop("_raw", "_b").select(*df.columns, "reason")


def contract_broken(nl: Column, sql: Column) -> Column:
    """Whether a pair breaks what the guard asks of an answer: "per" or "for each" over inner joins alone, an average duration without EPOCH."""
    q, s = F.concat(F.lit(" "), F.lower(nl), F.lit(" ")), F.lower(sql)
    per = q.rlike(EACH) & ~q.rlike(NOT_ALL)
    inner = s.rlike(r"\bjoin\b") & ~s.rlike(r"\b(?:left|right|full)\s+(?:outer\s+)?join\b")
    duration = q.rlike(DURATION) & ~s.rlike(r"extract ?\(epoch")
    return (per & s.rlike(r"\b(count|sum|avg|min|max)\s*\(") & inner) | duration


def funnel(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


#: Ends of names that say what a bind holds, and what is put in its place. Fixed values.
INTEGER_NAMES, DATE_NAMES = r"(?:^|_)(?:id|no|num|limit|offset|count|marks|year|attempt)s?$", r"date|_at$|_on$"
INTEGER, DATE = "42", "'2026-01-01'"
_BIND = r"(?<![:\w]):[A-Za-z_]\w*|\$\d+"


def substitute_binds(sql: str) -> tuple[str, int]:
    """(the statement with literals for the binds whose name, or for $1 the column it is compared with, tells their type; how many stay)."""
    masked, stay = tokens.mask(sql), 0
    for m in reversed(list(re.finditer(_BIND, masked))):
        compared = re.search(r"([A-Za-z_]\w*)\s*(?:=|<>|!=|<=|>=|<|>|\blike\b|\bilike\b|\bbetween\b|\bin\s*\()\s*$", masked[: m.start()], re.I)
        hint = m[0][1:] if m[0][0] == ":" else compared[1] if compared else ""
        if re.search(INTEGER_NAMES, hint, re.I):
            sql = sql[: m.start()] + INTEGER + sql[m.end() :]
        elif re.search(DATE_NAMES, hint, re.I):
            sql = sql[: m.start()] + DATE + sql[m.end() :]
        else:
            stay += 1
    return sql, stay


_OPERAND = r"[\w.\"]+(?:\([^()]*\))?"
_B = r"(?::[A-Za-z_]\w*|\$\d+)"
_PREDICATE = (
    rf"(?:not\s+)?{_OPERAND}\s*(?:(?:=|<>|!=|<=|>=|<|>|\bi?like\b)\s*(?:{_B}|\w+\(\s*{_B}[^()]*\))|(?:not\s+)?between\s+(?:{_B}\s+and\s+\S+|\S+\s+and\s+{_B})"
    rf"|(?:not\s+)?in\s*\([^()]*{_B}[^()]*\))"
)
_END = r"(?=\s*(?:$|\)|;|\bgroup\b|\border\b|\blimit\b|\bhaving\b|\bunion\b|\boffset\b|\bfetch\b))"


def strip_placeholder_predicates(sql: str, passes: int = 40) -> str | None:
    """Takes out the predicates that still hold a bind: of AND and OR the other side stays, a WHERE or HAVING of nothing else goes. None where a bind
    is a join's only condition or stands anywhere else, or after ``passes`` of them."""
    steps = (
        (rf"\s+(?:and|or)\s+{_PREDICATE}(?!\s*\()", ""),
        (rf"(\bwhere|\bhaving|\bon|\()(\s*){_PREDICATE}\s+(?:and|or)\s+", r"\1 "),
        (rf"\s+(?:where|having)\s+{_PREDICATE}{_END}", ""),
    )
    for _ in range(passes):
        masked = tokens.mask(sql)
        m, with_ = next(((m, w) for p, w in steps if (m := re.search(p, masked, re.I))), (None, ""))
        if m is None:
            break
        sql = sql[: m.start()] + m.expand(with_) + sql[m.end() :]
    return None if re.search(_BIND, tokens.mask(sql)) else sql


def settle(sql: str) -> tuple[str, str]:
    """(statement, status): clean, substituted, stripped or reject:bind."""
    if not re.search(_BIND, tokens.mask(sql)):
        return sql, "clean"
    new, stay = substitute_binds(sql)
    if not stay:
        return new, "substituted"
    stripped = strip_placeholder_predicates(new)
    return (sql, "reject:bind") if stripped is None else (stripped, "stripped")


def settled_binds(sql: Column) -> Column:
    """struct<sql, status> of :func:`settle`. It works on tokens, so in Arrow batches of Python; a statement without : and $ is handed back at once."""

    @F.pandas_udf("sql string, status string")
    def run(statements: pd.Series) -> pd.DataFrame:
        made = [settle(x) if x and (":" in x or "$" in x) else (x, "clean") for x in statements]
        return pd.DataFrame(made, columns=["sql", "status"])

    return run(sql)


def gold_confidence(sql: Column) -> Column:
    """0.92, 0.88 or 0.82 by the number of joins: none or one, two, more."""
    joins = F.regexp_count(F.lower(sql), F.lit(r"\bjoin\b"))
    return F.when(joins <= 1, 0.92).when(joins == 2, 0.88).otherwise(0.82)


def envelope(df: DataFrame) -> DataFrame:
    """(nl_query, answer): the JSON a model is trained to give: sql, tables_used, confidence."""
    used = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("sql"), F.lit(r"\b(?:from|join)\s+([a-z_][\w.]*)"), F.lit(1)), lambda t: t))
    body = F.struct(F.col("sql"), F.array_sort(used).alias("tables_used"), gold_confidence(F.col("sql")).alias("confidence"))
    return df.select("nl_query", F.to_json(body).alias("answer"))


def fit_to_budget(sections: list[dict], chunks: list[dict], budget: int) -> dict | None:
    """Drops sections in their order, then chunks that aren't gold from the end, then halves gold texts twice; None if it still doesn't fit.

    sections: name, tokens, drop (order of dropping, None for never). chunks: text, gold. Greedy, one prompt at a time.
    """
    count = lambda t: max(1, len(t) // 4)
    sections, chunks = list(sections), [dict(c) for c in chunks]
    size = lambda: sum(s["tokens"] for s in sections) + sum(count(c["text"]) for c in chunks)
    for s in sorted((s for s in sections if s["drop"] is not None), key=lambda s: s["drop"]):
        if size() <= budget:
            break
        sections.remove(s)
    while size() > budget and any(not c["gold"] for c in chunks):
        last = max(i for i, c in enumerate(chunks) if not c["gold"])
        del chunks[last]
    for _ in range(2):
        if size() <= budget:
            break
        for c in chunks:
            c["text"] = c["text"][: max(1, len(c["text"]) // 2)]
    if size() > budget or any(c["gold"] and not c["text"].strip() for c in chunks):
        return None  # without its gold a prompt teaches what it doesn't show
    return {"sections": [s["name"] for s in sections], "chunks": chunks, "tokens": size()}


def manifest(inputs: list[str], config: dict, rows: dict[str, int]) -> dict:
    """SHA-256 of every input file and of the configuration, with the row funnel."""
    files = {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in sorted(inputs)}
    return {"inputs": files, "config": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(), "rows": rows}


def is_fresh(stored: dict, inputs: list[str], config: dict) -> bool:
    now = manifest(inputs, config, {})
    return all(stored.get(k) == now[k] for k in ("inputs", "config"))
