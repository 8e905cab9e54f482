"""Mixing sources to target weights by pivotal dependent rounding (operator 5).

A source whose target is f times its size wants every document f times. The whole part of f is
taken outright; the fractional parts are rounded *dependently*: two documents of a source pass
words to each other, in a random direction chosen so that no document's expectation changes,
until one of them is taken whole or not at all. The words of the source stay what they were, so
only the last document left over can miss the target.

Documents are dealt into blocks by a hash of their key, so results don't depend on the layout;
each block leaves at most one undecided document, and these meet in a tree of fan-in ``FAN``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Documents in a block, on average, and blocks that meet at a node of the tree.
BLOCK, FAN = 2048, 16
#: Of rows that are alike, so many are dealt out together.
PIECE = 10_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """(source, rank, source_size, target, source_rows): ``share`` of all sizes dealt out by weight, none above ``cap`` of its size.

    Sources rank by code point with null last; their weights repeat along the ranks. Sources at
    their cap give the excess back, which the others share by weight, until none is above. All
    of it is aggregates; nothing but one total and one level a round comes to the driver.
    """
    totals = sized.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows")
    )
    ranked = common.numbered(totals, ["source"], "rank", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = common.stage(ranked.withColumn("weight", weight), "mix-weights")
    total = share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    limit, level, full = F.col("source_size") * F.lit(float(cap)), 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > limit
        s = table.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(above).alias("n"),
        ).first()
        if s["n"] == full or not s["open"]:
            level = level if s["open"] else float("inf")
            break
        full, level = s["n"], (total - s["held"]) / s["open"]
    target = limit if level == float("inf") else F.least(limit, F.lit(level) * F.col("weight"))
    return table.select("source", "rank", "source_size", "source_rows", target.cast("double").alias("target"))


def _uniform(seed: str, *parts: object) -> float:
    digest = hashlib.blake2b("\x1f".join(map(str, (seed, *parts))).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def pivot(rows: Iterator[tuple], seed: str) -> tuple[dict, tuple | None]:
    """Decides all of ``rows`` but one at most. A row is (key, size, share of it still to give).

    Returns {key: 0 or 1} and the undecided (key, size, share). The sum of size * share plus the
    sizes of the decided ones is kept at every step, and so is each document's expectation.
    """
    done: dict = {}
    held: tuple | None = None
    for key, size, p in rows:
        if size == 0 or p <= 1e-12 or p >= 1 - 1e-12:
            done[key] = int(p > 0.5)
            continue
        if held is None:
            held = (key, size, p)
            continue
        k, s, q = held
        up = min(size * (1 - p), s * q)  # words that this one can take from the held one
        down = min(size * p, s * (1 - q))
        move = up if _uniform(seed, k, key) * (up + down) < down else -down
        p, q = p + move / size, q - move / s
        left = []
        for key_, size_, p_ in ((k, s, q), (key, size, p)):
            if p_ <= 1e-9 or p_ >= 1 - 1e-9:
                done[key_] = int(p_ > 0.5)
            else:
                left.append((key_, size_, p_))
        held = left[0] if left else None
    return done, held


def mixed(
    rows: DataFrame, key: list[str], seed: str = "mix", block: int = BLOCK, fan: int = FAN, **shares
) -> DataFrame:
    """``rows`` (``key`` columns, source, size) with source_size, target and copies (0, 1 or 2).

    ``key`` identifies a row; rows that agree in it and in source and size must be told apart by
    one of its columns. Null keys are keys like others. A source without words takes no copies.
    Every run over the same rows gives the same copies, however they are laid out.
    """
    targets = source_targets(rows)
    depth = F.lit(0)
    for d in range(12, 0, -1):
        depth = F.when((F.col("source_rows") <= block * fan**d) & (F.col("source_rows") > block * fan ** (d - 1)), d).otherwise(depth)
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key]
    # The table of sources is small as a rule; Spark broadcasts it only below its own threshold.
    named = targets.withColumnRenamed("source", "__source")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shared = (
        rows.join(named, F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("__key", F.concat_ws("\x1f", *columns))
        .withColumn("__whole", F.floor(per + 1e-12).cast("long"))
        .withColumn("__p", F.greatest(F.lit(0.0), per - F.col("__whole")))
        .withColumn("__order", F.xxhash64(F.lit(seed), "__key"))
        .withColumn("__depth", depth)
        .withColumn("__block", F.pmod(F.shiftright("__order", 8), F.pow(F.lit(fan), "__depth").cast("long")))
    )
    shared = common.stage(shared, "mix-rows")
    schema = "rank long, __depth int, __block long, __key string, size long, p double, given int"

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__order", "__key"], kind="stable")
        done, held = pivot(zip(pdf["__key"], pdf["size"].astype(float), pdf["p"], strict=True), seed)
        out = pdf[["rank", "__depth", "__block", "__key", "size", "p"]].copy()
        out["given"] = [done.get(k, -1) for k in out["__key"]]
        if held:
            out.loc[out["__key"] == held[0], "p"] = held[2]
        return out

    level = shared.select("rank", "__depth", "__block", "__key", "size", F.col("__p").alias("p"), "__order")
    deepest = shared.agg(F.coalesce(F.max("__depth"), F.lit(0))).first()[0]
    decided: list[DataFrame] = []
    for _ in range(deepest + 1):
        made = common.stage(level.groupBy("rank", "__block").applyInPandas(decide, schema), "mix-level")
        decided.append(made.filter("given >= 0").select("rank", "__key", "given"))
        rest = made.filter("given < 0")
        up = F.greatest(F.lit(0), F.col("__depth") - 1)
        level = rest.select(
            "rank", up.alias("__depth"), (F.col("__block") % F.pow(F.lit(fan), up).cast("long")).alias("__block"),
            "__key", "size", "p", F.xxhash64(F.lit(seed), "__key").alias("__order"),
        )
    # What a source has left at the root is one document; it is taken with the probability it holds.
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("root"), "__key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    decided.append(rest.select("rank", "__key", (draw < F.col("p")).cast("int").alias("given")))
    given = decided[0]
    for d in decided[1:]:
        given = given.unionByName(d)
    return (
        shared.join(given, ["rank", "__key"])
        .withColumn("copies", F.col("__whole") + F.col("given"))
        .select(*[f"`{c}`" for c in rows.columns], "source_size", "target", "copies")
    )


def _one_by_one(groups: DataFrame, n: str) -> DataFrame:
    """Every row of ``groups`` as many times as ``n`` says, numbered ``__k`` from 1. Groups of over ``PIECE`` rows are dealt out in pieces."""
    pieces = groups.withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / PIECE))))
    if not groups.filter(F.col(n) > PIECE).isEmpty():
        pieces = pieces.repartition(F.xxhash64(*groups.columns, "__b"))
    ends = F.least(F.col(n), (F.col("__b") + 1) * PIECE)
    return pieces.withColumn("__k", F.explode(F.sequence(F.col("__b") * PIECE + 1, ends))).drop("__b", n)


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (null and empty texts have size 0 and take none).

    Rows that agree in doc_id, source and size are alike here: they are counted, and decided one by one by a running number. Null
    doc_ids and null sources are kept; an empty table gives no rows.
    """
    groups = docs.select("doc_id", "source", words().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("__n"))
    rows = _one_by_one(common.stage(groups, "mix-groups"), "__n").withColumnRenamed("__k", "k")
    return mixed(rows, ["doc_id", "source", "size", "k"]).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with the columns as they were.

    Words are counted once a row. Rows that agree in all columns are counted, decided one by one, and come back as often as they are taken
    together; the texts are shuffled once, one of each kind of row of a partition, to meet their copies. Documents without words, null
    texts among them, aren't taken; null sources are a source like others; an empty table stays empty.
    """
    columns = docs.columns
    every = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    marked = docs.withColumn("__a", F.xxhash64(*every)).withColumn("__b", F.xxhash64(F.lit(7), *every))
    groups = marked.select("source", words().alias("size"), "__a", "__b").groupBy("__a", "__b", "source", "size").agg(F.count("*").alias("__n"))
    small = _one_by_one(common.stage(groups.withColumnsRenamed({"__a": "__ka", "__b": "__kb"}), "mix-groups"), "__n")
    taken = mixed(small, ["__ka", "__kb", "__k"]).filter("copies > 0")
    taken = taken.groupBy("__ka", "__kb", F.floor((F.col("__k") - 1) / PIECE).alias("__piece")).agg(F.sum("copies").cast("int").alias("__copies"))
    first = F.row_number().over(Window.partitionBy("__a", "__b").orderBy(F.lit(0)))
    kinds = marked.withColumn("__first", first).filter("__first = 1")
    met = kinds.join(taken, (F.col("__a") == F.col("__ka")) & (F.col("__b") == F.col("__kb")))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of the mix of all ``documents``, see :func:`mix_report`."""
    return mix_report(common.documents(spark, sf_dir))
