"""Evaluation of question-to-SQL runs: result comparison, rates by tier, A/B regressions, error taxonomy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(c: Column, kind: str) -> Column:
    """A value as comparable text: null is a mark of its own, booleans and texts are trimmed, numbers have four places. Integers and
    decimals are written exactly (decimals of more places are rounded as decimals), floats are rounded."""
    if kind in ("int", "bigint", "smallint", "tinyint"):
        text = F.concat(c.cast("string"), F.lit(".0000"))
    elif kind.startswith("decimal"):
        d = F.round(c, 4)
        whole = F.regexp_extract(d.cast("string"), r"^-?\d+", 0)
        places = F.rpad(F.regexp_extract(d.cast("string"), r"\.(\d+)$", 1), 4, "0")
        text = F.when(d == 0, "0.0000").otherwise(F.concat(whole, F.lit("."), places))
    elif kind in ("double", "float"):
        d = F.round(c.cast("double"), 4)
        text = F.when(F.isnan(d), "nan").otherwise(F.format_string("%.4f", d + F.lit(0.0)))
        text = F.when(d == 0, "0.0000").otherwise(text)  # no minus zero
    else:
        text = F.trim(c.cast("string"))
    return F.coalesce(text, F.lit("∅"))


def normalised(df: DataFrame) -> DataFrame:
    """One column ``row``: the cells of each row by position."""
    return df.select(F.array(*[cell(F.col(f"`{n}`"), k) for n, k in df.dtypes] or [F.lit("")]).alias("row"))


def compare(generated: DataFrame, gold: DataFrame, ordered: bool = False) -> str:
    """correct, correct_empty or wrong_rows: as multisets, or as lists in the results' own order.

    Multisets are counted on each side and joined. Lists are numbered by position within partitions, one
    count a partition, so that neither side is gathered.
    """
    a, b = normalised(generated), normalised(gold)
    if ordered:
        a, b = _positions(a), _positions(b)
    x = a.groupBy(*a.columns).agg(F.count("*").alias("na"))
    y = b.groupBy(*b.columns).agg(F.count("*").alias("nb"))
    s = x.join(y, a.columns, "full").agg(
        F.coalesce(F.sum(F.coalesce("na", F.lit(0))), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.coalesce("nb", F.lit(0))), F.lit(0)).alias("b"),
        F.count_if(~F.col("na").eqNullSafe(F.col("nb"))).alias("bad"),
    ).first()
    return "wrong_rows" if s["bad"] else "correct" if s["a"] else "correct_empty"


def _positions(df: DataFrame) -> DataFrame:
    at = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return at.withColumn("_p", part).join(F.broadcast(sizes.drop("_n")), "_p").select(
        "row", (F.col("_b") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("position")
    )


def status(generated: DataFrame | None, gold: DataFrame | None, ordered: bool = False, error: str = "") -> str:
    if generated is None:
        return "generated_error" if error else "no_generated_sql"
    if gold is None:
        return "gold_error"
    return compare(generated, gold, ordered)


#: Buckets of errors in the order in which they are tried, and the stage tag or the mark that speaks for each. Fixed values.
TAXONOMY = (("cost", r"\(cost\)"), ("schema", r"\(schema\)"), ("semantic", r"\(semantic\)"), ("placeholder", "placeholder"), ("ambiguous", r"ambiguous_query|^\s*ambiguous\s*$"))
#: The tag of the guard's steps in an error: those of names and types, and the cost; all other rules are semantic.
STAGES = {"cost": "cost"} | dict.fromkeys(("syntax", "tables", "columns", "aliases", "types", "functions", "analysis"), "schema") | {"placeholder": "placeholder", "ambiguous": "ambiguous_query"}


def tagged(step: str, message: str) -> str:
    """An error as a run's log has it: with its stage's tag."""
    return f"({STAGES.get(step, 'semantic')}) {step}: {message}"


def bucket(message: Column) -> Column:
    """The first bucket whose tag the message has; other, or null without a message. A word such as "table" in it says nothing."""
    tests = reduce(lambda c, t: c.when(F.lower(message).rlike(t[1]), t[0]), TAXONOMY[1:], F.when(F.lower(message).rlike(TAXONOMY[0][1]), TAXONOMY[0][0]))
    return F.when(message.isNotNull() & (message != ""), tests.otherwise("other"))


def batch_metrics(runs: DataFrame) -> DataFrame:
    """tier (null: all), n, success, rate: provider errors are out of the denominator. runs: tier, result."""
    counted = runs.filter("result <> 'ProviderError'").rollup("tier").agg(
        F.count("*").alias("n"), F.count_if(F.col("result") == "Success").alias("success"), F.grouping("tier").alias("_all")
    )
    return counted.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("tier")).alias("tier"), "n", "success", (F.col("success") / F.col("n")).alias("rate")
    )


def passed(result: Column, confidence: Column) -> Column:
    """A success at confidence 0 is no true pass."""
    return F.coalesce((result == "Success") & (confidence > 0), F.lit(False))


def ab(base: DataFrame, new: DataFrame) -> DataFrame:
    """(qnum, change): regression, gain or same; questions missing on the new side are regressions if they passed. Both: qnum, result, confidence."""
    a = base.select("qnum", passed(F.col("result"), F.col("confidence")).alias("a"))
    b = new.select("qnum", passed(F.col("result"), F.col("confidence")).alias("b"))
    both = a.join(b, "qnum", "full")
    was, now = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return both.select("qnum", F.when(was & ~now, "regression").when(~was & now, "gain").otherwise("same").alias("change"))


def verdict(changes: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("change") == kind)
    s = changes.agg(n("regression").alias("regressions"), n("gain").alias("gains"))
    net = F.col("gains") - F.col("regressions")
    return s.select("regressions", "gains", net.alias("net"), F.when(net < 0, "WORSE").when(net > 0, "BETTER").otherwise("SAME").alias("verdict"))


def calibrate(confidence: Column, sql: Column, retries: Column, autofixed: Column) -> Column:
    """Confidence less .15 for LIKE on ids, .10 for more than three SELECTs, .03 a retry and .05 for an autofix; 0 at least."""
    like = F.lower(sql).rlike(r"\b\w*id\s+i?like\b")
    selects = F.regexp_count(F.lower(sql), F.lit(r"\bselect\b"))
    return F.greatest(
        F.lit(0.0),
        confidence - F.when(like, 0.15).otherwise(0.0) - F.when(selects > 3, 0.10).otherwise(0.0) - 0.03 * retries - F.when(autofixed, 0.05).otherwise(0.0),
    )


def error_signature(message: Column) -> Column:
    """An error message without literals, numbers and case, so that repeats of one failure are equal."""
    plain = F.regexp_replace(F.lower(message), "'[^']*'|\"[^\"]*\"", "?")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\d+", "#"), r"\s+", " "))


def model_metrics(results: DataFrame) -> DataFrame:
    """syntax, no_hallucination, executes, exact_match (rates) and p50 (ms) of a model's answers.

    results: generated, gold, parsed (boolean), unknown_names (int), executed (boolean), elapsed_ms. An exact match is equality without case and outer blanks.
    """
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return results.agg(
        rate(F.col("parsed")).alias("syntax"),
        rate(F.col("unknown_names") == 0).alias("no_hallucination"),
        rate(F.col("executed")).alias("executes"),
        rate(F.lower(F.trim("generated")) == F.lower(F.trim("gold"))).alias("exact_match"),
        F.percentile("elapsed_ms", 0.5).alias("p50"),
    )


def baseline_regressions(now: DataFrame, before: DataFrame, points: float = 3.0) -> DataFrame:
    """(metric, before, now, delta): metrics (in percent) that fell by more than ``points``. Both: metric, value."""
    both = before.select("metric", F.col("value").alias("before")).join(now.select("metric", F.col("value").alias("now")), "metric")
    return both.withColumn("delta", F.col("now") - F.col("before")).filter(F.col("delta") < -points)


def latency_residual(runs: DataFrame, parts: list[str], total: str = "total_ms") -> DataFrame:
    """``runs`` with ``unattributed``: what the measured parts leave of the total, at least 0."""
    known = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts])
    return runs.withColumn("unattributed", F.greatest(F.lit(0.0), F.col(total) - known))
