"""Evaluation over a run log derived from the driver's tables: events stand in for batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources import failures
from .tables import table

#: Statement pairs and what comparing their results must give.
COMPARISONS = [
    (1, "SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name", True, "correct"),
    (2, "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation ORDER BY n_name", True, "wrong_rows"),
    (3, "SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation", False, "correct"),
    (4, "SELECT n_name FROM nation WHERE false", "SELECT r_name FROM region WHERE false", False, "correct_empty"),
    (5, "SELECT n_regionkey FROM nation", "SELECT DISTINCT n_regionkey FROM nation", False, "wrong_rows"),
    (6, "SELECT CAST(n_regionkey AS DOUBLE) + 0.00001 FROM nation", "SELECT n_regionkey FROM nation", False, "correct"),
    (7, "SELECT nothing FROM nation", "SELECT n_regionkey FROM nation", False, "generated_error"),
    (8, "SELECT n_regionkey FROM nation", "SELECT nothing FROM nation", False, "gold_error"),
    (9, "", "SELECT n_regionkey FROM nation", False, "no_generated_sql"),
    (10, "SELECT 9007199254740993 AS c", "SELECT 9007199254740992 AS c", False, "wrong_rows"),
    (11, "SELECT CAST(1.00001 AS DECIMAL(20,5)) + n_regionkey AS c FROM nation", "SELECT n_regionkey + 1 AS c FROM nation", False, "correct"),
    (12, "SELECT CAST(n_regionkey AS DOUBLE) AS c FROM nation", "SELECT n_regionkey AS c FROM nation", False, "correct"),
    (13, "SELECT CAST(1.0002 AS DECIMAL(20,4)) AS c", "SELECT CAST(1.0001 AS DECIMAL(20,4)) AS c", False, "wrong_rows"),
    (14, "SELECT n_regionkey AS c FROM nation ORDER BY n_nationkey", "SELECT n_regionkey AS c FROM nation ORDER BY n_nationkey DESC", True, "wrong_rows"),
]


#: Errors as run logs have them: the stage's tag decides, not words such as table or ambiguous.
ERRORS = ["validation (cost): too expensive a table", "(schema) column x", "(semantic) the ambiguous one", "unresolved placeholder :id", "ambiguous_query", "relation of table y does not exist"]


def runs(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """qnum, tier, result, confidence, error, elapsed_ms, retries, ts."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tier = F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), (F.col("event_id") % 3 + 1).cast("int"))
    result = F.when((k + shift) % 10 == 0, "ProviderError").when((k + shift) % 10 < 3, "Error").otherwise("Success")
    errors = ERRORS
    error = F.when(result == "Error", F.element_at(F.array(*[F.lit(x) for x in errors]), (F.col("event_id") % 6 + 1).cast("int")))
    return e.select(
        F.col("event_id").alias("qnum"), tier.alias("tier"), result.alias("result"), F.when((k + shift) % 7 == 0, 0.0).otherwise(0.9).alias("confidence"),
        error.alias("error"), (F.col("value") * 10).alias("elapsed_ms"), (k % 3).alias("retries"), "ts",
    )


def eval_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of statements run and compared."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    table(spark, sf_dir, "region").createOrReplaceTempView("region")

    def run(sql: str) -> DataFrame | None:
        try:
            return spark.sql(sql) if sql else None
        except Exception:  # any refusal counts as an error of that side
            return None

    rows = []
    for n, generated, gold, ordered, _ in COMPARISONS:
        g = run(generated)
        rows.append((n, E.status(g, run(gold), ordered, "error" if generated and g is None else "")))
    return spark.createDataFrame(rows, "qnum int, status string")


def eval_tier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batch_metrics(runs(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def ab_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = E.ab(runs(spark, sf_dir), runs(spark, sf_dir, 1).filter("qnum % 50 <> 0"))
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def ab_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verdict(E.ab(runs(spark, sf_dir), runs(spark, sf_dir, 1)))


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("bucket", E.bucket(F.col("error"))).filter("bucket is not null")
    return r.groupBy("bucket").agg(F.count("*").alias("n"))


def run_latency_p50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("tier").agg(F.round(F.percentile("elapsed_ms", 0.5), 4).alias("p50"))


def failure_corpus_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record of each failed question, oldest first; a later correction replaces the failure."""
    r = runs(spark, sf_dir).filter("result = 'Error'").select(F.col("qnum").cast("string").alias("_id"), F.col("ts").alias("timestamp"), "error", F.lit(None).cast("string").alias("corrected_sql"))
    fixed = r.filter("qnum % 4 = 0" if "qnum" in r.columns else "cast(_id as long) % 4 = 0").withColumn("corrected_sql", F.lit("SELECT 1")).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    latest = failures.latest(r.unionByName(fixed))
    return latest.groupBy((F.col("corrected_sql").isNotNull()).alias("corrected")).agg(F.count("*").alias("n"))


def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    sql = F.when(F.col("qnum") % 2 == 0, F.lit("SELECT 1 FROM t WHERE user_id LIKE '5%'")).otherwise(F.lit("SELECT (SELECT 1), (SELECT 2), (SELECT 3)"))
    c = E.calibrate(F.lit(0.95), sql, F.col("retries"), F.col("qnum") % 3 == 0)
    return r.select(F.round(c, 4).alias("confidence")).groupBy("confidence").agg(F.count("*").alias("n"))


def error_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.concat(F.lit("Column 'c"), F.col("qnum").cast("string"), F.lit("' not found   at line "), (F.col("qnum") % 9).cast("string"))
    return runs(spark, sf_dir).select(E.error_signature(m).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        eval_multiset, eval_tier_rates, ab_regressions, ab_verdict, error_taxonomy, run_latency_p50, failure_corpus_list, confidence_calibration, error_signatures,
    )
}

_RUNS = """
r{s} AS (SELECT event_id AS qnum, ['High', 'Medium', 'Low'][(event_id % 3 + 1)::INTEGER] AS tier,
  CASE WHEN (k + {s}) % 10 = 0 THEN 'ProviderError' WHEN (k + {s}) % 10 < 3 THEN 'Error' ELSE 'Success' END AS result,
  CASE WHEN (k + {s}) % 7 = 0 THEN 0.0 ELSE 0.9 END AS confidence, value * 10 AS elapsed_ms, k % 3 AS retries
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
_R0, _R1 = _RUNS.format(s=0), _RUNS.format(s=1)
_AB = """ch AS (SELECT CASE WHEN a AND NOT b THEN 'regression' WHEN NOT a AND b THEN 'gain' ELSE 'same' END AS change FROM (
  SELECT coalesce(r0.result = 'Success' AND r0.confidence > 0, false) AS a, coalesce(r1.result = 'Success' AND r1.confidence > 0, false) AS b
  FROM r0 LEFT JOIN (SELECT * FROM r1 {w}) r1 USING (qnum)))"""

def _status(n: int, made: str, gold: str, ordered: bool, status: str) -> str:
    """The comparison in SQL: multisets by EXCEPT ALL, lists with their places; what can't be run at all is as declared."""
    if status in ("generated_error", "gold_error", "no_generated_sql"):
        return f"SELECT {n} AS qnum, '{status}' AS status"
    rows = []
    for sql in (made, gold):
        number = "CAST(round(CAST(c AS DECIMAL(38,6)), 4) AS VARCHAR)" if "_name" not in sql else "c"
        rows.append(f"SELECT {number} AS c{', row_number() OVER () AS r' if ordered else ''} FROM ({sql}) AS t(c)")
    a, b = rows
    return (
        f"SELECT {n} AS qnum, CASE WHEN (SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))) + (SELECT count(*) FROM (({b}) EXCEPT ALL ({a}))) > 0 THEN 'wrong_rows' "
        f"WHEN (SELECT count(*) FROM ({made}) AS t) = 0 THEN 'correct_empty' ELSE 'correct' END AS status"
    )


ORACLE_SQL = {
    "eval_multiset": " UNION ALL ".join(_status(*c) for c in COMPARISONS),
    "eval_tier_rates": f"""WITH {_R0} SELECT coalesce(tier, 'all') AS tier, count(*) AS n, count(*) FILTER (WHERE result = 'Success') AS success,
round(count(*) FILTER (WHERE result = 'Success') / count(*)::DOUBLE, 6) AS rate FROM r0 WHERE result <> 'ProviderError' GROUP BY ROLLUP (tier)""",
    "ab_regressions": f"WITH {_R0}, {_R1}, {_AB.format(w='WHERE qnum % 50 <> 0')} SELECT change, count(*) AS n FROM ch GROUP BY change",
    "ab_verdict": f"""WITH {_R0}, {_R1}, {_AB.format(w='')}, s AS (SELECT count(*) FILTER (WHERE change = 'regression') AS regressions, count(*) FILTER (WHERE change = 'gain') AS gains FROM ch)
SELECT regressions, gains, gains - regressions AS net, CASE WHEN gains < regressions THEN 'WORSE' WHEN gains > regressions THEN 'BETTER' ELSE 'SAME' END AS verdict FROM s""",
    "error_taxonomy": f"""WITH {_R0}, m AS (SELECT [{', '.join(f"'{e}'" for e in ERRORS)}][(qnum % 6 + 1)::INTEGER] AS m FROM r0 WHERE result = 'Error')
SELECT CASE WHEN contains(m, '(cost)') THEN 'cost' WHEN contains(m, '(schema)') THEN 'schema' WHEN contains(m, '(semantic)') THEN 'semantic' WHEN contains(m, 'placeholder') THEN 'placeholder'
  WHEN contains(m, 'ambiguous_query') OR m = 'ambiguous' THEN 'ambiguous' ELSE 'other' END AS bucket, count(*) AS n FROM m GROUP BY 1""",
    "run_latency_p50": f"WITH {_R0} SELECT tier, round(quantile_cont(elapsed_ms, 0.5), 4) AS p50 FROM r0 GROUP BY tier",
    "failure_corpus_list": f"WITH {_R0} SELECT qnum % 4 = 0 AS corrected, count(*) AS n FROM r0 WHERE result = 'Error' GROUP BY 1",
    "confidence_calibration": f"""WITH {_R0} SELECT round(0.95::DOUBLE - CASE WHEN qnum % 2 = 0 THEN 0.15 ELSE 0.10 END - 0.03 * retries - CASE WHEN qnum % 3 = 0 THEN 0.05 ELSE 0 END, 4) AS confidence, count(*) AS n FROM r0 GROUP BY 1""",
    "error_signatures": "SELECT 'column ? not found at line #' AS signature, count(*) AS n FROM events",
}
