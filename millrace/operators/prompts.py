"""What a model is given: ordered context sections, the column cheatsheet, and the context of a correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.questions import similar

#: Sections in their order, and the chunk types that fill them; those without come as extras, whose part has the section's name. Fixed values.
SECTIONS = (
    ("schema", ("TABLE", "VIEW")), ("join map", ("FK_MAP",)), ("rules", ("BUSINESS_RULE",)), ("workflow", ("WORKFLOW", "STATUS")), ("conditional", ("AUDIT", "PARTITION", "INDEX")),
    ("glossary", ("GLOSSARY",)), ("join paths", ()), ("recipes", ()), ("additional", ()), ("examples", ("FEW_SHOT",)), ("security", ()), ("hints", ()), ("clarification", ()),
    ("cheatsheet", ()), ("question", ()),
)
#: Words of a question that call for the blocks that are only shown then. Fixed values.
TRIGGERS = {
    "AUDIT": ("audit", "history", "log", "changed", "change", "who"), "PARTITION": ("partition", "archive", "archived", "old"), "INDEX": ("index", "slow", "fast", "performance", "search"),
}
NAMES = [name for name, _ in SECTIONS]


def section(chunk_type: Column) -> Column:
    """The number of the section a chunk type belongs to; unknown types are additional."""
    out = F.lit(NAMES.index("additional"))
    for i, (_, kinds) in reversed(list(enumerate(SECTIONS))):
        if kinds:
            out = F.when(chunk_type.isin(*kinds), i).otherwise(out)
    return out


def called_for(hits: DataFrame, questions: DataFrame, entities: DataFrame) -> DataFrame:
    """``hits`` (query_id, chunk_type, table_name, ..) without blocks that nothing calls for: a type of ``TRIGGERS`` stays where its table is among the
    question's (entities: query_id, table_name) or one of its words is in the question (questions: query_id, question)."""
    words = questions.select("query_id", T.tokens(F.col("question")).alias("_words"))
    own = entities.select("query_id", "table_name").distinct().withColumn("_own", F.lit(True))
    marked = hits.join(words, "query_id", "left").join(own, ["query_id", "table_name"], "left")
    keep = ~F.col("chunk_type").isin(*TRIGGERS) | F.coalesce("_own", F.lit(False))
    for kind, found in TRIGGERS.items():
        said = F.arrays_overlap(F.coalesce("_words", F.array().cast("array<string>")), F.array(*[F.lit(w) for w in found]))
        keep = keep | ((F.col("chunk_type") == kind) & said)
    return marked.filter(keep).select(*hits.columns)


def assemble(hits: DataFrame, extras: DataFrame) -> DataFrame:
    """(query_id, prompt): each query's chunks, once each, and the extras, in section order then rank. The question is fenced.

    hits: query_id, chunk_id, chunk_type, text, rank. extras: query_id, part (a section's name), text; other parts are left out.
    A query's chunks are the dozen that the budget left, so collecting them in one row is bounded.
    """
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    once = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    kinds = F.array(*[F.lit(n) for n in NAMES])
    parts = once.select(
        "query_id", section(F.col("chunk_type")).alias("s"), "rank", F.concat(F.lit("## "), F.get(kinds, section(F.col("chunk_type"))), F.lit("\n"), "text").alias("t")
    )
    place = F.array_position(kinds, F.col("part")).cast("int") - 1
    body = F.when(F.col("part") == "question", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    more = extras.select("query_id", place.alias("s"), F.lit(-1).alias("rank"), F.concat(F.lit("## "), "part", F.lit("\n"), body).alias("t")).filter("s >= 0")
    listed = parts.unionByName(more).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("s", "rank", "t"))).alias("l"))
    return listed.select("query_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("prompt"))


def cheatsheet(scope: DataFrame, columns: DataFrame) -> DataFrame:
    """(query_id, text): the exact columns of every table in scope, entities first. scope: query_id, table_name, first (boolean);
    columns: the catalog's column table. Tables that the catalog doesn't have are left out."""
    line = F.concat_ws(" ", "column_name", F.upper("type"), F.when(F.col("is_pk"), "PK"), F.when(F.col("allowed").isNotNull(), F.concat(F.lit("ONE OF "), F.array_join("allowed", ", "))))
    per = columns.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("line"))
    wanted = scope.groupBy("query_id", "table_name").agg(F.max("first").alias("first"))
    rows = wanted.join(per, "table_name").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((~F.col("first")).alias("later"), "table_name", "line"))).alias("l")
    )
    return rows.select("query_id", F.array_join(F.transform("l", lambda x: F.concat(x["table_name"], F.lit(": "), x["line"])), "\n").alias("text"))


def correction_context(mentions: DataFrame, chunks: DataFrame, least: float = 60.0, others: int = 3) -> DataFrame:
    """(query_id, chunk_id, place): for the (mis-spelt) tables of an error: their TABLE chunks, FK_MAP chunks, other chunks, then a few of other tables.

    mentions: query_id, name. chunks: chunk_id, chunk_type, table_name. Names are resolved to the most similar table at ``least`` or more. The few
    others are the first by chunk_id; they are among the first of as many tables as a query can name and ``others`` more, so that no query meets all chunks.
    """
    named = mentions.select("query_id", "name", T.token_sort(F.col("name")).alias("token"))
    near = similar(named.select("token").distinct(), chunks.select(F.col("table_name").alias("code")).distinct(), least)
    best = Window.partitionBy("query_id", "name").orderBy(F.col("score").desc(), "code")
    found = named.join(near, "token").withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("query_id", F.col("code").alias("table_name")).distinct()
    kind = F.when(F.col("chunk_type") == "TABLE", 0).when(F.col("chunk_type") == "FK_MAP", 1).otherwise(2)
    own = found.join(chunks, "table_name").select("query_id", "chunk_id", kind.alias("group"))
    own_tables = found.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    each = Window.partitionBy("table_name").orderBy("chunk_id")
    pool = chunks.select("chunk_id", "table_name").withColumn("_n", F.row_number().over(each)).filter(F.col("_n") <= others)
    pool = pool.orderBy("chunk_id").limit(others * (int(own_tables) + 1)).drop("_n")
    rest = mentions.select("query_id").distinct().crossJoin(F.broadcast(pool)).join(found, ["query_id", "table_name"], "left_anti")  # others * (tables + 1) rows
    w = Window.partitionBy("query_id").orderBy("chunk_id")
    few = rest.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= others).select("query_id", "chunk_id", F.lit(3).alias("group"))
    order = Window.partitionBy("query_id").orderBy("group", "chunk_id")
    return own.unionByName(few).select("query_id", "chunk_id", (F.row_number().over(order) - 1).alias("place"))
