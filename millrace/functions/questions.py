"""Understanding questions as column expressions: rewriting, intent, entities, codes, quantifiers, requirements."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

#: Abbreviations and what they stand for. Fixed values.
ABBREVIATIONS = {
    "qty": "quantity", "amt": "amount", "avg": "average", "num": "number", "no. of": "number of", "cust": "customer", "ord": "order", "max": "maximum", "min": "minimum", "pct": "percent", "dept": "department",
}
#: Intents in order of precedence, and the words that speak for them. Fixed values.
INTENTS = {
    "aggregation": ("how many", "count", "total", "average", "sum", "maximum", "minimum", "number of"),
    "temporal": ("when", "last month", "this year", "since", "before", "after", "trend"),
    "status": ("status", "pending", "open", "closed", "state of"),
    "comparison": ("compare", "versus", " vs ", "more than", "less than", "difference"),
    "relationship": ("related", "belongs to", "linked", "associated", "of each"),
    "lookup": ("show", "list", "find", "which", "who", "get"),
}
NEGATIONS = r"(?i)\b(no|not|never|without|none|nobody|neither|except|lacking|missing|un\w+ed)\b"
QUANTIFIERS = {"all": r"(?i)\b(all|every|each)\b", "any": r"(?i)\b(any|some|at least one)\b", "none": r"(?i)\b(no|none|never)\b", "exactly": r"(?i)\b(exactly|only)\b", "most": r"(?i)\b(most|top|highest|largest|best)\b"}


def expand(question: Column, words: dict[str, str] | None = None) -> Column:
    """Abbreviations written out, longest first, at word bounds."""
    words = ABBREVIATIONS if words is None else words
    return reduce(
        lambda c, k: F.regexp_replace(c, rf"(?i)(?<!\w){re.escape(k)}(?!\w)", words[k]), sorted(words, key=lambda k: (-len(k), k)), question
    )


def intent(question: Column) -> Column:
    """The intent with most keyword hits; ties by order; lookup without any hit."""
    q = F.lower(question)
    scores = {name: reduce(lambda a, b: a + b, [q.contains(w).cast("int") for w in words]) for name, words in INTENTS.items()}
    best = F.greatest(*scores.values())
    out = F.when(best == 0, "lookup")
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out


def status_codes(question: Column, vocabulary: list[str]) -> Column:
    """Upper-case words or quoted strings that are in the vocabulary, in order, once each."""
    upper = F.regexp_extract_all(question, F.lit(r"\b([A-Z_]{2,})\b"), F.lit(1))
    quoted = F.transform(F.regexp_extract_all(question, F.lit(r"'([^']+)'"), F.lit(1)), lambda x: F.upper(x))
    return F.array_intersect(F.concat(upper, quoted), F.array(*[F.lit(v) for v in vocabulary]))


def quantifiers(question: Column) -> Column:
    return F.filter(F.array(*[F.when(question.rlike(p), F.lit(n)) for n, p in QUANTIFIERS.items()]), lambda x: x.isNotNull())


def negative(question: Column) -> Column:
    """Whether a question asks for what isn't there."""
    return question.rlike(NEGATIONS)


def grouping(question: Column) -> Column:
    """The word after "per", "by" or "for each"; empty without one."""
    return F.lower(F.regexp_extract(question, r"(?i)\b(?:per|by|for each|for every)\s+(?:the\s+)?([a-z_]+)", 1))


def aggregate_intent(question: Column) -> Column:
    q = F.lower(question)
    return (
        F.when(q.rlike(r"\b(percent|percentage|share of|ratio)\b|%"), "percent")
        .when(q.rlike(r"\b(average|mean)\b"), "average")
        .when(q.rlike(r"\b(how many|number of|count)\b"), "count")
        .when(q.rlike(r"\b(total|sum)\b"), "sum")
        .when(q.rlike(r"\b(highest|maximum|largest|latest)\b"), "max")
        .when(q.rlike(r"\b(lowest|minimum|smallest|earliest)\b"), "min")
    )


#: Words before a number, and the comparison that they ask for. Fixed values.
COMPARISONS = {
    ">=": "at least|no less than|not less than|minimum of", "<=": "at most|no more than|not more than|up to|maximum of", ">": "more than|greater than|over|above|exceeding|higher than|after|longer than",
    "<": "less than|fewer than|under|below|lower than|before|shorter than", "=": "exactly|equal to|equals",
}


def comparisons(question: Column) -> Column:
    """array<struct<op, value>>: the numbers that a question compares with; both ends of "between x and y"."""
    number = r"(?:\s+than)?\s+(?:of\s+)?(?:\$\s*)?(-?\d+(?:\.\d+)?)(?![\w.]*\w)"
    q, rest, found = F.lower(question), F.lower(question), []

    def tagged(values: Column, op: str) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(op).alias("op"), x.cast("double").alias("value")))

    for op, words in COMPARISONS.items():  # the longer phrases first, which are then taken out
        each = F.regexp_extract_all(rest, F.lit(rf"\b(?:{words}){number}"), F.lit(1))
        found.append(tagged(each, op))
        rest = F.regexp_replace(rest, rf"\b(?:{words}){number}", " ")
    for op, group in ((">=", 1), ("<=", 2)):
        ends = F.regexp_extract_all(q, F.lit(r"\bbetween\s+(-?\d+(?:\.\d+)?)\s+and\s+(-?\d+(?:\.\d+)?)"), F.lit(group))
        found.append(tagged(ends, op))
    return F.concat(*found)


def requirements(question: Column) -> Column:
    """What a question asks for, as one struct."""
    numbers = F.transform(F.regexp_extract_all(question, F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])"), F.lit(1)), lambda x: x.cast("double"))
    outputs = F.transform(
        F.split(F.regexp_extract(question, r"(?i)\b(?:including|with|show|list)\s+(?:the\s+|their\s+)?([a-z_ ,]+?)(?:\s+(?:for|of|per|by|where|in|from)\b|[.?]|$)", 1), r"\s*(?:,|\band\b)\s*"),
        lambda x: F.lower(F.trim(x)),
    )
    return F.struct(
        negative(question).alias("negative"),
        aggregate_intent(question).alias("aggregate"),
        F.nullif(grouping(question), F.lit("")).alias("grouping"),
        quantifiers(question).alias("quantifiers"),
        numbers.alias("numbers"),
        comparisons(question).alias("comparisons"),
        F.regexp_extract_all(question, F.lit(r"'([^']*)'"), F.lit(1)).alias("literals"),
        F.filter(outputs, lambda x: (x != "") & (F.size(F.split(x, " ")) <= 6)).alias("outputs"),
    )


def _grams(questions: DataFrame, most: int) -> DataFrame:
    """(query_id, at, n, term): the runs of 1 to ``most`` words of each question."""
    words = questions.select("query_id", T.tokens(F.col("question")).alias("w"))
    out = None
    for n in range(1, most + 1):
        each = words.filter(F.size("w") >= n).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - n))).select(
            "query_id", "at", F.lit(n).alias("n"), F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("term")
        )
        out = each if out is None else out.unionByName(each)
    return out


def entities(questions: DataFrame, terms: DataFrame, most: int = 5, least: float | None = None) -> DataFrame:
    """(query_id, entities): tables named in each question, without overlaps, at most ``most``: those of exact terms first, in the question's
    order (of overlapping terms the longest), then, with ``least``, those of similar ones.

    questions: query_id, question. terms: term (lower case), table_name; the vocabulary of a schema, broadcast below
    Spark's threshold. Terms of one to three words are looked up among the question's word runs; a run that overlaps a longer one that
    matched is dropped. Runs of one or two words and four letters or more that overlap no match are compared with all terms by token-sort ratio, and the best
    term at ``least`` or more counts.
    """
    grams = _grams(questions, 3)
    hits = grams.join(terms, "term")
    overlaps = (F.col("h.query_id") == F.col("l.query_id")) & (F.col("l.at") < F.col("h.at") + F.col("h.n")) & (F.col("h.at") < F.col("l.at") + F.col("l.n"))
    spans = hits.select("query_id", "at", "n").distinct()
    kept = hits.alias("h").join(spans.alias("l"), overlaps & (F.col("l.n") > F.col("h.n")), "left_anti").withColumn("late", F.lit(0))
    if least is not None:
        free = _grams(questions, 2).filter("length(term) >= 4").alias("h").join(spans.alias("l"), overlaps, "left_anti")
        free = free.withColumn("sorted", T.token_sort(F.col("term")))
        near = similar(free.select(F.col("sorted").alias("token")).distinct(), terms.select(F.col("term").alias("code")).distinct(), least)
        best = Window.partitionBy("token").orderBy(F.col("score").desc(), "code")
        near = near.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(F.col("token").alias("sorted"), F.col("code").alias("like"))
        fuzzy = free.join(near, "sorted").select("query_id", "at", "n", F.col("like").alias("term")).join(terms, "term")
        kept = kept.select("query_id", "at", "n", "table_name", "late").unionByName(fuzzy.select("query_id", "at", "n", "table_name", F.lit(1).alias("late")))
    first = kept.groupBy("query_id", "table_name").agg(F.min(F.struct("late", "at")).alias("at"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "table_name"))).filter(F.col("k") <= most)
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "table_name"))), lambda s: s["table_name"]).alias("entities"))


def similar(tokens: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """(token, code, score): all pairs of a ratio of ``least`` or more between a token and a code with its words in order.

    Tokens aren't compared with all codes, but no pair is lost: a ratio of ``least`` allows k = floor((1 - least / 100) * longest) edits,
    which bounds the lengths; and of k + 1 pieces of the code one stands unchanged in the token, at most k letters away.
    """
    r = max(least, 1.0) / 100
    lengths = lambda c: F.sequence(F.greatest(F.lit(1), F.ceil(F.length(c) * r - 1e-9)).cast("int"), F.floor(F.length(c) / r + 1e-9).cast("int"))
    edits = F.floor(F.greatest("m", "n") * (1 - r) + 1e-9).cast("int")
    start = lambda i: F.floor(i * F.col("m") / (F.col("k") + 1)).cast("int")
    size = start(F.col("i") + 1) - start(F.col("i"))
    listed = codes.select("code", T.token_sort(F.col("code")).alias("c"))
    pieces = lambda df: df.withColumn("k", edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    w = pieces(tokens.select("token").filter("length(token) > 0").distinct().withColumn("n", F.length("token")).withColumn("m", F.explode(lengths("token"))))
    w = w.withColumn("at", F.explode(F.sequence(start(F.col("i")) - F.col("k"), start(F.col("i")) + F.col("k"))))
    w = w.filter((F.col("at") >= 0) & (F.col("at") + size <= F.col("n")))
    c = pieces(listed.filter("length(c) > 0").withColumn("m", F.length("c")).withColumn("n", F.explode(lengths("c"))))
    w = w.select("token", "m", "n", "i", F.col("token").substr(F.col("at") + 1, size).alias("piece")).distinct()
    c = c.select("code", "c", "m", "n", "i", F.col("c").substr(start(F.col("i")) + 1, size).alias("piece"))
    near = w.join(c, ["m", "n", "i", "piece"]).select("token", "code", "c").distinct()
    return near.select("token", "code", T.ratio(F.col("token"), F.col("c")).alias("score")).filter(F.col("score") >= least)


def fuzzy_codes(questions: DataFrame, codes: DataFrame, least: float = 85.0) -> DataFrame:
    """(query_id, token, code, score): the best code for each word of four letters or more, by token-sort ratio; no pair is lost (:func:`similar`)."""
    words = questions.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("token")).filter("length(token) >= 4")
    pairs = words.join(similar(words.select("token"), codes, least), "token").select("query_id", "token", "code", "score")
    best = Window.partitionBy("query_id", "token").orderBy(F.col("score").desc(), "code")
    return pairs.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def glossary_expansion(questions: DataFrame, glossary: DataFrame) -> DataFrame:
    """(query_id, expanded): the question with the definitions of its glossary terms appended, never substituted.

    glossary: term, definition and, if there are any, aliases (array). A term or alias counts as whole words only, in one go
    over the question's runs of up to five words.
    """
    names = F.array(F.col("term")) if "aliases" not in glossary.columns else F.concat(F.array(F.col("term")), F.coalesce("aliases", F.array().cast("array<string>")))
    listed = glossary.select(F.explode(names).alias("name"), "definition").select(F.array_join(T.tokens(F.col("name")), " ").alias("term"), "definition").filter("term <> ''")
    hits = _grams(questions, 5).join(listed, "term")
    notes = hits.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("definition")), "; ").alias("notes"))
    return questions.join(notes, "query_id", "left").select(
        "query_id", F.when(F.col("notes").isNull(), F.col("question")).otherwise(F.concat_ws(" | ", "question", "notes")).alias("expanded")
    )


def schema_vocabulary(columns: DataFrame) -> DataFrame:
    """(word, table_name) from the parts of table and column names, of three letters or more."""
    parts = columns.select("table_name", F.explode(F.split(F.concat_ws("_", "table_name", "column_name"), "_")).alias("word"))
    return parts.filter("length(word) >= 3").select("word", "table_name").distinct()


def label_filters(question: str, triggers: tuple[str, ...] = ("named", "called", "code", "id", "number")) -> list[str]:
    """Labels that follow a trigger word within 30 characters: an alphanumeric token that isn't all digits."""
    out = []
    for m in re.finditer(rf"(?i)\b({'|'.join(triggers)})\b", question):
        found = re.search(r"\b(?=\w*[A-Za-z])(?=\w*[\d_-]|[A-Z])[\w-]+", question[m.end() : m.end() + 30])
        if found and found[0] not in out:
            out.append(found[0])
    return out


def parse_answer(text: str) -> dict | None:
    """The JSON object of a model's answer: whole, fenced, the widest braces, or the sql field alone; None without any SQL."""
    import json

    tries = [text]
    if m := re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S):
        tries.append(m[1])
    if "{" in text and "}" in text:
        tries.append(text[text.index("{") : text.rindex("}") + 1])
    for t in tries:
        try:
            found = json.loads(t)
            if isinstance(found, dict) and found.get("sql"):
                return found
        except ValueError:
            pass
    if m := re.search(r'"sql"\s*:\s*"((?:[^"\\]|\\.)*)"', text, re.S):
        return {"sql": m[1].replace('\\"', '"').replace("\\n", "\n"), "partial": True}
    if m := re.search(r"```sql\s*(.*?)```", text, re.S):
        return {"sql": m[1].strip(), "partial": True}
    if m := re.match(r"(?is)\s*((?:select|with)\b.*)", text):
        return {"sql": m[1].strip(), "partial": True}
    return None


def error_tables(message: Column, tables: list[str]) -> Column:
    """Catalog tables that an error message mentions, alphabetically."""
    words = F.regexp_extract_all(F.lower(message), F.lit(r"([a-z_][a-z0-9_]*)"), F.lit(1))
    return F.array_sort(F.array_intersect(words, F.array(*[F.lit(t) for t in tables])))
