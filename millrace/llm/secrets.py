"""Secret scans (operator 7) with DataFrame functions only.

Three plain patterns give the base spans. The method adds spans by Shannon entropy: candidate
strings of a character class are slid over by a window whose symbol counts are kept
incrementally (one symbol comes in, one goes out, and the sum of c * log2 c is adjusted by the
two counts that change); the stretch from the first to the last window over the threshold is reported, unless what stands in
that stretch is on the allow-list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base kinds in their order. Pattern, group that must be long enough, least length.
#: For access and hex the length stands in the pattern: their matches are whole runs, so shorter ones only get skipped.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}+", 0, 20),
    "hex": (r"[0-9a-f]{24,}+", 0, 24),
}
#: A cheap test that every text with a match passes.
_MAY = {
    "assign": r"(?i)password|passwd|secret|token|api_?key",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
#: Entropy kinds: pattern of whole runs of the class, window, least entropy in bits. Runs are matched without
#: going back, so that texts of one very long run take linear time; a candidate holds digits and letters.
ENTROPY = {
    "entropy_hex": (r"(?:(?<![0-9A-Za-z])|(?<=(?<![0-9A-Za-z])0[xX]))[0-9A-Fa-f]{16,}+(?![0-9A-Za-z])", 16, 2.8),
    "entropy_base64": (r"[A-Za-z0-9+/_-]{20,}+", 20, 3.7),
}
#: Stretches that are no secrets: documented examples, sequences, one symbol repeated.
ALLOWED = (
    r"(?i:example|placeholder|changeme|dummy|your[-_]?(key|token|secret))",
    r"(?i:0123456789|1234567890|abcdefghij|deadbeef)",
    r"(?<same>.)\k<same>{7}",
)


def _located(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, found>> of the matches whose group has ``least`` characters, in code points.

    The pieces between matches and the matches themselves are measured and added up.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # Zipped, each array is made once; the last gap stands behind the last match and is left over.
    matches = F.zip_with(found, tested, lambda m, g: F.struct(m.alias("found"), (F.length(g) >= least).alias("keep")))
    steps = F.filter(
        F.zip_with(
            matches,
            F.split(text, pattern, -1),
            lambda m, gap: F.struct(F.length(gap).alias("gap"), m["found"].alias("found"), m["keep"].alias("keep")),
        ),
        lambda s: s["found"].isNotNull(),
    )
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def add(a: Column, s: Column) -> Column:
        start = a["pos"] + s["gap"]
        end = start + F.length(s["found"])
        span = F.struct(start.alias("start"), end.alias("end"), s["found"].alias("found"))
        return F.struct(end.alias("pos"), F.when(s["keep"], F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("pos"), none.alias("spans")), add, lambda a: a["spans"])


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def high_entropy(candidate: Column, window: int, least: float) -> Column:
    """struct<first, last>: where (from 0) the first and the last window of ``least`` bits or more begin; null if none does."""
    codes = F.transform(F.split(candidate, ""), lambda ch: F.ascii(ch))
    start = F.struct(
        codes.alias("codes"),
        F.array_repeat(F.lit(0), 128).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    whole = F.lit(float(window))

    def slide(a: Column, i: Column) -> Column:
        # i counts from 1; the symbol at i comes in, the one at i - window (if any: else no symbol, -1) goes out.
        came, gone = F.get(a["codes"], i - 1), F.when(i > window, F.get(a["codes"], i - 1 - window)).otherwise(-1)
        c_in, c_out = F.get(a["counts"], came), F.when(gone >= 0, F.get(a["counts"], gone)).otherwise(0)
        total = F.when(came == gone, a["sum"]).otherwise(
            a["sum"] + _clog(c_in + 1) - _clog(c_in) + F.when(gone >= 0, _clog(c_out - 1) - _clog(c_out)).otherwise(0.0)
        )
        counts = F.when(came == gone, a["counts"]).otherwise(
            F.transform(a["counts"], lambda v, k: v + F.when(k == came, 1).when(k == gone, -1).otherwise(0))
        )
        over = (i >= window) & (F.log2(whole) - total / whole >= least)
        at = i - window
        return F.struct(
            a["codes"].alias("codes"),
            counts.alias("counts"),
            total.alias("sum"),
            F.when(over & a["first"].isNull(), at).otherwise(a["first"]).alias("first"),
            F.when(over, at).otherwise(a["last"]).alias("last"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.length(candidate)), start, slide, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last"))
    )


def spans(text: Column, allowed: tuple[str, ...] = ALLOWED) -> tuple[dict[str, Column], Column]:
    """({base kind: array of spans}, array of entropy spans); all as struct<start, k, end>, k the kind's place."""
    empty = F.array().cast("array<struct<start:int,k:int,end:int>>")
    place = {kind: k for k, kind in enumerate((*BASE, *ENTROPY))}

    def plain(kind: str) -> Column:
        pattern, group, least = BASE[kind]
        found = F.transform(
            _located(text, pattern, group, least),
            lambda s: F.struct(s["start"].alias("start"), F.lit(place[kind]).alias("k"), s["end"].alias("end")),
        )
        return F.when(F.rlike(text, F.lit(_MAY[kind])), found).otherwise(empty)

    def dense(kind: str) -> Column:
        pattern, window, least = ENTROPY[kind]
        listed = F.lit("|".join(f"(?:{a})" for a in allowed) or "(?!)")
        scored = F.transform(
            F.filter(
                _located(text, pattern, 0, window),
                lambda s: F.rlike(s["found"], F.lit("[0-9]")) & F.rlike(s["found"], F.lit("[A-Za-z]")),
            ),
            lambda s: F.struct(s["start"].alias("at"), s["found"].alias("found"), high_entropy(s["found"], window, least).alias("h")),
        )
        stretch = lambda s: F.substr(s["found"], s["h"]["first"] + 1, s["h"]["last"] - s["h"]["first"] + window)
        over = F.transform(
            F.filter(scored, lambda s: s["h"]["first"].isNotNull() & ~F.rlike(stretch(s), listed)),
            lambda s: F.struct(
                (s["at"] + s["h"]["first"]).alias("start"), F.lit(place[kind]).alias("k"), (s["at"] + s["h"]["last"] + window).alias("end")
            ),
        )
        return F.when(F.rlike(text, F.lit(pattern)), over).otherwise(empty)

    return {kind: plain(kind) for kind in BASE}, F.concat(*[dense(kind) for kind in ENTROPY])


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*BASE, *ENTROPY)])
    return F.array_join(
        F.transform(
            F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def secret_report(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_assign, n_access, n_hex, base_sha256, spans for every row; a null text is empty and has no spans.

    Texts are scanned whole, however long; repeated rows are scanned each; spans that start together are in the kinds' order; an
    empty table gives no rows. Columns besides ``keep`` and the text aren't read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base, more = spans(body)
    # Exploding an array of one keeps the optimizer from copying the spans into every column made of them.
    made = F.struct(*[base[k].alias(k) for k in BASE], more.alias("more"))
    found = docs.select(*keep, F.explode(F.array(made)).alias("__s"))
    both = F.concat(*[F.col(f"__s.{k}") for k in BASE])
    return found.select(
        *keep,
        *[F.size(f"__s.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(both), 256).alias("base_sha256"),
        _listed(F.concat(both, F.col("__s.more"))).alias("spans"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and what :func:`secret_report` finds for every row of ``documents``."""
    return secret_report(common.documents(spark, sf_dir), ["doc_id"])
