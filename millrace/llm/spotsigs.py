"""SpotSigs document fingerprints (operator 10).

Wherever an anchor (a very common word of the language) stands, the next ``CHAIN`` content
words, skipping other anchors, form a spot signature with it. The set of a text's signatures,
as sorted 32-bit hashes, is its fingerprint; likeness is the Jaccard similarity of two sets.
Sets whose lengths alone keep them under a threshold are never compared, and a merge stops as
soon as the threshold is out of reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Anchors: fixed lists of common function words, by language.
ANCHORS = {
    "en": "the a an of to in is was it that this for on with be as by are at from and or not he she they we you his her its have has had",
    "fr": "le la les un une de des du et en est que qui dans pour pas sur au aux avec ce cette il elle son sa ses par plus ne se",
    "de": "der die das ein eine einer und in den dem des von zu mit ist auf für im sich nicht auch als an es er sie wir ihr war",
    "es": "el la los las un una de del y en que es por con para su sus al lo como más se no ha fue son esta este",
}
CHAIN, DISTANCE = 3, 1
#: Bytes of text that a range of doc_ids gets on average.
RANGE_BYTES = 256 << 20
_MARKS = b".,;:!?\"'()[]{}<>|*%&$#@~`^=+-_/\\"


def _words() -> frozenset[bytes]:
    return frozenset(w.encode() for words in ANCHORS.values() for w in words.split())


class Spotter:
    """Signature sets of texts, with a bounded memory of word hashes."""

    def __init__(self, chain: int = CHAIN, distance: int = DISTANCE):
        self.chain, self.distance, self.anchors = chain, distance, _words()
        self.memo = common.Memo(self._code)

    def _code(self, raw: bytes) -> int:
        """A word's hash; odd for anchors; 0 for chunks without letters or digits."""
        word = raw.strip(_MARKS).lower()
        if not word:
            return 0
        h = int.from_bytes(hashlib.blake2b(word, digest_size=7).digest(), "little") << 1
        return (h | 1) if word in self.anchors else (h or 2)

    def signatures(self, text: bytes) -> np.ndarray:
        """Sorted distinct uint32. In a text without a complete chain every word is a signature;
        a text without words has none."""
        chunks = text.split()
        words = np.fromiter(map(self.memo.__getitem__, chunks), dtype=np.uint64, count=len(chunks))
        words = words[words != 0]
        if not len(words):
            return np.empty(0, dtype=np.uint32)
        anchor = (words & np.uint64(1)).astype(bool)
        content = words[~anchor]
        first = np.cumsum(~anchor)[anchor]  # content words up to each anchor
        reach = (self.chain - 1) * self.distance
        ok = first + reach < len(content)
        first, mixed = first[ok], words[anchor][ok]
        for k in range(self.chain):
            mixed = (mixed ^ content[first + k * self.distance]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        if not len(mixed):
            mixed = words * np.uint64(0x9E3779B97F4A7C15)
        return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0.0 without a comparison if the lengths keep it under ``least``.

    Two empty sets are alike (1.0), an empty and another are not (0.0).
    """
    low, high = sorted((len(a), len(b)))
    if not high:
        return 1.0
    if low < least * high - 1e-9 or not low:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (low + high - both)


def digest(signatures: np.ndarray) -> str:
    """The set as a string: eight hex digits a signature, ascending."""
    return signatures.astype(">u4").tobytes().hex()


def signature_sets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and sigs (array<bigint>, ascending) for every row; null texts are empty."""
    spotter: list[Spotter] = []

    def score(texts: list[bytes]) -> list[list]:
        if not spotter:
            spotter.append(Spotter())
        return [[spotter[0].signatures(t).astype(np.int64) for t in texts]]

    return common.per_text(docs, keep, text, pa.schema([("sigs", pa.list_(pa.int64()))]), score)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id with class_id (least doc_id of the same signature set), and the pairs of classes
    (a, b, likeness) with Jaccard at ``threshold`` or more.

    Equal sets are one class, so copies make no pairs. Classes are partitioned by set length into
    ranges a factor 1 / threshold apart: only the same and the next range can match. Within those, two
    sets that match share one of their rarest signatures (of n, the first n - ceil(threshold * n) + 1 in
    order of frequency), so only these are joined; the intersection then decides. A set without
    signatures matches its equals alone. Null doc_ids are kept in members; null texts are empty; an empty table gives two empty tables.
    Products with ``threshold`` are taken a little lower, so that rounding loses no pair.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must be between 0 and 1")
    rows = common.stage(signature_sets(docs, ["doc_id"]), "spot-sets")
    keyed = rows.withColumn("set", F.sha2(F.concat_ws(",", F.col("sigs").cast("array<string>")), 256))
    least = common.stage(keyed.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")), "spot-classes")
    members = keyed.join(least.select("set", "class_id"), "set").select("doc_id", "class_id")
    sets = least.select("set", "class_id", F.explode("sigs").alias("sig"), F.size("sigs").alias("n"))
    often = sets.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = sets.join(often, "sig").withColumn("at", F.row_number().over(Window.partitionBy("set").orderBy("df", "sig")))
    prefix = ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).withColumn(
        "part", F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)) + 1e-9)
    )
    prefix = common.stage(prefix.select("set", "class_id", "sig", "n", "part"), "spot-prefix")
    a = prefix.select(F.col("set").alias("sa"), "sig", F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("pa"))
    b = prefix.select(F.col("set").alias("sb"), "sig", F.col("n").alias("nb"), "part")
    meet = (a["sig"] == b["sig"]) & (a["part"] == b["part"]) & (
        (F.col("pa") < b["part"]) | (F.col("sa") < F.col("sb"))
    ) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    found = a.join(b, meet).select("sa", "sb").distinct()
    left = least.select(F.col("set").alias("sa"), F.col("class_id").alias("a"), F.col("sigs").alias("xa"))
    right = least.select(F.col("set").alias("sb"), F.col("class_id").alias("b"), F.col("sigs").alias("xb"))
    shared = F.size(F.array_intersect("xa", "xb"))
    alike = shared / (F.size("xa") + F.size("xb") - shared)
    pairs = found.join(left, "sa").join(right, "sb").select("a", "b", alike.alias("likeness")).filter(F.col("likeness") >= threshold - 1e-12)
    return members, pairs


def _ordered_parts(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) with p below 2 * ``parts``, a range of doc_ids; ranges ascend, nulls come last. Cut points come
    from a sketch of all ids; one point a partition comes to the driver."""
    from pyspark.ml.feature import Bucketizer

    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] if parts > 1 else []
    splits = [float("-inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    with_id = docs.withColumn("__d", F.col("doc_id").cast("double"))
    parts = max(2, parts)
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    out = Bucketizer(splits=splits, inputCol="__d", outputCol="__p", handleInvalid="keep").transform(with_id)
    # Rows without an id are in order of their text's hash; its upper half deals them into as many ranges.
    upper = F.shiftright(F.xxhash64("text"), 32) + F.lit(1 << 31)
    return out.withColumn(
        "p", F.when(F.col("doc_id").isNull(), parts + F.shiftright(upper * F.lit(parts), 32)).otherwise(F.col("__p")).cast("int")
    ).drop("__d", "__p")


def edited_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document by doc_id (null ids last, ties by text); the first document follows
    the last. Texts are shuffled once, into ranges of doc_id; each range is read in order beside
    one more row, the first of the next range. Null texts are empty. A single document is its own next; repeated rows follow each
    other; an empty table gives no rows. Columns besides doc_id and text aren't read. The number of ranges comes from the counted bytes.
    """
    parts = max(2, common.ranges(docs, RANGE_BYTES))
    rows = _ordered_parts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), parts)
    order: list[Column] = [F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")]
    heads = rows.groupBy("p").agg(F.min_by("text", F.struct(*order)).alias("text"))
    heads = common.stage(heads, "spot-heads")
    every = Window.orderBy("p")
    end = F.last("p").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # The ranges' numbers alone are put in order; the head of a range stands behind the last row of the range before it.
    before = heads.select("p", F.coalesce(F.lag("p").over(every), end).alias("to"))
    tails = heads.join(before, "p").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("p"), F.lit(True).alias("tail"))
    dealt = rows.withColumn("tail", F.lit(False)).unionByName(tails)
    dealt = dealt.repartitionById(2 * parts, F.col("p")).sortWithinPartitions("p", "tail", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    fields = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter, held = Spotter(), None
        for batch in batches:
            out = []
            for doc_id, text, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                now = (doc_id, text, spotter.signatures(text.encode()))
                if held:
                    half = len(held[1]) // 2
                    edited = (held[1][: len(held[1]) - half] + text[:half]).encode()
                    own, changed = held[2], spotter.signatures(edited)
                    out.append(
                        (held[0], len(held[1]), hashlib.sha256(edited).hexdigest(), digest(own), digest(changed), likeness(own, changed), likeness(own, now[2]))
                    )
                held = None if tail else now
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(fields), fields, strict=True)], schema=fields)

    from pyspark.sql.pandas.types import from_arrow_schema

    return dealt.select("doc_id", "text", "p", "tail").mapInArrow(run, from_arrow_schema(fields))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts, see :func:`edited_report`."""
    return edited_report(common.documents(spark, sf_dir))
