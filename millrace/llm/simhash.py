"""SimHash near-duplicates by multi-index hashing (operator 2).

Every document gets a 64-bit SimHash of its word 3-shingles. Two fingerprints link when at
most ``RADIUS`` (3) bits differ. With two 32-bit segments, the pigeonhole rule says that some
segment differs in at most one bit, so the ball of radius 1 around each segment value is
enumerated, looked up in the table of segment values, and the complete distance is verified.
All work is on *distinct* fingerprints: exact copies meet in a plain aggregate.

Near copies of a few edits differ in more bits than that. :func:`keep_one` therefore also links texts whose sets of
word 5-shingles have a Jaccard similarity of ``LEAST`` (0.8) or more: bands of min-hashes propose pairs, and the complete sets decide.

Segment values shared by more than ``dense`` fingerprints would make quadratically many
pairs. Those go another, linear and exact way: see :func:`_dense_links`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS = 3
SEGMENT = 0xFFFFFFFF
#: Segment values with more distinct fingerprints than this take the linear way.
DENSE = 512
#: Similar texts: Jaccard of word shingles, proposed by bands of min-hashes (a pair at 0.8 is missed by all 16 once in 96,000).
LEAST, WIDE_SHINGLE, BANDS, PER_BAND = 0.8, 5, 16, 3
#: In bands shared by more distinct texts than this, each is compared with two hubs and a hashed group of about ``GROUP`` first; what
#: that leaves apart goes to :func:`crowd_links`, in shares of ``SHARE`` texts, by parities of ``SKETCH`` words of 64 bits.
CROWD, GROUP, SHARE, SKETCH = 64, 8, 512, 16
_LANES = np.uint64(0x0101010101010101)


def shingles(text: bytes, shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, or of all words where there are fewer; none for a wordless text."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=n)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text: a bit is 1 if set in over half of the hashes of its shingles."""
    hashes = shingles(text, shingle)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, counted in byte lanes of 255 hashes at a time."""
    n = len(hashes)
    counts = np.zeros((8, 8), dtype=np.int64)
    for low in range(0, n, 255 * 64):
        block = hashes[low : low + 255 * 64]
        starts = np.arange(0, len(block), 255)
        for bit in range(8):
            lanes = np.add.reduceat((block >> np.uint64(bit)) & _LANES, starts)
            counts[bit] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    out = 0
    for bit in range(8):
        for byte in range(8):
            if 2 * counts[bit, byte] > n:
                out |= 1 << (8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fp`` (signed 64-bit) for every row; a null or wordless text has fingerprint 0."""

    def score(texts: list[bytes]) -> list[list]:
        found = [fingerprint(t, shingle) for t in texts]
        return [[x - (1 << 64) if x >> 63 else x for x in found]]

    return common.per_text(docs, keep, text, pa.schema([("fp", pa.int64())]), score)


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit(SEGMENT))


def _ball(value: Column, bits: int = 32) -> Column:
    """The value and all values at one bit's distance."""
    flips = F.array(*[F.lit(1 << b) for b in range(bits)])
    return F.concat(F.array(value), F.transform(flips, lambda m: value.bitwiseXOR(m)))


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at distance 1 to 3; enough of them that components are exact.

    ``fps`` has one column ``fp`` without repeats. Every pair within the radius whose segment
    bucket isn't dense is an edge itself; pairs in dense buckets are joined through a hub.
    """
    table = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("seg"), _segment(F.col("fp"), k).alias("val")) for k in (0, 1)])
        ).alias("s"),
    ).select("fp", "s.seg", "s.val")
    sizes = table.groupBy("seg", "val").agg(F.count("*").alias("n")).filter(F.col("n") > dense).select("seg", "val")
    # At most 2 * |fps| / dense values; a sort-merge join is as good where they are many.
    heavy = common.stage(sizes, "mih-heavy")
    light = table.join(heavy, ["seg", "val"], "left_anti")
    # A pair at distance 1 in the segment meets from the side that has the bit set: it is enough to clear bits.
    clear = F.filter(_ball(F.col("val")), lambda v: v <= F.col("val"))
    probe = table.select("fp", "seg", F.explode(clear).alias("val"))
    distance = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp")))
    meets = (
        (F.col("p.seg") == F.col("t.seg"))
        & (F.col("p.val") == F.col("t.val"))
        & (F.col("p.fp") != F.col("t.fp"))
        & (distance <= RADIUS)
    )
    pairs = (
        probe.alias("p")
        .join(light.alias("t"), meets)
        .select(F.least("p.fp", "t.fp").alias("a"), F.greatest("p.fp", "t.fp").alias("b"))
    )
    if heavy.isEmpty():
        return pairs
    return pairs.unionByName(_dense_links(table, heavy))


def _dense_links(table: DataFrame, heavy: DataFrame) -> DataFrame:
    """Edges for the pairs in dense buckets, linear in the number of fingerprints there.

    Let the other 32 bits be the rest. Fingerprints whose segment equals v may differ in 3 bits
    of the rest; those at one bit from v in 2 more bits. Two rests are within 3 bits if and only
    if some x is within 1 bit of one and 2 of the other; within 2 bits if and only if some x is
    within 1 of both. So every fingerprint announces itself at the x of its ball, as *near*
    (centre or 1 bit) or *far* (2 bits), and all that meet at an x with a near one hang on the least near one: every
    such edge is a true link or joins two fingerprints that both link to that near one.
    """
    rest = F.when(F.col("seg") == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    exact = table.join(heavy, ["seg", "val"], "left_semi").select(
        "seg", F.col("val").alias("at"), F.lit(0).alias("off"), "fp", rest.alias("rest")
    )
    beside = (
        table.select(
            "fp", "seg", rest.alias("rest"), F.explode(F.slice(_ball(F.col("val")), 2, 32)).alias("val")
        )
        .join(heavy, ["seg", "val"], "left_semi")
        .select("seg", F.col("val").alias("at"), F.lit(1).alias("off"), "fp", "rest")
    )
    members = common.stage(exact.unionByName(beside), "mih-dense")
    flips = F.array(*[F.lit(1 << b) for b in range(32)])
    two = F.array(*[F.lit((1 << b) | (1 << c)) for b in range(32) for c in range(b)])
    moved = lambda masks, far: F.transform(
        masks, lambda m: F.struct(F.col("rest").bitwiseXOR(m).alias("x"), F.lit(far).alias("far"))
    )
    near = F.concat(F.array(F.struct(F.col("rest").alias("x"), F.lit(0).alias("far"))), moved(flips, 0))
    # Kind A joins equal segments (near with far or near); kind B joins equal with beside (near with near only).
    entries = members.filter("off = 0").select(
        "seg", "at", "fp", F.lit("A").alias("kind"), F.lit(0).alias("off"), F.explode(F.concat(near, moved(two, 1))).alias("e")
    ).unionByName(members.select("seg", "at", "fp", F.lit("B").alias("kind"), "off", F.explode(near).alias("e")))
    entries = entries.select("seg", "at", "fp", "kind", "off", F.col("e.x").alias("x"), F.col("e.far").alias("far"))
    hubs = entries.groupBy("seg", "at", "kind", "x").agg(
        F.min(F.when((F.col("far") == 0) & (F.col("off") == 0), F.col("fp"))).alias("hub"), F.count("*").alias("n")
    ).filter("hub is not null and n > 1")
    return (
        entries.join(hubs, ["seg", "at", "kind", "x"])
        .filter("fp <> hub")
        .select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
        .distinct()
    )


_MIX = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * PER_BAND, 1), dtype=np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band of min-hashes of a set of shingle hashes; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(hashes), 4096):
        mixed = (hashes[low : low + 4096] ^ _MIX[0]) * (_MIX[1] * np.uint64(2) + np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, PER_BAND)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def band_keys(rows: DataFrame) -> DataFrame:
    """(h, f, key), staged: the bands of every text of other words. rows: __h (hash of the text), fp, words (hash of its lower-cased words), bands."""
    one = rows.filter("size(bands) > 0").groupBy("words").agg(F.min(F.struct("__h", "fp", "bands")).alias("t"))
    return common.stage(one.select(F.col("t.__h").alias("h"), F.col("t.fp").alias("f"), F.explode("t.bands").alias("key")), "similar-keys")


def similar_links(keys: DataFrame, texts: DataFrame, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between fingerprints over ``RADIUS`` apart of texts whose ``WIDE_SHINGLE``-shingles have Jaccard ``least`` or more.

    keys: see :func:`band_keys`. texts: __h, text. Every pair that shares a band is verified on the complete sets. In a band of more than
    ``crowd`` texts every text is verified against two hubs and a group of about ``GROUP``, others in each band, so that near copies
    of one text make no square of pairs. That joins most of such a crowd; the pairs of what it leaves apart are :func:`crowd_links`.
    """
    mixed = F.struct(F.xxhash64("h", "key").alias("o"), "h", "f")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(mixed).alias("x"), F.max(mixed).alias("y")).filter("n > 1")
    sizes = common.stage(sizes, "similar-bands")
    groups = F.when(F.col("n") <= crowd, 1).otherwise(F.ceil(F.col("n") / GROUP))
    dealt = keys.join(sizes.select("key", groups.alias("groups")), "key")
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("h", "key", F.lit(1)), F.col("groups")))
    a, b = (dealt.select("key", "g", F.col("h").alias(f"h{x}"), F.col("f").alias(f"f{x}")) for x in "ab")
    pairs = a.join(b, ["key", "g"]).filter("ha < hb").select("ha", "fa", "hb", "fb")
    many = sizes.filter(F.col("n") > crowd).select("key", F.explode(F.array("x", "y")).alias("z"))
    starred = keys.join(many, "key").select(F.col("h").alias("ha"), F.col("f").alias("fa"), F.col("z.h").alias("hb"), F.col("z.f").alias("fb"))
    pairs = pairs.unionByName(starred.filter("ha <> hb")).filter(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) > RADIUS)
    return _verified(pairs, texts, least)


def crowd_links(keys: DataFrame, texts: DataFrame, labels: DataFrame, least: float = LEAST, crowd: int = CROWD, share: int = SHARE) -> DataFrame | None:
    """Further edges (a, b), so that no pair that shares a band of more than ``crowd`` texts is left undecided; None where there are none.

    labels: (node, root) of the components found so far. Pairs within one component need no edge. Of a pair of two, one at least isn't
    of the band's largest component: these stragglers meet all texts of the band, dealt in shares. Sets of Jaccard ``least`` differ
    in (1 - least) / (1 + least) of the sum of their sizes at most, and in as many hashed parities; who doesn't is dropped in the join, the others are verified on the complete sets.
    """
    many = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    members = keys.join(many, "key").join(labels.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    members = common.stage(members, "crowd")
    roots = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots"))
    mixed = common.stage(members.join(roots.filter("roots > 1").select("key", "most"), "key").withColumn("lone", F.col("root") != F.col("most")), "crowd-mixed")
    common.release(members)
    if mixed.isEmpty():
        return None
    wanted = mixed.select(F.col("h").alias("__h")).distinct()
    chosen = texts.join(wanted, "__h", "left_semi").groupBy("__h").agg(F.min("text").alias("text"))
    names = [f"s{k}" for k in range(SKETCH)]

    def score(batch: list[bytes]) -> list[list]:
        sets = [np.unique(shingles(t, WIDE_SHINGLE)) for t in batch]
        odd = [np.bincount((x >> np.uint64(64 - (64 * SKETCH - 1).bit_length())).astype(np.int64), minlength=64 * SKETCH) & 1 for x in sets]
        bits = np.packbits(np.array(odd, dtype=np.uint8).reshape(len(sets), 64 * SKETCH), axis=1).view(np.int64)
        return [[len(x) for x in sets], *bits.T.tolist()]

    fields = pa.schema([("size", pa.int32()), *((x, pa.int64()) for x in names)])
    sketched = common.stage(common.per_text(chosen, ["__h"], "text", fields, score).withColumnRenamed("__h", "h"), "crowd-sketches")
    full = mixed.join(sketched, "h")
    shares = F.ceil(F.col("n") / share)
    lone = full.filter("lone").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    every = full.withColumn("g", F.pmod(F.xxhash64("h", "key", F.lit(2)), shares))
    apart = sum((F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in names), F.lit(0))
    meets = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.g") == F.col("b.g"))
        & (F.col("a.root") != F.col("b.root"))
        & (~F.col("b.lone") | (F.col("a.h") < F.col("b.h")))
        & (F.least("a.size", "b.size") >= F.lit(least) * F.greatest("a.size", "b.size") - 1e-9)
        & (apart <= F.lit((1 - least) / (1 + least)) * (F.col("a.size") + F.col("b.size")) + 1e-6)
    )
    near = lone.alias("a").join(every.alias("b"), meets)
    return _verified(near.select(*(F.col(f"{x}.{y}").alias(f"{y}{x}") for x in "ab" for y in "hf")), texts, least)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between the fingerprints of those pairs (ha, fa, hb, fb) whose complete sets have Jaccard ``least`` or more."""
    pairs = common.stage(pairs.distinct(), "similar-pairs")
    wanted = pairs.select(F.col("ha").alias("__h")).unionByName(pairs.select(F.col("hb").alias("__h"))).distinct()
    chosen = texts.join(wanted, "__h", "left_semi").groupBy("__h").agg(F.min("text").alias("text"))

    def score(batch: list[bytes]) -> list[list]:
        return [[np.unique(shingles(t, WIDE_SHINGLE)).tobytes() for t in batch]]

    sets = common.stage(common.per_text(chosen, ["__h"], "text", pa.schema([("ids", pa.binary())]), score), "similar-sets")
    left, right = sets.select(F.col("__h").alias("ha"), F.col("ids").alias("xa")), sets.select(F.col("__h").alias("hb"), F.col("ids").alias("xb"))
    both = pairs.join(left, "ha").join(right, "hb").select("fa", "fb", "xa", "xb")

    def verify(batches):
        for batch in batches:
            xs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ok = pa.array([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in xs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["fa", "fb"])

    return both.mapInArrow(verify, "fa long, fb long").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()


def classes(rows: DataFrame, best: Column, dense: int = DENSE, more: DataFrame | None = None, rest: Callable[[DataFrame], DataFrame | None] | None = None) -> DataFrame:
    """(fp, best): for every fingerprint of ``rows``, the least ``best`` of all rows of its component; ``more`` are further edges.

    ``best`` is reduced to one value for each fingerprint first, by a partial aggregate; all joins are of
    distinct fingerprints, so a group of copies, however large, is one row in them. ``rest`` is given the components and gives the edges
    that are still missing, if any.
    """
    distinct = common.stage(rows.groupBy("fp").agg(F.min(best).alias("best")), "simhash-fps")
    edges = links(distinct.select("fp"), dense)
    edges = common.stage(edges if more is None else edges.unionByName(more), "simhash-links")
    roots = components(edges)
    if rest is not None and (last := rest(roots)) is not None:
        last = common.stage(last, "simhash-rest")
        if not last.isEmpty():  # stars of what is known, and what was missing
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(last))
    roots = roots.withColumnRenamed("node", "fp")
    tagged = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = tagged.groupBy("root").agg(F.min("best").alias("best"))
    return tagged.drop("best").join(least, "root").select("fp", "best")


def near_dup_components(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for every row of ``docs``.

    A null doc_id keeps its row; it never is a component's id unless all ids there are null. Null texts count as
    empty; repeated rows stay repeated; an empty table gives an empty result.
    """
    rows = common.stage(fingerprints(docs, ["doc_id"]), "simhash")
    found = classes(rows, F.col("doc_id"), dense).withColumnRenamed("best", "component_id")
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """The rows of ``docs``, one of each component: its least doc_id (null last), then its least text hash.

    Components are of links by fingerprint (``RADIUS``) and by similarity (``LEAST``), see :func:`similar_links` and :func:`crowd_links`.
    All columns come back as they were. Repeated rows of the kept document are reduced to one, in every partition before they are
    shuffled. Null and empty texts have fingerprint 0 and are one group; an empty table stays empty.
    """
    columns = docs.columns
    marked = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))

    def score(texts: list[bytes]) -> list[list]:
        found = [fingerprint(t) for t in texts]
        words = [xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 43) - (1 << 63) for t in texts]
        return [[x - (1 << 64) if x >> 63 else x for x in found], words, [bands(shingles(t, WIDE_SHINGLE)) for t in texts]]

    fields = pa.schema([("fp", pa.int64()), ("words", pa.int64()), ("bands", pa.list_(pa.int64()))])
    rows = common.stage(common.per_text(marked, ["doc_id", "__h"], "text", fields, score), "simhash")
    keys, texts = band_keys(rows), marked.select("__h", "text")
    more = similar_links(keys, texts)
    best = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("__h").alias("h"))
    chosen = classes(rows, best, dense, more, lambda roots: crowd_links(keys, texts, roots)).select(F.col("best.id").alias("__id"), F.col("best.h").alias("__kh")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__kh"))
    others = [F.col(f"`{c}`").asc_nulls_last() for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double") and c != "text"]
    first = Window.partitionBy("doc_id", "__h").orderBy(*(others or [F.lit(0)]))
    kept = marked.join(chosen, on, "left_semi").withColumn("__k", F.row_number().over(first)).filter("__k = 1")
    return kept.select(*[F.col(f"`{c}`") for c in columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``documents``, see :func:`near_dup_components`."""
    return near_dup_components(common.documents(spark, sf_dir).select("doc_id", "text"))
