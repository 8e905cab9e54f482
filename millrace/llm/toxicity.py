"""Toxicity by non-negative positive-unlabelled learning (operator 1).

Training sees confirmed toxic texts and *unlabelled* texts, never negatives. With the class prior
p, the risk of a scorer is p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)): what is
counted as negative among the unlabelled is corrected for the positives hidden there, and the
correction may not make the risk negative. Where it would, that part's step is turned back. A
few linear scorers in numpy over hashed words and word beginnings, each from its own start and
order, are averaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 18
#: Documented bounds of the fit: confirmed toxic texts, unlabelled texts. All else covers all data.
MAX_POSITIVE, MAX_UNLABELLED = 2000, 8000
MAX_BUCKETS, LEAST_Z = 4000, 4.0
MEMBERS, EPOCHS, BATCH, RATE, DECAY = 3, 20, 500, 0.02, 1e-4
#: Where the corrected negative risk falls below zero, its step is undone at this rate, and the positive risk's step stays.
UNDO = 0.1
#: The cut is found from known positives held out of fits in so many parts, where there are ``FEW`` or more.
PARTS, FEW = 3, 6
#: Standard errors by which what is estimated from samples is moved to the safe side.
SURE = 3.0
_MARKS = b".,;:!?\"'()[]{}<>|*%&$#@~`^=+-_/\\"


def _features(raw: bytes) -> bytes:
    """Buckets (int32) of a word and of its beginnings of 4 to 6 letters."""
    word = raw.strip(_MARKS).lower().decode("utf-8", "ignore")
    if not word:
        return b""
    mask = (1 << BITS) - 1
    starts = {f"{n}^{word[:n]}" for n in (4, 5, 6) if len(word) > n}
    return np.array([zlib.crc32(x.encode()) & mask for x in (word, *starts)], dtype=np.int32).tobytes()


_memo = common.Memo(_features, 200_000)


def features(text: bytes) -> np.ndarray:
    """The distinct buckets of a whole text, ascending."""
    return np.unique(np.frombuffer(b"".join(map(_memo.__getitem__, set(text.split()))), dtype=np.int32))


class Model:
    """A linear scorer over buckets; its size is fixed by ``BITS``."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, ids: np.ndarray) -> float:
        z = self.bias + float(self.weights[ids].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(r) for r in rows])
    return np.concatenate(rows) if rows else np.empty(0, np.int32), np.concatenate([[0], ends]).astype(np.int64)


def slopes(z: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """What a step goes along: the slope of the corrected risk by each score, of ``n_p`` positives and then of unlabelled texts.

    Where the corrected negative part is below zero, its slope is turned back at the rate ``UNDO``.
    """
    z = np.clip(z, -35, 35)
    p, n_u = 1 / (1 + np.exp(-z)), len(z) - n_p
    minus = np.log1p(np.exp(z))  # logistic loss of calling a text clean
    turn = 1.0 if minus[n_p:].mean() - prior * minus[:n_p].mean() >= 0 else -UNDO
    g = np.empty(len(z))
    g[:n_p] = prior * ((p[:n_p] - 1) - turn * p[:n_p]) / n_p
    g[n_p:] = turn * p[n_p:] / n_u
    return g


def _one(pos: list[np.ndarray], unl: list[np.ndarray], scale: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    rng, size = np.random.default_rng(seed), len(scale)
    w, b = rng.normal(0, 1e-3, size), -1.0
    mw, vw, mb, vb, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    steps = max(1, len(unl) // BATCH)
    for _ in range(EPOCHS):
        order, porder = rng.permutation(len(unl)), rng.permutation(len(pos))
        for s in range(steps):
            up = [pos[i] for i in np.array_split(porder, steps)[s]] or [pos[porder[s % len(pos)]]]
            uu = [unl[i] for i in order[s * BATCH : (s + 1) * BATCH]]
            flat, ends = _pack(up + uu)
            z = b + np.add.reduceat(np.append((w * scale)[flat], 0.0), ends[:-1]) * (np.diff(ends) > 0)
            g = slopes(z, len(up), prior)
            gw = np.bincount(flat, weights=np.repeat(g, np.diff(ends)), minlength=size) * scale + DECAY * w
            gb, t = g.sum(), t + 1
            mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            w -= RATE * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
            b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w * scale, b


def screen(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose share among positives differs from that among unlabelled texts by ``LEAST_Z`` standard errors,
    the ``MAX_BUCKETS`` most different ones, and how many standard errors. Words that say nothing would only add
    noise to long texts; the others are scaled by their difference, so that the clearest ones are learnt first.

    ``in_p``, ``in_u``: how many of the ``n_p`` positives and ``n_u`` unlabelled texts have each bucket."""
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    z[in_p + in_u < 3] = 0
    best = np.argsort(-z, kind="stable")[:MAX_BUCKETS]
    kept = np.sort(best[z[best] >= LEAST_Z])
    return kept, z[kept]


def screens(pos: np.ndarray, unl: np.ndarray, n_pos: list[int], n_unl: int) -> np.ndarray:
    """All buckets that a fit on all positives, or on all but one of ``PARTS``, keeps. ``pos``: counts of each part's positives, by row."""
    every, n = pos.sum(axis=0), sum(n_pos)
    kept = [screen(every, unl, n, n_unl)[0]] if n and n_unl else []
    kept += [screen(every - pos[k], unl, n - n_pos[k], n_unl)[0] for k in range(len(n_pos)) if n > n_pos[k] and n_unl]
    return np.unique(np.concatenate(kept)) if kept else np.empty(0, dtype=np.int64)


def toxic_share(ranks: np.ndarray, share: float, texts: int) -> tuple[float, float]:
    """(least, most) share of the unlabelled texts to call toxic. ``ranks``: for known positives that a scorer didn't see as
    such, the share of the ``texts`` unlabelled texts that score as high or higher. ``share``: what the labelled share leads one to expect
    among them, taken where there are under ``FEW`` positives.

    A share x that catches the part c of all toxic texts bounds their share p by x / c from above. Both are known up to some standard
    errors (``SURE``); the least bound with x raised and c lowered by these is taken for p. The x with the least x - 2 p c has the fewest errors for that
    scorer; ``share``, where it is within p, calls as many as there are. The cut lies from the greater of these to 3 p / n
    more, which is what may lie below the last of n positives (at 95%).
    """
    n = len(ranks)
    if n < FEW:
        return share, share
    x, caught = np.sort(ranks), np.arange(1, n + 1) / n
    wide = SURE * np.sqrt((x * (1 - x) + 1 / texts) / texts)
    sure = caught - SURE * np.sqrt((caught * (1 - caught) + 1 / n) / n)
    bounds = ((x + wide) / np.maximum(sure, 1e-9))[sure > 0]
    p = min(0.5, float(bounds.min(initial=0.5)))
    at = float(x[int((x - 2 * p * caught).argmin())])
    least = max(at, min(p, share))
    return least, least + 3 * p / n


def _cut(scores: np.ndarray, least: float, most: float) -> float:
    """Where unlabelled scores (ascending) part into clean and toxic: in the widest gap among those that call
    from ``least`` to ``most`` of them toxic, with the gap next to either end.
    Where all of these score the same, the cut is above them, as nothing tells them from the clean ones."""
    n = len(scores)
    low, high = n - 2 - int(np.ceil(most * n)), n - int(least * n)
    low, high = max(0, min(low, n - 2)), max(1, min(high, n - 1))
    gaps = np.diff(scores[low : high + 1])
    k = low + int(gaps.argmax())
    if not gaps.max():
        k = min(int(np.searchsorted(scores, scores[k], side="right")) - 1, n - 1)
        return float((scores[k] + scores[min(k + 1, n - 1)]) / 2 + (1e-9 if k == n - 1 else 0))
    return float((scores[k] + scores[k + 1]) / 2)


def _held_out_ranks(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> np.ndarray:
    """For each positive, the share of ``unl`` without the positives themselves that a fit without this positive scores as high or higher."""
    known = {id(r) for r in pos}
    ranks = []
    for part in range(PARTS):
        rest, held = [r for i, r in enumerate(pos) if i % PARTS != part], pos[part::PARTS]
        weights = _weights(rest, unl, prior, [part]) if rest else None
        if weights is None:
            return np.empty(0)
        free = np.sort([float(weights[r].sum()) for r in unl if id(r) not in known])
        own = np.array([float(weights[r].sum()) for r in held])
        ranks.append(1 - np.searchsorted(free, own, side="left") / max(1, len(free)))
    return np.concatenate(ranks)


def _weights(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, seeds: list[int]) -> np.ndarray | None:
    """The mean of one scorer for each seed over the screened buckets; None where no bucket tells the texts apart."""
    size = 1 << BITS
    count = lambda rows: np.bincount(np.concatenate(rows), minlength=size)
    kept, z = screen(count(pos), count(unl), len(pos), len(unl))
    if not len(kept):
        return None
    place = np.full(size, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    narrow = lambda rows: [(x := place[r])[x >= 0] for r in rows]
    p, u = narrow(pos), narrow(unl)
    weights = np.zeros(size)
    weights[kept] = np.mean([_one(p, u, np.minimum(z, 30) / 10, prior, s)[0] for s in seeds], axis=0)
    return weights


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, members: int = MEMBERS, share: float | None = None) -> Model:
    """Averages ``members`` scorers over the screened buckets. Without positives, unlabelled texts or buckets
    that tell them apart, nothing can be learnt: the scorer gives the prior to all.

    ``prior`` is for the risk alone. The cut comes from held-out positives, see :func:`toxic_share`; ``share`` (default: the
    prior) is called toxic where these are too few."""
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    weights = _weights(pos, unl, prior, list(range(members))) if pos and len(unl) > 1 else None
    if weights is None:
        return Model(np.zeros(1 << BITS), np.log(prior / (1 - prior)))
    known = {id(r) for r in pos}
    free = [r for r in unl if id(r) not in known]
    # Of the toxic texts among the unlabelled, the known ones are left out of what the cut is found on.
    hidden = max(0.0, (prior if share is None else share) * len(unl) - (len(unl) - len(free))) / max(1, len(free))
    least, most = toxic_share(_held_out_ranks(pos, unl, prior), hidden, max(1, len(free)))
    free = free if len(free) > 1 else unl
    return Model(weights, -_cut(np.sort([float(weights[r].sum()) for r in free]), least, most))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as held out (0)."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Learns from rows outside fold 0. Positives are labelled toxic; unlabelled are any documents, their labels unseen.

    Both are the first ids in order of a hash, up to the documented bounds; a repeated doc_id is one text, that of the least
    hash, and one label, the greatest. The prior, if not given, is the toxic share of all labels outside fold 0, less two
    standard errors; that is for the risk, not for the cut. What comes to the driver is bounded: the chosen ids, one count for each bucket
    and group, and of each chosen text the buckets that some fit keeps (:func:`screens`).
    Without labels or documents nothing is learnt and every text gets the prior (0.1).
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = prior
    if prior is None:
        share, n = known.agg(F.avg("toxic"), F.count("*")).first()
        # Its lower bound (two standard errors): a prior that is too high would forbid the risk what is true.
        prior = 0.1 if share is None else max(0.0, float(share) - 2 * (float(share) * (1 - float(share)) / n) ** 0.5)
        share = prior if share is None else float(share)
    pick = lambda ids, n, seed: [r[0] for r in ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n).collect()]
    free = docs.select("doc_id").filter("doc_id is not null").filter(fold(F.col("doc_id")) != 0).distinct()
    positive = free.join(known.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    groups = [(d, k % PARTS) for k, d in enumerate(sorted(pick(positive, MAX_POSITIVE, 1)))] + [(d, PARTS) for d in sorted(pick(free, MAX_UNLABELLED, 2))]
    chosen = F.broadcast(spark.createDataFrame(groups, "doc_id long, g int"))  # at most 10,000 ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def score(batch: list[bytes]) -> list[list]:
        return [[features(t).tobytes() for t in batch]]

    made = common.stage(common.per_text(texts, ["doc_id"], "text", pa.schema([("ids", pa.binary())]), score).join(chosen, "doc_id"), "tox-features")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in range(PARTS + 1):
                ids = [x for x, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if own == g]
                b, n = np.unique(np.frombuffer(b"".join(ids), dtype=np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.full(len(b), g, np.int32)), pa.array(n)], names=["b", "g", "n"])

    counted = made.select("ids", "g").mapInArrow(count, "b int, g int, n long").groupBy("b", "g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((PARTS + 1, 1 << BITS), dtype=np.int64)
    counts[counted.column("g").to_numpy(), counted.column("b").to_numpy()] = counted.column("n").to_numpy()
    sizes = dict(made.groupBy("g").count().collect())
    wanted = screens(counts[:PARTS], counts[PARTS], [sizes.get(g, 0) for g in range(PARTS)], sizes.get(PARTS, 0)).astype(np.int32)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.intersect1d(np.frombuffer(x, dtype=np.int32), wanted, assume_unique=True).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "g", "ids"])

    rows = made.select("doc_id", "g", "ids").mapInArrow(narrow, "doc_id long, g int, ids binary").toArrow().to_pylist()
    common.release(made)
    found = {r["doc_id"]: np.frombuffer(r["ids"], dtype=np.int32) for r in rows}
    pos = [found[r["doc_id"]] for r in sorted(rows, key=lambda r: r["doc_id"]) if r["g"] < PARTS]
    unl = [found[r["doc_id"]] for r in sorted(rows, key=lambda r: r["doc_id"]) if r["g"] == PARTS]
    return train(pos, unl, prior, share=share)


def toxicity_scores(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and score (0 to 1) for every row; null and empty texts get the scorer's bias."""

    def score(batch: list[bytes]) -> list[list]:
        return [[model.score(features(t)) for t in batch]]

    return common.per_text(docs, keep, text, pa.schema([("score", pa.float64())]), score)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``: null doc_ids count as held out, null and empty texts get
    the scorer's bias, repeated rows stay repeated, rows of equal texts score the same, an empty table gives no rows."""
    docs, labels = common.documents(spark, sf_dir), common.documents(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, fit(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
