"""Quality classifier from weak labels (operator 9).

Overlapping heuristic labellers each vote good (1), bad (0) or abstain (-1) on a text. How often
each combination of votes occurs is counted over *all* documents; expectation-maximisation over
these counts estimates how each labeller votes on good and on bad texts, without any true label. The
posterior of a combination is a soft label, and a hashed linear scorer over word shapes is
trained on a bounded sample of documents with it. True labels are used nowhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Documents the scorer is fitted on at most, by order of a hash of the text.
MAX_FIT = 8000
BITS = 14
KEEP = 0.5
_STOP = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that for it as with be on by this are was at from or not "
        "de la le les et des en un une que du qui der die und den das ist von zu mit el los las y por con para su se es al"
    ).split()
)
LABELLERS = ("marks", "capitals", "stutter", "bars", "repeats", "function_words", "sentences", "lines")


_MARKS = b"%$&*#@~^"
_RUNS = re.compile(rb"(.)\1+", re.S)
_SHAPES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else c for c in range(256))


class _Points(dict):
    """A, a or 0 for code points that are letters or digits, in any script; others stay."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        self[point] = kind = 65 if c.isupper() else 97 if c.isalpha() else 48 if c.isdigit() else point
        return kind


_points = _Points()


class _Words:
    """What is to be known of a word, remembered with a bound: flag bits, and the bucket of its shape."""

    MARK, CAPS, BAR, STOP, END, LONG = 1, 2, 4, 8, 16, 32
    FLAGS = 6

    def __init__(self) -> None:
        self.memo = common.Memo(self._code)

    def _code(self, raw: bytes) -> int:
        shape = raw.translate(_SHAPES) if raw.isascii() else raw.decode("utf-8", "replace").translate(_points).encode()
        upper, lower = shape.count(b"A"), shape.count(b"a")
        flags = self.LONG if len(raw) >= 6 else 0
        if raw == b"|":
            flags |= self.BAR
        elif not upper + lower + shape.count(b"0") or len(raw.translate(None, _MARKS)) < len(raw) or b"!!" in raw:
            flags |= self.MARK
        if upper + lower >= 2 and raw.isascii() and not lower or not raw.isascii() and raw.decode("utf-8", "ignore").isupper():
            flags |= self.CAPS
        if raw.strip(b".,;:!?\"'()").lower() in _STOP:
            flags |= self.STOP
        if raw[-1:] in (b".", b"?", b"!"):
            flags |= self.END
        size = b"s" if upper + lower <= 3 else b"m" if upper + lower <= 12 else b"l"
        return (zlib.crc32(size + _RUNS.sub(rb"\1\1", shape)) & ((1 << BITS) - 1)) << self.FLAGS | flags


class Text:
    """A text as the labellers and the scorer see it; both are made of one pass over its words."""

    def __init__(self, text: bytes, words: _Words):
        self.text, self.chunks = text, text.split()
        self.n = len(self.chunks)
        self.codes = np.fromiter(map(words.memo.__getitem__, self.chunks), dtype=np.int64, count=self.n)
        if not self.n:
            return
        self.stutter = sum(map(eq, self.chunks, self.chunks[1:])) / self.n
        long = list(compress(self.chunks, (self.codes & _Words.LONG).tolist()))
        self.repeated = 1 - len(set(long)) / len(long) if len(long) >= 20 else None

    def share(self, bit: int) -> float:
        return float(np.count_nonzero(self.codes & bit)) / self.n


def votes(t: Text) -> tuple[int, ...]:
    """The labellers' votes on a text; texts under 8 words only get votes on marks and capitals."""
    if not t.n:
        return (-1,) * len(LABELLERS)
    between = lambda x, good, bad: 1 if x <= good else 0 if x >= bad else -1
    out = [between(t.share(_Words.MARK), 0.05, 0.3), between(t.share(_Words.CAPS), 0.1, 0.4)]
    if t.n < 8:
        return (*out, *(-1,) * (len(LABELLERS) - 2))
    out.append(between(t.stutter, 0.05, 0.2))
    out.append(between(t.share(_Words.BAR), 0.02, 0.2))
    out.append(-1 if t.repeated is None else between(t.repeated, 0.25, 0.6))
    stop = t.share(_Words.STOP)
    out.append(1 if stop >= 0.12 else 0 if stop < 0.03 and t.n >= 25 else -1)
    ends = t.share(_Words.END)
    out.append(1 if 0.02 <= ends <= 0.35 else 0 if ends > 0.6 else -1)
    lines = [x for x in t.text.split(b"\n") if x.strip()]
    out.append(-1 if len(lines) < 4 else between(1 - len(set(lines)) / len(lines), 0.3, 0.6))
    return tuple(out)


def _pattern(v: tuple[int, ...]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x + 1
    return code


def _unpack(code: int) -> tuple[int, ...]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3 - 1)
        code //= 3
    return tuple(out[::-1])


def expectation_maximisation(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """(posterior of good for each combination, table[labeller, class, vote], share of good).

    Starts from the number of bad votes. Labellers are taken as independent given the class; one
    that abstains says nothing. Which class is the good one is told by the start alone.
    """
    codes = sorted(counts)
    table = np.full((len(LABELLERS), 2, 3), 0.5)  # votes: abstain (always 1), bad, good
    if not codes:
        return {}, table, 0.5
    v = np.array([_unpack(c) for c in codes]) + 1  # 0 abstains, 1 bad, 2 good
    n = np.array([counts[c] for c in codes], dtype=float)
    post = 0.95 * 0.25 ** (v == 1).sum(1)  # each labeller votes bad on rare and strong grounds only
    prior = 0.5
    for _ in range(rounds):
        prior = float((n * post).sum() / n.sum())
        for k in range(len(LABELLERS)):
            for c, weight in enumerate((1 - post, post)):
                seen = np.bincount(v[:, k], weights=n * weight, minlength=3)[1:] + 0.5
                table[k, c] = [1, *(seen / seen.sum())]
        log = np.log(np.clip([[1 - prior], [prior]], 1e-9, 1)) + sum(np.log(table[k][:, v[:, k]]) for k in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return {c: float(p) for c, p in zip(codes, post, strict=True)}, table, prior


class Scorer:
    """Logistic scorer: mean weight of a text's word shapes, and weights of doc-level buckets."""

    #: Doc-level buckets follow the shapes: repetition, share of capitals and stutter, in tenths.
    SIZE = (1 << BITS) + 33

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        self.weights = np.zeros(self.SIZE) if weights is None else weights
        self.bias = bias

    @staticmethod
    def seen(t: Text) -> bytes:
        """What the scorer has to know of a text: buckets (int16) and how often each occurs (uint32); nothing of an empty text."""
        if not t.n:
            return b""
        buckets, n = np.unique(t.codes >> _Words.FLAGS, return_counts=True)
        top = 1 << BITS
        tenths = [int(10 * (t.repeated or 0)), 11 + int(10 * t.share(_Words.CAPS)), 22 + int(10 * t.stutter)]
        return np.append(buckets, [top + x for x in tenths]).astype("<i2").tobytes() + n.astype("<u4").tobytes()

    @staticmethod
    def features(seen: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, values) of what :meth:`seen` gave."""
        if not seen:
            return np.empty(0, np.int64), np.empty(0)
        size = (len(seen) - 6) // 6  # buckets of words; three more are of the text
        n = np.frombuffer(seen, "<u4", offset=2 * (size + 3))
        return np.frombuffer(seen, "<i2", count=size + 3).astype(np.int64), np.append(np.sqrt(n / n.sum()), [0.5] * 3)

    def score(self, seen: bytes) -> float:
        ids, values = self.features(seen)
        z = self.bias + float((self.weights[ids] * values).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Scorer:
    """Full-batch Adam on the soft labels. Without rows the scorer says 0.5 to all."""
    rows = [r for r in rows if len(r[0])]
    if not rows:
        return Scorer()
    flat, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    starts, y = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array([r[2] for r in rows])
    w, b = np.zeros(Scorer.SIZE), 0.0
    m, v, mb, vb = np.zeros(Scorer.SIZE), np.zeros(Scorer.SIZE), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = b + np.add.reduceat(w[flat] * values, starts)
        g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(y)
        gw, gb = np.bincount(flat, weights=np.repeat(g, sizes) * values, minlength=Scorer.SIZE) + decay * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return Scorer(w, b)


_words: list[_Words] = []


def _own() -> _Words:
    if not _words:
        _words.append(_Words())
    return _words[0]


def read(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, k (hash of the text), pattern and seen (:meth:`Scorer.seen`) for every row, staged: the texts are read and split once for all that follows."""
    key = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(9))

    def score(batch: list[bytes]) -> list[list]:
        texts = [Text(t, _own()) for t in batch]
        return [[_pattern(votes(t)) for t in texts], [Scorer.seen(t) for t in texts]]

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], key.alias("k"), F.col("text").alias("__t"))
    return common.stage(common.per_text(rows, [*keep, "k"], "__t", pa.schema([("pattern", pa.int32()), ("seen", pa.binary())]), score), "quality-read")


def fit(rows: DataFrame) -> tuple[Scorer, dict[int, float]]:
    """(scorer, posterior of good by combination of votes) of the rows of :func:`read`; at most 3 ^ labellers counts and ``MAX_FIT`` texts'
    features are gathered: those of the least hashes, one for each text, so that a text with very many copies counts once."""
    counts = {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior, _, _ = expectation_maximisation(counts)
    chosen = common.stage(rows.select("k").distinct().orderBy("k").limit(MAX_FIT), "quality-sample")
    found = rows.join(F.broadcast(chosen), "k", "left_semi").groupBy("k").agg(F.min(F.struct("pattern", "seen")).alias("r"))
    sample = [(*Scorer.features(bytes(r["r"]["seen"])), posterior[r["r"]["pattern"]]) for r in sorted(found.collect(), key=lambda r: r["k"])]
    common.release(chosen)
    return fit_scorer(sample), posterior


def quality_scores(docs: DataFrame, scorer: Scorer, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and score (0 to 1, higher: better) for every row. An empty or null text has nothing wrong: it gets the bias."""

    def score(batch: list[bytes]) -> list[list]:
        return [[scorer.score(Scorer.seen(Text(t, _own()))) for t in batch]]

    return common.per_text(docs, keep, text, pa.schema([("score", pa.float64())]), score)


def keep_good(docs: DataFrame, threshold: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with the columns as they were.

    Rows of equal texts stay or go together, repeated ones all; null and empty texts get the scorer's bias; an empty table stays empty. The texts
    are read a second time for the decision, as to carry it back to them by key would shuffle or copy them all.
    """
    rows = read(docs, [])
    scorer, _ = fit(rows)
    common.release(rows)

    def score(batch: list[bytes]) -> list[list]:
        return [[scorer.score(Scorer.seen(Text(t, _own()))) >= threshold for t in batch]]

    columns = docs.columns
    made = common.per_text(docs.withColumn("__t", F.col("text")), columns, "__t", pa.schema([("__keep", pa.bool_())]), score)
    return made.filter("__keep").select(*[F.col(f"`{c}`") for c in columns])


def quality_report(docs: DataFrame, threshold: float = KEEP) -> DataFrame:
    """doc_id, weak (posterior of the votes), score, keep for every row: null doc_ids and repeated rows stay, rows of equal texts get equal
    values, null and empty texts abstain and get the scorer's bias, an empty table gives no rows. The texts are read once."""
    rows = read(docs, ["doc_id"])
    scorer, posterior = fit(rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak = [posterior[c] for c in batch.column(1).to_pylist()]
            scores = [scorer.score(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "weak", "score"])

    kind = docs.select("doc_id").dtypes[0][1]
    made = rows.select("doc_id", "pattern", "seen").mapInArrow(score, f"doc_id {kind}, weak double, score double")
    return made.withColumn("keep", F.col("score") >= threshold)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, weak, score, keep for every row of ``documents``, see :func:`quality_report`."""
    return quality_report(common.documents(spark, sf_dir))
