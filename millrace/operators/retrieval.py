"""Hybrid retrieval over chunks: dense cosine, BM25, rank fusion, score floor, mandatory chunks, disambiguation.

All searches take a DataFrame of queries, so that a batch is one job; ranks are windows over each
query's candidates. Chunk tables have chunk_id, text, and further payload.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T

K1, B = 1.2, 0.75
RRF_K = 60
SENTINEL = 999.0
FLOOR = 0.30
#: Chunk types by descending priority. Fixed values.
PRIORITY = {
    "BUSINESS_RULE": 11, "TABLE": 10, "VIEW": 10, "FK_MAP": 9, "WORKFLOW": 8, "STATUS": 7, "GLOSSARY": 6, "AUDIT": 5, "INDEX": 4, "PARTITION": 3, "FEW_SHOT": 0,
}
#: Bytes of query vectors that are sent out and compared at once.
BLOCK_BYTES = 32 << 20
#: Scores of a matrix product that are held at once.
SCORES = 1 << 20


def top_k(scored: DataFrame, k: int, query: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best rows by score of each query, with rank from 0; ties by ``tie``.

    The filter is on the bare row number, so that Spark cuts each partition to k rows a query before anything is shuffled.
    """
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def dense(queries: DataFrame, chunks: DataFrame, k: int = 20, where: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine, exactly; filters apply before ranking. Vectors without a direction match nothing.

    The queries go out in blocks of bounded size. For each block the chunks are read once: a matrix product of a batch of
    chunks and the block finds who can be among the k best, and only these are scored one by one. A partition gives k rows a query at most, which
    are all that is shuffled.
    """
    pool = (chunks if where is None else chunks.filter(where)).select("chunk_id", F.col("vector").cast("array<double>").alias("v"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("v"))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-n * 8 * width // block_bytes))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double"
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        block = queries.sparkSession.sparkContext.broadcast((rows.column("query_id").combine_chunks(), _unit(rows.column("v"))))
        made = pool.mapInArrow(lambda batches, block=block: _nearest(batches, *block.value, k), schema)
        out = made if out is None else out.unionByName(made)
    return top_k(out, k)


#: Vectors that lists are fitted on at most; rounds of the fit; share of true neighbours that the number of probed lists is chosen for.
IVF_SAMPLE, IVF_ROUNDS, IVF_RECALL = 20_000, 8, 0.97


def ivf_fit(chunks: DataFrame, lists: int | None = None, k: int = 10, recall: float = IVF_RECALL, seed: int = 7) -> tuple[np.ndarray, int]:
    """(centres of the lists, lists to probe) for :func:`dense_ivf`, fitted on the vectors of the least hashes, ``IVF_SAMPLE`` at most.

    Centres are of unit vectors, by rounds of nearest centre and mean. Of the sample's own vectors as queries, so many lists are probed that
    ``recall`` of their true neighbours in the sample are found. There are as many lists as the root of the number of chunks, unless told otherwise.
    """
    rows = chunks.filter("vector is not null").select(F.xxhash64("chunk_id", F.lit(seed)).alias("h"), F.col("vector").cast("array<double>").alias("v"))
    sample = _unit(rows.orderBy("h").limit(IVF_SAMPLE).select("v").toArrow().column("v"))
    sample = sample[(sample != 0).any(axis=1)]
    if not len(sample):
        return np.zeros((1, 1)), 1
    n = lists or int(chunks.count() ** 0.5)
    n, rng = max(1, min(n, len(sample) // 4 or 1)), np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(IVF_ROUNDS):
        own = _closest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    own, asked = _closest(sample, centres), sample[rng.choice(len(sample), min(len(sample), 500), replace=False)]
    true = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    rank = np.empty((len(asked), n), dtype=np.int64)  # the place at which each list is probed
    np.put_along_axis(rank, np.argsort(-(asked @ centres.T), axis=1, kind="stable"), np.arange(n)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, own[true], axis=1).ravel())
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _closest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row, in pieces of bounded size."""
    step = max(1, SCORES // len(centres))
    return np.concatenate([(m[i : i + step] @ centres.T).argmax(axis=1) for i in range(0, len(m), step)] or [np.empty(0, dtype=np.int64)])


def ivf_index(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """``chunks`` (chunk_id, vector, ..) with ``list``, the nearest centre; null without a vector. Every row is indexed; meant to be stored."""
    held = chunks.sparkSession.sparkContext.broadcast(centres)
    columns, schema = chunks.columns, StructType([*chunks.schema.fields, StructField("list", IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _unit(pa.chunked_array([batch.column(columns.index("vector"))]))
            if not len(m):
                continue
            ok = (m != 0).any(axis=1) if m.shape[1] == held.value.shape[1] else np.zeros(len(m), dtype=bool)
            own = np.zeros(len(m), dtype=np.int32)
            own[ok] = _closest(m[ok], held.value)
            yield batch.append_column("list", pa.array(own, pa.int32(), mask=~ok))

    return chunks.mapInArrow(assign, schema)


def dense_ivf(queries: DataFrame, index: DataFrame, centres: np.ndarray, probes: int, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As :func:`dense`, of the ``probes`` lists nearest to each query alone: work is the share of lists that are probed, and neighbours in
    other lists are missed. With as many probes as lists nothing is."""
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("v"))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    probes = min(probes, len(centres))
    blocks = max(1, -(-n * (8 * width + (4 * probes if probes < len(centres) else 0)) // block_bytes))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(index.dtypes)['chunk_id']}, score double"
    pool, out = index.filter("list is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("v"), "list"), None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        unit = _unit(rows.column("v"))
        block = queries.sparkSession.sparkContext.broadcast((rows.column("query_id").combine_chunks(), unit, _askers(unit, centres, probes)))
        made = pool.mapInArrow(lambda batches, block=block: _nearest(batches, *block.value[:2], k, block.value[2]), schema)
        out = made if out is None else out.unionByName(made)
    return top_k(out, k)


def _askers(unit: np.ndarray, centres: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(queries, where each list's begin): the queries with a direction that probe a list, list by list; None if all probe all."""
    if unit.shape[1] != centres.shape[1]:
        return np.empty(0, dtype=np.int32), np.zeros(len(centres) + 1, dtype=np.int64)
    if probes >= len(centres):
        return None
    live, step = np.flatnonzero((unit != 0).any(axis=1)).astype(np.int32), max(1, SCORES // len(centres))
    near = [np.argsort(-(unit[live[i : i + step]] @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32) for i in range(0, len(live), step)]
    lists = np.concatenate(near or [np.empty((0, probes), dtype=np.int32)]).ravel()
    order = np.argsort(lists, kind="stable")
    return live[order // probes], np.concatenate([[0], np.cumsum(np.bincount(lists, minlength=len(centres)))])


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of length 1, one a row; zeros where there is no vector or no direction. All have one width."""
    flat, widths = pc.list_flatten(vectors), pc.min_max(pc.list_value_length(vectors)).as_py()
    if not vectors.null_count and not flat.null_count and widths["min"] == widths["max"] and widths["max"]:
        m = flat.to_numpy().astype(np.float64).reshape(len(vectors), -1)
    else:
        width = max((len(v) for v in vectors.to_pylist() if v is not None), default=0)
        m = np.array([v if v is not None else [0.0] * width for v in vectors.to_pylist()], dtype=np.float64).reshape(len(vectors), width)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _nearest(batches: Iterator[pa.RecordBatch], ids: pa.Array, asked: np.ndarray, k: int, askers: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """The k best chunks of a partition for each query of a block, ties by chunk_id; with ``askers`` (:func:`_askers`) only among those that ask a chunk's list.

    ``SCORES`` scores are held at once, and what may still be among the k best: what scores below a query's k best so far is dropped.
    """
    best: list = []  # (query, chunk_id, score) of what may still be among them
    held, kind = 0, None
    live = np.flatnonzero((asked != 0).any(axis=1))
    floor = np.full(len(asked), -np.inf)

    def cut() -> None:
        nonlocal held
        q, c, s = (np.concatenate([p[i] for p in best]) for i in range(3))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == k - 1
        floor[q[last]] = np.maximum(floor[q[last]], s[last] - 1e-9)
        best[:] = [(q[place < k], c[place < k], s[place < k])]
        held = len(best[0][0])

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field(0).type
        chunk, m = np.array(batch.column(0).to_pylist()), _unit(pa.chunked_array([batch.column(1)]))
        some = (m != 0).any(axis=1)
        if not some.any() or m.shape[1] != asked.shape[1]:
            continue
        if askers is None:
            groups = [(np.flatnonzero(some), live)]
        else:
            lists = batch.column(2).to_numpy(zero_copy_only=False)
            groups = [(np.flatnonzero((lists == x) & some), askers[0][askers[1][x] : askers[1][x + 1]]) for x in np.unique(lists[some]).astype(int)]
        for rows, own in groups:
            of, step = m[rows].T, max(1, SCORES // max(1, len(rows)))
            for i in range(0, len(own), step):
                o = own[i : i + step]
                scores = asked[o] @ of
                # The product's last digits depend on its blocking: all that come near the k-th are scored anew, each by itself.
                if len(rows) > k and np.isinf(floor[o]).any():
                    floor[o] = np.maximum(floor[o], np.partition(scores, -k, axis=1)[:, -k] - 1e-9)
                q, c = np.nonzero(scores >= floor[o][:, None])
                q, c = o[q], rows[c]
                exact = np.concatenate([np.einsum("ij,ij->i", asked[q[j : j + 65536]], m[c[j : j + 65536]]) for j in range(0, len(q), 65536)] or [np.empty(0)])
                best.append((q, chunk[c], exact))
                held += len(q)
                if held > max(4 * k * len(asked), SCORES):
                    cut()
    if held:
        cut()
        for q, c, s in best:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(c, kind), pa.array(s)], names=["query_id", "chunk_id", "score"])


def postings(chunks: DataFrame, analysed: Column) -> DataFrame:
    """(chunk_id, term, dl, tf): the inverted index of one field under one analyser, of chunks with distinct ids. Meant to be stored; :func:`bm25` reads it.

    The terms of a chunk are counted where the chunk is, by Arrow's own grouping; nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            made = pa.table({"r": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)}).group_by(["r", "term"]).aggregate([([], "count_all")]).combine_chunks()
            if made.num_rows:
                r = made.column("r").chunk(0)
                columns = [batch.column(0).take(r), made.column("term").chunk(0), pc.list_value_length(lists).take(r).cast(pa.int32()), made.column("count_all").chunk(0).cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "term", "dl", "tf"])

    return chunks.select("chunk_id", analysed.alias("terms")).mapInArrow(count, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, term string, dl int, tf long")


def delete_postings(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index without the postings of these chunks (chunk_id)."""
    return index.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def rare_terms(index: DataFrame, wanted: Column, most: int, least: int = 2) -> DataFrame:
    """(query_id, term): of the chunks that ``wanted`` picks, the ``most`` rarest terms that ``least`` chunks or more have, ties by term: the chunk as a query."""
    often = index.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least)
    listed = index.filter(wanted).select(F.col("chunk_id").alias("query_id"), "term").join(often, "term")
    w = Window.partitionBy("query_id").orderBy("df", "term")
    return listed.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select("query_id", "term")


def bm25(queries: DataFrame, index: DataFrame, chunks: int) -> DataFrame:
    """(query_id, chunk_id, score) of one field by its stored ``index``. ``queries``: query_id, term. ``chunks``: how many there are, those without
    terms among them. Document frequency and mean length are global; only the postings of the queries' terms are joined."""
    stats = index.agg((F.coalesce(F.sum("tf"), F.lit(0)) / F.lit(max(1, chunks))).alias("avgdl"))
    wanted = queries.select("query_id", "term").distinct()
    hits = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(wanted, "term").join(df, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    return scored.groupBy("query_id", "chunk_id").agg(F.sum(idf * tf).alias("score"))


#: Fields that a lexical search looks at, each under both analysers, and the type that it leaves out. Fixed values.
FIELDS, LEFT_OUT = ("text", "nl_question"), "FEW_SHOT"


def searchable(chunks: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The chunks that a lexical search may find: of ``kinds``, if given, and no few-shot examples, which have a search of their own."""
    own = chunks.filter(F.col("chunk_type") != LEFT_OUT)
    return own if kinds is None else own.filter(F.col("chunk_type").isin(*kinds))


def search(questions: DataFrame, chunks: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the best BM25 score of any field under either analyser, the question taken apart by the same one.

    questions: query_id, question. chunks: chunk_id, chunk_type and the ``FIELDS``; what a field lacks is empty.
    """
    pool, found = searchable(chunks, kinds), []
    n = pool.count()
    for name in FIELDS:
        for analyser in (T.tokens, T.raw_tokens):
            index = postings(pool, analyser(F.coalesce(name, F.lit(""))))
            asked = questions.select("query_id", F.explode(analyser(F.col("question"))).alias("term"))
            found.append(bm25(asked, index, n))
    return best_fields(found)


def best_fields(fields: list[DataFrame]) -> DataFrame:
    """The best score of any field for each (query, chunk)."""
    out = fields[0]
    for f in fields[1:]:
        out = out.unionByName(f)
    return out.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, rank): sum of 1 / (k + rank + 1).

    A chunk counts once a list, at its first rank, though its repeats keep their ranks. Ties keep
    first-seen order: by list, then by rank.
    """
    each = None
    for n, ranked in enumerate(lists):
        one = ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank")).withColumn("list", F.lit(n))
        each = one if each is None else each.unionByName(one)
    fused = each.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("seen")
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen.list", "seen.rank", "chunk_id")
    return fused.withColumn("position", F.row_number().over(w) - 1).drop("seen")


def mandatory(entities: DataFrame, chunks: DataFrame, kinds: tuple[str, ...] = ("TABLE", "FK_MAP")) -> DataFrame:
    """(query_id, chunk_id, score): the chunks of these kinds of each entity table, at the sentinel score. What doesn't exist is left out."""
    return (
        entities.select("query_id", "table_name")
        .join(chunks.filter(F.col("chunk_type").isin(*kinds)), "table_name")
        .select("query_id", "chunk_id", F.lit(SENTINEL).alias("score"))
        .distinct()
    )


def score_floor(scored: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Drops rows under ``floor`` times the query's best genuine score; sentinels stay and don't count."""
    best = F.max(F.when(F.col("score") < SENTINEL - 99, F.col("score"))).over(Window.partitionBy("query_id"))
    return scored.withColumn("_best", best).filter(
        (F.col("score") >= SENTINEL - 99) | (F.col("score") >= floor * F.col("_best"))
    ).drop("_best")


def rerank_overlap(queries: DataFrame, hits: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Deterministic stand-in of a cross-encoder: the share of the query's tokens that the chunk has. queries: query_id, question."""
    joined = hits.select("query_id", "chunk_id").join(queries, "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return top_k(joined.select("query_id", "chunk_id", T.containment(F.array_distinct(T.tokens(F.col("question"))), T.tokens(F.col("text"))).alias("score")), k)


def disambiguate(scored: DataFrame, threshold: float = 0.75, margin: float = 0.10) -> DataFrame:
    """(query_id, option): the best option if it reaches ``threshold`` and leads the second by ``margin``; else null. scored: query_id, option, score."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "option")
    ranked = scored.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    sure = (F.col("score") >= threshold) & (F.col("score") - F.coalesce("_next", F.lit(0.0)) >= margin)
    return ranked.filter("_n = 1").select("query_id", F.when(sure, F.col("option")).alias("option"), "score")


#: Tiers of the context budget: their chunk types (the last has all others) and their share of what mandatory chunks leave. Fixed values.
TIERS = (
    (("BUSINESS_RULE", "FK_MAP", "WORKFLOW"), 0.40), (("TABLE", "VIEW", "STATUS"), 0.35), (("GLOSSARY", "FEW_SHOT"), 0.10), ((), 1.00),
)
MAX_CHUNKS = 14
PROTECTED = ("FK_MAP", "WORKFLOW", "BUSINESS_RULE")


def fill_budget(rows: list[dict], budget: int, most: int = MAX_CHUNKS) -> list[dict]:
    """Chooses chunks of one query: mandatory ones always; then by priority and score, each tier within its share of what these
    leave and all within it; what a tier's share deferred is tried once more. Beyond ``most`` chunks the least of those that are neither mandatory nor
    ``PROTECTED`` go. Types of priority 8 or more come first. Mandatory chunks that fill the budget stand alone.

    Greedy and dependent on order: a chunk that doesn't fit is skipped, and the next may fit.
    rows: chunk_id, chunk_type, score, tokens, mandatory.
    """
    rank = lambda r: (-PRIORITY.get(r["chunk_type"], 0), -r["score"], r["chunk_id"])
    taken = sorted((r for r in rows if r["mandatory"]), key=rank)
    free = budget - sum(r["tokens"] for r in taken)
    if free <= 0:
        return taken
    spent, total, deferred = [0] * len(TIERS), 0, []
    for r in sorted((r for r in rows if not r["mandatory"]), key=rank):
        tier = next((i for i, (kinds, _) in enumerate(TIERS) if r["chunk_type"] in kinds), len(TIERS) - 1)
        if total + r["tokens"] <= free and spent[tier] + r["tokens"] <= int(TIERS[tier][1] * free):
            taken.append(r)
            spent[tier] += r["tokens"]
            total += r["tokens"]
        else:
            deferred.append(r)
    for r in deferred:
        if total + r["tokens"] <= free:
            taken.append(r)
            total += r["tokens"]
    if len(taken) > most:
        safe = [r for r in taken if r["mandatory"] or r["chunk_type"] in PROTECTED]
        rest = sorted((r for r in taken if not (r["mandatory"] or r["chunk_type"] in PROTECTED)), key=rank)
        taken = safe + rest[: max(0, most - len(safe))]
    return sorted(taken, key=lambda r: PRIORITY.get(r["chunk_type"], 0) < 8)


def context_budget(hits: DataFrame, budget: int = 7000) -> DataFrame:
    """(query_id, position, chunk_id, tokens) chosen by :func:`fill_budget`, each query on its own.

    ``hits`` holds the few dozen candidates of each query, as retrieval ranks leave them.
    """
    import pandas as pd

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = fill_budget(pdf.to_dict("records"), budget)
        return pd.DataFrame(
            [(key[0], i, r["chunk_id"], r["tokens"]) for i, r in enumerate(chosen)], columns=["query_id", "position", "chunk_id", "tokens"]
        )

    return hits.groupBy("query_id").applyInPandas(fill, "query_id long, position int, chunk_id long, tokens long")


def upsert(store: DataFrame, changed: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store with rows of equal key replaced and new ones added."""
    return store.join(changed.select(key), key, "left_anti").unionByName(changed)


def delete_referencing(store: DataFrame, tables: list[str]) -> DataFrame:
    """The store without chunks that refer to any of the changed tables."""
    return store.filter(~F.arrays_overlap(F.col("referenced_tables"), F.array(*[F.lit(t) for t in tables])))
