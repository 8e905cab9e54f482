"""DDL to indexed knowledge: parse, find the tables that changed, make their chunks anew, and keep the store."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions import embed
from .functions.questions import schema_vocabulary
from .operators import chunks
from .operators import retrieval as R
from .sources import ddl


@dataclass
class Ingested:
    catalog: Catalog
    drift: dict[str, str]
    chunks: int
    version: int


class KnowledgeStore:
    """Chunks with their vectors in a folder, one Parquet table a version and a small state file that names the current one.

    A version is complete before the state file points to it, so a lost job leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, Path(path)

    def state(self) -> dict:
        f = self.path / "state.json"
        return json.loads(f.read_text()) if f.exists() else {"version": 0, "hashes": {}}

    def chunks(self) -> DataFrame | None:
        version = self.state()["version"]
        return self.spark.read.parquet(str(self.path / f"v{version}")) if version else None

    def ingest(self, script: str) -> Ingested:
        """Brings the store up to a DDL script; tables with the same structure keep their chunks."""
        catalog, state = ddl.parse(script), self.state()
        drift = catalog.drift(state["hashes"])
        stale = [t for t, s in drift.items() if s != "same"]
        old = self.chunks()
        if not stale and old is not None:
            return Ingested(catalog, drift, old.count(), state["version"])
        # A changed table also changes the join maps of its neighbours.
        near = {k.to_table for k in catalog.foreign_keys if k.from_table in stale} | {k.from_table for k in catalog.foreign_keys if k.to_table in stale}
        fresh = sorted(({*stale} | near) & set(catalog.tables))
        made = chunks.generate(self.spark, catalog, fresh).withColumn("vector", embed.embed(F.col("text")))
        kept = made if old is None else R.upsert(R.delete_referencing(old, sorted({*stale} | near)), made)
        version = state["version"] + 1
        kept.write.mode("overwrite").parquet(str(self.path / f"v{version}"))
        new = self.path / ".state.json"
        new.write_text(json.dumps({"version": version, "hashes": catalog.fingerprints()}))
        new.replace(self.path / "state.json")
        return Ingested(catalog, drift, self.chunks().count(), version)

    def vocabulary(self, catalog: Catalog) -> DataFrame:
        return schema_vocabulary(catalog.column_table(self.spark))

    def search(self, question: str, k: int = 10, entities: list[str] | None = None, budget: int = 7000) -> list[dict]:
        """Hybrid search of one question: dense and lexical ranks fused, mandatory chunks of its entities first, floor, budget."""
        from .functions import text as T

        store = self.chunks()
        q = self.spark.createDataFrame([(1, question)], "query_id long, question string")
        dense = R.dense(q.select("query_id", embed.embed(F.col("question")).alias("vector")), store, 2 * k)
        terms = q.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term"))
        pool = R.searchable(store)
        lexical = R.top_k(R.bm25(terms, R.postings(pool, T.tokens(F.col("text"))), pool.count()), 2 * k)
        fused = R.fuse([dense.select("query_id", "chunk_id", "rank"), lexical.select("query_id", "chunk_id", "rank")])
        scored = fused.filter(F.col("position") < k).select("query_id", "chunk_id", "score")
        if entities:
            wanted = self.spark.createDataFrame([(1, e) for e in entities], "query_id long, table_name string")
            must = R.mandatory(wanted, store)
            scored = scored.join(must.select("chunk_id"), "chunk_id", "left_anti").select("query_id", "chunk_id", "score").unionByName(must)
        kept = R.score_floor(scored).join(store, "chunk_id")
        rows = kept.select(
            "chunk_id", "chunk_type", "table_name", "text", "score", T.estimated_tokens(F.col("text")).alias("tokens"), (F.col("score") >= R.SENTINEL - 99).alias("mandatory")
        ).collect()  # the candidates of one question: k and its entities' chunks
        return R.fill_budget([r.asDict() for r in rows], budget)
