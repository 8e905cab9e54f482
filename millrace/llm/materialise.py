"""Training-order materialisation of token ids (operator 4).

Texts become token ids, each document is closed by an end-of-text id, and the stream of all
documents is cut into sequences of ``length`` ids. A keyed Feistel permutation over the smallest
even-bit domain, walked along its cycle until it falls below the number of sequences, gives every sequence its
slot in the training order: a bijection that is computed, not sorted for, and can be inverted.
Slots are range-partitioned into shards of fixed-stride records, so that record k of the training
order is at a known byte of a known shard, and a reader can resume anywhere.

The stream's order is that of a hash of doc_id and text, so slots depend on the data and the key alone, and rows
without an id spread like others, and so do very many rows that agree in both. Token ids are shuffled twice, compressed with a
dictionary: once into hash ranges, to number the stream, and once, as whole sequences, into slots. The number of ranges comes from
the counted bytes of the texts.
"""

from __future__ import annotations

import base64
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LENGTH, PER_SHARD, KEY = 2048, 512, 20240229
END = 50256
ROUNDS = 6
#: Bytes of text that a range gets on average; there are at least ``spark.sql.shuffle.partitions`` ranges.
RANGE_BYTES = 256 << 20
#: Rows of one doc_id and text that share one place in the stream at most.
REPEATS = 10_000
#: What the compression's dictionary is trained on: so many texts at most, so many characters of each. It bears on sizes alone, never on results.
SAMPLE, SAMPLE_CHARS, DICTIONARY, LEVEL = 1000, 4096, 1 << 18, 5


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Feistel:
    """A keyed permutation of 0 .. n-1."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _mix(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, k), left
            else:
                left, right = right, left ^ self._mix(right, k)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64), back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[str, object] = {}


def _encode(path: str, text: str, end: int, kind: str) -> np.ndarray:
    enc = _encoders.get(path) or _encoders.setdefault(path, encoder(path))
    return np.append(enc.encode_to_numpy(text, disallowed_special=()), end).astype(kind)


def id_type(path: str, end: int = END) -> str:
    """How an id is stored: two bytes where the vocabulary's greatest id and ``end`` fit, else four."""
    with open(path, "rb") as f:
        greatest = max((int(line.split()[1]) for line in f), default=0)
    return "<u2" if max(greatest, end) < 1 << 16 else "<u4"


class Packer:
    """Compresses and restores runs of ids, with a dictionary trained on some of them."""

    def __init__(self, dictionary: bytes):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=known).decompress


_packers: dict[bytes, Packer] = {}


def _packer(dictionary: bytes) -> Packer:
    if dictionary not in _packers:
        _packers.clear()
        _packers[dictionary] = Packer(dictionary)
    return _packers[dictionary]


def dictionary(docs: DataFrame, path: str, kind: str, end: int = END) -> bytes:
    """A dictionary of the ids of the first texts; none where these are too few to train on."""
    texts = docs.select(F.substring("text", 1, SAMPLE_CHARS)).filter("text is not null").limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [_encode(path, t, end, kind).tobytes() for (t,) in texts]).as_bytes()
    except zstandard.ZstdError:
        return b""


def tokenised(
    docs: DataFrame, keep: list[str], path: str | None = None, end: int = END, kind: str | None = None, known: bytes = b""
) -> DataFrame:
    """``keep``, n (ids with the end id) and ids (of ``kind``, packed with the dictionary ``known``) for every row; null texts are empty."""
    path = path or default_path()
    kind = kind or id_type(path, end)

    def score(texts: list[bytes]) -> list[list]:
        ids, pack = [_encode(path, t.decode(), end, kind) for t in texts], _packer(known).pack
        return [[len(x) for x in ids], [pack(x.tobytes()) for x in ids]]

    return common.per_text(docs, keep, "text", pa.schema([("n", pa.int64()), ("ids", pa.binary())]), score)


def _keyed_tokens(docs: DataFrame, path: str, end: int, kind: str, known: bytes) -> DataFrame:
    """doc_id, h, th, n, ids of every row; h is its place in the stream, th its text's hash.

    Rows that agree in doc_id and text have one place, unless there are more than ``REPEATS`` of them: these are counted, tokenised once,
    and their copies spread by a running number, so that no range gets them all.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    place = lambda *more: F.shiftrightunsigned(F.xxhash64("doc_id", "th", *more), 1).alias("h")
    many = rows.groupBy("doc_id", "th").agg(F.count("*").alias("copies")).filter(F.col("copies") > REPEATS)
    many = common.stage(many.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "copies"), "order-repeats")  # one row for each REPEATS rows at most
    single = lambda df: tokenised(df.select("doc_id", "text", "th", place()), ["doc_id", "h", "th"], path, end, kind, known)
    if many.isEmpty():
        return single(rows)
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t"))
    one = rows.join(many, same).groupBy("doc_id", "th", "copies").agg(F.min("text").alias("text"))
    made = tokenised(one, ["doc_id", "th", "copies"], path, end, kind, known)
    pieces = made.withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / REPEATS)))).repartition("doc_id", "th", "__b")
    ends = F.least(F.col("copies"), (F.col("__b") + 1) * REPEATS)
    spread = pieces.withColumn("k", F.explode(F.sequence(F.col("__b") * REPEATS + 1, ends))).select("doc_id", place("k"), "th", "n", "ids")
    return single(rows.join(many, same, "left_anti")).unionByName(spread)


Batches = Iterator[pa.RecordBatch]
_RECORDS = "slot long, shard int, offset long, n_tokens int, doc_ids array<long>, doc_tokens array<int>, record binary"


def training_order(
    docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, path: str | None = None, end: int = END
) -> DataFrame:
    """slot, shard, offset (bytes), n_tokens, doc_ids, doc_tokens, record: one row for each sequence, in range
    partitions of whole shards, each in slot order.

    ``record`` has ``length`` ids of two bytes (four where the vocabulary needs them); only the last sequence of the stream is filled up, with
    end ids that n_tokens doesn't count. doc_ids and doc_tokens say which documents a record holds pieces of, and how long.
    Null doc_ids stay null; null and empty texts are one end id; very long texts go on over many sequences; repeated rows are all
    written; an empty table has no sequences. Columns besides doc_id and text are not read.
    """
    pieces, join = _in_order(docs, length, per_shard, key, path or default_path(), end)
    return pieces.mapInArrow(join, _RECORDS)


def _in_order(docs: DataFrame, length: int, per_shard: int, key: int, path: str, end: int) -> tuple[DataFrame, Callable[[Batches], Batches]]:
    """(the pieces of all sequences, in range partitions of whole shards and in slot order; what makes records of a partition's batches)."""
    kind = id_type(path, end)
    width = np.dtype(kind).itemsize
    known = dictionary(docs, path, kind, end)
    parts = common.ranges(docs, RANGE_BYTES)
    tokens = _keyed_tokens(docs, path, end, kind, known)
    ranges = F.shiftright(F.shiftright("h", 31) * F.lit(parts), 32)
    dealt = tokens.withColumn("p", ranges.cast("int")).repartitionById(parts, F.col("p"))
    # All columns are used, so that this and the rows below read one and the same exchange.
    sizes = dealt.groupBy("p").agg(
        F.sum("n").alias("tokens"), F.max(F.struct("h", "th", "doc_id", F.octet_length("ids"))).alias("__any")
    )
    order = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.filter("__any is not null").select(
        F.col("p").alias("q"), F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"), F.sum("tokens").over(every).alias("total")
    )
    placed = dealt.join(F.broadcast(offsets), F.col("p") == F.col("q")).sortWithinPartitions(
        "p", "h", F.col("doc_id").asc_nulls_last(), "th"
    )
    placed = placed.select("doc_id", "n", "ids", "p", "before", "total")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sequences, but for those that a range begins or ends in the middle of."""
        packer = _packer(known)
        at, current, feistel = 0, None, None
        seqs, starts, docs_, sizes_, bodies = [], [], [], [], []
        open_: list[tuple] = []  # (doc_id, ids) of the sequence at hand
        first = 0

        def flush() -> None:
            if open_:
                seqs.append(first // length)
                starts.append(first % length)
                docs_.append([d for d, _ in open_])
                sizes_.append([len(x) // width for _, x in open_])
                bodies.append(packer.pack(b"".join(x for _, x in open_)))
                open_.clear()

        def made() -> pa.RecordBatch:
            slots = feistel.slot(np.array(seqs, dtype=np.uint64)) if seqs else np.empty(0, dtype=np.int64)
            totals = np.full(len(seqs), feistel.n if feistel else 0, dtype=np.int64)
            columns = [
                pa.array(slots), pa.array(starts, pa.int32()), pa.array(docs_, pa.list_(pa.int64())), pa.array(sizes_, pa.list_(pa.int32())),
                pa.array(bodies, pa.binary()), pa.array(totals),
            ]
            for x in (seqs, starts, docs_, sizes_, bodies):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=["slot", "start", "doc_ids", "doc_tokens", "body", "sequences"])

        for batch in batches:
            for doc_id, n, ids, p, before, total in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if p != current:
                    flush()
                    current, at, first = p, before, before
                if feistel is None:
                    feistel = Feistel(-(-total // length), key)
                done, ids = 0, packer.unpack(ids)
                while done < n:
                    take = min(n - done, length - at % length)
                    open_.append((doc_id, ids[width * done : width * (done + take)]))
                    done, at = done + take, at + take
                    if at % length == 0:
                        flush()
                        first = at
            yield made()
        flush()
        if seqs:
            yield made()

    cuts = placed.mapInArrow(cut, "slot long, start int, doc_ids array<long>, doc_tokens array<int>, body binary, sequences long")
    shards = F.ceil(F.col("sequences") / F.lit(per_shard))
    target = F.floor(F.floor(F.col("slot") / F.lit(per_shard)) * F.lit(parts) / shards).cast("int")
    ranged = cuts.repartitionById(parts, target).sortWithinPartitions("slot", "start").select("slot", "doc_ids", "doc_tokens", "body")

    def join(batches: Batches) -> Batches:
        packer, types = _packer(known), [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]

        def row(slot: int, held: list) -> tuple:
            body = b"".join(packer.unpack(x) for _, _, x in held)
            filled = body + np.full(length - len(body) // width, end, dtype=kind).tobytes()
            return (
                slot, slot // per_shard, slot % per_shard * width * length, len(body) // width,
                [d for ds, _, _ in held for d in ds], [n for _, ns, _ in held for n in ns], filled,
            )

        def table(rows: list) -> pa.RecordBatch:
            names = ["slot", "shard", "offset", "n_tokens", "doc_ids", "doc_tokens", "record"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)

        slot, held = None, []
        for batch in batches:
            rows = []
            for s, *part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != slot and held:
                    rows.append(row(slot, held))
                    held = []
                slot = s
                held.append(part)
            yield table(rows)
        if held:
            yield table([row(slot, held)])

    return ranged, join


class ShardWriter:
    """Writes records that come in slot order to ``shard-NNNNNNNN.bin`` under ``uri``; ``made`` lists the complete ones.

    A shard appears under its name only when it is complete: a repeated or speculative task replaces it by the same bytes.
    """

    def __init__(self, uri: str):
        from pyarrow import fs as pafs

        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.out, self.made = None, None, []

    def add(self, slot: int, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.first, self.n, self.crc, self.size = shard, slot, 0, 0, 0
            self.name = f"{self.root}/.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.name)
        self.out.write(record)
        self.n, self.crc, self.size = self.n + 1, zlib.crc32(record, self.crc), self.size + len(record)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(self.name, f"{self.root}/shard-{self.shard:08d}.bin")
            self.made.append((self.shard, self.first, self.n, self.size, self.crc))
            self.out = None


_MANIFEST = "shard int, first_slot long, records long, bytes long, crc32 long"


def _manifest_batch(made: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["shard", "first_slot", "records", "bytes", "crc32"]
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], type=t) for i, t in enumerate(types)], names=names)


def write_shards(records: DataFrame, uri: str) -> DataFrame:
    """Writes each shard of :func:`training_order` as ``shard-NNNNNNNN.bin`` under ``uri``; returns the manifest
    (shard, first_slot, records, bytes, crc32), which is also what a resumed run compares.

    ``uri`` must be a folder that all executors reach; see :class:`ShardWriter`.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(uri)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                writer.add(*row)
        writer.close()
        yield _manifest_batch(writer.made)

    return common.stage(records.select("slot", "shard", "record").mapInArrow(save, _MANIFEST), "shards-written")


def shard_folder(spark: SparkSession) -> str:
    """A new folder for shards in the shared folder, as a URI."""
    folder = common.shared_dir(spark)
    scheme, colon, rest = folder.partition(":")
    if not colon or scheme == "file":
        folder = "file:///" + (rest if colon else folder).lstrip("/")
    return f"{folder}/shards-{uuid.uuid4().hex}"


def written_order(
    docs: DataFrame, uri: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, path: str | None = None, end: int = END
) -> DataFrame:
    """Writes the shards of :func:`training_order` and ``manifest`` (Parquet) under ``uri`` (default: :func:`shard_folder`); returns
    the columns of training_order, the records read from the shards. An empty table writes an empty manifest and no shard.

    The manifest's bytes and sums are of the files as they are read again; a shard that hasn't the bytes of its records raises.
    """
    uri, path = uri or shard_folder(docs.sparkSession), path or default_path()
    stride = length * np.dtype(id_type(path, end)).itemsize
    index = "slot long, shard int, offset long, n_tokens int, doc_ids array<long>, doc_tokens array<int>"

    pieces, join = _in_order(docs, length, per_shard, key, path, end)

    def save(batches: Batches) -> Batches:
        """Joins and writes in one Python worker, so that the records don't pass the JVM in between."""
        writer = ShardWriter(uri)
        for batch in join(batches):
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 6)), strict=True):
                writer.add(*row)
            yield batch.drop_columns(["record"])
        writer.close()

    rows = common.stage(pieces.mapInArrow(save, index), "shards-index")

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            found = []
            for shard, first, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
                    body = f.read()
                if len(body) != n * stride:
                    raise RuntimeError(f"shard {shard}: {len(body)} bytes, {n} records")
                found.append((shard, first, n, len(body), zlib.crc32(body)))
            yield _manifest_batch(found)

    each = rows.groupBy("shard").agg(F.min("slot").alias("first_slot"), F.count("*").alias("records"))
    each.mapInArrow(inspect, _MANIFEST).write.parquet(f"{uri}/manifest")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(uri)
        current, f = None, None
        for batch in batches:
            records = []
            for shard, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if shard != current:
                    if f:
                        f.close()
                    current, f = shard, fs.open_input_file(f"{root}/shard-{shard:08d}.bin")
                f.seek(offset)
                records.append(f.read(stride))
            yield batch.append_column("record", pa.array(records, pa.binary()))
        if f:
            f.close()

    return rows.mapInArrow(load, f"{index}, record binary")


def read_slots(uri: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, kind: str = "<u2") -> np.ndarray:
    """Sequences ``first`` .. of the training order, read by seeking: what a resumed training job does. ``kind``: see :func:`id_type`."""
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(uri)
    out, stride = io.BytesIO(), length * np.dtype(kind).itemsize
    while count > 0:
        shard, inside = divmod(first, per_shard)
        n = min(count, per_shard - inside)
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(inside * stride)
            got = f.read(n * stride)
        out.write(got)
        if len(got) < n * stride:
            break
        first, count = first + n, count - n
    return np.frombuffer(out.getvalue(), dtype=kind).reshape(-1, length)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training order of all ``documents``, written as shards and read from them, see :func:`written_order`."""
    return written_order(common.documents(spark, sf_dir))
