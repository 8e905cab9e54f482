import numpy as np
import pytest

from millrace.llm import common, materialise


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = materialise.Feistel(n, 9)
    slots = f.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (f.index(slots) == np.arange(n)).all()
    if n > 500:
        assert (materialise.Feistel(n, 10).slot(np.arange(n)) != slots).mean() > 0.9


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_round_trip(name, request, spark, tmp_path):
    df = request.getfixturevalue(name)
    length, per = 256, 8
    made = common.stage(materialise.training_order(df, length, per), "records")
    rows = sorted(made.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(len(r.record) == 2 * length and r.shard == r.slot // per and r.offset == r.slot % per * 2 * length for r in rows)
    # In index order the records are the stream again: every text, closed by the end id.
    feistel = materialise.Feistel(len(rows), materialise.KEY)
    by_index = [rows[s] for s in feistel.slot(np.arange(len(rows)))]
    stream = np.concatenate([np.frombuffer(r.record, "<u2")[: r.n_tokens] for r in by_index])
    enc = materialise.encoder(materialise.default_path())
    texts, start = [], 0
    for end in np.flatnonzero(stream == materialise.END):
        texts.append(enc.decode(stream[start:end].tolist()))
        start = end + 1
    assert sorted(texts) == sorted(r.text or "" for r in df.collect())
    assert sum(sum(r.doc_tokens) for r in rows) == len(stream)
    # The same slots, however the rows are laid out.
    again = {r.slot: r.record for r in materialise.training_order(df.repartition(5), length, per).collect()}
    assert again == {r.slot: r.record for r in rows}
    uri = f"file://{tmp_path}/shards"
    manifest = sorted(materialise.write_shards(made.repartitionByRange("shard").sortWithinPartitions("slot"), uri).collect())
    assert sum(m.records for m in manifest) == len(rows) and [m.shard for m in manifest] == list(range(len(manifest)))
    first, count = per - 1, len(rows) - per
    got = materialise.read_slots(uri, first, count, length, per)
    assert [x.tobytes() for x in got] == [bytes(r.record) for r in rows[first : first + count]]
    assert sorted(materialise.write_shards(made.repartitionByRange("shard").sortWithinPartitions("slot"), uri).collect()) == manifest


def test_empty(none):
    assert materialise.training_order(none).count() == 0


def test_op4_and_the_pipeline_stage_write_shards(spark, sf, docs, monkeypatch):
    """The files alone give the training order: what is returned is what a resumed job reads."""
    import pathlib
    import zlib

    import corpus_pipeline as cp

    made = []
    monkeypatch.setattr(materialise, "shard_folder", lambda s, f=materialise.shard_folder: made.append(f(s)) or made[-1])
    want = {r.slot: tuple(r) for r in materialise.training_order(docs).collect()}
    for k, out in enumerate((materialise.op4(spark, sf), cp.training_order(spark, docs, sf))):
        got = {r.slot: tuple(r) for r in out.collect()}
        assert got == want
        read = materialise.read_slots(made[k], 0, len(want))
        assert [x.tobytes() for x in read] == [bytes(want[s][-1]) for s in sorted(want)]
        manifest = spark.read.parquet(f"{made[k]}/manifest").collect()
        assert sum(m.records for m in manifest) == len(want)
        for m in manifest:
            body = pathlib.Path(made[k].removeprefix("file://"), f"shard-{m.shard:08d}.bin").read_bytes()
            assert (m.bytes, m.crc32) == (len(body), zlib.crc32(body)) and m.first_slot == m.shard * materialise.PER_SHARD
    assert len(set(made)) == 2


def test_written_order_without_rows(none, odd):
    assert materialise.written_order(none).count() == 0
    assert materialise.written_order(odd, length=64, per_shard=3).count() == materialise.training_order(odd, 64, 3).count()


def test_ids_over_two_bytes_take_four(odd, tmp_path):
    end, length = 70_000, 64
    uri = f"file://{tmp_path}/wide"
    rows = sorted(materialise.written_order(odd, uri, length, 3, end=end).collect())
    assert all(len(r.record) == 4 * length and r.offset == r.slot % 3 * 4 * length for r in rows)
    ids = np.concatenate([np.frombuffer(r.record, "<u4")[: r.n_tokens] for r in rows])
    assert (ids == end).sum() == odd.count() and ids.max() == end
    assert materialise.id_type(materialise.default_path(), end) == "<u4" and materialise.id_type(materialise.default_path()) == "<u2"
    got = materialise.read_slots(uri, 0, len(rows), length, 3, "<u4")
    assert [x.tobytes() for x in got] == [bytes(r.record) for r in rows]


def test_very_many_rows_of_one_text_are_spread(spark, docs, monkeypatch):
    """The same records in every layout, all rows among them, and the copies in many ranges."""
    monkeypatch.setattr(materialise, "REPEATS", 20)
    same = spark.createDataFrame([(None, "a text that is there very often", "en", "a", 1)] * 90 + [(5000, None, "en", "a", 0)] * 41 + [(5001, "one more", "en", "a", 0)] * 20, docs.schema)
    df = docs.unionByName(same)
    made = [{r.slot: bytes(r.record) for r in materialise.training_order(d, 64, 4).collect()} for d in (df, df.repartition(7))]
    assert made[0] == made[1]
    ids = np.concatenate([np.frombuffer(x, "<u2") for _, x in sorted(made[0].items())])
    assert abs(int((ids == materialise.END).sum()) - df.count()) < 64  # the last record is filled up
    kind = materialise.id_type(materialise.default_path())
    keys = materialise._keyed_tokens(df, materialise.default_path(), materialise.END, kind, b"").select("doc_id", "h").collect()
    assert len(keys) == df.count() and len({r.h for r in keys if r.doc_id is None}) == 90 and len({r.h for r in keys if r.doc_id == 5000}) == 41
    assert len({r.h for r in keys if r.doc_id == 5001}) == 1
