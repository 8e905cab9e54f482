from millrace.llm import common, materialise


def test_stages_in_turn(spark, sf):
    import corpus_pipeline as cp

    docs = common.documents(spark, sf)
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf), "t")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert max(ids.count(i) for i in set(ids)) == 2
    out = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    ends = sum(list(memoryview(r.record).cast("H")[: r.n_tokens]).count(materialise.END) for r in out)
    assert ends == len(ids)


def test_odd_rows_pass_all_stages(spark, sf, odd, none):
    import corpus_pipeline as cp

    for docs in (odd, none):
        for _, stage in cp.STAGES:
            docs = common.stage(stage(spark, docs, sf), "t")
        docs.count()


def test_run(spark, sf):
    import corpus_pipeline as cp

    assert cp.run(spark, sf).count() > 0 and cp.ORACLE_SQL is None


def test_a_worker_keeps_the_memory_of_one_operator():
    from millrace.llm import decontaminate, quality

    words, spelling = quality._Words(), decontaminate.Spelling({b"benchmark": 1})
    common.only("a")
    assert words.memo[b"word"] and spelling([b"benchmrak", b"word"]).tolist() == [1, 0]
    common.only("a")
    assert len(words.memo) == 1 and len(spelling.known) == 3
    common.only("b")
    assert not words.memo and spelling.known == {b"benchmark": 1}
