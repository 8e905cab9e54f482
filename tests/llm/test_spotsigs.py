import hashlib

import pytest

from millrace.llm import spotsigs


def as_set(digest):
    return {digest[i : i + 8] for i in range(0, len(digest), 8)}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def spots(text):
    return spotsigs.digest(spotsigs.Spotter().signatures(text.encode()))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_report(name, request, spark):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text").collect()
    if name == "odd":
        from pyspark.sql import functions as F

        rows = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
        rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    else:
        rows.sort(key=lambda r: r.doc_id)
    want = []
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, n = r.text or "", nxt.text or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, b, c = spots(t), spots(edited), spots(n)
        want.append((r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(jaccard(as_set(a), as_set(b)), 9), round(jaccard(as_set(a), as_set(c)), 9)))
    for parts in ("4", "1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in spotsigs.edited_report(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_signatures():
    s = spotsigs.Spotter()
    a = s.signatures(b"At a rally to kick off a weeklong campaign for the South Carolina primary, many people came")
    b = s.signatures(b"NAV home | At a rally to kick off a weeklong campaign for the South Carolina primary, many people came | ads")
    assert len(a) and spotsigs.likeness(a, b) > 0.5
    assert len(s.signatures(b"")) == 0 and len(s.signatures(b"two words")) == 2
    assert spotsigs.likeness(a, b, 0.99) == 0.0 or len(a) == len(b)


def test_near_duplicates(spark, docs, none):
    base = [r.text for r in docs.limit(60).collect()]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " and the tail of some new words") for i, t in enumerate(base)] + [(300, base[0]), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, pairs = spotsigs.near_duplicates(df, 0.8)
    classes = {}
    for d, t in rows:
        classes.setdefault(spots(t), []).append(d)
    rep = {k: min(d for d in v if d is not None) for k, v in classes.items()}
    assert {(r.doc_id, r.class_id) for r in members.collect()} == {(d, rep[spots(t)]) for d, t in rows}
    want = set()
    keys = list(classes)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            j = jaccard(as_set(a), as_set(b)) if a and b else 0
            if j >= 0.8:
                want.add((frozenset((rep[a], rep[b])), round(j, 9)))
    assert {(frozenset((r.a, r.b)), round(r.likeness, 9)) for r in pairs.collect()} == want and want
    members, pairs = spotsigs.near_duplicates(none)
    assert members.count() == 0 and pairs.count() == 0


def test_no_pair_is_lost_to_rounding(spark):
    """Sets of 100 signatures of which 55 of 100 (0.55 * 100 is over 55 in floating point) or the whole smaller set is shared."""
    import numpy as np

    rng = np.random.default_rng(3)
    sets = {}
    for k in range(20):
        whole = rng.choice(1 << 31, 145, replace=False)
        sets[f"a{k}"], sets[f"b{k}"] = whole[:100], whole[45:100]
    for a, b in ((f"a{k}", f"b{k}") for k in range(20)):
        assert spotsigs.likeness(np.sort(sets[a]), np.sort(sets[b]), 0.55) == 0.55
    frame = spark.createDataFrame([(k, name, sorted(int(x) for x in v)) for k, (name, v) in enumerate(sets.items())], "doc_id long, text string, sigs array<long>")
    own = spotsigs.signature_sets
    spotsigs.signature_sets = lambda df, keep: df.select(*keep, "sigs")
    try:
        found = {frozenset((r.a, r.b)) for r in spotsigs.near_duplicates(frame, 0.55)[1].collect()}
    finally:
        spotsigs.signature_sets = own
    assert found == {frozenset((2 * k, 2 * k + 1)) for k in range(20)}


def test_empty(none):
    assert spotsigs.edited_report(none).count() == 0
