import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, capped, t = 1.5 * sum(sizes.values()), {}, {}
    while len(capped) < len(names):
        free = [s for s in names if s not in capped]
        t = {s: (left - sum(capped.values())) * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if t[s] > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2.0 * sizes[s] for s in over}
    return {**t, **capped}


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_targets_and_takings(name, request):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want = plain_targets(sizes)
    source = {(r.doc_id, size(r.text)): r.source for r in rows}
    got = mixing.mix_report(df).collect()
    assert sorted((g.doc_id or -1, g.size) for g in got) == sorted((r.doc_id or -1, size(r.text)) for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for g in got:
        s = source[g.doc_id, g.size]
        assert g.source_size == sizes[s] and g.target == pytest.approx(want[s])
        assert g.taken in (0, g.size, 2 * g.size)
        taken[s] += g.taken
        largest[s] = max(largest[s], g.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_runs_and_layouts_agree(docs):
    one = sorted(tuple(r) for r in mixing.mix_report(docs).collect())
    two = sorted(tuple(r) for r in mixing.mix_report(docs.repartition(7)).collect())
    assert one == two


def test_tree_of_several_levels(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'b', 'hot') source", "1 + id % 37 size")
    rows = rows.unionByName(spark.createDataFrame([(9000 + i, f"s{i}", 50) for i in range(4)], rows.schema))
    got = mixing.mixed(rows, ["doc_id"], block=16, fan=3).collect()
    assert len(got) == 3004
    taken, target = defaultdict(float), {}
    for g in got:
        taken[g.source] += g.copies * g["size"]
        target[g.source] = g.target
        assert g.copies in (0, 1, 2)
    assert all(abs(taken[s] - target[s]) <= (37 if s in ("b", "hot") else 50) for s in target)


def test_pivot_keeps_expectations():
    n, hits = 400, defaultdict(int)
    for seed in range(n):
        done, held = mixing.pivot(iter([("a", 3.0, 0.25), ("b", 5.0, 0.5), ("c", 2.0, 0.4)]), str(seed))
        for k, v in done.items():
            hits[k] += v
        if held:
            hits[held[0]] += held[2]
    assert hits["a"] / n == pytest.approx(0.25, abs=0.08) and hits["b"] / n == pytest.approx(0.5, abs=0.08)


def test_apply(odd, none):
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns
    report = {}
    for r in mixing.mix_report(odd).collect():
        report[r.doc_id] = report.get(r.doc_id, 0) + r.taken
    assert sum(size(r.text) for r in out.collect()) > 0
    assert mixing.apply_mix(none).count() == 0 and mixing.mix_report(none).count() == 0


def test_apply_takes_what_the_mix_takes(spark, docs, odd, monkeypatch):
    """Rows come back whole, 0 to 2 times each, near the targets, and alike however they are laid out; copies without an id are told apart."""
    same = spark.createDataFrame([(None, "some words that are repeated", "en", "a", 1)] * 70, docs.schema)
    monkeypatch.setattr(mixing, "PIECE", 16)
    for df in (docs.unionByName(same), odd):
        rows = df.collect()
        there, sizes = Counter(map(str, rows)), defaultdict(int)
        for r in rows:
            sizes[r.source] += size(r.text)
        out = [mixing.apply_mix(d).collect() for d in (df, df.repartition(7))]
        assert sorted(map(str, out[0])) == sorted(map(str, out[1]))
        got, taken = Counter(map(str, out[0])), defaultdict(int)
        assert set(got) <= set(there) and all(n <= 2 * there[r] for r, n in got.items())
        for r in out[0]:
            taken[r.source] += size(r.text)
        largest = max(size(r.text) for r in rows)
        assert all(abs(taken[s] - t) <= largest + 1e-6 for s, t in plain_targets(sizes).items())
