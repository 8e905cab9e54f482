import math
import zlib

import numpy as np

from millrace.llm import common, quality, toxicity

toxicity_train = toxicity.train


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.documents(spark, sf), common.documents(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity_scores(docs, model, ["doc_id"]).join(labels, "doc_id").collect()
    held = [(r.score, r.toxic) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    s, y = np.array(held).T
    order = s.argsort().argsort()
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.93 and ((s >= 0.5) == y).mean() > 0.93


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (7, 0, 1), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    for model in (toxicity.fit(odd, labels), toxicity.fit(none, labels.limit(0))):
        got = toxicity.toxicity_scores(odd, model, ["doc_id"]).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert toxicity.toxicity_scores(none, model, ["doc_id"]).count() == 0


def test_risk_is_corrected_for_the_prior():
    """Positives hide among the unlabelled: a scorer that took these as negatives would call most of them clean."""
    rng = np.random.default_rng(0)
    doc = lambda t: np.array(sorted({*rng.integers(10, 200, 20).tolist(), *([1, 2] if t else [])}), dtype=np.int32)
    pos, unl = [doc(True) for _ in range(300)], [doc(i % 5 == 0) for i in range(2000)]
    model = toxicity.train(pos, unl, 0.2)
    hits = [model.score(doc(True)) >= 0.5 for _ in range(200)]
    miss = [model.score(doc(False)) >= 0.5 for _ in range(200)]
    assert np.mean(hits) > 0.97 and np.mean(miss) < 0.03


def plain_risk(z, n_p, prior, turn):
    """The risk's positive part, and the corrected negative part as the step takes it, by plain loops."""
    loss = lambda x: math.log(1 + math.exp(x))
    positive = sum(loss(-x) for x in z[:n_p]) / n_p
    negative = sum(loss(x) for x in z[n_p:]) / (len(z) - n_p) - prior * sum(loss(x) for x in z[:n_p]) / n_p
    return prior * positive + turn * negative, negative


def test_the_slope_is_that_of_the_risk():
    """Against differences of the plain risk, where the negative part is above zero and where it is below and undone."""
    rng, seen = np.random.default_rng(4), set()
    for prior, shift in ((0.1, 0.0), (0.4, 0.5), (0.6, -3.0), (0.9, -2.0)):
        z, n_p = np.concatenate([rng.normal(1, 1, 7), rng.normal(shift, 1, 11)]).tolist(), 7
        below = plain_risk(z, n_p, prior, 1)[1] < 0
        turn = -toxicity.UNDO if below else 1.0
        seen.add(below)
        got = toxicity.slopes(np.array(z), n_p, prior)
        for i in range(len(z)):
            up, down = ([*z[:i], z[i] + d, *z[i + 1 :]] for d in (1e-6, -1e-6))
            want = (plain_risk(up, n_p, prior, turn)[0] - plain_risk(down, n_p, prior, turn)[0]) / 2e-6
            assert abs(got[i] - want) < 1e-6
    assert seen == {True, False}


def test_screening_by_counts_is_screening_of_the_texts(spark, monkeypatch):
    """What the driver is sent is enough: the model is that of complete texts."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, sf), common.documents(spark, sf, "labels")
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda pos, unl, prior, share: seen.update(narrow=real(pos, unl, prior, share=share), sizes=(len(pos), len(unl)), prior=prior, share=share))
    real, texts = toxicity_train, {r.doc_id: toxicity.features((r.text or "").encode()) for r in docs.collect()}
    toxicity.fit(docs, labels)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = {r.doc_id for r in labels.collect() if r.toxic == 1 and fold(r.doc_id)}
    pos, unl = [texts[i] for i in sorted(known)], [texts[i] for i in sorted(texts) if fold(i)]
    assert seen["sizes"] == (len(pos), len(unl))
    whole = real(pos, unl, seen["prior"], share=seen["share"])
    assert np.allclose(whole.weights, seen["narrow"].weights) and abs(whole.bias - seen["narrow"].bias) < 1e-6


def test_a_bound_from_no_text_above_is_no_zero():
    """Held-out positives that score above all unlabelled texts don't make the toxic share nought."""
    ranks = np.concatenate([np.zeros(12), np.linspace(0, 0.03, 1288)])
    least, most = toxicity.toxic_share(ranks, 0.03, 7000)
    assert 0.015 < least <= most < 0.05


def test_repeated_ids_are_one_text(spark):
    """The same model, however the rows are laid out."""
    words = lambda k, toxic: " ".join(["foul"] * toxic + [f"w{k * j % 37}" for j in range(2, 20)])
    rows = [(i, words(i, i % 4 == 0)) for i in range(1, 400)] + [(i, f"another text of {i}") for i in range(1, 400, 3)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 400)], "doc_id long, toxic int")
    made = [toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels) for n in (1, 7)]
    assert (made[0].weights == made[1].weights).all() and made[0].bias == made[1].bias and made[0].weights.any()


def test_quality_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.documents(spark, sf), common.documents(spark, sf, "labels")
    rows = quality.quality_report(docs).join(labels, "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.08


def plain_em(counts, rounds):
    """Posteriors by plain loops over documents' votes."""
    votes = {c: quality._unpack(c) for c in counts}
    post = {c: 0.95 * 0.25 ** sum(x == 0 for x in v) for c, v in votes.items()}
    for _ in range(rounds):
        total = sum(counts.values())
        prior = sum(counts[c] * post[c] for c in counts) / total
        rate = {}
        for k in range(len(quality.LABELLERS)):
            for good in (0, 1):
                seen = {x: 0.5 + sum(counts[c] * (post[c] if good else 1 - post[c]) for c in counts if votes[c][k] == x) for x in (0, 1)}
                rate[k, good] = {x: seen[x] / (seen[0] + seen[1]) for x in seen} | {-1: 1.0}
        for c, v in votes.items():
            g, b = prior, 1 - prior
            for k, x in enumerate(v):
                g, b = g * rate[k, 1][x], b * rate[k, 0][x]
            post[c] = g / (g + b)
    return post


def test_posteriors_are_those_of_plain_loops():
    rng, counts = np.random.default_rng(6), {}
    for _ in range(3000):
        good = rng.random() < 0.7
        v = tuple(int(-1 if rng.random() < 0.3 else (good if rng.random() < 0.85 else not good)) for _ in quality.LABELLERS)
        counts[quality._pattern(v)] = counts.get(quality._pattern(v), 0) + 1
    for rounds in (1, 3, 40):
        got, want = quality.expectation_maximisation(counts, rounds)[0], plain_em(counts, rounds)
        assert all(abs(got[c] - want[c]) < 1e-6 for c in counts)


def test_labeller_accuracies_are_found():
    """Three labellers of known accuracy over two classes; the estimate comes near."""
    rng = np.random.default_rng(1)
    counts = {}
    for _ in range(20000):
        good = rng.random() < 0.8
        v = [-1] * len(quality.LABELLERS)
        for k, acc in enumerate((0.95, 0.9, 0.85)):
            v[k] = int(good) if rng.random() < acc else 1 - int(good)
        counts[quality._pattern(tuple(v))] = counts.get(quality._pattern(tuple(v)), 0) + 1
    _, table, prior = quality.expectation_maximisation(counts)
    assert abs(prior - 0.8) < 0.05 and all(abs(table[k][1][2] - a) < 0.04 for k, a in enumerate((0.95, 0.9, 0.85)))


def test_quality_odd(odd, none):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert quality.quality_report(odd).count() == odd.count()
    assert quality.keep_good(none).count() == 0 and quality.quality_report(none).count() == 0


def test_keep_good_is_the_score_of_each_text(odd, docs):
    """Against the scorer applied text by text."""
    for df in (odd, docs.limit(150)):
        scorer, _ = quality.fit(quality.read(df, []))
        score = lambda t, s=scorer: s.score(quality.Scorer.seen(quality.Text((t or "").encode(), quality._own())))
        want = sorted(str(tuple(r)) for r in df.collect() if score(r.text) >= quality.KEEP)
        assert sorted(str(tuple(r)) for r in quality.keep_good(df).collect()) == want
        report = {(r.doc_id, round(r.score, 9), r["keep"]) for r in quality.quality_report(df).collect()}
        assert report == {(r.doc_id, round(score(r.text), 9), score(r.text) >= quality.KEEP) for r in df.collect()}


def test_words_are_seen_whole_and_by_code_point():
    words = quality._Words()
    flags = lambda w: words._code(w.encode()) & ((1 << words.FLAGS) - 1)
    bucket = lambda w: words._code(w.encode()) >> words.FLAGS
    for junk in ("\u2605\u2605\u2605", "\u2588\u2588\u2588\u2588", "\u2022", "\u2014", "\ufffd\ufffd", "\u2605" * 100):
        assert flags(junk) & words.MARK, junk
    for word in ("\u00e9t\u00e9", "\u0434\u043e\u043c", "\u4e2d\u6587", "\u0661\u0662", "caf\u00e9"):
        assert not flags(word) & words.MARK, word
    assert flags("\u00c9T\u00c9") & words.CAPS and not flags("\u00c9t\u00e9") & words.CAPS
    assert not flags("A" * 64 + "b") & words.CAPS and flags("A" * 80) & words.CAPS
    assert not flags("-" * 64 + "word") & words.MARK and flags("-" * 80) & words.MARK
    assert bucket("ab" * 40) == bucket("cd" * 40) != bucket("ab" * 40 + "-1;2;3")
    assert bucket("\u4e2d\u6587" * 40 + "\u2605|\u2605") != bucket("\u4e2d\u6587" * 40)


def test_the_cut_doesnt_depend_on_how_many_are_labelled():
    """Well separated texts: all toxic ones are called, with few labels (a low prior) and with labels richer in toxic texts than the corpus."""
    rng = np.random.default_rng(2)
    doc = lambda t: np.array(sorted({*rng.integers(10, 200, 20).tolist(), *([1, 2, 3] if t else [])}), dtype=np.int32)
    for n_pos, every, prior in ((36, 7, 0.067), (36, 7, 0.109), (300, 50, 0.1)):
        pos, unl = [doc(True) for _ in range(n_pos)], [doc(i % every == 0) for i in range(2000)]
        model = toxicity.train(pos, unl, prior)
        called = np.array([model.score(r) >= 0.5 for r in unl])
        toxic = np.arange(2000) % every == 0
        assert called[toxic].mean() > 0.97 and called[~toxic].mean() < 0.01, (n_pos, every, prior)
