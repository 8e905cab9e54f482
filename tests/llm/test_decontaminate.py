import os
import pickle
import random
import time

import numpy as np
import pytest

from millrace.llm import common, decontaminate as dc


def plain_best(item, text):
    """Least edit distance of a list of words to any stretch of another, word by word."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, row[j - 1] + (w != x), new[j - 1] + 1))
        row = new
    return min(row)


def letters_apart(a, b):
    """Edit distance of two words with a swap of neighbours as one, letter by letter."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def respelt(words, vocab, made=None):
    """Unknown words that are one edit from exactly one word of ``SPELT`` letters or more of the vocabulary, as that word."""
    made = {} if made is None else made
    ends = lambda a, b: len(os.path.commonprefix([a, b])) + len(os.path.commonprefix([a[::-1], b[::-1]]))
    for w in set(words) - vocab - set(made):
        near = [v for v in vocab if len(v) >= dc.SPELT and abs(len(v) - len(w)) <= 1 and ends(v, w) >= len(v) - 2 and letters_apart(w, v) == 1]
        made[w] = near[0] if len(near) == 1 else w
    return [made.get(w, w) for w in words]


def test_spelling_against_brute_force(monkeypatch):
    rng = random.Random(8)
    word = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    vocab = {word(rng.randint(3, 9)) for _ in range(300)}
    spelling = dc.Spelling({w: k + 1 for k, w in enumerate(sorted(vocab))})
    asked = [word(rng.randint(1, 10)) for _ in range(1500)] + [w[:-1] for w in vocab] + [w + b"a" for w in vocab] + [b"x" * 100, b"a" * 41]
    for some in (asked, asked[::-1]):  # the second time from memory
        got = spelling(some)
        assert got.tolist() == [spelling.vocab.get(respelt([w], vocab)[0], 0) for w in some]
    monkeypatch.setattr(dc.Spelling, "MOST", 100)
    assert spelling(asked).tolist() == got[::-1].tolist() == dc.Spelling(spelling.vocab)(asked).tolist()


def test_letters_edited_in_most_words_are_found():
    """Typing errors in four words of five; word by word none of these items would be near."""
    rng = random.Random(5)
    stems = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) for _ in range(600)]
    items = [(i, " ".join(rng.choice(stems) for _ in range(15)).encode()) for i in range(80)]
    index = dc.Index(items)

    def slip(w):
        k = rng.randrange(1, len(w) - 1)
        return rng.choice((w[:k] + w[k + 1 :], w[:k] + b"z" + w[k:], w[:k] + b"z" + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]))

    texts = [b"some words before " + b" ".join(slip(w) if rng.random() < 0.8 else w for w in t.split()) + b" and after" for _, t in items]
    met = [any(f[0] == i for f in found) for (i, _), found in zip(items, index.search(texts), strict=True)]
    assert np.mean(met) >= 0.9


@pytest.mark.parametrize("n", [8, 40, 150, 1000])
def test_recall_at_every_length(n):
    """Items of n words edited at the full distance, with unknown words and others of the vocabulary, in long hosts."""
    rng = random.Random(n)
    vocab = [f"w{int(3000 * rng.random() ** 2)}q" for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n)).encode()) for i in range(60)]
    index = dc.Index(items)
    assert all(g.recall >= dc.RECALL or g.exact for g in index.groups)
    texts = []
    for _, t in items:
        words = t.split()
        for _ in range(dc.edits_allowed(n)):
            at, new = rng.randrange(len(words)), rng.choice([b"unknown", rng.choice(vocab).encode()])
            rng.choice((lambda: words.__setitem__(at, new), lambda: words.insert(at, new), lambda: words.pop(at)))()  # noqa: B023
        host = [rng.choice(vocab).encode() for _ in range(300)]
        texts.append(b" ".join(host[:150] + words + host[150:]))
    found = index.search(texts)
    assert np.mean([any(f[0] == i for f in own) for (i, _), own in zip(items, found, strict=True)]) >= 0.97


def test_typing_errors_in_a_sentence():
    item = "the quick brown foxes jumped over lazy sleeping dogs beside rivers flowing under bridges"
    index = dc.Index([(1, item.encode()), (2, b"an entirely different question about mountains and valleys of another country")])
    found = index.search([b"so: The quikc bronw foxes jmuped over lzay slepeing dogs besdie rivres flowing undre brigdes, they say", b"the quick brown answer to mountains beside rivers"])
    assert [[f[0] for f in own] for own in found] == [[1], []]


def test_the_index_is_small_and_soon_made():
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"v{x}" for x in (20000 * rng.random(1000) ** 2).astype(int)).encode()) for i in range(1000)]
    start = time.time()
    index = dc.Index(items)
    assert time.time() - start < 60 and len(pickle.dumps(index)) < 50e6


def test_without_enough_recall_all_counted_windows_are_verified(monkeypatch):
    """Where the tables' bound is reached, nothing is lost."""
    monkeypatch.setattr(dc, "MOST_TABLES", 0)
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice((6, 12, 30)))).encode()) for i in range(30)]
    index = dc.Index(items)
    assert all(g.exact for g in index.groups)
    texts = []
    for _ in range(150):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, len(words) // 4)):
            words[rng.randrange(len(words))] = b"other"
        texts.append(b" ".join([f"w{rng.randrange(60)}".encode() for _ in range(20)] + words))
    for text, found in zip(texts, index.search(texts), strict=True):
        want = {(k, d) for k, t in items if (d := plain_best(t.split(), text.split())) <= dc.edits_allowed(len(t.split()))}
        assert {f[:2] for f in found} == want


def test_exact_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randint(1, 9))], [rng.randrange(5) for _ in range(rng.randint(0, 20))]
        assert dc.best_match(np.array(a), np.array(b, dtype=np.int64))[0] == plain_best(a, b)


def test_embedding_maps_edits_to_few_differences():
    items = [(i, " ".join(f"w{i}x{j}" for j in range(40)).encode()) for i in range(20)]
    index = dc.Index(items)
    zero = np.zeros(1, dtype=np.int64)
    steps = list(range(60))
    same = lambda a, b: np.mean([index.notes(index.padded(a), zero, 0, steps)[s][0] == index.notes(index.padded(b), zero, 0, steps)[s][0] for s in steps])
    one = np.delete(index.items[0], 20)
    assert same(index.items[0], index.items[0]) == 1.0 and same(index.items[0], one) > 0.5 > same(index.items[0], index.items[1])


def test_planted_edits_against_brute_force(spark, docs):
    rng = random.Random(11)
    bench = [r.text for r in common.documents(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    texts = [r.text for r in docs.limit(60).collect()]
    rows, items = [], [(i, t) for i, t in enumerate(bench)] + [(900, "two words"), (901, "")]
    for i in range(150):
        words = rng.choice(bench).split()
        for _ in range(rng.randint(0, len(words) // 4)):
            at = rng.randrange(len(words))
            (words.__setitem__(at, "other") if rng.random() < 0.5 else words.pop(at) if len(words) > 3 else None)
        host = rng.choice(texts).split()[:150]
        at = rng.randrange(len(host) + 1)
        rows.append((i, " ".join(host[:at] + words + host[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.leaks(df, table, ["doc_id"]).collect()}
    want, first = {}, {}
    for k, t in items:
        first.setdefault(t, k)
    vocab = {w for t in first for w in dc.words(t.encode())}
    made = {}
    for i, t in rows:
        w = respelt(dc.words(t.encode()), vocab, made)
        for text, k in first.items():
            x = dc.words(text.encode())
            if x and (d := plain_best(x, w)) <= dc.edits_allowed(len(x)):
                want[i, k] = d
    assert set(got) <= set(want) and all(got[p] == want[p] for p in got)
    assert len(got) >= 0.97 * len(want)
    clean = {r.doc_id for r in dc.drop_leaks(df, table).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in got}
    # In blocks of few words the same is found.
    small = {(r.doc_id, r.item_id) for r in dc.leaks(df, table, ["doc_id"], block_words=400).collect()}
    assert len(small ^ set(got)) <= 0.03 * len(want)


def test_odd(spark, odd, none):
    table = spark.createDataFrame([(1, "quick brown fox jumps"), (2, None), (None, "lazy dog and runs to the river")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(odd, table, ["doc_id"]).collect()}
    assert got == {(1, 1), (2, 1), (1, None), (2, None)}
    kept = dc.drop_leaks(odd, table)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert dc.leaks(none, table, ["doc_id"]).count() == 0
    assert dc.leaks(odd, table.limit(0), ["doc_id"]).count() == 0 and dc.drop_leaks(odd, table.limit(0)).count() == odd.count()
