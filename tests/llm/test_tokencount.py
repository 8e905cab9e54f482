from millrace.llm import tokencount


def library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokencount.default_path())
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


HARD = [
    "It's 'stuff' don't we'll THE the. naïve Ünï çà é é  x y\x1cz\x85w 12345 a1b2",
    "<|endoftext|> and <|startoftext|>x <|endof", "ﬁ ½ Ⅷ İstanbul ΣΑΣ ß", "日本語 テスト 😀👍🏽", "....!!!??? --- ''' \"\" 's's't", "x" * 300, "",
]


def test_whole_tokens_are_proved():
    from tokenizers import Tokenizer

    whole = tokencount.prove_whole(tokencount.default_path())
    assert len(whole) > 20000 and "the" in whole
    tok = Tokenizer.from_file(tokencount.default_path())
    assert all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[::97])


def test_hard_texts():
    counter = tokencount.Counter(tokencount.default_path(), tokencount.prove_whole(tokencount.default_path()))
    assert [counter.text(t.encode()) for t in HARD] == library(HARD)


def test_documents(docs, odd, none):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), n, n > 2048) for r, n in zip(rows, library([r.text for r in rows])))
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(df, ["doc_id"]).collect())
        assert got == want
    assert tokencount.token_counts(none, ["doc_id"]).count() == 0
