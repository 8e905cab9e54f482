"""Exact token counts by the whole-token shortcut (operator 6).

For a BPE vocabulary with word-end marks, most pre-tokens are a single token. Which ones is
proved once, offline, on the driver: every vocabulary string that ends a word is decoded and
encoded alone by the library; those that give exactly one token form the *whole* set. Then a
pre-token in that set counts 1 without any merging, and only the rest goes through the merges.

White space always separates pre-tokens here (the tokenizer turns it into separators and drops
it), so the count of a text is the sum over its chunks between ASCII white space, and the count
of a chunk may be remembered.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pre-tokens whose merges one Python worker remembers at most.
MEMO = 400_000
#: Chunks the shortcut may handle: letters, digits and ASCII marks; others go to the library whole.
_PLAIN = regex.compile(r"[\p{L}\p{N}\x21-\x7E]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def prove_whole(path: str) -> frozenset[str]:
    """The strings that the library encodes as exactly one token, found by encoding each of them alone.

    A string is taken only if it is one pre-token that normalisation leaves as it is.
    """
    from tokenizers import Tokenizer

    tok, spec = Tokenizer.from_file(path), json.load(open(path))
    end, alphabet = spec["model"]["end_of_word_suffix"] or "", _byte_alphabet()
    split = pre_token_pattern(path)
    found = []
    for entry in spec["model"]["vocab"]:
        if not entry.endswith(end) or not all(c in alphabet for c in entry.removesuffix(end)):
            continue
        try:
            word = bytes(alphabet[c] for c in entry.removesuffix(end)).decode()
        except UnicodeDecodeError:
            continue
        if word and split.fullmatch(word) and split.findall(word) == [word] and tok.normalizer.normalize_str(word) == word:
            found.append(word)
    return frozenset(
        w for w, e in zip(found, tok.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1
    )


def pre_token_pattern(path: str) -> regex.Pattern:
    """The pattern by which the tokenizer file itself says that words are split."""
    parts = json.load(open(path))["pre_tokenizer"]
    parts = parts.get("pretokenizers", [parts])
    return regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split"))


class Counter:
    """Counts tokens of texts given as UTF-8 bytes."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.tok, self.whole, self.split = Tokenizer.from_file(path), whole, pre_token_pattern(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo, self.merged = common.Memo(self.chunk), {}

    def _merge(self, pre_token: str) -> int:
        n = self.merged.get(pre_token)
        if n is None:
            if len(self.merged) >= MEMO:
                self.merged.clear()
            n = self.merged[pre_token] = len(self.tok.encode(pre_token, add_special_tokens=False).ids)
        return n

    def chunk(self, raw: bytes) -> int:
        chunk = raw.decode()
        if not _PLAIN.fullmatch(chunk) or any(s in chunk for s in self.specials):
            return len(self.tok.encode(chunk, add_special_tokens=False).ids)
        pre_tokens = self.split.findall(self.tok.normalizer.normalize_str(chunk))
        return sum(1 if p in self.whole else self._merge(p) for p in pre_tokens)

    def text(self, raw: bytes) -> int:
        return sum(map(self.memo.__getitem__, raw.split()))


_counters: dict[str, Counter] = {}


def token_counts(
    docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, limit: int = 2048
) -> DataFrame:
    """``keep``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row; null texts are empty.

    The tokenizer file must lie at ``path`` on every executor. Nothing is truncated: very long texts are counted whole, empty ones have
    no tokens, repeated rows are counted each, an empty table gives no rows. The set sent to the executors is bounded by the vocabulary.
    """
    path = path or default_path()
    whole = prove_whole(path)

    def score(texts: list[bytes]) -> list[list]:
        counter = _counters.get(path)
        if counter is None:
            counter = _counters[path] = Counter(path, whole)
        return [[len(t) for t in texts], [counter.text(t) for t in texts]]

    counted = common.per_text(docs, keep, text, pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())]), score)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``documents``, see :func:`token_counts`."""
    return token_counts(common.documents(spark, sf_dir), ["doc_id"])
