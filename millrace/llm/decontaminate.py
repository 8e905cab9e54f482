"""Benchmark decontamination under edit distance (operator 3).

Texts and benchmark items are sequences of words, lower-cased and without marks; an item leaks into a document if
some stretch of the document is within floor((1 - SIMILARITY) * words) word edits of it. A word that the benchmark doesn't
have, and that is one letter's edit (left out, put in, changed, or swapped with its neighbour) from exactly one of its words
of ``SPELT`` letters or more, counts as that word.

The CGK embedding walks over a sequence with shared random bits: at step j it notes the word it
stands on and, depending on the bit that step and word have, stays or moves on. Two
sequences at small edit distance fall back into step, so their notes differ in few places: edit
distance becomes Hamming distance. Bit sampling then hashes a window by the notes at a few random
steps. Items over ``CHUNK`` words are walked over from every ``CHUNK``-th word, as some of these stretches has no more than its share of the edits.
Walks and samples are repeated until edited copies of the items themselves, at the
largest distance allowed, are found with ``RECALL``; the windows that meet an item are verified by
exact edit distance. Where the tables' bound is reached first, all counted windows of that group are verified (``Group.exact``).

Windows begin at every word. Before any walk they are counted, item by item: a stretch within k edits of an item
with r rare words (those that few items have) holds at least r - k of them, so windows with fewer
are no match of that item. This loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIMILARITY, RECALL = 0.8, 0.98
SAMPLED = 2  # notes in a hash
WALKS, MOST_TABLES = 6, 32  # walks, and samples of each at most
CHUNK = 64  # words from one walk's start to the next in long items
TRIALS, TRIAL_WORDS = 4000, 2_000_000  # edited copies that recall is measured on, and words of these, at most
SPELT = 5  # letters of a word that may be misspelt
RARE = 0.02  # share of the items that may have a word for it to count as rare
#: Items are searched for in blocks of so many words, so that what the executors get is bounded.
BLOCK_WORDS = 2_000_000
#: Blocks that are searched for in one reading of the documents.
BLOCKS_AT_ONCE = 4
_MARKS = b".,;:!?\"'()[]{}<>|*%&$#@~`^=+-_/\\"
_PLAIN = bytes(32 if c in _MARKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs without white space and marks."""
    return text.translate(_PLAIN).split()


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int(n * (1 - similarity) + 1e-9)


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(least edit distance of ``item`` to any stretch of ``region``, where that stretch ends), exactly.

    Dynamic programming by rows of the item; a stretch may begin anywhere at no cost.
    """
    row = np.zeros(len(region) + 1, dtype=np.int64)
    steps = np.arange(len(region) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != w))
        row = np.minimum.accumulate(new - steps) + steps  # insertions run along the row
    end = int(row.argmin())
    return int(row[end]), end


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Spelling:
    """Ids of words: of the vocabulary, and of words one letter's edit from exactly one of its words; 0 for others.

    Words with one letter left out are kept as sorted hashes. All new words of a batch are hashed at once, whole and with each letter left
    out; a table of marks tells that most propose nothing, and what is proposed is compared letter by letter. Answers are remembered, with a bound.
    """

    MOST = 150_000
    MARKS = 16, 26  # bits of the least and greatest table of marks
    WIDE = 40  # letters of a word that is looked at, besides the vocabulary's own
    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: dict[bytes, int]):
        self.vocab, self.names, self.known = vocab, [b"", *vocab], dict(vocab)
        common.remembers(self)
        self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.WIDE, self._BASE)]), dtype=np.uint64)
        self.back = np.uint64(pow(int(self._BASE), -1, 1 << 64))
        long = [w for w in vocab if SPELT <= len(w) <= self.WIDE]
        hashes, owner = self._hashes(long)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], np.array([vocab[w] for w in long], dtype=np.int32)[owner[order]]
        self.bits = np.uint64(64 - min(max(self.MARKS[0], (256 * len(hashes)).bit_length()), self.MARKS[1]))
        self.marks = np.zeros(1 << int(64 - self.bits), dtype=bool)
        self.marks[self.hashes >> self.bits] = True

    def __reduce__(self) -> tuple:
        return Spelling, (self.vocab,)

    def clear(self) -> None:
        """Forgets all but the vocabulary."""
        self.known = dict(self.vocab)

    def _hashes(self, words_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of its word) of every word and of every word without each of its letters. A hash is a polynomial in the letters."""
        sizes = np.array(list(map(len, words_)), dtype=np.int64)
        if not len(sizes):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        place = np.arange(sizes.max())[None, :]
        inside = place < sizes[:, None]
        letters = np.zeros(inside.shape, dtype=np.uint64)
        letters[inside] = np.frombuffer(b"".join(words_), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        terms = letters * self.powers[: inside.shape[1]]
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)  # with each letter
        whole = upto[:, -1]
        without = upto - terms + (whole[:, None] - upto) * self.back
        owner = np.arange(len(words_))
        return _scramble(np.concatenate([whole, without[inside]])), np.concatenate([owner, np.repeat(owner, sizes)])

    @staticmethod
    def one_edit(a: bytes, b: bytes) -> bool:
        """Whether two different words are one letter left out, put in, changed, or swapped with its neighbour apart."""
        if abs(len(a) - len(b)) > 1:
            return False
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        x, y = a[same:], b[same:]
        return x[1:] == y[1:] or x[1:] == y or x == y[1:] or x[:2] == y[:2][::-1] and x[2:] == y[2:]

    def _learn(self, new: list[bytes]) -> None:
        if len(self.known) + len(new) > len(self.vocab) + self.MOST:
            self.clear()
        self.known.update(dict.fromkeys(new, 0))
        new = [w for w in new if SPELT - 1 <= len(w) <= self.WIDE]
        for first in range(0, len(new), 8192):
            some = new[first : first + 8192]
            hashes, owner = self._hashes(some)
            marked = np.flatnonzero(self.marks[hashes >> self.bits])
            low, high = (np.searchsorted(self.hashes, hashes[marked], side) for side in ("left", "right"))
            near: dict[int, set[int]] = {}
            for k in np.flatnonzero(high > low).tolist():
                near.setdefault(int(owner[marked[k]]), set()).update(self.ids[low[k] : high[k]].tolist())
            for k, ids in near.items():
                found = [i for i in ids if self.one_edit(some[k], self.names[i])]
                if len(found) == 1:
                    self.known[some[k]] = found[0]

    def __call__(self, words_: list[bytes]) -> np.ndarray:
        """The id of each word."""
        out = np.fromiter(map(self.known.get, words_, repeat(-1)), dtype=np.int32, count=len(words_))
        new = out < 0
        if new.any():
            rest = list(compress(words_, new.tolist()))
            self._learn(list(set(rest)))
            out[new] = np.fromiter(map(self.known.__getitem__, rest), dtype=np.int32, count=len(rest))
        return out


@dataclass
class Group:
    """Items of similar length: their walks, samples and hash tables."""

    low: int
    high: int
    bit: int
    need: int  # marked words that any match holds
    steps: int
    members: np.ndarray
    words: np.ndarray  # counted words, ascending
    first: np.ndarray  # where the holders of each begin in ``holders``
    holders: np.ndarray  # places among the members
    least: np.ndarray  # counted words that any match of each member holds
    tables: list = field(default_factory=list)  # (walk, sampled steps, sorted keys, item of each key, word of the item where its walk starts)
    recall: float = 0.0  # of edited copies
    exact: bool = False  # the recall wasn't reached: all counted windows are verified


class Index:
    """LSH tables over one block of items, and the search of texts. Sent to the executors by broadcast."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 3):
        self.similarity = similarity
        self.ids = [i for i, _ in items]
        split = [words(t) for _, t in items]
        self.spelling = Spelling({w: k + 1 for k, w in enumerate(sorted({w for ws in split for w in ws}))})  # 0: any other word
        self.items = [np.array([self.spelling.vocab[w] for w in ws], dtype=np.int32) for ws in split]
        self.base = len(self.spelling.vocab) + 1
        self.groups: list[Group] = []
        # The bit of step j and word w is the top bit of turns[walk][w] * odd[j].
        self.turns = _scramble(np.arange(self.base, dtype=np.uint64)[None, :] + (np.arange(WALKS, dtype=np.uint64) << np.uint64(40))[:, None]).astype(np.uint32)
        self.odd = (_scramble(np.arange(2 * CHUNK, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
        self.marks = np.zeros(self.base, dtype=np.uint64)
        held = np.bincount(np.concatenate([np.unique(x) for x in self.items] or [np.empty(0, np.int32)]), minlength=self.base)
        rare = held <= max(2, RARE * len(self.items))
        # The words that count for an item: its rare ones, or all where it has too few of them.
        self.counted = [x[rare[x]] if np.count_nonzero(rare[x]) - edits_allowed(len(x), similarity) >= 3 else x for x in self.items]
        kinds: dict[tuple, list[int]] = {}
        for k, x in enumerate(self.items):
            if len(x):
                kinds.setdefault((len(self.counted[k]) == len(x), len(x)), []).append(k)
        sizes, rng = sorted(kinds), np.random.default_rng(seed)
        while sizes:
            kind, low = sizes[0]
            own = [x for k, x in sizes if k == kind and x <= max(low, int(low * 1.15))]
            sizes = [(k, x) for k, x in sizes if k != kind or x > own[-1]]
            members = np.array(sorted(m for x in own for m in kinds[kind, x]))
            need = min(len(self.counted[k]) - edits_allowed(len(self.items[k]), similarity) for k in members)
            # Beyond 63 groups the last ones share a mark, which only makes the count less strict.
            least = np.maximum(1, [len(self.counted[k]) - edits_allowed(len(self.items[k]), similarity) for k in members])
            sets = [np.unique(self.counted[k]) for k in members]
            flat, holder = np.concatenate(sets), np.repeat(np.arange(len(members)), list(map(len, sets)))
            order = np.argsort(flat, kind="stable")
            held_by, first = np.unique(flat[order], return_index=True)
            steps = max(SAMPLED, int(1.5 * min(low, CHUNK)))
            g = Group(low, own[-1], min(len(self.groups), 63), max(1, need), steps, members, held_by, np.append(first, len(flat)), holder[order], least)
            self.marks[np.concatenate([self.counted[k] for k in members])] |= np.uint64(1 << g.bit)
            self.groups.append(g)
            self._build(g, recall, rng)

    # -- embedding

    def notes(self, ids: np.ndarray, starts: np.ndarray, walk: int, wanted: list[int], turned: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """The words noted at the wanted steps by walks from each start of padded ``ids``; 0 past their end. ``turned``: the words' turns, if at hand."""
        out, last, at, want = {}, max(wanted), starts.copy(), set(wanted)
        turned = self.turns[walk][ids] if turned is None else turned
        for j in range(last):
            if j in want:
                out[j] = ids[at]
            at += turned[at] * self.odd[j] >> np.uint32(31)
        out[last] = ids[at]
        return out

    def padded(self, ids: np.ndarray) -> np.ndarray:
        """``ids`` with as many zeros behind as the longest walk can take steps."""
        return np.concatenate([ids, np.zeros(2 * CHUNK, dtype=ids.dtype)])

    def _key(self, notes: dict[int, np.ndarray], steps: tuple[int, ...]) -> np.ndarray:
        key, some = np.zeros(len(notes[steps[0]]), dtype=np.uint64), np.ones(len(notes[steps[0]]), dtype=bool)
        for s in steps:
            key = (key + notes[s].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
            some &= notes[s] > 0
        key[~some] = 0  # a note of an unknown word never meets an item
        return key

    @staticmethod
    def walk_starts(n: int) -> list[int]:
        """Where walks over an item of ``n`` words start: every ``CHUNK`` words, the last with a complete stretch before the end."""
        return list(range(0, max(1, n - CHUNK + 1), CHUNK))

    def _edited(self, ids: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, list[int]]:
        """A copy at about the largest distance allowed, by random edits, a third of each kind, with unknown words and others of the
        vocabulary; and where the walks' starts have come to."""
        out, at = list(ids), list(range(len(ids)))  # at: the place in the item that each word comes from, -1 for new ones
        for _ in range(edits_allowed(len(ids), self.similarity)):
            kind, k = int(rng.integers(3)), int(rng.integers(len(out))) if out else 0
            word = int(rng.integers(self.base)) if rng.random() < 0.5 else 0
            if kind == 0 and out:
                out[k] = word
            elif kind == 1:
                out.insert(k, word)
                at.insert(k, -1)
            elif out:
                del out[k], at[k]
        where = {}
        for place, origin in enumerate(at):
            if origin >= 0:
                where[origin] = place
        starts = []
        for start in self.walk_starts(len(ids)):
            later = next((where[x] for x in range(start, len(ids)) if x in where), len(out))
            starts.append(later)
        return np.array(out, dtype=np.int32), starts

    def _laid(self, rows: list[tuple[np.ndarray, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all sequences, each padded, as one; where the walks start; the row of each start)."""
        parts, starts, owners, at = [], [], [], 0
        for k, (ids, own) in enumerate(rows):
            parts.append(self.padded(ids))
            starts += [at + x for x in own]
            owners += [k] * len(own)
            at += len(parts[-1])
        return np.concatenate(parts), np.array(starts, dtype=np.int64), np.array(owners, dtype=np.int64)

    def _build(self, g: Group, recall: float, rng: np.random.Generator) -> None:
        """Adds tables until ``recall`` of edited copies, drawn over all members, meet their own item at their own place, or the bound is reached."""
        n = int(np.clip(TRIAL_WORDS // g.high, 100, TRIALS))
        drawn = np.resize(rng.permutation(len(g.members)), max(400, min(n, len(g.members))) if n > 400 else n)
        flat, starts, owners = self._laid([(self.items[k], self.walk_starts(len(self.items[k]))) for k in g.members])
        offsets = np.concatenate([self.walk_starts(len(self.items[k])) for k in g.members]).astype(np.int32)
        first = np.searchsorted(owners, np.arange(len(g.members)))
        trials, tstarts, towners = self._laid([self._edited(self.items[g.members[k]], rng) for k in drawn])
        own = first[drawn[towners]] + np.arange(len(towners)) - np.searchsorted(towners, towners)  # the same stretch of the item itself
        missed = np.ones(len(drawn), dtype=bool)
        for _ in range(MOST_TABLES):
            for walk in range(WALKS):
                steps = tuple(sorted(rng.choice(g.steps, size=min(SAMPLED, g.steps), replace=False).tolist()))
                keys = self._key(self.notes(flat, starts, walk, list(steps)), steps)
                order = np.argsort(keys, kind="stable")
                g.tables.append((walk, steps, keys[order], g.members[owners[order]], offsets[order]))
                met = self._key(self.notes(trials, tstarts, walk, list(steps)), steps)
                missed[towners[(met == keys[own]) & (met > 0)]] = False
            g.recall = 1 - float(missed.mean())
            if g.recall >= recall:
                return
        g.exact, g.tables = True, []

    # -- search

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text: (item_id, edit distance, words of the item, word where the stretch ends) of each item that
        leaks into it, by its best match. The texts of a batch are searched as one sequence; matches keep to one text."""
        split = [words(t) for t in texts]
        lengths = list(map(len, split))
        ids = self.spelling(list(chain.from_iterable(split)))
        bounds = np.cumsum([0, *lengths])  # where each text begins among the words
        padded = self.padded(ids)
        best: list[dict] = [{} for _ in texts]
        turned: dict[int, np.ndarray] = {}
        marks = self.marks[ids]
        marked = np.flatnonzero(marks)
        marks = marks[marked]
        for g in self.groups:
            width = g.high + edits_allowed(g.high, self.similarity)
            pos = marked[(marks >> np.uint64(g.bit)) & np.uint64(1) == 1]
            if len(pos) < g.need:
                continue
            first, last = self._runs(g, pos, ids[pos], len(ids), width)
            if len(first):
                # Windows from last - width + 1 to first hold all of these; walks over long items also start further on in them.
                reach = 0 if g.high < 2 * CHUNK or g.exact else g.high
                edge = np.zeros(len(ids) + 1, dtype=np.int32)
                np.add.at(edge, np.maximum(last - width + 1, 0), 1)
                np.add.at(edge, np.minimum(first + reach + 1, len(ids)), -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                pairs = self._counted(g, ids, bounds, starts, width) if g.exact else self._met(g, padded, starts, turned)
                self._verify(g, ids, bounds, pairs, width, best)
        return [[(self.ids[k], d, len(self.items[k]), e) for k, (d, e) in sorted(b.items())] for b in best]

    @staticmethod
    def _runs(g: Group, pos: np.ndarray, ids: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) place of each run of marked words ``ids`` at ``pos`` that holds enough words of one and the same member within ``width``.

        Where words have very many holders, runs of enough words of any members are given, which are a superset."""
        near = np.flatnonzero(pos[g.need - 1 :] - pos[: len(pos) - g.need + 1] < width)
        if not len(near):
            return pos[:0], pos[:0]
        # Only words of such runs can be in a run of one member.
        edge = np.zeros(len(pos) + 1, dtype=np.int64)
        np.add.at(edge, near, 1)
        np.add.at(edge, near + g.need, -1)
        some = np.cumsum(edge[:-1]) > 0
        kept, found = pos[some], np.searchsorted(g.words, ids[some])
        known = g.words[np.minimum(found, len(g.words) - 1)] == ids[some]  # beyond 63 groups, marks are shared
        kept, found = kept[known], found[known]
        n = g.first[found + 1] - g.first[found]
        if n.sum() > 16 * len(pos):
            return pos[near], pos[near + g.need - 1]
        which = np.repeat(g.first[found] - np.cumsum(n) + n, n) + np.arange(n.sum())
        stride = size + width + 1
        keys = np.sort(g.holders[which].astype(np.int64) * stride + np.repeat(kept, n))
        end = np.arange(len(keys)) + g.least[keys // stride] - 1
        ok = np.flatnonzero(end < len(keys))
        ok = ok[keys[end[ok]] - keys[ok] < width]
        return keys[ok] % stride, keys[end[ok]] % stride

    def _met(self, g: Group, padded: np.ndarray, starts: np.ndarray, turned: dict[int, np.ndarray]) -> np.ndarray:
        """(item, word where it would begin, word where a walk met it) by the tables. ``turned`` keeps the words' turns of each walk."""
        by_walk: dict[int, list] = {}
        for walk, *rest in g.tables:
            by_walk.setdefault(walk, []).append(rest)
        met = [np.empty((0, 3), dtype=np.int64)]
        for walk, tables in by_walk.items():
            if walk not in turned:
                turned[walk] = self.turns[walk][padded]
            notes = self.notes(padded, starts, walk, sorted({s for steps, *_ in tables for s in steps}), turned[walk])
            for steps, keys, members, offsets in tables:
                own = self._key(notes, steps)
                left, right = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                hit = np.flatnonzero((right > left) & (own > 0))
                n = right[hit] - left[hit]
                if len(hit):
                    which = np.repeat(left[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    at = np.repeat(starts[hit], n)
                    met.append(np.stack([members[which], at - offsets[which], at], axis=1))
        return np.unique(np.concatenate(met), axis=0)

    def _counted(self, g: Group, ids: np.ndarray, bounds: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """As :meth:`_met`, of every member and every run of counted windows that holds enough of its words."""
        flat = np.concatenate([self.counted[k] for k in g.members])
        owner = np.repeat(np.arange(len(g.members)), [len(self.counted[k]) for k in g.members])
        least = np.array([len(self.counted[k]) - edits_allowed(len(self.items[k]), self.similarity) for k in g.members])
        found = [np.empty((0, 3), dtype=np.int64)]
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            there = np.unique(ids[run[0] : run[-1] + width])
            enough = np.flatnonzero(np.bincount(owner[np.isin(flat, there)], minlength=len(g.members)) >= least)
            if len(enough):
                found.append(np.stack([np.repeat(g.members[enough], len(run)), np.tile(run, len(enough)), np.tile(run, len(enough))], axis=1))
        return np.concatenate(found)

    def _verify(self, g: Group, ids: np.ndarray, bounds: np.ndarray, pairs: np.ndarray, width: int, best: list[dict]) -> None:
        if not len(pairs):
            return
        slack = edits_allowed(g.high, self.similarity)
        texts = np.searchsorted(bounds, pairs[:, 2], "right") - 1
        order = np.lexsort((pairs[:, 1], texts, pairs[:, 0]))
        pairs, texts = pairs[order], texts[order]
        # Neighbouring windows of one item in one text are verified together.
        fresh = (np.diff(pairs[:, 0]) != 0) | (np.diff(texts) != 0) | (np.diff(pairs[:, 1]) > width)
        cuts = np.concatenate([[0], np.flatnonzero(fresh) + 1, [len(pairs)]])
        there = np.zeros(self.base, dtype=bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k, t = int(pairs[a, 0]), int(texts[a])
            item = self.items[k]
            allowed = edits_allowed(len(item), self.similarity)
            low = max(int(bounds[t]), int(pairs[a, 1]) - slack)
            high = min(int(bounds[t + 1]), int(pairs[b - 1, 1]) + width + slack)
            if high <= low:
                continue
            region = ids[low:high]
            there[region] = True
            enough = np.count_nonzero(there[item]) >= len(item) - allowed
            there[region] = False
            if not enough:
                continue
            d, end = best_match(item, region)
            found = (d, low + end - int(bounds[t]))
            if d <= allowed and (k not in best[t] or found < best[t][k]):
                best[t][k] = found


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """Distinct item texts (least item_id of each), in blocks of bounded size. The benchmark's words are counted first;
    the driver holds one block after the other."""
    distinct = common.stage(
        benchmark.filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text"), "items"
    )
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + int(total) // (6 * block_words)
    for p in range(parts):
        rows = distinct.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        yield [(r["item_id"], r["text"].encode()) for r in rows]
    common.release(distinct)


def _indexes(benchmark: DataFrame, similarity: float, block_words: int) -> Iterator[list[Broadcast]]:
    """Broadcast indexes, ``BLOCKS_AT_ONCE`` of them for each reading of the documents; one list at least."""
    context, held = benchmark.sparkSession.sparkContext, []
    for items in _blocks(benchmark, block_words):
        held.append(context.broadcast(Index(items, similarity)))
        if len(held) == BLOCKS_AT_ONCE:
            yield held
            held = []
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep``, item_id, distance, n_words, similarity, end_word: one row for each row of ``docs`` and item that leaks into it.

    Null, empty and wordless texts and items match nothing; texts are searched whole, however long. Items with equal texts count as the one
    with the least item_id (null where all are); repeated rows of ``docs`` are reported each; of several stretches the nearest,
    then the first, is. An empty table on either side gives no rows. Columns of ``docs`` besides ``keep`` and text aren't read.
    """
    out, fields = None, pa.schema([("found", pa.list_(pa.list_(pa.int64())))])
    for indexes in _indexes(benchmark, similarity, block_words):

        def score(texts: list[bytes], indexes: list[Broadcast] = indexes) -> list[list]:
            found = [index.value.search(texts) for index in indexes]
            return [[[list(map(_plain, x)) for own in each for x in own] for each in zip(*found, strict=True)]]

        made = common.per_text(docs, keep, "text", fields, score).select(*keep, F.explode("found").alias("f"))
        out = made if out is None else out.unionByName(made)
    return out.select(
        *keep,
        F.get("f", F.lit(0)).alias("item_id"),
        F.get("f", F.lit(1)).alias("distance"),
        F.get("f", F.lit(2)).alias("n_words"),
        (1 - F.get("f", F.lit(1)) / F.get("f", F.lit(2))).alias("similarity"),
        F.get("f", F.lit(3)).alias("end_word"),
    )


def _plain(x: int | None) -> int | None:
    return None if x is None else int(x)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with the columns as they were: null, empty and wordless texts stay, repeated
    rows stay or go together, and an empty benchmark drops nothing."""
    columns = docs.columns
    for indexes in _indexes(benchmark, similarity, block_words):

        def score(texts: list[bytes], indexes: list[Broadcast] = indexes) -> list[list]:
            found = [index.value.search(texts) for index in indexes]
            return [[not any(each) for each in zip(*found, strict=True)]]

        made = common.per_text(docs.withColumn("__t", F.col("text")), columns, "__t", pa.schema([("__clean", pa.bool_())]), score)
        docs = made.filter("__clean").select(*[F.col(f"`{c}`") for c in columns])
    return docs


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, n_words, similarity, end_word of every item of ``benchmark`` that leaks into a row of ``documents``, see :func:`leaks`."""
    return leaks(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark"), ["doc_id"])
