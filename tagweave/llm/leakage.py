"""Evaluation passages inside a corpus: CGK walks and bit-sampling LSH over item-sized windows, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = 3  # steps of a walk between its two sampled outputs
_FILTER = np.uint64((1 << 20) - 1)
_ONES = np.uint64(2**64 - 1)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@cache
def _meet(lost: int, strange: int, steps: int = _STEPS) -> float:
    """Probability that the walks from one word of an item and of a passage stand on the next word they share at step ``steps``, if
    ``lost`` words of the item and ``strange`` ones of the passage lie between, and nothing they share follows."""
    at = {("start", 0, 0): 1.0}
    for _ in range(steps):
        then: dict[tuple, float] = {}

        def add(state: tuple, p: float) -> None:
            then[state] = then.get(state, 0.0) + p

        for (kind, a, b), p in at.items():
            if kind == "start":  # both on one word: one coin
                add((kind, 0, 0), p / 2)
                add(("met", 0, 0) if lost == strange == 0 else ("apart", 0, 0), p / 2)
            elif kind == "met":
                add((kind, 0, 0), p / 2)
            else:  # a and b words of the gaps are behind them; one at the end of its gap stands on the shared word
                for x in (0, 1):
                    for y in (0, 1):
                        if a + x <= lost and b + y <= strange:
                            add(("met", 0, 0) if (a + x, b + y) == (lost, strange) else (kind, a + x, b + y), p / 4)
        at = then
    return at.get(("met", 0, 0), 0.0)


@cache
def collision_rate(share: float, spread: float) -> float:
    """Expected collisions a repetition and word of the item of the worst passage that keeps ``share`` of the words within
    ``spread`` times the length: strange words spread evenly over the neighbours that are left (the rate is convex in their
    number), the lost words in runs of the worst length."""
    lost, strange, least = 1 - share, spread - share, 1.0
    for run in range(1, 9):
        gaps = lost / run
        pairs = max(share - gaps, 1e-9)
        whole, rest = divmod(strange / pairs, 1)
        near = (1 - rest) * _meet(0, int(whole)) + rest * _meet(0, int(whole) + 1)
        least = min(least, pairs * near + gaps * _meet(run, 0))
    return least


@cache
def least_collisions(n: int, repeats: int, share: float, spread: float, recall: float) -> int:
    """Collisions that the worst passage of an item of ``n`` words reaches with probability ``recall`` at least (binomial); 0 if there
    is no such number above 0."""
    trials = max(1, math.ceil(share * n)) * repeats
    p, tail, c = min(1.0, collision_rate(share, spread) * n * repeats / trials), 1.0, 0
    at = (1 - p) ** trials
    while c < trials:
        tail -= at
        if tail < recall:
            break
        c += 1
        at *= (trials - c + 1) / c * p / (1 - p) if p < 1 else 0
    return c


@cache
def least_in_run(run: int, repeats: int, recall: float) -> int:
    """Collisions that ``run`` consecutive words of an item reach with probability ``recall`` at least, in the normal approximation: a walk
    that moves and stays within the run collides."""
    stays = [sum(math.comb(_STEPS, k) for k in range(1, min(_STEPS, run - 1 - i) + 1)) / 2**_STEPS for i in range(run - 1)]
    mean, var = repeats * sum(stays), repeats * sum(p * (1 - p) for p in stays)
    deviations = next(z / 100 for z in range(0, 600) if 0.5 * math.erfc(-z / 100 / math.sqrt(2)) >= recall)
    return max(1, math.floor(mean - deviations * math.sqrt(var)))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _walks(flat: np.ndarray, starts: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """LSH keys of the CGK walks from ``starts`` in ``flat`` (word hashes, each text closed by a zero word, which no walk passes), and
    whether each walk moved.

    At every step the walk moves to the next word if a random bit of (repetition, step, word) says so. Walks of two texts that stand
    on one word go on together; an edit parts them until they meet again, which turns edit distance into Hamming distance of the
    outputs. The key samples two outputs, the first and that of step ``_STEPS``.
    """
    odd = np.random.default_rng(7919 * repeat + 17).integers(1, 2**63, _STEPS + 1, dtype=np.uint64) | np.uint64(1)
    at = starts.copy()
    for j in range(_STEPS):
        word = flat[at]
        at += ((_scramble(word ^ odd[j]) >> np.uint64(40)) & np.uint64(1)).astype(np.int64) & (word != 0)
    return _scramble(_scramble(flat[starts] * odd[_STEPS]) ^ (flat[at] + np.uint64(repeat))), (at > starts) & (flat[at] != 0)


def _flat(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid out one after the other, a zero word after each: the layout, and the place in it, the text and the place
    in the text of each word."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.arange(len(values)) + text
    flat = np.zeros(len(values) + len(lengths) + 1, np.uint64)
    flat[starts] = values
    return flat, starts, text, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Block:
    """A bounded number of evaluation items as arrays: their walks' keys with the items that hold them, and what exact comparison needs."""

    def __init__(self, ids: list, items: list[np.ndarray], repeats: int, least_run: int, share: float, spread: float, recall: float) -> None:
        self.ids, self.repeats, self.run = ids, repeats, least_run
        self.n = np.array([len(x) for x in items], np.int64)
        self.need = np.ceil(share * self.n - 1e-9).astype(np.int64)
        self.reach = np.maximum(1, np.floor(spread * self.n)).astype(np.int64)
        self.least = np.array([least_collisions(int(k), repeats, share, spread, recall) for k in self.n], np.int64)
        # Items too short for a sure collision are met by every single word, as many as needed: nothing is lost.
        self.short = self.least == 0
        self.least = np.where(self.short, self.need, self.least)
        self.least_run = least_in_run(least_run, repeats, 1 - (1 - recall) / 100)
        values = np.concatenate(items) if items else np.zeros(0, np.uint64)
        flat, starts, item, place = _flat(values, self.n)
        pairs = [np.stack([np.where(self.short[item], np.uint64(0), k), item.astype(np.uint64)], 1)[moved & ~self.short[item]] for k, moved in (_walks(flat, starts, r) for r in range(repeats))]
        pairs.append(np.stack([values, item.astype(np.uint64)], 1)[self.short[item]])
        pairs = np.unique(np.concatenate(pairs), axis=0)
        self.keys, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        self.holders, self.first, self.count = pairs[:, 1].astype(np.int64), first, count
        self.filter = np.zeros(int(_FILTER) + 1, bool)
        self.filter[(self.keys & _FILTER).astype(np.int64)] = True
        # Places of every word of every item as bits, one row for each item and word.
        self.vocabulary = np.unique(values)
        self.width = int(-(-max(self.n.max(initial=1), 1) // 64))
        at = item * (len(self.vocabulary) + 1) + np.searchsorted(self.vocabulary, values)
        self.masks = np.zeros((len(items) * (len(self.vocabulary) + 1), self.width), np.uint64)
        np.bitwise_or.at(self.masks, (at, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        self.grams = {(int(i), flat[s : s + least_run].tobytes()) for s, i, p in zip(starts, item, place) if p + least_run <= self.n[i]}

    def holding(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For keys that items hold: the indices into ``keys`` and the items, one row for each of both."""
        maybe = np.flatnonzero(self.filter[(keys & _FILTER).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        sure = self.keys[k] == keys[maybe]
        maybe, k = maybe[sure], k[sure]
        count = self.count[k]
        each = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(maybe, count), self.holders[np.repeat(self.first[k], count) + each]

    def common(self, flat_ids: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Longest common subsequences of items and stretches ``begin`` to ``end`` of ``flat_ids`` (vocabulary ids), bit-parallel over all
        pairs at once."""
        order = np.argsort(begin - end, kind="stable")
        item, begin, size = item[order], begin[order], (end - begin)[order]
        v = np.full((len(item), self.width), _ONES)
        row = item * (len(self.vocabulary) + 1)
        for j in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -j, side="left"))  # the longest come first
            m = self.masks[row[:live] + flat_ids[begin[:live] + j]]
            u, w, carry = v[:live] & m, v[:live], np.zeros(live, bool)
            for b in range(self.width):
                s = w[:, b] + u[:, b]
                more = s < w[:, b]
                s = s + carry
                carry = more | (carry & (s == 0))
                v[:live, b] = s | (w[:, b] & ~m[:, b])
        out = np.zeros(len(order), np.int64)
        out[order] = np.bitwise_count(~v).sum(1)
        return out


def _spans(pair: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one pair that overlap, put together; rows in the order of (pair, a), z rising with a."""
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (a[1:] > z[:-1])
    first = np.flatnonzero(new)
    return pair[first], a[first], z[np.append(first[1:], len(pair)) - 1] if len(first) else z


def search(block: Block, values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts (as word hashes) and items of ``block`` of which the first gives the second away."""
    n_items = len(block.ids)
    flat, starts, text, place = _flat(values, lengths)
    words_, items_ = [], []
    for r in range(block.repeats):
        key, moved = _walks(flat, starts, r)
        moved = np.flatnonzero(moved)
        at, item = block.holding(key[moved])
        words_.append(moved[at])
        items_.append(item)
    if block.short.any():
        at, item = block.holding(values)
        words_.append(at[block.short[item]])
        items_.append(item[block.short[item]])
    word, item = np.concatenate(words_), np.concatenate(items_)
    pair = text[word] * n_items + item
    # Few pairs have as many collisions at all; only theirs are put in order.
    few = np.minimum(block.least, block.least_run)
    enough = np.bincount(pair, minlength=len(lengths) * n_items)[pair] >= few[item]
    word, pair = word[enough], pair[enough]
    order = np.lexsort((word, pair))
    word, pair = word[order], pair[order]
    item, at = pair % n_items, place[word]

    def dense(k: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches in which a passage can lie that holds ``k`` neighbouring collisions within ``wide`` words."""
        last = np.arange(len(pair)) + k - 1
        fits = last < len(pair)
        last = np.minimum(last, max(0, len(pair) - 1))
        hit = np.flatnonzero(fits & (pair[last] == pair) & (at[last] - at < wide))
        p, base = pair[hit], word[hit] - at[hit]  # ``base``: index of the text's first word
        a = np.maximum(0, at[last[hit]] - wide[hit] + 1) + base
        z = np.minimum(lengths[p // n_items], at[hit] + wide[hit]) + base
        return _spans(p, a, z)

    found = []
    p, a, z = dense(np.full(len(pair), block.least_run), np.full(len(pair), block.run + _STEPS))
    raw = values
    for i, lo, hi in zip(p, a, z):
        if any((int(i % n_items), raw[s : s + block.run].tobytes()) in block.grams for s in range(lo, hi - block.run + 1)):
            found.append(i)
    done = np.array(found, np.int64)

    p, a, z = dense(block.least[item], block.reach[item])
    open_ = ~np.isin(p, done)
    p, a, z = p[open_], a[open_], z[open_]
    if len(p):
        ids = np.minimum(np.searchsorted(block.vocabulary, values), len(block.vocabulary) - 1)
        ids = np.where(block.vocabulary[ids] == values, ids, len(block.vocabulary))
        whole = block.common(ids, p % n_items, a, z) >= block.need[p % n_items]  # no window of a stretch holds more than it
        p, a, z = p[whole], a[whole], z[whole]
        # Exactly: every window that starts at a word of the item.
        count = z - a
        of = np.repeat(np.arange(len(p)), count)
        s = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + a[of]
        known = block.masks[(p[of] % n_items) * (len(block.vocabulary) + 1) + ids[s]].any(1)
        of, s = of[known], s[known]
        e = np.minimum(z[of], s + block.reach[p[of] % n_items])
        sure = block.common(ids, p[of] % n_items, s, e) >= block.need[p[of] % n_items]
        done = np.concatenate([done, p[of[sure]]])
    done = np.unique(done)
    return done // n_items, done % n_items


def _finder(block: object, grain: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(id, word hashes)`` to rows ``(id, index of the item)`` of what the texts give away of the broadcast ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        rows = max(1, (1 << 22) // max(1, len(b.ids)))
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64) if len(batch) else np.zeros(0, np.int64)
            values, first, skip = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), 0, 0
            while first < len(lengths):  # texts until about ``grain`` words are together, so that memory stays small
                take = min(rows, max(1, int(np.searchsorted(np.cumsum(lengths[first:]), grain, side="right"))))
                size = lengths[first : first + take]
                text, item = search(b, values[skip : skip + int(size.sum())], size)
                if len(text):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + text)), pa.array(item.astype(np.int32))], names=["doc_id", "k"])
                first, skip = first + take, skip + int(size.sum())

    return run


def leaks(
    documents: DataFrame,
    doc_id: Column,
    text: Column,
    items: DataFrame,
    item_id: Column,
    item_text: Column,
    least_run: int = 10,
    share: float = 0.75,
    spread: float = 1.5,
    repeats: int = 4,
    recall: float = 0.998,
    block_words: int = 1 << 15,
    grain: int = 200_000,
) -> DataFrame:
    """``doc_id, item_id``: every document with each item it gives away, once.

    A document gives an item away if it contains ``least_run`` consecutive words of it, or ``share`` of its words in order
    within ``spread`` times its length. Words are lower-case runs of letters and digits.

    Method: CGK random walks start at every word of documents and items, ``repeats`` times with other random bits; each is sampled at two
    outputs, and equal samples collide. In every window of a document, as long as the item may be spread, the item's collisions are
    counted; a window with as many as the worst passage has with probability ``recall`` is compared exactly: longest common
    subsequence in every window that starts at a word of the item, or equal runs of words. The worst passage loses words one by one
    and has strange words between all that are left. Walks are short: over a whole item they don't get back in step where every
    other word is strange. Items too short for a sure collision (under about ten words) are met by their single words instead.

    The corpus is read once for each block of items of about ``block_words`` words (an item is never cut), which is what is
    broadcast, so its size is bounded for any number of items; nothing of the corpus is shuffled, only found pairs are. Words are
    compared by 64-bit hashes.

    Defined results: null ids and null or empty texts are left out; repeated rows of an id count once as one pair; no items or no
    documents give no rows.
    """
    spark = documents.sparkSession
    hashed = lambda t: F.transform(words(t), lambda w: F.xxhash64(w).bitwiseOR(F.lit(1).cast("long")))
    docs = documents.select(doc_id.alias("doc_id"), text.alias("t")).where("doc_id is not null and t is not null").select("doc_id", hashed(F.col("t")).alias("h")).where("size(h) > 0")
    tests = items.select(item_id.alias("item_id"), hashed(item_text).alias("h")).where("item_id is not null and size(h) > 0").distinct()
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()

    def blocks() -> Iterator[Block]:
        ids: list = []
        held: list[np.ndarray] = []
        for row in tests.orderBy(F.size("h"), "item_id").toLocalIterator():
            ids.append(row["item_id"])
            held.append(np.array(row["h"], np.int64).view(np.uint64))
            if sum(map(len, held)) >= block_words or len(ids) >= 512:
                yield Block(ids, held, repeats, least_run, share, spread, recall)
                ids, held = [], []
        if ids:
            yield Block(ids, held, repeats, least_run, share, spread, recall)

    out = None
    for block in blocks():
        found = docs.mapInArrow(_finder(spark.sparkContext.broadcast(block), grain), f"doc_id {doc_type}, k int")
        names = spark.createDataFrame(pd.DataFrame({"k": range(len(block.ids)), "item_id": block.ids}), f"k int, item_id {item_type}")
        part = found.join(F.broadcast(names), "k").select("doc_id", "item_id")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"doc_id {doc_type}, item_id {item_type}")
    return out.distinct()
