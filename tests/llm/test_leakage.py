import random
import re

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm.leakage import Block, _flat, _walks, collision_rate, leaks, least_collisions, least_in_run, search

DOCS, ITEMS = "doc_id bigint, text string, item_id int, w string, place int", "item_id bigint, text string, doc_id string, n int, key int"
WORDS = [f"word{i}" for i in range(400)]


def text(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def found(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], ITEMS)
    rows = [tuple(r) for r in leaks(d, F.col("doc_id"), F.col("text"), e, F.col("item_id"), F.col("text"), **k).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], (prev + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def brute(doc, item):
    d, e = (re.findall(r"[^\W_]+", x.lower()) for x in (doc, item))
    if any(d[i : i + 10] == e[j : j + 10] and len(e[j : j + 10]) == 10 for i in range(len(d)) for j in range(len(e))):
        return True
    return any(subsequence(e, d[i : i + int(1.5 * len(e))]) >= 0.75 * len(e) for i in range(len(d)))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(k, text(rng, rng.randint(45, 90))) for k in range(12)]
    docs, kinds = [], {}
    for n in range(90):
        body = text(rng, rng.randint(0, 150))
        k, e = items[n % 12]
        kind = n % 9
        part = list(e)
        if kind == 0:
            part = e[5:15]
        elif kind == 1:
            part = e[5:14]
        elif kind == 2:  # every fourth word another: the worst that still counts
            part = [w if i % 4 else "other" for i, w in enumerate(e)]
        elif kind == 3:
            part = [w for i, w in enumerate(e) if i % 7]
        elif kind == 4:
            part = [x for i, w in enumerate(e) for x in ([w, "more"] if i % 8 == 0 else [w])]
        elif kind == 5:
            part = [w if i % 2 else "other" for i, w in enumerate(e)]
        elif kind == 6:
            part = [x for w in e for x in (w, "far", "off", "words")]
        elif kind == 7:
            part = []
        at = rng.randint(0, len(body))
        doc = body[:at] + part + body[at:]
        joined = "".join(w.upper() + rng.choice([" ", ", ", "\r\n", " - ", "."]) for w in doc)
        docs.append((n, joined))
        kinds[n] = kind
    docs += [(1000, None), (1001, ""), (1002, "..."), (None, docs[0][1]), docs[0], docs[0], (1003, " ".join(text(rng, 30_000) + items[3][1]))]
    plain = [(k, " ".join(e)) for k, e in items]
    want = {(n, k) for n, t in docs if t and n is not None and n < 1000 for k, e in plain if brute(t, e)} | {(1003, 3)}
    got = found(spark, docs, [*plain, plain[0], (77, None), (78, ""), (None, "a b c d e f g h i j k l"), (79, "two words")])
    assert got == want
    assert {kinds[n] for n, _ in got if n < 1000} == {0, 2, 3, 4, 8}


def test_nothing_leaks_from_nothing(spark):
    assert found(spark, [], [(1, "a b c d e f g h i j k l")]) == set()
    assert found(spark, [(1, "a b c d e f g h i j k l")], []) == set()


def hashes(rng, n):
    return rng.integers(1, 2**62, n).astype(np.uint64) | np.uint64(1)


def test_walks_of_equal_runs_collide_and_stay_within_their_text():
    rng = np.random.default_rng(1)
    a, b = hashes(rng, 10), hashes(rng, 10)
    flat, starts, text, place = _flat(np.concatenate([a, b[:3], a]), np.array([10, 13]))
    keys, moved = zip(*(_walks(flat, starts, r) for r in range(30)))
    keys, moved = np.array(keys), np.array(moved)
    assert (keys[:, :7] == keys[:, 13:20]).all() and (moved[:, :7] == moved[:, 13:20]).all()
    assert not moved[:, 9].any() and not moved[:, -1].any() and 0.8 < moved[:, :7].mean() < 0.95


def worst(n):
    """Passages of three quarters of n words within 1.5 n, as places in the item, -1 for a strange word."""
    left = [i for i in range(n) if i % 4 != 3]
    yield [x for i in left for x in [i] + [-1] * (2 - i % 4)]
    yield [x for i in left for x in (i, -1)]
    yield [x for k, i in enumerate(left) for x in [i] + [-1, -1] * (k % 2)]
    yield [x for i in range(3 * n // 4) for x in (i, -1)]
    yield [x for k, i in enumerate(range(3 * n // 4)) for x in [i] + [-1] * (k % 2)]
    yield [i if i % 4 != 3 else -1 for i in range(n)]


def test_recall_of_the_worst_passages():
    rng = np.random.default_rng(4)
    for n in (12, 24, 44, 60, 76, 100):
        for shape in [*worst(n), range(n // 2 - 5, n // 2 + 5)]:
            found = 0
            for _ in range(2):
                items = [hashes(rng, n) for _ in range(100)]
                passages = [np.where(np.array(list(shape)) < 0, hashes(rng, len(shape)), e[np.array(list(shape))]) for e in items]
                texts = [np.concatenate([hashes(rng, rng.integers(0, 40)), p, hashes(rng, rng.integers(0, 40))]) for p in passages]
                text, item = search(Block(list(range(100)), items, 4, 10, 0.75, 1.5, 0.998), np.concatenate(texts), np.array([len(t) for t in texts]))
                assert (text == item).all()
                found += len(text)
            assert found >= 198, (n, list(shape), found)


def test_least_collisions_follow_the_recall():
    assert 0.08 < collision_rate(0.75, 1.5) < 0.09 and collision_rate(0.75, 1.0) > collision_rate(0.75, 1.5)
    assert least_collisions(60, 4, 0.75, 1.5, 0.999) <= least_collisions(60, 4, 0.75, 1.5, 0.9) <= least_collisions(90, 4, 0.75, 1.5, 0.9)
    assert least_collisions(4, 4, 0.75, 1.5, 0.99) == 0 and 15 < least_in_run(10, 4, 0.9999) < 29


def test_exact_comparison():
    rng = np.random.default_rng(2)
    for n in (3, 12, 64, 65, 130, 200):
        items = [hashes(rng, n), hashes(rng, n)]
        block = Block([0, 1], items, 4, 10, 0.75, 1.5, 0.998)
        texts = [np.concatenate([items[k][rng.random(n) < keep], hashes(rng, 5)]) for k in (0, 1) for keep in (1, 0.6, 0.2)]
        texts = [rng.permutation(t) if len(t) % 2 else t for t in texts]
        flat = np.concatenate(texts)
        ids = np.minimum(np.searchsorted(block.vocabulary, flat), len(block.vocabulary) - 1)
        ids = np.where(block.vocabulary[ids] == flat, ids, len(block.vocabulary))
        ends = np.cumsum([len(t) for t in texts])
        got = block.common(ids, np.array([0, 0, 0, 1, 1, 1]), ends - [len(t) for t in texts], ends)
        assert got.tolist() == [subsequence(items[k // 3].tolist(), t.tolist()) for k, t in enumerate(texts)]


def test_stray_words_between_short_runs_are_found(spark):
    rng = random.Random(8)
    items = [text(rng, 44 + 4 * k) for k in range(8)]
    docs, want = [], set()
    for n in range(24):
        e, kind = items[n % 8], n // 8
        if kind == 0:  # a stray word after every second word
            part = [x for i, w in enumerate(e) for x in ([w, f"stray{i}"] if i % 2 else [w])]
        else:  # every fourth word lost (and one more, which is too many), and a stray word after every second one that is left
            part = [x for i, w in enumerate([w for i, w in enumerate(e) if i % 4 != 3][kind - 1 :]) for x in ([w, f"stray{i}"] if i % 2 else [w])]
        docs.append((n, " ".join([f"before{i}" for i in range(rng.randint(0, 60))] + part)))
        want |= {(n, n % 8)} if kind < 2 else set()
        assert brute(docs[-1][1], " ".join(e)) is (kind < 2)
    assert found(spark, docs, [(k, " ".join(e)) for k, e in enumerate(items)]) == want


def test_short_items_are_found(spark):
    assert found(spark, [(1, "now two strange words"), (2, "two words")], [(1, "two words"), (2, "alone")]) == {(1, 1), (2, 1)}


def test_passages_of_the_greatest_spread_are_found_at_any_offset(spark):
    rng = random.Random(9)
    e = text(rng, 64)
    spread = [x for i, w in enumerate(e[:48]) for x in (w, f"stray{i}")][:-1]  # 48 of 64 words within 95 of 96
    wider = spread[:50] + ["x", "y"] + spread[50:]
    docs = [(n, " ".join([f"before{i}" for i in range(n)] + spread + ["after"] * 40)) for n in range(10)]
    docs += [(99, " ".join(wider)), (98, " ".join(["before"] * 3 + wider + ["after"] * 40))]
    assert found(spark, docs, [(1, " ".join(e))]) == {(n, 1) for n in range(10)}


def test_blocks_of_items_and_small_grains_change_nothing(spark):
    rng = random.Random(10)
    items = [text(rng, rng.randint(3, 80)) for _ in range(9)]
    docs = [(n, " ".join(text(rng, 30) + items[n % 9] + text(rng, 30))) for n in range(27)]
    plain = [(k, " ".join(e)) for k, e in enumerate(items)]
    assert found(spark, docs, plain) == found(spark, docs, plain, block_words=50, grain=60) == {(n, n % 9) for n in range(27)}


def test_very_long_items(spark):
    rng = random.Random(11)
    item = [f"w{i}" for i in range(700)]
    assert found(spark, [(1, " ".join(item[:530])), (2, " ".join(item[::2])), (3, " ".join(item[300:310]))], [(5, " ".join(item))]) == {(1, 5), (3, 5)}
