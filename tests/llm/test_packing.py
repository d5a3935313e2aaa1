import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.llm.packing import fill, pack, plan, token_count, tokenizer_count


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 500), max_size=30))
def test_plan_places_every_item_once_and_overfills_nothing(histogram):
    groups, placed = plan(histogram.items(), 60), {}
    for n, takes in groups:
        assert n > 0 and sum(size * k for size, k in takes) <= 60
        for size, k in takes:
            placed[size] = placed.get(size, 0) + n * k
    assert placed == histogram
    assert len(groups) <= 4 * len(histogram) + 1


def test_plan_wastes_no_more_than_best_fit_item_by_item():
    rng = random.Random(3)
    for _ in range(20):
        items = [rng.randint(1, 100) for _ in range(400)]
        rooms = []
        for size in sorted(items, reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(100 - size)
        got = sum(n for n, _ in plan([(s, items.count(s)) for s in set(items)], 100))
        assert got <= len(rooms) * 1.01 + 1


def test_plan_grows_with_lengths_not_items():
    small, large = ([(s, k) for s in range(1, 101)] for k in (3, 3_000_000))
    assert len(plan(large, 100)) < 4 * 100 and sum(n for n, _ in plan(large, 100)) > 10**6 * len(plan(small, 100)) / 1000


@pytest.mark.parametrize("text", ["", "a", "a_b c-d", "¡Hola señor! x²", "日本語 テキスト、", "a b\x1cc\x85d", "«»--__", "éa", "line\r\n\tend...", None, "x" * 100_000])
def test_tokens(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(token_count(F.col("t"))).first()[0]
    assert got == len(re.findall(r"\w+|[^\w\s]+", text or ""))


SCHEMA = "id bigint, n bigint, piece string, container string, r int, part int, doc_id string"


def packed(spark, rows, capacity):
    return pack(spark.createDataFrame([(*r, None, None, 1, 2, "z") for r in rows], SCHEMA), F.col("id"), F.col("n"), capacity)


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([7, 7, 7, 7, rng.randint(1, 99), 100, 101, 250, 300])) for i in range(600)]
    extra = [(1, rows[1][1]), (2, 1), (None, 5), (9001, None), (9002, 0), (9003, -4)]
    out = packed(spark, rows + extra, 100)
    got, want = out.collect(), dict(rows)
    used, pieces = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.piece_tokens
        pieces.setdefault(r.doc_id, []).append(r)
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    assert pieces.keys() == want.keys()
    for i, n in want.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.piece_tokens for r in own) == n and [r.piece for r in own] == list(range(1, len(own) + 1))
        assert {r.is_split for r in own} == {n > 100} and len(own) == -(-n // 100)
    f = fill(out, 100).first()
    assert (f.n_containers, f.n_pieces, f.n_tokens) == (len(used), len(got), sum(want.values()))
    assert f.least_containers <= f.n_containers <= f.least_containers * 1.05 + 1


def test_pack_of_one_length_and_of_nothing(spark):
    out = packed(spark, [(i, 40) for i in range(1000)], 100)
    assert out.select("container").distinct().count() == 500
    assert packed(spark, [], 100).count() == 0 and fill(packed(spark, [], 100), 100).first().n_containers == 0


def test_tokens_of_a_public_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.exists(path):
        pytest.skip("no tokenizer files here")
    texts = ["Scan the label.", "", None, "<|endoftext|>", "naïve 日本"]
    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokenizer_count(spark, path)(F.col("t"))).collect()]
    assert got == [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts] and got[3] > 1
