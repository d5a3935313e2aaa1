import random
import re

import pytest
from pyspark.sql import functions as F

from tagweave.functions.similarity import jaro_winkler_score
from tagweave.operators.fields import assign_fields, position_quantity

PRODUCTS, SIZES, COLORS = ["5000", "H0763", "TR35182"], ["M", "XL", "L-TALL"], ["DARK HEATHER", "BLACK"]


def dims(spark, products=PRODUCTS, colors=COLORS):
    one = lambda v: spark.createDataFrame([(x, i) for i, x in enumerate(v)], "entry string, ord int")
    return {"product": one(products), "size": one(SIZES), "color": one(colors)}


@pytest.mark.parametrize(
    "text, position, want",
    [
        ("1/1", 0, (1, 1, 1.0)), ("2 / 10", 7, (2, 10, 1.0)), ("5/3", 5, None), ("315", 3, (3, 5, 0.9)), ("3l5", 3, (3, 5, 0.9)), ("375", 3, (3, 5, 0.9)), ("35", 3, (3, 5, 0.85)),
        ("312", 3, None), ("32", 3, None), ("315", 0, None), ("12|15", 12, None), ("1219", 12, None), ("12|9", 12, None), ("", 1, None), (None, 1, None), ("3x5", 3, None),
    ],
)
def test_position_quantity(spark, text, position, want):
    got = spark.createDataFrame([(text, position)], "t string, p bigint").select(position_quantity(F.col("t"), F.col("p")).alias("x")).first()["x"]
    assert (tuple(got) if got else None) == want


def sequential(blocks, position, min_score=0.9):
    """The field rules block by block, as a person would apply them."""
    blocks = sorted(blocks, key=lambda b: (b[2], b[3]))
    strip = lambda t: t.strip()

    def pq(t):
        m = re.match(r"^(\d+)\s*/\s*(\d+)$", t)
        if m:
            return (int(m[1]), int(m[2]), 1.0) if int(m[2]) >= int(m[1]) else None
        if position > 0 and t.startswith(str(position)):
            rest = t[len(str(position)) :]
            if len(rest) == 2 and rest[0] in "1|lI!tij7" and rest[1].isdigit():
                return (position, int(rest[1]), 0.9) if int(rest[1]) >= position else None
            if len(rest) == 1 and rest.isdigit():
                return (position, int(rest), 0.85) if int(rest) >= position else None
        return None

    def match(t, form, entries, keep):
        u = t.upper()
        if not re.match(form, t if keep else u):
            return None
        if u in entries or (keep and t in entries):
            return (u if u in entries else t), 1.0
        best, score = None, min_score
        for e in entries:
            lev = 1 - distance(u, e) / max(len(u), len(e))
            s = max(lev, jaro_winkler_score(u, e))
            if s > score:
                best, score = e, s
        return (best, score) if best else None

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    rules = {"product": (r"^[A-Za-z0-9]{3,9}$", PRODUCTS, True), "size": (r"^[A-Z0-9/-]{1,7}$", SIZES, False), "color": (r"^[A-Za-z /]{3,}$", COLORS, False)}
    out = {"pq": "", "product": "", "size": "", "color": "", "conf": {}, "valid": False}
    at = next((i for i, b in enumerate(blocks) if pq(strip(b[0]))), -1)
    if at < 0:
        return out
    p, q, k = pq(strip(blocks[at][0]))
    out["pq"], out["conf"]["positionQuantity"] = f"{p}/{q}", blocks[at][1] * k
    used, start = {at}, at + 1
    for f, (form, entries, keep) in rules.items():
        for i in range(start, len(blocks)):
            if m := match(strip(blocks[i][0]), form, entries, keep):
                out[f], out["conf"][f] = m[0], blocks[i][1] * m[1]
                used.add(i)
                start = i + 1
                break
    for f, (form, entries, keep) in rules.items():
        if not out[f]:
            for i, b in enumerate(blocks):
                if i not in used and (m := match(strip(b[0]), form, entries, keep)):
                    out[f], out["conf"][f] = m[0], b[1] * m[1] * 0.8
                    break
    out["valid"] = p == position and p > 0
    return out


def test_same_as_block_by_block(spark):
    rng = random.Random(11)
    pool = ["1/1", "2/3", "315", "35", "5/3", "5000", "h0763", "TR35l82", "TR35182", "M", "xl", "L-TALL", "L-TAL", "DARK HEATHER", "DARK HEATHR", "black", "BLACKK", "???", "", "12"]
    labels, blocks, want = [], [], {}
    for n in range(120):
        pos = rng.choice([0, 1, 2, 3])
        own = [(rng.choice(pool), round(rng.uniform(0.3, 1), 3), float(rng.randint(0, 4)), i) for i in range(rng.randint(0, 7))]
        labels.append((f"f{n}", pos))
        blocks += [(f"f{n}", *b) for b in own]
        want[f"f{n}"] = sequential(own, pos)
    b = spark.createDataFrame(blocks, "frame string, text string, conf double, y double, ord int")
    got = assign_fields(spark.createDataFrame(labels, "frame string, pos bigint"), "frame", "pos", b, "text", "conf", "y", "ord", dims(spark)).collect()
    assert len(got) == 120
    for r in got:
        w = want[r.frame]
        assert (r.position_quantity, r.product_code, r["size"], r.color, r.is_valid) == (w["pq"], w["product"], w["size"], w["color"], w["valid"]), r.frame
        conf = {{"productCode": "product"}.get(k, k): v for k, v in r.field_confidences.items()}
        assert conf.keys() == w["conf"].keys() and all(abs(conf[k] - v) < 1e-9 for k, v in w["conf"].items())


def test_worked_example(spark):
    rows = [("2/2", 0.99, 3.0, 0), ("5000", 0.98, 93.0, 1), ("M", 0.97, 145.0, 2), ("DARK HEATHER", 0.96, 185.0, 3), (None, 0.5, 1.0, 4), ("x", 0.5, None, 5)]
    b = spark.createDataFrame([("signal", *r) for r in rows] * 2, "frame string, text string, conf double, y double, ord int")
    frames = spark.createDataFrame([("signal", 2), ("none", 1)], "frame string, pos bigint")
    got = {r.frame: r for r in assign_fields(frames, "frame", "pos", b, "text", "conf", "y", "ord", dims(spark)).collect()}
    r = got["signal"]
    assert (r.position_quantity, r.quantity, r.product_code, r["size"], r.color, r.is_valid) == ("2/2", 2, "5000", "M", "DARK HEATHER", True)
    assert r.field_confidences == {"positionQuantity": 0.99, "productCode": 0.98, "size": 0.97, "color": 0.96}
    assert (got["none"].position_quantity, got["none"].is_valid, got["none"].field_confidences) == ("", False, {})
    bare = assign_fields(frames.where("frame = 'signal'"), "frame", "pos", b, "text", "conf", "y", "ord", dims(spark, [], [])).first()
    assert (bare.product_code, bare["size"], bare.color, bare.is_valid) == ("", "M", "", True)
