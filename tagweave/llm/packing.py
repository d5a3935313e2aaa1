"""Filling fixed-capacity containers: best-fit planned over a histogram of lengths, documents taking slots by rank."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.runtime import cut_lineage

# Letters, digits and underscores; white space as Unicode has it, with the four separators that text tools add.
_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x85\p{Z}"
TOKEN = rf"[{_WORD}]+|[^{_WORD}{_SPACE}]+"


def token_count(text: Column) -> Column:
    """Tokens of a text: longest runs of letters, digits and underscores, or of other characters that are no white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def tokenizer_count(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A column function that counts the tokens of a public tokenizer, a JSON file of the ``tokenizers`` library at ``path``.

    The driver reads the file and broadcasts it (its size is the file's, whatever the corpus); each task builds the tokenizer
    once. Special tokens in a text count as ordinary text; null counts 0.
    """
    with open(path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model.value)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count


@dataclass
class _Group:
    """``n`` containers filled alike: ``takes`` lists (length, items of it in each container)."""

    n: int
    takes: list[tuple[int, int]]


def plan(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over counts: ``[(containers, [(length, items a container)])]``.

    Lengths are taken from the longest; all items of one length go together into the group of containers with the least room
    that holds one, as many in each as fit, then into the next, and new containers at last. The work and the plan grow with the
    number of different lengths (at most ``capacity``), never with the number of items.
    """
    rooms: list[int] = []
    groups: dict[int, list[_Group]] = {}

    def put(room: int, group: _Group) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append(group)

    for length, items in sorted(histogram, reverse=True):
        placed: list[tuple[int, _Group]] = []
        while items:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(items, each)
                placed += [(capacity - k * length, _Group(n, [(length, k)])) for n, k in ((full, each), (1, rest)) if n and k]
                break
            room = rooms[at]
            group = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // length
            full = min(group.n, items // each)
            rest = items - full * each if full < group.n else 0
            if full:
                placed.append((room - each * length, _Group(full, [*group.takes, (length, each)])))
            if rest:
                placed.append((room - rest * length, _Group(1, [*group.takes, (length, rest)])))
            if (left := group.n - full - bool(rest)) > 0:
                placed.append((room, _Group(left, group.takes)))
            items -= full * each + rest
        for room, group in placed:
            put(room, group)
    return [(g.n, g.takes) for room in sorted(rooms) for g in groups[room]]


def _slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, last rank, first container, items a container)`` of each entry of the plan; ranks from 0 within a length."""
    out, used, container = [], {}, 0
    for n, takes in groups:
        for length, each in takes:
            start = used.get(length, 0)
            out.append((length, start, start + n * each - 1, container, each))
            used[length] = start + n * each
        container += n
    return out


def pack(documents: DataFrame, doc_id: Column, size: Column, capacity: int = 1024, spread: int = 64) -> DataFrame:
    """``doc_id, n_tokens, piece, piece_tokens, is_split, container``: where every document goes.

    A document above ``capacity`` is split: it fills containers of its own, and its last piece is packed like a document; all
    others stay whole. Method: the histogram of lengths (at most ``capacity`` rows) is planned on the driver; documents then get
    a rank within their length and take the plan's slot of that rank. The plan is at most some thousand rows whatever the number
    of documents, so it is joined by broadcast. Ranks are counted in ``spread`` parts of each length plus the parts' offsets, so
    a length that a third of all documents have is no single task.

    Defined results: rows with a null id or size, and those of size 0 or less, take no container and don't appear; a repeated id
    counts once, with its greatest size; no documents give no rows. Other columns play no part.
    """
    sizes = documents.select(doc_id.alias("doc_id"), size.cast("bigint").alias("n")).where("doc_id is not null and n > 0")
    sizes = cut_lineage(sizes.groupBy("doc_id").agg(F.max("n").alias("n_tokens")))
    n = F.col("n_tokens")
    whole, rest = F.floor(n / capacity), n % capacity
    full = sizes.where(n >= capacity).select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), whole)).alias("piece"), F.lit(capacity).cast("bigint").alias("piece_tokens"))
    tail = sizes.where(rest > 0).select("doc_id", "n_tokens", (whole + 1).alias("piece"), rest.alias("piece_tokens"))
    items = full.unionByName(tail)

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int")
    items = items.withColumn("part", part)
    counts = cut_lineage(items.groupBy("piece_tokens", "part").agg(F.count("*").alias("c")))
    histogram = [(r[0], r[1]) for r in counts.groupBy("piece_tokens").agg(F.sum("c")).collect()]  # at most ``capacity`` rows
    slots = _slots(plan(histogram, capacity))
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("length", "from_rank", "to_rank", "first", "each")])
    slots = documents.sparkSession.createDataFrame(slots, schema)

    offsets = counts.withColumn("offset", F.sum("c").over(W.partitionBy("piece_tokens").orderBy("part")) - F.col("c")).drop("c")
    ranked = items.withColumn("r", F.row_number().over(W.partitionBy("piece_tokens", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(offsets, ["piece_tokens", "part"]).withColumn("rank", F.col("r") + F.col("offset"))
    at = (F.col("piece_tokens") == F.col("length")) & F.col("rank").between(F.col("from_rank"), F.col("to_rank"))
    placed = ranked.join(F.broadcast(slots), at)
    container = F.col("first") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("each"))
    return placed.select("doc_id", "n_tokens", "piece", "piece_tokens", (n > capacity).alias("is_split"), container.alias("container"))


def fill(placed: DataFrame, capacity: int = 1024) -> DataFrame:
    """``n_containers, n_pieces, n_tokens, unused, least_containers``: how well the containers are filled; ``least_containers`` is
    the bound that no packing can beat (all tokens over the capacity, rounded up)."""
    by = placed.groupBy("container").agg(F.sum("piece_tokens").alias("used"), F.count("*").alias("k"))
    total = F.coalesce(F.sum("used"), F.lit(0))
    return by.agg(
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_pieces"),
        total.alias("n_tokens"),
        (F.count("*") * capacity - total).alias("unused"),
        F.ceil(total / capacity).alias("least_containers"),
    )
