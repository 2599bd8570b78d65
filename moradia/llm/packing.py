"""Fixed-capacity containers filled with texts (problem 7).

Vector bin packing with the dot-product heuristic: an open container takes, among the items that fit in every
dimension (tokens, segments, loss-bearing tokens), the one whose demand points most in the direction of what is left.
Each input partition is packed on its own, from sizes alone: there is no shuffle, no text crosses to Python, and the
last open containers of a partition are the only ones that stay underfilled.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moradia.session import small_rows

MOST_CLASSES = 1_000
SCHEMA = "recipiente_id int, recipiente bigint, doc_id bigint, peca int, inicio bigint, tokens bigint, perda bigint, dividido boolean"


def byte_size(text: Column) -> Column:
    """Tokens of a text under a byte-level tokenizer: its bytes in UTF-8 and one end token."""
    return (F.octet_length(text) + 1).cast("bigint")


class Shelf:
    """Items by size, the largest that fits first."""

    def __init__(self, items: Iterable[tuple[int, int, int]]) -> None:
        self.by_size: dict[tuple[int, int], list[int]] = {}
        for tokens, loss, key in items:
            self.by_size.setdefault((tokens, loss), []).append(key)
        self.sizes = sorted(self.by_size)

    def take(self, left: tuple[int, int], limits: tuple[int, int, int], segments: int) -> tuple[int, int, int] | None:
        """The item that fits ``left`` (tokens, loss-bearing tokens) with the greatest dot product of demand and room."""
        at = bisect_right(self.sizes, (left[0], 1 << 62)) - 1
        best, choice = -1.0, None
        room = left[0] / limits[0], (limits[1] - segments) / limits[1], left[1] / limits[2]
        while at >= 0:
            tokens, loss = self.sizes[at]
            at -= 1
            # no item of so many tokens or fewer can reach more: its loss-bearing tokens are at most its tokens, and at most what is left
            if tokens / limits[0] * room[0] + room[1] / limits[1] + min(tokens, left[1]) / limits[2] * room[2] < best:
                break
            if loss > left[1]:
                continue
            dot = tokens / limits[0] * room[0] + room[1] / limits[1] + loss / limits[2] * room[2]
            if dot > best:
                best, choice = dot, (tokens, loss)
        if choice is None:
            return None
        keys = self.by_size[choice]
        key = keys.pop()
        if not keys:
            del self.by_size[choice]
            del self.sizes[bisect_right(self.sizes, choice) - 1]
        return choice[0], choice[1], key

    def add(self, tokens: int, loss: int, key: int) -> None:
        if (tokens, loss) not in self.by_size:
            insort(self.sizes, (tokens, loss))
        self.by_size.setdefault((tokens, loss), []).append(key)


def packed(items: list[tuple[int, int]], limits: tuple[int, int, int]) -> Iterator[tuple[int, int, int, int, int, int, bool]]:
    """``(container, item, piece, start, tokens, loss, split)`` for items of ``(tokens, loss)`` under limits of (tokens, segments, loss).

    Only an item that alone exceeds the tokens or the loss-bearing tokens of an empty container is cut, into as few
    full pieces as there can be and a rest that is placed like an item. An empty item takes a segment and no room.
    """
    if min(limits) < 1:
        raise ValueError(f"limits must be positive: {limits}")
    pieces: list[tuple[int, int, int, int]] = []  # item, piece, start, tokens
    n = 0
    waiting: list[tuple[int, int, int]] = []
    for item, (tokens, loss) in enumerate(items):
        loss = min(loss, tokens)
        if tokens <= limits[0] and loss <= limits[2]:
            waiting.append((tokens, loss, len(pieces)))
            pieces.append((item, 0, 0, tokens))
            continue
        start, k, left = 0, 0, loss
        while start < tokens:
            size = min(limits[0], tokens - start)
            own = min(size, left)
            if own > limits[2]:
                size = own = limits[2]
            left -= own
            waiting.append((size, own, len(pieces)))
            pieces.append((item, k, start, size))
            start, k = start + size, k + 1
    cut = {item for item, piece, _, _ in pieces if piece}
    shelf = Shelf(waiting)
    while shelf.sizes:
        left, segments = (limits[0], limits[2]), 0
        while segments < limits[1] and (got := shelf.take(left, limits, segments)):
            tokens, loss, key = got
            item, piece, start, _ = pieces[key]
            yield n, item, piece, start, tokens, loss, item in cut
            left, segments = (left[0] - tokens, left[1] - loss), segments + 1
        n += 1


def pack(documents: DataFrame, containers: DataFrame, size: Column | None = None, loss: Column | None = None, segments: int = 512, loss_share: float = 1.0) -> DataFrame:
    """Every document placed in containers of each class: ``recipiente_id, recipiente, doc_id, peca, inicio, tokens, perda, dividido``.

    ``size`` is the tokens of a text (bytes and an end token by default), ``loss`` its loss-bearing tokens (all but the
    end token by default), ``segments`` the most texts of one container, ``loss_share`` its most loss-bearing tokens as a share of
    the capacity. The three limits are independent; all must be positive. A null text counts as empty. Repeated rows are
    placed as often as they stand. Classes without a positive capacity are left out; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = byte_size(text) if size is None else size
    loss = size - 1 if loss is None else loss
    classes = [(r[0], r[1]) for r in small_rows(containers.select("recipiente_id", "capacidade"), MOST_CLASSES, "container classes") if r[1] and r[1] > 0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        items: list[tuple[int, int]] = []
        for b in batches:
            ids += b.column(0).to_pylist()
            items += zip(b.column(1).to_pylist(), b.column(2).to_pylist())
        first = TaskContext.get().partitionId() << 33
        for class_id, capacity in classes:
            rows = [(class_id, first + n, ids[i], piece, start, tokens, loss, cut) for n, i, piece, start, tokens, loss, cut in packed(items, (capacity, segments, max(1, int(capacity * loss_share))))]
            for k in range(0, len(rows), 50_000):
                columns = zip(*rows[k : k + 50_000])
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["recipiente_id", "recipiente", "doc_id", "peca", "inicio", "tokens", "perda", "dividido"])

    if segments < 1 or not 0 < loss_share <= 1:
        raise ValueError("segments must be positive, loss_share above 0 and at most 1")
    sizes = documents.select(F.col("doc_id").cast("bigint"), F.greatest(size, F.lit(0)).cast("bigint").alias("n"), F.greatest(loss, F.lit(0)).cast("bigint").alias("l"))
    return sizes.mapInArrow(place, SCHEMA)


def body_size(text: Column) -> Column:
    """Loss-bearing tokens of a text whose first line is the instruction: the bytes after the first line break, and the end token; all where there is none."""
    return (F.octet_length(F.regexp_replace(text, r"^[^\n]*\n", "")) + 1).cast("bigint")


def fill_report(placed: DataFrame, containers: DataFrame, segments: int = 512, loss_share: float = 1.0) -> DataFrame:
    """For each class: containers, pieces, tokens placed, the share of room that stays unused, and in how many containers each limit is within a twentieth of being reached."""
    used = placed.groupBy("recipiente_id", "recipiente").agg(F.sum("tokens").alias("t"), F.count("*").alias("p"), F.sum("perda").alias("l"))
    used = used.join(F.broadcast(containers.select("recipiente_id", "capacidade")), "recipiente_id")
    most = F.greatest(F.lit(1), F.floor(F.col("capacidade") * loss_share))
    near = lambda x, limit: F.count_if(x >= limit * 0.95)
    total = used.groupBy("recipiente_id", "capacidade").agg(
        F.count("*").alias("recipientes"), F.sum("p").alias("pecas"), F.sum("t").alias("tokens"),
        near(F.col("t"), F.col("capacidade")).alias("por_tokens"), near(F.col("p"), F.lit(segments)).alias("por_pecas"), near(F.col("l"), most).alias("por_perda"),
    )
    return total.withColumn("vazio", F.round(1 - F.col("tokens") / (F.col("recipientes") * F.col("capacidade")), 6)).drop("capacidade")
