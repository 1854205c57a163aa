"""Best-fit-decreasing packing of indivisible groups into shards.

Rows with equal text form a group that no shard boundary may cut. Groups of at least ``1 / PARCELS`` of all bytes are
packed one by one; there are at most ``PARCELS`` of them, whatever the corpus holds. All smaller groups are gathered,
whole, by hash into ``PARCELS`` parcels. So the packing sees at most ``2 * PARCELS`` sizes at 1 GB and at 100 TB
alike, and runs on the driver over those sums only.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_size, power_of_two, written

PARCELS = 8192
#: What a task numbers at once, in rows and, where texts travel along, in bytes of them.
ROWS_PER_SLOT_RANGE, BYTES_PER_SLOT_RANGE = 20_000, 8 << 20


class CapacityTree:
    """Bins by remaining capacity in a treap; the tightest bin that fits is one descent."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _cut(node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = CapacityTree._cut(node[3], key)
            node[3] = left
            return node, right
        left, right = CapacityTree._cut(node[2], key)
        node[2] = right
        return left, node

    @staticmethod
    def _glue(left, right):
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            left[3] = CapacityTree._glue(left[3], right)
            return left
        right[2] = CapacityTree._glue(left, right[2])
        return right

    def add(self, room: int, bin_: int) -> None:
        left, right = self._cut(self.root, (room, bin_))
        weight = ((room * 2654435761 + bin_ * 40503 + 12345) * 2246822519) % 4294967291
        self.root = self._glue(self._glue(left, [(room, bin_), weight, None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (room, bin) of least room >= size."""
        left, rest = self._cut(self.root, (size, -1))
        if rest is None:
            self.root = left
            return None
        node = rest
        while node[2] is not None:
            node = node[2]
        _, rest = self._cut(rest, (node[0][0], node[0][1] + 1))
        self.root = self._glue(left, rest)
        return node[0]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; ``sizes`` descend. A size above the capacity gets a bin to itself."""
    tree, bins, out = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            found, bins = (max(capacity, size), bins), bins + 1
        out.append(found[1])
        tree.add(found[0] - size, found[1])
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size, at most ``shards`` shards of near equal sums.

    A group above the fair share of what is left gets a shard to itself. For the others the least capacity is
    sought at which best fit decreasing needs no more than the shards that remain; a last pass moves groups from the
    fullest to the emptiest shard while that narrows the gap.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, alone, left = [0] * len(sizes), 0, sum(sizes)
    while alone < min(shards - 1, len(order)) and sizes[order[alone]] * (shards - alone) >= left:
        out[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest, room = order[alone:], shards - alone
    falling = [sizes[i] for i in rest]
    if not rest:
        return out
    low = max(-(-left // room), falling[0])
    step, high = max(1, low // 4096), low
    while max(bins := best_fit_decreasing(falling, high)) >= room:
        high += step
        step *= 2
    for _ in range(8):
        if high - low <= max(1, low // 8192):
            break
        middle = (low + high) // 2
        if max(tried := best_fit_decreasing(falling, middle)) < room:
            high, bins = middle, tried
        else:
            low = middle
    held: list[list[tuple[int, int]]] = [[] for _ in range(room)]
    for i, b in zip(rest, bins, strict=True):
        held[b].append((sizes[i], i))
    sums = [sum(s for s, _ in h) for h in held]
    for h in held:
        h.sort()
    for _ in range(4 * room + 64):
        top, bottom = max(range(room), key=sums.__getitem__), min(range(room), key=sums.__getitem__)
        gap = sums[top] - sums[bottom]
        at = bisect.bisect_right(held[top], (gap // 2, len(sizes))) - 1
        if at < 0 or not 0 < held[top][at][0] < gap:
            break
        item = held[top].pop(at)
        bisect.insort(held[bottom], item)
        sums[top] -= item[0]
        sums[bottom] += item[0]
    for b, h in enumerate(held):
        for _, i in h:
            out[i] = alone + b
    return out


def shard(docs: DataFrame, shards: int, parcels: int = PARCELS, carry_text: bool = True) -> DataFrame:
    """``docs`` plus size, text_crc32, law, shard, slot and grown_shard; the law is ``bytes``.

    Rows with equal text (nulls among themselves, apart from empty texts) share a shard. Shards have near equal
    bytes, as far as a single group above its fair share allows: such a group fills a shard of its own. ``slot``
    counts from 0 within the shard, in hash order; ties in it are by size, else rows are alike. text_crc32 of a null text is null, as no text
    has been hashed, and its size 8. A very long text is one row like others, and one above a shard's fair share fills a shard. Null doc_ids
    and repeated rows are ordinary rows. An empty table gives an empty result. Input columns named like results are replaced, others stay.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = docs.drop(*made)
    others = [c for c in docs.columns if c != "text"]
    text, size = F.col("text"), byte_size(F.col("text")) + F.lit(8)
    crc = F.crc32(text.cast("binary"))
    group = F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"null"))
    # input columns travel inside a struct, so that no name can clash
    mixed = F.xxhash64(F.lit(11), crc, F.coalesce("doc_id", F.lit(-1)), *[F.col(c) for c, t in docs.dtypes if c not in ("text", "doc_id") and not t.startswith(("map", "variant"))])
    rows = docs.select(F.struct(*others).alias("_row"), *(["text"] if carry_text else []), size.alias("size"), crc.alias("text_crc32"), group.alias("_group"), mixed.alias("_mixed"))
    if carry_text:
        narrow = written(rows.select("_group", "size"), "shard-sizes")
    else:
        narrow = rows = written(rows, "shard-sizes")
    result = lambda df: df.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if carry_text or c != "text"], "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
    total = narrow.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return result(rows.select("*", F.lit(0).alias("shard"), F.lit(0).alias("slot")))
    parcel = F.pmod(F.xxhash64("_group"), F.lit(parcels)).cast("int")
    groups = narrow.groupBy("_group").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") * F.lit(parcels) >= F.lit(total["bytes"])
    # one row for each large group, of which there are at most PARCELS, and one for each parcel
    items = groups.groupBy(F.when(large, F.col("_group")).alias("group"), F.when(~large, parcel).alias("parcel")).agg(F.sum("bytes").alias("bytes"))
    items = sorted(items.collect(), key=lambda r: (r["parcel"] is None, r["parcel"] or 0, r["group"] or b""))
    shard_of = pack([r["bytes"] for r in items], shards)
    spark = docs.sparkSession
    alone = [(bytes(r["group"]), s) for r, s in zip(items, shard_of, strict=True) if r["group"] is not None]
    together = [(r["parcel"], s) for r, s in zip(items, shard_of, strict=True) if r["parcel"] is not None]
    rows = rows.withColumn("_parcel", parcel)
    rows = rows.join(F.broadcast(spark.createDataFrame(alone, "_group binary, _alone int")), "_group", "left").join(F.broadcast(spark.createDataFrame(together, "_parcel int, _together int")), "_parcel", "left")
    carried = total["bytes"] if carry_text else 0
    ranges = power_of_two(max(total["rows"] / ROWS_PER_SLOT_RANGE, carried / BYTES_PER_SLOT_RANGE) / shards)
    rows = rows.withColumn("shard", F.coalesce("_alone", "_together")).withColumn("_range", F.pmod("_mixed", F.lit(ranges))).drop("_group", "_parcel", "_alone", "_together")
    ahead = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_range").agg(F.count("*").alias("_n")).select("shard", "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_range").orderBy("_mixed", "size")
    placed = rows.withColumn("_place", F.row_number().over(inside)).join(offsets, ["shard", "_range"])
    return result(placed.withColumn("slot", F.col("_offset") + F.col("_place") - 1))
