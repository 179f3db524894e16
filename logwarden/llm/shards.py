"""Minimax contiguous sharding, in DataFrame functions only (operator 2)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from logwarden.llm.common import small_or_shuffled
from logwarden.session import cut_lineage

#: Bits of the key that the first look resolves, and that each further look adds.
FIRST_BITS, MORE_BITS = 12, 8


@dataclass(frozen=True)
class Cell:
    """Groups whose keys begin with the same bits: first key, how many bits, bytes, groups, bytes of the largest."""

    first: int
    bits: int
    size: int
    groups: int
    largest: int


class Line:
    """Ordered cells, their ends as running sums, and greedy walks over them."""

    def __init__(self, cells: list[Cell]):
        self.cells = cells
        self.ends = [0, *accumulate(c.size for c in cells)]
        self.total = self.ends[-1]

    def step(self, at: float, capacity: float, whole: bool) -> float:
        """Furthest place that a shard begun at ``at`` can reach; within a cell of several groups unless cells are ``whole``."""
        reach = min(at + capacity, self.total)
        i = bisect_right(self.ends, reach) - 1
        return reach if i == len(self.cells) or not whole and self.cells[i].groups > 1 else self.ends[i]

    def walk(self, capacity: float, shards: int, whole: bool) -> list[float]:
        places = [0.0]
        for _ in range(shards):
            places.append(self.step(places[-1], capacity, whole))
        return places

    def least(self, shards: int, low: int, whole: bool) -> int:
        """Smallest capacity for which the greedy walk reaches the end, by binary search."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.walk(mid, shards, whole)[-1] >= self.total else (mid + 1, high)
        return low

    def back(self, capacity: int, shards: int) -> list[float]:
        """Earliest starts of the last 0, 1, .. shards."""
        places = [float(self.total)]
        for _ in range(shards):
            places.append(self.ends[bisect_left(self.ends, max(0, places[-1] - capacity))])
        return places

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Numbers of the cells before which to cut: each shard ends where what is left divides most evenly, within ``capacity``."""
        from_end, at, out = self.back(capacity, shards), 0.0, []
        for left in range(shards - 1, 0, -1):
            low, high = bisect_left(self.ends, max(from_end[left], at)), bisect_right(self.ends, at + capacity) - 1
            ideal = at + (self.total - at) / (left + 1)
            best = min((i for i in {low, high, bisect_left(self.ends, ideal), bisect_left(self.ends, ideal) - 1} if low <= i <= high),
                       key=lambda i: (abs(self.ends[i] - ideal), i))
            out.append(best)
            at = self.ends[best]
        return out


def boundaries(cells_of: Callable[[int, list[Cell] | None], list[Cell]], shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, first keys of shards 1 .. n - 1) over groups in the order of their keys.

    ``cells_of(bits, within)`` gives the cells of that many bits in the given wider cells.  Only cells in which a
    cut can lie are resolved further, until the bound from whole cells meets the one from divisible cells.
    """
    cells = cells_of(FIRST_BITS, None)

    def resolve(some: list[Cell]) -> list[Cell]:
        found = [c for bits in {c.bits for c in some} for c in cells_of(min(64, bits + MORE_BITS), [c for c in some if c.bits == bits])]
        gone = {c.first for c in some}
        return sorted([c for c in cells if c.first not in gone] + found, key=lambda c: c.first)

    while True:
        line = Line(cells)
        heavy = [c for c in cells if c.groups > 1 and 16 * shards * c.size > line.total]
        if heavy:  # at most 16 times as many as shards; single heavy groups stand alone then
            cells = resolve(heavy)
            continue
        low = max([0, -(-line.total // shards), *(c.largest for c in cells)])
        floor = line.least(shards, low, whole=False)
        capacity = line.least(shards, floor, whole=True)
        if capacity == floor:
            break
        early, late = line.walk(floor, shards, True), line.walk(capacity, shards, False)
        unsure = [c for c, a, b in zip(cells, line.ends, line.ends[1:])
                  if c.groups > 1 and any(a < y and b > x for x, y in zip(early[1:], late[1:]))]
        if not unsure:
            break
        cells = resolve(unsure)
    keys = [line.cells[i].first if i < len(cells) else 1 << 64 for i in line.cuts(capacity, shards)]
    return capacity, keys


def unsigned_prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(2**63))), 64 - bits)


def minimax_shards(docs: DataFrame, shards: int = 16, rows_per_bucket: int = 200_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, group_key, shard, slot.

    Groups are equal texts, in the order of a 64-bit hash, and never divided.  Shards are runs of groups, and the
    largest shard has the fewest bytes that any such cutting allows; within that bound the others are as even as
    they get.  The size of a row is the bytes of its text plus one; a null text has no bytes, checksum 0
    and a group of its own.  ``slot`` numbers the rows of a shard without gaps, in buckets of hashed ids, so that no task
    numbers a whole shard.  Repeated rows get a slot each.  Some shards are empty if there are too few groups; an empty table gives no rows.
    """
    facts = docs.select(F.col(key).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
                        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), F.xxhash64(text).alias("group_key"))
    facts = cut_lineage(facts, "shard-facts")
    groups = cut_lineage(facts.groupBy("group_key").agg(F.sum("size").alias("size")), "shard-groups")

    def cells_of(bits: int, within: list[Cell] | None) -> list[Cell]:
        seen = groups
        if within is not None:
            wide = within[0].bits
            seen = seen.where(unsigned_prefix(F.col("group_key"), wide).isin([c.first >> 64 - wide for c in within]))
        rows = seen.groupBy(unsigned_prefix(F.col("group_key"), bits).alias("p")).agg(F.sum("size"), F.count("*"), F.max("size")).collect()
        return sorted((Cell(r[0] << 64 - bits, bits, r[1], r[2], r[3]) for r in rows), key=lambda c: c.first)

    _, keys = boundaries(cells_of, shards)
    signed = [k - (1 << 63) for k in keys if k < 1 << 64]
    shard = sum(((F.col("group_key") >= F.lit(k)).cast("int") for k in signed), F.lit(0))
    buckets = facts.count() // rows_per_bucket + 4
    placed = facts.withColumn("shard", shard).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("inside", inside).join(small_or_shuffled(offsets), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "group_key", "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"))
