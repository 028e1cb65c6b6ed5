"""Filling containers of a fixed capacity with documents.

Dominance reduction after Martello and Toth: while the largest open item has a set of at
most three items that dominates every other set it could share a container with, that
container is fixed; whatever is left is placed best fit, largest first.

Sizes are whole numbers up to the capacity, so the instance is a table of counts by size
(2,049 numbers for 2,048 tokens, whatever the number of documents). It is solved on those
counts; the documents themselves are only ranked within their size, in blocks of bounded
size, and looked up in the layout.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tokens import RANKS, count_tokens

CAPACITY = 2048
#: Items that one task ranks at once.
RANK_BLOCK = 100_000


@dataclass
class Layout:
    """Runs (size, first rank, first container, number): item first rank + i of that size
    lies in container first container + i. Ranks of a size start at 0 and leave no gap."""

    runs: list[tuple[int, int, int, int]] = field(default_factory=list)
    containers: int = 0
    fixed: int = 0
    _rank: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def open(self, n: int) -> int:
        self.containers += n
        return self.containers - n

    def put(self, size: int, n: int, first: int) -> None:
        self.runs.append((size, self._rank[size], first, n))
        self._rank[size] += n


def dominating_set(j: int, counts: dict[int, int], sizes: list[int], capacity: int) -> tuple[int, ...] | None:
    """The items that can be fixed beside an item of size j, or None if none dominates.

    `sizes` are the distinct sizes left, ascending, and `counts` their numbers, j's own
    item included. Feasible sets beside j are compared by the dominance criterion: a set
    dominates another if the other can be divided among its members without exceeding them.
    """
    room = capacity - j
    left = dict(counts)
    left[j] -= 1
    open_sizes = [s for s in sizes if left[s] > 0]
    if not open_sizes or open_sizes[0] > room:
        return ()
    fits = open_sizes[: bisect_left(open_sizes, room + 1)]
    top = fits[-1]
    if top == room:
        return (top,)
    smallest: list[int] = []
    for s in fits:
        smallest += [s] * min(left[s], 3 - len(smallest))
        if len(smallest) == 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (top,)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # at most two more items fit: look at every size with its best partner
    values = np.array(fits)
    numbers = np.array([left[s] for s in fits])
    mate = np.searchsorted(values, room - values, side="right") - 1
    own = (mate == np.arange(len(values))) & (numbers < 2)
    mate = np.where(own, mate - 1, mate)
    usable = mate >= 0
    sums = values[usable] + values[mate[usable]]
    if not len(sums) or sums.max() <= top:
        return (top,)
    left[top] -= 1
    partner = [s for s in fits if left[s] > 0 and s <= room - top]
    if not partner:
        return None
    second = partner[-1]
    # {top, second} fails only against a pair of two items above `second` that together exceed `top`
    both = (values[usable] > second) & (values[mate[usable]] > second) & (sums > top)
    return None if both.any() else (top, second)


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Layout:
    """The layout of counts[size] items of every size from 1 to the capacity."""
    layout = Layout()
    counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
    sizes = sorted(counts)

    def take(size: int, n: int, first: int) -> None:
        layout.put(size, n, first)
        counts[size] -= n
        if not counts[size]:
            del counts[size]
            sizes.pop(bisect_left(sizes, size))

    changed = True
    while changed:  # a fixed set can make room for another
        changed = False
        for j in sizes[::-1]:
            while counts.get(j):
                beside = dominating_set(j, counts, sizes, capacity)
                if beside is None:
                    break
                group = (j, *beside)
                n = min(counts[s] // group.count(s) for s in set(group))
                first = layout.open(n)
                for s in group:
                    take(s, n, first)
                layout.fixed += n
                changed = True
    # best fit, largest first, on runs of equal containers
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> [(first, number)]
    rooms: list[int] = []

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, n))

    for size in sizes[::-1]:
        while n := counts.get(size, 0):
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, m = runs[room].pop()
                if not runs[room]:
                    rooms.pop(at)
                used = min(n, m)
                take(size, used, first)
                keep(room - size, first, used)
                keep(room, first + used, m - used)
            else:
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    first = layout.open(full)
                    for _ in range(each):
                        take(size, full, first)
                    keep(capacity - each * size, first, full)
                else:
                    first = layout.open(1)
                    for _ in range(rest):
                        take(size, 1, first)
                    keep(capacity - rest * size, first, 1)
    return layout


def pack_sized(sized: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY,
               rank_block: int = RANK_BLOCK) -> DataFrame:
    """(key, part, n_tokens, container) for items with known sizes.

    An item over the capacity alone is divided: its full containers come first, its rest
    is packed like an item; every other item has the single part 0. Items of size 0 (null
    and empty texts) lie in container 0 and take no room; a null size counts as 0. Repeated
    rows are items of their own, ties of size are ranked by key. No rows give no rows.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    items = sized.select(F.col(key), n.alias("__n")).select(
        key,
        "__n",
        F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest((F.col("__n") - 1) / capacity, F.lit(0)).cast("long"))).alias("part", "__p"),
    ).select(key, "part", F.least(F.lit(capacity), F.col("__n") - F.col("part") * capacity).cast("int").alias("n_tokens"))
    # at most capacity + 1 rows come to the driver
    table = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    layout = solve(table, capacity)
    salts = {s: max(1, -(-c // rank_block)) for s, c in table.items()}
    if not table:
        return items.withColumn("container", F.lit(None).cast("long")).filter("false")
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for s in table:
        mine = [r for r in layout.runs if r[0] == s]
        by_size[s] = (np.array([r[1] for r in mine], np.int64), np.array([r[2] for r in mine], np.int64))

    # rank within the size: blocks by a hash of the key, so that no task gets all items of a common size
    most = max(salts.values())
    salted = items.withColumn("__salt", F.when(F.col("n_tokens").isin([s for s, k in salts.items() if k > 1]), F.pmod(F.xxhash64(key, "part"), F.lit(most))).otherwise(0).cast("int") if most > 1 else F.lit(0))
    ranked = salted.withColumn("__r", F.row_number().over(Window.partitionBy("n_tokens", "__salt").orderBy(key, "part")).cast("long") - 1)
    if most > 1:
        offsets = (
            salted.groupBy("n_tokens", "__salt").agg(F.count("*").alias("__c"))
            .withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy("n_tokens").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .drop("__c")
        )
        ranked = ranked.join(offsets, ["n_tokens", "__salt"]).withColumn("__r", F.col("__r") + F.col("__before"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            container = np.zeros(len(f), np.int64)
            for s, rows in f.groupby("n_tokens").indices.items():
                ranks, firsts = by_size[int(s)]
                if len(ranks):
                    r = f["__r"].to_numpy()[rows]
                    at = np.searchsorted(ranks, r, side="right") - 1
                    container[rows] = firsts[at] + r - ranks[at]
            yield f[[key, "part", "n_tokens"]].assign(container=container)

    return ranked.select(key, "part", "n_tokens", "__r").mapInPandas(place, items.schema.add("container", "long"))


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str = RANKS) -> DataFrame:
    """pack_sized for texts measured in tokens. Sizes are counted once and kept as a table
    in the shared folder, because the counts and the ranks both need them."""
    return pack_sized(written(count_tokens(df, key, text, ranks), "sizes"), key, "n_tokens", capacity)
