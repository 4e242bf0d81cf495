"""Items of varying length into containers of fixed capacity, planned on the histogram of lengths.

The plan depends on lengths alone: there are at most `capacity` distinct ones, so their counts fit on the driver whatever
the number of items, and so does the plan, a list of patterns with the number of windows of each. Items are routed to
context-size tiers. Each tier has windows of its own size, of which a container holds capacity / size. From the longest
tier to the shortest, the tier's own items are packed into its windows, longest first; then the gaps left in them are filled
from the shorter tiers, largest fitting length first. No item crosses a window. What a tier leaves of its last container is
divided into windows of the next. Every item then finds its place by its rank among the items of its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.llm.tokenizing import count_tokens
from chronopanel.sources.tables import cut

CAPACITY = 2048
#: Sizes of the tiers' windows; each divides the next, the last is the capacity.
TIERS = (256, 512, 1024, 2048)
#: Containers of a step group.
GROUP = 64
#: Items of one length that one task ranks.
RANKED = 100_000


@dataclass
class Pattern:
    """m windows of size `tier` that each hold used[k] items of length sizes[k]."""

    sizes: list[int]
    used: list[int]
    m: int
    tier: int


def _packed(left: dict[int, int], low: int, window: int) -> list[Pattern]:
    """A tier's own items, of lengths in (low, window], in windows of it, without anything shorter."""
    own = sorted(s for s, n in left.items() if n and low < s <= window)
    out = []
    while own:
        used, gap, at = {}, window, len(own) - 1
        while at >= 0 and gap > low:
            at = min(at, bisect_right(own, gap) - 1)
            if at < 0:
                break
            if k := min(gap // own[at], left[own[at]]):
                used[own[at]], gap = k, gap - k * own[at]
            at -= 1
        m = min(left[s] // k for s, k in used.items())
        out.append(Pattern(list(used), list(used.values()), m, window))
        for s, k in used.items():
            left[s] -= k * m
        own = [s for s in own if left[s]]
    return out


def _filled(pattern: Pattern, left: dict[int, int], low: int) -> list[Pattern]:
    """A pattern with its gap filled from lengths up to low, in as many variants as those run out."""
    out, m = [], pattern.m
    room = pattern.tier - sum(s * k for s, k in zip(pattern.sizes, pattern.used, strict=True))
    shorter = sorted(s for s, n in left.items() if n and s <= low)
    while m:
        more, gap, at = {}, room, len(shorter) - 1
        while at >= 0 and gap:
            at = min(at, bisect_right(shorter, gap) - 1)
            if at < 0:
                break
            if k := min(gap // shorter[at], left[shorter[at]]):
                more[shorter[at]], gap = k, gap - k * shorter[at]
            at -= 1
        now = min([m, *(left[s] // k for s, k in more.items())])
        out.append(Pattern(pattern.sizes + list(more), pattern.used + list(more.values()), now, pattern.tier))
        for s, k in more.items():
            left[s] -= k * now
        shorter, m = [s for s in shorter if left[s]], m - now
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[Pattern]:
    """Patterns that hold all items, tier by tier from the longest: packed with the tier's own items, then filled."""
    if not tiers or tiers[-1] != capacity or any(b % a or b == a for a, b in zip(tiers, tiers[1:], strict=False)):
        raise ValueError("every tier must divide the next, and the last one is the capacity")
    left = {s: n for s, n in counts.items() if n > 0}
    out = []
    for window, low in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        for pattern in _packed(left, low, window):
            out += _filled(pattern, left, low)
    return out


class Places:
    """For the r-th item of length s: container, start in it, tier, step group."""

    def __init__(self, patterns: list[Pattern], capacity: int = CAPACITY, group: int = GROUP) -> None:
        # Windows lie one after another, tier by tier from the longest and by falling cost of attention (squares of
        # lengths) within a tier: every tier divides the one before, so no window crosses a container. Containers, which
        # come by falling cost, are dealt to and fro among the groups, so that groups cost about the same.
        patterns = sorted(patterns, key=lambda p: (-p.tier, -sum(k * s * s for s, k in zip(p.sizes, p.used, strict=True)), p.sizes))
        rows, seen, address = [], {}, 0
        for p in patterns:
            start = 0
            for s, k in sorted(zip(p.sizes, p.used, strict=True), reverse=True):
                rows.append((s, seen.get(s, 0), address, k, start, p.tier))
                seen[s] = seen.get(s, 0) + k * p.m
                start += k * s
            address += p.m * p.tier
        self.capacity, self.containers = capacity, -(-address // capacity)
        self.groups = max(1, -(-self.containers // group))
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 6)
        self.key = (self.table[:, 0] << 48) | self.table[:, 1]

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        t = self.table[np.searchsorted(self.key, (size << 48) | rank, "right") - 1]
        r = rank - t[:, 1]
        window, nth = np.divmod(r, t[:, 3])
        at = t[:, 2] + window * t[:, 5] + t[:, 4] + nth * size
        container, start = np.divmod(at, self.capacity)
        lap, pos = np.divmod(container, self.groups)
        return container, start, t[:, 5], np.where(lap % 2 == 0, pos, self.groups - 1 - pos)


def pack(sized: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, group: int = GROUP) -> DataFrame:
    """key, piece, token_from, n_tokens, container_id, start, tier, step_group: where every item lies.

    An item of more than the capacity is cut into pieces of the capacity and a rest; all others have piece 0. Items of
    length 0 (null, empty texts) take no room: their container_id, start, tier and step_group are null. A null length
    counts as 0. tier is the size of the item's window. Every tier must divide the next; the last is the capacity. Repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / F.lit(capacity)).cast("long") - 1, F.lit(0).cast("long"))
    items = sized.select(F.col(key).alias(key), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    items = items.select(key, "piece", (F.col("piece") * capacity).alias("token_from"), F.least(F.col("_n") - F.col("piece") * capacity, F.lit(capacity).cast("long")).alias("n_tokens"))
    items = cut(items)
    counts = {r["n_tokens"]: r["n"] for r in items.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = Places(plan(counts, capacity, tiers), capacity, group)
    # Rank among the items of the same length: by buckets, so that no length is one task.
    buckets = max(1, -(-max(counts.values(), default=0) // RANKED))
    full = items.where("n_tokens > 0").withColumn("_b", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    per = full.groupBy(F.col("n_tokens").alias("_s"), F.col("_b").alias("_sb")).agg(F.count("*").alias("_c"))
    before = per.select("_s", "_sb", F.coalesce(F.sum("_c").over(W.partitionBy("_s").orderBy("_sb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = full.withColumn("_r", F.row_number().over(W.partitionBy("n_tokens", "_b").orderBy(key, "piece")) - 1)
    ranked = ranked.join(before, (F.col("n_tokens") == F.col("_s")) & (F.col("_b") == F.col("_sb"))).select(key, "piece", "token_from", "n_tokens", (F.col("_r") + F.col("_before")).alias("_rank"))
    kind = dict(sized.dtypes)[key]
    shape = f"`{key}` {kind}, piece long, token_from long, n_tokens long, container_id long, start long, tier int, step_group long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            container, start, tier, step = places.of(np.asarray(b.column("n_tokens")), np.asarray(b.column("_rank")))
            cols = [b.column(c) for c in (key, "piece", "token_from", "n_tokens")] + [pa.array(container), pa.array(start), pa.array(tier.astype(np.int32)), pa.array(step)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "piece", "token_from", "n_tokens", "container_id", "start", "tier", "step_group"])

    empty = items.where("n_tokens <= 0").select(key, "piece", "token_from", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("container_id", "long"), ("start", "long"), ("tier", "int"), ("step_group", "long"))])
    return ranked.mapInArrow(place, shape).unionByName(empty)


def pack_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, group: int = GROUP) -> DataFrame:
    """pack() of texts, measured in tokens of a public tokenizer."""
    return pack(count_tokens(df, key, text, vocabulary), key, "n_tokens", capacity, tiers, group)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """tier, windows, tokens, fill: how full the windows of each tier are."""
    full = packed.where(F.col("container_id").isNotNull())
    per = full.groupBy("tier", "container_id", F.floor(F.col("start") / F.col("tier")).alias("_w")).agg(F.sum("n_tokens").alias("t"))
    return per.groupBy("tier").agg(F.count("*").alias("windows"), F.sum("t").alias("tokens"), F.round(F.avg(F.col("t") / F.col("tier")), 6).alias("fill"))


def audit(packed: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row: items, pieces whose place is null though they have tokens, pieces that cross a window or overlap the one
    before them, and containers that hold more than the capacity: all but the first are to be 0."""
    w = W.partitionBy("container_id").orderBy("start")
    x = packed.withColumn("_end", F.when(F.col("container_id").isNotNull(), F.lag(F.col("start") + F.col("n_tokens")).over(w)))
    size = packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count(F.when(F.col("t") > capacity, 1)).alias("overfull"))
    crossing = F.floor(F.col("start") / F.col("tier")) != F.floor((F.col("start") + F.col("n_tokens") - 1) / F.col("tier"))
    bad = (F.col("_end") > F.col("start")) | crossing
    one = x.agg(F.count_distinct(key).alias("items"), F.count(F.when(F.col("container_id").isNull() & (F.col("n_tokens") > 0), 1)).alias("lost"), F.count(F.when(F.col("container_id").isNotNull() & bad, 1)).alias("misplaced"))
    return one.join(F.broadcast(size))  # a row either side
