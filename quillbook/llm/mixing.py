"""Interleaving of sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal bytes. With integer weight a of a total
of W, the source's block k of a cycle is released at slot floor(k W / a) and due
at ceil((k + 1) W / a); each slot takes the released block that is due first.
Every source is then less than one block away from its share at every slot, and
after W slots all are even, so one cycle is planned and the others repeat it:
a block's slot is arithmetic. Where a source runs out, a new phase begins
in which the others share the slots by their weights; every row is placed once.

Sources without a weight of their own share the weight of ``*`` equally: each
is a queue with its own releases and deadlines. Only beyond a bounded number of
them the smallest ones stay together in ``*``, which also holds null sources.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbook.llm.common import fresh, or_empty
from quillbook.session import materialize

OTHER = "*"
#: Rows of all sources in one of the buckets in which a source's rows are put in order, about.
BUCKET_ROWS = 1_000
BLOCK_BYTES = 1 << 16
#: Sum of all weights, at most: the length of a planned cycle.
MAX_CYCLE = 100_000
#: Sources without a weight that get a queue of their own, the largest ones first.
MAX_QUEUES = 64
#: Buckets summed up together before they are put end to end.
BUCKETS_TOGETHER = 4_096


@dataclass
class Share:
    """A source in a phase: its blocks [first, last), and where in a cycle each block of it falls."""

    source: str
    phase: int
    first: int
    last: int
    start: int
    weight: int
    cycle: int
    offsets: list[int]


def release(k: int, weight: int, cycle: int) -> int:
    return k * cycle // weight


def deadline(k: int, weight: int, cycle: int) -> int:
    return -(-(k + 1) * cycle // weight)


def one_cycle(weights: dict[str, int]) -> list[str]:
    """Source of each slot of a cycle, earliest deadline first among the released blocks."""
    cycle = sum(weights.values())
    waiting = [(0, s, 0) for s in weights]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # by deadline
    out = []
    for slot in range(cycle):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(k, weights[s], cycle), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, (release(k + 1, weights[s], cycle), s, k + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[Share]:
    """Shares of all phases for so many blocks of each source; its size depends on the weights alone."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, phase, out = 0, 0, []
    while left:
        common = math.gcd(*[weights[s] for s in left])
        active = {s: weights[s] // common for s in sorted(left)}
        order = one_cycle(active)
        full = min(left[s] // active[s] for s in active)
        taken = {s: full * active[s] for s in active}
        slots = full * len(order)
        for s in order:
            if taken[s] == left[s]:
                break
            taken[s] += 1
            slots += 1
        for s in active:
            offsets = [i for i, x in enumerate(order) if x == s]
            out.append(Share(s, phase, done[s], done[s] + taken[s], start, active[s], len(order), offsets))
            done[s] += taken[s]
        left = {s: n - taken[s] for s, n in left.items() if n > taken[s]}
        start, phase = start + slots, phase + 1
    return out


def shared_out(weights: dict[str, int], unlisted: list[str], rest: bool) -> dict[str, int]:
    """``weights`` with the entry ``*`` dealt in equal parts, rounded and 1 at least, to the unlisted sources and to ``*`` if it has rows."""
    members = [*unlisted, OTHER] if rest or not unlisted else unlisted
    part = max(1, round(weights[OTHER] / len(members)))
    return {s: w for s, w in weights.items() if s != OTHER} | dict.fromkeys(members, part)


def mix(docs: DataFrame, weights: dict[str, int], id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with block, phase, slot, release and due of each row (long), all rows kept.

    ``weights`` gives whole numbers above zero by source. The entry ``*`` (1 if
    there is none) is dealt in equal parts to the sources without one: the
    ``MAX_QUEUES`` with the most bytes (of equal ones the first by name) are
    queues of their own, further ones and rows with a null source, or one named
    ``*``, are one queue together. A row takes its UTF-8 bytes plus one, and belongs to the block in
    which it starts. Inside a source rows follow the hash of id and text, an
    order that does not depend on that of the table; fully equal rows are
    interchangeable, and each is placed. Sort by slot and id to train in order.
    Null ids and texts are values like others. An empty table gives no rows.
    """
    weights = {OTHER: 1} | {str(s): int(w) for s, w in weights.items()}
    if min(weights.values()) < 1 or sum(weights.values()) > MAX_CYCLE:
        raise ValueError(f"weights must be positive whole numbers with a sum of at most {MAX_CYCLE}")
    group, size, order, bucket, base, start, far, wide, lead = fresh(
        docs, "mix_group", "mix_bytes", "mix_order", "mix_bucket", "mix_base", "mix_start", "mix_far", "mix_wide", "mix_lead")
    names = fresh(docs, "block", "phase", "slot", "release", "due")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(OTHER))
    sized = docs.withColumns({
        group: source,
        size: F.octet_length(or_empty(text_col)).cast("long") + 1,
        order: F.xxhash64(id_col, text_col),
    })
    named = [s for s in weights if s != OTHER]
    by_source = materialize(sized.groupBy(group).agg(F.sum(size).alias(size), F.count("*").alias(base)))
    largest = by_source.filter(~F.col(group).isin(*named, OTHER)).orderBy(F.desc(size), group).limit(MAX_QUEUES)
    known = named + [r[0] for r in largest.collect()]
    queue = F.when(F.col(group).isin(known), F.col(group)).otherwise(OTHER)
    held = {r[0]: (r[1], r[2]) for r in by_source.groupBy(queue).agg(F.sum(size), F.sum(base)).collect()}  # a row for each queue at most
    weights = shared_out(weights, known[len(named):], OTHER in held)
    shares = phases({s: -(-n // block_bytes) for s, (n, _) in held.items()}, weights)
    n_buckets = max(1, -(-sum(n for _, n in held.values()) // BUCKET_ROWS))
    sized = sized.withColumns({group: queue, bucket: F.pmod(F.col(order), F.lit(n_buckets))})
    sums = sized.groupBy(group, bucket).agg(F.sum(size).alias(base)).withColumn(wide, F.expr(f"{bucket} div {BUCKETS_TOGETHER}"))
    # bytes ahead of a bucket: those of the runs of buckets before its own, and of the buckets before it in its run
    before = Window.partitionBy(group).orderBy(wide).rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy(group, wide).agg(F.sum(base).alias(far)).withColumn(lead, F.coalesce(F.sum(far).over(before), F.lit(0)))
    near = Window.partitionBy(group, wide).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(runs.drop(far), [group, wide]).select(
        group, bucket, (F.col(lead) + F.coalesce(F.sum(base).over(near), F.lit(0))).alias(base))
    inside = Window.partitionBy(group, bucket).orderBy(order, id_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(offsets, [group, bucket]).withColumn(
        start, F.floor((F.col(base) + F.coalesce(F.sum(size).over(inside), F.lit(0))) / block_bytes))
    rows = [(s.source, s.phase, s.first, s.last, s.start, s.weight, s.cycle, s.offsets) for s in shares]
    plan = docs.sparkSession.createDataFrame(
        rows, "p_source string, p_phase long, p_first long, p_last long, p_start long, p_weight long, p_cycle long, p_offsets array<long>")
    clash = {c: f"{c}_{i}" for i, c in enumerate(plan.columns)} if {c.lower() for c in docs.columns} & set(plan.columns) else {}
    plan = plan.withColumnsRenamed(clash)
    p = {c: F.col(clash.get(c, c)) for c in ("p_source", "p_phase", "p_first", "p_last", "p_start", "p_weight", "p_cycle", "p_offsets")}
    # one row for each queue and phase: a size that the weights and MAX_QUEUES bound, whatever the data
    met = placed.join(F.broadcast(plan), (F.col(group) == p["p_source"]) & (F.col(start) >= p["p_first"]) & (F.col(start) < p["p_last"]))
    nth = F.col(start) - p["p_first"]
    k, lap = F.pmod(nth, p["p_weight"]), p["p_start"] + F.floor(nth / p["p_weight"]) * p["p_cycle"]
    return met.select(
        *docs.columns, F.col(start).alias(names[0]), p["p_phase"].alias(names[1]),
        (lap + F.element_at(p["p_offsets"], (k + 1).cast("int"))).alias(names[2]),
        (lap + F.floor(k * p["p_cycle"] / p["p_weight"])).alias(names[3]),
        (lap + F.ceil((k + 1) * p["p_cycle"] / p["p_weight"])).alias(names[4]),
    )


def in_order(docs: DataFrame, weights: dict[str, int], id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of ``docs`` in the order of the mix, dealt to partitions by ranges of slots; same columns.

    Written out, the files follow each other, and the rows in them, in that order.
    """
    mixed = mix(docs, weights, id_col, text_col, source_col, block_bytes)
    slot = mixed.columns[len(docs.columns) + 2]
    return mixed.repartitionByRange(slot, id_col).sortWithinPartitions(slot, id_col).select(*docs.columns)
