"""Sharding and mixing against their laws, on tables with ties, nulls, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillbook.llm import mixing, queries, sharding

FOLDER = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, source string, row_no long, SIZE string, shard string, block string, p_source string"


def odd_rows():
    rows = [(i, "copy of one text", "big", i, "a", "b", "c", "d") for i in range(120)]
    rows += [(i, " ".join(["w"] * (i % 40)), None if i % 7 == 0 else f"s{i % 3}", None, None, None, None, None) for i in range(120, 300)]
    rows += [(None, None, None, None, None, None, None, None)] * 3 + [(5, "", "big", None, None, None, None, None)] * 4
    rows += [(301, "long " * 3000, "big", None, None, None, None, None)]
    return rows


def check_packed(rows, texts, shards):
    assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32((t or "").encode()) for t in texts)
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 16 for t in texts)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_pack_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    rows = sharding.pack(docs, 8).collect()
    check_packed(rows, texts, 8)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 8
    groups = defaultdict(set)
    for r in sharding.packed(docs, 8).collect():
        groups[r.text].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())


def test_pack_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    packed = sharding.packed(docs, 6)
    assert packed.columns[:8] == docs.columns and len(set(map(str.lower, packed.columns))) == len(packed.columns)
    rows = packed.collect()
    assert sorted(map(str, (tuple(r)[:8] for r in rows))) == sorted(map(str, odd_rows()))
    check_packed(sharding.pack(docs, 6).collect(), [r[1] for r in odd_rows()], 6)
    names = [f"c{i}" for i in range(8)] + ["size", "text_crc32", "shard", "slot"]
    check_packed(packed.toDF(*names).collect(), [r[1] for r in odd_rows()], 6)
    # the copies exceed a shard's rows, so they are cut; no shard has much more than its share of rows
    counts = Counter(r[-2] for r in rows)
    assert max(counts.values()) < 1.5 * len(rows) / 6


@pytest.mark.parametrize("hot_keys", [2, 10, 1000])
def test_repeated_rows_find_their_slots(spark, monkeypatch, hot_keys):
    """A row that fills a third of the table, others that come a few times, single ones; names of helper columns among the columns."""
    monkeypatch.setattr(sharding, "HOT_KEYS", hot_keys)
    rows = [(1, "one row, many times", 0)] * 200 + [(i, f"text {i}", i) for i in range(2, 300)] + [(i, f"text {i}", -i) for i in range(2, 60)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key long").withColumns(
        {c: F.lit(c) for c in ("_block", "copy_no", "nth", "row_key", "whole_row")}).repartition(5)
    out = sharding.packed(docs, 6)
    assert out.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"]
    found = out.collect()
    check_packed(found, [r[1] for r in rows], 6)
    assert Counter((r.doc_id, r.text, r["_key"]) for r in found) == Counter(rows)
    places = Counter((r.doc_id, r.text, r.shard, r.slot) for r in found)
    wanted = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard) for r in found)
    assert max(places.values()) == 1 and sum(wanted.values()) == len(rows)


@pytest.mark.parametrize("shards", [3, 8])
def test_every_group_takes_the_best_shard(spark, shards):
    """The dealt rule, group by group: the shard chosen has the highest dot product of residual capacity and sizes."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    where = defaultdict(set)
    for r in sharding.pack(docs, shards).collect():
        where[texts[r.doc_id]].add(r.shard)
    sizes = defaultdict(lambda: [0, 0, 0])
    for text in texts.values():
        for at, n in enumerate((len(text.encode()) + 16, len(re.findall(r"\S+", text, re.ASCII)), 1)):
            sizes[text][at] += n
    capacity = [sum(s[at] for s in sizes.values()) / shards for at in range(3)]
    shares = {t: [n / c for n, c in zip(s, capacity, strict=True)] for t, s in sizes.items()}
    order = sorted(shares, key=lambda t: (-max(shares[t]), hashlib.md5(t.encode()).hexdigest()))
    assert max(shares[order[0]]) <= 1 and len(order) < sharding.CELL_GROUPS  # nothing is cut, one cell
    residual = [[1.0] * 3 for _ in range(shards)]
    for text in order:
        (shard,) = where[text]
        fits = [sum(a * b for a, b in zip(left, shares[text], strict=True)) for left in residual]
        assert fits[shard] >= max(fits) - 1e-9
        residual[shard] = [a - b for a, b in zip(residual[shard], shares[text], strict=True)]


def test_cells_and_few_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_GROUPS", 50)
    rows = [(i, "x" * random.Random(i).randint(1, 400)) for i in range(2000)]
    packed = sharding.pack(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check_packed(packed, [t for _, t in rows], 4)
    sizes = Counter()
    for r in packed:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 4


def test_pack_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.pack(empty).count() == 0 == sharding.packed(empty).count()


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 50, "b": 3, "c": 7, "d": 1}, {"a": 1}, {"a": 1, "b": 999}])
def test_one_cycle_deviates_by_less_than_a_block(weights):
    order, total = mixing.one_cycle(weights), sum(weights.values())
    done = Counter()
    for slot, source in enumerate(order):
        k = done[source]
        assert mixing.release(k, weights[source], total) <= slot < mixing.deadline(k, weights[source], total)
        done[source] += 1
        assert all(abs(done[s] - w * (slot + 1) / total) < 1 for s, w in weights.items())
    assert done == weights


def test_phases_place_every_block_once():
    weights = {"a": 5, "b": 3, "c": 2}
    blocks = {"a": 17, "b": 40, "c": 1}
    slots = {}
    for s in mixing.phases(blocks, weights):
        for j in range(s.first, s.last):
            lap, k = divmod(j - s.first, s.weight)
            slots[(s.source, j)] = s.start + lap * s.cycle + s.offsets[k]
    assert Counter(s for s, _ in slots) == blocks
    assert sorted(slots.values()) == list(range(sum(blocks.values())))


def test_mix_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    mixed = mixing.mix(docs, {"big": 3, "s1": 2}, block_bytes=256)
    assert mixed.columns[:8] == docs.columns and len(set(map(str.lower, mixed.columns))) == 13
    rows = mixed.collect()
    assert sorted(map(str, (tuple(r)[:8] for r in rows))) == sorted(map(str, odd_rows()))
    assert all(r[11] <= r[10] < r[12] for r in rows)
    # brute force: sizes laid end to end give each source's blocks
    groups = defaultdict(list)
    for r in rows:
        groups[mixing.OTHER if r[2] is None else r[2]].append((r[8], r[10], len((r[1] or "").encode()) + 1))
    for members in groups.values():
        members.sort()
        assert [s for _, s, _ in members] == sorted(s for _, s, _ in members)
        total = sum(n for *_, n in members)
        assert members[-1][0] <= (total - 1) // 256
    assert len({(b, g) for g, m in groups.items() for b, _, _ in m}) == len({s for m in groups.values() for _, s, _ in m})


def plain_mix(rows, weights, block_bytes):
    """(id, block, phase, slot) of (id, bucket, hash, bytes, queue) rows: every slot goes to the released block that is due first."""
    laid, starts = defaultdict(list), Counter()
    for i, _, _, size, queue in sorted(rows, key=lambda r: (r[4], r[1], r[2], r[0])):
        laid[queue].append((starts[queue] // block_bytes, i))
        starts[queue] += size
    left = {q: -(-n // block_bytes) for q, n in starts.items()}
    done, slot, phase, at = Counter(), 0, 0, {}
    while left:
        total, begun, taken = sum(weights[q] for q in left), slot, Counter()
        while True:
            released = [q for q in left if taken[q] * total // weights[q] <= slot - begun]
            q = min(released, key=lambda q: (-(-(taken[q] + 1) * total // weights[q]), q))
            if taken[q] == left[q]:
                break
            at[q, done[q]] = (phase, slot)
            taken[q], done[q], slot = taken[q] + 1, done[q] + 1, slot + 1
        left = {q: n - taken[q] for q, n in left.items() if n > taken[q]}
        phase += 1
    return {(i, block, *at[q, block]) for q, members in laid.items() for block, i in members}


@pytest.mark.parametrize("together", [1, 4_096])
def test_registered_query_against_a_plain_scheduler(spark, monkeypatch, together):
    monkeypatch.setattr(mixing, "BUCKETS_TOGETHER", together)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = -(-docs.count() // 50)
    rows = [tuple(r) for r in docs.select("doc_id", F.expr(f"pmod(xxhash64(doc_id, text), {n})"), F.expr("xxhash64(doc_id, text)"), F.expr(
        "octet_length(coalesce(text, '')) + 1"), F.coalesce("source", F.lit("*"))).collect()]
    listed = queries.MIX_WEIGHTS
    others = {r[4] for r in rows} - set(listed)
    n_parts = len(others) + ("*" in {r[4] for r in rows})
    weights = listed | {q: round(listed["*"] / n_parts) for q in others | {"*"}}
    assert len(others) > 5
    found = {(r.doc_id, r.block, r.phase, r.slot) for r in queries.op7_mixing(spark, folder).collect()}
    assert found == plain_mix(rows, weights, mixing.BLOCK_BYTES)


def test_sources_beyond_the_queues_share_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_QUEUES", 2)
    rows = [(i, "x" * (10 * (i % 7)), ("a", "b", "c", "d", None, "*", "named")[i % 7]) for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, {"named": 3, "*": 6}, block_bytes=64).collect()
    assert len(mixed) == 210
    slots = defaultdict(set)
    for r in mixed:
        slots[r.slot].add(r.source if r.source in ("c", "d", "named") else "*")  # c and d are the largest without a weight
    assert all(len(s) == 1 for s in slots.values()) and set.union(*slots.values()) == {"c", "d", "named", "*"}
    assert mixing.shared_out({"named": 3, "*": 6}, ["c", "d"], True) == {"named": 3, "c": 2, "d": 2, "*": 2}
    assert mixing.shared_out({"*": 6}, [], False) == {"*": 6}


def test_in_order_and_empty(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    assert mixing.in_order(docs, {"big": 3}).columns == docs.columns
    assert mixing.in_order(docs, {"big": 3}).count() == len(odd_rows())
    assert mixing.mix(docs.limit(0), {"big": 3}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": 0})


def test_slots_follow_files_of_unequal_size(spark, tmp_path):
    start = 0
    for k, n in enumerate((40, 900, 300, 2000, 5, 1200)):
        rows = spark.range(start, start + n, 1, 1).select(
            F.col("id").alias("doc_id"), F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 256), 20), F.lit("x")).alias("text"))
        rows.write.parquet(f"{tmp_path}/made/{k}")
        (made,) = (tmp_path / "made" / str(k)).glob("part-*.parquet")
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / f"part-{k:05d}-x.parquet").write_bytes(made.read_bytes())
        start += n
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert [r.doc_id for r in docs.select("doc_id").collect()] != list(range(start))
    for out in (sharding.packed(docs, 3), sharding.pack(docs, 3), sharding.pack(docs.filter("doc_id >= 0").select("text", "doc_id"), 3)):
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == list(range(start))
        for shard in range(3):
            ids = [r.doc_id for r in sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)]
            assert ids and ids == sorted(ids)


def test_slots_follow_the_mix_of_several_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = {"src0": 5, "src1": 1}
    mixed = mixing.in_order(docs, weights, block_bytes=4096)
    mixed.write.option("maxRecordsPerFile", 170).parquet(f"{tmp_path}/mixed")
    read = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(read.inputFiles()) > 3
    slot = {r.doc_id: r.slot for r in mixing.mix(docs, weights, block_bytes=4096).collect()}
    by_shard = defaultdict(list)
    for r in sharding.packed(read, 4).collect():
        by_shard[r.shard].append((r.slot, slot[r.doc_id]))
    for pairs in by_shard.values():
        order = [s for _, s in sorted(pairs)]
        assert order == sorted(order)
