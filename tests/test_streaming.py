import random

from pyspark.sql import functions as F

from quillbook.operators.registry import registry_state
from quillbook.streaming import intake

STATEMENT = "Date Description Debit Credit Balance\n01/02/2024 SHOP 5.00 0.00 95.00\n02/02/2024 PAY 5.00 0.00 90.00\n"


def test_intake_registers_and_parses(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.txt").write_text(STATEMENT)
    (drop / "b.txt").write_text("nothing here")
    (drop / "d.exe").write_text(STATEMENT)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    intake.run_intake(intake.watch_folder(spark, str(drop)), out, state).awaitTermination()
    (drop / "c.txt").write_text(STATEMENT.replace("SHOP", "STORE"))
    intake.run_intake(intake.watch_folder(spark, str(drop)), out, state).awaitTermination()
    rows = spark.read.parquet(f"{out}/transactions")
    assert sorted((r.file_name, r.description) for r in rows.collect()) == [
        ("a.txt", "PAY"), ("a.txt", "SHOP"), ("c.txt", "PAY"), ("c.txt", "STORE"),
    ]
    log = spark.read.parquet(f"{out}/registry_log").withColumn("event_id", F.col("event_id").cast("long"))
    assert {r.document_id: (r.status, r.chunk_count) for r in registry_state(log).collect()} == {
        "a.txt": ("indexed", 2), "b.txt": ("error", 0), "c.txt": ("indexed", 2), "d.exe": ("error", 0),
    }


def test_repeated_uploads_are_dropped(spark, tmp_path):
    source = str(tmp_path / "uploads")
    schema = "file_name string, text string, content_hash string, arrived_at timestamp"
    rows = [("a", "t", "h1", 1), ("a", "t", "h1", 2), ("a", "u", "h2", 3), ("b", "t", "h1", 4)]
    df = spark.createDataFrame(rows, "file_name string, text string, content_hash string, s int")
    df.select("file_name", "text", "content_hash", F.timestamp_seconds("s").alias("arrived_at")).write.parquet(source)
    unique = intake.drop_repeated_uploads(spark.readStream.schema(schema).parquet(source))
    query = unique.writeStream.format("memory").queryName("unique_uploads").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.file_name, r.content_hash) for r in spark.table("unique_uploads").collect())
    assert got == [("a", "h1"), ("a", "h2"), ("b", "h1")]


FEED = "account long, ts timestamp, id long, debit long, credit long, balance long"


def live(spark, tmp_path, batches, late_by="10 seconds"):
    """{(account, id): (breaks, late)} after batches of (account, second, id, debit, credit, balance), one file each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", intake.ROCKSDB)
    source, name = str(tmp_path / "feed"), f"live_{tmp_path.name}".replace("-", "_")
    for batch in batches:
        rows = spark.createDataFrame(batch, FEED.replace("ts timestamp", "s double"))
        rows.withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("long"))).drop("s").coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        intake.live_balance_check(feed, late_by).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sorted(((r.account, r.id, r.breaks, r.late) for r in spark.table(name).collect()), key=str)


def test_live_balance_check_orders_rows_across_batches(spark, tmp_path):
    got = live(spark, tmp_path, [
        [(1, 1.0, 1, 0, 0, 10000), (1, 3.0, 4, 500, 0, 9300), (2, 1.0, 2, 0, 0, 500)],
        [(1, 2.0, 3, 500, 0, 9500), (2, 2.0, 5, 0, 100, 650)],  # account 1: between the two rows before
        [(9, 100.0, 9, 0, 0, 1)],  # the watermark passes all
    ])
    # 5 is off by 50 cents, within a unit; 9 is still waiting
    assert got == [(1, 1, False, False), (1, 3, False, False), (1, 4, True, False), (2, 2, False, False), (2, 5, False, False)]


def test_live_balance_check_reports_late_rows(spark, tmp_path):
    got = live(spark, tmp_path, [
        [(1, 1.0, 1, 0, 0, 10000), (1, 3.0, 2, 0, 0, 20000), (None, 3.0, 20, 0, 0, 5)],
        [(9, 100.0, 9, 0, 0, 1)],
        [(9, 101.0, 19, 0, 0, 1)],  # account 1 is let go here
        [(1, 2.0, 3, 0, 0, 15000), (1, 3.0, 2, 0, 0, 20000), (1, None, 4, 0, 0, 1), (1, 4.0, 5, None, 1000, 21000), (1, 4.0, None, 0, 0, None),
         (9, 100.0, 10, 500, 0, 1)],
        [(9, 200.0, 11, 0, 0, 1)],
        [(9, 300.0, 12, 0, 0, 1)],
    ])
    assert got == sorted([
        (1, 1, False, False), (1, 2, True, False), (None, 20, False, False),
        (1, 3, None, True), (1, 2, None, True), (1, 4, None, True),  # behind the last row, a repeat of it, without a time
        (1, None, False, False), (1, 5, False, False),  # one time: by id, one without id first; after an unknown balance nothing breaks
        (9, 9, False, False), (9, 10, True, False), (9, 19, False, False), (9, 11, False, False),
    ], key=str)


def test_live_balance_check_equals_the_sorted_feed(spark, tmp_path):
    draw = random.Random(5)
    rows, balance = [], 50_000
    for n in range(1, 61):
        debit = draw.randrange(1, 4000)
        balance += 3000 - debit
        rows.append((1, n * 0.0004, n, debit, 3000, balance + draw.choice([0, 0, 0, 700])))
    breaks, before = {}, 0
    for _, _, n, debit, credit, value in rows:
        breaks[n] = before != 0 and value != 0 and abs(before - debit + credit - value) > 100
        before = value
    draw.shuffle(rows)
    got = live(spark, tmp_path, [rows[:20], rows[20:40], rows[40:], [(2, 1000.0, 0, 0, 0, 1)]])
    assert {n: (off, late) for a, n, off, late in got if a == 1} == {n: (off, False) for n, off in breaks.items()}
    assert any(breaks.values()) and not all(breaks.values())
