import json

from ranksheaf.streaming import generation


def drop(folder, name, minute, rows):
    fields = ("request_id", "step", "piece", "is_last")
    (folder / name).write_text("\n".join(json.dumps(dict(zip(fields, r, strict=True), at=f"2024-01-01T00:{minute:02}:00Z")) for r in rows) + "\n")


def test_late_and_repeated_steps(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    events = tmp_path / "in"
    events.mkdir()

    def run():
        rows = generation.assembled(generation.arriving(spark, str(events)), hold_ms=10 * 60_000)
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(generation.ANSWERS).parquet(str(tmp_path / "out")).collect())

    try:
        drop(events, "1.json", 0, [("a", 1, "two ", False), ("b", 0, "only", True), ("a", 1, "again", False), (None, 0, "x", True), ("d", -1, "x", True)])
        assert run() == [("b", "only", 1, True)]
        drop(events, "2.json", 1, [("a", 2, "three", True), ("b", 0, "only", True), ("c", 0, "cut ", False), ("c", 2, "off", False)])
        assert len(run()) == 1  # step 0 of a is missing; b is not told twice
        drop(events, "3.json", 2, [("a", 0, "one ", False), ("a", 3, "beyond the end", False)])
        assert run() == [("a", "one two three", 3, True), ("b", "only", 1, True)]
        drop(events, "4.json", 30, [("e", 0, "e", True)])  # the watermark passes the time of c and d
        assert run() == [("a", "one two three", 3, True), ("b", "only", 1, True), ("c", "cut ", 1, False), ("d", "", 0, False), ("e", "e", 1, True)]
        drop(events, "5.json", 3, [("c", 1, "too late", True)])
        assert len(run()) == 5
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
