from pyspark.sql import functions as F

from leafmill.operators import order, sections


def test_running_sums_and_sections_over_ranges(spark):
    """A path that lies in several ranges is numbered as a whole, and its pages keep their whole text."""
    rows = [(p, i, f"{p}{i} " * (i % 40 if i % 7 else 0), i % 5 == 1) for p, n in (("a", 3), ("big", 4000), ("z", 40), (None, 9)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "path string, pos int, text string, has_break boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summed = order.with_running_sum(df, "path", F.col("has_break").cast("int"), "n", "pos").collect()
        assert len({r.path for r in summed}) == 4 and all(r.n == (r.pos + 4) // 5 for r in summed) and len(summed) == len(rows)
        got = {(r.path, r.section): r.text for r in sections.split_sections(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, {}
    for path, pos, text, starts in rows:
        if text:
            group = (pos + 4) // 5
            if last.get(path, (0, 0))[1] != group:
                last[path] = (last.get(path, (0, 0))[0] + 1, group)
            want.setdefault((path, last[path][0]), []).append(text)
    assert got == {k: "\n".join(v) for k, v in want.items()}


def test_running_sums_by_ranges(spark):
    rows = [(i % 37, i, ("a", "b", None)[i % 3], i % 4) for i in range(3000)]
    df = order.by_ranges(spark.createDataFrame(rows, "t int, id int, k string, v int"), "t", "id")
    got = order.with_range_sum(order.with_range_sum(df, F.col("v"), "all_", [], "t", "id"), F.col("v"), "own", ["k"], "t", "id").collect()
    total, own = 0, {}
    want = {}
    for t, i, k, v in sorted(rows, key=lambda r: r[:2]):
        total += v
        own[k] = own.get(k, 0) + v
        want[i] = (total, own[k])
    assert {r.id: (r.all_, r.own) for r in got} == want and len(got) == 3000


def test_log_lines_of_files(spark, tmp_path):
    from leafmill.operators import logs

    (tmp_path / "a.log").write_text("2024-01-01 10:00:00 start\nTraceback x\n\n2024-02-01T10:00:00 end\nTraceback y\n")
    lines = logs.dated(logs.read_lines(spark, str(tmp_path / "a.log")))
    got = [(r.line[:9], r.last_ts and r.last_ts.month) for r in logs.carried(lines, "line_id").orderBy("line_id").collect()]
    assert got == [("2024-01-0", 1), ("Traceback", 1), ("", 1), ("2024-02-0", 2), ("Traceback", 2)]
    assert logs.tracebacks(lines, "line_id", F.lit("2024-01-15").cast("timestamp")).first().tracebacks == 1
