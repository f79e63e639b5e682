"""Paragraphs of calibration logs."""

from pyspark.sql import functions as F

from gaugeline.operators import calibration


def test_texts_are_read_one_at_a_time(spark):
    """Lambdas of Spark run interpreted, once per entry and step."""
    logs = spark.createDataFrame([(1, "x")], "id long, content string")
    plan = calibration.parse_logs(logs)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_many_paragraphs_take_several_batches(spark):
    n = 3 * calibration._BATCH_ROWS + 5
    log = "Parameter Type=,pH\nk=,meta\n" + "".join(f"\n[point]\nk=,{i}\nk=,{-i}\n" for i in range(n))
    logs = spark.createDataFrame([(7, log, "a"), (8, None, "b"), (9, log, None)], "id long, content string, more string")
    parsed = calibration.parse_logs(logs)
    assert parsed.columns == ["id", "more", "chapter", "paragraph", "parameter_type", "fields"]
    found = parsed.select("id", "more", "paragraph", F.col("fields")["k"], F.col("fields")["k 2"], F.size("fields")).collect()
    assert sorted(found, key=lambda r: (r[0], r[2])) == [(i, m, p, str(p), str(-p), 3) for i, m in ((7, "a"), (9, None)) for p in range(n)]


def test_header_lines_and_line_ends(spark):
    head = calibration.EXPORT_HEADER
    log = f"\xa0{head} ----------\r\n\t{head}\ra=,1 {head}\x85Parameter Type=, t \x1f\r\n\r\n[x]\n {head} b=,0\nb=, 2\x0b\x0cno pair\n\n[y]\nb=,3\r{head}"
    rows = calibration.parse_logs(spark.createDataFrame([(log,)], "content string")).orderBy("paragraph").collect()
    assert [(r.chapter, r.paragraph, r.parameter_type, r.fields) for r in rows] == [
        (0, 0, "t", {"a": f"1 {head}", "Parameter Type": "t", "b": "2"}),
        # what follows a blank line is a paragraph, whose first line is its heading
        (0, 1, "t", {"a": f"1 {head}", "Parameter Type": "t"}),
        (0, 2, "t", {"a": f"1 {head}", "Parameter Type": "t", "b": "3"}),
    ]
