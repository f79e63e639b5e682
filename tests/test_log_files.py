"""Calibration logs at size: files of bounded length."""

from pathlib import Path

from gaugeline.operators import calibration
from gaugeline.plans import checks_columns

SF_DIR = "/root/testdata/sf0.001"


def test_more_logs_make_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checks_columns, "LOGS_OF_A_FILE", 4, raising=False)
    monkeypatch.setattr(checks_columns, "scratch", lambda *_: f"file:{tmp_path}/logs")
    rows = checks_columns.log_scan(spark, SF_DIR).collect()
    held = [p.read_bytes().count(calibration.EXPORT_HEADER.encode()) for p in Path(tmp_path, "logs").glob("*.csv")]
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    assert sum(held) == events and max(held) <= 4
    assert sum(r.n for r in rows) == 4 * events


def test_disk_holds_a_batch_of_logs(spark, tmp_path, monkeypatch):
    """Rows of their own, with event ids that repeat or are missing."""
    n, batch = 1000, 300
    rows = [(None if i % 3 == 0 else i % 7, i, i % 5, "click", i / 4) for i in range(n)]
    times = "timestamp_seconds(1700000000 + at) as ts"
    made = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double")
    made.selectExpr("event_id", times, "user_id", "event_type", "value", "'{}' as props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(checks_columns, "scratch", lambda *_: f"file:{tmp_path}/logs")
    monkeypatch.setattr(checks_columns, "LOGS_OF_A_BATCH", batch, raising=False)
    read, held = checks_columns.read_logs, []

    def counted(spark, path):
        at = Path(path.removeprefix("file:"))
        files = [sorted(at.glob("*.csv")), sorted(at.glob("older/*.csv")), sorted(at.glob("*.txt"))]
        held.append([sum(p.read_bytes().count(calibration.EXPORT_HEADER.encode()) for p in f) for f in files])
        return read(spark, path)

    monkeypatch.setattr(checks_columns, "read_logs", counted)
    found = sorted(checks_columns.log_scan(spark, str(tmp_path)).collect(), key=lambda r: (r.parameter_type, r.paragraph))
    assert all(csv == older == text <= batch for csv, older, text in held)
    assert sum(csv for csv, *_ in held) == n
    pre = [sum(round((r[4] + p) * 100) for r in rows) / 100 for p in (0, 1)]
    assert [tuple(r) for r in found] == [(k, p, u if p == 0 else "", n, pre[p]) for k, u in (("Sp Cond (µS/cm)", "µS/cm"), ("pH", "pH")) for p in (0, 1)]
