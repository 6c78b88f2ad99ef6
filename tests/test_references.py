import datetime

from memoriq.operators.references import Reference, orphan_references, orphan_report

ROW = "id string, memory_id string, created_at timestamp, ref string"
MEM = "id string, tombstoned boolean, created_at timestamp, dead string"


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def cases(spark, rows, parents):
    refs = [Reference("t", spark.createDataFrame(rows, ROW), "memory_id", "m")]
    return sorted(tuple(r) for r in orphan_references(refs, {"m": spark.createDataFrame(parents, MEM)}).collect())


def test_reasons_cases_and_repeats(spark):
    parents = [("A", False, day(0), None), ("b", True, day(9), None), ("C", None, day(40), "x"), ("c", False, day(50), None)]
    rows = [
        ("X1", "a", day(5), None), ("x2", "B", day(1), None), ("x3", "c", day(31), None), ("x3", "C", day(31), None), ("x4", "zz", day(2), "q"),
        ("x5", None, day(2), None), ("x6", "c", day(45), None), ("x7", "c", None, None), ("x8", "zz", None, None),
    ]
    assert cases(spark, rows, parents) == [
        ("t", "x2", "memory_id", "deleted", "2024-01"), ("t", "x3", "memory_id", "late", "2024-02"),
        ("t", "x4", "memory_id", "missing", "2024-01"), ("t", "x8", "memory_id", "missing", None),
    ]


def test_empty_tables(spark):
    assert cases(spark, [], [("a", False, day(0), None)]) == []
    assert cases(spark, [("x", "a", day(0), None)], []) == [("t", "x", "memory_id", "missing", "2024-01")]


def test_hot_key_and_report(spark):
    rows = [(f"x{i}", "gone" if i % 3 == 0 else "a", day(i % 60), None) for i in range(900)]
    refs = [Reference("t", spark.createDataFrame(rows, ROW), "memory_id", "m")]
    report = orphan_report(refs, {"m": spark.createDataFrame([("a", False, day(0), None)], MEM)})
    assert sum(r["n_rows"] for r in report.collect()) == 300
