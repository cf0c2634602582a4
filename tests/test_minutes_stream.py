import pytest

from barline.streaming import minutes_stream as ms


def minute(symbol, i, kind="trade", close=1.0, ts=None):
    return (symbol, kind, 60_000 * i if ts is None else ts, 1.0, 2.0, 0.5, close, 1.0)


def test_loading_refuses_and_resumes(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    drop = lambda rows: spark.createDataFrame(rows, ms.MINUTES).repartition(2).write.mode("append").parquet(source)
    run = lambda: ms.load(spark, source, target, str(tmp_path / "check")).awaitTermination()
    drop([minute("A", i) for i in range(100, 105)] + [minute("B", 7), minute("B", 9), minute("A", 100, "mark")])
    run()
    taken = lambda: sorted((r.symbol, r.kind, r.ts // 60_000) for r in ms.loaded(spark, target).collect())
    refused = lambda: sorted((r.symbol, r.ts // 60_000, r.refused) for r in ms.loaded(spark, target, "refused").collect())
    first = [("A", "mark", 100), *[("A", "trade", i) for i in range(100, 105)], ("B", "trade", 7)]
    assert taken() == first and refused() == [("B", 9, "after a hole")]
    # After a restart the state is there: a repeat, a step back and a hole are refused, the next minutes go on.
    drop([minute("A", 104), minute("A", 101), minute("A", 105), minute("A", 108), minute("B", 8), minute("B", 9), minute("A", 106, close=9.0), minute("A", 0, ts=60_000 * 106 + 1)])
    run()
    assert taken() == sorted([*first, ("A", "trade", 105), ("B", "trade", 8), ("B", "trade", 9)])
    assert refused() == [("A", 101, "step back"), ("A", 104, "repeat"), ("A", 106, "no bar"), ("A", 106, "off the grid"), ("A", 108, "after a hole"), ("B", 9, "after a hole")]
    run()  # nothing new: nothing changes
    assert len(taken()) == 10
    assert {(r.symbol, r.kind): r.whole for r in ms.coverage(ms.loaded(spark, target)).collect()} == {("A", "trade"): True, ("A", "mark"): True, ("B", "trade"): True}


@pytest.mark.parametrize("last, given, want", [(None, [5], [None]), (4, [5, 5, 6, 3], ["step back", None, "repeat", None]), (4, [6], ["after a hole"])])
def test_judging(last, given, want):
    import pandas as pd

    rows = pd.DataFrame([minute("A", i) for i in given], columns=ms.MINUTES.fieldNames())
    out, now = ms.judge(rows, None if last is None else 60_000 * last)
    assert out["refused"].tolist() == want
