"""The driver's contract, the streams and the sources."""

import numpy as np
import __spark_entry__ as entry
import pytest
from lattica.queries import oracle_sql, queries
from lattica.sources import files, generators
from lattica.streaming import fir


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    rows = [(i % 2, i, float(i)) for i in range(20)]
    spark.createDataFrame(rows[:10], "u int, t int, x double").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame(rows[10:], "u int, t int, x double").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    source = spark.readStream.schema("u int, t int, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = fir.fir(source, "u", "t", "x", [1.0, -1.0]).writeStream.format("memory").queryName("fir").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["u"], r["t"]): r["y"] for r in spark.table("fir").collect()}
    assert len(got) == 20 and sum(y == 2.0 for y in got.values()) >= 16


def test_sources(spark, tmp_path):
    x = np.arange(6.0).reshape(2, 3)
    np.save(f"{tmp_path}/0.npy", x)
    np.save(f"{tmp_path}/1.npy", x + 10)
    df, dims = files.read_npy(spark, f"{tmp_path}/*.npy")
    assert dims == (2, 2, 3) and {r["k"]: r["v"] for r in df.collect()}[10] == 14.0
    z = np.array([[1 + 2j, 3], [0, -1j]])
    np.save(f"{tmp_path}/z.npy", z)
    df, dims = files.read_npy(spark, f"{tmp_path}/z.npy")
    assert dims == (1, 2, 2) and {r["k"]: complex(r["re"], r["im"]) for r in df.collect()} == dict(enumerate(z.ravel()))
    with pytest.raises(ValueError):
        files.read_npy(spark, f"{tmp_path}/*.npy")
    plain, out = generators.linear2d(spark, np.arange(4) * 1.0, np.arange(8) * 1.0, 1.0, 2.0, 30.0, 1.0, [1.0])
    got = {r["k"]: r["v"] for r in out.collect() if abs(r["v"]) > 1e-12}
    assert np.isclose(got[2 * 8 + 3], 1.0) and np.isclose(got[8 + 2], 0.5) and np.isclose(got[8 + 3], 0.5)
    assert {r["k"]: r["v"] for r in plain.collect() if abs(r["v"]) > 1e-12} == got


def test_events_at_the_end_of_the_trace(spark):
    """An event at the last sample, and one past it whose wavelet reaches back."""
    t, wav = np.arange(10) * 0.5, [1.0, 2.0, 3.0, 2.0, 1.0]
    for t0, want in ((4.5, {7: 1.0, 8: 2.0, 9: 3.0}), (5.0, {8: 1.0, 9: 2.0})):
        plain, out = generators.hyperbolic2d(spark, np.zeros(1), t, t0, 1000.0, 1.0, wav)
        assert {r["k"]: r["v"] for r in out.collect() if r["v"]} == want
        assert {r["k"]: r["v"] for r in plain.collect() if r["v"]} == ({9: 1.0} if t0 == 4.5 else {})


def test_axes():
    par = {"ox": 1, "dx": 2, "nx": 3, "ot": 1, "dt": 0.5, "nt": 3}
    t, t2, x, y = generators.makeaxis(par)
    assert t.tolist() == [1, 1.5, 2] and t2.tolist() == [-1, -0.5, 0, 0.5, 1] and x.tolist() == [1, 3, 5] and y is None
    assert generators.makeaxis(par | {"oy": 0, "dy": 1, "ny": 2})[3].tolist() == [0, 1]
