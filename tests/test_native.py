import numpy as np
import pytest

from thermalake.sources import classic, native


@pytest.mark.parametrize("version", [1, 2, 5])
def test_files_come_back(version):
    import io

    rng = np.random.default_rng(version)
    dims = {"time": 3, "y": 4, "x": 5, "c": 2}
    held = {
        "rad": (("y", "x", "c"), rng.normal(size=(4, 5, 2)), {"scale_factor": 0.5, "units": "W"}),
        "count": (("y", "x"), rng.integers(-5, 5, (4, 5)).astype("i2"), {"_FillValue": np.int16(-3), "valid_range": np.array([-4, 3], "i2")}),
        "k": ((), np.float32(7.5), {}),
        "t": (("time",), np.arange(3.0), {}),
        "day": (("time", "x"), rng.integers(0, 9, (3, 5)).astype("i2"), {}),
    }
    file = io.BytesIO(classic.encode(dims, held, {"title": "räw", "n": 3}, records="time", version=version))
    header = classic.read_header(file)
    assert header.dims == dims and header.attributes == {"title": "räw", "n": 3}
    for name, (own, values, attributes) in held.items():
        v = header.variables[name]
        assert v.dims == own and v.attributes.keys() == attributes.keys()
        assert np.array_equal(classic.read_rows(file, header, name), values)
        if own:
            assert np.array_equal(classic.read_rows(file, header, name, 1, 3), values[1:3])
    out = classic.decoded(held["count"][1], header.variables["count"].attributes, ">i2")
    raw = held["count"][1].astype(float)
    assert np.array_equal(out, np.where((raw == -3) | (raw < -4) | (raw > 3), np.nan, raw), equal_nan=True)
    with pytest.raises(ValueError):
        classic.parse(b"\x89HDF0000")
    with pytest.raises(ValueError):
        classic.read_header(io.BytesIO(file.getvalue()[:40]))


def test_headers_longer_than_one_read_and_agreement_with_another_reader(tmp_path):
    names = {f"v{i}": (("y", "x"), np.full((2, 3), float(i)), {"long_name": "n" * 300}) for i in range(400)}
    (tmp_path / "long.nc").write_bytes(classic.encode({"y": 2, "x": 3}, names))
    with native.opened(str(tmp_path / "long.nc")) as file:
        header = classic.read_header(file)
        assert len(header.variables) == 400 and (classic.read_rows(file, header, "v399") == 399).all()
    scipy = pytest.importorskip("scipy.io")
    with scipy.netcdf_file(str(tmp_path / "long.nc"), mmap=False) as other:
        assert (other.variables["v7"][:] == 7).all()


@pytest.fixture
def day_files(tmp_path):
    """Two days of gridded files with both satellites, and their label files."""
    rng, held = np.random.default_rng(1), {}
    for day in (245, 246):
        variables = {}
        for sat in ("G16", "G18"):
            rad = rng.normal(100, 5, (10, 6, 9))
            rad[0, 0, 4] = np.nan
            variables[f"rad_{sat}_interp_corr"] = (("y", "x", "channel"), rad, {"_FillValue": np.nan})
            variables[f"lza_{sat}_interp_corr"] = (("y", "x"), rng.uniform(0, 80, (10, 6)), {})
            variables[f"planck_{sat}"] = (("channel", "coefficient"), np.arange(36.0).reshape(9, 4) + day, {})
        held[day] = variables
        (tmp_path / f"abi_day{day}.nc").write_bytes(classic.encode({"y": 10, "x": 6, "channel": 9, "coefficient": 4}, variables))
        labels = rng.integers(0, 4, (10, 6)).astype("i4")
        known = np.where(rng.random((10, 6)) < 0.8, labels.astype(float), np.nan)
        held[day, "labels"] = labels, known
        (tmp_path / f"scene_day{day}.nc").write_bytes(classic.encode({"y": 10, "x": 6}, {"labels": (("y", "x"), labels, {}), "sorted_labels": (("y", "x"), known, {"_FillValue": np.nan})}))
    return tmp_path, held


def test_pixels_labels_and_calibration(spark, day_files):
    folder, held = day_files
    df = native.read_pixels(spark, f"{folder}/abi_*.nc", labels=f"{folder}/scene_*.nc", rows=3)
    from thermalake.sources.tables import PIXELS

    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in PIXELS]
    rows = {(r.day, r.sat, r.y, r.x): r for r in df.collect()}
    assert len(rows) == 2 * 2 * 60
    for (day, sat, y, x), r in rows.items():
        want = held[day][f"rad_{sat}_interp_corr"][1][y, x][list(native.SPECTRAL)]
        assert [None if np.isnan(w) else w for w in want] == r.rad
        assert r.lza == held[day][f"lza_{sat}_interp_corr"][1][y, x]
        labels, known = held[day, "labels"]
        assert r.scene == (None if np.isnan(known[y, x]) else labels[y, x])
    got = {(r.day, r.sat, r.channel): (r.fk1, r.fk2, r.bc1, r.bc2) for r in native.gridded_calibration(spark, f"{folder}/abi_*.nc").collect()}
    assert len(got) == 2 * 2 * 6 and got[245, "G18", 14] == tuple(np.arange(24.0, 28.0) + 245)
    every_third = native.read_pixels(spark, f"{folder}/abi_*.nc", rows=4, stride=3).collect()
    assert {(r.y, r.x) for r in every_third} == {(y, x) for y in (0, 3, 6, 9) for x in (0, 3)}


def test_filters_leave_files_and_slabs_unread(spark, day_files):
    folder, held = day_files
    (folder / "abi_day247.nc").write_bytes(b"a damaged file")
    data = (folder / "abi_day246.nc").read_bytes()
    lza = classic.parse(data).variables["lza_G16_interp_corr"]
    df = native.read_grids(spark, f"{folder}/abi_*.nc", "day int, y int, x int, lza_G16_interp_corr double", rows=2)
    kept = df.filter("day = 246 AND y >= 4 AND y < 7 AND x IN (1, 2)")
    assert {(r.y, r.x, r[3]) for r in kept.collect()} == {(y, x, held[246]["lza_G16_interp_corr"][1][y, x]) for y in (4, 5, 6) for x in (1, 2)}
    assert "PushedFilters" not in kept._jdf.queryExecution().executedPlan().toString() or kept.rdd.getNumPartitions() == 2
    # all but the wanted slabs are cut out of the file: reading them would fail
    (folder / "abi_day246.nc").write_bytes(data[: lza.begin + 8 * 6 * 8])
    assert kept.count() == 6
    with pytest.raises(Exception, match="ends before row"):
        df.filter("day = 246").count()
    with pytest.raises(Exception, match="classic grid format"):
        df.filter("day = 247").count()
    with pytest.raises(Exception, match="missing variables"):
        native.read_grids(spark, f"{folder}/abi_day245.nc", "y int, nothing double").count()
    assert set(native.read_grids(spark, f"{folder}/scene_day245.nc").columns) == {"path", "day", "sat", "channel", "y", "x", "labels", "sorted_labels"}


def test_raw_channels(spark, tmp_path):
    for sat, c, scale in (("G16", 8, 0.1), ("G16", 14, 0.2), ("G18", 14, 0.2)):
        counts = np.arange(12, dtype="i2").reshape(3, 4)
        variables = {"Rad": (("y", "x"), counts, {"scale_factor": scale, "add_offset": -1.0, "_FillValue": np.int16(5)})}
        variables |= {f"planck_{n}": ((), np.float32(v + c), {}) for n, v in (("fk1", 1000), ("fk2", 10), ("bc1", 0), ("bc2", 1))}
        (tmp_path / f"OR_ABI-L1b-RadF-M6C{c:02d}_{sat}_s2023245.nc").write_bytes(classic.encode({"y": 3, "x": 4}, variables))
    rows = native.read_channels(spark, str(tmp_path), stride=2).orderBy("sat", "channel", "y", "x").collect()
    assert [(r.day, r.sat, r.channel) for r in rows[:1]] == [(245, "G16", 8)]
    assert [round(r.rad, 6) for r in rows if (r.sat, r.channel) == ("G16", 14)] == [-1.0, -0.6, 0.6, 1.0] and rows[0].planck.fk1 == 1008
    table = {(r.sat, r.channel): r.fk2 for r in native.calibration(spark, str(tmp_path)).collect()}
    assert table == {("G16", 8): 18.0, ("G16", 14): 24.0, ("G18", 14): 24.0}
    assert native.read_channels(spark, str(tmp_path)).filter("rad IS NULL").count() == 3
