import pytest
from pyspark.sql import functions as F

from thermalake.plans import governance as g
from thermalake.sources import tables


def test_settings_extend_shallowly(tmp_path):
    (tmp_path / "base.yaml").write_text("nested: {a: 1, b: 2}\nkept: 3\n")
    (tmp_path / "child.yaml").write_text("extends: base.yaml\nnested: {b: 4}\n")
    assert g.load_settings(tmp_path / "child.yaml") == {"nested": {"b": 4}, "kept": 3}
    (tmp_path / "base.yaml").write_text("extends: child.yaml\n")
    with pytest.raises(ValueError):
        g.load_settings(tmp_path / "child.yaml")


def test_identities_and_status(spark):
    assert g.identity({"b": 1, "a": [1, 2]}) == g.identity({"a": [1, 2], "b": 1})
    source = "def f():\n    return 1\n\ndef g():\n    return 2\n"
    assert g.code_identity(source, ["f"]) == g.code_identity(source.replace("2", "3"), ["f"]) != g.code_identity(source, ["g"])
    df = spark.range(20)
    assert g.table_identity(df) == g.table_identity(df.repartition(5))
    assert g.status(None, {}) == ("missing", []) and g.status({"a": 1}, {"a": 2}) == ("stale", ["a"]) and g.status({"a": 1}, {"a": 1}) == ("current", [])
    chain = "LIMIT = 3\ndef helper(x):\n    return x + LIMIT\n\ndef f():\n    return helper(1)\n\nOTHER = 5\n"
    of_f = g.code_identity(chain, ["f"])
    assert of_f != g.code_identity(chain.replace("LIMIT = 3", "LIMIT = 4"), ["f"]) and of_f == g.code_identity(chain.replace("OTHER = 5", "OTHER = 6"), ["f"])
    with pytest.raises(KeyError):
        g.code_identity(chain, ["nothing"])
    stage = g.stage_identity("fit", {"k": 7}, chain, ["f"], ["before"])
    assert stage == g.stage_identity("fit", {"k": 7}, chain, ["f"], ["before"]) != g.stage_identity("fit", {"k": 8}, chain, ["f"], ["before"])
    first, reused = g.reuse_or_run(None, {"a": 1}, lambda: {"value": 3})
    assert not reused and g.reuse_or_run(first, {"a": 1}, lambda: {"value": 4}) == (first, True) and g.reuse_or_run(first, {"a": 2}, lambda: {"value": 4})[0]["value"] == 4


def test_settings_are_checked():
    assert g.resolve_components(7, 4, 10) == [6, 7, 8] and g.resolve_components(4, 4, 10) == [4, 5]
    with pytest.raises(ValueError):
        g.resolve_components(3, 4, 10)
    g.check_days([1, 2], [3], [3, 1, 2])
    for bad in (([1, 2], [2], [1, 2]), ([1], [2], [1, 2, 3]), ([1, 1], [2], [1, 2])):
        with pytest.raises(ValueError):
            g.check_days(*bad)
    rules = {"k": (int, 1, 20), "share": ((int, float), 0.0, 1.0)}
    g.check_settings({"k": 7, "share": 0.5}, rules)
    for bad in ({"k": 7}, {"k": "7", "share": 0.5}, {"k": True, "share": 0.5}, {"k": 7, "share": 1.5}):
        with pytest.raises(ValueError):
            g.check_settings(bad, rules)
    a, b = {"x": {"y": 1, "z": 2}, "t": 3}, {"x": {"y": 1, "z": 4}, "u": 5, "t": 9}
    assert g.profile_differences(a, b, ["t"]) == ["u", "x.z"]
    assert g.requirement([{"id": "a", "v": 1}, {"id": "a", "v": 1}], "a")["v"] == 1
    for bad in ([{"id": "a", "v": 1}, {"id": "a", "v": 2}], []):
        with pytest.raises((ValueError, KeyError)):
            g.requirement(bad, "a")
    terms = [{"name": "a", "bias": 1.0}, {"name": "a", "bias": 2.0}, {"name": "b", "bias": 1.0}, {"name": "b", "bias": 3.0, "kind": "sensitivity"}]
    assert g.term_conflicts(terms) == ["a"]


def test_gate():
    good = {"selection": {"n_components": 7, "reviewer": "r", "date": "d", "reason": "x", "diagnostics_sha256": "h"}}
    assert g.selected_components(good, "h", [6, 7]) == 7
    for bad in ({}, {"selection": good["selection"] | {"date": None}}, {"selection": good["selection"] | {"n_components": 9}}):
        with pytest.raises(ValueError):
            g.selected_components(bad, "h", [6, 7])
    with pytest.raises(ValueError):
        g.selected_components(good, "other", [7])


def test_registry_report(spark):
    terms = [{"name": "a", "rmse": 1.0, "sources": ["current"]}, {"name": "b", "rmse": float("nan"), "sources": ["current", "stale"]}]
    report = g.gap_report(g.registry(spark, terms))
    assert "| b |" in report and "no value" in report and "| a |" not in report


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "srf.txt").write_text("header one\nwavelength response\n 6000.0 0.1\n 6100.5 1e-1\n")
    assert [tuple(r) for r in tables.read_response(spark, str(tmp_path / "srf.txt")).collect()] == [(6000.0, 0.1), (6100.5, 0.1)]
    paths = spark.createDataFrame([("/2023/246/ABI-C08_G16_s2023245.nc",), ("/x/CTH_G18_day12.nc",)], "path string")
    assert [tuple(r)[1:] for r in tables.catalogue(paths).collect()] == [("ABI", 8, "G16", 245), ("CTH", None, "G18", 12)]
    with pytest.raises(ValueError):
        tables.conform(paths, tables.PIXELS)
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "k int, v double")
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).filter(F.col("v").isNotNull()).count() == 1
    tables.write_table(df, str(tmp_path / "p"), ("k",))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
