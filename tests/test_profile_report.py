import json

from tablewash.operators import profile
from tablewash.plans.recipe import Recipe
from tablewash.plans.report import build_report, report_html, report_json, report_text_lines, save_report, summary_row


def _before(spark):
    """Water samples: two repeats of one row, two missing values."""
    return spark.createDataFrame(
        [("P-7", 6.8, 40, "weir"), ("P-7", 6.8, 40, "weir"), ("P-9", None, 12, "lock"), ("P-4", 7.1, None, "lock"), ("P-7", 6.8, 40, "weir")],
        "probe string, ph double, litres bigint, site string",
    )


def _after(spark):
    return spark.createDataFrame([("P-7", 6.8, 40), ("P-9", 6.9, 12), ("P-4", 7.1, 26)], "probe string, ph double, litres bigint")


def test_snapshot(spark):
    s = profile.snapshot(_before(spark)).first()
    assert s["rows"] == 5 and s["columns"] == 4 and s["duplicates"] == 2
    assert s["missing_values"] == {"probe": 0, "ph": 1, "litres": 1, "site": 0}
    assert s["column_types"] == {"probe": "string", "ph": "double", "litres": "bigint", "site": "string"}
    long = {(r["metric"], r["column_name"]): r["value"] for r in profile.snapshot_long(_before(spark)).collect()}
    assert long[("rows", "*")] == 5 and long[("missing", "litres")] == 1 and long[("duplicates", "*")] == 2


def test_missing_and_types(spark):
    m = {r["column_name"]: r["missing"] for r in profile.missing_by_column(_before(spark)).collect()}
    assert m == {"probe": 0, "ph": 1, "litres": 1, "site": 0}
    t = [tuple(r) for r in profile.column_types(_before(spark)).collect()]
    assert t == [("probe", 0, "string"), ("ph", 1, "double"), ("litres", 2, "bigint"), ("site", 3, "string")]


def test_report_summary(spark):
    r = Recipe().record("remove_duplicates", {"remove": "yes"})
    rep = build_report(_before(spark), _after(spark), r, "2026-01-01T00:00:00")
    s = summary_row(rep).first()
    assert s["rows_removed"] == 2 and s["columns_removed"] == 1
    assert s["missing_values_before"] == 2 and s["missing_values_after"] == 0
    assert s["duplicates_removed"] == 2
    doc = json.loads(report_json(rep).first()["json"])
    assert doc["pipeline_steps"] == [{"step": "remove_duplicates", "params": {"remove": "yes"}}]
    assert doc["before"]["rows"] == 5 and doc["summary"]["duplicates_removed"] == 2
    lines = [x["line"] for x in report_text_lines(rep).orderBy("line_no").collect()]
    assert lines[4] == "Rows:             5 → 3 (-2)"
    assert "  litres: bigint" in lines
    html = report_html(rep).first()["html"]
    assert "<td>Rows</td><td>5</td><td>3</td><td>-2</td>" in html


def test_report_html_escapes(spark):
    df = spark.createDataFrame([(1,)], "`<b>x</b>` bigint")
    rep = build_report(df, df, Recipe().record("x<y", {}), "t")
    html = report_html(rep).first()["html"]
    assert "<b>x</b>" not in html and "&lt;b&gt;x&lt;/b&gt;" in html and "x&lt;y" in html


def test_save_report(spark, tmp_path):
    rep = build_report(_before(spark), _after(spark), Recipe(), "t")
    for fmt, ext in (("json", ".json"), ("html", ".html"), ("text", ".txt"), ("other", ".txt")):
        p = save_report(rep, str(tmp_path / "r"), fmt)
        assert p.endswith(ext)
    assert json.loads(open(tmp_path / "r.json").read())["summary"]["rows_removed"] == 2


def test_preview(spark):
    assert profile.preview(_before(spark)).count() == 3
    assert profile.preview(_before(spark), 10).count() == 5
