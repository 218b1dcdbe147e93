import json

from palimpsest import cli
from palimpsest.plans import report
from palimpsest.sources import relations as R

PROD = [["1 Setup", "Nevigate to the menu with the arrow keys.", "Clean the lamp with a soft dry cloth only."], ["2 Care", "Keep the unit away from heat and water."]]
STAGE = [["1 Setup", "Navigate to the menu with the arrow keys."], ["2 Care", "Keep the unit away from heat and water."], ["3 More", "Something that only this edition says."]]


def write(spark, folder, side, pages):
    spans = [(1, side, p, b, 0, 0, t, "Sans", 16.0 if b == 0 else 10.0, 0, 0, 72.0, 60.0 + 60.0 * b, 72.0 + 5 * len(t), 72.0 + 60.0 * b) for p, lines in enumerate(pages) for b, t in enumerate(lines)]
    schema = lambda name: R.SCHEMAS[name]
    spark.createDataFrame(spans, schema("spans")).write.parquet(f"{folder}/spans")
    spark.createDataFrame([(1, side, p, 612.0, 792.0) for p in range(len(pages))], schema("pages")).write.parquet(f"{folder}/pages")
    spark.createDataFrame([(1, side, n, 1, lines[0], n, 732.0) for n, lines in enumerate(pages)], schema("outline")).write.parquet(f"{folder}/outline")
    return folder


def test_a_pair_is_compared_from_relations_to_the_report(spark, tmp_path, capsys):
    prod, stage, out = write(spark, f"{tmp_path}/p", "prod", PROD), write(spark, f"{tmp_path}/s", "stage", STAGE), f"{tmp_path}/out"
    found = report.compare(report.read_relations(spark, prod, stage))
    said = {(r.message, r.section, r.details.get("expected"), r.details.get("actual")) for r in found["issues"].collect()}
    assert ("Missing text", "1 Setup", PROD[0][2], None) in said and ("Changed text", "1 Setup", PROD[0][1], STAGE[0][1]) in said
    assert any(m == "Section added" for m, *_ in said) and any(m == "Page count mismatch" for m, *_ in said)
    assert not any(PROD[1][1] in (e or "") for _, _, e, _ in said)
    assert {(r.title, r.status) for r in found["toc"].collect()} == {("1 Setup", "Matched"), ("2 Care", "Matched"), ("3 More", "Extra")}
    told = []
    assert cli.run(spark, prod, stage, out, ("json", "toc", "html", "rows", "unknown"), lambda p, w: told.append(p) or 1 / 0) is False and told[-1] == 100
    (doc,) = [json.loads(line) for line in "".join(p.read_text() for p in (tmp_path / "out/report.json").glob("*.json")).splitlines()]
    checks = {c["name"]: c for c in doc["checks"]}
    assert doc["passed"] is False and checks["Content"]["passed"] is False and checks["Pages"]["passed"] is True and checks["Content"]["summary_title"] == "Sections"
    assert {m["message"] for m in checks["Content"]["message_counts"]} >= {"Missing text", "Changed text"} and doc["expected_path"] == prod
    (page,) = [r.html for r in spark.read.json(f"{out}/pages").collect()]
    assert "FAIL" in page and "Missing text (page 1)" in page


def test_the_same_edition_passes_and_a_missing_one_is_told(spark, tmp_path, capsys):
    prod, stage = write(spark, f"{tmp_path}/p", "prod", PROD), write(spark, f"{tmp_path}/s", "stage", PROD)
    assert cli.main([prod, stage, "-o", f"{tmp_path}/out"]) == 0 and "PASS" in capsys.readouterr().out
    assert cli.main([prod, f"{tmp_path}/none", "-o", f"{tmp_path}/out2"]) == 2 and "not found" in capsys.readouterr().err


def test_reading_plan_and_crops(spark):
    pages = spark.createDataFrame([(1, "prod", p, p == 3, "かな text") for p in range(5)], "pair_id int, side string, page int, scanned boolean, sample string")
    plan = R.reading_plan(pages, most=2).collect()
    assert [(r.page, r.languages, r.dpi) for r in plan] == [(3, "jpn+eng", 200), (0, "jpn+eng", 200)]
    box = spark.createDataFrame([(1, "prod", 0, 10.0, 50.0, 600.0, 80.0)], "pair_id int, side string, page int, x0 double, y0 double, x1 double, y1 double")
    size = spark.createDataFrame([(1, "prod", 0, 612.0, 792.0)], "pair_id int, side string, page int, width double, height double")
    assert tuple(R.crop_boxes(box, size).first())[3:] == (0.0, 26.0, 612.0, 104.0)
