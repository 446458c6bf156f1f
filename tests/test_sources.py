"""Readers, writers and checks on small files."""
import gzip
import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fieldrounds import functions as fn
from fieldrounds.operators import checks as ck, clean
from fieldrounds.sources import adapt, readers, sinks


def item(status, text, major="N"):
    return {"status": status, "violation_accela": text, "major_violation": major}


DOCS = [{"business_id": "7", "name": " Cafe ", "business_type": "Restaurant Food Facility", "address": "1 Main St", "zip": "02139-1", "status": "", "lat": "x", "long": "1.5",
         "inspections": [
             {"inspection_id": "1", "custom_id": "P1", "type": "Routine", "status": "Complete", "score": "0", "grade": "a", "completed_date": "2024-01-05T00:00:00",
              "violations": [item("Out of Compliance - Minor", "7. Proper hot and cold holding temperatures", "Y"), item("Note", "No Valid Permit")]},
             {"inspection_id": "2", "custom_id": "", "type": "Routine", "status": "Complete", "score": "93.0", "grade": "A", "completed_date": "2024-01-05", "violations": []},
             {"inspection_id": "3", "type": "Routine", "status": "No Access", "completed_date": "2024-02-01", "violations": []},
             {"inspection_id": "4", "type": "Environmental", "status": "Self Closed", "completed_date": "2024-02-02", "violations": [item("Out of Compliance - Major", "23. No rodents, insects, birds")]},
             {"inspection_id": "5", "type": "Routine", "status": "Complete", "completed_date": "soon", "violations": None}]},
        {"business_id": "8", "name": "B", "inspections": None}]


@pytest.fixture()
def docs(spark, tmp_path):
    with gzip.open(tmp_path / "pull.json.gz", "wt") as fh:
        fh.write("\n".join(json.dumps(d) for d in DOCS))
    return readers.read_documents(spark, str(tmp_path))


def test_nested_documents(docs):
    r = {x.record_id: x for x in clean.records_from_documents(docs).collect()}
    assert [k for k, x in sorted(r.items()) if x.kept] == ["1", "2", "4"]
    assert r["1"].score is None and r["2"].score == 93 and r["1"].grade == "A"
    assert (r["1"].n_major, r["1"].items[0].theme, r["1"].items[0].code) == (1, "temperature", "7")
    assert r["1"].permit_note and r["4"].is_order and r["4"].items[0].theme == "vermin"
    v = {x.visit_type: x for x in clean.merge_same_day(clean.records_from_documents(docs).where("kept")).collect()}
    assert v["routine"].n_records == 2 and v["routine"].score == 93 and v["routine"].record_id == "1"
    drops = {(x.source_type, x.status): x.n for x in clean.drop_counts(clean.records_from_documents(docs)).collect()}
    assert drops == {("Routine", "No Access"): 1, ("Routine", "Complete"): 1}


def test_facility_dimension(docs):
    f = {x.business_id: x for x in readers.facilities(docs).collect()}
    assert (f["7"].facility_id, f["7"].name, f["8"].facility_id) == ("P1", "Cafe", "8")


def test_documents_round_trip(spark, tmp_path):
    adapt.documents(spark, SMALL).write.json(str(tmp_path / "docs"))
    got = clean.records_from_documents(readers.read_documents(spark, str(tmp_path / "docs")))
    want = adapt.records(spark, SMALL)
    cols = ["record_id", "day", "visit_type", "status", "n_major", "n_minor", "n_grp", "is_order", "is_reopen"]
    a = got.withColumn("record_id", F.col("record_id").cast("long")).select(cols)
    assert a.exceptAll(want.select(cols)).count() == 0 and want.select(cols).exceptAll(a).count() == 0


def test_flat_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text("business_id,zip,score,completed_date,n_major\n1,02139,x,2024-01-02,1\n2,92101,88.0,never,0\n3,92101,90,2024-03-04,\n")
    r = {x.business_id: x for x in readers.read_inspections(spark, str(tmp_path / "v.csv")).collect()}
    assert set(r) == {"1", "3"} and r["1"].zip == "02139" and r["1"].score is None and r["3"].score == 90 and r["3"].closure_order is None


def test_shapes(spark, tmp_path):
    ring = [[[0, 0], [1, 0], [1, 1], [0, 1]]]
    feats = [{"properties": {"JUR_NAME": j, "DISTRICT": d}, "geometry": {"type": "Polygon", "coordinates": ring}} for j, d in (("Town", "1"), ("Town", "2"), ("Other", "1"))]
    (tmp_path / "s.json").write_text(json.dumps({"features": feats}))
    assert readers.read_shapes(spark, str(tmp_path / "s.json"), "TOWN").count() == 2
    with pytest.raises(ValueError):
        (tmp_path / "t.json").write_text(json.dumps({"features": feats[1:]}))
        readers.read_shapes(spark, str(tmp_path / "t.json"), "town")


def test_archive_is_write_once_and_prunes(spark, tmp_path):
    path = str(tmp_path / "archive")
    new = spark.createDataFrame([("F1", 1, 5.0), ("F2", 0, 2.0)], "facility_id string, eligible int, points double")
    said = sinks.archive(new, "forward_2024-01-01", path, {"generated": "2024-01-02"})
    sinks.archive(new.drop("eligible"), "forward_2023-01-01", path)
    with pytest.raises(FileExistsError):
        sinks.archive(new, "forward_2024-01-01", path)
    assert readers.read_archive(spark, path).count() == 3
    assert readers.read_archive(spark, path, ["forward_2024-01-01"]).count() == 1
    assert said["generated"] == "2024-01-02" and sinks.verify_archive(spark, path, "forward_2024-01-01").count() == 0


def test_a_broken_off_archive_is_not_read_and_does_not_bar_the_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "archive")
    new = spark.createDataFrame([("F1", 1, 5.0)], "facility_id string, eligible int, points double")
    sinks.archive(new, "a", path)

    def broken(*_):
        raise OSError("lost")
    monkeypatch.setattr(sinks, "_create", broken)
    with pytest.raises(OSError):
        sinks.archive(new, "b", path)
    monkeypatch.undo()
    assert [r["run"] for r in readers.read_archive(spark, path).collect()] == ["a"]
    sinks.archive(new, "b", path)
    assert sorted(r["run"] for r in readers.read_archive(spark, path).collect()) == ["a", "b"]


def test_changes_to_an_archive_are_found(spark, tmp_path):
    path = str(tmp_path / "archive")
    said = sinks.archive(spark.range(9).selectExpr("cast(id AS string) AS facility_id", "1 AS eligible").coalesce(1), "a", path)
    part, = (tmp_path / "archive/rankings/run=a" / f"attempt={said['attempt']}").glob("part-*")
    for crc in (tmp_path / "archive").rglob(".*.crc"):        # the local file system's own checks
        crc.unlink()
    part.write_bytes(part.read_bytes() + b"x")
    assert [(r["problem"]) for r in sinks.verify_archive(spark, path, "a").collect()] == ["changed"]
    (tmp_path / "archive/meta" / f"a-{said['attempt']}.json").write_text('{"generated": "later"}')
    with pytest.raises(ValueError):
        sinks.verify_archive(spark, path, "a")


def test_export_card_and_frozen_copy(spark, tmp_path):
    ix = spark.createDataFrame([("F1", "A", "1 St", 9, "1", ["major"])], "facility_id string, name string, address string, points int, band string, flags array<string>")
    det = spark.createDataFrame([("F1", 9, [("2024-01-01", True, "health", "2024-01-03")], [(91, False)])],
                                "facility_id string, points int, inspections array<struct<date:string,closed:boolean,closure:string,reopened_on:string>>, scores_used array<struct<score:int,closure:boolean>>")
    sinks.write_export(ix, det, str(tmp_path / "site"))
    meta = {"inspections_through": "2024-06-30"}
    row = readers.read_card(spark, str(tmp_path / "site/index"), str(tmp_path / "site/place"), meta).first()
    assert (row.card_points, row.closures_24m, row.reopened_on) == (9, 1, "2024-01-03")
    held = spark.createDataFrame([("F1",)], "facility_id string")
    row = readers.read_card(spark, str(tmp_path / "site/index"), str(tmp_path / "site/place"), meta, held).first()
    assert row.card_points is None and row.held and row.closures_24m == 1
    with pytest.raises(ValueError):
        readers.read_card(spark, "x", "y", {"sample": True})
    with pytest.raises(ValueError):
        sinks.write_export(ix.withColumn("facility_id", F.lit("../x")), det, str(tmp_path / "bad"))
    (tmp_path / "frozen").mkdir()
    for n in ("a.csv", "b.csv"):
        (tmp_path / "frozen" / n).write_text(n)
    manifest = spark.createDataFrame(sinks.file_hashes(spark, str(tmp_path / "frozen")).collect())
    assert sinks.verify_files(spark, str(tmp_path / "frozen"), manifest).count() == 0
    (tmp_path / "frozen" / "a.csv").write_text("changed")
    (tmp_path / "frozen" / "b.csv").unlink()
    assert {(r.file, r.problem) for r in sinks.verify_files(spark, str(tmp_path / "frozen"), manifest).collect()} == {("a.csv", "changed"), ("b.csv", "missing")}


def test_month_and_flat_writers(spark, tmp_path):
    from fieldrounds.plans.lists import this_month
    from fieldrounds.plans.registry import Tables
    t = Tables(spark, SMALL)
    f = this_month(t).withColumnRenamed("mean_points", "mp").withColumn("name", F.lit("=cmd"))
    sinks.write_month(f, str(tmp_path / "wl"))
    back = spark.read.option("header", True).csv(str(tmp_path / "wl/lists"))
    assert back.count() == f.where("due_this_month").count() and back.where("name = \"'=cmd\"").count() == back.count()
    flat = sinks.flat_visits(t.visits, t.records, t.places)
    sinks.write_inspections(flat, str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).count() == t.visits.count() and len(flat.columns) == 20


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert sinks.fingerprint(a).first() == sinks.fingerprint(a.orderBy(F.desc("a")).select("b", "a")).first()
    assert sinks.fingerprint(a).first() != sinks.fingerprint(a.fillna("y")).first()


def test_scalar_edges(spark):
    d = spark.createDataFrame([("=1+1", "12"), ("-5", "x"), ("@a", None)], "t string, n string")
    assert [r[0] for r in d.select(fn.formula_safe(F.col("t"))).collect()] == ["'=1+1", "-5", "'@a"]
    assert [r[0] for r in d.select(fn.safe_int(F.col("n"))).collect()] == [12, None, None]
    toks = d.limit(1).select(fn.search_tokens(F.lit("Taco & Convoy St., 4th ave"))).first()[0]
    assert toks == ["taco", "convoy", "street", "4th", "avenue"]
    low, high = fn.wilson(F.lit(0), F.lit(0))
    assert tuple(d.limit(1).select(low, high).first()) == (None, None)


def test_public_gate(spark):
    bad = spark.createDataFrame([("a", 5)], "zip string, places long")
    with pytest.raises(ValueError, match="row-level column zip"):
        ck.require_public(bad)
    ck.require_public(spark.createDataFrame([("a", 50)], "type string, places long"))


def test_counts_of_documents_parse_no_text(spark):
    """Severities come from an item's status, so its text is parsed only where items are read."""
    docs = spark.createDataFrame([("1", [{"inspection_id": "9", "type": "Routine", "status": "Complete", "completed_date": "2024-01-02"}])],
                                 "business_id string, inspections array<struct<inspection_id:string,type:string,status:string,score:string,grade:string,"
                                 "completed_date:string,violations:array<struct<violation:string,major_violation:string,status:string,violation_accela:string>>>>")
    records = clean.records_from_documents(docs)
    counts = records.select("record_id", "n_major", "n_minor", "n_grp", "kept")
    assert counts.collect()[0][1:] == (0, 0, 0, True)
    assert "regexp_extract" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in records._jdf.queryExecution().optimizedPlan().toString()
