"""Explicit schemas: nothing is inferred from data."""
from __future__ import annotations

from pyspark.sql import types as T



def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


S, I, L, D, B, DATE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType()

ITEM = _struct([("violation", S), ("major_violation", S), ("status", S), ("violation_accela", S)])
RAW_INSPECTION = _struct([("custom_id", S), ("inspection_id", S), ("type", S), ("score", S), ("grade", S), ("completed_date", S),
                          ("status", S), ("violations", T.ArrayType(ITEM))])
DOCUMENT = _struct([("business_id", S), ("name", S), ("business_type", S), ("address", S), ("city", S), ("zip", S), ("status", S),
                    ("lat", S), ("long", S), ("opened_date", S), ("inspections", T.ArrayType(RAW_INSPECTION)), ("_corrupt_record", S)])
PAGE = _struct([("total_count", I), ("result", T.ArrayType(_struct([(f.name, f.dataType) for f in DOCUMENT.fields[:-1]])))])

INSPECTION = _struct([
    ("business_id", S), ("business_type", S), ("zip", S), ("lat", D), ("lng", D), ("opened_date", DATE), ("inspection_id", S),
    ("insp_type", S), ("county_type", S), ("status", S), ("score", I), ("grade", S), ("completed_date", DATE), ("n_violations", I),
    ("n_major", I), ("n_minor", I), ("n_grp", I), ("closure", S), ("closure_order", S), ("closure_inferred", B)])

SHAPES = _struct([("features", T.ArrayType(_struct([
    ("properties", _struct([("JUR_NAME", S), ("DISTRICT", S)])),
    ("geometry", _struct([("type", S), ("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(D))))]))])))])

OPEN_CLOSURE = _struct([("date", S), ("reason", S), ("later_ungraded", T.ArrayType(S)), ("status", S)])
GRADE = _struct([("grade", S), ("score", I), ("date", S), ("replaced", _struct([("grade", S), ("score", I), ("date", S)])),
                 ("open_closure", OPEN_CLOSURE)])
INDEX = _struct([("facility_id", S), ("name", S), ("address", S), ("facility_type", S), ("council_district", I),
                 ("last_visit", _struct([("date", S), ("type", S), ("county_type", S)])), ("grade", GRADE), ("flags", T.ArrayType(S)),
                 ("points", I), ("band", S), ("on_hold", B), ("lon", D), ("lat", D)])
RECORD = _struct([("date", S), ("status", S), ("type", S), ("county_type", S), ("score", I), ("grade", S), ("major", I), ("minor", I),
                  ("grp", I), ("closed", B), ("closure", S), ("reopened", B), ("reopened_on", S), ("closure_inferred", B),
                  ("reopen_without_closure", B)])
USED = _struct([("date", S), ("score", I), ("closure", B), ("source_score", I)])
PLACE_FILE = _struct([("facility_id", S), ("inspections", T.ArrayType(RECORD)), ("scores_used", T.ArrayType(USED)), ("points", I)])
MANIFEST = "run string, attempt string, files long, ranking_sha256 string, meta_sha256 string, generated string"
