import pytest
from pyspark.sql import functions as F

from spanweave.operators import impute

CODES = {"kind": {"a": "a", "apple": "a", "b": "b", "bean": "b"}, "hue": {"r": "r", "g": "g"}}
SCHEMA = "id long, lot string, kind string, hue string, size double, day timestamp, value string, prediction double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "id long, lot string, kind string, hue string, size double, day string, value string, prediction double").withColumn("day", F.to_timestamp("day"))


def fill(df):
    return {(r["id"], r["field"]): r for r in impute.fill_log(df, "id", ["kind", "size"], ["hue"], CODES, "lot", "day").collect()}


def test_donors_come_from_the_lot(spark):
    rows = [(i, f"L{i % 2}", "a" if i % 2 else " Bean ", "r" if i % 2 else "g", float(i), "2024-01-01") for i in range(20)]
    rows += [(100, "L0", None, "g", None, "2024-01-01"), (101, "L1", "?", None, float("nan"), None), (102, None, "", "g", 1.0, "2024-01-01"), (103, "alone", "unknown", None, 1.0, None)]
    df = table(spark, [*rows, rows[-1], (None, "L0", None, "g", 1.0, None)])
    log = fill(df)
    assert set(log) == {(100, "kind"), (100, "size"), (101, "kind"), (101, "size"), (102, "kind"), (103, "kind")}
    assert log[100, "kind"]["value"] == "b" and log[100, "kind"]["donor_group"] == "group" and log[100, "kind"]["donor_id"] % 2 == 0
    assert log[101, "kind"]["value"] == "a" and float(log[101, "size"]["value"]) % 2 == 1
    assert log[102, "kind"]["donor_group"] == "day" and log[103, "kind"]["donor_group"] == "all"
    out = {r["id"]: r for r in impute.fill_missing(df, "id", ["kind", "size"], ["hue"], CODES, "lot", "day").collect()}
    assert len(out) == 24 and out[0]["kind"] == "b" and not out[0]["kind_filled"] and out[0]["kind_donor"] is None
    assert out[100]["kind_filled"] and out[100]["kind"] == "b" and out[100]["size"] == float(log[100, "size"]["value"])


def test_nothing_to_learn_from(spark):
    df = table(spark, [(1, None, None, None, None, None), (2, "L", "?", "r", None, None)])
    log = fill(df)
    assert len(log) == 4 and all(r["value"] is None and r["donor_id"] is None for r in log.values())
    assert impute.fill_log(df.limit(0), "id", ["kind"], ["hue"], CODES, "lot", "day").count() == 0
    out = impute.fill_missing(df, "id", ["kind"], ["hue"], CODES).collect()
    assert len(out) == 2 and not any(r["kind_filled"] for r in out)


def test_held_out_accuracy(spark, data):
    rows = spark.read.parquet(data.replace("0.001", "0.01") + "/mushroom.parquet").dropDuplicates(["mushroom_id"])
    codes = impute.code_tables(spark.read.parquet(data + "/mushroom_codes.parquet"))
    known = rows.withColumn("truth", impute.canonical_code("odor", codes["odor"]))
    hidden = known.withColumn("odor", F.when(F.pmod(F.xxhash64("mushroom_id"), F.lit(5)) == 0, None).otherwise(F.col("odor")))
    predictors = [c for c in rows.columns if c in codes and c not in ("odor", "stalk_root")]
    log = impute.fill_log(hidden, "mushroom_id", ["odor"], predictors, codes, "lot_id", "collected_at").where("donor_group = 'group'")
    scored = log.join(known.select(F.col("mushroom_id").alias("id"), "truth").where("truth is not null"), "id")
    assert scored.select(F.avg((F.col("value") == F.col("truth")).cast("int"))).first()[0] > 0.7
    # a donor is of the same lot and holds the value it gives
    donors = known.select(F.col("mushroom_id").alias("donor_id"), F.col("truth").alias("given"), F.col("lot_id").alias("from_lot"))
    lots = known.select(F.col("mushroom_id").alias("id"), "lot_id")
    assert log.join(donors, "donor_id").join(lots, "id").where("given <> value or from_lot <> lot_id").count() == 0


def test_code_tables(spark):
    codes = spark.createDataFrame([("f", "a", "Almond"), ("f", "b", None), (None, "x", "y")], "field_name string, code string, meaning string")
    assert impute.code_tables(codes) == {"f": {"a": "a", "almond": "a", "b": "b"}}
    got = spark.createDataFrame([(" ALMOND\t",), ("b",), ("?",), (None,), ("",)], "f string").select(impute.canonical_code("f", {"a": "a", "almond": "a", "b": "b"})).collect()
    assert [r[0] for r in got] == ["a", "b", None, None, None]


def test_donors_are_the_nearest_of_all(spark):
    rows = [(1000 * lot + i, f"L{lot}", "a", "r", float(i + 37 * lot * lot), f"2024-01-0{1 + lot % 2}") for lot in range(4) for i in range(150 + 50 * lot)]
    need = [(10_000 + i, lot, "a", "r", None, day) for i, (lot, day) in enumerate([(f"L{i % 4}", "2024-01-01") for i in range(40)] + [(None, "2024-01-02"), ("alone", "2024-01-01"), (None, None)] * 5)]
    log = {r["id"]: r for r in impute.fill_log(table(spark, rows + need), "id", ["size"], ["hue"], CODES, "lot", "day").collect()}
    assert set(log) == {r[0] for r in need}
    mean = sum(r[4] for r in rows) / len(rows)
    sd = (sum(r[4] ** 2 for r in rows) / len(rows) - mean**2) ** 0.5
    z = {r[0]: (r[4] - mean) / sd for r in rows}
    total = {f"L{lot}": (sum(z[r[0]] for r in rows if r[1] == f"L{lot}"), 150 + 50 * lot) for lot in range(4)}
    own = {r[0]: (total[r[1]][0] - z[r[0]]) / total[r[1]][1] for r in rows}  # all rows have one predictor level: the prediction is linear in this mean
    for i, lot, _, _, _, day in need:
        pool, name = ([r[0] for r in rows if r[1] == lot], "group") if lot in total else ([r[0] for r in rows if r[5] == day], "day") if day else (list(own), "all")
        at = total[lot][0] / (total[lot][1] + 1) if lot in total else 0.0
        third = sorted(abs(own[j] - at) for j in pool)[2]
        assert log[i]["donor_group"] == name and log[i]["donor_id"] in pool
        assert abs(own[log[i]["donor_id"]] - at) <= third + 1e-9
