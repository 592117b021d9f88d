import datetime as dt
import math
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift, links, pii, quality, states, stats, topk
from plumbline.plans import document, incremental, oracle, queries
from plumbline.plans.profile import column_profiles, profile_table, run_profile
from plumbline.sources import history, tables

ROWS = [
    (1, "Alice", "100.50", 10, 1), (2, "Bob", "25.00", 0, 2), (3, "Alice", "-10.25", -5, 3), (4, "", "0.00", 0, 4), (5, "   ", "50.75", 20, 5),
    (6, None, None, None, None), (7, "Bob", "25.00", 10, 7), (8, "Carol", "999.99", 30, 8), (9, "Carol", "0.00", 0, 9), (10, None, "-1.50", -10, 10),
]


def as_of():
    return F.lit("2026-06-01").cast("timestamp_ntz")


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [(i, n, a, s, None if d is None else dt.datetime(2026, 1, d, d + 9)) for i, n, a, s, d in ROWS]
    df = spark.createDataFrame(rows, "id int, name string, amount string, score int, created_at timestamp_ntz")
    return df.withColumn("amount", F.col("amount").cast("decimal(12,2)"))


@pytest.fixture(scope="module")
def profile(dirty):
    return {r["column_name"]: r for r in column_profiles(dirty, as_of=as_of()).collect()}


def test_dirty_fixture(profile):
    name, amount, score, made, key = (profile[c] for c in ("name", "amount", "score", "created_at", "id"))
    assert (name["null_count"], name["empty_count"], name["whitespace_count"], name["distinct_count"]) == (2, 1, 1, 5)
    assert (name["min_length"], name["max_length"], name["avg_length"]) == (0, 5, 3.625)
    assert name["entropy"] == pytest.approx(2.25) and name["normalized_entropy"] == pytest.approx(0.969022, abs=1e-6)
    assert (amount["null_count"], amount["zero_count"], amount["min"], amount["max"], amount["distinct_count"]) == (1, 2, "-10.25", "999.99", 7)
    assert [amount[c] for c in ("avg", "sum", "stddev", "variance", "skewness", "kurtosis")] == pytest.approx([132.165556, 1189.49, 308.545606, 95200.390936, 2.423367, 3.973788], rel=1e-6)
    assert [amount[c] for c in ("p50", "p75", "p90", "p95", "p99")] == pytest.approx([25, 50.75, 280.398, 640.194, 928.0308])
    assert [key[c] for c in ("p50", "p75", "p90", "p95", "p99")] == pytest.approx([5.5, 7.75, 9.1, 9.55, 9.91])
    assert (score["zero_count"], score["distinct_count"], score["outlier_count"]) == (3, 6, 0)
    assert (made["date_range_days"], made["future_date_count"], made["distinct_count"]) == (9.375, 0, 9)
    assert (name["pii"], name["pii_confidence"]) == ("person_name", 0.65)
    assert all(profile[c]["pii"] == "" for c in ("id", "amount", "score", "created_at"))


def test_dirty_parts(dirty):
    base = stats.column_stats(dirty)
    bins = {(r["column_name"], r["bin"]): r["count"] for r in stats.histogram(dirty, base).collect()}
    assert {b: n for (c, b), n in bins.items() if c == "amount"} == {0: 7, 1: 1, 9: 1}
    assert {b: n for (c, b), n in bins.items() if c == "score"} == {0: 1, 1: 1, 2: 3, 5: 2, 7: 1, 9: 1}
    patterns = {r["pattern"]: r["count"] for r in stats.string_patterns(dirty).collect()}
    assert patterns == {"alphabetic": 6, "symbolic": 1, "mixed": 1}
    months = [(r["period"], r["count"], r["percentage"]) for r in stats.date_distribution(dirty).collect()]
    assert months == [("2026-01", 9, 90.0)]
    corr = {(r[0], r[1]): r[2] for r in stats.correlations(dirty).collect()}
    assert corr == pytest.approx({("id", "amount"): 0.245112, ("id", "score"): 0.017066, ("amount", "score"): 0.754313}, abs=1e-6)
    assert stats.duplicate_rows(dirty).first()["duplicate_rows"] == 0
    checked = quality.checks(column_profiles(dirty, as_of=as_of()), stats.duplicate_rows(dirty))
    assert quality.score(checked).first()["score"] == 95


def test_edges(spark):
    df = spark.createDataFrame([(None, 0.1, "a\n"), (None, 0.1, "a\n"), (None, 0.1, None)], "n int, c double, t string")
    p = {r["column_name"]: r for r in column_profiles(df, as_of=as_of()).collect()}
    assert p["n"]["distinct_count"] == 0 and p["n"]["avg"] is None and p["n"]["p50"] is None
    assert p["c"]["outlier_count"] == 0 and p["c"]["skewness"] is None and p["c"]["p99"] == pytest.approx(0.1)
    assert [r["count"] for r in stats.histogram(df, stats.column_stats(df), ["c"]).collect()] == [3]
    assert stats.duplicate_rows(df).first()["duplicate_rows"] == 1
    assert stats.correlations(df).count() == 0
    empty = df.limit(0)
    assert all(r["total_rows"] == 0 and r["null_percentage"] == 0 for r in column_profiles(empty, as_of=as_of()).collect())
    zeros = spark.createDataFrame([(-0.0,), (0.0,), (float("nan"),)], "z double")
    assert stats.distinct_counts(stats.value_freq(zeros)).first()["distinct_count"] == 2
    assert sum(r["count"] for r in stats.string_patterns(df).collect()) == 2


def test_partitioning_does_not_matter(dirty):
    one = sorted(map(str, column_profiles(dirty.coalesce(1), as_of=as_of()).drop("stddev", "variance").collect()))
    many = column_profiles(dirty.repartition(7), as_of=as_of()).collect()
    assert len(one) == len(many) and all(math.isclose(r["p90"], 280.398) for r in many if r["column_name"] == "amount")


def _detect(spark, name, values):
    cols = spark.createDataFrame([(name,)], "column_name string")
    return pii.detect(cols, spark.createDataFrame([(name, v, n) for v, n in values], "column_name string, value string, count long")).first()


def test_pii(spark):
    assert _detect(spark, "contact", [("a@b.com", 8), ("c@d.org", 2)])["pii_confidence"] == 0.9
    r = _detect(spark, "email", [("a@b.com", 1), ("c@d.org", 1), ("e@f.net", 1), ("b@. test.com", 1)])
    assert (r["pii"], r["pii_confidence"]) == ("email", 0.85)
    assert _detect(spark, "host", [("999.1.1.1", 1)])["pii"] == ""
    assert _detect(spark, "host", [("192.168.1.10", 1)])["pii"] == "ip_address"
    assert _detect(spark, "payment_value", [("4111 1111 1111 1111", 1)])["pii"] == "credit_card"
    assert _detect(spark, "customer_id", [("12", 1)])["pii"] == ""


def _snapshots(spark, a, b):
    cols = "schema_name string, table_name string, snapshot_id string, column_name string, data_type string, nullable boolean, distinct_count long, null_percentage double, distinct_percentage double, outlier_percentage double, pii string"
    rows = [("s", "t", sid, n, t, True, d, 0.0, 0.0, 0.0, "") for sid, x in (("1", a[0]), ("2", b[0])) for n, t, d in x]
    tab = spark.createDataFrame([("s", "t", "1", dt.datetime(2026, 1, 1), a[1], 0), ("s", "t", "2", dt.datetime(2026, 1, 2), b[1], 0)], "schema_name string, table_name string, snapshot_id string, created_at timestamp_ntz, score double, duplicate_rows long")
    c = drift.changes(spark.createDataFrame(rows, cols), tab)
    return c.collect(), drift.reports(c, tab).collect()


def test_drift(spark):
    changes, report = _snapshots(spark, ([("a", "int", 1), ("b", "int", 1)], 98.0), ([("a", "bigint", 1), ("c", "int", 1)], 78.0))
    assert sorted(r["kind"] for r in changes) == ["added", "removed", "score", "type"]
    assert report[0]["column_changes"] == ["quality score changed: 98.00 -> 78.00", "removed: b", "type changed: a (int -> bigint)", "added: c"]
    assert report[0]["score_delta"] == -20
    changes, report = _snapshots(spark, ([("a", "int", 1)], 98.0), ([("a", "int", 1)], 98.0))
    assert not changes and (report[0]["changed"], report[0]["score_delta"], report[0]["column_changes"]) == (False, 0, [])


def test_run_drift_shows_numbers_of_any_size(spark, monkeypatch):
    """As DuckDB casts them: no powers of ten."""
    values = ["6.0E-4", "1.0E-4", "5.55E-4", "2.0E7", "1.23456789125E8", "900000", "12345678", "1234567890123", "45.4551", "33.33", "100.0", "0.0", "0", "-7.5E-4"]
    texts_ = ["bigint", "true", "", None]
    rows = [(str(i), "k", "low", v, w) for i, (v, w) in enumerate(zip([*values, *texts_], [*values[::-1], *texts_[::-1]], strict=True))]
    changed = spark.createDataFrame(rows, "column_name string, kind string, severity string, old_value string, new_value string")
    monkeypatch.setattr(queries, "_runs", lambda *_: (None, changed))
    in_sql = {v: duckdb.sql(f"SELECT CAST(round(CAST('{v}' AS DOUBLE), 4) AS VARCHAR)").fetchall()[0][0] for v in values}
    want = [(n, k, s, in_sql.get(v, v), in_sql.get(w, w)) for n, k, s, v, w in rows]
    assert sorted(map(tuple, queries.run_drift(spark, "").collect())) == sorted(want)


def test_store(spark, dirty, tmp_path):
    path = str(tmp_path / "h")
    for i, df in enumerate((dirty, dirty.drop("score"))):
        checked, changes = run_profile(df, "s", "t", str(i), F.lit(dt.datetime(2026, 6, 1 + i)), path)
        assert checked.count() > 5
        assert [r["text"] for r in changes.collect()] == ([] if i == 0 else ["removed: score"])
    t = history.load(spark, f"{path}/tables")
    assert history.latest(t).first()["snapshot_id"] in ("1", 1)
    assert history.history(t, 500).count() == 2
    assert history.from_json(history.to_json(t), t).count() == 2


def test_links_and_samples(spark, dirty):
    parent = spark.createDataFrame([(i,) for i in range(1, 6)], "pk int")
    r = links.check_link(dirty, "id", parent, "pk").first()
    assert (r["filled_rows"], r["orphan_rows"], r["match_percentage"]) == (10, 5, 50.0)
    found = links.discover_links({"p": parent, "d": dirty.select("id")}).collect()
    assert [(x[0], x[1], x[2], x[3]) for x in found] == [("p", "pk", "d", "id")]
    assert tables.sample_rows(dirty, 5, 10).count() <= 5 and tables.sample_rows(dirty, 0, 10).count() == 10
    assert sorted(tables.keyed_sample(dirty.repartition(3), ["id"], 0.5).select("id").collect()) == sorted(tables.keyed_sample(dirty, ["id"], 0.5).select("id").collect())
    with pytest.raises(ValueError):
        tables.open_table(spark, "snowflake", "x")


def test_merged_variance_of_large_numbers(spark):
    """Deviations survive a large mean; empty parts and parts of one row count."""
    df = spark.createDataFrame([("a", 1e9 + 1), ("b", 1e9 + 2), ("b", 1e9 + 3), ("c", None)], "part string, v double")
    m = states.merge_states(states.partial_states(df, ["part"])).first()
    assert (m["total_rows"], m["null_count"], m["avg"], m["min_num"]) == (4, 1, 1e9 + 2, 1e9 + 1) and m["variance"] == pytest.approx(2 / 3)
    none = states.merge_states(states.partial_states(df.where("v is null"), ["part"])).first()
    assert none["variance"] is None and none["total_rows"] == 1


def test_long_top_values_are_texts(spark):
    long = "x" * 300
    df = spark.createDataFrame([(long, "a"), (long, "b"), ("short", None)], "t string, u string")
    base = stats.column_stats(df)
    top = {(r["column_name"], r["rank"]): (r["value"], r["count"]) for r in stats.top_values(stats.value_freq(df), base, df).collect()}
    assert top == {("t", 1): (long, 2), ("t", 2): ("short", 1), ("u", 1): ("a", 1), ("u", 2): ("b", 1)}


def test_metric_groups(spark, dirty):
    counts = {r["column_name"]: r for r in stats.column_stats(dirty, groups=()).collect()}
    assert (counts["name"]["null_count"], counts["name"]["empty_count"], counts["amount"]["avg"], counts["created_at"]["max"]) == (2, 0, None, None)
    some = {r["column_name"]: r for r in stats.column_stats(dirty, groups=("numeric",)).collect()}
    assert some["score"]["sum"] == 55 and some["score"]["skewness"] is None


def test_keyed_sample_and_sizes(spark):
    df = spark.range(10_000)
    one = {r["id"] for r in tables.keyed_sample(df, ["id"], 0.1).collect()}
    assert one == {r["id"] for r in tables.keyed_sample(df.repartition(7), ["id"], 0.1).collect()} and 800 < len(one) < 1200
    assert {r["id"] for r in tables.keyed_sample(df, [], 0.25, F.col("id") * 1000).collect()} == {i for i in range(10_000) if i * 1000 % 1_000_000 < 250_000}
    assert 0 < tables.sample_rows(df, 500, 10_000).count() <= 500 and tables.sample_rows(df, 0, 10_000).count() == 10_000


def test_rules_out_of_range_fall_back():
    rules = quality.QualityRules(max_null=-1, high_cardinality=101, dominant_value=50)
    assert [rules.threshold(n) for n in ("max_null", "high_cardinality", "dominant_value")] == [20, 95, 50]


def test_every_kind_of_drift(spark):
    """The registered query shows each kind at least once."""
    from plumbline.plans import queries

    got = {r["kind"] for r in queries.run_drift(spark, "/root/testdata/sf0.001").collect()}
    assert got == set(drift.KINDS)


def test_declared_links(spark):
    rows = links.declared_links([("customer_id", "public", "customers", "id")], spark).collect()
    assert [tuple(r) for r in rows] == [("customer_id", "public", "customers", "id", "foreign_key")]


ODD = {
    "no_dates": ([(1, "a"), (2, None)], "n int, t string"),
    "no_numbers": ([("a",), ("b",), (None,)], "t string"),
    "no_texts": ([(1, dt.datetime(2026, 1, 1)), (2, None)], "n int, d timestamp_ntz"),
    "only_dates": ([(dt.date(2026, 1, 1),), (dt.date(2026, 1, 1),)], "d date"),
    "only_flags": ([(True,), (None,)], "b boolean"),
    "dotted": ([(1.5, "x", dt.datetime(2026, 1, 1), 3), (2.5, "", None, 4)], "`a.b` double, `c.d` string, `e f.g` timestamp_ntz, `h``i` int"),
    "maps": ([({"a": 1, "b": 2}, [{"k": 1.0}], 1), ({"b": 2, "a": 1}, [{"k": 1.0}], 1), (None, None, 1)], "m map<string,int>, l array<map<string,double>>, n int"),
    "structs": ([((1, {"x": "y"}), bytearray(b"z")), ((1, {"x": "y"}), bytearray(b"z"))], "s struct<a:int,m:map<string,string>>, b binary"),
    "empty": ([], "n int, t string, d date"),
    "not_a_number": ([(float("nan"),), (float("inf"),), (1.0,), (3.0,)], "x double"),
}


@pytest.mark.parametrize("name", ODD)
@pytest.mark.parametrize("tier", ["basic", "deep"])
def test_every_table_has_a_profile(spark, name, tier):
    rows, schema = ODD[name]
    df = spark.createDataFrame(rows, schema)
    p = profile_table(df, as_of=as_of(), tier=tier)
    found = {r["column_name"]: r for r in p.columns.collect()}
    assert list(found) and set(found) == set(df.columns) and all(r["total_rows"] == len(rows) for r in found.values())
    every = {n: part.collect() for n, part in p.parts().items()}
    families = {r["column_name"]: r["family"] for r in found.values()}
    for part, family in (("patterns", "text"), ("histograms", "numeric"), ("dates", "datetime")):
        assert {r["column_name"] for r in every[part]} == {c for c, f in families.items() if f == family and found[c]["null_count"] < len(rows)}
    if name == "dotted":
        assert (found["a.b"]["variance"], found["c.d"]["empty_count"], found["h`i"]["sum"]) == (0.25, 1, 7)
    if name == "maps":
        assert every["duplicates"][0]["duplicate_rows"] == 1 and found["m"]["distinct_count"] == 1
        assert stats.duplicate_rows(df, fingerprint=True).first()["duplicate_rows"] == 1
    if name == "structs":
        assert every["duplicates"][0]["duplicate_rows"] == 1
    if name == "not_a_number":
        assert sorted((r["bin"], r["lower"], r["upper"], r["count"]) for r in every["histograms"]) == [(0, 1.0, 1.2, 1), (9, 2.8, 3.0, 1)]


def test_grouped_percentiles_are_exact(spark):
    rows = [(g, i * i % 97 / 7) for g, n in (("a", 500), ("b", 3), (None, 40)) for i in range(n)] + [("c", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: [r[p] for p in ("p50", "p75", "p90", "p95", "p99")] for r in stats.percentiles(df, by=["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, found in got.items():
        v = sorted(x for k, x in rows if k == g and x is not None and x == x)
        for p, x in zip(stats.PERCENTILES, found, strict=True):
            at = p * (len(v) - 1)
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            assert x == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))
    whole = {r["g"]: r["p90"] for r in column_profiles(df, by=["g"], as_of=as_of()).collect()}
    assert whole["a"] == pytest.approx(got["a"][2]) and whole[None] == pytest.approx(got[None][2])


def test_long_texts_have_shapes(spark):
    """A text of over 256 characters counts by itself, not by its digest."""
    mail = "x" * 300 + "@example.com"
    values = stats.texts(spark.createDataFrame([(mail,), ("n/a",)], "contact string"))
    ratios = {r["label"]: r["ratio"] for r in pii.value_ratios(values.select("column_name", F.col("v").alias("value"), F.lit(1).alias("count"))).collect()}
    assert ratios["email"] == 0.5 and ratios["uuid"] == 0


def test_exact_sample(spark):
    rows = [(i, i % 3, "x") for i in range(5000)] + [(7, 1, "same")] * 40
    df = spark.createDataFrame(rows, "id int, k int, t string")
    for n in (1, 7, 100, 4999, 5039, 5040, 9000):
        one = sorted(tables.exact_sample(df, n).collect())
        assert len(one) == min(n, len(rows))
        assert one == sorted(tables.exact_sample(df.repartition(7), n).collect())
    assert set(tables.exact_sample(df, 50).collect()) <= set(tables.exact_sample(df, 60).collect())
    by_key = sorted(tables.exact_sample(df, 1000, ["k"]).collect())
    assert len(by_key) == 1000 and by_key == sorted(tables.exact_sample(df.repartition(3), 1000, ["k"]).collect())
    same = spark.createDataFrame([("a",)] * 50, "t string")
    assert tables.exact_sample(same, 20).count() == 20 and tables.exact_sample(same.limit(0), 5).count() == 0


def test_sampled_profile(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as string) as t")
    p = profile_table(df, sample=100, as_of=as_of())
    assert (p.total_rows, p.sampled, p.rows.count()) == (1000, True, 100)
    assert {r["total_rows"] for r in p.columns.collect()} == {100}
    assert not profile_table(df, sample=1000, as_of=as_of()).sampled


def test_snapshots_appear_whole_and_once(spark, dirty, tmp_path):
    path = str(tmp_path / "h")
    made = F.lit(dt.datetime(2026, 6, 1))
    p = profile_table(dirty, as_of=as_of())
    history.stage({"columns": p.columns, "top_values": p.top_values}, path, "s", "t", "1", made)  # and a crash
    assert history.manifest(spark, path).count() == 0 and history.load_part(spark, path, "columns").count() == 0
    first = run_profile(dirty, "s", "t", "1", made, path, sample=4)
    again = run_profile(dirty, "s", "t", "1", made, path, sample=4)
    for a, b in zip(first, again, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert history.load_part(spark, path, "columns").count() == 5
    table = history.load_part(spark, path, "tables").collect()
    assert [(r["total_rows"], r["profiled_rows"], r["sampled"], r["sample_size"]) for r in table] == [(10, 4, True, 4)]
    # two attempts that both end: one is seen
    for _ in range(2):
        attempt = history.stage({"columns": p.columns, "tables": history.load_part(spark, path, "tables").drop(*history._SNAPSHOT, "created_at")}, path, "s", "t", "2", made)
        history.publish(spark, path, "s", "t", "2", attempt)
    assert history.load_part(spark, path, "columns").where("snapshot_id = '2'").count() == 5
    assert history.load_part(spark, path, "tables").count() == 2


def test_documents_hold_a_whole_profile(spark, dirty, tmp_path):
    path = str(tmp_path / "h")
    known = links.declared_links([("id", "s", "other", "key")], spark)
    for i, df in enumerate((dirty, dirty.select("score"))):
        run_profile(df, "s", "t", str(i), F.lit(dt.datetime(2026, 6, 1 + i)), path, relationships=known)
    names = ("columns", "tables", *document.PER_COLUMN, *document.PER_TABLE)
    parts = {n: history.load_part(spark, path, n) for n in names}
    parts["drift"] = drift.reports(drift.changes(parts["columns"], parts["tables"]), parts["tables"])
    docs = document.documents(parts)
    assert docs.count() == 2
    back = document.parsed(docs, document.document_schema(parts))
    assert [c for c in back["drift"].first()["column_changes"] if c.startswith("removed")] == [f"removed: {c}" for c in ("amount", "created_at", "id", "name")]
    for n in (*names, "drift"):
        one, two = ([tuple(str(r[c]) for c in sorted(parts[n].columns)) for r in x.collect()] for x in (parts[n], back[n]))
        assert sorted(one) == sorted(two), n


def test_incremental_profile(spark, tmp_path):
    table, path = str(tmp_path / "t"), str(tmp_path / "h")
    rows = [(d, i * 1.5 + d, f"u{i % 7}" if i % 5 else None, dt.datetime(2026, 1, 1 + d, i % 24)) for d in range(4) for i in range(100)]
    df = spark.createDataFrame(rows, "day int, v double, t string, at timestamp")
    df.write.partitionBy("day").parquet(table)
    read = lambda: spark.read.parquet(table)

    def check(run, parts_read, rows_read, parts):
        assert (run.parts_read, run.rows_read, run.parts) == (parts_read, rows_read, parts)
        got = {r["column_name"]: r for r in run.columns.collect()}
        want = {r["column_name"]: r for r in column_profiles(read().drop("day"), as_of=as_of()).collect()}
        assert set(got) == set(want) == {"v", "t", "at"}
        for c, w in want.items():
            for f in ("total_rows", "null_count", "avg", "sum", "variance", "stddev", "skewness", "kurtosis", "min_num", "max_num"):
                assert got[c][f] == (w[f] if w[f] is None else pytest.approx(w[f])), (c, f)
            assert got[c]["approx_distinct_count"] == pytest.approx(w["distinct_count"], rel=0.05)
        assert (got["t"]["min_length"], got["t"]["empty_count"], str(got["at"]["min_ts"])) == (2, 0, want["at"]["min"])
        assert got["v"]["p90"] == pytest.approx(want["v"]["p90"], rel=0.05)

    check(incremental.profile(read(), ["day"], path, "t"), 4, 400, 4)
    check(incremental.profile(read(), ["day"], path, "t"), 0, 0, 4)
    df.where("day = 2").limit(30).withColumn("v", F.col("v") + 1000).drop("day").write.mode("append").parquet(f"{table}/day=2")
    check(incremental.profile(read(), ["day"], path, "t"), 1, 130, 4)
    spark.createDataFrame([(1.0, "new", dt.datetime(2026, 2, 1))], "v double, t string, at timestamp").write.parquet(f"{table}/day=9")
    shutil.rmtree(f"{table}/day=0")
    check(incremental.profile(read(), ["day"], path, "t"), 1, 1, 4)


def test_sketched_percentiles(spark):
    df = spark.range(20_000).selectExpr("cast(id % 5000 as double) as v", "pmod(hash(id), 1000) * 1.0 as w", "id % 50 as part")
    merged = states.merge_states(states.partial_states(df, ["part"]))
    errors = states.rank_errors(df.drop("part"), merged).collect()
    assert len(errors) == 10 and all(r["rank_error"] <= states.RANK_ERROR for r in errors)


def test_heavy_hitters(spark):
    rows = [("hot" if i % 3 == 0 else f"w{i % 40}" if i % 3 == 1 else f"r{i}", i % 4, "y" * 300 if i % 2 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "t string, k int, long string")
    want = [tuple(r) for r in stats.top_values(stats.value_freq(df), stats.column_stats(df), df).collect()]
    got = topk.heavy_hitters(df, exact=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted((c, k, v, n, p) for c, k, v, n, p in want)
    assert all(r["proven"] for r in got)
    flat = spark.range(20_000).selectExpr("id", "id % 2 as two")
    exact = topk.heavy_hitters(flat, exact=True).collect()
    assert sorted({(r["column_name"], r["proven"]) for r in exact}) == [("id", False), ("two", True)] and len(exact) == 12
    sure = topk.heavy_hitters(flat).collect()
    assert {(r["column_name"], r["value"], r["count"]) for r in sure} == {("two", "0", 10_000), ("two", "1", 10_000)}
    assert topk.candidates(flat).where("column_name = 'id' and n > bound").count() == 0


def test_basic_tier_estimates_large_columns(spark):
    df = spark.range(30_000).selectExpr("id", "id % 3 as few", "if(id % 10 < 8, 'same', cast(id as string)) as mostly")
    p = {r["column_name"]: r for r in column_profiles(df, as_of=as_of(), tier="basic", counted=1000).collect()}
    assert {c: r["distinct_exact"] for c, r in p.items()} == {"id": False, "few": True, "mostly": False}
    assert p["few"]["distinct_count"] == 3 and p["id"]["distinct_count"] == pytest.approx(30_000, rel=0.1) and p["id"]["distinct_count"] <= 30_000
    assert p["mostly"]["top_percentage"] == 80 and p["id"]["top_percentage"] == 0
    assert all(r["distinct_exact"] for r in column_profiles(df, as_of=as_of(), tier="basic").collect())


def test_basic_tier_counts_large_columns(spark, tmp_path):
    """Over a million different keys, one of them on a thousandth of the rows, which a summary cannot prove."""
    n = 1_200_000
    rows = spark.range(n).selectExpr("if(id % 1000 = 0, -1, id) as l_orderkey", "cast(id % 50 as double) as l_quantity", "if(id % 3 = 0, 'A', 'R') as l_returnflag", "timestamp_ntz'1998-01-01 00:00:00' as l_shipdate")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.sql(oracle.oracle_sql()["basic_tier_columns"])
    got = queries.basic_tier_columns(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_basic_tier_has_the_top_values_and_labels_of_others(spark):
    df = spark.range(20_000).selectExpr("id", "concat('u', id, '@example.com') as contact")
    found = [profile_table(df, as_of=as_of(), tier=tier) for tier in ("basic", "standard")]
    same = ("column_name", "distinct_count", "distinct_exact", "top_percentage", "pii", "pii_confidence")
    for of in (lambda p: p.columns.select(*same), lambda p: p.top_values):
        basic, standard = (sorted(map(tuple, of(p).collect())) for p in found)
        assert basic == standard
    assert found[0].columns.where("column_name = 'contact'").first()["pii"] == "email"
    estimated = profile_table(df, as_of=as_of(), tier="basic", counted=1000)
    assert not estimated.columns.where("distinct_exact").count() and not estimated.top_values.count()


def test_listed_tables(spark):
    spark.sql("create database if not exists listed")
    try:
        spark.range(3).write.mode("overwrite").saveAsTable("listed.b")
        spark.range(3).write.mode("overwrite").saveAsTable("listed.a")
        spark.sql("create or replace view listed.v as select * from listed.a")
        assert tables.list_tables(spark, "listed") == ["a", "b"]
    finally:
        spark.sql("drop database listed cascade")
    catalogue = spark.createDataFrame([("s", "t", "BASE TABLE"), ("s", "v", "VIEW"), ("x", "t", "BASE TABLE")], "table_schema string, table_name string, table_type string")
    assert [tuple(r) for r in tables.list_jdbc_tables(catalogue, "s").collect()] == [("s", "t")]


def test_counted_numbers_give_what_rows_give(spark, dirty):
    """Outliers, bins and percentiles from value counts; floats are no doubles of the same text."""
    df = dirty.withColumns({"f": (F.col("score") / 7).cast("float"), "far": F.when(F.col("id") == 8, 1e9).otherwise(F.col("score").cast("double"))}).unionByName(dirty.withColumns({"f": F.lit(0.1).cast("float"), "far": F.lit(-0.0)}))
    for by in ([], ["name"]):
        base, freq = stats.column_stats(df, by=by), stats.value_freq(df, by=by)
        for f in (stats.outliers, stats.histogram):
            assert sorted(map(str, f(df, base, by=by, freq=freq).collect())) == sorted(map(str, f(df, base, by=by).collect()))
        assert sorted(map(str, stats.percentiles(df, by=by, freq=freq).collect())) == sorted(map(str, stats.percentiles(df, by=by).collect()))


def test_unique_keys(spark):
    rows = [(i, i // 3, i % 3, i % 2, None if i == 5 else i, {"k": i}) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, a int, b int, two int, gap int, m map<string,int>")
    got = {tuple(r["key_columns"]) for r in links.unique_keys(df).collect()}
    assert got == {("id",), ("m",), ("a", "b")}
    three = spark.createDataFrame([(i // 4, i // 2 % 2, i % 2, 1) for i in range(64)], "a int, b int, c int, d int")
    assert links.unique_keys(three).count() == 0
    assert [tuple(r["key_columns"]) for r in links.unique_keys(three, 3).collect()] == [("a", "b", "c")]
    assert links.unique_keys(df.limit(0)).count() == 0


def test_links_of_several_columns(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 9), (None, 1), (3, None)], "x int, y int")
    parent = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "p int, q int")
    r = links.check_link(child, ["x", "y"], parent, ["p", "q"]).first()
    assert (r["filled_rows"], r["orphan_rows"], r["match_percentage"]) == (4, 1, 75.0)
    with pytest.raises(ValueError):
        links.check_link(child, ["x", "y"], parent, "p")


def test_sketches_lose_no_link(spark):
    """A child of few values against a parent of many, a child that misses one value, types that do not mix."""
    parent = spark.range(60_000).selectExpr("id as k", "concat('n', id) as t")
    child = spark.createDataFrame([(i * 11 % 60_000, f"n{i}", i) for i in range(300)], "k bigint, t string, more int")
    wrong = spark.createDataFrame([(i, f"z{i}") for i in range(59_000, 60_001)], "k bigint, t string")
    got = {tuple(r)[:4] for r in links.discover_links({"p": parent, "c": child, "w": wrong}).collect()}
    assert got >= {("c", "k", "p", "k"), ("c", "t", "p", "t"), ("c", "more", "p", "k")} and not any(g[0] == "w" for g in got)
    left = {tuple(r) for r in links.sketched_pairs({"p": parent, "c": child, "w": wrong}).collect()}
    assert {g for g in got} <= left and ("w", "t", "p", "t") not in left
    none = links.discover_links({"a": spark.createDataFrame([(1.5,)], "v double").withColumn("s", F.lit("x")), "b": spark.createDataFrame([("y",)], "s string")})
    assert none.count() == 0
    with pytest.raises(ValueError):
        links.discover_links({"a": spark.createDataFrame([(1.5,)], "v double")})


def test_catalogue_links(spark, dirty):
    """Rows as a database's catalogue has them: a key of one column, one of two whose columns are named in another order, another table's."""
    usage = spark.createDataFrame(
        [
            ("s", "pk_other", "s", "other", "a", 1, None), ("s", "pk_other", "s", "other", "b", 2, None), ("s", "pk_one", "x", "one", "key", 1, None),
            ("s", "fk_two", "s", "t", "u", 1, 2), ("s", "fk_two", "s", "t", "v", 2, 1), ("s", "fk_one", "s", "t", "id", 1, 1), ("s", "fk_else", "s", "else", "id", 1, 1), ("s", "pk_t", "s", "t", "id", 1, None),
        ],
        "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int",
    )
    refers = spark.createDataFrame([("s", "fk_two", "s", "pk_other"), ("s", "fk_one", "s", "pk_one"), ("s", "fk_else", "s", "pk_one")], "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string")
    found = links.catalogue_links(usage, refers, "s", "t")
    want = [("id", "x", "one", "key", "foreign_key"), ("u", "s", "other", "b", "foreign_key"), ("v", "s", "other", "a", "foreign_key")]
    assert [tuple(r) for r in found.collect()] == want
    p = profile_table(dirty, as_of=as_of(), tier="basic", relationships=found)
    assert sorted(map(tuple, p.parts()["links"].collect())) == want


def test_jdbc_tables(spark):
    """A database in memory, read whole and in parts."""
    url = "memory:shop;create=true"
    spark.range(100).selectExpr("id", "concat('n', id) as name").write.format("jdbc").options(url=f"jdbc:derby:{url}", dbtable="shop", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    whole = tables.open_table(spark, "derby", url, "shop", **driver)
    parts = tables.open_table(spark, "jdbc", f"jdbc:derby:{url}", "shop", partition_column="id", bounds=(0, 100), partitions=5, **driver)
    assert (whole.count(), parts.count(), whole.rdd.getNumPartitions(), parts.rdd.getNumPartitions()) == (100, 100, 1, 5)
    p = {r["column_name"].lower(): r for r in profile_table(parts, as_of=as_of()).columns.collect()}
    assert (p["id"]["distinct_count"], p["id"]["p50"], p["name"]["max_length"]) == (100, 49.5, 3)


def test_distinct_by_hash(spark, dirty):
    want = {r["column_name"]: r["distinct_count"] for r in stats.distinct_counts(stats.value_freq(dirty)).collect()}
    assert {r["column_name"]: r["distinct_count"] for r in stats.distinct_by_hash(dirty).collect()} == want


def test_file_formats(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "concat('n', id % 3) as name")
    for kind in tables.FILE_FORMATS:
        path = str(tmp_path / kind)
        df.write.format(kind).options(header="true").save(path)
        back = tables.open_table(spark, kind, path)
        assert sorted((int(r["id"]), r["name"]) for r in back.collect()) == sorted((r["id"], r["name"]) for r in df.collect())
        assert {r["column_name"]: r["distinct_count"] for r in column_profiles(back, as_of=as_of(), tier="basic").collect()} == {"id": 20, "name": 3}
    with pytest.raises(ValueError):
        tables.open_table(spark, "unheard_of", "x")


def test_stored_tables_are_discarded_unless_read(spark):
    with tables.recorded() as made:
        one, two = tables.stored(spark.range(3), "one"), tables.stored(spark.range(4), "two")
    assert len(made) == 2
    tables.discard(spark, made, two.where("id > 1"))
    assert len(made) == 1 and two.count() == 4 and not history._exists(spark, one.inputFiles()[0])
    tables.discard(spark, made, spark.range(1))
    assert made == []
