"""Framework files with every fault once, publications that are whole or absent, and facts as a stream."""

import json

from pyspark.sql import functions as F

from attesta.operators import applicability as A
from attesta.plans.bindings import Inputs
from attesta.sources import framework as FW, publish as P
from attesta.streaming.arrivals import current_facts, latest_facts_arrivals

SF = "/root/testdata/sf0.001"
REQUIREMENT = {"clause": "6(1)", "title": "t", "requirement": "r", "detection_method": "ocr", "automation_class": "image_automatable", "implementation_status": "implemented",
               "verification_status": "unverified"}
RULE = {"rule_number": "6", "title": "Rule", "automation_class": "image_automatable", "verification_status": "unverified"}
GOOD = {
    "instruments.json": {"instruments": [{"citation": "G.S.R. 1", "instrument_type": "principal", "verification_status": "verified", "verification_note": "n", "notified_on": "2011-03-07", "_c": 1}]},
    "applicability_conditions.json": {"conditions": [{"code": "bidi", "name": "Bidi", "determination": "database", "is_active": False}]},
    "rules.json": {"_comment": "x", "rules": [
        {**RULE, "requirements": [{**REQUIREMENT, "applicability": [{"condition": "bidi", "mode": "exempts"}, {"condition": "bidi", "mode": "requires", "note": "n"}], "compliance_rule_codes": ["A", "B"]},
                                  {**REQUIREMENT, "version": 2, "supersedes_version": 1, "effective_from": "2020-01-01", "effective_to": ""}]},
        {**RULE, "rule_number": "32A"}, {**RULE, "rule_number": "7", "requirements": None}]}}


def written(spark, tmp_path, files):
    for name, content in files.items():
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))
    return FW.read_framework_files(spark, str(tmp_path))


def test_a_good_framework_has_no_fault_and_typed_rows(spark, tmp_path):
    files = written(spark, tmp_path, GOOD)
    assert FW.all_faults(files).count() == 0
    rows = FW.rows_of(files, "requirements").orderBy("version").collect()
    assert [(r.parent, r.clause, r.version, r.supersedes_version, r.severity, r.is_active, r.compliance_rule_codes) for r in rows] == [
        ("6", "6(1)", 1, None, "major", True, ["A", "B"]), ("6", "6(1)", 2, 1, "major", True, None)]
    links = FW.rows_of(files, "applicability").orderBy("at").collect()
    assert [(r.at, r.parent, r.condition, r["mode"], r.note) for r in links] == [
        ("$.rules[0].requirements[0].applicability[0]", "6 6(1) v1", "bidi", "exempts", None), ("$.rules[0].requirements[0].applicability[1]", "6 6(1) v1", "bidi", "requires", "n")]
    assert [r.is_active for r in FW.rows_of(files, "conditions").collect()] == [False]
    assert FW.rows_of(files, "instruments").first().notified_on.isoformat() == "2011-03-07"


def test_every_fault_once_with_its_path(spark, tmp_path):
    r = lambda **kw: {**REQUIREMENT, **kw}
    broken = [
        r(version=0), r(clause="b", version="2"), r(clause="c", version=2, supersedes_version=2), r(clause="d", detection_method="magic"), r(clause="e", verification_status="verified", source_note=" "),
        r(clause="f", effective_from="2020-02-30"), r(clause="g", effective_from="2020-02-03", effective_to="2020-02-02"), r(clause="h", is_active="yes"), r(clause="i", applicability={}),
        r(clause="j", compliance_rule_codes=["A", 1]), r(clause="k", colour="red", _note="x"), {k: v for k, v in r(clause="l").items() if k != "title"}, r(clause=" "), 7, r(clause="m"), r(clause="m"),
        r(clause="n", applicability=[{"condition": "", "mode": "exempts"}, {"condition": "bidi", "mode": "hopes"}, {"mode": "exempts"}])]
    files = written(spark, tmp_path, {
        "rules.json": {"rules": [{**RULE, "requirements": broken}, {**RULE, "rule_number": "x"}, {**RULE, "rule_number": 8}, {**RULE, "rule_number": "9", "requirements": "none"}]},
        "bad.json": "{", "list.json": "[1]", "other.json": "{\"things\": []}"})
    at = "$.rules[0].requirements"
    want = {
        ("bad.json", "$", "not valid JSON"), ("list.json", "$", "not an object"), ("other.json", "$", "no list of entries"),
        ("rules.json", "$.rules[1].rule_number", "has no digits"), ("rules.json", "$.rules[2].rule_number", "not a text"), ("rules.json", "$.rules[3].requirements", "not a list")}
    want |= {("rules.json", f"{at}[{n}]{path}", fault) for n, path, fault in [
        (0, ".version", "not a whole number from 1"), (1, ".version", "not a whole number from 1"), (2, ".supersedes_version", "not a whole number below the version"),
        (3, ".detection_method", "not one of the values"), (4, ".source_note", "missing on a verified entry"), (5, ".effective_from", "not a date"), (6, ".effective_to", "ends before it begins"),
        (7, ".is_active", "not true or false"), (8, ".applicability", "not a list"), (9, ".compliance_rule_codes", "not a list of texts"), (10, "", "unrecognised: colour"), (11, "", "missing: title"),
        (12, ".clause", "not a text"), (13, "", "not an object"), (14, "", "repeated: m v1"),
        (16, ".applicability[0].condition", "not a text"), (16, ".applicability[1].mode", "not one of the values"), (16, ".applicability[2]", "missing: condition")]}
    # an entry that is no object lacks every key as well
    got = {tuple(x) for x in FW.all_faults(files).collect()}
    extra = {x for x in got - want if x[1] == f"{at}[13]" and x[2].startswith("missing: ")}
    assert got - extra == want and len(extra) <= 1


def test_publications_are_whole_or_absent(spark, tmp_path):
    root = str(tmp_path / "results")
    rows = spark.range(100).select(F.col("id").alias("run_id"), F.lit("passed").alias("status"))
    schema = "run_id long, status string, evaluated_on string"
    assert P.read_published(spark, root, schema).count() == 0
    assert P.append_results(rows, root, "2025-01-01-a", "2025-01-01") and not P.append_results(rows, root, "2025-01-01-a", "2025-01-01")
    assert P.append_results(rows.limit(10), root, "2025-01-02-a", "2025-01-02")
    assert P.read_published(spark, root, schema).count() == 110 and P.read_published(spark, root, schema, "2025-01-02-a").count() == 10
    # a job that failed half way has written data and no commit: nobody sees it
    rows.write.parquet(f"{root}/data-lost")
    (tmp_path / "results" / "_commits" / "half.json").write_text('{"key": "half", "fol')
    assert P.read_published(spark, root, schema).count() == 110


def test_a_load_with_errors_leaves_nothing_visible(spark, tmp_path):
    root = str(tmp_path / "rules")
    rows, none = spark.range(5), spark.createDataFrame([], "path string, error string")
    errors = spark.createDataFrame([("a.json", "broken")], "path string, error string")
    assert P.load_all_or_nothing(rows, errors, root, "v1") == 1 and P.read_published(spark, root, "id long").count() == 0
    assert [tuple(r) for r in P.read_published(spark, f"{root}-errors", "path string, error string").collect()] == [("a.json", "broken")]
    assert P.load_all_or_nothing(rows, none, root, "v1", dry_run=True) == 0 and P.read_published(spark, root, "id long").count() == 0
    assert P.load_all_or_nothing(rows, none, root, "v1") == 0 and P.read_published(spark, root, "id long").count() == 5


def test_reports_are_ordered_over_their_parts(spark, tmp_path):
    root = str(tmp_path / "report")
    report = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") > 5, "x").alias("v")).repartition(6)
    assert P.write_report(report, root, "r1") and not P.write_report(report, root, "r1")
    folder = P.commits(spark, root).first().folder
    parts = sorted((tmp_path / "report" / folder).glob("part-*.txt"))
    lines = [json.loads(x) for p in parts for x in p.read_text().splitlines()]
    assert len(parts) > 1 and [x["k"] for x in lines] == list(range(1000)) and lines[0] == {"k": 0, "v": None}


def test_streamed_facts_equal_the_batch(spark, tmp_path):
    """Rows arrive in three shuffled files and one of them twice; state has one row a key."""
    i = Inputs(spark, SF)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    facts = i.declarations
    for n in range(3):
        facts.where(F.pmod(F.xxhash64("declaration_id"), F.lit(3)) == n).orderBy(F.rand(n)).coalesce(1).write.mode("append").parquet(source)
    facts.where(F.pmod(F.xxhash64("declaration_id"), F.lit(3)) == 0).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = latest_facts_arrivals(stream, i.conditions, out, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = A.latest_facts(facts, i.conditions, with_id=True)
    got = current_facts(spark.read.parquet(out)).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == want.count() and len(q.recentProgress) >= 4
