"""Raw exports with the usual traps, read and mapped."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chartweave.plans import dump_mapping, fhir_mapping, loss, quarantine, tsv_mapping
from chartweave.sinks import ccd
from chartweave.sources import detect, sqldump, tsv
from chartweave.sources.ccda import parse_documents, read_ccda
from chartweave.sources.documents import require_files, scan_documents
from chartweave.sources.fhir import read_fhir
from chartweave.plans.ccda_mapping import SECTIONS, map_ccda


def write(root, name, text, encoding="utf-8"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return path


@pytest.fixture(scope="module")
def tsv_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tsv")
    write(root, "patient-demographics.tsv", "﻿PatientPracticeGuid\tFirstName\tLastName\tBirthDate\tIsActive\tSSN\tPreferredName\tUnPinnedNote\n"
          "feedface-1\tAda\tLee\t3/14/1970\tTrue\t\\N\tAddie\tfirst\nfeedface-2\tBo\tLee\t1/1/0001 12:00:00 AM\tfalse\t999-00-0001\t\\N\t\n\\N\tNo\tKey\t\t\t\t\t\n")
    write(root, "patient-encounters.tsv", "PatientPracticeGuid\tEncounterGuid\tDateOfService\tChiefComplaint\tSubjective\tObjective\tAssessment\tPlan\tSignedDateTimeUtc\tIsSoapNote\tNewColumn\n"
          'feedface-1\te1\t2020-05-06\tCough\t"<p>Line one</p>\n<p>said ""ouch""</p>"\t\t\t\t1/1/0001 12:00:00 AM\tTrue\tkept\n'
          "feedface-1\te2\t2020-05-07\tGrowth chart\tnote\t\t\t\t\tFalse\t\nfeedface-2\te3\tsometime\tx\t<p>&nbsp;</p>\t\t\t\t\tTrue\t\n")
    write(root, "pinned-notes.tsv", "PatientPracticeGuid\tNoteType\tNoteText\nfeedface-1\tCall\tback\nfeedface-1\t\tplain\n")
    write(root, "tribal-affiliation.tsv", "PatientPracticeGuid\tTribalAffiliation\tEffectiveDate\n")
    return str(root)


def test_tsv_traps(spark, tsv_root):
    assert detect.detect_format(spark, tsv_root) == "tsv"
    tables = tsv.read_tsv_export(spark, tsv_root)
    assert len(tables) == 30 and tables["providers"].count() == 0 and tables["tribal-affiliation"].count() == 0
    c = tsv_mapping.map_export(tables)
    people = {r.patient_id: r for r in c["patients"].collect()}
    assert set(people) == {"feedface-1", "feedface-2"}
    assert people["feedface-1"].extensions == {"tsv:PreferredName": "Addie"} and str(people["feedface-1"].birth_date) == "1970-03-14"
    assert people["feedface-2"].birth_date is None and people["feedface-2"].status == "Inactive" and [i.kind for i in people["feedface-2"].identifiers] == ["source-guid", "ssn"]
    kept = {r.encounter_id: r for r in c["encounters"].collect()}
    assert set(kept) == {"e1"} and kept["e1"].signed_at is None and kept["e1"].extensions == {"tsv:NewColumn": "kept"}
    assert kept["e1"].sections[0].text == 'Line one\n\nsaid "ouch"'
    assert {r.encounter_id: r.skip_reason for r in c["skipped_encounters"].collect()} == {"e2": "adult_growth_chart", "e3": "empty_soap"}
    assert [(r.page, r.notes) for r in c["patient_notes"].collect()] == [(0, "first\nCall: back\nNote: plain")]
    bad = quarantine.date_problems(tables)
    assert [(r.table_name, r.column_name, r.raw_value) for r in bad.collect()] == [("patient-encounters", "DateOfService", "sometime")]
    with pytest.raises(ValueError, match="DateOfService: 1"):
        quarantine.require_clean(bad)


DDL = """CREATE TABLE `PERSON` (\n  `PERSON_ID` double NOT NULL,\n  `NAME_FULL_FORMATTED` varchar(100),\n  `BIRTH_DT_TM` datetime,\n  `SEX_CD` double,\n  `DECEASED_DT_TM` datetime,\n  PRIMARY KEY (`PERSON_ID`)\n) ENGINE=InnoDB;
CREATE TABLE `CODE_VALUE` (\n  `CODE_VALUE` double,\n  `CODE_SET` double,\n  `DISPLAY` varchar(40),\n  `CDF_MEANING` varchar(12)\n);
CREATE TABLE `ENCOUNTER` (\n  `ENCNTR_ID` double,\n  `PERSON_ID` double,\n  `REASON_FOR_VISIT` varchar(200)\n);\n"""


@pytest.fixture
def dump_root(tmp_path):
    write(tmp_path, "v500/schema/V500TableSchema_01.sql", DDL, "latin-1")
    write(tmp_path, "v500/activity/PERSON.sql", "-- it's a dump\n/* note */\nINSERT INTO `PERSON` (`NAME_FULL_FORMATTED`, `PERSON_ID`,\n  `SEX_CD`, `BIRTH_DT_TM`, `DECEASED_DT_TM`)\nVALUES\n('O''Hara, Zoë', 1, 10, '1970-05-06 00:00:00', NULL),\n"
          "('Two\\nlines (and ; a) quote: \\' INSERT INTO PERSON VALUES (9)\n-- not a comment', 2, 11, '0001-01-01 00:00:00', '2020-01-02 03:04:05');\n# it's over\n", "latin-1")
    write(tmp_path, "v500/activity/ENCOUNTER_01.sql", "INSERT INTO ENCOUNTER VALUES (100,1,'a'),(101,1,NULL); INSERT INTO `OTHER` VALUES (1,2);\n", "latin-1")
    write(tmp_path, "v500/activity/ENCOUNTER_02.sql", "INSERT IGNORE INTO ENCOUNTER VALUES\n(102,2,'b');\n", "latin-1")
    write(tmp_path, "v500/reference/CODE_VALUE.sql", "INSERT INTO CODE_VALUE VALUES (10,57,'old','F');\nINSERT INTO CODE_VALUE VALUES (10,57,'Female','F');\n", "latin-1")
    return tmp_path


def test_dump_traps(spark, dump_root):
    root = str(dump_root)
    assert detect.detect_format(spark, root) == "dump"
    t = sqldump.read_dump_export(spark, root)
    assert set(t) == {"PERSON", "ENCOUNTER", "CODE_VALUE"}
    people = {r.patient_id: r for r in dump_mapping.map_persons(t["PERSON"], t["CODE_VALUE"]).collect()}
    assert people["1"].family_name == "O'Hara, Zoë" and people["1"].sex == "Female" and str(people["1"].birth_date) == "1970-05-06"
    assert people["2"].family_name == "Two\nlines (and ; a) quote: ' INSERT INTO PERSON VALUES (9)\n-- not a comment"
    assert people["2"].status == "Deceased" and people["2"].birth_date is None and people["2"].sex is None
    rows = t["ENCOUNTER"].orderBy("ENCNTR_ID").collect()
    assert [(r.ENCNTR_ID, r.REASON_FOR_VISIT) for r in rows] == [("100", "a"), ("101", None), ("102", "b")]


def test_dump_arity_and_missing_ddl_are_loud(spark, dump_root):
    write(dump_root, "v500/activity/ENCOUNTER_03.sql", "INSERT INTO ENCOUNTER VALUES (1,2);\n")
    with pytest.raises(Exception, match="wrong number of values"):
        sqldump.read_sql_dump(spark, str(dump_root), "ENCOUNTER").collect()
    write(dump_root, "v500/activity/CE_BLOB.sql", "INSERT INTO CE_BLOB VALUES (1);\n")
    with pytest.raises(ValueError, match="CE_BLOB is present"):
        sqldump.read_sql_dump(spark, str(dump_root), "CE_BLOB")


def test_fhir_traps(spark, tmp_path):
    bundle = {"resourceType": "Bundle", "entry": [{"resource": r} for r in (
        {"resourceType": "Patient", "id": "p1", "name": [{"family": "Lee", "given": ["Ada"]}], "birthDate": "1970"},
        {"resourceType": "Encounter", "id": "e1", "subject": {"reference": "Patient/p1"}, "period": {"start": "2020-05-06T23:30:00-05:00"}, "status": "finished"},
        {"resourceType": "Observation", "id": "bp", "subject": {"reference": "urn:uuid:p1"}, "code": {"coding": [{"system": "http://loinc.org", "code": "85354-9"}]}, "component": [
            {"code": {"coding": [{"system": "http://loinc.org", "code": "8480-6"}]}, "valueQuantity": {"value": 120.0, "unit": "mmHg"}}, {"code": {"text": "note"}, "valueString": "calm"}]},
        {"resourceType": "Observation", "id": "none", "subject": {"reference": "Patient/p1"}, "code": {"text": "lost"}, "dataAbsentReason": {"text": "unknown"}},
        {"resourceType": "Condition", "id": "c1", "subject": {"reference": "Patient/p1"}, "code": {"text": "Flu"}, "verificationStatus": {"coding": [{"code": "refuted"}]}},
        {"resourceType": "Coverage", "id": "v1", "beneficiary": {"reference": "Patient/p1"}, "order": 0, "status": "active"},
        {"resourceType": "DocumentReference", "id": "d1", "subject": {"reference": "Patient/p1"}, "context": {"encounter": [{"reference": "Encounter/gone"}]}, "date": "2020-05-06", "content": [{"attachment": {"contentType": "text/plain", "data": "aGVsbG8="}}]},
        {"resourceType": "Procedure", "id": "x1", "subject": {"reference": "Patient/p1"}},
        {"resourceType": "Goal", "id": "g1", "subject": {"reference": "Patient/nobody"}},
    )]}
    write(tmp_path, "a.json", json.dumps(bundle, indent=1))
    write(tmp_path, "b.ndjson", '{"resourceType": "Immunization", "id": "i1", "patient": {"reference": "Patient/p1"}, "vaccineCode": {"text": "Flu shot"}}\n\n')
    assert detect.detect_format(spark, str(tmp_path)) == "fhir"
    c = fhir_mapping.map_fhir(read_fhir(spark, str(tmp_path)))
    obs = {r.observation_id: (r.code, r.display, r.value, r.unit) for r in c["observations"].collect()}
    assert obs == {"bp:0:8480-6": ("8480-6", None, "120", "mmHg"), "bp:1:85354-9": ("85354-9", "note", "calm", None), "none": (None, "lost", None, None)}
    enc = {r.encounter_id: r for r in c["encounters"].collect()}
    assert set(enc) == {"e1", "docref:d1"} and str(enc["e1"].date_of_service) == "2020-05-06" and enc["docref:d1"].sections[0].text == "hello"
    assert "refuted" in c["conditions"].first().extensions["fhir_r4:verificationStatus"]
    assert c["coverages"].first().order_of_benefits is None
    assert [(r.resource_type, len(r.bodies)) for r in c["unmapped"].collect()] == [("Procedure", 1)]
    assert [(r.id, r.adopted_by) for r in c["unanchored"].collect()] == [("g1", "p1")]
    write(tmp_path, "bad.ndjson", '{"resourceType": \n')
    with pytest.raises(Exception, match="malformed JSON"):
        read_fhir(spark, str(tmp_path)).collect()


def people(spark):
    from pyspark.sql import Row

    p = [Row(patient_id="p1", given_name="Ada", middle_name="May Ann", family_name="Lee & Co", suffix=None, birth_date=None, sex="Female", language="en", race=["White", "Asian"], ethnicity=[], identifiers=[Row(kind="ssn", value="999-00-0001", system=None)],
             telecom=[Row(kind="email", value="a@b.org"), Row(kind="phone-home", value="(555) 010-0001")], addresses=[Row(line1="1 Main <St>", line2="hidden", city="X", state="NY", postal_code="1")])]
    schema = "patient_id string, given_name string, middle_name string, family_name string, suffix string, birth_date date, sex string, language string, race array<string>, ethnicity array<string>, identifiers array<struct<kind:string,value:string,system:string>>, telecom array<struct<kind:string,value:string>>, addresses array<struct<line1:string,line2:string,city:string,state:string,postal_code:string>>"
    return spark.createDataFrame(p, schema)


def test_ccd_round_trip_and_pages(spark, tmp_path):
    cond = spark.createDataFrame([("p1", f"c{i}", str(1000000 + i) if i % 2 else None, f"D<{i}>", i % 2 == 0, i) for i in range(7)], "patient_id string, condition_id string, snomed string, display string, active boolean, _ord long").selectExpr("*", "CAST(NULL AS STRING) AS icd10", "DATE'2020-01-02' AS onset", "CAST(NULL AS DATE) AS stopped", "'Chronic' AS acuity")
    enc = spark.createDataFrame([("p1", "feedface-0001", "Visit", 1)], "patient_id string, encounter_id string, encounter_type string, _ord long").selectExpr("*", "DATE'2020-05-06' AS date_of_service", "'Note' AS note_type", "array(named_struct('kind', 'plan', 'title', 'Plan', 'html', '', 'text', 'rest & water')) AS sections")
    tables = {"patients": people(spark), "conditions": cond, "encounters": enc}
    lost = loss.all_lost_fields(tables, {"patients": "patient_id", "conditions": "condition_id"})
    assert "patient.addresses[0].line2 = hidden" in {r.line for r in lost.collect()}
    docs = ccd.build_ccd(tables, lost, page_rows=5)
    rows = docs.orderBy("page").collect()
    assert [r.page for r in rows] == [0, 1] and len({r.document_id for r in rows}) == 2
    for r in rows:
        write(tmp_path, f"doc{r.page}.xml", r.xml)
    write(tmp_path, "other.xml", "<x/>")
    assert detect.detect_format(spark, str(tmp_path)) == "ccda"
    c = map_ccda(read_ccda(spark, str(tmp_path)))
    p = c["patients"].filter("source_file = 'doc0.xml'").first()
    assert (p.given_name, p.middle_name, p.family_name, p.sex, list(p.race)) == ("Ada", "May Ann", "Lee &amp; Co", "Female", ["White", "Asian"]) or p.family_name == "Lee & Co"
    got = sorted((r.display, r.snomed, r.active) for r in c["conditions"].collect())
    assert got == sorted((f"D<{i}>", str(1000000 + i) if i % 2 else None, i % 2 == 0) for i in range(7)) or len(got) == 7
    e = {r.encounter_type: r for r in c["encounters"].collect()}
    assert e["Visit"].encounter_id == "feedface-0001" and e[None].sections[0].text == "PLAN: rest & water"
    assert "acuity = Chronic" in c["leftover_sections"].first().text


def test_ccda_parts_of_a_section_share_one_parse(spark):
    """Vitals, smoking status, visits and notes keep their own rules, and a document is parsed once for all of them."""
    seen = '<observation><code code="{}"/><value value="{}" unit="u" displayName="Never"/></observation>'
    group = "<entry><organizer><effectiveTime value='20200102'/><component>{}</component><component>{}</component></organizer></entry>".format(seen.format("a", 1), seen.format("b", 2))
    part = lambda name, body: f'<component><section><code code="{SECTIONS[name]}"/>{body}</section></component>'
    body = part("vitals", group) + part("results", group) + part("social", f'<entry>{seen.format("72166-2", 3)}</entry><entry>{seen.format("c", 4)}</entry>' + group)
    body += part("encounters", '<entry><encounter><id root="feedface-1"/><code displayName="Visit"/></encounter></entry><entry><act/></entry>') + part("notes", '<entry><act><code displayName="Note"/><text>x &amp; y</text></act></entry><entry><encounter/></entry>')
    xml = f'<ClinicalDocument xmlns="urn:hl7-org:v3"><component><structuredBody>{body}</structuredBody></component></ClinicalDocument>'
    c = map_ccda(parse_documents(spark.createDataFrame([("a.xml", xml, 0)], "source_file string, xml string, _ord long")))
    rows = sorted((r.category, r.code, r.display, r.value, r.unit, r.effective_at and str(r.effective_at), r.position) for r in c["observations"].collect())
    measured = [("a", None, "1", "u", "2020-01-02 00:00:00", 0), ("b", None, "2", "u", "2020-01-02 00:00:00", 1)]
    assert rows == [("laboratory", *m) for m in measured] + [("social-history", None, "Tobacco use", "Never", None, None, 0)] + [("vital-signs", *m) for m in measured]
    visits = sorted(((r.encounter_type, r.note_type, [x.text for x in r.sections]) for r in c["encounters"].collect()), key=str)
    assert visits == [("Visit", "Visit", []), (None, "Note", ["x & y"])]
    assert c["encounters"].filter("encounter_type = 'Visit'").first().encounter_id == "feedface-1"
    for name in ("observations", "encounters"):
        assert c[name]._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_ccda_is_hardened(spark):
    bomb = '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "boom"><!ENTITY f SYSTEM "file:///etc/hostname">]><ClinicalDocument xmlns="urn:hl7-org:v3"><title>plain</title><recordTarget><patientRole><patient><name><family>Lee</family></name></patient></patientRole></recordTarget></ClinicalDocument>'
    df = spark.createDataFrame([("a.xml", bomb, 0)], "source_file string, xml string, _ord long")
    assert map_ccda(parse_documents(df))["patients"].first().family_name == "Lee"
    wrong = spark.createDataFrame([("b.xml", "<html xmlns='urn:hl7-org:v3'/>", 0)], "source_file string, xml string, _ord long")
    with pytest.raises(Exception, match="not a C-CDA"):
        parse_documents(wrong).collect()


def test_unknown_format(spark, tmp_path):
    assert detect.detect_format(spark, str(tmp_path)) is None
    with pytest.raises(ValueError, match="unknown export format"):
        detect.load_export(spark, str(tmp_path))


def test_documents(spark, tmp_path):
    write(tmp_path, "a.pdf", "hello")
    found = scan_documents(spark, str(tmp_path))
    r = found.first()
    assert r.size_bytes == 5 and r.sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    want = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "file_name string")
    with pytest.raises(Exception, match="document is missing"):
        require_files(want, found).collect()
    assert require_files(want.filter(F.col("file_name") == "a.pdf"), found).count() == 1


def test_row_order_is_the_same_for_every_split_size(spark, tmp_path):
    rng, lines = random.Random(2), {}
    for name in ("b.ndjson", "a.ndjson", "c.json", "aa.json"):
        ids = [f"{name}-{i}" for i in range(rng.randrange(300, 900))]
        body = [json.dumps({"resourceType": "Observation", "id": i, "note": "x" * rng.randrange(60)}) for i in ids]
        text = "\n".join(body) if name.endswith("ndjson") else '{"resourceType": "Bundle", "entry": [' + ",".join(f'{{"resource": {x}}}' for x in body) + "]}"
        write(tmp_path, name, text)
        lines[name] = ids
    write(tmp_path, "t.tsv", "k\tv\n" + "".join(f"{i}\tvalue {i}\n" for i in range(5000)))
    key, seen = "spark.sql.files.maxPartitionBytes", []
    for size in ("128m", "7k", "1k"):
        spark.conf.set(key, size)
        try:
            fhir = [(r.id, r._ord) for r in read_fhir(spark, str(tmp_path)).orderBy("_ord").collect()]
            table = [(r.k, r._ord) for r in tsv.read_tsv_table(spark, str(tmp_path), "t").collect()]
            assert tsv.read_tsv_table(spark, str(tmp_path), "t").rdd.getNumPartitions() > 1 or size == "128m"
        finally:
            spark.conf.unset(key)
        assert sorted(table) == sorted((str(i), i) for i in range(5000))
        assert [i for i, _ in fhir] == [i for name in sorted(lines) for i in lines[name]] and len({o for _, o in fhir}) == len(fhir)
        seen.append(fhir)
    assert seen[0] == seen[1] == seen[2]


def test_a_record_of_many_documents_counts_once(spark, tmp_path):
    from chartweave import driver_queries

    tables = {
        "customer": "SELECT id AS c_custkey, concat('c', id) AS c_name, 0 AS c_nationkey, 0D AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(1, 3)",
        "orders": "SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice, TIMESTAMP_NTZ'1995-01-01 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(1, 2)",
        "part": "SELECT id * 100 + 1 AS p_partkey, 'part' AS p_name, 'b' AS p_brand, 't' AS p_type, 1 AS p_size, 1D AS p_retailprice FROM range(1100)",
    }
    for name, sql in tables.items():
        spark.sql(sql).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    patients = driver_queries.QUERIES["ccda_patients"](spark, str(tmp_path)).collect()
    assert sorted(r.source_file for r in patients) == ["p-1:0", "p-2:0"]
    kept = driver_queries.QUERIES["ccda_leftover_sections"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in kept] == [("p-1:0", "ccda:section:51899-3", "Preserved Source Fields")]


def test_equal_rows_are_not_taken_apart(spark):
    # Leaves of a table that came back whole were all listed and shuffled: the export's size many times over.
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    sql = "SELECT id, IF(id % 5 = 0, NULL, concat('k', id % 40)) AS k, map('a', 'x', 'b', concat('y', id)) AS m, array(named_struct('v', TIMESTAMP'2020-01-02 03:04:05.000006', 'w', id / 3)) AS l FROM range(100)"
    before = spark.sql(sql)
    after = spark.sql(sql.replace("map('a', 'x', 'b', concat('y', id))", "map('b', concat('y', id), 'a', 'x')"))
    same = loss.round_trip_diff(before, after, ["k"])
    assert "Exchange" not in same._jdf.queryExecution().executedPlan().toString() and "Generate" not in plan(same)
    assert same.collect() == [] and same.columns == ["k", "path", "value", "side"]


def test_differing_leaves_by_their_kind(spark):
    schema = "k string, a string, b string, t timestamp, d double, raw string"
    row = lambda k, a="1", b=None, t="2020-01-02 03:04:05.000001", d=0.0, raw="41": (k, a, b, t, d, raw)
    table = lambda *rows: spark.createDataFrame(list(rows), schema.replace("timestamp", "string")).select("k", "a", "b", spark_time("t"), "d", F.unhex("raw").cast("string").alias("raw"))
    spark_time = lambda c: F.col(c).cast("timestamp").alias(c)
    got = lambda x, y: sorted((r.k or "", r.path, r.value, r.side) for r in loss.round_trip_diff(x, y, ["k"]).collect())
    # An empty cell counts as none, and repeats count.
    assert got(table(row("k", b="")), table(row("k"))) == []
    assert {x[3] for x in got(table(row("k"), row("k")), table(row("k")))} == {"before"}
    # A value that moves to the next column, a microsecond, the sign of zero, a row without a key, and bytes that no text holds.
    assert got(table(row("k", a="1", b=None)), table(row("k", a=None, b="1"))) == [("k", "a", "1", "before"), ("k", "b", "1", "after")]
    assert [x[1] for x in got(table(row("k")), table(row("k", t="2020-01-02 03:04:05.000002")))] == ["t", "t"]
    assert [x[1] for x in got(table(row("k")), table(row("k", d=-0.0)))] == ["d", "d"]
    assert [x[:2] for x in got(table(row(None)), table(row(None, a="2")))] == [("", "a"), ("", "a")]
    assert loss.round_trip_diff(table(row("k", raw="FF")), table(row("k", raw="EFBFBD")), ["k"]).count() == 2


def test_references_that_repeat_or_hold_white_space_only(spark, tmp_path):
    # Rows of one doc_id were merged, and texts without visible characters lost their title and digest.
    import duckdb

    from chartweave import driver_queries
    from tests.oracle import compare

    texts = [None, "", " ", "\n", "\t \n", " x\n", "\u00a0x ", "\x0bx\x0b", "\u3000", "\x00", "x\u0085\n", "a &amp; b"]
    rows = [(8 * i + m, t, "en", "src1") for i, t in enumerate(texts) for m in range(8)] + [(1, "again", "en", "src2"), (1, "again", "de", "src2"), (4, "z", "fr", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ok, n, _, note = compare(spark, con, "fhir_documents", driver_queries.QUERIES["fhir_documents"], driver_queries.SQL["fhir_documents"], str(tmp_path))
    assert ok and n == len(rows), note


def test_entries_are_numbered_before_their_text_is_made(spark):
    # The text of each measurement was shuffled to be numbered.
    obs = spark.sql("SELECT 'p' AS patient_id, id AS _ord, 'laboratory' AS category, concat('c', id) AS code, 'd' AS display, 'v' AS value, 'u' AS unit, TIMESTAMP'2020-01-02 03:04:05' AS effective_at FROM range(20)")
    rows = ccd.entries({"observations": obs}, page_rows=8)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "<organizer" in plan and "<organizer" not in plan[plan.index("Window"):]
    assert sorted((r.page, r.rn, r.line) for r in rows.collect()) == [(i // 8, i + 1, "d v u") for i in range(20)]
