import datetime
import os

import pytest
from samples import sample

from remitta.errors import MaskError, ReadError, SummaryError
from remitta.functions.values import shift_days, token
from remitta.operators import compat, summary
from remitta.plans.builtin import builtin
from remitta.sources import remittance as R
from remitta.sources.sql import register
from remitta.sources.views import csv_lines, filtered, json_view, lake, render
from remitta.streaming.intake import intake, stream_table

KEY = b"0123456789abcdef"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "a.835").write_bytes(sample())
    (d / "b.835").write_bytes(sample(("CLP*A-18", "CLP*B-1*4*80*75*0*12*PC18*11*1")))
    (d / "other.dat").write_bytes(b"no interchange")
    (d / "latin.rmt").write_bytes(sample(("NM1*QC*1*GREEN", "NM1*QC*1*GR#N*AVA****MI*M0017")).replace(b"GR#N", b"GR\xc9N"))
    return str(d)


def test_paths(spark, folder):
    assert [os.path.basename(p) for p in R.expand(spark, f"{folder}/*.835")] == ["a.835", "b.835"]
    for bad in (None, [], [None], 3, f"{folder}/none*.835", f"{folder}/none.835"):
        with pytest.raises(ReadError):
            R.expand(spark, bad)
    both = R.read_835(spark, [f"{folder}/a.835", f"{folder}/b.835"], filename=True)
    assert both.count() == 4 and both.columns[-1] == "filename"
    assert R.read_835(spark, f"{folder}/*.835", "payments").count() == 2


def test_options(spark, folder):
    for options in ({"table_name": "none"}, {"version": "6010"}, {"binary": None}, {"filename": None}):
        with pytest.raises(ReadError):
            R.read_835(spark, f"{folder}/a.835", **options)
    with pytest.raises(MaskError):
        R.read_835(spark, f"{folder}/a.835", mask_key="short")
    with pytest.raises(MaskError):
        R.read_835(spark, f"{folder}/a.835", mask_dates="year")


def test_schema_follows_the_specification(spark, folder):
    listed = {(r.table_name, r.column_name): r for r in R.schema_listing(spark).collect()}
    for name in builtin().table_names:
        df = R.read_835(spark, f"{folder}/a.835", name)
        assert df.columns == [c for t, c in listed if t == name]
    assert listed["adjustments", "service"].parent == "services"
    assert R.schema(builtin(), "claims")["payment"].metadata == {"parent": "payments"}


def test_bad_files(spark, folder):
    with pytest.raises(Exception, match="does not begin with an ISA"):
        R.read_835(spark, f"{folder}/other.dat").count()
    assert R.read_835(spark, f"{folder}/other.dat", ignore_errors=True).count() == 0
    (f,) = R.read_835(spark, f"{folder}/other.dat", "diagnostics", ignore_errors=True).collect()
    assert (f.kind, f.level, f.segment) == ("NotAnInterchange", 1, None)
    with pytest.raises(Exception, match="patient_last_name.*not UTF-8"):
        R.read_835(spark, f"{folder}/latin.rmt").count()
    assert R.read_835(spark, f"{folder}/latin.rmt", binary=True).first().patient_last_name == bytearray(b"GR\xc9N")


def test_masks(spark, folder):
    plain = R.read_835(spark, f"{folder}/a.835").first()
    year = R.read_835(spark, f"{folder}/a.835", mask_key=KEY).first()
    assert year.patient_last_name == token(KEY, "name", b"GREEN").decode() and year.claim_id == token(KEY, "id", b"A-17").decode()
    assert year.statement_from == datetime.date(2025, 1, 1) and year.payment_amount == plain.payment_amount
    days = shift_days(KEY, b"M0017")
    moved = R.read_835(spark, f"{folder}/a.835", "services", mask_key=KEY, mask_dates="shift").first()
    assert moved.service_date == datetime.date(2025, 1, 10) + datetime.timedelta(days=days)
    kept = R.read_835(spark, f"{folder}/a.835", mask_key=KEY, mask_dates="keep").first()
    assert kept.statement_from == plain.statement_from
    assert token(b"a-secret-of-at-least-16-bytes", "name", b"DOE") == b"3955b11ab0c58e93"


def test_findings_hide_patient_data(spark, tmp_path):
    (tmp_path / "x.835").write_bytes(sample(("NM1*QC*1*GREEN", "NM1*QC*1*GREEN*AVA****MI*" + "M" * 90)))
    (f,) = R.read_835(spark, str(tmp_path / "x.835"), "diagnostics", mask_key=KEY).filter("kind = 'LengthOutOfRange'").collect()
    assert f.datum == token(KEY, "id", b"M" * 90).decode()


def test_summaries(spark, folder):
    tables = R.parse_file(spark, f"{folder}/a.835").tables
    spec = builtin()
    assert summary.summary(spec, tables, "count_claims") == 2
    assert summary.summary(spec, tables, "count_patients") == 2
    assert str(summary.summary(spec, tables, "sum_payments")) == "205.50"
    assert summary.summary(spec, tables, "payer")["city"] == "DENVER"
    with pytest.raises(SummaryError):
        summary.summary(spec, tables, "none")
    with pytest.raises(SummaryError):
        summary.summary(spec, R.parse_file(spark, f"{folder}/*.835").tables, "payer")


def test_batches_of_closed_loops(spark, folder):
    r = R.parse_file(spark, f"{folder}/a.835")
    rows = {(x.row, x.batch) for x in r.batches("services", "2100").collect()}
    assert rows == {(0, 0), (1, 0)}
    assert {(x.row, x.batch) for x in r.batches("claims", "2100").collect()} == {(0, 0), (1, 1)}
    assert [x.batch for x in r.batches("payments", "2100").collect()] == [2]
    with pytest.raises(Exception, match="unknown loop"):
        r.batches("claims", "none")


def test_sql(spark, folder):
    register(spark)
    df = spark.read.format("x835").option("table_name", "claims").option("filename", "true").load(f"{folder}/*.835")
    assert df.count() == 4 and df.columns[-1] == "filename"
    R.files(spark, f"{folder}/*.835").createOrReplaceTempView("files")
    got = spark.sql("SELECT f.filename, sum(t.payment_amount) AS paid FROM files f, LATERAL parse_835(f.content, 'claims') t GROUP BY 1 ORDER BY 1").collect()
    assert [str(r.paid) for r in got] == ["195.50", "195.50"]
    assert spark.sql("SELECT * FROM schema_835('5010') WHERE table_name = 'claims'").count() == 28


def test_views(spark, folder, tmp_path):
    r = R.parse_file(spark, f"{folder}/a.835")
    (view,) = json_view(r).collect()
    assert '"claim_id":"A-17"' in view.view
    assert csv_lines(spark.createDataFrame([("=1", 'a"b', None)], "a string, b string, c string")).first().line == "'=1,\"a\"\"b\","
    assert filtered(r.table("claims"), "green").count() == 1
    assert "∅" in render("t", [("a", "binary", 0, None)], [[None]])
    lake(r, str(tmp_path / "lake"))
    back = spark.read.parquet(str(tmp_path / "lake"))
    assert {x.payer for x in back.collect()} == {"HILL PLAN"} and back.count() == 2


def test_structure_frames(spark, folder):
    r = R.parse_file(spark, f"{folder}/a.835")
    segments = r.segments().orderBy("segment").collect()
    assert b"".join(bytes(s.raw) for s in segments) == sample()
    assert segments[16].path.endswith("2100#1") and segments[16].occurrence == "statement_from_or_to_date"
    nodes = {n.node: n for n in r.nodes().collect()}
    services = [n for n in nodes.values() if n.loop == "2110"]
    assert [nodes[n.parent].loop for n in services] == ["2100", "2100"]


def test_wide_frame(spark, folder):
    f = compat.frame(R.files(spark, f"{folder}/a.835"))
    rows = f.orderBy("service").collect()
    assert len(rows) == 2 and rows[0].patient == "Ava Green" and rows[0].allowed_amount == 90.5 and rows[1].allowed_units == 2
    assert rows[1].adj_0_code == "1" and rows[0].payer == "HILL PLAN" and rows[0].payer_classification == "primary"
    more = compat.frame(R.files(spark, f"{folder}/a.835"), extended=True)
    assert {r.x_row_kind: r.n for r in more.groupBy("x_row_kind").count().withColumnRenamed("count", "n").collect()} == {"service": 2, "claim": 1, "provider_adjustment": 1}
    (c,) = compat.counts(R.files(spark, f"{folder}/a.835")).collect()
    assert (c.count_claims, c.count_patients, c.sum_payments) == (2, 2, 205.5)
    v = compat.claim_views(R.files(spark, f"{folder}/a.835")).filter("claim = 0").first()
    assert len(v.services) == 2 and v.services[0].code == "99214" and v.status == "processed as primary" and v.dates[0].qualifier == "claim statement period start"
    assert compat.widths(f) == {"adj": 1, "ref": 1, "rem": 0}
    assert compat.appearance(f)[:3] == ["adj_0_group", "adj_0_code", "adj_0_amount"]
    files = R.files(spark, f"{folder}/a.835")
    assert compat.payment_views(files).first().payment_method == "automatic deposit"
    assert {r.type for r in compat.organization_views(files).collect()} == {"payer", "payee"} and compat.interchange_views(files).first().sender == "HILLPLAN"
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


def test_many_files_of_a_folder(spark, folder):
    assert R.parse_many(spark, folder).table("claims").count() == 4


def test_arriving_files(spark, folder, tmp_path):
    q = intake(spark, folder, str(tmp_path / "out"), str(tmp_path / "cp"), ["claims"], worst_level=3, pattern="*.835")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/claims")).count() == 2
    rejected = spark.read.parquet(str(tmp_path / "out/rejected")).collect()
    assert [os.path.basename(r.filename) for r in rejected] == ["b.835"]
    q = stream_table(spark, folder, "payments").writeStream.format("memory").queryName("pays").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("pays").count() == 2


def test_external_findings(spark, folder):
    from remitta.operators.external import all_findings, external_findings, hidden, required

    def validator(data):
        yield "A1", "the name GREEN looks odd", data.index(b"NM1*QC"), b"GREEN"
        yield "A2", "no place", None, b""

    files = R.files(spark, f"{folder}/a.835")
    a, b = external_findings(files, validator, "other", mask_key=KEY).collect()
    assert (a.kind, a.segment, a.code, a.origin) == ("External", 14, "A1", "other") and b.segment is None
    assert "GREEN" not in a.rule and a.datum == token(KEY, "name", b"GREEN").decode() and a.path.endswith("2100#1")
    (f,) = external_findings(files, lambda data: 1 / 0, "other").collect()
    assert (f.level, f.segment) == (1, None) and "ZeroDivisionError" in f.rule
    assert all_findings(files, validator, "other").count() == 2
    assert hidden("AB and CAB, ABCD", {"AB": "x", "ABCD": "y"}) == "x and CAB, y"
    with pytest.raises(ImportError, match="not installed"):
        required("no_such_package")


def test_native_lexer_agrees(spark, folder):
    from remitta.operators import native_lexer
    from remitta.operators.lexer import BOM

    files = R.files(spark, f"{folder}/a.835").unionByName(spark.createDataFrame([("bom", bytearray(BOM + b" \n" + sample(end="~") + b"\n")), ("none", bytearray(b"x"))], "filename string, content binary"))
    ours = R.Remittance(files, ignore_errors=True).segments().collect()
    native = native_lexer.segments(files, spans=True).collect()
    want = {(r.filename, r.segment): (r.id, [[p.decode("latin-1") for p in e] for e in r.elements], r.terminated, r.raw_start, r.raw_end) for r in ours}
    assert {(r.filename, r.segment): (r.id, r["elements"], r.terminated, r.raw_start, r.raw_end) for r in native} == want
    assert native_lexer.delimiters_of(files).filter("repetition = '^'").count() == 2


def test_native_lexer_skips_any_amount_of_blanks(spark):
    from remitta.operators import native_lexer

    data = [("plain", bytearray(sample())), ("blanks", bytearray(b" \r\n" * 3000 + sample()))]
    got = native_lexer.segments(spark.createDataFrame(data, "filename string, content binary")).collect()
    of = lambda name: sorted((r.segment, r.id, r["elements"]) for r in got if r.filename == name)
    assert of("plain") and of("blanks") == of("plain")


def test_sql_finds_calls_only_where_they_stand(spark, folder):
    from remitta.errors import ReadError
    from remitta.sources.sql import sql

    q = f"""SELECT '{{x}} read_835(' AS text, c.claim_id, p.payer_name -- read_835('none')
        FROM read_835(array('{folder}/a.835', '{folder}/b.835'), table_name => 'claims', filename => true) c /* read_835( */
        JOIN READ_835('{folder}/*.835', table_name := 'payments', filename := TRUE) AS p ON c.filename = p.filename AND c.payment = p.row ORDER BY 2"""
    got = sql(spark, q).collect()
    assert [r.claim_id for r in got] == ["A-17", "A-17", "A-18", "B-1"] and got[0].text == "{x} read_835(" and got[0].payer_name == "HILL PLAN"
    masked = sql(spark, f"SELECT * FROM read_835('{folder}/a.835', mask_key := X'{KEY.hex()}', mask_dates := 'keep')").first()
    assert masked.claim_id == token(KEY, "id", b"A-17").decode() and masked.statement_from == datetime.date(2025, 1, 10)
    for bad in ("read_835()", "read_835('a', 'b')", "read_835(NULL)", "read_835('a', binary := 'yes')", "read_835(['a', NULL])", "read_835('a'"):
        with pytest.raises(ReadError):
            sql(spark, f"SELECT * FROM {bad}")


def test_several_paths_of_the_data_source(spark, folder):
    register(spark)
    both = spark.read.format("x835").option("table_name", "payments").load([f"{folder}/a.835", f"file://{folder}/b.8*"])
    assert both.count() == 2
    with pytest.raises(Exception, match="can't be 'maybe'"):
        spark.read.format("x835").option("binary", "maybe").load(f"{folder}/a.835").count()
    with pytest.raises(Exception, match="unknown option 'colour'"):
        spark.read.format("x835").option("colour", "red").load(f"{folder}/a.835").count()


def test_headers_of_any_length(spark):
    from remitta.operators.engine import version_of
    from remitta.operators.lexer import delimiters

    assert delimiters(b" \r\n" * 5000 + sample()) == delimiters(sample())
    old = sample(("GS*", "TA1*1*250301*1215*A*000~" * 4000 + "GS*HP*A*B*20250301*1215*7*X*004010X091A1"), lines=None)
    assert version_of(old, delimiters(old)) == "4010"


def test_one_pass_reads_as_many(spark, folder):
    files = R.files(spark, f"{folder}/[ab].835")
    r = R.Remittance(files)
    once = r.once()
    for name in [*builtin().table_names, "diagnostics"]:
        a, b = r.table(name), once.table(name)
        assert a.columns == b.columns and a.exceptAll(b).count() == b.exceptAll(a).count() == 0, name
    masked = R.Remittance(files, mask_key=KEY)
    assert masked.table("claims").exceptAll(masked.once(["claims"]).table("claims")).count() == 0
