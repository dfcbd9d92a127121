import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from samples import sample

from remitta.errors import CopyError, WriteError
from remitta.operators import writer as W
from remitta.operators.lexer import Delimiters
from remitta.plans.builtin import builtin
from remitta.sources import remittance as R

ENVELOPE = W.Envelope("HILLPLAN", "LAKECLINIC", "20250301", "1215", usage="T", line_break=True)


@pytest.fixture(scope="module")
def tables(spark):
    return {k: v.drop("filename").cache() for k, v in R.parse(spark, sample()).tables.items()}


def test_round_trip(spark, tables):
    data = W.write(tables, ENVELOPE)
    assert data.startswith(b"ISA*00*          *00*          *ZZ*HILLPLAN       *ZZ*LAKECLINIC     *250301*1215*^*00501*000000001*0*T*:~\nGS*HP*HILLPLAN*LAKECLINIC*20250301*1215*1*X*005010X221A1~\nST*835*0001~\n")
    again = R.parse(spark, data).tables
    for name, df in tables.items():
        a, b = (x.drop("segment", "filename") for x in (df, again[name]))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0, name


def test_findings_stop_the_write(spark, tables):
    wrong = tables | {"claims": tables["claims"].withColumn("payment_amount", F.when(F.col("row") == 0, Decimal("130.50")).otherwise(F.col("payment_amount")).cast("decimal(38,2)"))}
    with pytest.raises(WriteError) as e:
        W.write(wrong, ENVELOPE)
    assert [(f["table"], f["row"], f["column"]) for f in e.value.findings] == [("claims", 0, "charge_amount"), ("payments", 0, "total_payment_amount")]
    assert "(2 findings); nothing was written" in str(e.value)
    data, findings = W.write(wrong, ENVELOPE, allow_findings=True)
    assert len(findings) == 2 and data


@pytest.mark.parametrize(
    ("table", "column", "value", "kind"),
    [
        ("services", "claim", "9L", "MissingParent"),
        ("claims", "payment", "cast(null as bigint)", "MissingParent"),
        ("services", "payment", "3L", "MissingParent"),
        ("claims", "row", "0L", "DuplicateRowNumber"),
        ("claims", "claim_id", "'A*1'", "DelimiterInValue"),
        ("claims", "claim_status", "'99'", "ReadBack"),
    ],
)
def test_each_finding(spark, tables, table, column, value, kind):
    _, findings = W.write(tables | {table: tables[table].withColumn(column, F.expr(value))}, ENVELOPE, allow_findings=True)
    assert kind in {f["kind"] for f in findings}, findings


def test_release_byte_instead_of_a_finding(spark, tables):
    d = Delimiters(repetition=b"^", release=b"?")
    claims = tables["claims"].withColumn("claim_id", F.lit("A*?1"))
    data, findings = W.write(tables | {"claims": claims}, W.Envelope("HILLPLAN", "LAKECLINIC", "20250301", "1215", delimiters=d), allow_findings=True)
    assert findings == [] and b"A?*??1" in data
    assert R.parse(spark, data, delimiters=d).table("claims").first().claim_id == "A*?1"


def test_types_are_checked(tables):
    with pytest.raises(CopyError, match="exact decimals"):
        W.write({"claims": tables["claims"].withColumn("payment_amount", F.lit(1.5))}, ENVELOPE)
    with pytest.raises(WriteError, match="has no column"):
        W.write({"claims": tables["claims"].withColumn("zzz", F.lit(1))}, ENVELOPE)
    with pytest.raises(WriteError, match="unknown table"):
        W.write({"zzz": tables["claims"]}, ENVELOPE)
    with pytest.raises(ValueError, match="same byte"):
        W.write(tables, W.Envelope("A", "B", "20250301", "1215", delimiters=Delimiters(segment=b"*")))


def test_4010(spark, tables):
    data, _ = W.write(tables, W.Envelope("HILLPLAN", "LAKECLINIC", "20250301", "1215", delimiters=Delimiters()), builtin("4010"), allow_findings=True)
    assert b"*U*00401*" in data and b"004010X091A1" in data


def test_copy(spark, tables, tmp_path):
    struct = None
    for name, df in tables.items():
        one = df.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name))
        struct = one if struct is None else struct.crossJoin(one)
    row = struct.select(F.struct(*tables).alias("s"))
    path = str(tmp_path / "out.835")
    options = {"sender_id": "HILLPLAN", "receiver_id": "LAKECLINIC", "date": datetime.date(2025, 3, 1), "time": datetime.time(12, 15), "usage_indicator": "T", "line_break": True}
    n = W.copy_835(spark, row, path, **options)
    data = (tmp_path / "out.835").read_bytes()
    assert len(data) == n and data == W.write(tables, ENVELOPE)
    for bad in ({"zzz": 1}, {"time": datetime.time(1, 1, 1, 5)}, {"version": "1"}, {"delimiters": {"element": "**"}}, {"delimiters": {"x": "*"}}, {"sender_id": None}, {"compression": "gzip"}, {"line_break": 1}):
        with pytest.raises(CopyError):
            W.copy_835(spark, row, path, **(options | bad))
    with pytest.raises(CopyError, match="STRUCT"):
        W.copy_835(spark, spark.range(1), path, **options)
    with pytest.raises(CopyError, match="missing"):
        W.copy_835(spark, row, path)


def test_files_by_name(spark):
    both = spark.createDataFrame([("a", bytearray(sample())), ("b", bytearray(sample(("CLP*A-18", "CLP*A-18*4*80*75*0*12*PC18*11*1"))))], "filename string, content binary")
    out = {r.filename: r for r in W.write_files(R.Remittance(both).tables, ENVELOPE).collect()}
    assert out["a"].content and not out["a"].findings
    assert out["b"].content is None and out["b"].findings[0].table == "claims"


def test_packing_and_runs(spark):
    df = spark.createDataFrame([("f", i, 1 if i < 8 else 2) for i in range(10)], "filename string, row bigint, g int")
    got = {(r.island, r.part): r.n for r in W.packed(df, ["filename", "g"], 6).groupBy("island", "part").count().withColumnRenamed("count", "n").collect()}
    assert got == {(0, 0): 6, (0, 1): 2, (1, 0): 2}


def test_values_without_a_form(spark, tables):
    spec = builtin().patch({"segments": {"DTM": {"elements": {"2": {"min": 6, "max": 6}}}}})
    data, findings = W.write(tables, ENVELOPE, spec, allow_findings=True)
    assert findings == [] and b"DTM*232*250110~" in data
    old = tables["claims"].withColumn("statement_from", F.expr("date'1949-12-31'"))
    data, findings = W.write(tables | {"claims": old}, ENVELOPE, spec, allow_findings=True)
    assert {f["kind"] for f in findings} >= {"NotWritable"} and "1949-12-31" in findings[0]["message"]


def test_only_values_with_delimiters_are_looked_at(monkeypatch):
    """A segment's delimiters are counted; values are looked at one by one only if there are too many."""
    from samples import run

    from remitta.operators.writer import Assembler, Envelope, Plan, Record

    def assembler(change: bytes | None = None) -> Assembler:
        r, rows = run(sample(), events=False), {}
        for t in r.spec.tables:
            width = len(t.parents)
            rows[t.name] = [Record(t.name, v[0], v[1], v[2 : 2 + width], [x if x is None or isinstance(x, bytes) else str(x).replace("-", "").encode() if hasattr(x, "year") else str(x).encode() for x in v[2 + width :]]) for v, _ in r.project.take(t.name)]
        if change:
            rows["claims"][0].cells[[c.name for c in r.spec.table("claims").columns].index("patient_last_name")] = change
        return Assembler(r.spec, Plan(r.spec), Envelope("PAYER", "PAYEE", "20250301", "1215"), rows)

    wrong = assembler(b"A*B")
    wrong.file()
    assert [f["kind"] for f in wrong.findings] == ["DelimiterInValue"] and wrong.broken
    monkeypatch.setattr(Assembler, "_safe", None)
    data = assembler().file()
    assert b"~NM1*QC*1*GREEN*AVA****MI*M0017~" in data and b"~SVC*HC:99214*100.00*90.50**1" in data


def test_rows_of_a_file_as_plain_values():
    import pyarrow as pa

    from remitta.operators.writer import _plain

    lists = pa.chunked_array([pa.array([[b"a", None], None, []], pa.list_(pa.binary())).slice(0, 2), pa.array([[b"b"]] * 2, pa.list_(pa.binary())).slice(1)])
    assert _plain(lists) == [[b"a", None], [], [b"b"]]
    numbers = pa.chunked_array([pa.array([1 << 60, None]), pa.array([(1 << 60) + 1])])
    assert _plain(numbers) == [1 << 60, None, (1 << 60) + 1] and _plain(pa.chunked_array([pa.array(["x", None])])) == ["x", None]
