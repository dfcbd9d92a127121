"""Files are read once by what needs them once."""

import pytest
from pyspark.sql import functions as F
from samples import sample

from remitta.operators import compat


@pytest.fixture
def counted(spark):
    """Files, and how often one was read so far."""
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    alone = sample(("SVC*HC:36415", None), ("DTM*472*20250111", None), ("CAS*PR*1*10", None), ("REF*6R", None))
    rows = [(f"{i}.835", bytearray(x)) for i, x in enumerate((sample(), alone))]
    return spark.createDataFrame(rows, "filename string, content binary").coalesce(1).mapInArrow(run, "filename string, content binary"), reads


def test_extended_frame(counted):
    files, reads = counted
    got = compat.frame(files, extended=True, widest=1).select("filename", "x_row_kind", "service", "marker", "allowed_units", "was_forwarded", "x_plb_amount").collect()
    assert reads.value == 2
    kinds = sorted((r.filename, r.x_row_kind, r.service) for r in got if r.x_row_kind == "service")
    assert kinds == [("0.835", "service", 0), ("0.835", "service", 1), ("1.835", "service", 0)]
    assert [(r.marker, r.service, r.allowed_units, r.was_forwarded is None) for r in got if r.x_row_kind == "claim"] == [("A-18", None, None, False)] * 2
    assert [(r.marker, r.was_forwarded, r.x_plb_amount) for r in got if r.x_row_kind == "provider_adjustment"] == [(None, None, -10.0)] * 2


def test_order_of_appearance(counted):
    files, reads = counted
    assert compat.appearance(compat.frame(files)) == ["adj_0_group", "adj_0_code", "adj_0_amount", "ref_0_qual", "ref_0_value"]
    assert reads.value == 2


def test_failures_parse_headers_only(spark, monkeypatch, tmp_path):
    from remitta.sources import remittance as R

    for name, data in (("a.txt", b"no interchange"), ("b.835", sample()), ("c.DAT", sample(("CLP*A-17", "CLP*A-17*1*1"))), ("d.log", b"")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "x.835").mkdir()
    (tmp_path / "x.835" / "e.835").write_bytes(sample())
    r = R.parse_many(spark, str(tmp_path))
    monkeypatch.setattr(R, "parse_files", None)  # no table and no findings are needed
    with pytest.warns(UserWarning, match="a.txt"):
        ((name, why),) = R.failures(r)
    assert name.endswith("/a.txt") and "ISA" in why
    monkeypatch.undo()
    assert {n.rsplit("/", 1)[1] for n in (x.filename for x in r.table("claims").select("filename").distinct().collect())} == {"b.835", "c.DAT"}


def test_json_view(counted):
    import json

    from remitta.sources.remittance import Remittance
    from remitta.sources.views import json_view

    files, reads = counted
    views = {r.filename: json.loads(r.view) for r in json_view(Remittance(files)).collect()}
    assert reads.value == 2
    v = views["0.835"]
    assert [len(v[n]) for n in ("claims", "services", "payments")] == [2, 2, 1] and v["claims"][0]["charge_amount"] == "150.00"
    assert {"node": 0, "implicit": "false"} == v["nodes"][0] and v["segments"][2]["raw"].startswith("\nST*835*0009") and "statement_to" not in v["claims"][1]
