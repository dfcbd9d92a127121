import datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import ISA, LINES, kinds, run, sample, table

from remitta.operators.lexer import BOM, Delimiters, Document, NotAnInterchange, delimiters, segments
from remitta.plans.builtin import builtin
from remitta.plans.spec import Spec, SpecError


def test_a_clean_file_has_no_findings():
    assert run(sample()).found == []


def test_rows_of_all_tables():
    r = run(sample())
    (p,) = table(r, "payments")
    assert p["total_payment_amount"] == Decimal("205.50") and p["payment_date"] == datetime.date(2025, 3, 3)
    assert p["payer_technical_contact_number"] == b"3035550101" and p["payee_id"] == b"1098765432" and p["payer_id"] is None
    a, b = table(r, "claims")
    assert (a["row"], a["payment"], a["header_number"], b["header_number"]) == (0, 0, 1, 2)
    assert a["statement_to"] == datetime.date(2025, 1, 11) and b["statement_to"] is None
    s = table(r, "services")
    assert [(x["claim"], x["procedure_code"], x["units_paid"]) for x in s] == [(0, b"99214", Decimal(1)), (0, b"36415", Decimal(2))]
    assert s[0]["allowed_amount"] == Decimal("90.50") and s[1]["line_item_control_number"] == b"L2"
    adj = table(r, "adjustments")
    assert [(x["service"], x["group_code"], x["reason_code"], x["amount"], x["quantity"]) for x in adj] == [
        (0, b"CO", b"45", Decimal("9.50"), None), (1, b"PR", b"1", Decimal(10), None), (1, b"PR", b"2", Decimal(10), Decimal(1)),
    ]
    (plb,) = table(r, "provider_adjustments")
    assert (plb["reason_code"], plb["reference_id"], plb["amount"]) == (b"WO", b"X1", Decimal(-10))


def test_a_claim_adjustment_has_no_service_and_empty_groups_are_skipped():
    r = run(sample(("NM1*QC*1*GREEN", "CAS*OA*23*5*****94*7~NM1*QC*1*GREEN*AVA****MI*M0017")))
    first = table(r, "adjustments")[:2]
    assert [(x["service"], x["reason_code"], x["amount"]) for x in first] == [(None, b"23", Decimal(5)), (None, b"94", Decimal(7))]


def test_absent_text_is_null_and_empty_text_is_empty():
    r = run(sample(("SVC*HC:99214", "SVC*HC:*100*90.5**1")))
    assert table(r, "services")[0]["procedure_code"] == b""
    (p,) = table(r, "payments")
    assert p["payer_id"] is None
    assert p["payment_format"] == b"CCP"


@pytest.mark.parametrize(
    ("change", "kind", "text"),
    [
        (("SE*29", "SE*30*0009"), "ControlCountMismatch", 'SE01 declares "30" but the count is 29'),
        (("GE*1*7", "GE*1*8"), "ControlNumberMismatch", 'GE02 "8" does not match GS06 "7" of segment #1'),
        (("GE*1*7", "GE*1"), "ControlElementMissing", "control element GE02 is missing: the segment has no element 2"),
        (("SE*29", None), "UnterminatedLoop", 'loop "transaction" opened at segment #2 closed without its end segment "SE"'),
        (("LX*2", "ZZ*1"), "UnknownSegment", 'segment "ZZ" is not part of the structure'),
        (("TRN", "TRN*1*TRC77*199988877"), "LengthOutOfRange", "element TRN03 (payer_identifier) has length 9; the spec allows 10 to 10"),
        (("DTM*232*20250110", "DTM*232*20250230"), "TypeMismatch", "element DTM02 (date) is not a valid DT (date CCYYMMDD or YYMMDD)"),
        (("CLP*A-18", "CLP*A-18*77*75*75*0*12*PC18*11*1"), "CodeNotInList", "element CLP02 (claim_status_code) is not one of the 10 codes the spec lists for it"),
        (("SVC*HC:99214", "SVC*HC:99214:1:2:3:4:5:6:7*100*90.5**1"), "CompositeShape", "element SVC01 (composite_medical_procedure_identifier) has 9 components; the spec declares 8"),
        (("PER*BL", None), "RequiredOccurrenceMissing", 'closed without its required occurrence "payer_technical_contact_information" ("PER" where PER01 is "BL")'),
        (("N1*PE", None), "RequiredLoopMissing", 'closed without its required child loop "1000B" (trigger "N1" where {1: "PE"})'),
        (("TRN", "TRN*1*TRC77*1999888777~TRN*1*TRC78*1999888777"), "OccurrenceOverMax", 'occurrence "reassociation_trace_number" ("TRN") of loop "transaction" appears 2 times'),
        (("N1*PE", "N1*PE*LAKE CLINIC*XX*1098765432~N1*PE*OTHER*XX*1098765432"), "LoopOverMax", 'loop "1000B" has 2 instances under one instance of loop "transaction"; the spec allows at most 1'),
        (("N1*PR", "N1*PR*HILL PLAN~TRN*1*TRC77*1999888777"), "OutOfOrder", 'occurrence "reassociation_trace_number" (position 10400) of loop "transaction" comes after occurrence "payer_identification" (position 10800) of loop "1000A"'),
        (("REF*EV", "REF*QQ*LK01"), "UnknownOccurrence", 'segment "REF" matches none of the 2 occurrences loop "transaction" declares for it ("receiver_identification", "version_identification"): REF01 holds none'),
        (("CLP*A-18", "CLP*A-18*4*80*75*0*12*PC18*11*1"), "BalanceMismatch", "is 5.00, but sum of CAS03"),
        (("SVC*HC:36415", "SVC*HC:36415**30**2"), "RequiredElementMissing", "required element SVC02 (line_item_charge_amount) is missing or empty"),
    ],
)
def test_each_finding(change, kind, text):
    found = [f for f in run(sample(change)).found if f.kind == kind]
    assert any(text in f.rule for f in found), [f.message() for f in run(sample(change)).found]


def test_byte_order_mark_is_reported_and_kept():
    data = BOM + sample()
    assert kinds(data) == ["ByteOrderMark"]
    assert Document(data).write() == data


def test_a_length_fault_hides_the_code_fault_and_keeps_the_value():
    r = run(sample(("NM1*QC*1*GREEN", "NM1*QC*12*GREEN*AVA****MI*M0017")))
    assert [f.kind for f in r.found] == ["LengthOutOfRange"]
    r = run(sample(("CLP*A-18", "CLP*A-18*77*75*75*0*12*PC18*11*1")))
    assert table(r, "claims")[1]["claim_status"] == b"77"


def test_implicit_loops():
    lines = [x for x in LINES if not x.startswith(("GS", "GE", "IEA"))]
    data = "".join(x + "~" for x in lines).encode()
    r = run_without_header(data)
    assert [f.kind for f in r.found[:2]] == ["ImplicitLoop", "ImplicitLoop"]
    assert len(table(r, "claims")) == 2


def run_without_header(data):
    from remitta.operators.engine import Run

    spec = builtin()
    return Run(data, spec, Delimiters(), spec.table_names, True, True).all()


def test_balance_is_skipped_for_what_is_not_an_amount():
    assert "BalanceMismatch" not in kinds(sample(("CLP*A-18", "CLP*A-18*4*7x*75*0*12*PC18*11*1")))


def test_versions():
    old = sample(("GS*HP", "GS*HP*HILLPLAN*LAKECLINIC*20250301*1215*7*X*004010X091A1"), ("ISA", ISA.replace("*^*00501", "*U*00401")))
    assert run(old).spec is builtin("4010")
    assert run(sample()).spec is builtin("5010")


def test_events_and_instances_balance():
    r = run(sample())
    opened = sum(e.kind.startswith("open") for e in r.events)
    assert opened == sum(e.kind == "close" for e in r.events) == r.instances
    captured = [e.segment for e in r.events if e.kind in ("cap", "empty", "unmatched")]
    assert captured == list(range(len(captured)))


def test_rows_number_over_transactions():
    lines = [LINES[0], *LINES[1:30], *LINES[1:30], "GE*2*7", "IEA*1*000000042"]
    r = run(sample(lines=lines))
    assert r.found == []
    assert [(c["row"], c["payment"]) for c in table(r, "claims")] == [(0, 0), (1, 0), (2, 1), (3, 1)]


# Lexing


@pytest.mark.parametrize("data", [b"", b"hello", b"ISA*00*", b"ISA" + b"*" * 16])
def test_not_an_interchange(data):
    with pytest.raises(NotAnInterchange):
        delimiters(data)


def test_delimiters_are_counted_not_measured():
    d = delimiters(b"ISA|a|b|c|d|e|f|g|h|i|j|^|00501|1|0|T|>!GS|x!")
    assert (d.element, d.component, d.segment, d.repetition) == (b"|", b">", b"!", b"^")
    assert delimiters(b"ISA|a|b|c|d|e|f|g|h|i|j|U|00401|1|0|T|>!").repetition is None


def test_release_byte():
    d = Delimiters(release=b"?")
    (s,) = segments(b"AA*1?*2*x?:y:z*e??*q?", d)
    assert [s.text(i) for i in range(1, 5)] == [b"1*2", b"x:y:z", b"e?", b"q"]
    assert s.leaf(2, 2) == b"z"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_segments_join_to_the_input(tail):
    data = ISA.encode() + b"~" + tail
    assert Document(data).write() == data


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(LINES), max_size=40))
def test_any_order_of_segments_is_taken_in(lines):
    r = run(sample(lines=lines or ["GS"]))
    assert sum(e.kind == "cap" for e in r.events) + sum(e.kind == "unmatched" for e in r.events) == len(lines or ["GS"]) + 1
    claim = r.spec.loop("2100").index
    assert len(table(r, "claims")) == sum(e.kind.startswith("open") and e.loop == claim for e in r.events)


# The specification


def test_patches():
    spec = builtin().patch({"tables": {"claims": {"columns": {"contract_class": {"segment": "REF", "where": {"1": "CE"}, "element": 2}}}}})
    r = run(sample(("DTM*233", "DTM*233*20250111~REF*CE*GOLD"), ("SE*29", "SE*30*0009")), spec)
    assert table(r, "claims")[0]["contract_class"] == b"GOLD"
    assert Spec.from_json(spec.to_json()).to_json() == spec.to_json()


@pytest.mark.parametrize(
    ("patch", "text"),
    [
        ({"loops": {"2110": None}, "tables": {"services": None, "adjustments": {"loops": ["2100"]}}}, 'balancing rule "claim_balance": sum[1].loop names loop "2110"'),
        ({"nothing": 1}, "unknown key nothing"),
        ({"tables": {"claims": {"columns": {"row": {"segment": "CLP", "element": 1}}}}}, "reserved"),
        ({"tables": {"claims": {"columns": {"x": {"segment": "CLP", "element": 3, "phi": "id"}}}}}, "phi"),
        ({"tables": {"claims": {"loops": ["2000", "2100"]}}}, "sits inside"),
        ({"loops": {"1000B": {"trigger": {"where": {"1": "PR"}}}}}, "same trigger"),
        ({"segments": {"CLP": {"elements": {"3": {"type": "XX"}}}}}, "must be AN, ID"),
        ({"summaries": {"x": {"sum": {"table": "claims", "column": "claim_id"}}}}, "holds no decimals"),
        ({"default_table": "none"}, "default_table"),
        ({"loops": {"2100": {"occurrences": {"insured_name": {"qualifier": {"codes": ["QC"]}}}}}}, "share the qualifier code"),
    ],
)
def test_patches_that_are_refused(patch, text):
    with pytest.raises(SpecError, match="(?s).*" + __import__("re").escape(text)):
        builtin().patch(patch)


def test_structure_of_the_built_in_specification():
    spec = builtin()
    assert [x.name for x in spec.loops] == ["1000A", "1000B", "2000", "2100", "2110", "group", "interchange", "transaction"]
    assert [len(t.columns) for t in spec.tables] == [4, 25, 27, 5, 9]
    assert spec.table("adjustments").parents == ["payments", "claims", "services"]
    assert {x.name for x in spec.loops if x.required} == {"interchange", "group", "transaction", "1000A", "1000B", "2100"}
    assert len(spec.segments) == 30
    assert len(builtin(wide=True).tables) == 17
