"""The adapter of the other validator, with a stand-in for the package."""

import json

import pytest
from samples import sample

from remitta.operators.external import hidden
from remitta.operators.pyx12 import pieces, pyx12_validator, run_pyx12


def node(**more):
    return {"errors": [], **more}


def error(code, text, value=None, x12=None):
    return {"err_cde": code, "x12_code": x12, "err_str": text, "err_val": value}


def stand_in(report, done=(1,), ok=False, failure=None):
    return pyx12_validator(lambda text: (json.dumps(report) if report is not None else "", list(done), ok, failure))


def test_errors_land_on_their_segments():
    data = b"\xef\xbb\xbf\n" + sample()
    segment = {"cur_line": 14, "errors": [error("SEG_8_has_data_element_errors", "rollup"), error("SEG_X", "odd", x12="8")], "elements": [{"ele_pos": 3, "subele_pos": 1, "errors": [error("7", "bad code", "GREEN")]}]}
    st = {"errors": [error("4", "wrong count", "29")], "segments": [segment]}
    report = {"interchanges": [{"errors": [error("023", "no trailer")], "groups": [{"errors": [error("5", "sets")], "transactions": [st]}]}]}
    got = list(stand_in(report)(data))
    at = lambda x: data.index(x)
    assert [(g[0], g[2]) for g in got] == [("023", at(b"ISA")), ("5", at(b"GE*")), ("4", at(b"SE*")), ("8", at(b"CLP*A-17")), ("7", at(b"CLP*A-17"))]
    assert got[3][1] == "odd (SEG_X)"
    assert got[4][3:] == (b"GREEN", 2, 3, 1) and got[0][4:] == (1, 13) and got[2][4:] == (1, 1)


def test_failures_are_findings():
    data = sample()
    (f,) = stand_in(None, done=[1, 2], failure=ValueError("x"))(data)
    assert f[0] is None and f[4] == 1 and data[f[2] : f[2] + 3] == b"ST*" and "ValueError: x" in f[1]
    (f,) = stand_in(None, done=[])(data)
    assert "rejected" in f[1] and f[2] == 0
    assert list(stand_in(None, done=[1], ok=True)(data)) == []
    with pytest.raises(ImportError, match="pyx12"):
        run_pyx12("")


def test_pieces_stop_at_an_empty_one():
    assert pieces("ab~\ncd~~ef~", "~") == [0, 4]


def test_hidden_values_are_replaced_once():
    assert hidden("the 1402 and 6346", {"6346": "x1402y", "1402": "z"}) == "the z and x1402y"
