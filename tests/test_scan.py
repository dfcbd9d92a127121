"""Files by columns: the same rows as stepping through them, and clean only if that finds nothing."""

import pyarrow as pa
import pytest
from samples import sample

from remitta.operators.engine import Run
from remitta.operators.lexer import Delimiters, delimiters
from remitta.operators.scan import decimals, scanned
from remitta.plans.builtin import builtin
from remitta.sources import remittance, views
from remitta.sources.remittance import Options, Remittance, _Cells


def changed(data: bytes):
    """The file with each segment left out, doubled, moved, and each element emptied, cut or changed."""
    segments = data.split(b"~")
    for i in range(1, len(segments)):
        rest = lambda *new: b"~".join([*segments[:i], *new, *segments[i + 1 :]])  # noqa: E731, B023
        yield rest()
        yield rest(segments[i], segments[i])
        yield rest(b"\r\n" + segments[i])
        yield rest(b" ", segments[i])
        if i + 1 < len(segments):
            yield b"~".join([*segments[:i], segments[i + 1], segments[i], *segments[i + 2 :]])
        pieces = segments[i].split(b"*")
        for k in range(1, len(pieces)):
            for new in (b"", b"1", b"-1.50", b".5", b"1e3", b"A:B", b"2025011", b"X" * 90, b"\xff"):
                yield rest(b"*".join([*pieces[:k], new, *pieces[k + 1 :]]))
        for new in (b"*", b"*1", b"*:", b":A"):
            yield rest(segments[i] + new)


@pytest.mark.parametrize("version, wide, every", [("5010", False, 3), ("4010", False, 17), ("5010", True, 17)])
def test_equal_to_stepping(version, wide, every):
    spec, taken, clean = builtin(version, wide), 0, 0
    names = [t.name for t in spec.tables]
    cells = {n: _Cells(Options(n, version=version, wide=wide, binary=True)) for n in names}
    data = sample()
    for x in (data, data + b"\n\n", data.rstrip(b"~\n"), data.replace(b"~", b"|").replace(b"*", b"+"), b"\xef\xbb\xbf" + data, *list(changed(data))[::every]):
        d = delimiters(x)
        scan, run = scanned(x, spec, d), Run(x, spec, d, names, findings=True).all()
        assert (scan is not None and scan.clean()) == (not run.found), x
        clean += not run.found
        for n in names:
            want = [v for v, _ in run.project.take(n)]
            if scan is not None and n not in scan.of.refused:
                taken += 1
                assert all(a.equals(b) for a, b in zip(scan.table(n).arrays(cells[n].kinds), cells[n].arrays(want, None), strict=True)), (n, x)
    assert taken > 300 and (clean > 10 or every > 3)


def test_decimals():
    texts = [b"1", b"-1.5", b"", None, b"0", b"007.10", b"12345678901234.56", b"-0"]
    assert decimals(texts, 2).equals(pa.array([v.as_py() for v in decimals([*texts, b"x", b".5"], 2)][:-2], pa.decimal128(38, 2)))
    assert [str(v) for v in decimals([b"1", b"1\n2", b"+1", b" 1", b"1.234", b"5.", b".5"], 2).to_pylist()] == ["1.00", "None", "None", "None", "None", "5.00", "0.50"]


def test_release_is_stepped_through():
    assert scanned(sample(), builtin(), Delimiters(release=b"?")) is None


class Files:
    """What json_view needs of a DataFrame."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        return f


def test_view_of_a_clean_file(monkeypatch):
    """Made without stepping through the segments, and the same text."""
    files = [sample(), sample() + b"\n\n", sample().replace(b"~", b"~\r\n"), sample().replace(b"~GE", b"~ ~GE"), sample().replace(b"A-17", b'A\x01"\\\xc3\xa9')]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.835" for i in range(len(files))]), pa.array(files, pa.binary())], ["filename", "content"])
    run, made = views.json_view(Remittance(Files())), []
    monkeypatch.setattr(views, "by_columns", lambda *_: None)
    want = [b.column(1).to_pylist() for b in run([batch])]
    monkeypatch.undo()
    monkeypatch.setattr(views, "Run", lambda *_, **__: made.append(1))
    assert [b.column(1).to_pylist() for b in run([batch])] == want and not made


def test_tables_of_both_sides_of_a_round_trip(monkeypatch):
    """Several tables in one pass without stepping through the segments; the same rows, those of files that step among them."""
    names = [t.name for t in builtin().tables]
    files = [sample(), sample() + b"\n\n", b"\xef\xbb\xbf" + sample(), sample().replace(b"A-17", b"B-\xc3\xa9")]

    def rows(data: list[bytes]) -> list:
        batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.835" for i in range(len(data))]), pa.array(data, pa.binary())], ["filename", "content"])
        return sorted((str(r) for b in remittance.parse_tables(Files(), names)([batch]) for r in b.to_pylist()))

    got = rows(files)
    monkeypatch.setattr(remittance, "by_columns", lambda *_: None)
    assert rows(files) == got and len(got) == 36
    alone = rows(files[:1])
    monkeypatch.undo()
    monkeypatch.setattr(remittance, "Run", None)
    assert rows(files[:1]) == alone
    with pytest.raises(TypeError):
        rows([files[2]])


def test_text_that_is_not_utf8_is_refused_as_before():
    batch = pa.RecordBatch.from_arrays([pa.array(["a.835"]), pa.array([sample().replace(b"A-17", b"A\xff")], pa.binary())], ["filename", "content"])
    for run in (remittance.parse_tables(Files(), ["claims"]), remittance._parser(Options("claims"))):
        with pytest.raises(remittance.ReadError, match="claim_id.*not UTF-8"):
            list(run([batch]))
