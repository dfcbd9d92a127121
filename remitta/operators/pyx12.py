"""The findings of pyx12, a public validator, where it is installed.

It runs in the task that holds a file, with its own defaults, and writes its errors as JSON: interchanges hold groups,
these transactions, these segments with elements. Its segment numbers count pieces between terminators; the byte offset
of a piece tells the segment. Errors of an envelope are put at its header or trailer by their code.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

from remitta.operators.external import required
from remitta.operators.lexer import delimiters, leading

# Where the errors of envelopes stand (header or trailer, element), by envelope and code.
_PLACES = {
    ("ISA", "001"): ("trailer", 2), ("ISA", "021"): ("trailer", 1), ("ISA", "023"): ("header", 13), ("ISA", "024"): ("trailer", None), ("ISA", "025"): ("header", 13),
    ("GS", "3"): ("trailer", None), ("GS", "4"): ("trailer", 2), ("GS", "5"): ("trailer", 1), ("GS", "6"): ("header", 6),
    ("ST", "2"): ("header", 2), ("ST", "3"): ("trailer", 2), ("ST", "4"): ("trailer", 1), ("ST", "23"): ("header", 2),
}
_TRAILER = {"ISA": "IEA", "GS": "GE", "ST": "SE"}
#: Says only that an element of the segment has errors, which are reported themselves.
_ROLLUP = "SEG_8_has_data_element_errors"


def run_pyx12(text: str) -> tuple[str, list[int], bool, BaseException | None]:
    """Its JSON, the segments it finished, its verdict and what it raised."""
    for module in ("pyx12", "pyx12.params", "pyx12.x12n_document"):
        required(module)
    import pyx12.params
    import pyx12.x12n_document

    done, out, ok, failure = [], io.StringIO(), False, None
    try:
        ok = pyx12.x12n_document.x12n_document(param=pyx12.params.ParamsBase(), src_file=io.StringIO(text), fd_997=None, fd_html=None, fd_json=out, callback=lambda seg, src, node, valid: done.append(src.get_cur_line()))
    except Exception as e:  # its own failure is a finding
        failure = e
    return out.getvalue(), done, ok, failure


def pieces(text: str, terminator: str) -> list[int]:
    """Where each of its numbered segments begins: line ends before a segment are skipped, and it stops at an empty one."""
    out, at = [], 0
    while (end := text.find(terminator, at)) >= 0:
        begin = at + len(text[at:end]) - len(text[at:end].lstrip("\n\r"))
        if begin == end:
            break
        out.append(begin)
        at = end + 1
    return out


def _errors(node: dict) -> Iterator[tuple[str, str, str]]:
    for e in node["errors"]:
        if e["err_cde"] != _ROLLUP:
            code = e.get("x12_code") or e["err_cde"]
            yield code, e["err_str"] if code == e["err_cde"] else f"{e['err_str']} ({e['err_cde']})", e.get("err_val") or ""


def pyx12_validator(run: Callable[[str], tuple] = run_pyx12) -> Callable[[bytes], Iterator[tuple]]:
    """A validator for external_findings; run stands for the package in tests."""

    def validate(data: bytes) -> Iterator[tuple]:
        d, base = delimiters(data), leading(data)
        text = data[base:].decode("latin-1")
        starts = pieces(text, d.segment.decode("latin-1"))
        at = lambda line: base + starts[line - 1] if line is not None and 1 <= line <= len(starts) else None
        report, done, ok, failure = run(text)
        if failure is not None:
            now = at(done[-1] + 1 if done else 1)
            where = "it was processing this segment" if now is not None else "it had read every segment" if done else "it reached no segment"
            yield None, f"could not finish validating: {type(failure).__name__}: {failure}; {where}", now if now is not None or not done else at(done[-1]), b"", 1
        tree = json.loads(report)["interchanges"] if report else []
        if not (tree or ok or done or failure):
            yield None, "could not finish validating: it does not read the file as X12; it rejected this segment", at(1), b"ISA", 1
        if not tree:
            return
        heads: dict[str, list[int]] = {}
        for line, begin in enumerate(starts, 1):
            heads.setdefault(text[begin : begin + 3].split(d.element.decode("latin-1"))[0], []).append(line)
        seen = dict.fromkeys(_TRAILER, 0)

        def envelope(kind: str, node: dict) -> Iterator[tuple]:
            number = seen[kind]
            seen[kind] += 1
            for code, message, value in _errors(node):
                side, element = _PLACES.get((kind, code), ("header", None))
                lines = heads.get(_TRAILER[kind] if side == "trailer" else kind, [])
                yield code, message, at(lines[number]) if number < len(lines) else None, value.encode("latin-1", "replace"), 1, element

        for isa in tree:
            yield from envelope("ISA", isa)
            for gs in isa["groups"]:
                yield from envelope("GS", gs)
                for st in gs["transactions"]:
                    yield from envelope("ST", st)
                    for s in st["segments"]:
                        for code, message, value in _errors(s):
                            yield code, message, at(s["cur_line"]), value.encode("latin-1", "replace"), 2
                        for e in s["elements"]:
                            for code, message, value in _errors(e):
                                yield code, message, at(s["cur_line"]), value.encode("latin-1", "replace"), 2, e["ele_pos"], e.get("subele_pos")

    return validate
