"""Segments, events and the tree of loops as DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from remitta.operators.engine import Run
from remitta.operators.lexer import NotAnInterchange, delimiters, segments

_OPENED = pa.struct([("loop", pa.string()), ("implicit", pa.bool_()), ("ordinal", pa.int64())])
#: Columns of segments: Spark type, Arrow type, and what a segment, its file, run and events give.
_SEGMENT = {
    "filename": ("string", pa.string(), lambda x: x.name),
    "segment": ("bigint", pa.int64(), lambda x: x.s.index),
    "id": ("string", pa.string(), lambda x: x.s.id.decode("latin-1")),
    "raw": ("binary", pa.binary(), lambda x: x.data[x.s.start : x.s.stop]),
    "elements": ("array<array<binary>>", pa.list_(pa.list_(pa.binary())), lambda x: [x.s.parts(i) for i in range(1, len(x.s.pieces))]),
    "raw_start": ("bigint", pa.int64(), lambda x: x.s.start),
    "body_start": ("bigint", pa.int64(), lambda x: x.s.body),
    "body_end": ("bigint", pa.int64(), lambda x: x.s.end),
    "raw_end": ("bigint", pa.int64(), lambda x: x.s.stop),
    "terminated": ("boolean", pa.bool_(), lambda x: x.s.terminated),
    "empty": ("boolean", pa.bool_(), lambda x: x.s.empty),
    "unmatched": ("boolean", pa.bool_(), lambda x: any(e.kind == "unmatched" for e in x.events)),
    "loop": ("string", pa.string(), lambda x: x.loops[x.cap.loop].name if x.cap else None),
    "node": ("bigint", pa.int64(), lambda x: x.cap.instance if x.cap else next((e.instance for e in x.events if e.kind == "unmatched"), x.run.stack[-1][1] if x.run.stack else None)),
    "path": ("string", pa.string(), lambda x: x.run.path()),
    "occurrence": ("string", pa.string(), lambda x: x.loops[x.cap.loop].occurrences[x.cap.occurrence].name if x.cap and x.cap.occurrence is not None else None),
    "opens": ("array<struct<loop:string,implicit:boolean,ordinal:bigint>>", pa.list_(_OPENED), lambda x: [{"loop": x.loops[e.loop].name, "implicit": e.kind == "open!", "ordinal": e.ordinal} for e in x.events if e.kind in ("open", "open!")]),
    "closes": ("array<string>", pa.list_(pa.string()), lambda x: [x.loops[e.loop].name for e in x.events if e.kind == "close"]),
}
#: Columns that need no loops.
_PLAIN = frozenset("filename segment id raw elements raw_start body_start body_end raw_end terminated empty".split())


class _Step:
    """A segment with what is known of it."""

    __slots__ = ("name", "data", "run", "loops", "s", "events", "cap")

_NODES = "filename string, node bigint, parent bigint, loop string, ordinal bigint, implicit boolean, opened_by bigint, segments array<bigint>, unmatched array<bigint>"


def _runs(batches, o):
    for b in batches:
        for name, data in zip(b.column(0).to_pylist(), b.column(1)):
            data = data.as_py() or b""
            try:
                d = o.delimiters or delimiters(data)
            except NotAnInterchange:
                if o.ignore_errors:
                    continue
                raise
            yield name, data, Run(data, o.spec_of(data, d), d, events=True)


def segments_of(contents: DataFrame, o, *columns: str) -> DataFrame:
    """One row per segment: spans that join to the file, elements, and what it did to the loops; columns: those that are wanted."""
    names = list(columns or _SEGMENT)
    kinds, makers = [_SEGMENT[n][1] for n in names], [_SEGMENT[n][2] for n in names]
    plain = _PLAIN.issuperset(names)

    def run(batches):
        x = _Step()
        for x.name, x.data, x.run in _runs(batches, o):
            x.loops, rows = x.run.spec.loops, []
            for x.s in segments(x.data, x.run.delimiters) if plain else x.run.steps():
                x.events, x.run.events = x.run.events, []
                x.cap = next((e for e in x.events if e.kind == "cap"), None)
                rows.append([f(x) for f in makers])
                if len(rows) >= 4096:
                    yield _batch(rows, names, kinds)
                    rows = []
            if rows:
                yield _batch(rows, names, kinds)

    return contents.select("filename", "content").mapInArrow(run, ", ".join(f"{n} {_SEGMENT[n][0]}" for n in names))


def _batch(rows, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def nodes_of(contents: DataFrame, o) -> DataFrame:
    """The tree of loop instances as parent references; node 0 is the root, which holds the roots of the loops."""

    def run(batches):
        names = [x.split()[0] for x in _NODES.split(", ")]
        numbers = pa.list_(pa.int64())
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), numbers, numbers]
        for name, _, r in _runs(batches, o):
            r.all()
            nodes = {None: [name, 0, None, None, None, False, None, [], []]}
            for e in r.events:
                if e.kind in ("open", "open!"):
                    nodes[e.instance] = [name, e.instance + 1, 0 if e.parent is None else e.parent + 1, r.spec.loops[e.loop].name, e.ordinal, e.kind == "open!", e.segment, [], []]
                elif e.kind == "cap":
                    nodes[e.instance][7].append(e.segment)
                elif e.kind == "unmatched":
                    nodes[e.instance][8].append(e.segment)
            yield _batch(list(nodes.values()), names, kinds)

    return contents.select("filename", "content").mapInArrow(run, _NODES)


def loop_paths(contents: DataFrame, wanted: DataFrame, o) -> DataFrame:
    """filename, segment, path of the segments that `wanted` (filename, segment) names."""
    return segments_of(contents, o, "filename", "segment", "path").join(wanted.select("filename", "segment").distinct(), ["filename", "segment"], "left_semi")
