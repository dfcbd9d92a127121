"""What viewers show of a file, and exports: JSON, text and CSV."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitta.errors import ReadError
from remitta.functions import columns as C
from remitta.functions.values import decimal_display, parsed, printable, time_display
from remitta.operators.checks import Finding
from remitta.operators.engine import Run
from remitta.operators.masking import Places
from remitta.operators.scan import Scan
from remitta.plans.spec import Column
from remitta.sources.remittance import DIAGNOSTICS, Options, Remittance, _delimiters_of, _findings, by_columns, table_columns


def json_view(r: Remittance, mask_key: bytes | None = None) -> DataFrame:
    """filename, view: segments, nodes, tables and findings of each file as one JSON text. Each file is read once, and its view made in one task; the key masks tables and findings, not the segments."""
    options = r.options | ({"mask_key": mask_key} if mask_key is not None else {})
    tables = list(r.spec.table_names)
    every = {n: Options(n, **options) for n in [*tables, DIAGNOSTICS]}
    first, columns = next(iter(every.values())), {n: table_columns(o.shape, n) for n, o in every.items()}
    write = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), check_circular=False).encode

    def text(v, kind: str) -> str:
        if isinstance(v, bytes):
            return printable(v) if kind == "text" else v.decode(errors="replace" if first.binary else "strict")
        return f"{v:f}" if kind == "decimal" else str(v)

    def row(name: str, table: str, values: list, order: int) -> dict:
        """The cell that orders the rows first; nulls are left out."""
        out = {} if values[order] is None else {columns[table][order][0]: values[order]}
        for i, ((column, kind, _, _), v) in enumerate(zip(columns[table], values)):
            if v is None or i == order:
                continue
            try:
                out[column] = text(v, "text" if table == DIAGNOSTICS else kind)
            except UnicodeDecodeError as e:
                raise ReadError(f"{name}: row {values[0]}, column {column!r} of table {table!r} is not UTF-8: {printable(v)}; read with binary") from e
        return out

    def view(name: str, data: bytes) -> str | None:
        d = _delimiters_of(name, data, first)
        if isinstance(d, Finding):
            return None
        for o in every.values():
            spec = o.spec_of(data, d)  # its columns must be those that were asked for
        scan = by_columns(data, spec, d, first, tables, True)
        if scan is not None:
            try:
                return _clean_view(data, scan, columns, first.binary)
            except (UnicodeDecodeError, pa.ArrowInvalid):  # said below
                pass
        run = Run(data, spec, d, tables, findings=True, events=True, largest_text=first.largest_text)
        run.unpad = first.unpad
        hide, ids, loops, path = Places(spec, first.mask) if first.mask else None, [], spec.loops, ""
        segments, nodes = [], [{"node": 0, "implicit": "false"}]
        for s in run.steps():
            node, loop = run.stack[-1][1] if run.stack else None, None
            moved = False
            for e in run.events:
                if e.kind == "cap":
                    node, loop = e.instance, loops[e.loop].name
                elif e.kind in ("open", "open!"):
                    moved = True
                    nodes.append({"node": e.instance + 1, "parent": str(0 if e.parent is None else e.parent + 1), "loop": loops[e.loop].name, "ordinal": str(e.ordinal), "implicit": str(e.kind == "open!").lower(), "opened_by": str(e.segment)})
                elif e.kind == "close":
                    moved = True
                elif e.kind == "unmatched":
                    node = e.instance
            run.events.clear()
            if moved:
                path = run.path()
            ids.append(s.id)
            one = {"segment": s.index, "id": s.id.decode("latin-1"), "raw": data[s.start : s.stop].decode("latin-1")}
            if loop is not None:
                one["loop"] = loop
            one["path"] = path
            if node is not None:
                one["node"] = str(node)
            segments.append(one)
        out = {"segments": segments, "nodes": nodes}
        for t in tables:
            table = spec.table(t)
            rows = sorted((first.mask.row(table, v, seed) if first.mask else v for v, seed in run.project.take(t)), key=lambda v: v[0])
            if rows:
                out[t] = [row(name, t, v, 0) for v in rows]
        at = [c for c, _, _, _ in columns[DIAGNOSTICS]].index("segment")
        found = [row(name, DIAGNOSTICS, v, at) for _, v in _findings(run, hide, ids)]
        if found:
            names = ["segment", *(c for c, _, _, _ in columns[DIAGNOSTICS] if c != "segment")]
            out[DIAGNOSTICS] = sorted(found, key=lambda f: [(c in f, f.get(c)) for c in names])
        return write(out)

    def views(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                got = view(name, data.as_py() or b"")
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([got], pa.string())], ["filename", "view"])

    return r.contents.select("filename", "content").mapInArrow(views, "filename string, view string")


_quoted = json.encoder.encode_basestring


def _shown(c: Column, texts: list, replace: bool) -> list[str]:
    """`,"name":"text"` of each cell, nothing for null; as the cell is shown by its value."""
    head = f',"{c.name}":' if c.name.isidentifier() else f",{_quoted(c.name)}:"
    if c.kind == "binary":
        errors = "replace" if replace else "strict"
        return ["" if t is None else head + _quoted(t.decode(errors=errors)) for t in texts]
    out = []
    for t in texts:
        if not t:
            out.append("")
        elif c.kind == "decimal" and c.scale == 2 and (m := _PLAIN(t)):
            out.append(f'{head}"{t.decode()}"' if m[1] else f'{head}"{t.decode()}.00"')
        else:
            v = parsed(c.kind, c.scale, t)
            out.append("" if v is None else f'{head}"{v:f}"' if c.kind == "decimal" else f'{head}"{v}"')
    return out


#: An amount whose text is what its value is shown as, but for zeros at the end.
_PLAIN = re.compile(rb"(?:0|[1-9][0-9]{0,30})(\.[0-9]{2})?").fullmatch


def _clean_view(data: bytes, scan: Scan, columns: dict, replace: bool) -> str:
    """The view of a file without findings."""
    loops = scan.spec.loops
    segments, nodes, stack, ordinals, instances = [], ['{"node":0,"implicit":"false"}'], [], [0] * len(loops), 0
    names = [_quoted(x.name)[1:-1] for x in loops]
    raws, end = data.decode("latin-1").split(scan.d.segment.decode("latin-1")), scan.d.segment.decode("latin-1")
    if scan.terminated:
        raws.pop()
    raws = [*map(_quoted, [x + end for x in raws[:-1]] + [raws[-1] + end * scan.terminated])] if raws else []
    ids = {b: _quoted(b.decode("latin-1")) for b in {x.segment for x in scan.steps}}
    path, tail, done = "", ',"path":""}', 0
    for i, step in zip(scan.at.tolist(), scan.steps):
        while done < i:  # white space
            segments.append(f'{{"segment":{done},"id":"","raw":{raws[done]}{tail}')
            done += 1
        done += 1
        if not step.closes and not step.opens and not step.ends:
            segments.append(f'{{"segment":{i},"id":{ids[step.segment]},"raw":{raws[i]}{held}')
            continue
        if step.closes:
            del stack[-len(step.closes) :]
        for loop, _ in step.opens:
            ordinals[loop] += 1
            nodes.append(f'{{"node":{instances + 1},"parent":"{stack[-1][0] + 1 if stack else 0}","loop":"{names[loop]}","ordinal":"{ordinals[loop]}","implicit":"false","opened_by":"{i}"}}')
            stack.append((instances, loop, f"{stack[-1][2]}/{names[loop]}#{ordinals[loop]}" if stack else f"{names[loop]}#{ordinals[loop]}"))
            instances += 1
        node, name = stack[-1][0], names[step.holder]
        if step.ends:
            stack.pop()
        path = stack[-1][2] if stack else ""
        segments.append(f'{{"segment":{i},"id":{ids[step.segment]},"raw":{raws[i]},"loop":"{name}","path":"{path}","node":"{node}"}}')
        held = f',"loop":"{names[stack[-1][1]]}","path":"{path}","node":"{stack[-1][0]}"}}' if stack else None
        tail = f',"path":"{path}"' + (f',"node":"{stack[-1][0]}"}}' if stack else "}")
    segments += [f'{{"segment":{i},"id":"","raw":{raws[i]}{tail}' for i in range(done, len(raws))]
    out = [f'{{"segments":[{",".join(segments)}],"nodes":[{",".join(nodes)}]']
    for t in scan.spec.tables:
        rows = scan.table(t.name)
        if not len(rows):
            continue
        shown = columns[t.name]
        cells = [[f'{{"{shown[0][0]}":{i}' for i in range(len(rows))], [f',"{shown[1][0]}":"{i}"' for i in rows.segment.tolist()]]
        for (name, _, _, _), p in zip(shown[2:], rows.parents):
            cells.append(["" if x is None else f',"{name}":"{x}"' for x in p.to_pylist()])
        cells += [_shown(c, x, replace) for c, x in zip(t.columns, rows.texts) if x is not None]
        out.append(f',{_quoted(t.name)}:[{"},".join(map("".join, zip(*cells)))}}}]')
    return "".join(out) + "}"


def csv_lines(df: DataFrame) -> DataFrame:
    """line: the cells of each row, quoted where needed and safe for spreadsheets."""
    return df.select(F.concat_ws(",", *[F.coalesce(C.csv_cell(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns]).alias("line"))


def filtered(df: DataFrame, text: str) -> DataFrame:
    return df.filter(C.any_cell_contains([F.col(f"`{c}`") for c in df.columns], text))


def render(name: str, columns: list[tuple[str, str, int, str | None]], rows: list[list]) -> str:
    """A table as text: title, header, a line for each row; null is shown as ∅."""
    kinds = {"int": "int64", "binary": "binary", "date": "date32", "time": "time32 (seconds)"}
    head = " | ".join(f"{c}: {kinds.get(k) or f'decimal128(38, {s})'}" for c, k, s, _ in columns)
    lines = [f"## {name} (rows: {len(rows)})", head]
    for r in rows:
        cells = []
        for (_, k, s, _), v in zip(columns, r):
            cells.append("∅" if v is None else printable(v) if isinstance(v, bytes) else decimal_display(v, s) if k == "decimal" else time_display(v) if k == "time" else str(v))
        lines.append(" | ".join(cells))
    return "\n".join(lines) + "\n"


def lake(r: Remittance, path: str, months: str = "payment_date") -> None:
    """Claims with their payer as Parquet, a folder for each payer and month; files of one folder are written by few tasks."""
    payments = r.table("payments").select("filename", F.col("row").alias("payment"), F.coalesce("payer_name", F.lit("unknown")).alias("payer"), F.coalesce(F.date_format(months, "yyyy-MM"), F.lit("unknown")).alias("month"))
    claims = r.table("claims").join(payments, ["filename", "payment"])
    claims.write.mode("overwrite").partitionBy("payer", "month").parquet(path)
