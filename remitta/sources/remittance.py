"""Reading 835 files into DataFrames. A file is read whole by one task; files spread over the tasks, and nothing is shuffled."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitta.errors import MaskError, ReadError, SchemaError
from remitta.functions.values import printable
from remitta.operators.checks import Finding
from remitta.operators.engine import Run, spec_for
from remitta.operators.lexer import Delimiters, NotAnInterchange, delimiters
from remitta.operators.masking import Mask, Places
from remitta.operators.scan import Scan, scanned
from remitta.plans.builtin import VERSIONS, builtin
from remitta.plans.spec import Spec
from remitta.sources.shared import scratch

DIAGNOSTICS = "diagnostics"
_FINDING = [("level", "int", 0), ("kind", "text", 0), ("rule", "text", 0), ("segment", "int", 0), ("element", "int", 0), ("component", "int", 0), ("path", "text", 0), ("datum", "binary", 0), ("origin", "text", 0), ("code", "text", 0)]
#: Rows of a batch that a task hands on.
BATCH = 8192


def _types(kind: str, scale: int, binary: bool) -> tuple[pa.DataType, T.DataType]:
    if kind == "int":
        return pa.int64(), T.LongType()
    if kind == "decimal":
        return pa.decimal128(38, scale), T.DecimalType(38, scale)
    if kind == "date":
        return pa.date32(), T.DateType()
    if kind == "time":
        return pa.int32(), T.IntegerType()  # seconds of the day
    return (pa.binary(), T.BinaryType()) if kind == "binary" and binary else (pa.string(), T.StringType())


def table_columns(spec: Spec, name: str) -> list[tuple[str, str, int, str | None]]:
    """Name, kind, scale and parent table."""
    return [(*c, None) for c in _FINDING] if name == DIAGNOSTICS else spec.columns_of(spec.table(name))


def schema(spec: Spec, name: str, binary: bool = False, filename: bool = False) -> T.StructType:
    out = T.StructType()
    for column, kind, scale, parent in table_columns(spec, name):
        meta = ({"parent": parent} if parent else {}) | ({"scale": scale} if kind == "int" and scale else {})
        out.add(column, _types(kind, scale, binary)[1], True, meta)
    return out.add("filename", T.StringType()) if filename else out


def spec_schema(spec: Spec, binary: bool = True) -> dict[str, T.StructType]:
    return {t.name: schema(spec, t.name, binary) for t in spec.tables}


def schema_listing(spark: SparkSession, version: str | None = None, binary: bool = False, spec: Spec | None = None) -> DataFrame:
    """table_name, column_name, column_type, parent, position of every column, the findings' table included."""
    if binary is None:
        raise SchemaError("the option binary is null")
    if version is not None and version not in VERSIONS:
        raise SchemaError(f"unknown version {version!r}; the built-in ones are {', '.join(VERSIONS)}")
    spec = spec or builtin(version or VERSIONS[0])
    names = {"bigint": "BIGINT", "string": "VARCHAR", "binary": "BLOB", "date": "DATE", "int": "TIME"}
    rows = []
    for name in sorted([*spec.table_names, DIAGNOSTICS]):
        for i, ((column, kind, scale, parent), field) in enumerate(zip(table_columns(spec, name), schema(spec, name, binary)), 1):
            shown = f"DECIMAL(38,{scale})" if kind == "decimal" else names[field.dataType.simpleString()]
            rows.append((name, column, shown, parent, i))
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string, parent string, position int")


# Paths


def is_pattern(path: str) -> bool:
    return any(c in path for c in "*?[") and not path.lower().startswith(("http://", "https://"))


def expand(spark: SparkSession, path) -> list[str]:
    """The files of a path, a pattern or a list of them; those of a pattern in order."""
    if path is None:
        raise ReadError("the path is null")
    if isinstance(path, str):
        path = [path]
    if not isinstance(path, (list, tuple)):
        raise ReadError(f"a path is a text or a list of texts; found {type(path).__name__}")
    if not path:
        raise ReadError("the list of paths is empty")
    out: list[str] = []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in path:
        if p is None:
            raise ReadError("the list of paths holds a null")
        if not isinstance(p, str):
            raise ReadError(f"a path is a text; found {type(p).__name__}")
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        if is_pattern(p):
            found = sorted(str(s.getPath()) for s in fs.globStatus(where) or [] if s.isFile())
            if not found:
                raise ReadError(f"no file matches {p!r}")
            out += found
        elif not fs.exists(where):
            raise ReadError(f"can't open {p!r}: no such file")
        else:
            out.append(p)
    return out


def files(spark: SparkSession, path) -> DataFrame:
    """filename, content."""
    if isinstance(path, str) and is_pattern(path):
        plain: list[str] | str = path  # Spark lists the files itself, on many threads
        try:
            return spark.read.format("binaryFile").load(plain).select(F.col("path").alias("filename"), "content")
        except AnalysisException as e:
            raise ReadError(f"no file matches {path!r}") from e
    # names that were asked for may hold characters that Spark would take for a pattern
    plain = ["".join("\\" + c if c in "*?[]{}" else c for c in p) for p in expand(spark, path)]
    return spark.read.format("binaryFile").load(plain).select(F.col("path").alias("filename"), "content")


# Parsing


#: Stands for a mask option that was not given. None is refused: a key that failed to load must not read patient data unmasked.
NOT_GIVEN = object()


#: Bytes that a text column of one file may hold in a cell.
LARGEST_TEXT = (1 << 31) - 1


class Options:
    """What a parsing task needs to know; checked on the driver."""

    def __init__(self, table_name: str | None = None, version: str | None = None, binary: bool = False, ignore_errors: bool = False, mask_key=NOT_GIVEN, mask_dates: str | None = NOT_GIVEN, spec: Spec | None = None, delimiters: Delimiters | None = None, by: str | None = None, unpad: bool = False, wide: bool = False, largest_text: int = LARGEST_TEXT):
        for name, value in (("binary", binary), ("ignore_errors", ignore_errors), ("mask_key", mask_key), ("mask_dates", mask_dates)):
            if value is None:
                raise ReadError(f"the option {name} is null")
        if version is not None and version not in VERSIONS:
            raise ReadError(f"unknown version {version!r}; the built-in ones are {', '.join(VERSIONS)}")
        if mask_key is NOT_GIVEN:
            if mask_dates is not NOT_GIVEN:
                raise MaskError("mask_dates needs a mask_key")
            self.mask = None
        else:
            self.mask = Mask(mask_key.encode() if isinstance(mask_key, str) else bytes(mask_key), "year" if mask_dates is NOT_GIVEN else mask_dates)
        self.spec, self.version, self.wide = spec, version, wide
        self.shape = spec or builtin(version or VERSIONS[0], wide)
        self.table = table_name or self.shape.default_table
        if self.table != DIAGNOSTICS and self.table not in self.shape.table_names:
            raise ReadError(f"unknown table {self.table!r}; known are {', '.join([*self.shape.table_names, DIAGNOSTICS])}")
        self.binary, self.ignore_errors, self.delimiters, self.by, self.unpad = binary, ignore_errors, delimiters, by, unpad
        self.largest_text = largest_text
        if by is not None:
            self.shape.loop(by)

    def spec_of(self, data: bytes, d: Delimiters) -> Spec:
        if self.spec is not None:
            return self.spec
        spec = spec_for(data, d, self.version, self.wide)
        if self.table != DIAGNOSTICS and spec is not self.shape and spec.columns_of(spec.table(self.table)) != self.shape.columns_of(self.shape.table(self.table)):
            raise ReadError(f"the columns of table {self.table!r} differ between the file's version and the one that was asked for")
        return spec


#: Segments after which a run hands on what it has.
_DRAIN = 2048


def rows_of(name: str, data: bytes, o: Options) -> Iterator[tuple]:
    """(batch number, values) of one file as they come; batch numbers count closed instances of the loop `by`."""
    d = _delimiters_of(name, data, o)
    if isinstance(d, Finding):
        if o.table == DIAGNOSTICS:
            yield 0, d.values()
        return
    spec = o.spec_of(data, d)
    if o.table == DIAGNOSTICS:
        # a text can't be dropped from a file that is no longer than it may be
        run = Run(data, spec, d, spec.table_names if len(data) > o.largest_text else (), findings=True, largest_text=o.largest_text)
        run.unpad = o.unpad
        hide, ids = Places(spec, o.mask) if o.mask else None, []
        for s in run.steps():
            if hide:
                ids.append(s.id)
            if s.index % _DRAIN == 0 and run.found:
                yield from _findings(run, hide, ids)
        yield from _findings(run, hide, ids)
        return
    table = spec.table(o.table)
    run = Run(data, spec, d, [o.table], events=o.by is not None, largest_text=o.largest_text)
    run.unpad = o.unpad
    take = lambda n: [(n, o.mask.row(table, v, seed) if o.mask else v) for v, seed in run.project.take(o.table)]
    number, loop = 0, None if o.by is None else spec.loop(o.by).index
    for s in run.steps():
        if loop is not None:
            closed = any(e.kind == "close" and e.loop == loop for e in run.events)
            run.events.clear()
            if closed:
                yield from take(number)
                number += 1
        elif s.index % _DRAIN == 0:
            yield from take(0)
    yield from take(number)


def _delimiters_of(name: str, data: bytes, o: Options) -> Delimiters | Finding:
    try:
        return o.delimiters or delimiters(data)
    except NotAnInterchange as e:
        if not o.ignore_errors:
            raise ReadError(f"{name}: {e}") from e
        return Finding("NotAnInterchange", str(e), datum=data[:8])


def by_columns(data: bytes, spec: Spec, d: Delimiters, o: Options, names: list[str], findings: bool) -> Scan | None:
    """The file by columns; None if it has to be stepped through: if it has findings that are wanted, say."""
    if o.mask or o.unpad or o.by is not None or len(data) > o.largest_text:
        return None
    scan = scanned(data, spec, d)
    return scan if scan is not None and scan.of.refused.isdisjoint(names) and (not findings or scan.clean()) else None


def _findings(run: Run, hide: Places | None, ids: list[bytes]) -> Iterator[tuple]:
    found, run.check.found = run.check.found, []
    for f in found:
        yield 0, (hide.hide(f, ids[f.segment] if f.segment is not None and f.segment < len(ids) else None) if hide else f).values()


class _Cells:
    """Rows of one table to Arrow columns."""

    def __init__(self, o: Options):
        self.o, self.columns = o, table_columns(o.shape, o.table)
        self.kinds = [_types(k, s, o.binary)[0] for _, k, s, _ in self.columns]
        self.texts = [i for i, (_, k, _, _) in enumerate(self.columns) if k == "binary" and not o.binary]
        self.names = [c for c, _, _, _ in self.columns]

    def arrays(self, rows: list, name_of) -> list[pa.Array]:
        cols = list(zip(*rows)) or [()] * len(self.kinds)
        for i in self.texts if self.o.table == DIAGNOSTICS else ():
            cols[i] = [None if v is None else printable(v) for v in cols[i]]
        out = []
        for i, (c, k) in enumerate(zip(cols, self.kinds)):
            try:
                out.append(pa.array(c, k))
            except pa.ArrowInvalid:  # texts come as bytes
                self._refuse(cols, i, name_of)
                raise
        return out

    def _refuse(self, cols: list, i: int, name_of) -> None:
        for r, v in enumerate(cols[i] if i in self.texts else ()):
            try:
                v.decode() if isinstance(v, bytes) else None
            except UnicodeDecodeError as e:
                raise ReadError(f"{name_of[r]}: row {cols[0][r]}, column {self.columns[i][0]!r} of table {self.o.table!r} is not UTF-8: {printable(v)}; read with binary") from e


class _Same:
    """The one file that all rows are of."""

    def __init__(self, name: str):
        self.name = name

    def __getitem__(self, _: int) -> str:
        return self.name


def columns_of(name: str, data: bytes, o: Options, cells: _Cells) -> list[pa.Array] | None:
    """The columns of one file's rows; empty if it has none. None: rows_of gives them."""
    d = _delimiters_of(name, data, o)
    if isinstance(d, Finding):
        return None
    spec, findings = o.spec_of(data, d), o.table == DIAGNOSTICS
    scan = by_columns(data, spec, d, o, () if findings else [o.table], findings)
    if scan is None:
        return None
    try:
        return [] if findings else scan.table(o.table).arrays(cells.kinds)
    except pa.ArrowInvalid:  # a text that isn't UTF-8: said by rows_of
        return None


def _parser(o: Options):
    cells = _Cells(o)

    def batch(rows: list[tuple], name_of: list[str]) -> pa.RecordBatch:
        arrays = cells.arrays([v for _, v in rows], name_of)
        return pa.RecordBatch.from_arrays([*arrays, pa.array(name_of, pa.string()), pa.array([b for b, _ in rows], pa.int64())], [*cells.names, "filename", "batch"])

    def run(batches):
        rows: list[tuple] = []
        name_of: list[str] = []
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                whole = columns_of(name, data.as_py() or b"", o, cells)
                if whole is not None:
                    n = len(whole[0]) if whole else 0
                    if n:
                        yield pa.RecordBatch.from_arrays([*whole, pa.array([name] * n, pa.string()), pa.array([0] * n, pa.int64())], [*cells.names, "filename", "batch"])
                    continue
                for row in rows_of(name, data.as_py() or b"", o):
                    rows.append(row)
                    name_of.append(name)
                    if len(rows) == BATCH:
                        yield batch(rows, name_of)
                        rows, name_of = [], []
        if rows:
            yield batch(rows, name_of)

    return run


def parse_tables(contents: DataFrame, names: list[str], gate: int | None = None, **options) -> DataFrame:
    """filename, table, and a struct for each table: the rows of several tables in one pass over the files.

    gate: of files with a finding of a level up to this only the findings come out, and a row of the table `rejected`.
    """
    every = {n: Options(n, **options) for n in names}
    cells = {n: _Cells(o) for n, o in every.items()}
    first = next(iter(every.values()))
    inner = {n: pa.struct(list(zip(c.names, c.kinds))) for n, c in cells.items()}
    out = T.StructType([T.StructField("filename", T.StringType()), T.StructField("table", T.StringType())] + [T.StructField(n, schema(o.shape, n, o.binary)) for n, o in every.items()])
    tables = [n for n in names if n != DIAGNOSTICS]
    findings = DIAGNOSTICS in names or gate is not None

    def batch(table: str, rows: list, name_of: list[str]) -> pa.RecordBatch:
        n = len(name_of)
        structs = [pa.StructArray.from_arrays(cells[t].arrays(rows, name_of), fields=list(inner[t])) if t == table else pa.nulls(n, inner[t]) for t in names]
        return pa.RecordBatch.from_arrays([pa.array(name_of, pa.string()), pa.array([table] * n, pa.string()), *structs], ["filename", "table", *names])

    def whole(name: str, data: bytes) -> dict[str, list[pa.Array]] | None:
        """Columns of the tables of a file that is read by columns."""
        d = _delimiters_of(name, data, first)
        if isinstance(d, Finding):
            return None
        spec = first.spec_of(data, d)
        for o in every.values():
            o.spec_of(data, d)  # its columns must be those that were asked for
        scan = by_columns(data, spec, d, first, tables, findings)
        if scan is None:
            return None
        try:
            return {t: scan.table(t).arrays(cells[t].kinds) for t in tables}
        except pa.ArrowInvalid:  # a text that isn't UTF-8: said by of_file
            return None

    def joined(table: str, parts: list) -> pa.RecordBatch:
        names_of, structs = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
        n = len(names_of)
        return pa.RecordBatch.from_arrays([names_of, pa.array([table] * n, pa.string()), *(structs if t == table else pa.nulls(n, inner[t]) for t in names)], ["filename", "table", *names])

    def of_file(name: str, data: bytes) -> Iterator[tuple[str, list]]:
        d = _delimiters_of(name, data, first)
        if isinstance(d, Finding):
            yield DIAGNOSTICS, [d.values()]
            if gate is not None:
                yield "rejected", [None]
            return
        spec = first.spec_of(data, d)
        for o in every.values():
            o.spec_of(data, d)  # its columns must be those that were asked for
        run = Run(data, spec, d, tables, findings=findings, largest_text=first.largest_text)
        run.unpad = first.unpad
        hide, ids = Places(spec, first.mask) if first.mask else None, []
        for s in run.steps():
            if hide and findings:
                ids.append(s.id)
            if gate is None and s.index % _DRAIN == 0:
                yield from drained(run, spec)
        bad = gate is not None and any(f.level <= gate for f in run.found)
        if findings:
            yield DIAGNOSTICS, [v for _, v in _findings(run, hide, ids)]
        if bad:
            yield "rejected", [None]
        else:
            yield from drained(run, spec)

    def drained(run: Run, spec: Spec) -> Iterator[tuple[str, list]]:
        for t in tables:
            table = spec.table(t)
            yield t, [first.mask.row(table, v, seed) if first.mask else v for v, seed in run.project.take(t)]

    def run(batches):
        waiting: dict[str, tuple[list, list]] = {}
        arrays: dict[str, list] = {}
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                columns = whole(name, data.as_py() or b"")
                if columns is not None:
                    for table, got in columns.items():
                        n, parts = len(got[0]), arrays.setdefault(table, [])
                        parts.append((pa.array([name] * n, pa.string()), pa.StructArray.from_arrays(got, fields=list(inner[table]))))
                        if sum(len(x) for x, _ in parts) >= BATCH:
                            yield joined(table, arrays.pop(table))
                    continue
                for table, got in of_file(name, data.as_py() or b""):
                    if table not in cells and table != "rejected":
                        continue
                    rows, name_of = waiting.setdefault(table, ([], []))
                    rows += got
                    name_of += [name] * len(got)
                    if len(rows) >= BATCH:
                        yield batch(table, *waiting.pop(table))
        for table, parts in arrays.items():
            if any(len(x) for x, _ in parts):
                yield joined(table, parts)
        for table, (rows, name_of) in waiting.items():
            if rows:
                yield batch(table, rows, name_of)

    return contents.select("filename", "content").mapInArrow(run, out)


def parse_files(contents: DataFrame, o: Options, filename: bool = True, batch: bool = False) -> DataFrame:
    """The rows of one table from rows of filename and content."""
    out = schema(o.shape, o.table, o.binary, True).add("batch", T.LongType())
    rows = contents.select("filename", "content").mapInArrow(_parser(o), out)
    return rows.drop(*([] if batch else ["batch"]), *([] if filename else ["filename"]))


def read_835(spark: SparkSession, path, table_name: str | None = None, filename: bool = False, **options) -> DataFrame:
    """One table of 835 files. Options: version, binary, ignore_errors, mask_key, mask_dates, spec, delimiters."""
    if filename is None:
        raise ReadError("the option filename is null")
    o = Options(table_name, **options)
    return parse_files(files(spark, path), o, filename)


class Remittance:
    """All tables of some files, each a lazy DataFrame; the facade of parse, parse_file and parse_many."""

    def __init__(self, contents: DataFrame, **options):
        self.contents, self.options, self.kept = contents, options, {}
        self.spec: Spec = options.get("spec") or builtin(options.get("version") or VERSIONS[0], options.get("wide", False))

    def once(self, names: list[str] | None = None) -> "Remittance":
        """Reads the files once for several tables (all of them and the findings, if none are named), and keeps these in the shared folder."""
        names = names or [*self.spec.table_names, DIAGNOSTICS]
        path = scratch(self.contents.sparkSession, "tables")
        every = parse_tables(self.contents, names, **self.options)
        every.write.partitionBy("table").parquet(path)
        out = Remittance(self.contents, **self.options)
        whole = self.contents.sparkSession.read.schema(T.StructType([*every.schema.fields])).parquet(path)
        out.kept = {n: whole.filter(F.col("table") == n).select(F.col(n).alias("row_of"), "filename").select("row_of.*", "filename") for n in names}
        return out

    def table(self, name: str, filename: bool = True) -> DataFrame:
        if name in self.kept:
            return self.kept[name] if filename else self.kept[name].drop("filename")
        return parse_files(self.contents, Options(name, **self.options), filename)

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in self.spec.table_names}

    @property
    def diagnostics(self) -> DataFrame:
        return self.table(DIAGNOSTICS)

    def batches(self, table: str, by: str) -> DataFrame:
        """The table's rows with the number of the batch they come in: one batch for each closed instance of the loop."""
        return parse_files(self.contents, Options(table, by=by, **self.options), True, True)

    def segments(self, *columns: str) -> DataFrame:
        """One row per segment; only what the named columns need is worked out (none: all)."""
        from remitta.operators.structure import segments_of

        return segments_of(self.contents, Options(None if self.spec.default_table else self.spec.table_names[0], **self.options), *columns)

    def nodes(self) -> DataFrame:
        from remitta.operators.structure import nodes_of

        return nodes_of(self.contents, Options(None if self.spec.default_table else self.spec.table_names[0], **self.options))


def parse(spark: SparkSession, data: bytes, **options) -> Remittance:
    return Remittance(spark.createDataFrame([("<bytes>", bytearray(data))], "filename string, content binary"), **options)


def parse_file(spark: SparkSession, path, **options) -> Remittance:
    return Remittance(files(spark, path), **options)


#: Endings of remittance files in a folder.
SUFFIXES = (".txt", ".835", ".DAT")


def parse_many(spark: SparkSession, folder: str, **options) -> Remittance:
    """Every file of a folder with one of the known endings; files that can't be read are skipped, and show in the findings and in failures()."""
    at = folder.rstrip("/")
    try:  # Spark lists the files itself, on many threads
        found = files(spark, "".join("\\" + c if c in "*?[]{}" else c for c in at) + f"/*{{{','.join(SUFFIXES)}}}")
    except ReadError as e:
        raise ReadError(f"{folder!r} holds no file ending in {', '.join(SUFFIXES)}") from e
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    depth = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).depth() + 1
    inside = F.size(F.split(F.regexp_replace("filename", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), "/")) - 1
    return Remittance(found.filter(inside == depth), **({"ignore_errors": True} | options))  # not those of a folder with such an ending


def failures(r: Remittance, warn: bool = True) -> list[tuple[str, str]]:
    """Name and reason of each file that could not be read; each is warned of. Only the headers are parsed."""
    if DIAGNOSTICS in r.kept:
        bad = r.table(DIAGNOSTICS).filter("kind = 'NotAnInterchange'").select("filename", "rule")
    else:
        o = Options(DIAGNOSTICS, **r.options)

        def run(batches):
            for b in batches:
                got = [(name, _delimiters_of(name, data.as_py() or b"", o)) for name, data in zip(b.column(0).to_pylist(), b.column(1))]
                got = [(name, d.rule) for name, d in got if isinstance(d, Finding)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.string()) for i in (0, 1)], ["filename", "rule"])

        bad = r.contents.select("filename", "content").mapInArrow(run, "filename string, rule string")
    found = bad.orderBy("filename").collect()
    for f in found if warn else ():
        warnings.warn(f"skipped {f.filename}: {f.rule}", stacklevel=2)
    return [(f.filename, f.rule) for f in found]
