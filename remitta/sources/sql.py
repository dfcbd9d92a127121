"""835 files from SQL: read_835 in queries, a data source and table functions.

    sql(spark, "SELECT * FROM read_835('/in/*.835', table_name := 'claims', filename := true)")

    register(spark)
    spark.read.format("x835").option("table_name", "claims").load("/in/*.835")
    SELECT f.path, t.* FROM files f, LATERAL parse_835(f.content, 'claims') t
    SELECT * FROM schema_835('5010')

`sql` puts a distributed read in the place of each read_835, with all eight parameters, and leaves the rest of the query
to Spark: every store that Spark knows is reached. The data source reads with pyarrow's file systems (local, S3, HDFS, GCS),
one partition for each group of files.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from remitta.errors import ReadError
from remitta.plans.builtin import VERSIONS, builtin
from remitta.sources.remittance import DIAGNOSTICS, NOT_GIVEN, Options, _parser, is_pattern, read_835, rows_of, schema, table_columns

#: Parameters of read_835 beside the path, with their types.
PARAMETERS = {"table_name": str, "filename": bool, "version": str, "binary": bool, "ignore_errors": bool, "mask_key": (str, bytes), "mask_dates": str}
_FLAGS = {"true": True, "false": False}


# read_835 in a query

_SPLIT = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\bread_835\s*\(""", re.S | re.I)
_PIECE = re.compile(r"""\s*(?:(?P<text>'(?:[^']|'')*')|(?P<blob>[xX]'[0-9A-Fa-f]*')|(?P<open>\[|array\s*\()|(?P<word>[A-Za-z_]\w*)\s*(?P<named>:=|=>)?|(?P<mark>[\],)]))""", re.I)


def _value(text: str, at: int):
    """A constant and where it ends."""
    m = _PIECE.match(text, at)
    if m is None or m["mark"] or m["named"]:
        raise ReadError(f"the arguments of read_835 must be constants; found {text[at : at + 20].strip()!r}")
    if m["text"]:
        return m["text"][1:-1].replace("''", "'"), m.end()
    if m["blob"]:
        return bytes.fromhex(m["blob"][2:-1]), m.end()
    if m["open"]:
        out, at = [], m.end()
        while True:
            if (end := re.compile(r"\s*[\])]").match(text, at)) and not out:
                return out, end.end()
            value, at = _value(text, at)
            out.append(value)
            mark = _PIECE.match(text, at)
            if mark is None or not mark["mark"]:
                raise ReadError("a list in the arguments of read_835 does not end")
            at = mark.end()
            if mark["mark"] != ",":
                return out, at
    word = m["word"].lower()
    if word not in ("true", "false", "null"):
        raise ReadError(f"the arguments of read_835 must be constants; found {m['word']!r}")
    return {"true": True, "false": False, "null": None}[word], m.end()


def arguments(text: str, at: int) -> tuple[object, dict, int]:
    """The path, the named arguments, and where the call ends."""
    path, named = NOT_GIVEN, {}
    while True:
        m = _PIECE.match(text, at)
        if m and m["mark"] == ")":
            return path, named, m.end()
        if m and m["named"]:
            name = m["word"].lower()
            value, at = _value(text, m.end())
            if name not in PARAMETERS:
                raise ReadError(f"read_835 has no parameter {name!r}; known are {', '.join(PARAMETERS)}")
            if value is None:
                raise ReadError(f"the option {name} is null")
            if not isinstance(value, PARAMETERS[name]):
                raise ReadError(f"the option {name} can't be {value!r}")
            named[name] = value
        else:
            if path is not NOT_GIVEN:
                raise ReadError("read_835 takes one path; the other arguments are named")
            path, at = _value(text, at)
        m = _PIECE.match(text, at)
        if m is None or m["mark"] not in (",", ")"):
            raise ReadError("a call of read_835 does not end")
        at = m.end() if m["mark"] == "," else m.start()


def sql(spark: SparkSession, query: str) -> DataFrame:
    """A query over read_835(path, ...); path is a text, a pattern or a list of them."""
    out, at, frames = [], 0, {}
    while m := _SPLIT.search(query, at):
        if m[0][-1] != "(" or m[0][0] in "'\"`-/":
            out.append(query[at : m.end()].replace("{", "{{").replace("}", "}}"))
            at = m.end()
            continue
        path, named, end = arguments(query, m.end())
        if path is NOT_GIVEN:
            raise ReadError("read_835 needs a path")
        name = f"read_835_{len(frames)}"
        frames[name] = read_835(spark, path, **named)
        out += [query[at : m.start()].replace("{", "{{").replace("}", "}}"), "{", name, "}"]
        at = end
    out.append(query[at:].replace("{", "{{").replace("}", "}}"))
    return spark.sql("".join(out), **frames)


# The data source


def _options(given: dict) -> tuple[Options, bool]:
    o = {k.lower(): v for k, v in given.items() if k.lower() not in ("path", "paths")}
    for k in o:
        if k not in PARAMETERS:
            raise ReadError(f"unknown option {k!r}; known are {', '.join(PARAMETERS)}")
    flags = {k: o.pop(k) for k in ("binary", "ignore_errors", "filename") if k in o}
    for k, v in flags.items():
        if str(v).lower() not in _FLAGS:
            raise ReadError(f"the option {k} can't be {v!r}")
        flags[k] = _FLAGS[str(v).lower()]
    filename = flags.pop("filename", False)
    return Options(**o, **flags), filename


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class RemittanceSource(DataSource):
    """format("x835"): options table_name, version, binary, ignore_errors, mask_key, mask_dates, filename."""

    @classmethod
    def name(cls) -> str:
        return "x835"

    def schema(self):
        o, filename = _options(self.options)
        return schema(o.shape, o.table, o.binary, filename)

    def reader(self, schema):
        return _Reader(self.options)


def _store(path: str):
    """File system and path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _matching(path: str):
    """Names and sizes of the files of a path or pattern, in order; only the folder before the first wildcard is listed."""
    import fnmatch

    from pyarrow import fs

    scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]*", path)
    base = path if not is_pattern(path) else re.split(r"[*?\[]", path, maxsplit=1)[0].rpartition("/")[0] or "/"
    store, inside = _store(base)
    if not is_pattern(path):
        info = store.get_file_info(inside)
        if info.type != fs.FileType.File:
            raise ReadError(f"can't open {path!r}: no such file")
        return [(path, info.size)]
    depth = path.removeprefix(base).strip("/").split("/")
    level, found = [inside], []
    for i, part in enumerate(depth):
        below = [x for folder in level for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if fnmatch.fnmatchcase(x.base_name, part)]
        if i == len(depth) - 1:
            found = [(x.path, x.size) for x in below if x.type == fs.FileType.File]
        level = [x.path for x in below if x.type == fs.FileType.Directory]
    if not found:
        raise ReadError(f"no file matches {path!r}")
    prefix = "" if scheme is None else scheme[0] if scheme[0].startswith("file") else scheme[0].split("://")[0] + "://"
    return sorted((prefix + p, n) for p, n in found)


class _Reader(DataSourceReader):
    #: Bytes of files that one task reads, about.
    GROUP = 64 << 20

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        o = {k.lower(): v for k, v in self.options.items()}
        paths = [o["path"]] if o.get("path") else json.loads(o.get("paths") or "[]")
        if not paths:
            raise ReadError("the path is null")
        out, size = [[]], 0
        for name, n in (x for p in paths for x in _matching(p)):
            if size >= self.GROUP:
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [_Files(g) for g in out]

    def read(self, partition):
        o, filename = _options(self.options)

        def contents():
            for n in partition.names:
                store, inside = _store(n)
                with store.open_input_stream(inside) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([f.read()], pa.binary())], ["filename", "content"])

        for batch in _parser(o)(contents()):
            keep = [c for c in batch.schema.names if c != "batch" and (filename or c != "filename")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep], keep)


# Table functions


def _named(argument: AnalyzeArgument | None, what: str) -> str | None:
    if argument is None:
        return None
    if not argument.isConstantExpression:
        raise ReadError(f"the {what} must be a constant")
    return argument.value


def _content_options(table_name=None, version=None, binary=False, ignore_errors=False, mask_key=NOT_GIVEN, mask_dates=NOT_GIVEN) -> Options:
    return Options(table_name, version, binary, ignore_errors, mask_key, mask_dates)


@udtf
class Parse835:
    """parse_835(content, table_name, version, binary, ignore_errors, mask_key, mask_dates): the rows of one table of one file."""

    def __init__(self):
        self.cache: dict = {}

    @staticmethod
    def analyze(content: AnalyzeArgument, *given: AnalyzeArgument, **named: AnalyzeArgument) -> AnalyzeResult:
        o = _content_options(*(_named(a, "option") for a in given), **{k: _named(a, f"option {k}") for k, a in named.items()})
        return AnalyzeResult(schema(o.shape, o.table, o.binary))

    def eval(self, content, *given, **named):
        key = (given, tuple(sorted(named.items())))
        if key not in self.cache:
            self.cache[key] = _content_options(*given, **named)
        o = self.cache[key]
        texts = [i for i, (_, k, _, _) in enumerate(table_columns(o.shape, o.table)) if k == "binary" and not o.binary]
        for _, values in rows_of("content", bytes(content or b""), o):
            out = list(values)
            for i in texts:
                out[i] = None if out[i] is None else out[i].decode("utf-8", "backslashreplace" if o.table == DIAGNOSTICS else "strict")
            yield tuple(out)


@udtf(returnType=T.StructType([T.StructField(n, T.StringType()) for n in ("table_name", "column_name", "column_type", "parent")]).add("position", T.IntegerType()))
class Schema835:
    """schema_835(version): one row for each column of each table."""

    def eval(self, version: str = VERSIONS[0]):
        spec = builtin(version)
        for name in sorted([*spec.table_names, DIAGNOSTICS]):
            for i, ((column, _, _, parent), field) in enumerate(zip(table_columns(spec, name), schema(spec, name)), 1):
                yield Row(name, column, field.dataType.simpleString().upper(), parent, i)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemittanceSource)
    spark.udtf.register("parse_835", Parse835)
    spark.udtf.register("schema_835", Schema835)
