"""Registered queries of paths, options, the wide frame, writing, streams, specifications and errors.

Queries of errors return their facts: what was tried, the class that is raised, and what the message names.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.functions import columns as C
from remitta.functions import values as V
from remitta.operators import compat, external, rows, summary, writer
from remitta.operators.lexer import Delimiters, Document, delimiters
from remitta.operators.pyx12 import pyx12_validator
from remitta.plans.builtin import builtin
from remitta.plans.generate import remittances
from remitta.plans.registry import BASE, KEY, _STATUS, money, query
from remitta.plans.registry_findings import NUMBER, changed
from remitta.plans.spec import Spec, merge_patch
from remitta.sources import remittance as R
from remitta.sources.remittance import Options, Remittance, parse_files
from remitta.sources.shared import scratch
from remitta.sources.sql import register, sql
from remitta.sources.views import csv_lines, json_view, lake, render
from remitta.streaming.intake import intake

_folders: dict[tuple, str] = {}


def folder(spark: SparkSession, sf_dir: str) -> str:
    """The generated files as files, put there once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        path = scratch(spark, "files")
        writer.save_each(remittances(spark, sf_dir), path).count()
        _folders[key] = path
    return _folders[key]


def _base_name(c: str = "filename"):
    return F.substring_index(F.col(c), "/", -1)


def facts(spark: SparkSession, cases: list[tuple[str, Callable, str]]) -> DataFrame:
    """case, error, named: the class that each case raises, and whether its message names what it must."""
    out = []
    for name, run, wanted in cases:
        try:
            run()
            out.append((name, "none", False))
        except Exception as e:  # the class is the fact
            out.append((name, type(e).__name__, wanted in str(e)))
    return spark.createDataFrame(out, "case string, error string, named boolean")


def said(*cases: tuple[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', TRUE)" for a, b in cases) + ") t(\"case\", error, named)"


# Paths and options

_CLAIMS_OF = 'filename, "row", CAST(o_orderkey AS VARCHAR) AS claim_id, {0} AS payment_amount'.format(money("paid"))


@query(f"{BASE} SELECT {_CLAIMS_OF} FROM claims")
def s1_sql_read_835(spark, sf_dir):
    """In SQL, with a pattern and named parameters."""
    got = sql(spark, f"SELECT filename, `row`, claim_id, payment_amount FROM read_835('{folder(spark, sf_dir)}/*.835', table_name := 'claims', filename := true) WHERE payment_amount IS NOT NULL")
    return got.withColumn("filename", _base_name())


@query(f"{BASE} SELECT filename, count(*) AS n, CAST(sum({money('paid')}) AS DECIMAL(38,2)) AS paid FROM claims GROUP BY 1")
def s1_data_source(spark, sf_dir):
    register(spark)
    df = spark.read.format("x835").option("table_name", "claims").option("filename", "true").load(f"{folder(spark, sf_dir)}/*.835")
    return df.groupBy(_base_name().alias("filename")).agg(F.count(F.lit(1)).alias("n"), F.sum("payment_amount").cast("decimal(38,2)").alias("paid"))


@query(f"{BASE} SELECT {_CLAIMS_OF} FROM claims WHERE {NUMBER} IN (0, 2)")
def s2_list_of_paths(spark, sf_dir):
    at = folder(spark, sf_dir)
    got = sql(spark, f"SELECT * FROM read_835(['{at}/bucket-000002.835', '{at}/bucket-000000.835'], filename := true)")
    return got.select(_base_name().alias("filename"), "row", "claim_id", "payment_amount")


@query(f"{BASE} SELECT {_CLAIMS_OF} FROM claims WHERE {NUMBER} IN (1, 3)")
def s3_glob(spark, sf_dir):
    return R.read_835(spark, f"{folder(spark, sf_dir)}/bucket-00000[13].8?5", filename=True).select(_base_name().alias("filename"), "row", "claim_id", "payment_amount")


@query(f"{BASE} SELECT filename, CAST(5 + sum(12 + n_lx + 3 * n_claims + 5 * n_lines) AS BIGINT) AS n, TRUE AS whole FROM totals GROUP BY 1")
def s4_file_read(spark, sf_dir):
    """Bytes from disk are those that were written."""
    files = R.files(spark, f"{folder(spark, sf_dir)}/*.835").withColumn("filename", _base_name())
    same = files.join(remittances(spark, sf_dir).select("filename", F.sha2("content", 256).alias("was")), "filename").select("filename", (F.sha2("content", 256) == F.col("was")).alias("whole"))
    return Remittance(files).segments("filename", "id").groupBy("filename").agg(F.count(F.lit(1)).alias("n")).join(same, "filename")


@query(said(("null path", "ReadError"), ("empty list", "ReadError"), ("null in list", "ReadError"), ("other type", "ReadError"), ("no match", "ReadError"), ("no file", "ReadError"), ("unknown table", "ReadError"), ("unknown version", "ReadError"), ("null option", "ReadError"), ("null in SQL", "ReadError"), ("unknown parameter", "ReadError"), ("not a constant", "ReadError"), ("null mask key", "ReadError"), ("mask dates without key", "MaskError"), ("short key", "MaskError"), ("date mode", "MaskError")))
def r1_read_errors(spark, sf_dir):
    at = folder(spark, sf_dir)
    read = lambda path, **o: lambda: R.read_835(spark, path, **o)
    one = f"{at}/bucket-000000.835"
    return facts(spark, [
        ("null path", read(None), "null"), ("empty list", read([]), "empty"), ("null in list", read([None]), "null"), ("other type", read(7), "int"), ("no match", read(f"{at}/none*.835"), "none*.835"), ("no file", read(f"{at}/none.835"), "none.835"),
        ("unknown table", read(one, table_name="none"), "claims"), ("unknown version", read(one, version="6010"), "6010"), ("null option", read(one, binary=None), "binary"), ("null in SQL", lambda: sql(spark, f"SELECT * FROM read_835('{one}', version := NULL)"), "version"),
        ("unknown parameter", lambda: sql(spark, f"SELECT * FROM read_835('{one}', tables := 'x')"), "tables"), ("not a constant", lambda: sql(spark, "SELECT * FROM read_835(path)"), "path"), ("null mask key", read(one, mask_key=None), "mask_key"), ("mask dates without key", read(one, mask_dates="shift"), "mask_key"),
        ("short key", read(one, mask_key="short"), "16"), ("date mode", read(one, mask_key=KEY, mask_dates="day"), "day"),
    ])


@query(said(("null key", "ReadError"), ("null dates", "ReadError"), ("short key", "MaskError"), ("unknown mode", "MaskError"), ("dates without key", "MaskError")))
def m5_key_rules(spark, sf_dir):
    """A key that failed to load is refused; nothing reads unmasked by mistake."""
    return facts(spark, [("null key", lambda: Options("claims", mask_key=None), "null"), ("null dates", lambda: Options("claims", mask_key=KEY, mask_dates=None), "mask_dates"), ("short key", lambda: Options("claims", mask_key=b"x" * 15), "15"), ("unknown mode", lambda: Options("claims", mask_key=KEY, mask_dates="none"), "none"), ("dates without key", lambda: Options("claims", mask_dates="keep"), "mask_key")])


@query(said(("schema of another version", "ReadError"), ("not an interchange", "PythonException"), ("not UTF-8", "PythonException")))
def s8_schema_guard(spark, sf_dir):
    """What a task refuses: columns other than those that were bound, a file that is no interchange, bytes that are no text."""
    files = remittances(spark, sf_dir)
    o = Options("claims")
    o.shape = builtin().patch({"tables": {"claims": {"columns": {"more": {"segment": "CLP", "element": 1}}}}})
    first = bytes(files.filter("filename = 'bucket-000000.835'").first().content)
    other = lambda: o.spec_of(first, delimiters(first))
    broken = files.withColumn("content", F.encode(F.lit("no file"), "UTF-8"))
    latin = changed(files, ("Customer#", "Customér#"))
    return facts(spark, [("schema of another version", other, "claims"), ("not an interchange", lambda: parse_files(broken, Options("claims")).count(), "ISA"), ("not UTF-8", lambda: parse_files(latin, Options("claims")).count(), "patient_last_name")])


@query(f"{BASE} SELECT filename, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM services GROUP BY 1")
def s11_chunks(spark, sf_dir):
    """Rows are handed on a few at a time, whatever the size of a file."""
    rows_of_file = parse_files(remittances(spark, sf_dir), Options("services"))
    return rows_of_file.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("procedure_code").cast("bigint")).alias("parts"))


@query(f"{BASE} SELECT filename, count(*) AS n, count(*) AS equal FROM adjustments GROUP BY 1")
def s12_single_table(spark, sf_dir):
    """Rows read alone, where the other tables only count theirs, are those of a pass over all tables."""
    r = Remittance(remittances(spark, sf_dir))
    alone, beside = r.table("adjustments"), r.once(["payments", "claims", "services", "adjustments"]).table("adjustments")
    both = alone.withColumn("side", F.lit(1)).unionByName(beside.withColumn("side", F.lit(-1))).groupBy(*alone.columns).agg(F.sum("side").alias("d"), F.count_if(F.col("side") > 0).alias("n"))
    return both.groupBy("filename").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)).alias("equal"))


_SCHEMA = """
adjustments: row BIGINT, segment BIGINT, payment BIGINT payments, claim BIGINT claims, service BIGINT services, amount DECIMAL(38;2), group_code VARCHAR, quantity DECIMAL(38;2), reason_code VARCHAR
claims: row BIGINT, segment BIGINT, payment BIGINT payments, charge_amount DECIMAL(38;2), claim_id VARCHAR, claim_status VARCHAR, coverage_amount DECIMAL(38;2), discharge_fraction DECIMAL(38;4), drg_code VARCHAR, drg_weight DECIMAL(38;4), facility_type VARCHAR, filing_indicator VARCHAR, frequency_code VARCHAR, group_number VARCHAR, header_number BIGINT, patient_first_name VARCHAR, patient_id VARCHAR, patient_id_qualifier VARCHAR, patient_last_name VARCHAR, patient_responsibility DECIMAL(38;2), payer_control_number VARCHAR, payment_amount DECIMAL(38;2), rendering_provider_entity_type VARCHAR, rendering_provider_id VARCHAR, rendering_provider_id_qualifier VARCHAR, rendering_provider_name VARCHAR, statement_from DATE, statement_to DATE
diagnostics: level BIGINT, kind VARCHAR, rule VARCHAR, segment BIGINT, element BIGINT, component BIGINT, path VARCHAR, datum VARCHAR, origin VARCHAR, code VARCHAR
payments: row BIGINT, segment BIGINT, credit_debit_flag VARCHAR, handling_code VARCHAR, payee_address VARCHAR, payee_city VARCHAR, payee_id VARCHAR, payee_id_qualifier VARCHAR, payee_name VARCHAR, payee_state VARCHAR, payee_zip VARCHAR, payer_address VARCHAR, payer_city VARCHAR, payer_id VARCHAR, payer_id_qualifier VARCHAR, payer_identifier VARCHAR, payer_name VARCHAR, payer_state VARCHAR, payer_technical_contact_name VARCHAR, payer_technical_contact_number VARCHAR, payer_technical_contact_qualifier VARCHAR, payer_zip VARCHAR, payment_date DATE, payment_format VARCHAR, payment_method VARCHAR, production_date DATE, receiver_id VARCHAR, total_payment_amount DECIMAL(38;2), trace_number VARCHAR
provider_adjustments: row BIGINT, segment BIGINT, payment BIGINT payments, amount DECIMAL(38;2), fiscal_period_date DATE, provider_id VARCHAR, reason_code VARCHAR, reference_id VARCHAR
services: row BIGINT, segment BIGINT, payment BIGINT payments, claim BIGINT claims, allowed_amount DECIMAL(38;2), charge_amount DECIMAL(38;2), line_item_control_number VARCHAR, original_units DECIMAL(38;2), payment_amount DECIMAL(38;2), procedure_code VARCHAR, procedure_qualifier VARCHAR, service_date DATE, units_paid DECIMAL(38;2)
"""


def _listing() -> str:
    out = []
    for line in _SCHEMA.strip().splitlines():
        table, _, columns = line.partition(": ")
        for i, c in enumerate(columns.split(", "), 1):
            name, kind, *parent = c.split()
            out.append("('{}', '{}', '{}', {}, {})".format(table, name, kind.replace(";", ","), f"'{parent[0]}'" if parent else "NULL", i))
    return f"SELECT * FROM (VALUES {', '.join(out)}) t(table_name, column_name, column_type, parent, position)"


@query(_listing())
def s13_schema_listing(spark, sf_dir):
    """Every column of all six tables."""
    return R.schema_listing(spark)


@query("SELECT * FROM (VALUES ('unknown version', 'SchemaError', TRUE), ('null option', 'SchemaError', TRUE)) t(\"case\", error, named)")
def r3_schema_errors(spark, sf_dir):
    return facts(spark, [("unknown version", lambda: R.schema_listing(spark, "6010"), "6010"), ("null option", lambda: R.schema_listing(spark, binary=None), "binary")])


@query(f"{BASE} SELECT \"row\", CAST(o_orderkey AS VARCHAR) AS claim_id FROM claims WHERE {NUMBER} = 0")
def s14_parse_bytes(spark, sf_dir):
    """The bytes of one file, held by the caller."""
    data = bytes(remittances(spark, sf_dir).filter("filename = 'bucket-000000.835'").first().content)
    return R.parse(spark, data).table("claims", filename=False).select("row", "claim_id")


@query(f"{BASE} SELECT filename, CAST(sum(n_claims) AS BIGINT) AS claims, CAST(sum(n_lines) AS BIGINT) AS services, CAST(5 + sum(12 + n_lx + 3 * n_claims + 5 * n_lines) AS BIGINT) AS segments FROM totals GROUP BY 1")
def s16_json_view(spark, sf_dir):
    view = json_view(Remittance(remittances(spark, sf_dir)))
    parts = view.select("filename", F.from_json("view", "claims array<struct<row:bigint>>, services array<struct<row:bigint>>, segments array<struct<segment:bigint>>").alias("v"))
    return parts.select("filename", *(F.size(f"v.{name}").cast("bigint").alias(name) for name in ("claims", "services", "segments")))


@query(f"{BASE} SELECT (SELECT count(*) FROM claims) AS n, CAST(1 AS BIGINT) AS failed, TRUE AS warned")
def s17_folder_of_files(spark, sf_dir):
    """All files of a folder by their endings; one that can't be read is warned of."""
    import warnings

    at = scratch(spark, "many")
    bad = spark.createDataFrame([("bad.txt", bytearray(b"no interchange")), ("other.log", bytearray(b"not looked at"))], "filename string, content binary")
    writer.save_each(remittances(spark, sf_dir).unionByName(bad), at).count()
    r = R.parse_many(spark, at)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        failed = R.failures(r)
    return r.table("claims").agg(F.count(F.lit(1)).alias("n"), F.lit(len(failed)).cast("bigint").alias("failed"), F.lit(any("bad.txt" in str(w.message) for w in seen)).alias("warned"))


@query(said(("not ISA", "NotAnInterchange"), ("cut off", "NotAnInterchange"), ("too large", "ValueError")))
def r4_document_errors(spark, sf_dir):
    class Huge(bytes):
        def __len__(self):
            return 1 << 31

    return facts(spark, [("not ISA", lambda: delimiters(b"XSA*00"), "58 53 41"), ("cut off", lambda: delimiters(b"ISA*00*"), "2 of 16"), ("too large", lambda: Document(Huge(), Delimiters()), "2 GiB")])


# Streams


@query(said(("unknown loop", "SpecError")))
def t2_unknown_loop(spark, sf_dir):
    return facts(spark, [("unknown loop", lambda: Options("claims", by="2300"), "2100")])


@query(f"{BASE} SELECT filename, \"row\", n_claims AS batch FROM pays JOIN (SELECT filename, sum(n_claims) AS n_claims FROM totals GROUP BY 1) USING (filename) WHERE \"row\" = (SELECT max(\"row\") FROM pays p WHERE p.filename = pays.filename)".replace("n_claims AS batch", "CAST(n_claims AS BIGINT) AS batch"))
def t3_tail_batch(spark, sf_dir):
    """The last payment comes with what is left after the last closed claim."""
    from pyspark.sql import Window

    last = F.max("row").over(Window.partitionBy("filename"))
    return Remittance(remittances(spark, sf_dir)).batches("payments", "2100").withColumn("last", last).filter("row = last").select("filename", "row", "batch")


@query(f"{BASE} SELECT filename, min(\"row\") AS least, max(\"row\") AS most, count(DISTINCT \"row\") AS n FROM services GROUP BY 1")
def t4_continuing_numbers(spark, sf_dir):
    r = Remittance(remittances(spark, sf_dir)).batches("services", "2100")
    return r.groupBy("filename").agg(F.min("row").alias("least"), F.max("row").alias("most"), F.count_distinct("row").alias("n"))


@query(f"{BASE} SELECT 'claims' AS what, count(*) AS n FROM claims UNION ALL SELECT 'services', count(*) FROM services UNION ALL SELECT 'rejected', 1")
def t6_arriving_files(spark, sf_dir):
    """A stream over the files of a folder, each parsed once; a bad one is held back."""
    at, out = scratch(spark, "arriving"), scratch(spark, "intake-out")
    bad = spark.createDataFrame([("bad.835", bytearray(b"ISA*00*"))], "filename string, content binary")
    writer.save_each(remittances(spark, sf_dir).unionByName(bad), at).count()
    intake(spark, at, out, scratch(spark, "intake-state"), ["claims", "services"]).awaitTermination()
    parts = [spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n")) for name in ("claims", "services", "rejected")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# The wide frame


@query(f"{BASE} SELECT filename, \"row\" AS service, 'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS patient FROM services")
def c1_positions(spark, sf_dir):
    """What each service finds by the key of its claim: a lookup that keeps rows without a match."""
    t = Remittance(remittances(spark, sf_dir)).once(["services", "claims"]).tables
    claims = t["claims"].select("filename", F.col("row").alias("claim"), "patient_id")
    return t["services"].join(claims, ["filename", "claim"], "left").select("filename", F.col("row").alias("service"), F.coalesce("patient_id", F.lit("none")).alias("patient"))


@query(f"{BASE} SELECT filename, \"row\" AS claim, {_STATUS.format(chr(39) + 'processed as primary' + chr(39), chr(39) + 'denial' + chr(39), chr(39) + 'processed as secondary' + chr(39))} AS status, {_STATUS.format(chr(39) + 'primary' + chr(39), chr(39) + 'unspecified' + chr(39), chr(39) + 'secondary' + chr(39))} AS payer_classification, 'member identification number' AS qualifier, 'patient' AS entity, 'claim statement period start' AS date_kind, 'provider control number' AS ref_kind FROM claims")
def c6_code_texts(spark, sf_dir):
    """Codes as text in the nested views."""
    v = compat.claim_views(remittances(spark, sf_dir))
    first = lambda c: F.get(F.col(c), F.lit(0))
    ref = F.get(F.get("services", F.lit(0)).ref, F.lit(0)).qual
    from remitta.functions.codes import REFERENCE_QUALIFIERS

    return v.select("filename", "claim", "status", "payer_classification", first("entities").identification_code_qualifier.alias("qualifier"), first("entities").entity.alias("entity"), first("dates").qualifier.alias("date_kind"), compat.code_text(ref, REFERENCE_QUALIFIERS).alias("ref_kind"))


@query(f"{BASE} SELECT services.filename, services.\"row\" AS service, CASE WHEN l_linenumber % 2 = 0 THEN CAST(charge AS DOUBLE) / 100 END AS allowed_amount FROM services")
def c7_last_amount(spark, sf_dir):
    """The last amount of a service, if it is the allowed one."""
    files = changed(remittances(spark, sf_dir), (r"SVC\*HC:([0-9]+)\*([0-9.]+)\*([^~]*~DTM[^~]*~CAS[^~]*~CAS[^~]*~)REF\*6R\*([0-9]+)-([0-9]*[02468])~", "SVC*HC:$1*$2*$3REF*6R*$4-$5~AMT*T*1~AMT*B6*$2~"), (r"REF\*6R\*([0-9]+)-([0-9]*[13579])~", "REF*6R*$1-$2~AMT*B6*5~AMT*T*7~"))
    return compat.frame(files, widest=0).select("filename", "service", "allowed_amount")


@query(f"{BASE} SELECT services.filename, services.\"row\" AS service, CASE l_linenumber % 3 WHEN 0 THEN make_date(2001, 2, 3) WHEN 1 THEN shipped ELSE ordered END AS start_date FROM services JOIN claims ON claims.filename = services.filename AND claims.\"row\" = services.claim")
def c8_date_precedence(spark, sf_dir):
    """The period's start, else the service date, else the claim's."""
    files = changed(remittances(spark, sf_dir), (r"DTM\*472\*([0-9]{8})~(CAS[^~]*~CAS[^~]*~REF\*6R\*[0-9]+-(3|6)~)", "DTM*472*$1~DTM*150*20010203~$2"), (r"DTM\*472\*([0-9]{8})~(CAS[^~]*~CAS[^~]*~REF\*6R\*[0-9]+-(2|5)~)", "$2"))
    return compat.frame(files, widest=0).select("filename", "service", "start_date")


@query(f"{BASE} SELECT filename, \"row\" AS service, CASE WHEN l_linenumber % 2 = 0 THEN CAST(qty AS DOUBLE) WHEN charge - discount - tax = 0 THEN 0.0 ELSE 1.0 END AS allowed_units, CASE WHEN l_linenumber % 2 = 0 THEN CAST(qty AS DOUBLE) WHEN charge - discount - tax = 0 THEN 0.0 ELSE 1.0 END AS billed_units FROM services")
def c9_units_defaults(spark, sf_dir):
    """Units that a segment stops before are one, or none if nothing was paid."""
    files = changed(remittances(spark, sf_dir), (r"(SVC\*HC:[0-9]+\*[0-9.]+\*-?[0-9.]+)\*\*[0-9]+(~DTM\*472\*[0-9]{8}~CAS[^~]*~CAS[^~]*~REF\*6R\*[0-9]+-[0-9]*[13579]~)", "$1$2"))
    return compat.frame(files, widest=0).select("filename", "service", "allowed_units", "billed_units")


@query(f"{BASE} SELECT filename, count(*) AS services, CAST(sum(CASE WHEN charge - discount - tax > 0 THEN 1 ELSE 0 END) AS BIGINT) AS paid, CAST(0 AS BIGINT) AS claims_alone, (SELECT count(*) FROM pays WHERE pays.filename = services.filename) AS plb, CAST((SELECT sum(balance) / 100.0 FROM pays WHERE pays.filename = services.filename) AS DECIMAL(38,2)) AS plb_amount FROM services GROUP BY filename")
def c12_extended_frame(spark, sf_dir):
    """Service, claim and provider adjustment rows in one frame."""
    f = compat.frame(remittances(spark, sf_dir), extended=True, widest=2)
    kind = lambda k: F.count_if(F.col("x_row_kind") == k)
    return f.groupBy("filename").agg(kind("service").alias("services"), F.count_if(F.col("paid_amount") > 0).alias("paid"), kind("claim").alias("claims_alone"), kind("provider_adjustment").alias("plb"), F.sum(F.col("x_plb_amount").cast("decimal(38,2)")).cast("decimal(38,2)").alias("plb_amount"))


_ORDER = [f"{k}_{n}_{s}" for k, n in (("adj", 0), ("adj", 1), ("ref", 0)) for s in (("group", "code", "amount") if k == "adj" else ("qual", "value"))]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_ORDER)) + ") t(place, name)")
def c5_order_of_appearance(spark, sf_dir):
    """Numbered columns as a list of records first shows them."""
    found = compat.appearance(compat.frame(remittances(spark, sf_dir)))
    return spark.createDataFrame(list(enumerate(found)), "place int, name string")


@query("SELECT * FROM (VALUES (0, 'code'), (1, 'marker'), (2, 'adj_0_code'), (3, 'adj_10_code'), (4, 'adj_2_code'), (5, 'ref_0_qual'), (6, 'rem_0_code')) t(place, name)")
def c11_sorted_columns(spark, sf_dir):
    found = compat.sort_columns(["rem_0_code", "code", "adj_2_code", "adj_10_code", "marker", "ref_0_qual", "adj_0_code"])
    return spark.createDataFrame(list(enumerate(found)), "place int, name string")


@query(f"{BASE} SELECT \"row\" AS claim, CAST(o_orderkey AS VARCHAR) AS claim_id FROM claims WHERE {NUMBER} = 1 AND payment = 2")
def c13_one_transaction(spark, sf_dir):
    return compat.transaction(parse_files(remittances(spark, sf_dir), Options("claims")), "bucket-000001.835", 2).select(F.col("row").alias("claim"), "claim_id")


@query(f"{BASE} SELECT filename, \"row\", 'ICN' || o_orderkey AS icn, 'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS patient_id FROM claims")
def c14_unpad(spark, sf_dir):
    """Blanks at the end of a segment's last element go."""
    files = changed(remittances(spark, sf_dir), (r"(NM1\*QC\*[^~]*)~", "$1   ~"), (r"(CLP\*[^~]*\*ICN[0-9]+)\*11\*1~", "$1  ~"))
    return parse_files(files, Options("claims", unpad=True)).select("filename", "row", F.col("payer_control_number").alias("icn"), "patient_id")


_MEANINGS = {"CO": "contractual obligation", "CR": "corrections and reversals", "OA": "other adjustment", "PI": "payor initiated reduction", "PR": "patient responsibility"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('groups', '{k}', '{v}')" for k, v in _MEANINGS.items()) + ", ('methods', 'CHK', 'check'), ('methods', 'ACH', 'automatic deposit'), ('methods', 'NON', 'no payment'), ('statuses', '19', 'processed as primary, forwarded to additional payer(s)'), ('statuses', '22', 'reversal of previous payment'), ('entities', '82', 'rendering provider'), ('dates', '472', 'service')) t(kind, code, meaning)")
def c15_dictionaries(spark, sf_dir):
    from remitta.functions import codes

    kinds = {"groups": codes.ADJUSTMENT_GROUPS, "methods": codes.PAYMENT_METHODS, "statuses": {k: v[0] for k, v in codes.STATUSES.items() if k in ("19", "22")}, "entities": {"82": codes.ENTITY_CODES["82"]}, "dates": {"472": codes.DATE_QUALIFIERS["472"]}}
    return spark.createDataFrame([(k, c, m) for k, of in kinds.items() for c, m in of.items()], "kind string, code string, meaning string")


@query(f"{BASE} SELECT pays.filename, pays.\"row\" AS payment, CAST({money('totals.paid - balance')} AS DECIMAL(38,2)) AS amount_paid, 'check' AS payment_method, 'PLAN OF ' || n_name AS payer, 'WO' AS plb_reason, {money('balance')} AS plb_amount FROM pays JOIN totals USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey")
def c16_payment_views(spark, sf_dir):
    v = compat.payment_views(remittances(spark, sf_dir))
    plb = F.get("provider_adjustments", F.lit(0))
    return v.select("filename", "payment", F.col("amount_paid").cast("decimal(38,2)").alias("amount_paid"), "payment_method", "payer", plb.reason_code.alias("plb_reason"), plb.amount.alias("plb_amount"))


@query(f"{BASE} SELECT pays.filename, pays.\"row\" AS payment, 'payee' AS type, c_name AS name, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS identification_code FROM pays UNION ALL SELECT pays.filename, pays.\"row\", 'payer', 'PLAN OF ' || n_name, NULL FROM pays JOIN nation ON c_nationkey = n_nationkey")
def c16_organization_views(spark, sf_dir):
    return compat.organization_views(remittances(spark, sf_dir)).select("filename", "payment", "type", "name", "identification_code")


@query("SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' O''Neil-' || CASE WHEN c_custkey % 2 = 0 THEN 'Ray2Bob' ELSE 'D''Arc' END AS name FROM customer")
def f24_title_case(spark, sf_dir):
    """Every run of letters, after apostrophes, hyphens and digits too."""
    tail = F.when(F.col("c_custkey") % 2 == 0, "RAY2BOB").otherwise("D'ARC")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", compat.title_case(F.concat("c_mktsegment", F.lit(" O'NEIL-"), tail)).alias("name"))


# Functions


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, CASE WHEN l_linenumber > 3 THEN CAST(l_orderkey AS BIGINT) END AS digits FROM lineitem")
def f5_counts(spark, sf_dir):
    """Counts as digits, leading zeros included; anything else is none."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 9, "0")
    return x.select("l_orderkey", "l_linenumber", C.parse_unsigned(text).alias("n"), C.parse_unsigned(F.concat(F.when(F.col("l_linenumber") > 3, "").otherwise("+"), F.col("l_orderkey").cast("string"))).alias("digits"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS whole, CAST(l_shipdate AS DATE) AS day, CAST(l_linenumber * 60 AS BIGINT) AS seconds FROM lineitem")
def f8_exact_conversions(spark, sf_dir):
    """Whole numbers of doubles, days of midnights, seconds of larger units: exact, or an error."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select("l_orderkey", "l_linenumber", C.whole(F.col("l_quantity").cast("double")).alias("whole"), C.whole_days(F.col("l_shipdate").cast("timestamp")).alias("day"), C.whole_seconds(F.col("l_linenumber").cast("bigint") * 60_000, 1000).alias("seconds"))


@query(said(("not whole", "ConvertError"), ("out of range", "ConvertError"), ("too many decimals", "ConvertError"), ("not midnight", "ConvertError"), ("not whole seconds", "ConvertError"), ("not whole column", "SparkRuntimeException"), ("not midnight column", "SparkRuntimeException")))
def r9_convert_errors(spark, sf_dir):
    from decimal import Decimal

    one = spark.range(1)
    return facts(spark, [
        ("not whole", lambda: V.whole(1.5), "1.5"), ("out of range", lambda: V.whole(1e19), "1"), ("too many decimals", lambda: V.rescale(Decimal("1.234"), 2), "1.234"), ("not midnight", lambda: V.date_of(datetime.datetime(2024, 1, 1, 5)), "2024"), ("not whole seconds", lambda: V.seconds_of(1500, 1000), "1500"),
        ("not whole column", lambda: one.select(C.whole(F.lit(1.5))).collect(), "1.5"), ("not midnight column", lambda: one.select(C.whole_days(F.lit("2024-01-01 05:00:00").cast("timestamp"))).collect(), "whole day"),
    ])


@query(said(("two digit year", "ElementTextError"), ("outside a day", "ElementTextError"), ("seconds not held", "ElementTextError")))
def r10_element_text_errors(spark, sf_dir):
    return facts(spark, [("two digit year", lambda: V.date_element(datetime.date(2051, 1, 1), 6), "2051"), ("outside a day", lambda: V.time_element(90_000), "90000"), ("seconds not held", lambda: V.time_element(61, 4), "1")])


@query(said(("arity", "RowError"), ("cell type", "RowError"), ("float for money", "RowError")))
def r11_row_errors(spark, sf_dir):
    make = lambda row: lambda: rows.table_of(spark, builtin(), "provider_adjustments", [row])
    return facts(spark, [("arity", make((0, 1)), "2 cells"), ("cell type", make((0, 1, 0, None, "20240101", "P", "WO", "X")), "fiscal_period_date"), ("float for money", make((0, 1, 0, 1.5, None, "P", "WO", "X")), "amount")])


@query(said(("element", "SegmentWriteError"), ("component", "SegmentWriteError"), ("id", "SegmentWriteError")))
def r12_segment_write_errors(spark, sf_dir):
    d = Delimiters()
    return facts(spark, [("element", lambda: rows.segment_bytes(b"REF", [b"6R", b"a*b"], d), "element 2"), ("component", lambda: rows.segment_bytes(b"SVC", [[b"HC", b"1~"]], d), "component 2"), ("id", lambda: rows.segment_bytes(b"R:F", [b"x"], d), "segment id")])


# Specifications


@query("""SELECT '{"a": "z", "c": {"d": "e"}, "l": [3]}' AS v, 'merged' AS k""")
def f21_merge_patch(spark, sf_dir):
    """Objects merge, null deletes, arrays are replaced."""
    got = merge_patch({"a": "b", "c": {"d": "e", "f": "g"}, "l": [1, 2]}, {"a": "z", "c": {"f": None}, "l": [3]})
    return spark.createDataFrame([(json.dumps(got, sort_keys=True), "merged")], "v string, k string")


@query("SELECT * FROM (VALUES ('5010', '1000A', 'transaction'), ('5010', '1000B', 'transaction'), ('5010', '2000', 'transaction'), ('5010', '2100', '2000'), ('5010', '2110', '2100'), ('5010', 'group', 'interchange'), ('5010', 'interchange', NULL), ('5010', 'transaction', 'group')) t(version, loop, parent)")
def y1_loops_of_the_specification(spark, sf_dir):
    """Through JSON and back."""
    spec = Spec.from_json(json.dumps(builtin().source))
    return spark.createDataFrame([("5010", x.name, None if x.parent is None else spec.loops[x.parent].name) for x in spec.loops], "version string, loop string, parent string")


def _wrong(patch: dict) -> Callable:
    return lambda: builtin().patch(patch)


@query(said(("unknown key", "SpecError"), ("missing key", "SpecError"), ("wrong type", "SpecError"), ("not JSON", "SpecError")))
def y2_shape_errors(spark, sf_dir):
    return facts(spark, [("unknown key", _wrong({"loops": {"2100": {"colour": 1}}}), "loops.2100.colour"), ("missing key", _wrong({"loops": {"2100": {"trigger": None}}}), "loops.2100.trigger"), ("wrong type", _wrong({"loops": {"2100": {"occurrences": {"claim_adjustment": {"max": "many"}}}}}), "max"), ("not JSON", lambda: Spec.from_json("{"), "JSON")])


@query(said(("same trigger", "SpecError"), ("same code", "SpecError")))
def y3_ambiguity(spark, sf_dir):
    return facts(spark, [("same trigger", _wrong({"loops": {"1000C": {"parent": "transaction", "trigger": {"segment": "N1", "where": {"1": "PR"}}, "occurrences": {"n": {"segment": "N1", "pos": 10800}}}}}), "1000A"), ("same code", _wrong({"loops": {"2100": {"occurrences": {"twice": {"segment": "NM1", "pos": 20300, "qualifier": {"element": 1, "codes": ["QC"]}}}}}}), "QC")])


def _column(**c) -> Callable:
    return _wrong({"tables": {"claims": {"columns": {"new": c}}}})


_TABLE_ERRORS = [
    ("unknown loop", _wrong({"tables": {"t": {"loops": ["9999"], "columns": {}}}}), "9999"), ("no loop", _wrong({"tables": {"t": {"loops": [], "columns": {}}}}), "at least one"), ("nested anchors", _wrong({"tables": {"t": {"loops": ["2100", "2110"], "columns": {}}}}), "2110"),
    ("repeat without segment", _wrong({"tables": {"t": {"loops": ["2110"], "repeat": {"from": 2, "step": 3}, "columns": {}}}}), "repeat"), ("reserved ref", _wrong({"tables": {"claims": {"ref": "row"}}}), "row"), ("ref twice", _wrong({"tables": {"services": {"ref": "claim"}}}), "claim"),
    ("anchor taken", _wrong({"tables": {"t": {"loops": ["2100"], "ref": "t", "columns": {}}}}), "2100"), ("reserved column", _wrong({"tables": {"claims": {"columns": {"segment": {"segment": "CLP", "element": 1}}}}}), "segment"), ("two sources", _column(segment="CLP", element=1, segment_index=True), "exactly one"),
    ("no segment", _column(element=1), "segment"), ("unknown loop of a column", _column(segment="CLP", element=1, loop="9999"), "9999"), ("loop aside", _column(segment="N1", element=1, loop="1000B"), "1000B"), ("unknown occurrence", _column(occurrence="none", element=1), "none"),
    ("occurrence and where", _column(occurrence="patient_name", segment="NM1", element=1), "occurrence"), ("pick without occurrence", _column(segment="CLP", element=1, pick="last"), "pick"), ("pick beyond the most", _column(occurrence="patient_name", element=3, pick=5), "at most"), ("wrong pick", _column(occurrence="claim_adjustment", element=1, pick="any"), "pick"),
    ("group without repeat", _column(group_element=0), "group_element"), ("index with component", _column(segment="CLP", segment_index=True, component=1), "component"), ("phi of another type", _column(segment="CLP", element=3, phi="name"), "phi"), ("seed that is no id", _wrong({"tables": {"claims": {"phi_seed": "claim_status"}}}), "phi_seed"),
    ("default table", _wrong({"default_table": "none"}), "none"), ("summary table", _wrong({"summaries": {"s": {"count": {"table": "none"}}}}), "none"), ("summary column", _wrong({"summaries": {"s": {"sum": {"table": "claims", "column": "none"}}}}), "none"), ("summary type", _wrong({"summaries": {"s": {"sum": {"table": "claims", "column": "claim_id"}}}}), "claim_id"),
    ("balance loop", _wrong({"balancing": {"b": {"per": "9999", "target": [], "sum": []}}}), "9999"), ("balance without terms", _wrong({"balancing": {"b": {"per": "2100", "target": [], "sum": []}}}), "at least one"), ("balance occurrence", _wrong({"balancing": {"b": {"per": "2100", "target": [{"occurrence": "none", "elements": [1]}], "sum": [{"occurrence": "claim_adjustment", "elements": [3]}]}}}), "none"),
    ("balance of text", _wrong({"balancing": {"b": {"per": "2100", "target": [{"occurrence": "claim_payment_information", "elements": [1]}], "sum": [{"occurrence": "claim_adjustment", "elements": [3]}]}}}), "CLP01"), ("parent", _wrong({"loops": {"2110": {"parent": "9999"}}}), "9999"), ("ring", _wrong({"loops": {"2000": {"parent": "2110"}}}), "ring"),
    ("version", _wrong({"version": {"values": []}}), "version.values"), ("min above max", _wrong({"segments": {"CLP": {"elements": {"1": {"min": 9, "max": 3}}}}}), "min 9"),
]


@query(said(*((name, "SpecError") for name, _, _ in _TABLE_ERRORS)))
def y4_compile_errors(spark, sf_dir):
    return facts(spark, _TABLE_ERRORS)


@query(said(("element type", "SpecError"), ("scale", "SpecError"), ("codes of numbers", "SpecError"), ("usage", "SpecError"), ("end is the trigger", "SpecError"), ("unknown table", "SpecError"), ("unknown loop", "SpecError")))
def r6_spec_errors(spark, sf_dir):
    element = lambda **e: _wrong({"segments": {"CLP": {"elements": {"1": e}}}})
    return facts(spark, [
        ("element type", element(type="XX"), "XX"), ("scale", element(type="AN", scale=3), "scale"), ("codes of numbers", element(type="R", codes=["1"]), "codes"), ("usage", _wrong({"loops": {"2110": {"usage": "maybe"}}}), "usage"),
        ("end is the trigger", _wrong({"loops": {"2110": {"end": "SVC"}}}), "SVC"), ("unknown table", lambda: builtin().table("none"), "claims"), ("unknown loop", lambda: builtin().loop("none"), "2100"),
    ])


@query(said(("undeclared", "SummaryError"), ("missing table", "SummaryError"), ("missing column", "SummaryError"), ("not one row", "SummaryError")))
def r7_summary_errors(spark, sf_dir):
    claims = parse_files(remittances(spark, sf_dir), Options("claims"))
    pays = parse_files(remittances(spark, sf_dir), Options("payments"))
    s = lambda tables, name: lambda: summary.summary(builtin(), tables, name)
    return facts(spark, [("undeclared", s({}, "none"), "count_claims"), ("missing table", s({}, "count_claims"), "claims"), ("missing column", s({"claims": claims.drop("patient_id")}, "count_patients"), "patient_id"), ("not one row", s({"payments": pays}, "payer"), "one row")])


# Writing

ENVELOPE = writer.Envelope(sender="PAYER", receiver="RECEIVER", date="20240110", time="0900")


def _small(spark, sf_dir) -> dict[str, DataFrame]:
    """The tables of the first payment of the first file."""
    r = Remittance(remittances(spark, sf_dir).filter("filename = 'bucket-000000.835'")).once(list(builtin().table_names))
    return {n: (df.filter("row = 0") if n == "payments" else df.filter("payment = 0")).drop("filename") for n, df in r.tables.items()}


@query(said(("strict", "WriteError")) + " UNION ALL SELECT 'with findings: ReadBack claims charge_amount', 'none', TRUE")
def w1_strict_write(spark, sf_dir):
    """Nothing is written with a finding, unless it is asked for."""
    t = _small(spark, sf_dir)
    wrong = t | {"claims": t["claims"].withColumn("charge_amount", F.when(F.col("row") == 0, F.col("charge_amount") + 1).otherwise(F.col("charge_amount")).cast("decimal(38,2)"))}
    out = facts(spark, [("strict", lambda: writer.write(wrong, ENVELOPE), "nothing was written")])
    _, found = writer.write(wrong, ENVELOPE, allow_findings=True)
    shown = [(f"with findings: {f['kind']} {f['table']} {f['column']}", "none", True) for f in found]
    return out.unionByName(spark.createDataFrame(shown, out.schema))


@query(f"{BASE} SELECT 'claims' AS what, count(*) AS n FROM claims WHERE {NUMBER} = 0 UNION ALL SELECT 'adjustments', count(*) FROM adjustments WHERE {NUMBER} = 0")
def w2_copy(spark, sf_dir):
    """A query of one struct with a list for each table, to a file that reads back."""
    tables = Remittance(remittances(spark, sf_dir).filter("filename = 'bucket-000000.835'")).once(list(builtin().table_names)).tables
    one = None
    for name, df in tables.items():
        listed = df.drop("filename").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "filename"]))).alias(name))
        one = listed if one is None else one.crossJoin(listed)  # one row each
    path = f"{scratch(spark, 'copy')}.835"
    writer.copy_835(spark, one.select(F.struct(*tables).alias("t")), path, sender_id="PAYER", receiver_id="RECEIVER", date="20240110", time="0900")
    read = lambda name: R.read_835(spark, path, name).agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    return read("claims").unionByName(read("adjustments"))


@query(f"{BASE} SELECT filename, TRUE AS longer, count(*) AS n FROM claims GROUP BY 1")
def w2_many_files(spark, sf_dir):
    """A file for each group of rows, written by the tasks and read back from disk."""
    r = Remittance(remittances(spark, sf_dir)).once(list(builtin().table_names))
    at = scratch(spark, "written")
    sizes = writer.save_each(writer.write_files(r.tables, ENVELOPE), at)
    sizes = spark.createDataFrame(sizes.collect(), sizes.schema)
    back = R.read_835(spark, f"{at}/*.835", "claims", filename=True).groupBy(_base_name().alias("filename")).agg(F.count(F.lit(1)).alias("n"))
    return back.join(sizes, "filename").select("filename", (F.col("n_bytes") > 1000).alias("longer"), "n")


@query(said(("same byte", "ValueError"), ("letter", "ValueError"), ("blank", "ValueError"), ("no repetition", "WriteError")))
def w13_delimiter_checks(spark, sf_dir):
    from remitta.operators.writer import Assembler, Plan

    empty = lambda d: lambda: Assembler(builtin(), Plan(builtin()), writer.Envelope("A", "B", "20240110", "0900", delimiters=d), {}).file()
    return facts(spark, [("same byte", lambda: Delimiters(b"*", b"*").checked(), "same"), ("letter", lambda: Delimiters(b"a").checked(), "a"), ("blank", lambda: Delimiters(b" ").checked(), " "), ("no repetition", empty(Delimiters(repetition=None)), "ISA11")])


_FINDINGS = [
    ("MissingParent", "services", "claim", "9999L"), ("MissingParent", "claims", "payment", "cast(null as bigint)"), ("DuplicateRowNumber", "claims", "row", "0L"), ("DelimiterInValue", "claims", "claim_id", "'A*1'"), ("ReadBack", "claims", "claim_status", "'99'"),
    ("MismatchedReference", "adjustments", "claim", "claim + 1"), ("OutOfOrder", "services", "row", "1000L - row"), ("NotWritable", "claims", "statement_from", "date'1949-12-31'"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', '{c}', TRUE)" for k, t, c, _ in _FINDINGS) + ") t(kind, table_name, column_name, found)")
def w14_findings(spark, sf_dir):
    """Each kind of finding, by a table that has it."""
    t, out = _small(spark, sf_dir), []
    t = {k: v.persist() for k, v in t.items()}
    spec = builtin().patch({"segments": {"DTM": {"elements": {"2": {"min": 6, "max": 6}}}}})  # dates of two-digit years
    for kind, table, column, value in _FINDINGS:
        try:
            _, found = writer.write(t | {table: t[table].withColumn(column, F.expr(value))}, ENVELOPE, spec, allow_findings=True)
            kinds = {f["kind"] for f in found}
        except Exception as e:  # shown as a kind of its own
            kinds = {type(e).__name__}
        out.append((kind, table, column, kind in kinds))
    for df in t.values():
        df.unpersist()
    return spark.createDataFrame(out, "kind string, table_name string, column_name string, found boolean")


def _plan(patch: dict) -> Callable:
    return lambda: writer.Plan(builtin().patch(patch))


_REFUSALS = [
    ("segment index", _plan({"tables": {"claims": {"columns": {"at": {"segment": "NM1", "segment_index": True}}}}}), "index"), ("pick", _plan({"tables": {"claims": {"columns": {"a": {"occurrence": "claim_adjustment", "element": 1, "pick": "last"}}}}}), "last"),
    ("required loop", _plan({"tables": {"payments": {"columns": {c: None for c in ("payee_name", "payee_id", "payee_id_qualifier", "payee_address", "payee_city", "payee_state", "payee_zip")}}}, "summaries": None}), "1000B"),
    ("required occurrence", _plan({"tables": {"payments": {"columns": {"trace_number": None, "payer_identifier": None}}}}), "reassociation_trace_number"), ("ambiguous source", _plan({"tables": {"claims": {"columns": {"any_name": {"segment": "NM1", "element": 3}}}}}), "NM1"),
    ("no occurrence", _plan({"tables": {"claims": {"columns": {"other": {"segment": "LQ", "element": 2}}}}}), "LQ"), ("same element twice", _plan({"tables": {"claims": {"columns": {"again": {"segment": "CLP", "element": 1}}}}}), "CLP01"),
    ("several anchors", _plan({"tables": {"t": {"loops": ["1000A", "1000B"], "ref": "t", "columns": {"name": {"segment": "N1", "element": 2}}}}}), "anchor"),
    ("repeat of a trigger", _plan({"tables": {"t": {"loops": ["2000"], "segment": "LX", "repeat": {"from": 1, "step": 1}, "columns": {"n": {"group_element": 0}}}}}), "LX"),
    ("repeat without occurrence", _plan({"tables": {"t": {"loops": ["2000"], "segment": "AMT", "repeat": {"from": 1, "step": 1}, "columns": {"n": {"group_element": 0}}}}}), "AMT"),
    ("repeat writes twice", _plan({"tables": {"adjustments": {"columns": {"again": {"group_element": 1}}}}}), "again"), ("no transaction table", lambda: writer.Assembler((s := builtin().patch({"tables": {"payments": None}, "summaries": None})), writer.Plan(s), ENVELOPE, {}).file(), "counts segments"),
]


@query(said(*((name, "PlanError") for name, _, _ in _REFUSALS)))
def w16_plan_refusals(spark, sf_dir):
    """Specifications whose tables can't be turned back into files."""
    return facts(spark, _REFUSALS)


@query(said(("float for money", "CopyError"), ("unknown column", "WriteError"), ("wrong type", "WriteError"), ("unknown table", "WriteError")) + " UNION ALL SELECT 'integers for money', 'none', FALSE")
def w17_input_conversion(spark, sf_dir):
    """Types that can hold the values are taken, floats for money are not."""
    plb = parse_files(remittances(spark, sf_dir), Options("provider_adjustments")).drop("filename")
    check = lambda df: lambda: writer.check_types(builtin(), builtin().table("provider_adjustments"), df)
    return facts(spark, [("float for money", check(plb.withColumn("amount", F.lit(1.5))), "amount"), ("unknown column", check(plb.withColumn("more", F.lit(1))), "more"), ("wrong type", check(plb.withColumn("fiscal_period_date", F.lit("x"))), "fiscal_period_date"), ("unknown table", lambda: writer.write_files({"none": plb}, ENVELOPE), "none"), ("integers for money", check(plb.withColumn("amount", F.lit(2))), "amount")])


@query(said(("longer target", "CopyError")) + " UNION ALL SELECT 'shorter target', 'replaced', TRUE UNION ALL SELECT 'refused write', 'untouched', TRUE")
def w18_target_file(spark, sf_dir):
    """The target changes only when the file was accepted; a longer one is refused."""
    at = scratch(spark, "target")
    one = lambda name, size: spark.createDataFrame([(name, bytearray(b"x" * size))], "filename string, content binary")
    writer.save_each(one("long.835", 5000).unionByName(one("short.835", 5)).unionByName(one("kept.835", 7)), at).count()
    size = lambda name: spark.read.format("binaryFile").load(f"{at}/{name}").first().length
    out = facts(spark, [("longer target", lambda: writer.save(spark, b"y" * 100, f"{at}/long.835"), "longer")])
    writer.save(spark, b"y" * 100, f"{at}/short.835")
    row = spark.createDataFrame([(([{"row": 0, "claim_id": "x"}],),)], "t struct<claims: array<struct<row: bigint, claim_id: string>>>")
    try:
        writer.copy_835(spark, row, f"{at}/kept.835", sender_id="A", receiver_id="B", date="20240110", time="0900")
    except Exception:  # the point is what stands in the target afterwards
        pass
    more = [("shorter target", "replaced" if size("short.835") == 100 else "kept", True), ("refused write", "untouched" if size("kept.835") == 7 else "changed", True)]
    return out.unionByName(spark.createDataFrame(more, out.schema))


_COPY = {"sender_id": "A", "receiver_id": "B", "date": "20240110", "time": "0900"}


@query(said(*((n, "CopyError") for n in ("unknown option", "file option", "missing option", "no value", "option value", "fractional time", "time outside a day", "unknown version", "unknown delimiter", "delimiter length", "column count", "not a struct", "not rows"))))
def r2_copy_errors(spark, sf_dir):
    good = spark.createDataFrame([], "t struct<claims: array<struct<row: bigint>>>")
    copy = lambda df=good, **o: lambda: writer.copy_835(spark, df, "/nowhere/x.835", **{k: v for k, v in (_COPY | o).items() if v != "-"})
    return facts(spark, [
        ("unknown option", copy(colour="red"), "colour"), ("file option", copy(compression="gzip"), "compression"), ("missing option", copy(date="-"), "date"), ("no value", copy(sender_id=None), "sender_id"), ("option value", copy(line_break="yes"), "line_break"), ("fractional time", copy(time=datetime.time(9, 0, 0, 5)), "fraction"),
        ("time outside a day", copy(time=90_000), "90000"), ("unknown version", copy(version="6010"), "6010"), ("unknown delimiter", copy(delimiters={"colour": "x"}), "colour"), ("delimiter length", copy(delimiters={"element": "xx"}), "xx"), ("column count", copy(good.withColumn("b", F.lit(1))), "2"),
        ("not a struct", copy(spark.createDataFrame([], "t bigint")), "bigint"), ("not rows", copy(spark.createDataFrame([], "t struct<claims: bigint>")), "claims"),
    ])


@query(said(("unknown table", "WriteError"), ("unknown column", "WriteError"), ("column type", "WriteError"), ("delimiter", "ValueError"), ("no repetition", "WriteError")))
def r5_write_errors(spark, sf_dir):
    plb = parse_files(remittances(spark, sf_dir), Options("provider_adjustments")).drop("filename").limit(1)
    write = lambda t, e=ENVELOPE: lambda: writer.write(t, e)
    bad = lambda d: writer.Envelope("A", "B", "20240110", "0900", delimiters=d)
    return facts(spark, [("unknown table", write({"none": plb}), "none"), ("unknown column", write({"provider_adjustments": plb.withColumn("more", F.lit(1))}), "more"), ("column type", write({"provider_adjustments": plb.withColumn("row", F.lit("x"))}), "row"), ("delimiter", write({"provider_adjustments": plb}, bad(Delimiters(b"*", b"*"))), "same"), ("no repetition", write({}, bad(Delimiters())), "ISA11")])


@query("SELECT * FROM (VALUES ('NotAnInterchange', TRUE), ('ReadError', TRUE), ('SpecError', TRUE), ('WriteError', TRUE), ('MaskError', TRUE)) t(error, is_value_error)")
def r13_value_errors(spark, sf_dir):
    """What callers catch: all are value errors."""
    from remitta import errors

    names = ("NotAnInterchange", "ReadError", "SpecError", "WriteError", "MaskError")
    return spark.createDataFrame([(n, issubclass(getattr(errors, n), ValueError)) for n in names], "error string, is_value_error boolean")


@query(said(("short key", "MaskError"), ("unknown date mode", "MaskError")))
def r8_mask_errors(spark, sf_dir):
    from remitta.operators.masking import Mask

    return facts(spark, [("short key", lambda: Mask(b"123"), "3 bytes"), ("unknown date mode", lambda: Mask(KEY, "week"), "week")])


@query(f"{BASE} SELECT count(*) AS n, CAST(sum({money('charge')}) AS DECIMAL(38,2)) AS charge, 'decimal128(38, 2)' AS kind FROM claims")
def w19_arrow_export(spark, sf_dir):
    """A table as Arrow; here its figures."""
    t = parse_files(remittances(spark, sf_dir), Options("claims")).select("charge_amount").toArrow()
    import pyarrow.compute as pc

    return spark.createDataFrame([(t.num_rows, pc.sum(t["charge_amount"]).as_py(), str(t.schema.field("charge_amount").type))], "n bigint, charge decimal(38,2), kind string")


@query(f"{BASE} SELECT 1 AS line, '## provider_adjustments (rows: ' || count(*) || ')' AS text FROM pays WHERE {NUMBER} = 0 UNION ALL SELECT 2, 'row: int64 | amount: decimal128(38, 2) | provider_id: binary' UNION ALL SELECT CAST(\"row\" + 3 AS INTEGER), \"row\" || ' | ' || CAST({money('balance')} AS VARCHAR) || ' | PRV' || c_custkey FROM pays WHERE {NUMBER} = 0")
def w20_rendered_text(spark, sf_dir):
    """A table as text, a line for each row."""
    got = parse_files(remittances(spark, sf_dir).filter("filename = 'bucket-000000.835'"), Options("provider_adjustments", binary=True)).orderBy("row").collect()
    text = render("provider_adjustments", [("row", "int", 0, None), ("amount", "decimal", 2, None), ("provider_id", "binary", 0, None)], [[r.row, r.amount, bytes(r.provider_id)] for r in got])
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"), 1)), "line int, text string")


@query(f"{BASE} SELECT 'PLAN OF ' || n_name AS payer, '2024-01' AS month, count(*) AS n, CAST(sum({money('paid')}) AS DECIMAL(38,2)) AS paid FROM claims JOIN customer USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def w21_lake(spark, sf_dir):
    """Claims by payer and month as Parquet, read back by folder."""
    at = scratch(spark, "lake")
    lake(Remittance(remittances(spark, sf_dir)).once(["claims", "payments"]), at)
    back = spark.read.parquet(at).filter("month = '2024-01'")
    return back.groupBy("payer", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("payment_amount").cast("decimal(38,2)").alias("paid"))


@query(f"{BASE} SELECT filename || ',' || \"row\" || ',' || CASE WHEN balance < 0 THEN '' ELSE '' END || CAST({money('balance')} AS VARCHAR) AS line FROM pays")
def f22_csv_lines(spark, sf_dir):
    rows_of = parse_files(remittances(spark, sf_dir), Options("provider_adjustments")).select("filename", "row", "amount")
    return csv_lines(rows_of)


# Other validators


def _stand_in(text: str) -> tuple:
    """What the package would report: every claim's charge, and the count of each transaction."""
    segments, at, found, done = text.split("~"), 0, [], []
    for line, s in enumerate(segments, 1):
        s = s.lstrip("\n")
        done.append(line)
        if s.startswith("CLP*"):
            found.append({"cur_line": line, "errors": [], "elements": [{"ele_pos": 3, "subele_pos": None, "errors": [{"err_cde": "6", "x12_code": None, "err_str": "odd charge", "err_val": s.split("*")[3]}]}]})
        at += 1
    st = {"errors": [{"err_cde": "4", "x12_code": None, "err_str": "wrong count", "err_val": "1"}], "segments": found}
    return json.dumps({"interchanges": [{"errors": [], "groups": [{"errors": [], "transactions": [st]}]}]}), done, False, None


@query(f"{BASE} SELECT filename, CAST(o_orderkey AS VARCHAR) AS claim_id, CAST({money('charge')} AS VARCHAR) AS datum, '6' AS code, CAST(3 AS BIGINT) AS element, CAST(2 AS BIGINT) AS level, 'odd charge (reported by pyx12, code 6)' AS rule FROM claims")
def x1_pyx12(spark, sf_dir):
    """The adapter with a stand-in for the package: numbered pieces land on their segments."""
    files = remittances(spark, sf_dir)
    got = external.external_findings(files, pyx12_validator(_stand_in), "pyx12").filter("code = '6'").select("filename", "segment", "datum", "code", "element", "level", "rule")
    return got.join(parse_files(files, Options("claims")).select("filename", "segment", "claim_id"), ["filename", "segment"]).drop("segment")


@query(f"{BASE} SELECT DISTINCT filename, '4' AS code, CAST(1 AS BIGINT) AS level, 'SE' AS id FROM cust")
def x2_envelope_places(spark, sf_dir):
    """An error of a transaction's count stands at its trailer."""
    files = remittances(spark, sf_dir)
    got = external.external_findings(files, pyx12_validator(_stand_in), "pyx12").filter("code = '4'").select("filename", "segment", "code", "level")
    return got.join(Remittance(files).segments("filename", "segment", "id"), ["filename", "segment"]).select("filename", "code", "level", "id")


@query(f"{BASE} SELECT DISTINCT filename, CAST(1 AS BIGINT) AS level, 'ZeroDivisionError: division by zero (reported by other)' AS rule FROM cust")
def x3_failure_finding(spark, sf_dir):
    return external.external_findings(remittances(spark, sf_dir), lambda data: 1 / 0, "other").filter("segment is null").select("filename", "level", "rule")

