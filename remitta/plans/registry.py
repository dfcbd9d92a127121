"""Registered queries over the 835 engine, with the same results in DuckDB's SQL.

The driver's tables hold no 835 files. Most queries therefore write files from customers, orders and lines (generate.py),
read them back with the engine, and the SQL computes what must come out from the tables alone. The others apply the
column functions to the tables' own texts and times. Every query covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitta.functions import columns as C
from remitta.operators import compat, external, native_lexer, structure, summary, writer
from remitta.plans.builtin import builtin
from remitta.plans.generate import LINES, PER_FILE, remittances
from remitta.sources.remittance import DIAGNOSTICS, Options, Remittance, parse_files

KEY = b"a-secret-of-at-least-16-bytes"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from remitta.plans import registry_findings, registry_surface  # noqa: F401  (they register themselves)

    return dict(_QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(_ORACLES)


# The generated files, as SQL over the tables

_MONEY = "CAST(({0}) / 100.0 AS DECIMAL(38,2))"
BASE = f"""
WITH cfg AS (SELECT greatest(4, count(*) // {PER_FILE}) AS n FROM customer),
lines AS ({LINES.format(div="//")}),
per AS (SELECT l_orderkey AS okey, sum(charge) AS charge, sum(charge - discount - tax) AS paid, sum(tax) AS tax, count(*) AS n_lines FROM lines GROUP BY 1),
cust AS (SELECT *, 'bucket-' || lpad(CAST(c_custkey % n AS VARCHAR), 6, '0') || '.835' AS filename, CAST(round(c_acctbal * 100) AS BIGINT) AS balance
         FROM customer, cfg WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN per ON o_orderkey = okey)),
pays AS (SELECT cust.*, row_number() OVER (PARTITION BY filename ORDER BY c_custkey) - 1 AS "row" FROM cust),
cl AS (SELECT pays.filename, pays."row" AS payment, c_custkey, c_name, c_mktsegment, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS ordered, per.charge, per.paid, per.tax, per.n_lines,
              dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS lx
       FROM orders JOIN per ON o_orderkey = okey JOIN pays ON o_custkey = c_custkey),
claims AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY c_custkey, lx, o_orderkey) - 1 AS "row" FROM cl),
services AS (SELECT claims.filename, payment, claims."row" AS claim, c_custkey, o_orderkey, lines.*, row_number() OVER (PARTITION BY filename ORDER BY c_custkey, lx, o_orderkey, l_linenumber, l_partkey, lines.charge, qty, shipped, discount, lines.tax) - 1 AS "row"
             FROM lines JOIN claims ON l_orderkey = o_orderkey),
adj AS (SELECT filename, payment, claim, "row" AS service, k, CASE k WHEN 1 THEN 'CO' ELSE 'PR' END AS group_code, CASE k WHEN 1 THEN '45' WHEN 2 THEN '1' ELSE '2' END AS reason_code,
               CASE k WHEN 1 THEN discount WHEN 2 THEN tax ELSE 0 END AS cents, CASE k WHEN 2 THEN qty END AS quantity
        FROM services, (VALUES (1), (2), (3)) t(k)),
adjustments AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY service, k) - 1 AS "row" FROM adj),
totals AS (SELECT filename, c_custkey, payment, sum(paid) AS paid, sum(n_lines) AS n_lines, count(*) AS n_claims, max(lx) AS n_lx FROM claims GROUP BY ALL)
"""


def money(cents: str) -> str:
    return _MONEY.format(cents)


def _read(spark: SparkSession, sf_dir: str, table: str, faults: bool = False, **options) -> DataFrame:
    return parse_files(remittances(spark, sf_dir, faults), Options(table, **options))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "claims").select("filename", "row", "payment", "claim_id", "charge_amount", "payment_amount", "patient_id", "statement_from")


# Scans

_CLAIM_COLUMNS = f"""filename, "row", payment, CAST(o_orderkey AS VARCHAR) AS claim_id, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '4' ELSE '2' END AS claim_status,
 {money('charge')} AS charge_amount, {money('paid')} AS payment_amount, {money('tax')} AS patient_responsibility, CAST(lx AS BIGINT) AS header_number, 'ICN' || o_orderkey AS payer_control_number,
 c_name AS patient_last_name, c_mktsegment AS patient_first_name, 'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS patient_id, ordered AS statement_from"""
_CLAIMS = ["filename", "row", "payment", "claim_id", "claim_status", "charge_amount", "payment_amount", "patient_responsibility", "header_number", "payer_control_number", "patient_last_name", "patient_first_name", "patient_id", "statement_from"]


@query(f"{BASE} SELECT {_CLAIM_COLUMNS} FROM claims")
def s1_read_claims(spark, sf_dir):
    return _read(spark, sf_dir, "claims").select(*_CLAIMS)


@query(f"""{BASE} SELECT filename, "row", payment, claim, 'HC' AS procedure_qualifier, CAST(l_partkey AS VARCHAR) AS procedure_code, {money('charge')} AS charge_amount, {money('charge - discount - tax')} AS payment_amount,
 CAST(qty AS DECIMAL(38,2)) AS units_paid, shipped AS service_date, l_orderkey || '-' || l_linenumber AS line_item_control_number FROM services""")
def s1_read_services(spark, sf_dir):
    return _read(spark, sf_dir, "services").select("filename", "row", "payment", "claim", "procedure_qualifier", "procedure_code", "charge_amount", "payment_amount", "units_paid", "service_date", "line_item_control_number")


@query(f"""{BASE} SELECT filename, "row", payment, claim, service, group_code, reason_code, {money('cents')} AS amount, CAST(quantity AS DECIMAL(38,2)) AS quantity FROM adjustments""")
def p7_unnest_adjustments(spark, sf_dir):
    return _read(spark, sf_dir, "adjustments").select("filename", "row", "payment", "claim", "service", "group_code", "reason_code", "amount", "quantity")


@query(f"""{BASE} SELECT pays.filename, pays."row", 'I' AS handling_code, {money('totals.paid - balance')} AS total_payment_amount, DATE '2024-01-12' AS payment_date, DATE '2024-01-10' AS production_date, 'CHK' || pays.c_custkey AS trace_number,
 'R' || pays.c_custkey AS receiver_id, 'PLAN OF ' || n_name AS payer_name, 'TOWN' AS payer_city, c_name AS payee_name, lpad(CAST(pays.c_custkey AS VARCHAR), 10, '0') AS payee_id, 'EDI DESK' AS payer_technical_contact_name
 FROM pays JOIN totals USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey""")
def s1_read_payments(spark, sf_dir):
    return _read(spark, sf_dir, "payments").select("filename", "row", "handling_code", "total_payment_amount", "payment_date", "production_date", "trace_number", "receiver_id", "payer_name", "payer_city", "payee_name", "payee_id", "payer_technical_contact_name")


@query(f"""{BASE} SELECT filename, "row", "row" AS payment, 'PRV' || c_custkey AS provider_id, DATE '2024-12-31' AS fiscal_period_date, 'WO' AS reason_code, 'A' || c_custkey AS reference_id, {money('balance')} AS amount FROM pays""")
def s1_read_provider_adjustments(spark, sf_dir):
    return _read(spark, sf_dir, "provider_adjustments").select("filename", "row", "payment", "provider_id", "fiscal_period_date", "reason_code", "reference_id", "amount")


@query(f"{BASE} SELECT count(*) AS n_claims, sum({money('paid')}) AS paid FROM claims")
def s5_default_table(spark, sf_dir):
    return _read(spark, sf_dir, None).agg(F.count(F.lit(1)).alias("n_claims"), F.sum("payment_amount").cast("decimal(38,2)").alias("paid"))


@query(f"{BASE} SELECT filename, count(*) AS n_claims FROM claims GROUP BY filename")
def s6_filename(spark, sf_dir):
    return _read(spark, sf_dir, "claims").groupBy("filename").agg(F.count(F.lit(1)).alias("n_claims"))


@query(f"{BASE} SELECT 'NotAnInterchange' AS kind, count(*) AS n FROM cust WHERE c_custkey % 50 = 0")
def s9_ignore_errors(spark, sf_dir):
    """Files cut short for some customers: no rows, one finding each."""
    have = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").join(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")
    bad = have.filter("o_custkey % 50 = 0").select("o_custkey").distinct().select(F.concat(F.lit("bad-"), "o_custkey").alias("filename"), F.lit("ISA*00*").cast("binary").alias("content"))
    both = remittances(spark, sf_dir).unionByName(bad)
    return parse_files(both, Options(DIAGNOSTICS, ignore_errors=True)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT filename, \"row\", hex(encode(CAST(o_orderkey AS VARCHAR))) AS claim_id_hex FROM claims")
def s10_binary(spark, sf_dir):
    return _read(spark, sf_dir, "claims", binary=True).select("filename", "row", F.hex("claim_id").alias("claim_id_hex"))


# Lexing and structure


@query(f"""{BASE}, ids AS (SELECT filename, 'CLP' AS id, sum(n_claims) AS n FROM totals GROUP BY 1 UNION ALL SELECT filename, 'SVC', sum(n_lines) FROM totals GROUP BY 1 UNION ALL SELECT filename, 'CAS', 2 * sum(n_lines) FROM totals GROUP BY 1
 UNION ALL SELECT filename, 'DTM', sum(n_lines) + sum(n_claims) + count(*) FROM totals GROUP BY 1 UNION ALL SELECT filename, 'REF', sum(n_lines) + count(*) FROM totals GROUP BY 1 UNION ALL SELECT filename, 'NM1', sum(n_claims) FROM totals GROUP BY 1
 UNION ALL SELECT filename, 'LX', sum(n_lx) FROM totals GROUP BY 1 UNION ALL SELECT filename, 'N1', 2 * count(*) FROM totals GROUP BY 1
 UNION ALL SELECT filename, x, count(*) FROM totals, (VALUES ('ST'), ('BPR'), ('TRN'), ('N3'), ('N4'), ('PER'), ('PLB'), ('SE')) v(x) GROUP BY 1, 2 UNION ALL SELECT DISTINCT filename, x, 1 FROM totals, (VALUES ('ISA'), ('GS'), ('GE'), ('IEA'), ('')) v(x))
 SELECT filename, id, CAST(n AS BIGINT) AS n FROM ids""")
def l5_segments_by_id(spark, sf_dir):
    return Remittance(remittances(spark, sf_dir)).segments("filename", "id").groupBy("filename", "id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{BASE}, ids AS (SELECT filename, 'CLP' AS id, sum(n_claims) AS n FROM totals GROUP BY 1 UNION ALL SELECT filename, 'SVC', sum(n_lines) FROM totals GROUP BY 1 UNION ALL SELECT filename, 'CAS', 2 * sum(n_lines) FROM totals GROUP BY 1
 UNION ALL SELECT filename, 'DTM', sum(n_lines) + sum(n_claims) + count(*) FROM totals GROUP BY 1 UNION ALL SELECT filename, 'REF', sum(n_lines) + count(*) FROM totals GROUP BY 1 UNION ALL SELECT filename, 'NM1', sum(n_claims) FROM totals GROUP BY 1
 UNION ALL SELECT filename, 'LX', sum(n_lx) FROM totals GROUP BY 1 UNION ALL SELECT filename, 'N1', 2 * count(*) FROM totals GROUP BY 1
 UNION ALL SELECT filename, x, count(*) FROM totals, (VALUES ('ST'), ('BPR'), ('TRN'), ('N3'), ('N4'), ('PER'), ('PLB'), ('SE')) v(x) GROUP BY 1, 2 UNION ALL SELECT DISTINCT filename, x, 1 FROM totals, (VALUES ('ISA'), ('GS'), ('GE'), ('IEA'), ('')) v(x))
 SELECT filename, id, CAST(n AS BIGINT) AS n FROM ids""")
def l6_native_segments_by_id(spark, sf_dir):
    """The same counts without leaving the JVM."""
    return native_lexer.segments(remittances(spark, sf_dir)).groupBy("filename", "id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT filename, group_code, reason_code, CAST(sum({money('cents')}) AS DECIMAL(38,2)) AS amount FROM adj WHERE k < 3 GROUP BY 1, 2, 3")
def l7_native_first_reasons(spark, sf_dir):
    """Amounts of the first adjustment of each CAS, read by position."""
    cas = native_lexer.segments(remittances(spark, sf_dir)).filter("id = 'CAS'")
    return cas.groupBy("filename", native_lexer.element(1).alias("group_code"), native_lexer.element(2).alias("reason_code")).agg(F.sum(C.parse_r(native_lexer.element(3))).cast("decimal(38,2)").alias("amount"))


@query(f"{BASE} SELECT filename, TRUE AS equal, CAST(5 + sum(12 + n_lx + 3 * n_claims + 5 * n_lines) AS BIGINT) AS n FROM totals GROUP BY 1")
def l10_lossless(spark, sf_dir):
    """The segments' bytes in order are the file."""
    files = remittances(spark, sf_dir)
    listed = F.array_sort(F.collect_list(F.struct("segment", "raw")))
    again = Remittance(files).segments("filename", "segment", "raw").groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("", F.transform(listed, lambda x: F.decode(x.raw, "ISO-8859-1"))), 256).alias("written"))
    return files.select("filename", F.sha2(F.decode("content", "ISO-8859-1"), 256).alias("read")).join(again, "filename").select("filename", (F.col("read") == F.col("written")).alias("equal"), "n")


@query(f"""{BASE} SELECT filename, l.x AS "loop", CAST(CASE l.x WHEN '2000' THEN sum(n_lx) WHEN '2100' THEN sum(n_claims) WHEN '2110' THEN sum(n_lines) WHEN 'interchange' THEN 1 WHEN 'group' THEN 1 ELSE count(*) END AS BIGINT) AS last_ordinal
 FROM totals, (VALUES ('interchange'), ('group'), ('transaction'), ('1000A'), ('1000B'), ('2000'), ('2100'), ('2110')) l(x) GROUP BY 1, 2""")
def e2_ordinals(spark, sf_dir):
    opened = Remittance(remittances(spark, sf_dir)).segments("filename", "opens").select("filename", F.explode("opens").alias("o"))
    return opened.groupBy("filename", F.col("o.loop").alias("loop")).agg(F.max("o.ordinal").alias("last_ordinal"))


@query(f"{BASE} SELECT filename, CAST(lx AS BIGINT) AS ordinal_in_payment, payment, count(*) AS n_claims FROM claims GROUP BY ALL")
def e6_tree(spark, sf_dir):
    """Claims under each header, by parent references."""
    nodes = Remittance(remittances(spark, sf_dir)).nodes()
    claims = nodes.filter("loop = '2100'").groupBy("filename", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_claims"))
    heads, tops = nodes.filter("loop = '2000'").select("filename", "node", "parent"), nodes.filter("loop = 'transaction'").select("filename", F.col("node").alias("parent"), (F.col("ordinal") - 1).alias("payment"))
    number = F.row_number().over(Window.partitionBy("filename", "parent").orderBy("node")).cast("bigint")
    return heads.withColumn("ordinal_in_payment", number).join(claims, ["filename", "node"]).join(tops, ["filename", "parent"]).select("filename", "ordinal_in_payment", "payment", "n_claims")


@query(f"{BASE} SELECT filename, \"row\", CAST(lx AS BIGINT) AS header_number FROM claims")
def p5_carried_header(spark, sf_dir):
    return _read(spark, sf_dir, "claims").select("filename", "row", "header_number")


@query(f"{BASE} SELECT filename, service, min(claim) AS claim, min(payment) AS payment, count(*) AS n FROM adjustments GROUP BY 1, 2")
def p8_parent_references(spark, sf_dir):
    return _read(spark, sf_dir, "adjustments").groupBy("filename", "service").agg(F.min("claim").alias("claim"), F.min("payment").alias("payment"), F.count(F.lit(1)).alias("n"))


# Findings


@query(f"""{BASE}, f AS (
 SELECT filename, 3 AS level, 'BalanceMismatch' AS kind, count(*) AS n FROM claims WHERE o_orderkey % 97 = 0 GROUP BY 1
 UNION ALL SELECT filename, 2, 'TypeMismatch', count(*) FROM services WHERE o_orderkey % 89 = 0 AND l_linenumber = 1 GROUP BY 1
 UNION ALL SELECT filename, 2, 'LengthOutOfRange', count(*) FROM services WHERE o_orderkey % 83 = 0 AND l_linenumber = 1 GROUP BY 1
 UNION ALL SELECT filename, 2, 'CodeNotInList', count(*) FROM claims WHERE o_orderkey % 79 = 0 GROUP BY 1
 UNION ALL SELECT filename, 1, 'UnknownSegment', count(*) FROM pays WHERE c_custkey % 17 = 0 GROUP BY 1
 UNION ALL SELECT filename, 1, 'ControlCountMismatch', count(*) FROM pays WHERE c_custkey % 13 = 0 GROUP BY 1)
 SELECT filename, CAST(level AS BIGINT) AS level, kind, n FROM f""")
def v_findings_by_kind(spark, sf_dir):
    return _read(spark, sf_dir, DIAGNOSTICS, True).groupBy("filename", "level", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{BASE} SELECT filename, CAST(o_orderkey AS VARCHAR) AS claim_id, replace(CAST({money('charge + 100')} AS VARCHAR), ' ', '') AS datum FROM claims WHERE o_orderkey % 97 = 0""")
def v20_balance(spark, sf_dir):
    """Findings of the claim balance, joined to their claims by segment."""
    files = remittances(spark, sf_dir, True)
    found = parse_files(files, Options(DIAGNOSTICS)).filter("kind = 'BalanceMismatch'").select("filename", "segment", "datum")
    return found.join(parse_files(files, Options("claims")).select("filename", "segment", "claim_id"), ["filename", "segment"]).select("filename", "claim_id", "datum")


@query(f"{BASE} SELECT filename, CAST(12 + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END + n_lx + 3 * n_claims + 5 * n_lines AS VARCHAR) AS counted FROM totals WHERE c_custkey % 13 = 0")
def v5_control_counts(spark, sf_dir):
    found = _read(spark, sf_dir, DIAGNOSTICS, True).filter("kind = 'ControlCountMismatch'")
    return found.select("filename", F.regexp_extract("rule", r"the count is (\d+)", 1).alias("counted"))


@query(f"{BASE} SELECT filename, '20241341' AS datum, CAST(2 AS BIGINT) AS element, count(*) AS n FROM services WHERE o_orderkey % 89 = 0 AND l_linenumber = 1 GROUP BY 1")
def v9_type_mismatch(spark, sf_dir):
    return _read(spark, sf_dir, DIAGNOSTICS, True).filter("kind = 'TypeMismatch'").groupBy("filename", "datum", "element").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT filename, repeat('9', 60) AS datum, 'length 60; the spec allows 1 to 50' AS rule, count(*) AS n FROM services WHERE o_orderkey % 83 = 0 AND l_linenumber = 1 GROUP BY 1")
def v10_length(spark, sf_dir):
    found = _read(spark, sf_dir, DIAGNOSTICS, True).filter("kind = 'LengthOutOfRange'")
    return found.groupBy("filename", "datum", F.regexp_extract("rule", "length .*", 0).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT filename, '99' AS datum, count(*) AS n FROM claims WHERE o_orderkey % 79 = 0 GROUP BY 1")
def v12_code_not_in_list(spark, sf_dir):
    return _read(spark, sf_dir, DIAGNOSTICS, True).filter("kind = 'CodeNotInList'").groupBy("filename", "datum").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT filename, 'interchange#1/group#1/transaction#' || (\"row\" + 1) || '/1000B#' || (\"row\" + 1) AS path, 'XX' AS datum, CAST(1 AS BIGINT) AS level FROM pays WHERE c_custkey % 17 = 0")
def v2_unknown_segments(spark, sf_dir):
    return _read(spark, sf_dir, DIAGNOSTICS, True).filter("kind = 'UnknownSegment'").select("filename", "path", "datum", "level")


@query(f"{BASE} SELECT filename, 'interchange#1/group#1/transaction#' || (payment + 1) || '/2000#' || head || '/2100#' || (\"row\" + 1) AS path FROM (SELECT *, dense_rank() OVER (PARTITION BY filename ORDER BY payment, lx) AS head FROM claims) WHERE o_orderkey % 97 = 0")
def e5_paths_of_segments(spark, sf_dir):
    """Loop paths of the claims that don't balance."""
    files = remittances(spark, sf_dir, True)
    wanted = parse_files(files, Options(DIAGNOSTICS)).filter("kind = 'BalanceMismatch'").select("filename", "segment")
    return structure.loop_paths(files, wanted, Options("claims")).select("filename", "path")


@query(f"{BASE} SELECT filename, 'LARGE' AS code, 'External' AS kind, CAST(1 AS BIGINT) AS claims_hit, count(*) AS n FROM claims WHERE charge >= 50000000 GROUP BY 1")
def v21_external_findings(spark, sf_dir):
    """A validator that reports large charges by offset; each lands on its claim's segment."""
    files = remittances(spark, sf_dir)

    def large(data: bytes):
        import re

        for m in re.finditer(rb"CLP\*(\d+)\*\d\*(\d+)\.\d\d\*", data):
            if int(m[2]) >= 500_000:
                yield "LARGE", "the charge is large", m.start() + 2, m[1]

    found = external.external_findings(files, large, "size check")
    joined = found.join(parse_files(files, Options("claims")).select("filename", "segment", "claim_id"), ["filename", "segment"], "left")
    return joined.groupBy("filename", "code", "kind").agg(F.min((F.col("claim_id") == F.col("datum")).cast("bigint")).alias("claims_hit"), F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT version, count(*) AS n FROM (SELECT filename, CASE WHEN CAST(substr(filename, 8, 6) AS BIGINT) % 2 = 1 THEN '4010' ELSE '5010' END AS version FROM claims) GROUP BY 1")
def s7_versions(spark, sf_dir):
    """Half of the files as 4010: the version is found in each."""
    files = remittances(spark, sf_dir)
    odd = F.substring("filename", 8, 6).cast("bigint") % 2 == 1
    text = F.decode("content", "ISO-8859-1")
    old = F.replace(F.replace(text, F.lit("005010X221A1"), F.lit("004010X091A1")), F.lit("*^*00501*"), F.lit("*U*00401*"))
    files = files.withColumn("content", F.when(odd, F.encode(old, "ISO-8859-1")).otherwise(F.col("content")))
    segments = Remittance(files).segments("filename", "loop", "id", "occurrence").filter("loop = '2100' and id = 'DTM'").select("filename", F.when(F.col("occurrence") == "claim_date", "4010").otherwise("5010").alias("version"))
    return segments.groupBy("version").agg(F.count(F.lit(1)).alias("n"))


# Summaries


def _tables(spark, sf_dir, *names: str) -> dict[str, DataFrame]:
    """Several tables by one pass over the files; one by name is read as it stands."""
    r = Remittance(remittances(spark, sf_dir))
    return (r.once(list(names)) if len(names) > 1 else r).tables


@query(f"{BASE} SELECT filename, count(*) AS count_claims FROM claims GROUP BY 1")
def a1_count_claims(spark, sf_dir):
    return summary.summary_frame(builtin(), _tables(spark, sf_dir), "count_claims", ["filename"])


@query(f"{BASE} SELECT filename, count(DISTINCT c_custkey) AS count_patients FROM claims GROUP BY 1")
def a2_count_patients(spark, sf_dir):
    return summary.summary_frame(builtin(), _tables(spark, sf_dir), "count_patients", ["filename"])


@query(f"{BASE} SELECT totals.filename, CAST(sum({money('totals.paid - balance')}) AS DECIMAL(38,2)) AS sum_payments FROM totals JOIN cust USING (c_custkey) GROUP BY 1")
def a3_sum_payments(spark, sf_dir):
    return summary.summary_frame(builtin(), _tables(spark, sf_dir), "sum_payments", ["filename"]).withColumn("sum_payments", F.col("sum_payments").cast("decimal(38,2)"))


@query(f"{BASE} SELECT pays.filename, pays.\"row\", CAST(1 AS BIGINT) AS n_rows, c_name AS name, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS identification_code FROM pays")
def a4_payer(spark, sf_dir):
    """The one row of each payment."""
    return summary.summary_frame(builtin(), _tables(spark, sf_dir), "payee", ["filename", "row"]).select("filename", "row", "n_rows", "name", "identification_code")


@query(f"{BASE} SELECT level, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(3 AS BIGINT) AS level, count(*) AS n FROM claims WHERE o_orderkey % 97 = 0 UNION ALL SELECT 2, count(*) FROM services WHERE o_orderkey % 89 = 0 AND l_linenumber = 1 UNION ALL SELECT 2, count(*) FROM services WHERE o_orderkey % 83 = 0 AND l_linenumber = 1 UNION ALL SELECT 2, count(*) FROM claims WHERE o_orderkey % 79 = 0 UNION ALL SELECT 1, count(*) FROM pays WHERE c_custkey % 17 = 0 UNION ALL SELECT 1, count(*) FROM pays WHERE c_custkey % 13 = 0) GROUP BY 1 HAVING sum(n) > 0")
def a8_levels(spark, sf_dir):
    return _read(spark, sf_dir, DIAGNOSTICS, True).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


# Masking

_PAD = lambda x: bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex()


def _hmac_sql(message: str) -> str:
    return f"sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || {message})))"


def _token_sql(kind: str, value: str) -> str:
    return f"substr({_hmac_sql(f'''unhex('{kind.encode().hex()}00') || encode({value})''')}, 1, 16)"


@query(f"""{BASE} SELECT filename, "row", {_token_sql('id', "CAST(o_orderkey AS VARCHAR)")} AS claim_id, {_token_sql('name', 'c_name')} AS patient_last_name, {_token_sql('id', "'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')")} AS patient_id, CAST(date_trunc('year', ordered) AS DATE) AS statement_from FROM claims""")
def m1_masked_claims(spark, sf_dir):
    return _read(spark, sf_dir, "claims", mask_key=KEY).select("filename", "row", "claim_id", "patient_last_name", "patient_id", "statement_from")


_SHIFT_SQL = f"""(CAST(('0x' || substr({_hmac_sql("unhex('736869667400') || encode('P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0'))")}, 1, 8)) AS BIGINT) % 365 - 182)"""


@query(f"""{BASE} SELECT filename, "row", shipped + CAST({_SHIFT_SQL} AS INTEGER) AS service_date FROM services""")
def m3_shifted_services(spark, sf_dir):
    """Dates of services move by the patient of their claim."""
    return _read(spark, sf_dir, "services", mask_key=KEY, mask_dates="shift").select("filename", "row", "service_date")


@query(f"""{BASE} SELECT filename, {_token_sql('id', "repeat('9', 60)")} AS datum, count(*) AS n FROM services WHERE o_orderkey % 83 = 0 AND l_linenumber = 1 GROUP BY 1, 2""")
def m4_masked_findings(spark, sf_dir):
    return _read(spark, sf_dir, DIAGNOSTICS, True, mask_key=KEY).filter("kind = 'LengthOutOfRange'").groupBy("filename", "datum").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey, {_token_sql('name', 'c_name')} AS token, CAST(('0x' || substr({_hmac_sql('''unhex('736869667400') || encode(c_name)''')}, 1, 8)) AS BIGINT) % 365 - 182 AS days FROM customer")
def f15_token_columns(spark, sf_dir):
    name = F.col("c_name")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", C.token(KEY, "name", name).alias("token"), C.shift_days(KEY, name).cast("bigint").alias("days"))


# Streams of batches


@query(f"{BASE} SELECT filename, \"row\", \"row\" AS batch FROM claims")
def t1_batches(spark, sf_dir):
    """A batch for each closed claim."""
    return Remittance(remittances(spark, sf_dir)).batches("claims", "2100").select("filename", "row", "batch")


# Joins, aggregates, windows and set operations of the recipes


@query(f"{BASE} SELECT payee_name, month, count(*) AS n, CAST(sum({money('paid')}) AS DECIMAL(38,2)) AS paid FROM (SELECT c_name AS payee_name, '2024-01' AS month, paid FROM claims) GROUP BY 1, 2")
def j1_claims_of_payments(spark, sf_dir):
    t = _tables(spark, sf_dir, "claims", "payments")
    joined = t["claims"].join(t["payments"].select("filename", F.col("row").alias("payment"), "payee_name", "payment_date"), ["filename", "payment"])
    return joined.groupBy("payee_name", F.date_format("payment_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("payment_amount").cast("decimal(38,2)").alias("paid"))


@query(f"{BASE} SELECT group_code, reason_code, claim_status, count(*) AS n, CAST(sum({money('cents')}) AS DECIMAL(38,2)) AS amount FROM adjustments JOIN (SELECT filename, \"row\" AS claim, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '4' ELSE '2' END AS claim_status FROM claims) USING (filename, claim) GROUP BY 1, 2, 3")
def j2_adjustments_of_claims(spark, sf_dir):
    t = _tables(spark, sf_dir, "adjustments", "claims")
    joined = t["adjustments"].join(t["claims"].select("filename", F.col("row").alias("claim"), "claim_status"), ["filename", "claim"])
    return joined.groupBy("group_code", "reason_code", "claim_status").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("amount"))


@query(f"{BASE} SELECT l_partkey || '' AS procedure_code, count(*) AS n FROM adj JOIN services ON adj.filename = services.filename AND adj.service = services.\"row\" GROUP BY 1")
def j3_left_services(spark, sf_dir):
    t = _tables(spark, sf_dir, "adjustments", "services")
    return t["adjustments"].select("filename", "service").join(t["services"].select("filename", F.col("row").alias("service"), "procedure_code"), ["filename", "service"], "left").groupBy("procedure_code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{BASE}, p AS (SELECT filename, 'P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS patient_id FROM claims) SELECT filename, count(*) AS n, min({_token_sql('id', 'patient_id')}) AS least_token, bool_and(regexp_full_match({_token_sql('id', 'patient_id')}, '[0-9a-f]{{16}}')) AS masked,
 bool_or({_token_sql('id', 'patient_id')} = patient_id) AS leaked FROM p GROUP BY 1""")
def j4_masked_self_join(spark, sf_dir):
    files = remittances(spark, sf_dir)
    plain = parse_files(files, Options("claims")).select("filename", "row", "patient_id")
    hidden = parse_files(files, Options("claims", mask_key=KEY)).select("filename", "row", F.col("patient_id").alias("token"))
    both = plain.join(hidden, ["filename", "row"]).groupBy("filename")
    return both.agg(F.count(F.lit(1)).alias("n"), F.min("token").alias("least_token"), F.bool_and(F.col("token").rlike("^[0-9a-f]{16}$")).alias("masked"), F.bool_or(F.col("token") == F.col("patient_id")).alias("leaked"))


@query(f"{BASE} SELECT count(*) AS n FROM claims WHERE o_orderkey % 97 = 0")
def j5_claims_with_findings(spark, sf_dir):
    files = remittances(spark, sf_dir, True)
    found = parse_files(files, Options(DIAGNOSTICS)).filter("level = 3").select("filename", "segment")
    return parse_files(files, Options("claims")).join(found, ["filename", "segment"], "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT count(*) AS n FROM claims WHERE o_orderkey % 97 <> 0")
def j5_claims_without_findings(spark, sf_dir):
    files = remittances(spark, sf_dir, True)
    found = parse_files(files, Options(DIAGNOSTICS)).filter("level = 3").select("filename", "segment")
    return parse_files(files, Options("claims")).join(found, ["filename", "segment"], "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT count(*) AS n FROM services")
def j7_offsets_to_segments(spark, sf_dir):
    """Offsets in a file to the segments around them: equal to the segment's own, by an as-of window."""
    segments = Remittance(remittances(spark, sf_dir)).segments("filename", "segment", "raw_start", "body_start", "id")
    marks = segments.filter("id = 'SVC'").select("filename", (F.col("body_start") + 1).alias("at"), F.col("segment").alias("want"), F.lit(None).cast("bigint").alias("segment"))
    both = segments.select("filename", F.col("raw_start").alias("at"), F.lit(None).cast("bigint").alias("want"), "segment").unionByName(marks)
    seen = F.last("segment", ignorenulls=True).over(Window.partitionBy("filename").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("got", seen).filter("want is not null and want = got").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT claim_status, count(*) AS n, CAST(sum(p) AS DECIMAL(38,2)) AS paid, CAST(min(c) AS DECIMAL(38,2)) AS least, CAST(max(c) AS DECIMAL(38,2)) AS most, count(DISTINCT c_custkey) AS patients FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '4' ELSE '2' END AS claim_status, {money('paid')} AS p, {money('charge')} AS c FROM claims) GROUP BY 1")
def g1_figures_by_status(spark, sf_dir):
    return _read(spark, sf_dir, "claims").groupBy("claim_status").agg(F.count(F.lit(1)).alias("n"), F.sum("payment_amount").cast("decimal(38,2)").alias("paid"), F.min("charge_amount").alias("least"), F.max("charge_amount").alias("most"), F.count_distinct("patient_id").alias("patients"))


@query(f"{BASE} SELECT filename, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS denied, CAST(coalesce(sum({money('charge')}) FILTER (WHERE o_orderstatus = 'O'), 0) AS DECIMAL(38,2)) AS denied_charge, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 3) AS rate FROM claims GROUP BY 1")
def g4_denial_rate(spark, sf_dir):
    denied = F.col("claim_status") == "4"
    n, d = F.count(F.lit(1)), F.count_if(denied)
    return _read(spark, sf_dir, "claims").groupBy("filename").agg(n.alias("n"), d.alias("denied"), F.sum(F.when(denied, F.col("charge_amount")).otherwise(0)).cast("decimal(38,2)").alias("denied_charge"), F.round(d / n, 3).alias("rate"))


@query(f"{BASE} SELECT payer_name, group_code, reason_code, CAST(sum({money('cents')}) AS DECIMAL(38,2)) AS amount FROM adjustments JOIN (SELECT pays.filename, pays.\"row\" AS payment, 'PLAN OF ' || n_name AS payer_name FROM pays JOIN nation ON c_nationkey = n_nationkey) USING (filename, payment) GROUP BY 1, 2, 3")
def g5_totals_by_payer(spark, sf_dir):
    t = _tables(spark, sf_dir, "adjustments", "payments")
    joined = t["adjustments"].join(t["payments"].select("filename", F.col("row").alias("payment"), "payer_name"), ["filename", "payment"])
    return joined.groupBy("payer_name", "group_code", "reason_code").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))


@query(f"{BASE} SELECT CAST(l_partkey AS VARCHAR) AS procedure_code, round(CAST(sum(charge - discount - tax) AS DOUBLE) / CAST(sum(charge) AS DOUBLE), 3) AS share FROM services GROUP BY 1")
def g6_paid_share(spark, sf_dir):
    s = _read(spark, sf_dir, "services")
    return s.groupBy("procedure_code").agg(F.round((F.sum("payment_amount") * 100).cast("double") / (F.sum("charge_amount") * 100).cast("double"), 3).alias("share"))


@query(f"{BASE} SELECT filename, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY \"row\") AS ids FROM claims GROUP BY 1")
def g9_ids_in_order(spark, sf_dir):
    """As a list in order, joined."""
    listed = F.array_sort(F.collect_list(F.struct("row", "claim_id")))
    return _read(spark, sf_dir, "claims").groupBy("filename").agg(F.array_join(F.transform(listed, lambda x: x.claim_id), ", ").alias("ids"))


@query(f"{BASE} SELECT filename, \"row\", row_number() OVER (PARTITION BY filename ORDER BY paid DESC, \"row\") AS place FROM claims")
def g10_row_number(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc_nulls_first("payment_amount"), "row")).cast("bigint")
    return _read(spark, sf_dir, "claims").select("filename", "row", place.alias("place"))


@query(f"{BASE} SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, {money('charge')} AS charge_amount FROM claims ORDER BY charge DESC, o_orderkey LIMIT 20")
def g11_largest_claims(spark, sf_dir):
    return _read(spark, sf_dir, "claims").orderBy(F.desc("charge_amount"), F.col("claim_id").cast("bigint")).limit(20).select("claim_id", "charge_amount")


@query(f"{BASE} SELECT count(*) AS n FROM claims WHERE o_orderkey % 97 = 0")
def g12_except_all(spark, sf_dir):
    """Claims whose charge the faults change: the difference of the two reads."""
    cols = ["filename", "row", "claim_id", "charge_amount"]
    return _read(spark, sf_dir, "claims", True).select(*cols).exceptAll(_read(spark, sf_dir, "claims").select(*cols)).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT CAST(sum(x) AS DECIMAL(38,2)) AS total, 'ok' AS gate FROM (SELECT {money('paid')} AS x FROM claims UNION ALL SELECT {money('-balance')} FROM pays)")
def g13_gate(spark, sf_dir):
    """Paid claims less provider adjustments are what the payments say, else an error."""
    t = _tables(spark, sf_dir, "claims", "provider_adjustments", "payments")
    parts = t["claims"].select(F.col("payment_amount").alias("x")).unionAll(t["provider_adjustments"].select((-F.col("amount")).alias("x"))).agg(F.sum("x").alias("total"))
    said = t["payments"].agg(F.sum("total_payment_amount").alias("said"))
    gate = F.when(F.col("total") == F.col("said"), F.lit("ok")).otherwise(F.raise_error(F.lit("the payments do not add up")))
    return parts.join(F.broadcast(said)).select(F.col("total").cast("decimal(38,2)").alias("total"), gate.alias("gate"))


@query(f"{BASE} SELECT CAST(month(shipped) AS BIGINT) AS month, count(*) AS n, CAST(max(date_diff('day', ordered, shipped)) AS BIGINT) AS longest FROM services JOIN (SELECT filename, \"row\" AS claim, ordered FROM claims) USING (filename, claim) WHERE regexp_matches(CAST(l_partkey AS VARCHAR), '^1') GROUP BY 1")
def g16_dates_and_patterns(spark, sf_dir):
    t = _tables(spark, sf_dir, "services", "claims")
    joined = t["services"].filter(F.col("procedure_code").rlike("^1")).join(t["claims"].select("filename", F.col("row").alias("claim"), "statement_from"), ["filename", "claim"])
    return joined.groupBy(F.month("service_date").cast("bigint").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max(F.datediff("service_date", "statement_from")).cast("bigint").alias("longest"))


@query(f"{BASE} SELECT filename, CAST(sum(n_lines) AS BIGINT) AS n FROM totals GROUP BY 1")
def g18_unnest(spark, sf_dir):
    per_claim = _read(spark, sf_dir, "services").groupBy("filename", "claim").agg(F.collect_list("row").alias("rows"))
    return per_claim.select("filename", F.explode("rows")).groupBy("filename").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT claim_status, count(*) AS n, CAST(sum(p) AS DECIMAL(38,2)) AS paid FROM (SELECT CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '4' ELSE '2' END AS claim_status, {money('paid')} AS p FROM claims) GROUP BY 1")
def g14_view(spark, sf_dir):
    """Through a view and SQL."""
    return spark.sql("SELECT claim_status, count(*) AS n, CAST(sum(payment_amount) AS DECIMAL(38,2)) AS paid FROM (SELECT * EXCEPT (segment) FROM {claims}) GROUP BY ALL", claims=_read(spark, sf_dir, "claims"))


@query(f"{BASE} SELECT filename, count(*) AS n_claims, CAST(sum(\"row\") AS BIGINT) AS row_sum, min(o_orderkey || '') AS least FROM claims GROUP BY 1")
def g8_list_of_rows(spark, sf_dir):
    """Rows as an ordered list of structs, as for a copy to a file."""
    listed = _read(spark, sf_dir, "claims").groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("row", "claim_id"))).alias("t"))
    return listed.select("filename", F.size("t").cast("bigint").alias("n_claims"), F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x.row).alias("row_sum"), F.array_min(F.transform("t", lambda x: x.claim_id)).alias("least"))


@query(f"""{BASE}, cells AS (SELECT filename, "row", concat_ws(chr(10), "row", payment, claim, service, group_code, reason_code, {money('cents')}, CAST(quantity AS DECIMAL(38,2)), filename) AS t FROM adjustments) SELECT filename, "row" FROM cells WHERE contains(lower(t), 'pr' || chr(10) || '1' || chr(10)) AND contains(t, '77')""")
def f23_text_filter(spark, sf_dir):
    """Over all cells of a row, but for the number of its segment."""
    rows = _read(spark, sf_dir, "adjustments")
    cells = [F.col(c) for c in ("row", "payment", "claim", "service", "group_code", "reason_code", "amount", "quantity", "filename")]
    return rows.filter(C.any_cell_contains(cells, "Pr\n1\n") & C.any_cell_contains(cells, "77")).select("filename", "row")


@query(f"{BASE} SELECT filename, service, max(CASE k WHEN 1 THEN reason_code END) AS x_0_code, max(CASE k WHEN 2 THEN reason_code END) AS x_1_code, max(CASE k WHEN 3 THEN reason_code END) AS x_2_code FROM adjustments GROUP BY 1, 2")
def c4_numbered_pivot(spark, sf_dir):
    return compat.numbered(_read(spark, sf_dir, "adjustments").withColumnRenamed("reason_code", "code"), ["filename", "service"], "x", {"code": "code"}, 3).drop("x")


# Functions on the tables' own values

_DIRTY = "documents"


def _words(spark, sf_dir):
    """Words of the documents with a digit, as they stand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.explode(F.split("text", "[ \n]")).alias("x")).filter(F.col("x").rlike("[0-9]")).distinct()


_WORDS_SQL = "(SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS x FROM documents) WHERE regexp_matches(x, '[0-9]'))"


@query(f"""SELECT doc_id, x, CASE WHEN regexp_full_match(x, '-?[0-9]+') THEN try_cast(x AS BIGINT) END AS n, CASE WHEN regexp_full_match(x, '-?([0-9]+([.][0-9]{{0,2}})?|[.][0-9]{{1,2}})') THEN try_cast(x AS DECIMAL(38,2)) END AS r,
 CAST(length(regexp_replace(x, '[^0-9]', '', 'g')) AS BIGINT) AS digits FROM {_WORDS_SQL}""")
def f1_numbers(spark, sf_dir):
    x = F.col("x")
    return _words(spark, sf_dir).select("doc_id", "x", C.parse_n(x).alias("n"), C.parse_r(x, 2).alias("r"), C.digits(x).cast("bigint").alias("digits"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS long_form, CAST(l_shipdate AS DATE) AS short_form, CAST(NULL AS DATE) AS bad, strftime(l_shipdate, '%y%m%d') AS two_digits, CAST(date_trunc('year', l_shipdate) AS DATE) AS year_start FROM lineitem""")
def f3_dates(spark, sf_dir):
    d = F.to_date("l_shipdate")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", C.parse_dt(C.date_element(d)).alias("long_form"), C.parse_dt(C.date_element(d, 6)).alias("short_form"), C.parse_dt(F.concat(F.year(d), F.lit("1341"))).alias("bad"), C.date_element(d, 6).alias("two_digits"), C.year_start(d).alias("year_start")
    )


@query("""SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS seconds, strftime(ts, '%H:%M:%S') AS shown, CASE WHEN second(ts) = 0 THEN strftime(ts, '%H%M') ELSE strftime(ts, '%H%M%S') END AS element, hour(ts) * 3600 + minute(ts) * 60 AS short_form FROM events""")
def f4_times(spark, sf_dir):
    ts = F.col("ts")
    s = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C.parse_tm(F.date_format(ts, "HHmmss")).cast("bigint").alias("seconds"), C.time_display(s).alias("shown"), C.time_element(s).alias("element"), C.parse_tm(F.date_format(ts, "HHmm")).cast("bigint").alias("short_form"))


@query("""SELECT l_orderkey, l_linenumber, CAST(d AS VARCHAR) AS shown, CASE WHEN contains(CAST(d AS VARCHAR), '.') THEN regexp_replace(CAST(d AS VARCHAR), '[.]?0+$', '') ELSE CAST(d AS VARCHAR) END AS element, CAST(d AS DECIMAL(38,4)) AS rescaled
 FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0 AS DECIMAL(38,2)) AS d FROM lineitem)""")
def f11_decimals(spark, sf_dir):
    d = (F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("decimal(20,0)") / 100).cast("decimal(38,2)")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", d.cast("string").alias("shown"), C.decimal_element(d).alias("element"), C.rescale(d, 4).alias("rescaled"))


@query("SELECT event_id, regexp_replace(props, '([*:~^?])', '?\\1', 'g') AS escaped, CASE WHEN regexp_matches(props, '[\",\\r\\n]') THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE props END AS csv, contains(lower(props), 'a') AS found FROM events")
def f19_escape_and_csv(spark, sf_dir):
    x = F.col("props")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C.escape(x, "?", "*:~^").alias("escaped"), C.csv_cell(x).alias("csv"), C.any_cell_contains([x], "A").alias("found"))


# The wide frame and writing


_STATUS = "CASE o_orderstatus WHEN 'F' THEN {0} WHEN 'O' THEN {1} ELSE {2} END"


@query(f"""{BASE} SELECT filename, services.payment, claim, services."row" AS service, 'P' || lpad(CAST(claims.c_custkey AS VARCHAR), 6, '0') AS patient_identifier, claims.o_orderkey || '' AS marker, 'ICN' || claims.o_orderkey AS icn, {_STATUS.format("'primary'", "'unspecified'", "'secondary'")} AS payer_classification,
 FALSE AS was_forwarded, CAST(services.l_partkey AS VARCHAR) AS code, 'HC' AS qualifier, CAST(qty AS DOUBLE) AS allowed_units, CAST(qty AS DOUBLE) AS billed_units, DATE '2024-01-12' AS transaction_date, 'PLAN OF ' || n_name AS payer, CAST(services.charge AS DOUBLE) / 100 AS charge_amount,
 CAST(services.charge - services.discount - services.tax AS DOUBLE) / 100 AS paid_amount, shipped AS start_date, shipped AS end_date, 'CO' AS adj_0_group, '45' AS adj_0_code, CAST(discount AS DOUBLE) / 100 AS adj_0_amount, 'PR' AS adj_1_group, '1' AS adj_1_code, CAST(services.tax AS DOUBLE) / 100 AS adj_1_amount,
 '6R' AS ref_0_qual, claims.o_orderkey || '-' || l_linenumber AS ref_0_value FROM services JOIN claims USING (filename, o_orderkey) JOIN customer ON customer.c_custkey = claims.c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def c10_wide_frame(spark, sf_dir):
    """All columns of the strict frame but those that are empty throughout."""
    f = compat.frame(remittances(spark, sf_dir), widest={"adj": 2, "ref": 1, "rem": 0})
    return f.select(
        "filename", "payment", "claim", "service", "patient_identifier", "marker", "icn", "payer_classification", "was_forwarded", "code", "qualifier", "allowed_units", "billed_units", "transaction_date", "payer", "charge_amount", "paid_amount", "start_date", "end_date",
        *(f"adj_{n}_{x}" for n in (0, 1) for x in ("group", "code", "amount")), "ref_0_qual", "ref_0_value",
    )


@query(f"{BASE} SELECT filename, CAST(sum(n_claims) AS BIGINT) AS count_claims, count(DISTINCT c_custkey) AS count_patients, CAST(CAST(sum(totals.paid - balance) / 100.0 AS DECIMAL(38,2)) AS DOUBLE) AS sum_payments FROM totals JOIN (SELECT c_custkey, balance FROM cust) USING (c_custkey) GROUP BY 1")
def a7_library_counts(spark, sf_dir):
    return compat.counts(remittances(spark, sf_dir))


@query(f"{BASE} SELECT filename, service, group_code, CAST(count(*) AS BIGINT) AS n, string_agg(reason_code, ',' ORDER BY \"row\") AS reasons FROM adjustments GROUP BY 1, 2, 3")
def w7_packing(spark, sf_dir):
    """Rows back into segments of up to six."""
    packed = writer.packed(_read(spark, sf_dir, "adjustments"), ["filename", "payment", "claim", "service", "group_code", "segment"], 6)
    return packed.groupBy("filename", "service", "group_code", "island", "part").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "reason_code"))), lambda x: x.reason_code), ",").alias("reasons")).select("filename", "service", "group_code", "n", "reasons")


@query(f"{BASE} SELECT filename, payment, CAST(lx AS BIGINT) AS header_number, count(*) AS n FROM claims GROUP BY ALL")
def w6_header_runs(spark, sf_dir):
    runs = writer.islands(_read(spark, sf_dir, "claims").select("filename", "payment", "row", "header_number"), ["filename", "payment"], ["header_number"], "row")
    return runs.groupBy("filename", "payment", "header_number", "island").agg(F.count(F.lit(1)).alias("n")).drop("island")


_BACK = " UNION ALL ".join(f"SELECT '{t}' AS table_name, filename, count(*) AS n_rows, count(*) AS n_equal FROM {v} GROUP BY 2" for t, v in (("adjustments", "adjustments"), ("claims", "claims"), ("payments", "pays"), ("provider_adjustments", "pays"), ("services", "services")))


@query(f"{BASE} {_BACK}")
def w15_round_trip(spark, sf_dir):
    """Tables to files and back: rows of each file and table, and how many come back as they were, but for the numbers of segments. Each side is parsed once."""
    first = Remittance(remittances(spark, sf_dir)).once(list(builtin().table_names))
    written = writer.write_files(first.tables, writer.Envelope(sender="PAYER", receiver="RECEIVER", date="20240110", time="0900"))
    again, out = Remittance(written.select("filename", "content")).once(list(builtin().table_names)), None
    for name in builtin().table_names:
        a, b = (r.table(name).drop("segment").withColumn("side", F.lit(k)) for k, r in ((1, first), (-1, again)))
        keys = [c for c in a.columns if c != "side"]
        pairs = a.unionByName(b).groupBy(*keys).agg(F.count_if(F.col("side") > 0).alias("was"), F.count_if(F.col("side") < 0).alias("came"))
        found = pairs.groupBy("filename").agg(F.sum("was").alias("n_rows"), F.sum(F.least("was", "came")).alias("n_equal")).select(F.lit(name).alias("table_name"), "filename", "n_rows", "n_equal")
        out = found if out is None else out.unionByName(found)
    return out
