"""Registered queries of the findings: the generated files with one fault planted each, everywhere or by the files' numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitta.operators import summary
from remitta.operators.lexer import Delimiters
from remitta.plans.builtin import builtin
from remitta.plans.generate import remittances
from remitta.plans.registry import BASE, KEY, _token_sql, money, query
from remitta.sources.remittance import DIAGNOSTICS, Options, Remittance, parse_files

_TEXT = "ISO-8859-1"
#: Number of a file, in Spark and in the oracles.
NUMBER = "CAST(substr(filename, 8, 6) AS BIGINT)"


def changed(files: DataFrame, *changes: tuple[str, str], where: str | None = None) -> DataFrame:
    """The files with every match of the patterns replaced; where: only in some of them."""
    text: Column = F.decode("content", _TEXT)
    for pattern, new in changes:
        text = F.regexp_replace(text, pattern, new)
    content = F.encode(text, _TEXT)
    return files.withColumn("content", content if where is None else F.when(F.expr(where), content).otherwise(F.col("content")))


def older(files: DataFrame) -> DataFrame:
    """As files of the older version."""
    return changed(files, ("005010X221A1", "004010X091A1"), (r"\*\^\*00501\*", "*U*00401*"))


def found(files: DataFrame, kind: str, *columns: str, **options) -> DataFrame:
    """How many findings of a kind each file has, by what they say."""
    rows = parse_files(files, Options(DIAGNOSTICS, **options)).filter(F.col("kind") == kind)
    return rows.groupBy("filename", "kind", "level", *columns).agg(F.count(F.lit(1)).alias("n"))


def expected(kind: str, level: int, source: str, columns: str = "", group: str = "", where: str = "TRUE") -> str:
    return f"{BASE} SELECT filename, '{kind}' AS kind, CAST({level} AS BIGINT) AS level, {columns} count(*) AS n FROM {source} WHERE {where} GROUP BY filename{group}"


@query(f"{BASE} SELECT DISTINCT filename, 'ByteOrderMark' AS kind, CAST(1 AS BIGINT) AS level, CAST(0 AS BIGINT) AS segment, CAST(1 AS BIGINT) AS n FROM cust WHERE {NUMBER} % 3 = 0")
def v1_byte_order_mark(spark, sf_dir):
    files = remittances(spark, sf_dir)
    marked = F.when(F.expr(f"{NUMBER} % 3 = 0"), F.concat(F.unhex(F.lit("efbbbf")), "content")).otherwise(F.col("content"))
    return found(files.withColumn("content", marked), "ByteOrderMark", "segment")


@query(expected("ImplicitLoop", 1, "pays", "'CLP' AS datum,"))
def v3_implicit_loop(spark, sf_dir):
    """Without LX, the first claim of each transaction opens the header's loop."""
    return found(changed(remittances(spark, sf_dir), (r"LX\*[0-9]+~", "")), "ImplicitLoop", "datum")


@query(expected("UnterminatedLoop", 1, "pays"))
def v4_unterminated_loop(spark, sf_dir):
    """Transactions without SE."""
    return found(changed(remittances(spark, sf_dir), (r"SE\*[0-9]+\*[0-9]+~", "")), "UnterminatedLoop")


@query(f"{BASE}, n AS (SELECT filename, count(*) AS n FROM pays GROUP BY 1) SELECT filename, 'ControlCountMismatch' AS kind, CAST(1 AS BIGINT) AS level, '99999' AS datum, 'the count is ' || n AS said, CAST(1 AS BIGINT) AS n FROM n")
def v5_group_counts(spark, sf_dir):
    """GE counts transactions."""
    rows = parse_files(changed(remittances(spark, sf_dir), (r"GE\*[0-9]+\*", "GE*99999*")), Options(DIAGNOSTICS)).filter("kind = 'ControlCountMismatch'")
    return rows.groupBy("filename", "kind", "level", "datum", F.regexp_extract("rule", "the count is .*", 0).alias("said")).agg(F.count(F.lit(1)).alias("n"))


@query(expected("ControlElementMissing", 1, "pays", "CAST(2 AS BIGINT) AS element,"))
def v6_control_element_missing(spark, sf_dir):
    return found(changed(remittances(spark, sf_dir), (r"SE\*([0-9]+)\*[0-9]+~", "SE*$1~")), "ControlElementMissing", "element")


@query(expected("ControlNumberMismatch", 1, "pays", "'9999' AS datum, CAST(2 AS BIGINT) AS element,"))
def v7_control_number_mismatch(spark, sf_dir):
    return found(changed(remittances(spark, sf_dir), (r"SE\*([0-9]+)\*[0-9]+~", "SE*$1*9999~")), "ControlNumberMismatch", "datum", "element")


@query(expected("RequiredElementMissing", 2, "pays", "CAST(2 AS BIGINT) AS element, 'check_or_eft_trace_number' AS name,"))
def v8_required_element_missing(spark, sf_dir):
    rows = parse_files(changed(remittances(spark, sf_dir), (r"TRN\*1\*CHK[0-9]+\*", "TRN*1**")), Options(DIAGNOSTICS)).filter("kind = 'RequiredElementMissing'")
    return rows.groupBy("filename", "kind", "level", "element", F.regexp_extract("rule", r"\((\w+)\)", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(expected("CompositeShape", 2, "services", "CAST(1 AS BIGINT) AS element, CAST(9 AS BIGINT) AS component, 'Y' AS datum,"))
def v11_composite_shape(spark, sf_dir):
    return found(changed(remittances(spark, sf_dir), (r"SVC\*HC:([0-9]+)\*", "SVC*HC:$1:::::::Y*")), "CompositeShape", "element", "component", "datum")


_OLD_CODES = " UNION ALL ".join(
    f"SELECT filename, 'CodeNotInList' AS kind, CAST(2 AS BIGINT) AS level, '{datum}' AS datum, CAST({element} AS BIGINT) AS element, count(*) AS n FROM {source} GROUP BY 1"
    for datum, element, source in (("QQ", 6, "claims"), ("$", 9, "claims"), ("QQQ", 1, "services"), ("6X", 1, "services"), ("XY", 1, "claims"), ("BL", 1, "pays"))
)


@query(f"{BASE} {_OLD_CODES}")
def v12_older_codes(spark, sf_dir):
    """Codes that the older version does not list, planted in CLP06, CLP09, AMT01, REF01, NM101 and PER01."""
    files = older(remittances(spark, sf_dir))
    files = changed(files, (r"\*12\*ICN([0-9]+)\*11\*1~", r"*QQ*ICN$1*11*\$~NM1*XY*1*Z~"), (r"REF\*6R\*([0-9-]+)~", "AMT*QQQ*1~REF*6X*$1~"))
    return found(files, "CodeNotInList", "datum", "element").filter("datum in ('QQ', '$', 'QQQ', '6X', 'XY', 'BL')")


@query(f"{BASE} SELECT filename, 'ValueDropped' AS kind, CAST(2 AS BIGINT) AS level, 'claims.patient_first_name' AS place, count(*) AS n FROM claims WHERE length(c_mktsegment) > 9 GROUP BY 1")
def v13_value_dropped(spark, sf_dir):
    """Texts longer than a cell may be (here 9 bytes) are dropped and reported; control numbers and codes are all shorter."""
    files = changed(remittances(spark, sf_dir), (r"Customer#([0-9]+)", "C$1"), (r"PLAN OF [A-Z ]+", "PLAN"), (r"EDI DESK", "DESK"))
    rows = parse_files(files, Options(DIAGNOSTICS, largest_text=9)).filter("kind = 'ValueDropped'")
    place = F.concat(F.regexp_extract("rule", 'table "([a-z_]+)"', 1), F.lit("."), F.regexp_extract("rule", 'column "([a-z_]+)"', 1))
    return rows.groupBy("filename", "kind", "level", place.alias("place")).agg(F.count(F.lit(1)).alias("n")).filter("place = 'claims.patient_first_name'")


@query(f"{BASE} SELECT filename, \"row\", CASE WHEN length(c_mktsegment) > 9 THEN NULL ELSE c_mktsegment END AS patient_first_name FROM claims")
def p11_dropped_cells(spark, sf_dir):
    """What V13 reports reads as null, and rows stay aligned."""
    return parse_files(remittances(spark, sf_dir), Options("claims", largest_text=9)).select("filename", "row", "patient_first_name")


@query(expected("RequiredOccurrenceMissing", 2, "pays", "'payer_technical_contact_information' AS name,"))
def v14_required_occurrence_missing(spark, sf_dir):
    rows = parse_files(changed(remittances(spark, sf_dir), (r"PER\*BL\*[^~]*~", "")), Options(DIAGNOSTICS)).filter("kind = 'RequiredOccurrenceMissing'")
    return rows.groupBy("filename", "kind", "level", F.regexp_extract("rule", 'occurrence "([a-z_]+)"', 1).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(expected("OccurrenceOverMax", 2, "pays", "'DTM' AS datum,"))
def v15_occurrence_over_max(spark, sf_dir):
    return found(changed(remittances(spark, sf_dir), (r"(DTM\*405\*[0-9]+~)", "$1$1")), "OccurrenceOverMax", "datum")


@query(expected("LoopOverMax", 2, "pays", "'N1' AS datum,"))
def v16_loop_over_max(spark, sf_dir):
    return found(changed(remittances(spark, sf_dir), (r"(N1\*PE\*[^~]*~)", "$1$1")), "LoopOverMax", "datum")


@query(expected("OutOfOrder", 2, "pays", "'REF' AS datum,"))
def v17_out_of_order(spark, sf_dir):
    return found(changed(remittances(spark, sf_dir), (r"(REF\*EV\*[^~]*~)(DTM\*405\*[0-9]+~)", "$2$1")), "OutOfOrder", "datum")


@query(expected("UnknownOccurrence", 2, "claims", "'999' AS datum, CAST(1 AS BIGINT) AS element,"))
def v18_unknown_occurrence(spark, sf_dir):
    return found(changed(remittances(spark, sf_dir), (r"DTM\*232\*", "DTM*999*")), "UnknownOccurrence", "datum", "element")


@query(expected("RequiredLoopMissing", 2, "pays", "'1000B' AS name,"))
def v19_required_loop_missing(spark, sf_dir):
    rows = parse_files(changed(remittances(spark, sf_dir), (r"N1\*PE\*[^~]*~", "")), Options(DIAGNOSTICS)).filter("kind = 'RequiredLoopMissing'")
    return rows.groupBy("filename", "kind", "level", F.regexp_extract("rule", 'child loop "(\\w+)"', 1).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT filename, 'transaction_balance' AS rule, CAST({money('totals.paid - balance + 100')} AS VARCHAR) AS target, CAST({money('totals.paid - balance')} AS VARCHAR) AS adds_up, count(*) AS n FROM totals JOIN (SELECT c_custkey, balance FROM cust) USING (c_custkey) GROUP BY 1, 3, 4")
def v20_transaction_balance(spark, sf_dir):
    """A dollar more in every BPR: what the rule says of both sides."""
    files = remittances(spark, sf_dir).withColumn("t", F.decode("content", _TEXT))
    # amounts are changed by arithmetic on the text of each transaction, then joined again
    parts = F.split("t", r"(?=BPR\*I\*)")
    cents = lambda x: F.regexp_extract(x, r"^BPR\*I\*(-?[0-9]+\.[0-9]{2})\*", 1).cast("decimal(38,2)") + F.lit(1).cast("decimal(38,2)")
    moved = F.transform(parts, lambda x: F.when(x.startswith("BPR*I*"), F.concat(F.lit("BPR*I*"), cents(x).cast("string"), F.regexp_extract(x, r"(?s)^BPR\*I\*-?[0-9.]+(\*.*)$", 1))).otherwise(x))
    changed_files = files.select("filename", F.encode(F.array_join(moved, ""), _TEXT).alias("content"))
    rows = parse_files(changed_files, Options(DIAGNOSTICS)).filter("kind = 'BalanceMismatch'").select("filename", "rule")
    number = lambda pattern: F.regexp_extract("rule", pattern, 1)
    return rows.groupBy("filename", F.regexp_extract("rule", 'rule "(\\w+)"', 1).alias("rule"), number(r" is (-?[0-9.]+), but").alias("target"), number(r"adds up to (-?[0-9.]+) \(").alias("adds_up")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT filename, CAST(count(*) AS BIGINT) AS opened, CAST(sum(CASE WHEN {NUMBER} % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM pays GROUP BY 1")
def a6_counts_per_instance(spark, sf_dir):
    """Every instance counts its own occurrences: where the contact is taken out of half of the files, each of their payers lacks one."""
    files = changed(remittances(spark, sf_dir), (r"PER\*BL\*[^~]*~", ""), where=f"{NUMBER} % 2 = 0")
    r = Remittance(files)
    opened = r.segments("filename", "opens").select("filename", F.explode("opens").alias("o")).filter("o.loop = '1000A'").groupBy("filename").agg(F.count(F.lit(1)).alias("opened"))
    missing = r.diagnostics.filter("kind = 'RequiredOccurrenceMissing'").groupBy("filename").agg(F.count(F.lit(1)).alias("missing"))
    return opened.join(missing, "filename", "left").select("filename", "opened", F.coalesce("missing", F.lit(0)).alias("missing"))


@query(f"{BASE} SELECT DISTINCT filename, CAST(2 AS BIGINT) AS n, TRUE AS at_the_end FROM cust")
def e7_finish(spark, sf_dir):
    """Files cut before GE: the end of the input closes the group and the interchange."""
    cut = changed(remittances(spark, sf_dir), (r"GE\*[0-9]+\*[0-9]+~IEA\*1\*[0-9]+~\n", ""))
    rows = parse_files(cut, Options(DIAGNOSTICS)).filter("kind = 'UnterminatedLoop'")
    return rows.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("segment").isNull()).alias("at_the_end"))


@query(f"{BASE} SELECT filename, l.x AS \"loop\", CAST(CASE l.x WHEN '2110' THEN 5 WHEN '2100' THEN 3 ELSE 1 END AS BIGINT) AS held, CAST(CASE l.x WHEN '2110' THEN sum(n_lines) WHEN '2100' THEN sum(n_claims) ELSE sum(n_lx) END AS BIGINT) AS nodes FROM totals, (VALUES ('2000'), ('2100'), ('2110')) l(x) GROUP BY 1, 2")
def e8_owner_nodes(spark, sf_dir):
    """The node that holds each segment: five segments a service, three a claim, one a header."""
    s = Remittance(remittances(spark, sf_dir)).segments("filename", "node", "loop").filter("loop in ('2000', '2100', '2110')")
    return s.groupBy("filename", "loop", "node").agg(F.count(F.lit(1)).alias("held")).groupBy("filename", "loop", "held").agg(F.count(F.lit(1)).alias("nodes"))


# Projection and lexing of files in other shapes


def _extra_dates(files: DataFrame) -> DataFrame:
    return changed(files, (r"(DTM\*472\*)([0-9]{4})([0-9]{4})~", "DTM*150*$2$3~DTM*151*$20101~DTM*472*$2$3~DTM*472*$21231~"))


def _picks():
    source = builtin().source
    place = lambda pick, q: {"occurrence": "service_date", "element": 2, "loop": "2110", "pick": pick}
    patched = {"tables": {"services": {"columns": {"date_first": place("first", None), "date_last": place("last", None), "date_second": place(2, None), "at": {"segment": "DTM", "segment_index": True}}}}}
    assert source["loops"]["2110"]["occurrences"]["service_date"]["max"] == 2
    return builtin().patch(patched)


@query(f"{BASE} SELECT filename, \"row\", shipped AS date_first, make_date(year(shipped), 12, 31) AS date_last, make_date(year(shipped), 1, 1) AS date_second FROM services")
def p2_picks(spark, sf_dir):
    """The first, the last and the second date of every service."""
    rows = parse_files(_extra_dates(remittances(spark, sf_dir)), Options("services", spec=_picks()))
    return rows.select("filename", "row", "date_first", "date_last", "date_second")


@query(f"{BASE} SELECT filename, payment, o_orderkey || '' AS claim_id, CAST(min(o_orderkey || '-' || l_linenumber) AS VARCHAR) AS same FROM (SELECT services.filename, services.payment, services.o_orderkey, l_linenumber FROM services WHERE l_linenumber = (SELECT min(l_linenumber) FROM lines x WHERE x.l_orderkey = services.o_orderkey)) GROUP BY 1, 2, 3")
def p4_inner_loops(spark, sf_dir):
    """A column of claims read from the loop below: the control number of the first service."""
    spec = builtin().patch({"tables": {"claims": {"columns": {"first_line": {"segment": "REF", "where": {"1": "6R"}, "element": 2, "loop": "2110"}}}}})
    return parse_files(remittances(spark, sf_dir), Options("claims", spec=spec)).select("filename", "payment", "claim_id", F.col("first_line").alias("same"))


@query(f"{BASE} SELECT filename, count(*) AS n, CAST(1 AS BIGINT) AS after FROM services GROUP BY 1")
def p9_segment_index(spark, sf_dir):
    """The index of the segment that a column reads: the date of a service stands right after its SVC."""
    rows = parse_files(remittances(spark, sf_dir), Options("services", spec=_picks()))
    return rows.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("at") - F.col("segment")).alias("after"))


@query(f"{BASE} SELECT filename, count(*) AS n, CAST(sum(CASE WHEN cents = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero FROM adjustments GROUP BY 1")
def p12_numbers_continue(spark, sf_dir):
    """Drained after every claim, rows keep counting: the numbers are those of the whole file."""
    rows = Remittance(remittances(spark, sf_dir)).batches("adjustments", "2100")
    checked = rows.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount") == 0).alias("zero"), (F.max("row") + 1).alias("last"), F.count_distinct("row").alias("different"))
    return checked.filter("n = last and n = different").select("filename", "n", "zero")


@query(f"{BASE} SELECT filename, count(*) AS n, min(o_orderkey || '') AS least FROM claims GROUP BY 1")
def l1_leading_trivia(spark, sf_dir):
    """A byte order mark and thousands of blanks before ISA."""
    blank = F.concat(F.unhex(F.lit("efbbbf")), F.encode(F.repeat(F.lit(" \r\n"), 4000), _TEXT), "content")
    return parse_files(remittances(spark, sf_dir).withColumn("content", blank), Options("claims")).groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("least"))


@query(f"{BASE} SELECT filename, \"row\", {money('charge')} AS charge_amount, CAST(l_partkey AS VARCHAR) AS procedure_code FROM services")
def l2_other_delimiters(spark, sf_dir):
    """Each file by its own delimiters: half of them use others."""
    files = remittances(spark, sf_dir).withColumn("content", F.when(F.expr(f"{NUMBER} % 2 = 1"), F.encode(F.translate(F.decode("content", _TEXT), "*:~", "|>!"), _TEXT)).otherwise(F.col("content")))
    return parse_files(files, Options("services")).select("filename", "row", "charge_amount", "procedure_code")


@query(f"{BASE} SELECT DISTINCT filename, CASE WHEN {NUMBER} % 2 = 1 THEN NULL ELSE '^' END AS repetition, '*' AS element, ':' AS component, '~' AS segment FROM cust")
def l3_repetition_separator(spark, sf_dir):
    """ISA11 from version 00402 on."""
    from remitta.operators.native_lexer import delimiters_of

    files = remittances(spark, sf_dir)
    old = older(files).filter(f"{NUMBER} % 2 = 1").unionByName(files.filter(f"{NUMBER} % 2 = 0"))
    return delimiters_of(old).select("filename", "repetition", "element", "component", "segment")


@query(f"{BASE} SELECT DISTINCT filename, CASE WHEN {NUMBER} % 2 = 1 THEN 'the input does not begin with an ISA segment; its first bytes are 58 53 41 2a 30 30 2a 20' ELSE 'the ISA segment is cut off: it has 5 of 16 element separators' END AS rule, CAST(1 AS BIGINT) AS level FROM cust")
def l4_header_errors(spark, sf_dir):
    files = remittances(spark, sf_dir)
    text = F.when(F.expr(f"{NUMBER} % 2 = 1"), F.concat(F.lit("X"), F.substring(F.decode("content", _TEXT), 2, 1_000_000_000))).otherwise(F.substring_index(F.decode("content", _TEXT), "*", 6))
    return parse_files(files.withColumn("content", F.encode(text, _TEXT)), Options(DIAGNOSTICS, ignore_errors=True)).select("filename", "rule", "level")


@query(f"{BASE} SELECT filename, \"row\", replace(c_name, '#', '*~:?') AS patient_last_name FROM claims")
def l8_release_byte(spark, sf_dir):
    """With a release byte, delimiters stand in values."""
    files = changed(remittances(spark, sf_dir), ("Customer#", r"Customer?*?~?:??"))
    d = Delimiters(repetition=b"^", release=b"?")
    return parse_files(files, Options("claims", delimiters=d)).select("filename", "row", "patient_last_name")


@query(f"""{BASE} SELECT filename, 'CLP' AS id, CAST(sum(n_claims) AS BIGINT) AS n FROM totals GROUP BY 1 UNION ALL SELECT filename, 'SVC', CAST(sum(n_lines) AS BIGINT) FROM totals GROUP BY 1 UNION ALL SELECT filename, 'PLB', count(*) FROM totals GROUP BY 1""")
def l9_lazy_segments(spark, sf_dir):
    """Segments without loops: the automaton does not run."""
    return Remittance(remittances(spark, sf_dir)).segments("filename", "id").filter("id in ('CLP', 'SVC', 'PLB')").groupBy("filename", "id").agg(F.count(F.lit(1)).alias("n"))


# Masks


@query(f"""{BASE} SELECT pays.filename, pays."row", 'PLAN OF ' || n_name AS payer_name, c_name AS payee_name, lpad(CAST(pays.c_custkey AS VARCHAR), 10, '0') AS payee_id FROM pays JOIN nation ON c_nationkey = n_nationkey""")
def m6_not_masked(spark, sf_dir):
    """Payers and payees read as they are, whatever the mask."""
    return parse_files(remittances(spark, sf_dir), Options("payments", mask_key=KEY)).select("filename", "row", "payer_name", "payee_name", "payee_id")


@query(f"{BASE} SELECT filename, \"row\", ordered AS statement_from, {_token_sql('id', 'CAST(o_orderkey AS VARCHAR)')} AS claim_id FROM claims")
def m2_kept_dates(spark, sf_dir):
    return parse_files(remittances(spark, sf_dir), Options("claims", mask_key=KEY, mask_dates="keep")).select("filename", "row", "statement_from", "claim_id")


@query(f"""{BASE} SELECT filename, 'the name ' || {_token_sql('name', 'c_name')} || ' is odd (reported by other, code ODD)' AS rule, {_token_sql('name', 'c_name')} AS datum, count(*) AS n FROM claims GROUP BY 1, 2, 3""")
def f18_quotes_of_messages(spark, sf_dir):
    """Patients that another validator quotes are masked in its message."""
    from remitta.operators import external

    def names(data: bytes):
        import re

        for m in re.finditer(rb"NM1\*QC\*1\*([^*~]+)", data):
            yield "ODD", f"the name {m[1].decode()} is odd", m.start(), m[1]

    return external.external_findings(remittances(spark, sf_dir), names, "other", mask_key=KEY).groupBy("filename", "rule", "datum").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT filename, 'a\\xffb' AS datum, count(*) AS n FROM claims GROUP BY 1")
def f20_printable_bytes(spark, sf_dir):
    """Bytes of findings that are no text, as escapes."""
    files = remittances(spark, sf_dir)
    text = F.regexp_replace(F.decode("content", _TEXT), r"\*12\*ICN[0-9]+\*11\*1~", "*aÿb*ICN*11*1~")
    return found(files.withColumn("content", F.encode(text, _TEXT)), "LengthOutOfRange", "datum").select("filename", "datum", "n")


@query(f"{BASE} SELECT filename, count(*) AS n_files, CAST(sum(n_claims) AS BIGINT) AS count_claims FROM (SELECT filename, sum(n_claims) AS n_claims FROM totals GROUP BY 1) GROUP BY 1")
def r7_declared_summaries(spark, sf_dir):
    """A summary of a patched specification."""
    spec = builtin().patch({"summaries": {"claims_here": {"count": {"table": "claims"}}}})
    tables = {"claims": parse_files(remittances(spark, sf_dir), Options("claims", spec=spec))}
    return summary.summary_frame(spec, tables, "claims_here", ["filename"]).select("filename", F.lit(1).cast("bigint").alias("n_files"), F.col("claims_here").alias("count_claims"))

