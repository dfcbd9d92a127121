"""835 files from the relational tables, all in SQL expressions: a file for each bucket of customers, a transaction for each
customer with orders, a claim for each order, a service for each line. Amounts are computed in whole cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from remitta.sources.shared import scratch

#: Customers of a file, about.
PER_FILE = 40

def money(cents: str) -> str:
    return f"concat(case when {cents} < 0 then '-' else '' end, cast(abs({cents}) div 100 as string), '.', lpad(cast(abs({cents}) % 100 as string), 2, '0'))"


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem", "nation")}


#: Cents of a line. The oracles use the same expressions.
LINES = """
select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as qty, cast(l_shipdate as date) as shipped,
       cast(round(l_extendedprice * 100) as bigint) as charge,
       (cast(round(l_extendedprice * 100) as bigint) * cast(round(l_discount * 100) as bigint)) {div} 100 as discount,
       (cast(round(l_extendedprice * 100) as bigint) * cast(round(l_tax * 100) as bigint)) {div} 100 as tax
from lineitem
"""


def buckets(spark: SparkSession, sf_dir: str) -> int:
    return max(4, spark.read.parquet(f"{sf_dir}/customer.parquet").count() // PER_FILE)


_written: dict[tuple, str] = {}


def remittances(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """filename, content; written once for a session, to the shared folder. faults: some claims, lines and transactions are wrong, by their keys."""
    key = (spark.sparkContext.applicationId, sf_dir, faults)
    if key not in _written:
        path = scratch(spark, "remittances")
        generated(spark, sf_dir, faults).write.parquet(path)
        _written[key] = path
    return spark.read.schema("filename string, content binary").parquet(_written[key])


def generated(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    n = buckets(spark, sf_dir)
    r = relations(spark, sf_dir)
    lines = spark.sql(LINES.format(div="div").replace("from lineitem", "from {lineitem}"), lineitem=r["lineitem"])
    f = lambda condition, then, other: f"case when {condition} then {then} else {other} end" if faults else other
    per_order = spark.sql(
        f"""
        select l_orderkey as okey, sum(charge) as charge, sum(charge - discount - tax) as paid, sum(tax) as tax, count(*) as n_lines,
               concat_ws('', transform(array_sort(collect_list(struct(l_linenumber, l_partkey, charge, qty, shipped, discount, tax,
                 concat('SVC*HC:', l_partkey, '*', {money('charge')}, '*', {money('(charge - discount - tax)')}, '**', qty, '~',
                        'DTM*472*', {f("l_orderkey % 89 = 0 and l_linenumber = 1", "'20241341'", "date_format(shipped, 'yyyyMMdd')")}, '~',
                        'CAS*CO*45*', {money('discount')}, '~',
                        'CAS*PR*1*', {money('tax')}, '*', qty, '*2*0~',
                        'REF*6R*', {f("l_orderkey % 83 = 0 and l_linenumber = 1", "repeat('9', 60)", "concat(l_orderkey, '-', l_linenumber)")}, '~') as t))), x -> x.t)) as body
        from {{lines}} group by l_orderkey""",
        lines=lines,
    )
    claims = spark.sql(
        f"""
        select o_custkey, o_orderkey, year(o_orderdate) as y, charge, paid, tax, 3 + 5 * n_lines as n_segments,
               concat('CLP*', o_orderkey, '*', {f("o_orderkey % 79 = 0", "'99'", "case o_orderstatus when 'F' then '1' when 'O' then '4' else '2' end")}, '*',
                      {money(f("o_orderkey % 97 = 0", "(charge + 100)", "charge"))}, '*', {money('paid')}, '*', {money('tax')}, '*12*ICN', o_orderkey, '*11*1~',
                      'NM1*QC*1*', c_name, '*', c_mktsegment, '****MI*P', lpad(cast(o_custkey as string), 6, '0'), '~',
                      'DTM*232*', date_format(o_orderdate, 'yyyyMMdd'), '~', body) as text
        from {{orders}} join {{per_order}} on o_orderkey = okey join {{customer}} on o_custkey = c_custkey""",
        orders=r["orders"], per_order=per_order, customer=r["customer"],
    )
    years = spark.sql("select o_custkey, y, count(*) as n, sum(paid) as paid, sum(n_segments) as n_segments, concat_ws('', transform(array_sort(collect_list(struct(o_orderkey, text))), x -> x.text)) as body from {claims} group by o_custkey, y", claims=claims)
    numbered = spark.sql("select *, row_number() over (partition by o_custkey order by y) as lx from {years}", years=years)
    headed = spark.sql("select o_custkey, sum(paid) as paid, sum(n_segments) + count(*) as n_segments, concat_ws('', transform(array_sort(collect_list(struct(lx, concat('LX*', lx, '~', body) as t))), x -> x.t)) as body from {numbered} group by o_custkey", numbered=numbered)
    transactions = spark.sql(
        f"""
        select c_custkey % {n} as bucket, c_custkey,
               concat('ST*835*', lpad(cast(c_custkey as string), 6, '0'), '~BPR*I*', {money('(paid - balance)')}, '*C*CHK************20240112~TRN*1*CHK', c_custkey, '*1512345678~',
                      'REF*EV*R', c_custkey, '~DTM*405*20240110~N1*PR*PLAN OF ', n_name, '~N3*1 MAIN ST~N4*TOWN*IL*62701~PER*BL*EDI DESK*TE*8005559876~',
                      'N1*PE*', c_name, '*XX*', lpad(cast(c_custkey as string), 10, '0'), '~',
                      {f("c_custkey % 17 = 0", "'XX*1~'", "''")}, body,
                      'PLB*PRV', c_custkey, '*20241231*WO:A', c_custkey, '*', {money('balance')}, '~',
                      'SE*', 12 + n_segments + {f("c_custkey % 17 = 0", "1", "0")} + {f("c_custkey % 13 = 0", "5", "0")}, '*', lpad(cast(c_custkey as string), 6, '0'), '~') as text
        from (select *, cast(round(c_acctbal * 100) as bigint) as balance from {{customer}}) join {{headed}} on c_custkey = o_custkey join {{nation}} on c_nationkey = n_nationkey""",
        customer=r["customer"], headed=headed, nation=r["nation"],
    )
    return spark.sql(
        """
        select concat('bucket-', lpad(cast(bucket as string), 6, '0'), '.835') as filename,
               cast(concat('ISA*00*          *00*          *ZZ*PAYER          *ZZ*RECEIVER       *240110*0900*^*00501*', lpad(cast(bucket as string), 9, '0'), '*0*T*:~\n',
                      'GS*HP*PAYER*RECEIVER*20240110*0900*', bucket + 1, '*X*005010X221A1~', concat_ws('', transform(array_sort(collect_list(struct(c_custkey, text))), x -> x.text)),
                      'GE*', count(*), '*', bucket + 1, '~IEA*1*', lpad(cast(bucket as string), 9, '0'), '~\n') as binary) as content
        from {transactions} group by bucket""",
        transactions=transactions,
    )
