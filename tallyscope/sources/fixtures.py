"""Transfers derived from the given tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Persons grow with the customers: 57 at sf0.01, 588 at sf0.1.
MODULUS = "(select greatest(100, cast(floor(count(*) / 15) as int)) from customer)"

F1_SQL = """
with k as (select {modulus} as m),
b as (
  select l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_returnflag, l.l_shipdate, o.o_orderdate,
         cast(floor((o.o_custkey % k.m) * (o.o_custkey % k.m) / (k.m * 1.7e0)) as int) as sp,
         cast(floor((l.l_partkey % k.m) * (l.l_partkey % k.m) / (k.m * 1.7e0)) as int) as rp,
         cast((l.l_orderkey * 7919 + l.l_partkey * 104729 + l.l_linenumber * 31) % 1440 as int) as mins,
         cast((l.l_orderkey + l.l_linenumber) % 12 as int) as dk
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey cross join k),
base as (
  select 0 as leg, b.*, sp as s, rp as r, l_shipdate + interval '1' minute * mins as ts,
         case when l_linenumber = 7 and l_suppkey % 4 = 0 then 17000.0 + (l_partkey % 31) - 15
              when l_returnflag = 'R' then l_extendedprice
              when l_linenumber = 1 then floor(l_extendedprice / 1000) * 100.0
              else floor(l_extendedprice * 10) / 100 end as amount
  from b),
legs as (
  select leg, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, s, r, dk, ts, amount from base
  union all
  select 1 as leg, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, r as s, s as r, dk,
         ts + interval '1' minute * cast(l_quantity * 17 as int) as ts, floor(amount * 99) / 100 as amount
  from base where l_linenumber = 2 and l_suppkey % 5 = 0 and s <> r)
select leg, l_orderkey as order_key, l_partkey as part_key, l_suppkey as supp_key, l_linenumber as line_number, s as sn, r as rn,
  'P' || lpad(cast(s as varchar(10)), 4, '0') as user_id, 'P' || lpad(cast(r as varchar(10)), 4, '0') as receiver_id,
  ts, cast(amount as double) as movement_amount,
  case when l_linenumber = 3 then 'folio ' || cast(l_orderkey as varchar(20)) end as reference_text,
  case dk when 0 then 'abono 25' when 1 then 'autoriza orden de compra' when 2 then 'incentivo por fuera' when 3 then 'pago servicios varios'
          when 4 then 'reembolso gastos' when 5 then 'gracias mil por el contrato' when 6 then 'mordida para firma' when 7 then ''
          when 8 then 'prestam urgente' when 9 then 'viaje cancun vip' when 10 then 'consultoria proyecto' else 'nomina sombra' end as descripcion,
  'app' || cast(l_suppkey % 8 as varchar(4)) as origin_application_id,
  l_shipdate + interval '1' day * cast(l_linenumber - 4 as int) as value_ts
from legs
""".replace("{modulus}", MODULUS)

#: The graph of all orders: every line is an edge from a customer to another.
F3_SQL = """
select 'C' || cast(o.o_custkey as varchar(20)) as user_id,
       'C' || cast(l.l_partkey * 7 % (select count(*) from customer) as varchar(20)) as receiver_id,
       l.l_extendedprice as movement_amount, l.l_shipdate as ts
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
"""

TABLES = ("lineitem", "orders", "customer")


def sql_over_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the given tables, without registering views."""
    from_tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for t in TABLES:
        sql = sql.replace(f"from {t} ", f"from {{{t}}} ").replace(f"join {t} ", f"join {{{t}}} ").replace(f"from {t})", f"from {{{t}}})")
    return spark.sql(sql, **from_tables)


def dense_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transfers with repeats, reversals, near-threshold amounts and texts for every rule."""
    return sql_over_tables(spark, sf_dir, F1_SQL)


def order_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    return sql_over_tables(spark, sf_dir, F3_SQL)


def event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the event stream as transfers through channels."""
    return as_transfers(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 as a stream of the table's files; the pattern lets a single file be read, too."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_transfers(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))


def as_transfers(e: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    receiver = F.get_json_object("props", "$.k").cast("long") % 50
    return e.select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("tx_id"), F.col("user_id").cast("string").alias("user_id"), receiver.cast("string").alias("receiver_id"), F.col("event_type").alias("origin_application_id"), F.col("value").alias("movement_amount"), F.col("ts").cast("timestamp").alias("fecha_hora_ts"))
