"""Registered queries over the warehouse tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import marts, quality, scd
from tributary.session import table
from tributary.staging import staged_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DAY = "1998-06-15"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def _date(column: str) -> F.Column:
    return F.col(column).cast("date")


@query("mart_master", """WITH ch AS (SELECT DISTINCT l_orderkey, l_returnflag, CAST(l_shipdate AS DATE) AS ship_date, 'final' AS channel FROM lineitem WHERE l_linestatus = 'F'
 UNION ALL SELECT l_orderkey, l_returnflag, CAST(l_shipdate AS DATE), 'open' FROM lineitem WHERE l_linestatus <> 'F'),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ship_date DESC, l_returnflag, channel) AS n FROM ch) WHERE n = 1)
 SELECT o_orderkey AS order_key, o_custkey AS customer_key, c_name AS customer_name, c_mktsegment AS segment, c_nationkey AS nation_key, o_orderstatus AS status, o_totalprice AS total_price, CAST(o_orderdate AS DATE) AS order_date,
  o_orderpriority AS priority, 'IDR' AS currency, l_returnflag AS return_flag, ship_date, channel FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN one ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) < DATE '1999-01-01'""")
def mart_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", _date("l_shipdate").alias("ship_date"), "l_linestatus")
    final = lines.where("l_linestatus = 'F'").drop("l_linestatus").distinct().withColumn("channel", F.lit("final"))
    still = lines.where("l_linestatus <> 'F'").drop("l_linestatus").withColumn("channel", F.lit("open"))
    one = marts.latest_per_key(final.unionByName(still), ["l_orderkey"], [F.desc("ship_date"), F.asc("l_returnflag"), F.asc("channel")])
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(one, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation_key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_price"), _date("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("priority"), F.lit("IDR").alias("currency"), F.col("l_returnflag").alias("return_flag"), "ship_date", "channel",
    )


@query("mart_wide_cast", """SELECT l_orderkey, l_linenumber, p_name, s_name, n_name AS nation, CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(17,2)) AS price,
 CAST(l_extendedprice AS DECIMAL(22,3)) * CAST(l_quantity AS DECIMAL(22,3)) AS weighted, CAST(CAST(l_extendedprice AS DECIMAL(17,2)) - CAST(l_tax AS DECIMAL(17,2)) AS DECIMAL(18,2)) AS net,
 least(l_discount, l_tax) AS lesser, lpad(CAST(l_partkey AS VARCHAR), 16, '0') AS part_code, substr(trim(p_type), 1, 4) AS type_head, CAST(length(p_name) AS INTEGER) AS name_length,
 CASE WHEN l_discount > 0.05 THEN CASE WHEN l_tax > 0.04 THEN 'high-high' ELSE 'high-low' END ELSE 'low' END AS band, CAST(l_shipdate AS DATE) + 30 AS due, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS m, CAST(day(l_shipdate) AS INTEGER) AS d
 FROM lineitem LEFT JOIN part ON lpad(CAST(p_partkey AS VARCHAR), 16, '0') = lpad(CAST(l_partkey AS VARCHAR), 16, '0') LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey
 WHERE l_returnflag <> 'R' AND l_quantity NOT BETWEEN 10 AND 20 AND coalesce(trim(l_linestatus), 'XXX') NOT IN ('Z', 'XXX')""")
def mart_wide_cast(spark, sf_dir):
    code = lambda c: F.lpad(F.col(c).cast("string"), 16, "0")
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") != "R") & ~F.col("l_quantity").between(10, 20) & ~F.coalesce(F.trim("l_linestatus"), F.lit("XXX")).isin("Z", "XXX"))
    lines = lines.withColumn("code", code("l_partkey"))
    parts = table(spark, sf_dir, "part").select(code("p_partkey").alias("p_code"), "p_name", "p_type")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        lines.join(parts, lines.code == parts.p_code, "left")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    )
    ship = _date("l_shipdate")
    return joined.select(
        "l_orderkey", "l_linenumber", "p_name", "s_name", F.col("n_name").alias("nation"), F.col("l_quantity").try_cast("int").alias("quantity"),
        F.col("l_extendedprice").try_cast("decimal(17,2)").alias("price"),
        (F.col("l_extendedprice").try_cast("decimal(22,3)") * F.col("l_quantity").try_cast("decimal(22,3)")).alias("weighted"),
        (F.col("l_extendedprice").try_cast("decimal(17,2)") - F.col("l_tax").try_cast("decimal(17,2)")).cast("decimal(18,2)").alias("net"),
        F.least("l_discount", "l_tax").alias("lesser"), F.col("code").alias("part_code"), F.substring(F.trim("p_type"), 1, 4).alias("type_head"), F.length("p_name").alias("name_length"),
        F.when(F.col("l_discount") > 0.05, F.when(F.col("l_tax") > 0.04, "high-high").otherwise("high-low")).otherwise("low").alias("band"),
        F.date_add(ship, 30).alias("due"), F.year(ship).alias("y"), F.month(ship).alias("m"), F.dayofmonth(ship).alias("d"),
    )


@query("mart_union_padded", """SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(17,2)) AS amount, o_orderstatus AS code, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS DECIMAL(5,0)) AS user_id, CAST(NULL AS VARCHAR) AS flag, 'orders' AS origin FROM orders
 UNION ALL SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(17,2)), NULL, CAST(l_shipdate AS DATE), CAST(l_linenumber AS DECIMAL(5,0)), l_returnflag, 'lines' FROM lineitem""")
def mart_union_padded(spark, sf_dir):
    schema = {"id": "bigint", "amount": "decimal(17,2)", "code": "string", "day": "date", "user_id": "decimal(5,0)", "flag": "string", "origin": "string"}
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("code"), F.col("o_orderdate").alias("day"), F.lit("orders").alias("origin"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("day"), F.col("l_linenumber").alias("user_id"), F.col("l_returnflag").alias("flag"), F.lit("lines").alias("origin"))
    return marts.padded_union([orders, lines], schema)


_DIM = """dim AS (SELECT c_custkey AS cif_key, c_mktsegment AS segment, DATE '1995-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS start_date, CASE WHEN c_custkey % 4 = 0 THEN DATE '1997-12-31' ELSE DATE '2999-12-31' END AS end_date FROM customer),
 staged AS (SELECT c_custkey AS cif_key, upper(c_mktsegment) AS segment FROM customer WHERE c_custkey % 3 = 0)"""
_CLOSED = f"SELECT cif_key, segment, start_date, CASE WHEN cif_key IN (SELECT cif_key FROM staged) AND DATE '{DAY}' BETWEEN start_date AND end_date THEN CAST(DATE '{DAY}' - 1 AS DATE) ELSE end_date END AS end_date FROM dim"
_OPENED = f"SELECT cif_key, segment, DATE '{DAY}' AS start_date, DATE '2999-12-31' AS end_date FROM staged"


def _dim(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    dim = c.select(
        F.col("c_custkey").alias("cif_key"), F.col("c_mktsegment").alias("segment"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("start_date"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("1997-12-31").cast("date")).otherwise(F.lit(marts.OPEN_END).cast("date")).alias("end_date"),
    )
    return dim, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("cif_key"), F.upper("c_mktsegment").alias("segment"))


@query("scd2_close", f"WITH {_DIM} {_CLOSED}")
def scd2_close(spark, sf_dir):
    return scd.close_versions(*_dim(spark, sf_dir), "cif_key", DAY)


@query("scd2_open", f"WITH {_DIM} {_OPENED}")
def scd2_open(spark, sf_dir):
    return scd.open_versions(_dim(spark, sf_dir)[1], DAY)


@query("scd2_apply", f"WITH {_DIM} {_CLOSED} UNION ALL {_OPENED}")
def scd2_apply(spark, sf_dir):
    return scd.apply_scd2(*_dim(spark, sf_dir), "cif_key", DAY)


_CHANGES = "cif_key % 3 = 0 AND cif_key % 16 < 2"


@query("scd2_rewrite", f"""WITH {_DIM}, changed AS (SELECT * FROM staged WHERE {_CHANGES}), done AS ({_CLOSED.replace("FROM staged", "FROM changed")} UNION ALL {_OPENED.replace("FROM staged", "FROM changed")})
 SELECT *, CAST(cif_key % 16 AS INTEGER) AS part FROM done""")
def scd2_rewrite(spark, sf_dir):
    """The dimension as a partitioned table of which only the touched partitions are written anew."""
    dim, changes = (d.withColumn("part", (F.col("cif_key") % 16).cast("int")) for d in _dim(spark, sf_dir))
    path = staged_path(spark, "dimension")
    marts.write_partitioned(dim, path, ["part"])
    scd.rewrite_touched(path, changes.where(_CHANGES), "cif_key", DAY, ["part"])
    return spark.read.parquet(path).select(*dim.columns)


@query("scd2_current", f"WITH {_DIM} SELECT * FROM dim WHERE DATE '{DAY}' BETWEEN start_date AND end_date")
def scd2_current(spark, sf_dir):
    return scd.current(_dim(spark, sf_dir)[0], DAY)


@query("metric_row_count_band", """SELECT 'orders_by_year' AS metric_flag, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS metric_numeric, CAST(NULL AS VARCHAR) AS sample_data,
 CASE WHEN count(*) FILTER (WHERE year(o_orderdate) = 1997) < 0.95 * count(*) FILTER (WHERE year(o_orderdate) = 1996) OR count(*) FILTER (WHERE year(o_orderdate) = 1997) > 1.05 * count(*) FILTER (WHERE year(o_orderdate) = 1996) THEN 'Yes' ELSE 'No' END AS is_anomaly FROM orders""")
def metric_row_count_band(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate")
    return quality.row_count_band(orders, F.year("o_orderdate") == 1997, F.year("o_orderdate") == 1996, 0.05, "orders_by_year")


@query("metric_duplicates", """WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1), v AS (SELECT CAST(count(*) FILTER (WHERE n > 1 AND k IS NOT NULL) + coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS v, min(k) FILTER (WHERE n > 1) AS s FROM k)
 SELECT 'line_key' AS metric_flag, v AS metric_numeric, CAST(s AS VARCHAR) AS sample_data, CASE WHEN v > 0 THEN 'Yes' ELSE 'No' END AS is_anomaly FROM v""")
def metric_duplicates(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return quality.duplicates_and_nulls(keys, "k", "line_key")


@query("metric_table_match", """SELECT 'orders_customers' AS metric_flag, (SELECT count(*) FROM orders) AS metric_numeric, CAST(NULL AS VARCHAR) AS sample_data, CASE WHEN (SELECT count(*) FROM orders) <> (SELECT count(*) FROM customer) THEN 'Yes' ELSE 'No' END AS is_anomaly""")
def metric_table_match(spark, sf_dir):
    return quality.table_match(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "orders_customers")


@query("post_load_counts", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
def post_load_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))


@query("retention_filter", "SELECT event_id, user_id, event_type FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-31' - 14")
def retention_filter(spark, sf_dir):
    # the same bound on the raw column lets the scan skip row groups
    events = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-17").cast("timestamp_ntz"))
    return marts.drop_old(events, _date("ts"), F.lit("2024-01-31").cast("date"), 14).select("event_id", "user_id", "event_type")


@query("month_end_flag", "SELECT o_orderkey, CAST(o_orderdate AS DATE) = last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders")
def month_end_flag(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", marts.is_month_end(_date("o_orderdate")).alias("month_end"))


@query("serial_day_to_date", """SELECT p_partkey, CASE WHEN s > 2956565 THEN DATE '2999-12-31' WHEN s <= 0 THEN DATE '1900-01-01' ELSE DATE '1900-01-01' + CAST(least(greatest(s, 1), 2956565) AS INTEGER) - 1 END AS day
 FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0 WHEN p_size % 10 = 1 THEN 3000000 ELSE CAST(p_size AS BIGINT) * 700 END AS s FROM part)""")
def serial_day_to_date(spark, sf_dir):
    serial = F.when(F.col("p_size") % 10 == 0, 0).when(F.col("p_size") % 10 == 1, 3000000).otherwise(F.col("p_size").cast("long") * 700)
    return table(spark, sf_dir, "part").select("p_partkey", marts.serial_to_date(serial).alias("day"))


@query("next_due_date", """SELECT o_orderkey, CAST(date_trunc('month', CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) AS DATE) + least(day(last_day(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE))), 30) :: INTEGER - 1 AS due FROM orders""")
def next_due_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", marts.next_due(_date("o_orderdate"), F.lit(1), F.lit(30)).alias("due"))


@query("code_label", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'other' END AS label FROM orders""")
def code_label(spark, sf_dir):
    labels = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}
    return table(spark, sf_dir, "orders").select("o_orderkey", marts.code_label(F.col("o_orderpriority"), labels, "other").alias("label"))


_FLAGS = [("c_nationkey", k) for k in range(25)] + [("c_custkey % 75", k) for k in range(75)]


@query("flag_concat", "SELECT c_custkey, " + " || ".join(f"CASE WHEN {c} = {k} THEN '1' ELSE '0' END" for c, k in _FLAGS) + " AS flags FROM customer")
def flag_concat(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", marts.flag_string([F.expr(c) == k for c, k in _FLAGS]).alias("flags"))


@query("try_casts", "SELECT event_id, TRY_CAST(event_type AS INTEGER) AS bad, TRY_CAST(CAST(user_id AS VARCHAR) AS BIGINT) AS good, TRY_CAST(substr(event_type, 1, 2) AS DATE) AS day FROM events")
def try_casts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", marts.safe_cast(F.col("event_type"), "int").alias("bad"), marts.safe_cast(F.col("user_id").cast("string"), "bigint").alias("good"), marts.safe_cast(F.substring("event_type", 1, 2), "date").alias("day"))


@query("semi_join_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_join_in(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return table(spark, sf_dir, "orders").join(poor, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("unused_left_join", "SELECT o_orderkey, o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) l ON l_orderkey = o_orderkey")
def unused_left_join(spark, sf_dir):
    """A left join no column of which is selected may still multiply rows, so it stays."""
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_totalprice")


@query("inner_two_keys_residual", """SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus
 AND coalesce(trim(l.l_returnflag), 'N') <> 'R' AND o.o_totalprice > l.l_extendedprice""")
def inner_two_keys_residual(spark, sf_dir):
    """An inner join on two keys, one condition on one side, and one over both sides."""
    lines, orders = table(spark, sf_dir, "lineitem").alias("l"), table(spark, sf_dir, "orders").alias("o")
    keys = (F.col("l.l_orderkey") == F.col("o.o_orderkey")) & (F.col("l.l_linestatus") == F.col("o.o_orderstatus"))
    rest = (F.coalesce(F.trim("l.l_returnflag"), F.lit("N")) != "R") & (F.col("o.o_totalprice") > F.col("l.l_extendedprice"))
    return lines.join(orders, keys & rest).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("left_two_key_latest", """WITH d AS (SELECT l_orderkey, l_linestatus, max(l_linenumber) AS last_line FROM lineitem GROUP BY ALL)
 SELECT o_orderkey, o_orderstatus, CAST(last_line AS VARCHAR) AS last_line FROM orders LEFT JOIN d ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus""")
def left_two_key_latest(spark, sf_dir):
    """A left join on two keys to one row of each of them; the maximum deduplicates on the map side."""
    latest = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.max("l_linenumber").alias("last_line"))
    keys = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderstatus") == F.col("l_linestatus"))
    return table(spark, sf_dir, "orders").join(latest, keys, "left").select("o_orderkey", "o_orderstatus", F.col("last_line").cast("string").alias("last_line"))


@query("temp_view_sql", "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def temp_view_sql(spark, sf_dir):
    """A temporary view that SQL text reads."""
    table(spark, sf_dir, "orders").where("o_totalprice > 1000").createOrReplaceTempView("tributary_large_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS orders FROM tributary_large_orders GROUP BY o_orderstatus")

# Dates and decimals leave the registered queries as text, which every client prints alike; the operators keep their types.
_AS_TEXT = {
    "mart_master": ("order_date", "ship_date"),
    "mart_wide_cast": ("price", "weighted", "net", "due"),
    "mart_union_padded": ("amount", "day", "user_id"),
    "scd2_close": ("start_date", "end_date"),
    "scd2_open": ("start_date", "end_date"),
    "scd2_apply": ("start_date", "end_date"),
    "scd2_current": ("start_date", "end_date"),
    "post_load_counts": ("day",),
    "serial_day_to_date": ("day",),
    "next_due_date": ("due",),
    "try_casts": ("day",),
}


def _as_text(function, columns: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in columns})

    return run


for _name, _columns in _AS_TEXT.items():
    QUERIES[_name] = _as_text(QUERIES[_name], _columns)
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _columns)}) FROM ({ORACLE_SQL[_name]})"
