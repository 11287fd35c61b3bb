"""Insert, update, delete, merge, ledgers and triggers as new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import ora as o
from tamarack.operators.changes import net_changes, row_changes, split_before
from tamarack.operators.inventory import issue, receive, transfers
from tamarack.operators.relational import merge_into, next_values, ranked, running, split_rejects, with_ties
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession


@P.query("""
    WITH src AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN -s_suppkey ELSE s_suppkey * 2 END AS k, s_acctbal AS v FROM supplier)
    SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN v WHEN k IS NOT NULL AND v > 0 THEN round(c_acctbal + v, 4) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey IS NULL THEN NULL ELSE c_mktsegment END AS c_mktsegment
    FROM customer c FULL JOIN src ON c_custkey = k
    WHERE NOT (c_custkey IS NOT NULL AND k IS NOT NULL AND v > 0 AND c_acctbal + v > 12000) AND NOT (c_custkey IS NULL AND v < 1000)""")
def merge_upsert(s: S, d: str) -> DataFrame:
    """MERGE with conditional update, delete and insert."""
    target = t(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    key = F.when(F.col("s_suppkey") % 3 == 0, -F.col("s_suppkey")).otherwise(F.col("s_suppkey") * 2)
    source = t(s, d, "supplier").select(key.alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return merge_into(
        target, source, ["c_custkey"], update={"c_acctbal": F.round(F.col("t.c_acctbal") + F.col("s.c_acctbal"), 4)}, update_where=F.col("s.c_acctbal") > 0, delete_where=F.col("c_acctbal") > 12000, insert_where=F.col("s.c_acctbal") >= 1000
    )


@P.query("SELECT c_custkey, CASE WHEN x.top IS NOT NULL THEN x.top ELSE c_acctbal END AS c_acctbal, CASE WHEN x.top IS NOT NULL THEN 'TOP' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 450000 GROUP BY 1) x ON o_custkey = c_custkey")
def update_from_query(s: S, d: str) -> DataFrame:
    """UPDATE SET (a, b) = (subquery)."""
    top = t(s, d, "orders").where("o_totalprice > 450000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return t(s, d, "customer").join(top, "c_custkey", "left").select("c_custkey", F.coalesce("top", "c_acctbal").alias("c_acctbal"), F.when(F.col("top").isNotNull(), "TOP").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


@P.query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F' AND o_totalprice < 200000, false)")
def delete_where(s: S, d: str) -> DataFrame:
    """DELETE: rows for which the condition isn't true stay."""
    return t(s, d, "orders").where(~F.coalesce((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 200000), F.lit(False))).select("o_orderkey")


@P.query("SELECT 'big' AS target, o_orderkey FROM orders WHERE o_totalprice >= 300000 UNION ALL SELECT 'mid', o_orderkey FROM orders WHERE o_totalprice < 300000 AND o_totalprice >= 100000 UNION ALL SELECT 'rest', o_orderkey FROM orders WHERE o_totalprice < 100000")
def insert_first(s: S, d: str) -> DataFrame:
    """INSERT FIRST WHEN: each row goes to the first target whose condition holds."""
    target = F.when(F.col("o_totalprice") >= 300000, "big").when(F.col("o_totalprice") >= 100000, "mid").otherwise("rest")
    return t(s, d, "orders").select(target.alias("target"), "o_orderkey")


@P.query("SELECT 'urgent' AS target, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'big', o_orderkey FROM orders WHERE o_totalprice > 300000")
def insert_all(s: S, d: str) -> DataFrame:
    """INSERT ALL WHEN: each row goes to every target whose condition holds, in one scan."""
    targets = F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_totalprice") > 300000, "big"))
    return t(s, d, "orders").select(F.explode(F.filter(targets, lambda x: x.isNotNull())).alias("target"), "o_orderkey")


@P.query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'qty' WHEN l_discount > 0.09 THEN 'discount' END AS reject_reason FROM lineitem")
def bulk_rejects(s: S, d: str) -> DataFrame:
    """FORALL SAVE EXCEPTIONS and LOG ERRORS: rows that keep the rules, and the others with the rule they break."""
    good, bad = split_rejects(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), {"qty": F.col("l_quantity") >= 5, "discount": F.col("l_discount") <= 0.09})
    shown = ["l_orderkey", "l_linenumber", "reject_reason"]
    return good.withColumn("reject_reason", F.lit(None).cast("string")).select(*shown).unionByName(bad.select(*shown))


@P.query("SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN strftime(l_shipdate, '%Y%m') END AS archive_month FROM lineitem")
def archive_split(s: S, d: str) -> DataFrame:
    """Rows moved to monthly archives and rows that stay."""
    kept, gone = split_before(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day")), "day", "1999-01-01")
    return kept.withColumn("archive_month", F.lit(None).cast("string")).unionByName(gone).drop("day")


#: Purchase lines as lots: item, lot, day of receipt, quantity in stock, unit cost.
_LOTS = """SELECT item_id, lot, received, avail, cost FROM (SELECT DISTINCT po_line_id AS lot, item_id, coalesce(need_date, DATE '2020-01-01') AS received, qty_received AS avail, unit_price AS cost FROM t_po_line WHERE item_id IS NOT NULL) WHERE avail > 0"""


def _lots(s: S, d: str) -> DataFrame:
    day = F.coalesce(F.col("need_date"), F.lit("2020-01-01").cast("date"))
    x = t(s, d, "t_po_line").where("item_id is not null and qty_received > 0")
    return x.select("item_id", F.col("po_line_id").alias("lot"), day.alias("received"), F.col("qty_received").alias("avail"), F.col("unit_price").alias("cost")).distinct()


@P.query(f"SELECT item_id, lot, row_number() OVER w AS layer, CAST(sum(avail) OVER w * 10000 AS BIGINT) AS cum_qty_e4, CAST(floor(sum(CAST(avail AS DECIMAL(19,4)) * CAST(cost AS DECIMAL(19,6))) OVER w * 100) AS BIGINT) AS cum_cents FROM ({_LOTS}) WINDOW w AS (PARTITION BY item_id ORDER BY received, lot ROWS UNBOUNDED PRECEDING)")
def fifo_layers(s: S, d: str) -> DataFrame:
    """Lots in order of receipt with running quantity and amount."""
    x = _lots(s, d).withColumn("amount", F.col("avail").cast("decimal(18,4)") * F.col("cost").cast("decimal(16,6)"))
    x = running(x, ["item_id"], ["received", "lot"], {"cum_qty": "avail", "cum_amount": "amount"}, position="layer")
    return x.select("item_id", "lot", "layer", (F.col("cum_qty") * 10_000).cast("long").alias("cum_qty_e4"), F.floor(F.col("cum_amount") * 100).cast("long").alias("cum_cents"))


_NEEDS = "SELECT item_id, CAST(sum(qty_ordered) AS DECIMAL(18,4)) AS need FROM (SELECT DISTINCT so_line_id, item_id, qty_ordered FROM t_so_line) WHERE item_id IS NOT NULL GROUP BY 1"


def _needs(s: S, d: str) -> DataFrame:
    lines = t(s, d, "t_so_line").where("item_id is not null").select("so_line_id", "item_id", "qty_ordered").distinct()
    return lines.groupBy("item_id").agg(F.sum("qty_ordered").cast("decimal(18,4)").alias("need"))


@P.query(f"""
    WITH l AS (SELECT *, sum(avail) OVER (PARTITION BY item_id ORDER BY received, lot ROWS UNBOUNDED PRECEDING) AS cum, sum(avail) OVER (PARTITION BY item_id) AS stock FROM ({_LOTS})), x AS (SELECT *, greatest(0, least(avail, need - (cum - avail))) AS take FROM l JOIN ({_NEEDS}) USING (item_id) WHERE stock >= need)
    SELECT item_id, lot, CAST(take AS DOUBLE) AS take, CAST(avail - take AS DOUBLE) AS lot_left, CASE WHEN avail = take THEN 'CONSUMED' ELSE 'AVAILABLE' END AS status, CAST(stock - (cum - avail) AS DOUBLE) AS qty_before, CAST(stock - (cum - avail) - take AS DOUBLE) AS qty_after FROM x WHERE take > 0""")
def fifo_issue(s: S, d: str) -> DataFrame:
    """What each lot gives to its item's need, first in first out, with stock before and after; short items give nothing."""
    issued, _ = issue(_lots(s, d), _needs(s, d), ["item_id"], ["received", "lot"], available="avail", needed="need")
    shown = {c: F.col(c).cast("double") for c in ("take", "lot_left", "qty_before", "qty_after")}
    return issued.withColumns(shown).select("item_id", "lot", "take", "lot_left", "status", "qty_before", "qty_after")


@P.query(f"SELECT n.item_id, CAST(need AS DOUBLE) AS need, CAST(coalesce(stock, 0) AS DOUBLE) AS stock FROM ({_NEEDS}) n LEFT JOIN (SELECT item_id, sum(avail) AS stock FROM ({_LOTS}) GROUP BY 1) USING (item_id) WHERE need > coalesce(stock, 0)")
def short_stock(s: S, d: str) -> DataFrame:
    """The needs that stock does not cover."""
    _, short = issue(_lots(s, d), _needs(s, d), ["item_id"], ["received", "lot"], available="avail", needed="need")
    return short.select("item_id", F.col("need").cast("double").alias("need"), F.col("stock").cast("double").alias("stock"))


@P.query(f"""
    WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY received, lot) AS k FROM ({_LOTS})),
    w AS (SELECT item_id, lot, k, CAST(avail AS DOUBLE) AS q, CAST(cost AS DOUBLE) AS c FROM r WHERE k = 1
      UNION ALL SELECT r.item_id, r.lot, r.k, w.q + CAST(r.avail AS DOUBLE), round((w.q * w.c + CAST(r.avail AS DOUBLE) * CAST(r.cost AS DOUBLE)) / (w.q + CAST(r.avail AS DOUBLE)), 6) FROM w JOIN r ON r.item_id = w.item_id AND r.k = w.k + 1)
    SELECT item_id, lot, round(q, 4) AS qty_after, c AS avg_cost FROM w""")
def moving_average_cost(s: S, d: str) -> DataFrame:
    """The moving average cost after each receipt, rounded at each: the fold that a receipt routine makes."""
    x = receive(_lots(s, d), ["item_id"], ["received", "lot"], quantity="avail", cost="cost")
    return x.select("item_id", "lot", F.round(F.col("qty_after").cast("double"), 4).alias("qty_after"), "avg_cost")


@P.query(f"""
    WITH l AS (SELECT item_id, sum(avail) AS q, sum(CAST(avail AS DECIMAL(19,4)) * CAST(cost AS DECIMAL(19,6))) AS v FROM ({_LOTS}) GROUP BY 1), i AS (SELECT DISTINCT item_id, valuation_method, std_cost FROM t_item)
    SELECT item_id, valuation_method, CAST(q AS DOUBLE) AS qty, round(CASE WHEN valuation_method = 'STD' THEN CAST(q AS DOUBLE) * CAST(std_cost AS DOUBLE) ELSE CAST(v AS DOUBLE) END, 4) AS value FROM l JOIN i USING (item_id)""")
def inventory_value(s: S, d: str) -> DataFrame:
    """Stock valued at standard cost or at the cost of its lots, as the item says."""
    lots = _lots(s, d).groupBy("item_id").agg(F.sum("avail").alias("q"), F.sum(F.col("avail").cast("decimal(18,4)") * F.col("cost").cast("decimal(16,6)")).alias("v"))
    items = t(s, d, "t_item").select("item_id", "valuation_method", "std_cost").distinct()
    value = F.when(F.col("valuation_method") == "STD", F.col("q").cast("double") * F.col("std_cost").cast("double")).otherwise(F.col("v").cast("double"))
    return lots.join(items, "item_id").select("item_id", "valuation_method", F.col("q").cast("double").alias("qty"), F.round(value, 4).alias("value"))


#: Movements: receipts in, shipments out, half of each receipt moved to a second place.
_MOVES = f"""SELECT item_id, 1 AS place, lot AS doc, 1 AS leg, received AS day, avail AS qty FROM ({_LOTS})
      UNION ALL SELECT item_id, 1, lot, 2, received, -floor(avail / 2) FROM ({_LOTS}) UNION ALL SELECT item_id, 2, lot, 2, received, floor(avail / 2) FROM ({_LOTS})"""


def _moves(s: S, d: str) -> DataFrame:
    x = _lots(s, d).select("item_id", F.lit(1).alias("place"), F.col("lot").alias("doc"), F.lit(1).alias("leg"), F.col("received").alias("day"), F.col("avail").alias("qty"))
    out = x.select("item_id", F.lit(1).alias("from_place"), F.lit(2).alias("to_place"), "doc", "day", F.floor(F.col("qty") / 2).cast("decimal(18,4)").alias("qty"))
    return x.unionByName(transfers(out, quantity="qty", from_place="from_place", to_place="to_place", place="place").withColumn("leg", F.lit(2)))


@P.query(f"SELECT item_id, place, doc, leg, CAST((sum(qty) OVER w - qty) * 10000 AS BIGINT) AS before_e4, CAST(sum(qty) OVER w * 10000 AS BIGINT) AS after_e4 FROM ({_MOVES}) WINDOW w AS (PARTITION BY item_id, place ORDER BY day, doc, leg ROWS UNBOUNDED PRECEDING)")
def running_ledger(s: S, d: str) -> DataFrame:
    """Stock before and after every movement of an ordered ledger, transfers as two legs."""
    x = running(_moves(s, d), ["item_id", "place"], ["day", "doc", "leg"], {"after": "qty"})
    return x.select("item_id", "place", "doc", "leg", ((F.col("after") - F.col("qty")) * 10_000).cast("long").alias("before_e4"), (F.col("after") * 10_000).cast("long").alias("after_e4"))


@P.query(f"SELECT item_id, place, CAST(sum(qty) * 10000 AS BIGINT) AS on_hand_e4, max(day) AS last_day, count(*) AS version FROM ({_MOVES}) GROUP BY 1, 2")
def synced_balance(s: S, d: str) -> DataFrame:
    """Balances rebuilt from their ledger."""
    x = _moves(s, d).groupBy("item_id", "place").agg((F.sum("qty") * 10_000).cast("long").alias("on_hand_e4"), F.max("day").alias("last_day"), F.count("*").alias("version"))
    return x


@P.query(f"SELECT item_id, need, rank() OVER (ORDER BY need DESC) AS place FROM (SELECT item_id, CAST(need AS DOUBLE) AS need FROM ({_NEEDS})) QUALIFY rank() OVER (ORDER BY need DESC) <= 20")
def top_consumed(s: S, d: str) -> DataFrame:
    """The twenty items consumed most, ties included."""
    top = with_ties(_needs(s, d), ["need"], 20, descending=True)
    return ranked(top, "need").select("item_id", F.col("need").cast("double").alias("need"), F.col("rank").alias("place"))


@P.query("""WITH n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 15 = 0 THEN NULL WHEN c_custkey % 25 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer)
    SELECT o.c_custkey, 'c_mktsegment' AS "column", o.c_mktsegment AS old_value, n.c_mktsegment AS new_value FROM customer o JOIN n USING (c_custkey) WHERE o.c_mktsegment <> n.c_mktsegment""")
def row_trigger_audit(s: S, d: str) -> DataFrame:
    """Row trigger on changed columns: changes to null aren't audited."""
    old = t(s, d, "customer")
    new = old.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 15 == 0, F.lit(None)).when(F.col("c_custkey") % 25 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")))
    return row_changes(old, new, ["c_custkey"], ["c_mktsegment", "c_name"])


@P.query("SELECT date_trunc('day', ts)::DATE AS day, user_id, CAST(sum(CAST(CASE WHEN event_type = 'error' THEN -value ELSE value END AS DECIMAL(18,4))) AS DOUBLE) AS net, count(*) AS n_rows FROM events GROUP BY 1, 2")
def statement_trigger_net(s: S, d: str) -> DataFrame:
    """Compound trigger: net change by statement and key."""
    x = t(s, d, "events").select(F.col("ts").cast("date").alias("day"), "user_id", F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("v"))
    return net_changes(x, ["day"], ["user_id"], "v").withColumn("net", F.col("net").cast("double"))


@P.query("""SELECT job, last_run, CASE freq WHEN 'DAILY' THEN CAST(last_run + INTERVAL 1 DAY AS DATE) ELSE CAST(last_run + INTERVAL 1 MONTH AS DATE) END AS next_run FROM (SELECT event_type AS job, CAST(max(ts) AS DATE) AS last_run, CASE WHEN event_type < 'm' THEN 'DAILY' ELSE 'MONTHLY' END AS freq FROM events GROUP BY event_type)""")
def scheduled_jobs(s: S, d: str) -> DataFrame:
    """Latest run and next run of jobs with FREQ=DAILY or MONTHLY."""
    x = t(s, d, "events").groupBy(F.col("event_type").alias("job")).agg(F.max("ts").cast("date").alias("last_run"))
    return x.select("job", "last_run", F.when(F.col("job") < "m", F.date_add("last_run", 1)).otherwise(F.add_months("last_run", 1)).alias("next_run"))


@P.query("SELECT s_suppkey, total, rank() OVER (ORDER BY total DESC) AS by_total, dense_rank() OVER (ORDER BY n DESC) AS by_n, round(100 * total / sum(total) OVER (), 4) AS share FROM (SELECT s_suppkey, coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE), 0.0) AS total, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1)")
def supplier_rank(s: S, d: str) -> DataFrame:
    """RANK, DENSE_RANK and share over aggregated rows; suppliers without rows stay."""
    x = t(s, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(o.exact(F.col("l_extendedprice"))).cast("double").alias("total"), F.count("*").alias("n"))
    y = t(s, d, "supplier").select("s_suppkey").join(x, "s_suppkey", "left").select("s_suppkey", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    by_total = ranked(y, "total").select("s_suppkey", F.col("rank").alias("by_total"))
    by_n = ranked(y, "n").select("s_suppkey", F.col("dense_rank").alias("by_n"))
    whole = y.agg(F.sum("total").alias("whole"))
    return y.join(by_total, "s_suppkey").join(by_n, "s_suppkey").crossJoin(F.broadcast(whole)).select("s_suppkey", "total", "by_total", "by_n", F.round(100 * F.col("total") / F.nullif("whole", F.lit(0.0)), 4).alias("share"))


@P.query(f"""
    SELECT lot, item_id, age_days, CASE WHEN age_days <= 30 THEN '0-30' WHEN age_days <= 60 THEN '31-60' WHEN age_days <= 90 THEN '61-90' ELSE '90+' END AS age_bucket, ntile(4) OVER (ORDER BY age_days, lot) AS age_quartile, round(CAST(avail AS DOUBLE) / CAST(sum(avail) OVER () AS DOUBLE) * 100, 6) AS qty_pct
    FROM (SELECT *, datediff('day', received, DATE '2028-12-31') AS age_days FROM ({_LOTS}))""")
def stock_aging(s: S, d: str) -> DataFrame:
    """Lots by age as of a stated day: buckets, quartiles over the whole stock, shares of it; no window in one task."""
    x = _lots(s, d).select("lot", "item_id", "avail", F.datediff(F.lit("2028-12-31").cast("date"), "received").alias("age_days"))
    x = next_values(x, "_n", 1, "age_days", "lot")
    whole = x.agg(F.sum("avail").alias("_all"), F.count("*").alias("_rows"))
    age, low, more = F.col("age_days"), F.expr("_rows div 4"), F.expr("_rows % 4")
    quartile = F.when(F.col("_n") <= more * (low + 1), F.expr("(_n - 1) div (_rows div 4 + 1)")).otherwise(F.expr("(_n - 1 - _rows % 4) div greatest(_rows div 4, 1)")) + 1
    return x.crossJoin(F.broadcast(whole)).select(
        "lot", "item_id", "age_days", F.when(age <= 30, "0-30").when(age <= 60, "31-60").when(age <= 90, "61-90").otherwise("90+").alias("age_bucket"), quartile.cast("long").alias("age_quartile"),
        F.round(F.col("avail").cast("double") / F.col("_all").cast("double") * 100, 6).alias("qty_pct"),
    )


@P.query("SELECT so_id, so_line_id, row_number() OVER (PARTITION BY so_id ORDER BY so_line_id) * 10 AS line_no FROM (SELECT DISTINCT so_id, so_line_id FROM t_so_line)")
def grouped_lines(s: S, d: str) -> DataFrame:
    """Line numbers of documents made from grouped rows."""
    x = running(t(s, d, "t_so_line").select("so_id", "so_line_id").distinct(), ["so_id"], ["so_line_id"], {}, position="n")
    return x.select("so_id", "so_line_id", (F.col("n") * 10).alias("line_no"))


@P.query("""SELECT c_nationkey, m, qty, round(ape, 4) AS ape, round(avg(ape) OVER (PARTITION BY c_nationkey ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mape3, round((qty - lag(qty) OVER (PARTITION BY c_nationkey ORDER BY m)) / nullif(lag(qty) OVER (PARTITION BY c_nationkey ORDER BY m), 0), 4) AS growth
    FROM (SELECT c_nationkey, m, qty, abs(qty - prev) / nullif(qty, 0) AS ape FROM (SELECT *, lag(qty) OVER (PARTITION BY c_nationkey ORDER BY m) AS prev FROM (SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(count(*) AS DOUBLE) AS qty FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)))""")
def accuracy_windows(s: S, d: str) -> DataFrame:
    """Error of a naive forecast, its moving mean, growth against the month before."""
    x = t(s, d, "orders").join(t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("c_nationkey", F.trunc("o_orderdate", "MM").alias("m")).agg(F.count("*").cast("double").alias("qty"))
    w = Window.partitionBy("c_nationkey").orderBy("m")
    prev = F.lag("qty").over(w)
    x = x.withColumn("prev", prev).withColumn("ape", F.abs(F.col("qty") - F.col("prev")) / F.nullif("qty", F.lit(0.0)))
    return x.select("c_nationkey", "m", "qty", F.round("ape", 4).alias("ape"), F.round(F.avg("ape").over(w.rowsBetween(-2, 0)), 6).alias("mape3"), F.round((F.col("qty") - F.col("prev")) / F.nullif("prev", F.lit(0.0)), 4).alias("growth"))


@P.query(f"""
    WITH i AS (SELECT DISTINCT item_id, std_cost, abc_class FROM t_item), v AS (SELECT item_id, CAST(need AS DECIMAL(19,4)) * CAST(std_cost AS DECIMAL(19,6)) AS val FROM ({_NEEDS}) JOIN i USING (item_id)),
    c AS (SELECT item_id, CAST(sum(val) OVER (ORDER BY val DESC) AS DOUBLE) / CAST(sum(val) OVER () AS DOUBLE) AS cum FROM v)
    SELECT item_id, CASE WHEN cum IS NULL THEN abc_class WHEN cum <= 0.8 THEN 'A' WHEN cum <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM i LEFT JOIN c USING (item_id)""")
def reclassified_items(s: S, d: str) -> DataFrame:
    """The items' classes anew, by the cumulative share of what was ordered of them; equal values share a place, items without orders keep theirs."""
    items = t(s, d, "t_item").select("item_id", "std_cost", "abc_class").distinct()
    value = _needs(s, d).join(items, "item_id").select("item_id", (F.col("need").cast("decimal(18,4)") * F.col("std_cost").cast("decimal(16,6)")).alias("val"))
    whole = value.agg(F.sum("val").cast("double").alias("whole"))
    share = F.col("cum_val").cast("double") / F.col("whole")
    placed = ranked(value, "val", ["val"]).crossJoin(F.broadcast(whole)).select("item_id", F.when(share <= 0.8, "A").when(share <= 0.95, "B").otherwise("C").alias("abc_class"))
    return merge_into(items.select("item_id", "abc_class"), placed, ["item_id"], update={"abc_class": F.col("s.abc_class")}, insert_where=F.lit(False))
