"""Queries over conversations, events and the relational tables: costs, routing, rate limits, catalogue, graph, joins, sinks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions.answers import numbered, search_terms
from textloom.functions.calculator import calculated
from textloom.functions.fixed import FALLBACK, HARD_SIGNALS, RATES
from textloom.functions.text import any_of
from textloom.operators.evaluation import drift
from textloom.plans.registry import query
from textloom.sources.tables import delete, insert_unique, table, upsert

PRICES = ", ".join(f"('{m}', {i}, {o})" for m, (i, o) in RATES.items())
MODEL = "CASE conv_id % 4 WHEN 0 THEN 'llama-3.3-70b-versatile' WHEN 1 THEN 'openai/gpt-oss-20b' WHEN 2 THEN 'llama-3.1-8b-instant' ELSE 'unlisted' END"
CALLS = f"WITH calls AS (SELECT conv_id, turn, {MODEL} AS model, CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END AS tin, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS tout FROM conversations), prices AS (SELECT * FROM (VALUES {PRICES}) v(model, pin, pout)), priced AS (SELECT calls.*, tin / 1e6 * coalesce(CAST(pin AS DOUBLE), {FALLBACK[0]:.1f}) + tout / 1e6 * coalesce(CAST(pout AS DOUBLE), {FALLBACK[1]:.1f}) AS cost FROM calls LEFT JOIN prices USING (model)) "


def priced(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answer, n = F.col("role") == "assistant", F.floor(F.length("text") / 4)
    model = F.when(F.col("conv_id") % 4 == 0, "llama-3.3-70b-versatile").when(F.col("conv_id") % 4 == 1, "openai/gpt-oss-20b").when(F.col("conv_id") % 4 == 2, "llama-3.1-8b-instant").otherwise("unlisted")
    c = c.select("conv_id", "turn", model.alias("model"), F.when(answer, 0).otherwise(n).alias("tin"), F.when(answer, n).otherwise(0).alias("tout"))
    prices = spark.createDataFrame([(m, i, o) for m, (i, o) in RATES.items()], "model string, pin double, pout double")
    cost = F.col("tin") / 1e6 * F.coalesce("pin", F.lit(FALLBACK[0])) + F.col("tout") / 1e6 * F.coalesce("pout", F.lit(FALLBACK[1]))
    return c.join(F.broadcast(prices), "model", "left").withColumn("cost", cost)


@query(CALLS + "SELECT conv_id, count(*) AS calls, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, round(sum(cost), 9) AS cost, round(sum(cost) / count(*), 9) AS cost_per_call FROM priced GROUP BY conv_id")
def session_costs(spark, sf_dir):
    return priced(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("calls"), F.sum("tin").cast("long").alias("tokens_in"), F.sum("tout").cast("long").alias("tokens_out"), F.round(F.sum("cost"), 9).alias("cost"), F.round(F.sum("cost") / F.count("*"), 9).alias("cost_per_call"))


@query(CALLS + ", s AS (SELECT conv_id, model, count(*) AS calls, sum(cost) AS cost FROM priced GROUP BY ALL) SELECT calls, model, count(*) AS sessions, round(avg(cost), 9) AS mean_cost FROM s GROUP BY calls, model HAVING count(*) >= 2")
def matched_comparison(spark, sf_dir):
    s = priced(spark, sf_dir).groupBy("conv_id", "model").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
    return s.groupBy("calls", "model").agg(F.count("*").alias("sessions"), F.round(F.avg("cost"), 9).alias("mean_cost")).where("sessions >= 2")


@query(CALLS + "SELECT model, count(*) AS calls, round(avg(cost), 9) AS mean, round(coalesce(stddev_samp(cost), 0), 9) AS spread, round(min(cost), 9) AS least, round(max(cost), 9) AS most FROM priced GROUP BY model")
def configuration_costs(spark, sf_dir):
    r = lambda c: F.round(c, 9)
    return priced(spark, sf_dir).groupBy("model").agg(F.count("*").alias("calls"), r(F.avg("cost")).alias("mean"), r(F.coalesce(F.stddev_samp("cost"), F.lit(0.0))).alias("spread"), r(F.min("cost")).alias("least"), r(F.max("cost")).alias("most"))


@query("SELECT conv_id, arg_max(text, turn) AS last_question, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_question"), F.max("turn").alias("turn"))


HARD = " OR ".join("contains(lower(text), '" + s + "')" for s in HARD_SIGNALS)


@query(f"SELECT conv_id, turn, length(text) <= 200 AND NOT ({HARD}) AS cheap FROM conversations WHERE role = 'user'")
def model_routing(spark, sf_dir):
    hard = any_of(*(F.contains(F.lower("text"), F.lit(s)) for s in HARD_SIGNALS))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", ((F.length("text") <= 200) & ~hard).alias("cheap"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN left(text, 200) || '... [' || CAST(length(text) - 200 AS VARCHAR) || ' more]' ELSE text END AS clipped FROM conversations")
def truncated_results(spark, sf_dir):
    more = F.concat(F.left("text", F.lit(200)), F.lit("... ["), (F.length("text") - 200).cast("string"), F.lit(" more]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.length("text") > 200, more).otherwise(F.col("text")).alias("clipped"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6 AS kept FROM conversations")
def conversation_suffix(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) <= 6).alias("kept"))


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) // 4 AS est_tokens FROM conversations GROUP BY conv_id")
def estimated_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.floor(F.sum(F.length("text")) / 4).alias("est_tokens"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS last_day, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 60 AS over_limit FROM events")
def rolling_rate_limit(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("textloom_events")
    return spark.sql("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS last_hour,
        count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW) AS last_day,
        count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) > 60 AS over_limit FROM textloom_events""")


@query("SELECT event_id, round(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 3) AS gap_s FROM events")
def politeness_gap(spark, sf_dir):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.round((micros(F.col("ts")) - micros(before)) / 1e6, 3).alias("gap_s"))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "total")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s")
def sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("SELECT event_type, CAST(regexp_extract(props, '\"k\": ?(\\d+)', 1) AS BIGINT) % 10 AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def json_properties(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint") % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1500 AND p_brand = 'Brand#2' ORDER BY p_retailprice, p_partkey LIMIT 20")
def structured_list(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_retailprice between 950 and 1500 and p_brand = 'Brand#2'").orderBy(F.asc_nulls_last("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT p_brand, p_type, count(*) AS n, round(min(p_retailprice), 2) AS cheapest FROM part WHERE p_size >= 10 GROUP BY ALL")
def structured_count(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size >= 10").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.min("p_retailprice"), 2).alias("cheapest"))


#: Lines of a partition of bought_together.
LINES = 50_000


@query("WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM c) SELECT src, dst, n, rank FROM r WHERE rank <= 2")
def bought_together(spark, sf_dir):
    """Shuffles have a partition for each 50,000 lines, so a task's memory doesn't grow with the table."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = max(1, -(-lines.count() // LINES))
    e = lines.repartition(parts, "l_orderkey").distinct()
    pairs = e.select("l_orderkey", F.col("l_partkey").alias("src")).join(e.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").where("src <> dst").select("src", "dst")
    pairs = pairs.repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n")).repartition(parts, "src")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst")).cast("long")).where("rank <= 2")


@query("SELECT p_partkey, list(sib ORDER BY sib) AS siblings FROM (SELECT a.p_partkey, b.p_partkey AS sib, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS rn FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) WHERE rn <= 2 GROUP BY p_partkey")
def category_siblings(spark, sf_dir):
    """The two lowest other parts of a category, without pairing its members: its three lowest, less the part itself."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    low = p.withColumn("rn", F.row_number().over(Window.partitionBy("p_type", "p_brand").orderBy("p_partkey"))).where("rn <= 3").groupBy("p_type", "p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("low"))
    out = p.join(low, ["p_type", "p_brand"]).select("p_partkey", F.slice(F.filter("low", lambda x: x != F.col("p_partkey")), 1, 2).alias("siblings"))
    return out.where("size(siblings) > 0")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def paginated(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT c_nationkey FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier")
def shared_nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey").intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def unique_insert(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return insert_unique(rows.limit(0), rows, "o_custkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 5 <> 1")
def upsert_and_delete(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return delete(upsert(p, p.where("p_partkey % 3 = 0").withColumn("p_name", F.upper("p_name")), "p_partkey"), p.where("p_partkey % 5 = 1"), "p_partkey")


@query("SELECT r_name, n_name, GROUPING(r_name, n_name) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def balance_rollup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS views, coalesce(b.n, 0) AS purchases FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id")
def paired_outcomes(spark, sf_dir):
    counts = lambda kind, name: table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))
    return counts("view", "views").join(counts("purchase", "purchases"), "user_id", "full_outer").select("user_id", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("purchases", F.lit(0)).alias("purchases"))


@query(r"""SELECT conv_id, turn, coalesce(nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(trim(text), '\s+'), lambda w: regexp_replace(w, '[-+&|!(){}\[\]^"~*?:\\/]', '', 'g')), lambda w: w <> ''), ' OR '), ''), text) AS terms FROM conversations WHERE role = 'user'""")
def search_expressions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", search_terms(F.col("text")).alias("terms"))


@query("SELECT conv_id, string_agg('[' || n || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def numbered_context(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n <= 3")
    parts = F.array_sort(F.collect_list(F.struct("n", F.col("role").alias("title"), F.col("text").alias("body"))))
    return first.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", numbered(F.col("parts")).alias("context"))


@query("SELECT event_id, CAST(event_id % 97 * 3 - (7 + user_id % 5) // 2 AS DOUBLE) AS result FROM events")
def calculator(spark, sf_dir):
    text = F.concat((F.col("event_id") % 97).cast("string"), F.lit(" * 3 - (7 + "), (F.col("user_id") % 5).cast("string"), F.lit(") // 2"))
    return table(spark, sf_dir, "events").select("event_id", calculated(text).alias("result"))


@query("WITH claims AS (SELECT unnest([p_partkey % 13, p_partkey % 13 + 1]) AS q, p_partkey AS article_id, CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS title FROM part), once AS (SELECT article_id, title, min(q) AS question_id FROM claims GROUP BY ALL) SELECT article_id, title, question_id, p_name AS actual, CASE WHEN p_partkey IS NULL THEN 'gone' ELSE 'retitled' END AS problem FROM once LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) p ON p_partkey = article_id WHERE p_partkey IS NULL OR trim(p_name) <> trim(title)")
def evaluation_drift(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    title = F.when(F.col("p_partkey") % 11 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    q = F.col("p_partkey") % 13
    claims = p.select(F.explode(F.array(q, q + 1)).alias("question_id"), F.col("p_partkey").alias("article_id"), title.alias("title"))
    return drift(claims, p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))
