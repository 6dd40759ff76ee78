"""Queries on evaluation and gates: fused result lists, scores, answers, citations, robots, validation, usage."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.fixed import LIMITS
from textloom.operators import dom, pages, robots, splitting, structured
from textloom.plans.registry import query
from textloom.plans.retrieval import SIMS, ranked
from textloom.sources.tables import table


@query(SIMS + ", firsts AS (SELECT query_id // 100 % 7 AS question, vec_id, min(query_id * 10 + rank) AS place FROM ranked WHERE rank <= 3 GROUP BY ALL) SELECT question, vec_id, row_number() OVER (PARTITION BY question ORDER BY place, vec_id) AS position FROM firsts QUALIFY position <= 6")
def multi_query_union(spark, sf_dir):
    """Seven questions, each in several wordings: the first three of each wording, each vector at its first place, six a question."""
    top = ranked(spark, sf_dir, 3).withColumn("question", F.floor(F.col("query_id") / 100) % 7)
    at = top.groupBy("question", "vec_id").agg(F.min(F.col("query_id") * 10 + F.col("rank")).alias("place"))
    position = F.row_number().over(Window.partitionBy("question").orderBy("place", "vec_id")).cast("long")
    return at.select("question", "vec_id", position.alias("position")).where("position <= 6")


@query(SIMS + ", best AS (SELECT query_id, label, max(similarity) AS similarity FROM ranked WHERE rank <= 12 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, label) AS place FROM best")
def collapsed_articles(spark, sf_dir):
    """Chunks found, as articles in the order of their best chunk."""
    best = ranked(spark, sf_dir).groupBy("query_id", "label").agg(F.max("similarity").alias("similarity"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc_nulls_last("label"))).cast("long"))


@query(SIMS + """, best AS (SELECT query_id, wanted, label, max(similarity) AS s FROM ranked WHERE rank <= 12 GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) AS place FROM best),
per AS (SELECT query_id, wanted % 2 = 0 AS answerable, min(place) FILTER (label = wanted) AS p, max(s) AS s FROM placed GROUP BY ALL)
SELECT count(*) FILTER (answerable) AS answerable, count(*) FILTER (answerable AND p <= 1) AS top_1, count(*) FILTER (answerable AND p <= 5) AS top_5, count(*) FILTER (NOT answerable) AS unanswerable, count(*) FILTER (NOT answerable AND s < 0.425) AS refused FROM per""")
def answer_score(spark, sf_dir):
    """First and first five articles of answerable questions, refusals of the others."""
    placed = ranked(spark, sf_dir).groupBy("query_id", "wanted", "label").agg(F.max("similarity").alias("s"))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), F.asc_nulls_last("label"))))
    per = placed.groupBy("query_id", (F.col("wanted") % 2 == 0).alias("answerable")).agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("place"))).alias("p"), F.max("s").alias("s"))
    a = F.col("answerable")
    return per.agg(F.count_if(a).alias("answerable"), F.count_if(a & (F.col("p") <= 1)).alias("top_1"), F.count_if(a & (F.col("p") <= 5)).alias("top_5"), F.count_if(~a).alias("unanswerable"), F.count_if(~a & (F.col("s") < 0.425)).alias("refused"))


REPLY = "CASE WHEN turn % 4 = 1 THEN text || ' [' || turn || ', 2] and [9]' WHEN turn % 4 = 2 THEN 'I don''t know.' ELSE text END"


@query(f"""WITH a AS (SELECT conv_id, turn, {REPLY} AS t FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, rtrim(lower(trim(t)), '.! ') AS t, list_distinct(list_transform(list_filter(string_split(array_to_string(regexp_extract_all(t, '\\[\\s*([0-9][0-9,\\s]*?)\\s*\\]', 1), ','), ','), lambda x: trim(x) <> ''), lambda x: CAST(trim(x) AS INT))) AS cited FROM a)
SELECT conv_id, turn, list_sort(cited) AS cited, list_sort(list_filter(cited, lambda x: x NOT BETWEEN 1 AND 5)) AS invalid, CASE WHEN t IN ('i don''t know', 'i do not know') THEN 'refused' WHEN len(cited) = 0 THEN 'uncited' WHEN len(list_filter(cited, lambda x: x NOT BETWEEN 1 AND 5)) > 0 THEN 'wrong_source' ELSE 'cited' END AS outcome FROM c""")
def citation_outcomes(spark, sf_dir):
    """Of replies to five sources: what they cite, which of it can't be, and the first outcome that holds."""
    turn, text = F.col("turn"), F.col("text")
    reply = F.when(turn % 4 == 1, F.concat(text, F.lit(" ["), turn.cast("string"), F.lit(", 2] and [9]"))).when(turn % 4 == 2, "I don't know.").otherwise(text)
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", reply.alias("t"))
    a = a.withColumn("cited", F.array_sort(tx.citations(F.col("t"))))
    a = a.withColumn("invalid", F.filter("cited", lambda x: ~x.between(1, 5)))
    outcome = F.when(tx.is_refusal(F.col("t")), "refused").when(F.size("cited") == 0, "uncited").when(F.size("invalid") > 0, "wrong_source").otherwise("cited")
    return a.select("conv_id", "turn", "cited", "invalid", outcome.alias("outcome"))


@query("SELECT turn % 5 AS run, count(*) AS n, sum(CASE WHEN length(text) >= 200 THEN 1.0 WHEN length(text) >= 80 THEN 0.5 ELSE 0.0 END)::DOUBLE AS points FROM conversations WHERE role = 'assistant' GROUP BY 1")
def weighted_accuracy(spark, sf_dir):
    """Whole points for long replies, half for middling ones, as judged answers are added up."""
    n = F.length("text")
    points = F.when(n >= 200, 1.0).when(n >= 80, 0.5).otherwise(0.0)
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy((F.col("turn") % 5).alias("run")).agg(F.count("*").alias("n"), F.sum(points).alias("points"))


@query("WITH p AS (SELECT doc_id, i AS parent, substr(text, i * 2000 + 1, 2000) AS body FROM documents, LATERAL (SELECT unnest(range(0, (length(text) + 1999) // 2000)) AS i)), c AS (SELECT doc_id, parent, j AS child, substr(body, j * 200 + 1, 200) AS t FROM p, LATERAL (SELECT unnest(range(0, (length(body) + 199) // 200)) AS j)) SELECT doc_id, parent, min(child) AS first_child, count(*) AS hits FROM c WHERE contains(lower(t), 'license') GROUP BY ALL")
def parent_passages(spark, sf_dir):
    """Parents of 2,000 characters whose children of 200 name the term; each parent once, at its first child."""
    cut = lambda c, n: F.transform(F.filter(F.sequence(F.lit(0), F.ceil(F.length(c) / n).cast("int")), lambda i: i * n < F.length(c)), lambda i: F.substring(c, i * n + 1, F.lit(n)))
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut(F.col("text"), 2000)).alias("parent", "body"))
    c = p.select("doc_id", F.col("parent").cast("long").alias("parent"), F.posexplode(cut(F.col("body"), 200)).alias("child", "t")).where(F.contains(F.lower("t"), F.lit("license")))
    return c.groupBy("doc_id", "parent").agg(F.min("child").cast("long").alias("first_child"), F.count("*").alias("hits"))


AS_OF = "2024-01-20 12:00:00"


@query(" UNION ALL ".join(f"SELECT {h} AS hours, {limit} AS quota, {str(per).lower()} AS per_user, {'user_id' if per else 'NULL::BIGINT'} AS user_id, count(*) AS used, count(*) >= {limit} AS refused, CASE WHEN count(*) >= {limit} THEN CAST(floor(epoch(min(ts)) + {h * 3600} - epoch(TIMESTAMP '{AS_OF}')) AS BIGINT) END AS retry_after FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {h} HOUR AND ts <= TIMESTAMP '{AS_OF}' {'GROUP BY user_id' if per else 'HAVING count(*) > 0'}" for h, limit, per in LIMITS))
def request_usage(spark, sf_dir):
    """Requests in each rolling window that ends at AS_OF, a window's start included; how long to wait where its limit is reached."""
    now, out = F.lit(AS_OF).cast("timestamp_ntz"), None
    events = table(spark, sf_dir, "events")
    for hours, limit, per in LIMITS:
        rows = events.where((F.col("ts") >= now - F.expr(f"interval {hours} hours")) & (F.col("ts") <= now)).groupBy((F.col("user_id") if per else F.lit(None).cast("long")).alias("user_id"))
        used = rows.agg(F.count("*").alias("used"), F.min("ts").alias("oldest"))
        wait = F.floor(F.unix_micros(F.col("oldest").cast("timestamp")) / 1_000_000 + hours * 3600 - F.unix_micros(now.cast("timestamp")) / 1_000_000)
        part = used.select(F.lit(hours).alias("hours"), F.lit(limit).alias("quota"), F.lit(per).alias("per_user"), "user_id", "used", (F.col("used") >= limit).alias("refused"), F.when(F.col("used") >= limit, wait).alias("retry_after"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, list_filter([CASE WHEN doc_id IS NULL THEN 'doc_id_missing' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'text_missing' END, CASE WHEN length(source) NOT BETWEEN 1 AND 6 THEN 'source_length' END, CASE WHEN n_chars <> length(text) THEN 'n_chars_wrong' END], lambda x: x IS NOT NULL) AS violations FROM documents")
def validation(spark, sf_dir):
    """Violations of each row, none for a valid one."""
    rules = {"doc_id_missing": F.col("doc_id").isNull(), "text_missing": F.coalesce(F.trim("text"), F.lit("")) == "", "source_length": ~F.length("source").between(1, 6), "n_chars_wrong": F.col("n_chars") != F.length("text")}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items()))).alias("violations"))


@query("WITH s AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN (page_id % 11) / 10.0 END::DOUBLE AS score FROM pages) SELECT page_id, score, row_number() OVER (ORDER BY coalesce(score, -1) DESC, page_id) AS place FROM s WHERE score IS NULL OR score >= 0.5")
def discovery_ranking(spark, sf_dir):
    """Candidates whose score is unknown or at least 0.5, the best first. The order is total, so places are counted over one list of candidates."""
    s = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 != 0, (F.col("page_id") % 11) / 10.0).alias("score")).where("score is null or score >= 0.5")
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "page_id")).cast("long"))


@query("WITH todo AS (SELECT doc_id FROM documents) SELECT doc_id FROM todo ANTI JOIN labels USING (doc_id)")
def unanswered(spark, sf_dir):
    """What a resumed run has still to do."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT count(*) AS total FROM part WHERE p_retailprice >= 950 AND p_retailprice <= 1500 AND p_type = (SELECT min(p_type) FROM part)")
def catalogue_count(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = part.agg(F.min("p_type")).first()[0]
    shop = part.select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_type").alias("category"))
    return structured.answer(shop, structured.Filter.of({"op": "count", "price_min": "950", "price_max": 1500, "category": f" {kind} "}), "p_partkey")


@query("SELECT page_id, NOT contains(url, '/article') AND page_id % 3 <> 1 OR page_id % 3 = 2 AS allowed FROM pages")
def robots_decisions(spark, sf_dir):
    """A third of the hosts can't be read, a third have no file, a third forbid articles; the host here is the page's own."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://h"), "page_id", F.lit("/"), F.regexp_replace("url", "^https?://[^/]*/?", "")).alias("url"), F.col("page_id").cast("string").alias("host"), F.contains("url", F.lit("/article")).alias("article"))
    status = F.when(F.col("page_id") % 3 == 1, 503).when(F.col("page_id") % 3 == 2, 404).otherwise(200)
    files = p.select("host", status.alias("status"), F.when(F.col("article"), "User-agent: *\nDisallow: /").otherwise("User-agent: *\nDisallow:").alias("body"))
    return robots.decisions(p, files, "textloom").select("page_id", "allowed")


@query()
def page_markdown(spark, sf_dir):
    """Each page's article as Markdown, with counts of its structure, agreement of two extractors, link density, rules and date."""
    p = dom.with_page(table(spark, sf_dir, "pages"), F.col("html"), F.col("url"))
    p = p.select("page_id", "html", "page.*").withColumns({"chars": F.length("markdown").cast("long"), "link_density": dom.link_density(F.col("anchors"), tx.without_links(F.col("markdown")))})
    agreement = F.when(F.greatest("chars", "secondary_chars") > 0, F.round(F.least("chars", "secondary_chars") / F.greatest("chars", "secondary_chars"), 4)).otherwise(0.0)
    count = lambda r: F.regexp_count("markdown", F.lit(r)).cast("long")
    p = p.withColumns({"headings": count("(?m)^#{1,6} "), "items": count(r"(?m)^\s*(?:[-*+]|\d+\.) "), "agreement": agreement})
    p = pages.published(p, {"json_ld": F.col("json_ld"), "meta_article": F.col("meta"), "time_element": F.col("time"), "text_pattern": F.col("text")}, F.lit("2026-01-01").cast("timestamp"))
    return p.select("page_id", "title", F.sha2("markdown", 256).alias("hash"), "chars", "headings", "items", "link_density", "agreement", pages.failed_rules(F.col("chars"), F.col("link_density"), F.col("agreement"), F.col("secondary_chars")).alias("rules"), "published_at", "published_source", "paid", "password")


@query("SELECT page_id, substr(sha256(url), 1, 2) || '/' || sha256(url) || '.html' AS path FROM pages")
def cache_paths(spark, sf_dir):
    """Where a page's copy lies: by the hash of its URL, in a folder of the hash's first two digits."""
    key = F.sha2("url", 256)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.substring(key, 1, 2), F.lit("/"), key, F.lit(".html")).alias("path"))


@query("SELECT p_partkey, '[' || p_partkey || '] ' || p_name || ' - ' || CASE WHEN p_size % 5 = 0 THEN 'price unknown' ELSE printf('$%.2f', p_retailprice) END || CASE WHEN p_size % 3 = 0 THEN printf(' (rated %d)', p_size % 6) ELSE '' END AS line FROM part")
def rendered_products(spark, sf_dir):
    price = F.when(F.col("p_size") % 5 == 0, "price unknown").otherwise(F.format_string("$%.2f", "p_retailprice"))
    rating = F.when(F.col("p_size") % 3 == 0, F.format_string(" (rated %d)", F.col("p_size") % 6)).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.col("p_partkey").cast("string"), F.lit("] "), "p_name", F.lit(" - "), price, rating).alias("line"))


@query("""WITH d AS (SELECT conv_id, list_transform(list_filter(string_split(lower(arg_min(text, turn) FILTER (role = 'user')), ' '), lambda w: length(w) >= 6), lambda w: w) AS words, lower(arg_max(text, turn) FILTER (role = 'assistant')) AS reply, count(*) FILTER (role = 'assistant') AS calls, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id)
SELECT conv_id, calls, chars, coalesce(len(list_filter(words, lambda w: contains(reply, w))) > 0, false) AS recalled FROM d""")
def benchmark_replay(spark, sf_dir):
    """Of each conversation: calls, characters, and whether the last reply holds one of the first question's longer words."""
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.lower(F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn")))).alias("question"), F.lower(F.max_by(F.when(reply, F.col("text")), F.when(reply, F.col("turn")))).alias("reply"),
        F.count_if(reply).alias("calls"), F.sum(F.length("text")).cast("long").alias("chars"),
    )
    held = F.exists(F.filter(F.split("question", " "), lambda w: F.length(w) >= 6), lambda w: F.contains("reply", w))
    return d.select("conv_id", "calls", "chars", F.coalesce(held, F.lit(False)).alias("recalled"))


@query("SELECT user_id, round(epoch(min(ts) FILTER (event_type = 'click') - min(ts)), 3) AS first_s, round(epoch(max(ts) - min(ts)), 3) AS whole_s, count(*) / nullif(epoch(max(ts) - min(ts)), 0) * 3600 > 1 AS busy FROM events GROUP BY user_id")
def latencies(spark, sf_dir):
    """Seconds from a user's first event to the first click and to the last event, and whether there was more than one event an hour."""
    s = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1_000_000
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("c"), F.count("*").alias("n"))
    a, z, c = F.col("a"), F.col("z"), F.col("c")
    return e.select("user_id", F.round(s(c, a), 3).alias("first_s"), F.round(s(z, a), 3).alias("whole_s"), (F.try_divide(F.col("n"), s(z, a)) * 3600 > 1).alias("busy"))


@query("SELECT p.page_id, CASE WHEN p.page_id % 4 <> 0 THEN 'first' WHEN p.page_id % 8 <> 0 THEN 'second' END AS provider, CASE WHEN p.page_id % 4 <> 0 OR p.page_id % 8 <> 0 THEN CASE WHEN length(html) > 400 THEN left(html, 400) || '...' ELSE html END END AS snippet FROM pages p")
def provider_fallback(spark, sf_dir):
    """The first provider with a result for a page, and its snippet of at most 400 characters."""
    clip = lambda c: F.when(F.length(c) > 400, F.concat(F.left(c, F.lit(400)), F.lit("..."))).otherwise(c)
    p = table(spark, sf_dir, "pages")
    found = [F.when(cond, F.struct(F.lit(name).alias("provider"), clip(F.col("html")).alias("snippet"))) for name, cond in (("first", F.col("page_id") % 4 != 0), ("second", F.col("page_id") % 8 != 0))]
    return p.withColumn("f", F.coalesce(*found)).select("page_id", "f.provider", "f.snippet")


@query()
def fixed_size_pieces(spark, sf_dir):
    return splitting.split(table(spark, sf_dir, "documents"), "doc_id", "text", 800, 80)
