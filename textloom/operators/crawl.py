"""The crawl's outcome per page as one plan: each page ends at the first stage that stops it, in a fixed order of stages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.fixed import STATUS_GROUPS, STATUS_MESSAGES
from textloom.functions.urls import with_canonical
from textloom.operators import dedupe, pages


def detail(rules: Column, said: Column) -> Column:
    """[rule, rule] and what else is said; null of neither."""
    listed = F.when(F.size(rules) > 0, F.concat(F.lit("["), F.array_join(rules, ", "), F.lit("]")))
    return F.nullif(F.concat_ws(" ", listed, said), F.lit(""))


def rules_of(detail: Column) -> Column:
    """The rules that a detail lists."""
    listed = F.regexp_extract(F.coalesce(detail, F.lit("")), r"^\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(listed, ","), lambda r: F.trim(r)), lambda r: r != "")


def message(status: Column, detail: Column) -> Column:
    """What a status says, with the detail in brackets; an unknown status says itself."""
    known = F.create_map(*(F.lit(x) for pair in STATUS_MESSAGES.items() for x in pair))
    base = F.coalesce(F.try_element_at(known, status), status)
    return F.when(F.coalesce(detail, F.lit("")) != "", F.concat(base, F.lit(" ("), detail, F.lit(")"))).otherwise(base)


def outcomes(landing: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Of (id, url, allowed, within_limit, http_status, error, html, pushed): (id, canonical, host, status, detail, message, duplicate_of, similarity).

    In order: a URL that can't be one, a canonical URL that an earlier id has (whatever became of that), robots rules, rate limits, no page
    at all, walls, an error in spite of a page, no text, failed quality rules, the text of an earlier stored page, a text near an earlier stored
    one (the nearest, of equals the first), what the store answered (pushed: null, duplicate or rejected), stored. Ids are unique and not null. Needs a
    checkpoint folder.
    """
    base = with_canonical(landing, F.col("url"))
    seen = base.where("canonical is not null").groupBy("canonical").agg(F.min("id").alias("first"))
    text = tx.normalised(pages.visible(F.coalesce("html", F.lit(""))))
    base = base.join(seen, "canonical", "left").withColumn("text", text).withColumn("chars", F.length("text"))
    density = pages.density(pages.link_text(F.coalesce("html", F.lit(""))), F.col("text"))
    base = base.withColumn("rules", pages.failed_rules(F.col("chars"), density, F.lit(1.0), F.col("chars"))).withColumn("wall", pages.wall(F.coalesce("html", F.lit("")), F.col("http_status"), F.col("chars")))
    failed = F.col("error").isNotNull() | (F.col("http_status") >= 400)
    blank = F.coalesce("html", F.lit("")) == ""
    early = (
        F.when(F.col("canonical").isNull(), "invalid_url").when(F.col("id") > F.col("first"), "duplicate_url").when(~F.col("allowed"), "robots_disallowed").when(~F.col("within_limit"), "rate_limited")
        .when(failed & blank, "fetch_failed").when(F.col("wall").isNotNull() & ~blank, F.col("wall")).when(failed, "fetch_failed").when(F.col("chars") == 0, "extraction_failed").when(F.size("rules") > 0, "junk")
    )
    rules = F.when(early.isin("junk", "extraction_failed"), F.when(F.col("chars") == 0, F.array(F.lit("no_text_extracted"))).otherwise(F.col("rules"))).otherwise(F.array().cast("array<string>"))
    base = base.select("id", "canonical", "host", "pushed", early.alias("early"), detail(rules, F.when(early == "fetch_failed", F.col("error"))).alias("detail"), "first", F.when(early.isNull(), F.col("text")).alias("text"), F.sha2("text", 256).alias("hash")).checkpoint()
    kept = base.where("early is null")
    firsts = kept.groupBy("hash").agg(F.min("id").alias("rep"))
    reps = kept.join(firsts.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "text")
    sets = dedupe.shingle_sets(reps, "id", F.col("text"))
    pairs, same = dedupe.similar_pairs(sets, threshold).checkpoint(), dedupe.copies(sets)
    decided = dedupe.resolve_all(reps, "id", pairs, same).join(same, "id", "left").select("id", "kept", F.coalesce("representative", "id").alias("set")).checkpoint()
    stored = decided.where("kept").select(F.col("id").alias("a"))
    near = pairs.join(stored, "a").groupBy(F.col("b").alias("set")).agg(F.max_by("a", F.struct("similarity", -F.col("a"))).alias("near_id"), F.max("similarity").alias("near"))
    of_set = decided.join(stored.withColumnRenamed("a", "set").withColumn("whole", F.lit(True)), "set", "left").join(near, "set", "left")
    of_set = of_set.select(F.col("id").alias("rep"), "kept", F.when(F.col("whole"), F.col("set")).otherwise(F.col("near_id")).alias("near_id"), F.when(F.col("whole"), 1.0).otherwise(F.col("near")).alias("near"))
    late = firsts.join(of_set, "rep")
    out = base.join(late, "hash", "left")
    ended = F.coalesce("early", F.when(~F.col("kept"), "duplicate_near").when(F.col("id") > F.col("rep"), "duplicate_content").when(F.col("pushed") == "duplicate", "duplicate_url").when(F.col("pushed") == "rejected", "api_rejected").otherwise("stored"))
    out = out.withColumn("status", ended)
    to = F.when(F.col("early") == "duplicate_url", F.col("first")).when(F.col("status") == "duplicate_content", F.col("rep")).when(F.col("status") == "duplicate_near", F.col("near_id"))
    similarity = F.when(F.col("status") == "duplicate_content", 1.0).when(F.col("status") == "duplicate_near", F.round("near", 6))
    return out.select("id", "canonical", "host", "status", "detail", message(F.col("status"), F.col("detail")).alias("message"), to.alias("duplicate_of"), similarity.alias("similarity"))


def report(found: DataFrame) -> DataFrame:
    """(status, status_group, n, pct) of outcomes: every status, zero where none ended so; pct of all pages."""
    dim = found.sparkSession.createDataFrame(list(STATUS_GROUPS.items()), "status string, status_group string")
    counts = found.groupBy("status").agg(F.count("*").alias("c"))
    wide = dim.join(counts, "status", "full").select("status", "status_group", F.coalesce("c", F.lit(0)).alias("n"))
    whole = wide.agg(F.sum("n").alias("whole"))
    return wide.crossJoin(F.broadcast(whole)).select("status", "status_group", "n", tx.percent(F.col("n"), F.col("whole")).alias("pct"))  # one row is sent


def provenance(found: DataFrame) -> DataFrame:
    """Of (id, status, published_source, published_raw): (source, n) over stored pages: by the rung that gave the date, unparseable where only a raw date is there, none."""
    source = F.coalesce("published_source", F.when(F.col("published_raw").isNotNull(), "unparseable").otherwise("none"))
    return found.where("status = 'stored'").groupBy(source.alias("source")).agg(F.count("*").alias("n"))
