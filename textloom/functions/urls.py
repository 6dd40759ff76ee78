"""Canonical URLs by built-in expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.fixed import TRACKING, TRACKING_STARTS

#: Hosts are checked in their ASCII form; the last label has letters only.
HOST = r"^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"


def with_canonical(df: DataFrame, url: Column) -> DataFrame:
    """df with canonical (null if the URL can't be one) and host.

    Wrapping marks and trailing punctuation go, a missing scheme is added, http becomes https, the host is lower case without outer dots,
    the scheme's port goes, slashes in the path collapse, tracking parameters and fragments that don't route go; credentials, other
    schemes, ports outside 1 to 65535 and hosts without a top-level domain of letters are refused. International hosts take their ASCII form.
    """
    raw = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[<>\"'`()\[\]]+|[<>\"'`()\[\].,;:!?]+$", ""), r"\s+", "")
    raw = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    part = lambda i: F.regexp_extract("__raw", r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", i)
    out = df.withColumn("__raw", raw).withColumns({"__scheme": F.lower(part(1)), "__at": part(2), "__path": part(3), "__query": F.substring(part(4), 2, 1_000_000), "__fragment": F.substring(part(5), 2, 1_000_000)})
    named, port = F.regexp_replace(F.lower(F.regexp_extract("__at", r"^([^:]*)", 1)), r"^\.+|\.+$", ""), F.regexp_extract("__at", r"^[^:]*:(.*)$", 1)
    ascii_form = F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), named))
    host = F.when(named.rlike(r"[^\x00-\x7F]"), F.coalesce(ascii_form, F.lit(""))).otherwise(named)
    number = F.when(port.rlike("^[0-9]{1,9}$"), port.cast("int"))
    path = F.regexp_replace(F.regexp_replace("__path", "/+", "/"), "(?<=.)/+$", "")
    name = lambda p: F.lower(F.split(p, "=")[0])
    own = F.filter(F.split("__query", "&"), lambda p: (p != "") & ~name(p).isin(TRACKING) & ~F.exists(F.array(*map(F.lit, TRACKING_STARTS)), lambda s: F.startswith(name(p), s)))
    query = F.array_join(F.transform(own, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    good = F.col("__scheme").isin("http", "https") & ~F.contains("__at", F.lit("@")) & host.rlike(HOST) & ((port == "") | F.coalesce(number.between(1, 65535), F.lit(False)))
    canonical = F.concat(
        F.lit("https://"), host, F.when((port != "") & (port != "443"), F.concat(F.lit(":"), port)).otherwise(""), F.when(path == "", "/").otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(F.col("__fragment").rlike("^!?/"), F.concat(F.lit("#"), F.col("__fragment"))).otherwise(""),
    )
    return out.withColumns({"canonical": F.when(good, canonical), "host": F.when(good, host)}).drop("__raw", "__scheme", "__at", "__path", "__query", "__fragment")
