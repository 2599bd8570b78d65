"""The page that an address leads to, as a Column (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that do not choose the page.
TRACKING = r"utm_[a-z]+|fbclid|gclid|msclkid|sessao|session|sessionid|sid|phpsessid|origem|origin|ref|referrer|src"


def _stripped(url: Column) -> Column:
    """The address without what does not choose the page; every step is used once."""
    u = F.regexp_replace(url, r"^[\s\u00a0]*(?:[hH][tT][tT][pP][sS]?:)?/*(?:[wW]{3}\.)?|[\s\u00a0]+|#.*$", "")
    u = F.regexp_replace(u, rf"(?<=[?&;])(?:{TRACKING})(?:=[^&;]*)?(?:[&;]|$)", "")
    u = F.regexp_replace(u, r"^([^/?:]+):(?:80|443)?(?=[/?]|$)", "$1")
    return F.regexp_replace(u, r"/+(?=[/?]|$)|[?&;]+$", "")


def _ordered(u: Column) -> Column:
    base = F.substring_index(u, "?", 1)
    host = F.substring_index(base, "/", 1)
    query = F.array_join(F.sort_array(F.split(F.substr(u, F.length(base) + 2), "[&;]")), "&")
    return F.rtrim(F.concat(F.lower(host), F.substr(base, F.length(host) + 1), F.lit("?"), query), F.lit("?"))


def page_key(url: Column) -> Column:
    """One key for all ways of writing an address: no scheme, ``www.``, default port, fragment, tracking parameters,
    doubled or trailing slashes; host in lower case. Null for null or blank addresses."""
    return F.nullif(_ordered(_stripped(url)), F.lit(""))


def with_page_key(df: DataFrame, out: str, url: str = "url_anuncio") -> DataFrame:
    """``df`` with the page key, rows without an address left out. In two projections, so that the costly step runs once a row."""
    return df.filter(F.col(url).rlike(r"[^\s\u00a0/#?]")).withColumn("_endereco", _stripped(F.col(url))).withColumn(out, _ordered(F.col("_endereco"))).drop("_endereco")
