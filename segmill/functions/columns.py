"""Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any kind, as a class for regular expressions (fixed values: the characters that Unicode and ASCII call space).
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text has one of the phrases; false for a null text."""
    low = F.lower(text)
    return F.coalesce(reduce(Column.__or__, (low.contains(p) for p in phrases), F.lit(False)), F.lit(False))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, cut off."""
    return (seconds * 1000).cast("bigint")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def clean_name(path: Column) -> Column:
    """The path with _clean before its extension; leading dots of the name start no extension."""
    extension = F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]*)$", 1)
    return F.concat(F.substr(path, F.lit(1), F.length(path) - F.length(extension)), F.lit("_clean"), extension)


def key_of_path(path: Column) -> Column:
    return F.concat(F.lit("podcasts/original/"), base_name(path))


def key_of_url(url: Column) -> Column:
    return F.concat(F.lit("podcasts/"), F.md5(url))


def content_type(path: Column) -> Column:
    return F.when(path.endswith(".mp3"), "audio/mpeg").when(path.endswith(".wav"), "audio/wav").otherwise("application/octet-stream")


def query_value(target: Column, name: str) -> Column:
    """First value of a parameter in a request target, decoded; null if it is missing or blank."""
    query = F.regexp_extract(target, r"^[^?#]*\?([^#]*)", 1)
    value = F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1)
    return F.nullif(F.try_url_decode(value), F.lit(""))


def route(target: Column) -> Column:
    """The name of the route of a request target; null if there is none."""
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    return F.when(path == "/process", "process").when(path == "/rss", "rss").when(path == "/status", "status").when(path.startswith("/download/"), "download")


def process_url(base: str, url: Column) -> Column:
    """The URL under which an episode is processed. The episode's URL isn't encoded, so what follows its first & is lost
    when the parameter is read; feeds in use depend on this form."""
    return F.concat(F.lit(f"{base}/process?url="), url)


def iso_time(text: Column) -> Column:
    """The time that an ISO 8601 text says; null if it is none. Without an offset it is in the session's time zone."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d([.,]\d{1,6})?)?(Z|[+-]\d\d:?\d\d)?)?$"), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))


def iso_text(time: Column) -> Column:
    """ISO 8601 with microseconds where there are any, without an offset."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(time, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def xml_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attribute(text: Column) -> Column:
    return F.replace(xml_text(text), F.lit('"'), F.lit("&quot;"))
