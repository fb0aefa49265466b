"""URL column functions (all JVM-side expressions, no UDFs).

Semantics follow the standard-library URL split: the network location is the part after
`scheme://` (or a leading `//`) up to the first `/`, `?` or `#`; the host is what lies after
the last `@` and before the first `:`, lower-cased. A URL without a network location is tried
again as `http://` + url; when that also yields nothing the result is null (the caller may
quarantine such rows instead of failing the job).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NETLOC_WITH_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_NETLOC_BARE = r"^([^/?#]*)"


def _host_of_netloc(netloc: Column) -> Column:
    after_at = F.regexp_extract(netloc, r"([^@]*)$", 1)
    host = F.regexp_extract(after_at, r"^([^:]*)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def url_host(url: Column) -> Column:
    first = _host_of_netloc(F.regexp_extract(url, _NETLOC_WITH_SCHEME, 1))
    second = _host_of_netloc(F.regexp_extract(url, _NETLOC_BARE, 1))
    return F.coalesce(first, second)


def url_tld(url: Column) -> Column:
    host = url_host(url)
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def last_two_labels(url: Column) -> Column:
    """The commented-out second-level-domain reduction: `a.b.example.com` -> `example.com`."""
    host = url_host(url)
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -2))


def ensure_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url) \
        .otherwise(F.concat(F.lit("http://"), url))


def obs_time(hhmm: Column, ingested_at: Column) -> Column:
    """'HH:MM' of a listing attached to the ingestion date; a time later than the ingestion
    instant belongs to the day before."""
    ing = ingested_at.cast("timestamp_ntz")  # wall-clock arithmetic: independent of the session zone
    same_day = F.to_timestamp_ntz(F.concat(F.date_format(ing, "yyyy-MM-dd"), F.lit(" "), hhmm),
                                  F.lit("yyyy-MM-dd HH:mm"))
    return F.when(same_day > ing, same_day - F.expr("INTERVAL 1 DAY")).otherwise(same_day)


def media_identity(url: Column) -> Column:
    """Embedded media are identified by their URL without the query string."""
    return F.substring_index(url, "?", 1)
