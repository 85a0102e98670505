"""URL filter by a dated list: entries become validity intervals, captures are joined as of their fetch time.

An entry says that from its date on a pattern is on the list, or is off it again.
Patterns are hosts, domains with all that is below them, and URL prefixes by whole
path segments. A capture's host, parent domains and path prefixes are its keys; it
is blocked if one of them has an interval that holds its fetch time. Captures are
reduced to distinct (url, time) first. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BROADCAST = 200_000  # intervals; beyond, the join is shuffled with salted keys
SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, valid_from, valid_to) from (kind, value, listed, dated).

    An entry that lists a pattern holds from its date to that of the pattern's next
    entry, whatever this says; valid_to is null if there is none. Of several entries
    on one date, one that takes the pattern off the list wins. Entries with a null
    in kind, value, listed or dated say nothing; values are lower-cased.
    """
    sound = entries.select("kind", F.lower("value").alias("value"), "listed", "dated").dropna()
    daily = sound.groupBy("kind", "value", "dated").agg(F.min("listed").alias("listed"))
    following = Window.partitionBy("kind", "value").orderBy("dated")
    return daily.withColumn("valid_to", F.lead("dated").over(following)).where("listed").select("kind", "value", F.col("dated").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked, n_entries and rule for every row.

    n_entries counts the intervals that hold at the fetch time, rule is the first of
    them as kind:value, null if none. A null or malformed url, and a null time, is
    not blocked. Columns of ``captures`` with the names of the new ones are replaced.
    """
    intervals = validity_intervals(entries)
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).dropna().distinct()
    labels = F.split("_host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    parts = F.split("_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat("_host", F.array_join(F.slice(parts, 1, i), "/")))
    keyed = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    keys = F.concat(keyed("host", F.array("_host")), keyed("domain", domains), keyed("prefix", F.filter(prefixes, lambda v: v != F.col("_host"))))
    probes = asked.withColumn("_host", host_of(F.col("_url"))).where("_host <> ''").withColumn("_path", F.regexp_extract("_url", PATH, 1)).select("_url", "_at", F.explode(keys).alias("k")).select("_url", "_at", "k.kind", F.col("k.value").alias("value"))
    if intervals.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        matched = probes.join(F.broadcast(intervals), ["kind", "value"])
    else:  # a host may hold a third of all captures: its key is dealt over salts
        salted = intervals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = probes.withColumn("salt", F.pmod(F.xxhash64("_url", "_at"), F.lit(SALTS)).cast("int")).join(salted, ["kind", "value", "salt"])
    active = matched.where("_at >= valid_from and (valid_to is null or _at < valid_to)")
    verdict = active.groupBy("_url", "_at").agg(F.count("*").alias("n_entries"), F.min(F.concat("kind", F.lit(":"), "value")).alias("rule"))
    kept = captures.drop("blocked", "n_entries", "rule")
    out = kept.join(verdict, (kept[url] == verdict["_url"]) & (kept[fetched] == verdict["_at"]), "left")
    return out.select(*[kept[c] for c in kept.columns], F.coalesce(F.col("n_entries") > 0, F.lit(False)).alias("blocked"), F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), "rule")


def _digit(value: Column, k: int) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(value.cast("binary")), k, 1)) - 1


def example_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``, drawn by digits of their MD5: the
    testdata have none. Hosts, parents of hosts with four labels or more, and
    sections of a host come on the list at some day of 2024, may go, and may return.
    """
    hosts = pages.select(host_of(F.col("url")).alias("h")).where("h <> ''").distinct()
    parents = hosts.where(F.size(F.split("h", r"\.")) >= 4).select(F.regexp_replace("h", r"^[^.]+\.", "").alias("h")).distinct()
    patterns = hosts.where(_digit(F.col("h"), 1) < 6).select(F.lit("host").alias("kind"), F.col("h").alias("value"))
    patterns = patterns.union(parents.where(_digit(F.col("h"), 1) < 4).select(F.lit("domain"), "h"))
    patterns = patterns.union(hosts.where(_digit(F.col("h"), 1) >= 12).select(F.lit("prefix"), F.concat("h", F.lit("/en"))))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    a, b, c = (_digit(F.col("value"), k) for k in (2, 3, 4))
    step = lambda listed, n: F.struct(F.lit(listed).alias("listed"), day(n).alias("dated"))
    steps = F.array(step(True, a * 10), step(False, a * 10 + 20 + b * 5), step(True, a * 10 + 120 + c * 5))
    return patterns.select("kind", "value", F.explode(F.when(b < 4, F.slice(steps, 1, 1)).when(c < 8, F.slice(steps, 1, 2)).otherwise(steps)).alias("s")).select("kind", "value", "s.listed", "s.dated")


def example_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch date, which the testdata lack: a day of 2024 by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_at"))


ORACLE = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched_at,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages),
hosts AS (SELECT DISTINCT h FROM c WHERE h <> ''),
parents AS (SELECT DISTINCT regexp_replace(h, '^[^.]+\.', '') AS h FROM hosts WHERE len(string_split(h, '.')) >= 4),
pat AS (SELECT 'host' AS kind, h AS value FROM hosts WHERE instr('0123456789abcdef', substr(md5(h), 1, 1)) - 1 < 6
  UNION ALL SELECT 'domain', h FROM parents WHERE instr('0123456789abcdef', substr(md5(h), 1, 1)) - 1 < 4
  UNION ALL SELECT 'prefix', h || '/en' FROM hosts WHERE instr('0123456789abcdef', substr(md5(h), 1, 1)) - 1 >= 12),
d AS (SELECT kind, value, instr('0123456789abcdef', substr(md5(value), 2, 1)) - 1 AS a, instr('0123456789abcdef', substr(md5(value), 3, 1)) - 1 AS b, instr('0123456789abcdef', substr(md5(value), 4, 1)) - 1 AS c FROM pat),
e AS (SELECT kind, value, true AS listed, DATE '2024-01-01' + (a * 10)::INT AS dated FROM d
  UNION ALL SELECT kind, value, false, DATE '2024-01-01' + (a * 10 + 20 + b * 5)::INT FROM d WHERE b >= 4
  UNION ALL SELECT kind, value, true, DATE '2024-01-01' + (a * 10 + 120 + c * 5)::INT FROM d WHERE b >= 4 AND c >= 8),
g AS (SELECT kind, value, dated, bool_and(listed) AS listed FROM e GROUP BY ALL),
i AS (SELECT * FROM (SELECT *, lead(dated) OVER (PARTITION BY kind, value ORDER BY dated) AS valid_to FROM g) WHERE listed),
k AS (SELECT page_id, url, fetched_at, 'host' AS kind, h AS value FROM c WHERE h <> ''
  UNION ALL SELECT page_id, url, fetched_at, 'domain', unnest(list_transform(range(1, len(string_split(h, '.')) + 1), lambda x: array_to_string(string_split(h, '.')[x:], '.'))) FROM c WHERE h <> ''
  UNION ALL SELECT page_id, url, fetched_at, 'prefix', unnest(list_filter(list_transform(range(1, len(string_split(p, '/')) + 1), lambda x: h || array_to_string(string_split(p, '/')[:x], '/')), lambda v: v <> h)) FROM c WHERE h <> ''),
m AS (SELECT k.page_id, k.kind || ':' || k.value AS rule FROM k JOIN i ON k.kind = i.kind AND k.value = i.value AND k.fetched_at >= i.dated AND (i.valid_to IS NULL OR k.fetched_at < i.valid_to))
SELECT c.page_id, c.url, CAST(c.fetched_at AS DATE) AS fetched_at, count(m.rule) > 0 AS blocked, count(m.rule) AS n_entries, min(m.rule) AS rule
FROM c LEFT JOIN m ON m.page_id = c.page_id GROUP BY c.page_id, c.url, c.fetched_at"""
