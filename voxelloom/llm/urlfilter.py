"""URL filters as of the time of the fetch, with DataFrame functions alone.

A list is a table of dated entries: at some time a host, a domain with all its
subdomains, or a URL prefix is added with an action, or removed. An entry is
valid from its time until the next entry of the same key. A capture is held
against the entries that are valid when it was fetched: its URL is turned into
the keys that could match (the host, each domain above it, each path prefix),
and these are joined to the intervals by equality of the key, so a hot host
makes no cross product and a large list is never scanned for each capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shield

#: Kinds of entries by rank: where several are valid the highest rank decides, then the longest value, then the latest.
RANK = {"prefix": 3, "host": 2, "domain": 1}

# A small list in the form of production lists (kind, value, change, action, day).
LIST = [
    ("domain", "spam-farm.example.org", "add", "block", "2024-01-15"),
    ("domain", "spam-farm.example.org", "remove", "block", "2024-09-01"),
    ("domain", "spam-farm.example.org", "add", "block", "2025-02-01"),
    ("domain", "cheap-pills.example.com", "add", "block", "2024-03-10"),
    ("host", "www.cheap-pills.example.com", "add", "allow", "2025-01-05"),
    ("domain", "example.net", "add", "block", "2024-06-01"),
    ("domain", "example.net", "remove", "block", "2024-07-15"),
    ("host", "ththan.example.net", "add", "allow", "2024-06-10"),
    ("prefix", "tionsh.example.net/en", "add", "block", "2024-11-01"),
    ("prefix", "tionsh.example.net/en", "remove", "block", "2025-05-01"),
    ("domain", "tiontion.example.net", "add", "block", "2024-02-02"),
    ("prefix", "blog.tionsh.example.com/fr", "add", "block", "2024-04-01"),
    ("prefix", "blog.tionsh.example.com/fr", "add", "allow", "2024-10-01"),
    ("domain", "blog.tionble.example.com", "add", "block", "2025-03-01"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without user, port and last dot) and path (without query and fragment) of a URL; null where there is no host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(host != "", host), path


def keys(host: Column, path: Column) -> Column:
    """All entry keys that a URL could match, as kind:value."""
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda i: F.concat(F.lit("prefix:"), host, F.when(i > 0, F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))).otherwise("")),
    )
    return F.when(host.isNotNull(), F.concat(F.array(F.concat(F.lit("host:"), host)), domains, F.array_distinct(prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, kind, value, action, entry_id, valid_from, valid_to) of every entry that adds.

    entries: entry_id, kind, value, change (add or remove), action, at. Of
    entries of a key at the same time that with the largest entry_id holds;
    entries with a null among these are passed over. valid_to is null while
    nothing has followed.
    """
    whole = entries.select("entry_id", "kind", F.lower("value").alias("value"), "change", "action", "at").dropna()
    last = whole.groupBy("kind", "value", "at").agg(F.max(F.struct("entry_id", "change", "action")).alias("e"))
    order = Window.partitionBy("kind", "value").orderBy("at")
    return (
        last.withColumn("valid_to", F.lead("at").over(order))
        .filter("e.change = 'add'")
        .select(
            F.concat_ws(":", "kind", "value").alias("key"),
            "kind",
            "value",
            F.col("e.action").alias("action"),
            F.col("e.entry_id").alias("entry_id"),
            F.col("at").alias("valid_from"),
            "valid_to",
        )
    )


def apply_lists(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds host, n_active (valid entries that match), verdict (block, allow or none) and entry_id (of the entry that decides).

    captures: url and fetched, and any other columns. A URL without a host, a
    null URL or a null time matches nothing. Every row gets its own result,
    repeated rows too; columns of the names above are replaced.
    """
    made = ("host", "n_active", "verdict", "entry_id")
    safe, back = shield(captures.drop(*[c for c in captures.columns if c.lower() in made]), ["_path", "_key", "_entry", "_best", "_n", "_url", "_at"])
    host, path = url_parts(F.col("url"))
    rows = safe.withColumn("host", host)
    # A verdict is of a URL and a time, however many captures there are; only these go to the keys.
    places = rows.filter("host IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched").distinct()
    places = places.withColumn("host", host).withColumn("_path", path)
    dealt = places.select(F.col("url").alias("_url"), F.col("fetched").alias("_at"), F.explode(keys(F.col("host"), F.col("_path"))).alias("_key"))
    list_ = intervals(entries)
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in RANK.items()], F.lit(0))
    strength = F.struct(rank.alias("rank"), F.length("value").alias("length"), F.col("valid_from"), F.col("entry_id").alias("entry_id"), F.col("action").alias("action"))
    list_ = list_.select(F.col("key").alias("_key"), "valid_from", "valid_to", strength.alias("_entry"))
    asof = (dealt["_key"] == list_["_key"]) & (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    found = dealt.join(list_, asof).groupBy("_url", "_at").agg(F.count("*").alias("_n"), F.max("_entry").alias("_best"))
    # A key that no entry has leaves no row, so what comes back to the captures is matches alone.
    told = rows.join(found, (rows["url"] == found["_url"]) & (rows["fetched"] == found["_at"]), "left")
    return told.select(
        *back,
        "host",
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("_best.action", F.lit("none")).alias("verdict"),
        F.col("_best.entry_id").alias("entry_id"),
    )


def sample_list(spark: SparkSession, hosts: DataFrame) -> DataFrame:
    """The fixed list, and for hosts whose name's length is a multiple of three entries that come and go."""
    rows = [(k + 1, *r) for k, r in enumerate(LIST)]
    fixed = spark.createDataFrame(rows, "entry_id long, kind string, value string, change string, action string, day string")
    fixed = fixed.select("entry_id", "kind", "value", "change", "action", F.to_timestamp("day").alias("at"))
    some = hosts.filter(F.length("host") % 3 == 0)
    at = lambda days: F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")))
    n = F.length("host")
    turns = F.explode(F.array(*[F.struct(F.lit(c).alias("change"), at(n * k).alias("at"), F.lit(i).alias("i")) for i, (c, k) in enumerate((("add", 5), ("remove", 13), ("add", 21)))]))
    derived = some.select("host", turns.alias("t")).select(
        (F.lit(1000) + F.length("host") * 3 + F.col("t.i")).cast("long").alias("entry_id"), F.lit("host").alias("kind"), F.col("host").alias("value"), "t.change", F.lit("block").alias("action"), "t.at"
    )
    return fixed.unionByName(derived)


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures; as the table has no time of fetching, one is derived from page_id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(731)).cast("int"))
    fetched = F.to_timestamp(day) + F.make_dt_interval(F.lit(0), F.pmod("page_id", F.lit(24)).cast("int"))
    return pages.select("page_id", "url", fetched.alias("fetched"))


def report(pages: DataFrame) -> DataFrame:
    captures = captures_of(pages)
    hosts = captures.select(url_parts(F.col("url"))[0].alias("host")).filter("host IS NOT NULL").distinct()
    found = apply_lists(captures, sample_list(pages.sparkSession, hosts))
    return found.select("page_id", "url", "host", "n_active", "verdict", F.coalesce("entry_id", F.lit(0)).alias("entry_id"))


def oracle() -> str:
    values = ", ".join(f"({k + 1}, '{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}', TIMESTAMP '{r[4]}')" for k, r in enumerate(LIST))
    return f"""
        WITH c AS (
            SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 37) % 731 AS INTEGER)) + to_hours(page_id % 24) AS fetched,
                   nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.$', ''), '') AS host,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
            FROM pages),
        h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL AND length(host) % 3 = 0),
        e AS (
            SELECT * FROM (VALUES {values}) AS t(entry_id, kind, value, change, action, since)
            UNION ALL
            SELECT 1000 + length(host) * 3 + i, 'host', host, change, 'block', TIMESTAMP '2024-01-01' + to_days(CAST(length(host) * k AS INTEGER))
            FROM h, (VALUES (0, 'add', 5), (1, 'remove', 13), (2, 'add', 21)) AS s(i, change, k)),
        v AS (SELECT *, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS until FROM e),
        m AS (
            SELECT page_id, entry_id, action, row_number() OVER (PARTITION BY page_id ORDER BY
                   CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(value) DESC, since DESC, entry_id DESC) AS k,
                   count(*) OVER (PARTITION BY page_id) AS n
            FROM c JOIN v ON change = 'add' AND fetched >= since AND (until IS NULL OR fetched < until) AND (
                 kind = 'host' AND host = value OR kind = 'domain' AND (host = value OR ends_with(host, '.' || value))
                 OR kind = 'prefix' AND (host || rtrim(path, '/') = value OR starts_with(host || path, value || '/'))))
        SELECT c.page_id, url, host, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(action, 'none') AS verdict, CAST(coalesce(entry_id, 0) AS BIGINT) AS entry_id
        FROM c LEFT JOIN m ON c.page_id = m.page_id AND k = 1"""
