"""Not-modified revisits of a web archive, resolved to the responses that they confirm.

A capture is a row (record_id, url, ts in seconds, kind, headers, payload_id, payload_digest); kind is
``response`` (a full answer) or ``revisit`` (304 Not Modified, no body). A revisit takes the body of the
latest strictly earlier response of the same canonical URL - an as-of join - if its validators agree:

* it has an ETag: the response's must be equal in weak comparison (``W/`` ignored);
* else it has a Last-Modified: the response's must be equal;
* it has neither: accepted, marked unchecked.

The resolved record has the response's headers, replaced by those of the revisit that a 304 may update
(:data:`PERMITTED`); all others of the revisit are ignored.

The as-of join runs in two steps so that no URL is gathered in one task: inside each (URL, time slice)
a window carries the last response forward; across slices only the last response of each slice is
carried on. Slim rows only: bodies stay where they are and are fetched by ``payload_id`` when wanted.

Null and empty URLs match nothing; null timestamps come before all others; responses of one URL and second are
taken in order of record_id, and a revisit in the same second does not see them; header names are
compared in lower case, the last of repeated ones counts; null headers are none. Repeated rows are
resolved each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 may update (the ones a server must send with it).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not change the page.
TRACKING = "^(utm_[a-z]+|fbclid|gclid|ref|sessionid)="
SLICE_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """host[:port]/path[?query]: no scheme, user, www, default port of the scheme, fragment, tracking
    parameters or closing slash; the host in lower case, parameters in order. A URL without ``scheme://`` is
    taken as it is; an empty one is null."""
    plain = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)", 1)), "^www[0-9]*\\.", "")
    port = F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*:([0-9]+)", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(plain, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    built = F.concat(
        host,
        F.when(usual, "").otherwise(F.concat(F.lit(":"), port)),
        path,
        F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""),
    )
    return F.nullif(F.when(scheme != "", built).otherwise(url), F.lit(""))


def lower_names(headers: Column) -> Column:
    """The map with lower-case names; the last of names that differ in case counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def merged(stored: Column, fresh: Column) -> Column:
    """``stored`` updated by the permitted headers of ``fresh``."""
    update = F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def resolve(captures: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Every capture with canonical_url, outcome (full, resolved, unchecked, validator_mismatch,
    no_earlier_response), response_id, payload_id, payload_digest and its effective headers."""
    rows = captures.select(
        "record_id",
        canonical_url(F.col("url").cast("string")).alias("canonical_url"),
        F.col("ts").cast("bigint").alias("ts"),
        "kind",
        lower_names(F.col("headers")).alias("headers"),
        "payload_id",
        "payload_digest",
    ).withColumn("slice", F.floor(F.coalesce("ts", F.lit(-(2**40))) / slice_seconds))
    is_full = F.col("kind") == "response"
    full = F.struct("ts", "record_id", "payload_id", "payload_digest", "headers")
    inside = Window.partitionBy("canonical_url", "slice").orderBy(F.col("ts").asc_nulls_first(), F.when(is_full, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("canonical_url").isNotNull()
    # Rows without a URL match nothing: they go round the window, which would put them into one task.
    local = rows.where(known).withColumn("here", F.last(F.when(is_full, full), ignorenulls=True).over(inside))
    ends = rows.where(is_full & known).groupBy("canonical_url", "slice").agg(F.max_by(full, F.struct("ts", "record_id")).alias("end"))
    # Slices that have revisits but no response need the carried one too.
    asked = rows.where(known).select("canonical_url", "slice").distinct().join(ends, ["canonical_url", "slice"], "left")
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.select("canonical_url", "slice", F.last("end", ignorenulls=True).over(before).alias("carried"))
    both = local.join(carried, ["canonical_url", "slice"], "left").withColumn("found", F.coalesce("here", "carried")).unionByName(rows.where(~known), allowMissingColumns=True)
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    own, kept = F.col("headers"), F.col("found.headers")
    outcome = (
        F.when(is_full, "full")
        .when(F.col("found").isNull(), "no_earlier_response")
        .when(tag(own).isNotNull(), F.when(tag(own) == F.coalesce(tag(kept), F.lit("\0")), "resolved").otherwise("validator_mismatch"))
        .when(F.element_at(own, "last-modified").isNotNull(), F.when(F.element_at(own, "last-modified") == F.coalesce(F.element_at(kept, "last-modified"), F.lit("\0")), "resolved").otherwise("validator_mismatch"))
        .otherwise("unchecked")
    )
    done = both.withColumn("outcome", outcome)
    taken = F.col("outcome").isin("resolved", "unchecked")
    return done.select(
        "record_id",
        "canonical_url",
        "ts",
        "outcome",
        F.when(taken, F.col("found.record_id")).alias("response_id"),
        F.when(is_full, F.col("payload_id")).when(taken, F.col("found.payload_id")).alias("payload_id"),
        F.when(is_full, F.col("payload_digest")).when(taken, F.col("found.payload_digest")).alias("payload_digest"),
        F.when(taken, merged(kept, own)).otherwise(own).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl of the pages table: every page answered in full once; asked again later (with equal, weak,
    other, partial or no validators, under URL variants); some asked before, some answered anew."""
    p = pages.select(F.col("page_id").cast("bigint").alias("id"), F.col("url").cast("string").alias("url"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("d"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("len"))
    p = p.withColumn("t", 1_700_000_000 + F.pmod(F.col("id") * 7919, F.lit(8_640_000)))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    day = lambda t: F.concat(F.lit("day "), F.floor(t / 86_400).cast("string"))

    def record(k: int, kind: str, url: Column, ts: Column, headers: list[tuple[str, Column]], digest: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")) for n, v in headers])
        return F.struct(
            (F.col("id") * 4 + k).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"),
            F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())).alias("headers"),
            F.when(F.lit(kind == "response"), F.col("id")).alias("payload_id"), digest.alias("payload_digest"),
        )

    def full(k: int, ts: Column, digest: Column) -> Column:
        return record(k, "response", F.col("url"), ts, [("Content-Type", F.lit("text/html")), ("Content-Length", F.col("len")), ("ETag", quoted(digest)), ("Last-Modified", day(F.col("t"))), ("Date", day(ts)), ("Server", F.lit("a"))], digest)

    def again(k: int, url: Column, ts: Column) -> Column:
        r = F.pmod("id", F.lit(7))
        etag = F.when(r == 3, F.lit('"other"')).when(r == 6, F.concat(F.lit("W/"), quoted(F.col("d")))).when(r.isin(4, 5), None).otherwise(quoted(F.col("d")))
        lm = F.when(r == 5, None).otherwise(day(F.col("t")))
        return record(k, "revisit", url, ts, [("etag", etag), ("last-modified", lm), ("date", day(ts)), ("cache-control", F.lit("max-age=60")), ("content-length", F.lit("0")), ("server", F.lit("b"))], F.lit(None).cast("string"))

    q = F.pmod("id", F.lit(4))
    variant = F.when(q == 1, F.regexp_replace("url", "^http:", "https:")).when(q == 2, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))).otherwise(F.col("url"))
    t = F.col("t")
    rows = F.array(
        full(0, t, F.col("d")),
        again(1, variant, t + 3600 * (1 + F.pmod("id", F.lit(50)))),
        F.when(F.pmod("id", F.lit(3)) == 0, again(2, F.col("url"), t - 1800)),
        F.when(F.pmod("id", F.lit(5)) == 0, full(3, t + 72_000, F.md5(F.concat(F.col("d"), F.lit("!")).cast("binary")))),
    )
    return p.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def resolve_pages(pages: DataFrame) -> DataFrame:
    out = resolve(captures_of(pages))
    return out.select("record_id", "canonical_url", "ts", "outcome", "response_id", "payload_id", "payload_digest", header_text(F.col("headers")).alias("headers"))


REVISITS_SQL = r"""
WITH p AS (
  SELECT page_id AS id, url, md5(coalesce(html, '')) AS d, len(coalesce(html, ''))::VARCHAR AS l,
         1700000000 + (page_id * 7919) % 8640000 AS t FROM pages),
c AS (
  SELECT id * 4 AS record_id, id, url, t AS ts, 1 AS f, d AS pd, '"' || d || '"' AS etag, 'day ' || floor(t / 86400)::BIGINT AS lm, l FROM p
  UNION ALL
  SELECT id * 4 + 3, id, url, t + 72000, 1, md5(d || '!'), '"' || md5(d || '!') || '"', 'day ' || floor(t / 86400)::BIGINT, l FROM p WHERE id % 5 = 0
  UNION ALL
  SELECT id * 4 + k, id,
         CASE WHEN k = 1 AND id % 4 = 1 THEN regexp_replace(url, '^http:', 'https:') WHEN k = 1 AND id % 4 = 2 THEN regexp_replace(url, '#.*$', '') || '#again' ELSE url END,
         CASE WHEN k = 1 THEN t + 3600 * (1 + id % 50) ELSE t - 1800 END, 0, NULL,
         CASE id % 7 WHEN 3 THEN '"other"' WHEN 6 THEN 'W/"' || d || '"' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE '"' || d || '"' END,
         CASE id % 7 WHEN 5 THEN NULL ELSE 'day ' || floor(t / 86400)::BIGINT END, '0'
  FROM p, (VALUES (1), (2)) v(k) WHERE k = 1 OR id % 3 = 0),
u AS (
  SELECT *, regexp_replace(url, '#.*$', '') AS plain FROM c),
w AS (
  SELECT *,
    list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref|sessionid)='))) AS params,
    regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*:([0-9]+)', 1) AS port FROM u),
x AS (
  SELECT *,
    regexp_replace(lower(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)', 1)), '^www[0-9]*\.', '')
    || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END
    || regexp_replace(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM w),
y AS (
  SELECT *, last_value(CASE WHEN f = 1 THEN {'record_id': record_id, 'id': id, 'pd': pd, 'etag': etag, 'lm': lm, 'l': l, 'ts': ts} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY ts, f, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM x),
z AS (
  SELECT *, CASE WHEN f = 1 THEN 'full' WHEN r IS NULL THEN 'no_earlier_response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = r.etag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN lm IS NOT NULL THEN CASE WHEN lm = r.lm THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE 'unchecked' END AS outcome FROM y)
SELECT record_id, canonical_url, ts, outcome,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN r.record_id END AS response_id,
  CASE WHEN f = 1 THEN id WHEN outcome IN ('resolved', 'unchecked') THEN r.id END AS payload_id,
  CASE WHEN f = 1 THEN pd WHEN outcome IN ('resolved', 'unchecked') THEN r.pd END AS payload_digest,
  CASE WHEN f = 1 THEN
      'content-length: ' || l || chr(10) || 'content-type: text/html' || chr(10) || 'date: day ' || floor(ts / 86400)::BIGINT || chr(10) || 'etag: ' || etag || chr(10) || 'last-modified: ' || lm || chr(10) || 'server: a'
    WHEN outcome IN ('resolved', 'unchecked') THEN
      'cache-control: max-age=60' || chr(10) || 'content-length: ' || r.l || chr(10) || 'content-type: text/html' || chr(10) || 'date: day ' || floor(ts / 86400)::BIGINT || chr(10) || 'etag: ' || coalesce(etag, r.etag) || chr(10) || 'last-modified: ' || r.lm || chr(10) || 'server: a'
    ELSE
      'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: day ' || floor(ts / 86400)::BIGINT || coalesce(chr(10) || 'etag: ' || etag, '') || coalesce(chr(10) || 'last-modified: ' || lm, '') || chr(10) || 'server: b'
  END AS headers
FROM z
"""
