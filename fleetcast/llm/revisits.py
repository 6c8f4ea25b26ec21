"""WARC: not-modified revisits resolved by an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcast.llm.url_filters import LOWER, UPPER
from fleetcast.plans.staging import materialize

#: Headers of a 304 response that replace those of the stored response; all others of it are dropped.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that name no other page.
TRACKING = r"utm_[^=&]*|gclid|fbclid|ref"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case (A-Z), no user, default port, fragment or tracking parameters, ``/`` for an empty path.

    Null, and what has no ``scheme://host``, gives null.
    """
    part = lambda i: F.regexp_extract(url, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    scheme = F.translate(part(1), UPPER, LOWER)
    host = F.regexp_replace(F.translate(part(2), UPPER, LOWER), r"\.?(:(80|443)?)?$", "")
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), part(4)), rf"&({TRACKING})(=[^&]*)?(?=&|$)", ""), "^&+", "")
    full = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when((scheme != "") & (host != ""), full)


def _tag(value: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(value), "^W/", "")


def resolve_revisits(records: DataFrame, span_seconds: int = 600) -> DataFrame:
    """Revisits with the response that they repeat.

    ``records``: record_id (long), url, time (timestamp), type (``response`` or ``revisit``), status (int), headers
    (map, names in lower case), payload_digest. A full response has type ``response`` and status 200.

    One row for each revisit: record_id, canonical_url, time, ``refers_to`` (the latest full response of the same
    canonical URL with an earlier time; of several at that time the one with the largest id, of equal ids that with the
    largest digest), ``outcome`` and ``headers``. Outcomes: ``unresolved`` (no earlier response, or no URL or time),
    ``mismatch`` (a validator that both have differs: entity tags by weak comparison, else dates of last modification, else
    payload digests), ``unchecked`` (no validator in common), ``matched``. ``headers`` of matched and unchecked revisits are
    those of the response, with the permitted ones of the revisit in place; null otherwise.

    Null headers count as empty. A null ``record_id`` is an id like others, before all others: such a response may be referred
    to, by a null, and its headers are merged. Repeated rows each stay. Very long URLs and headers are used whole. An empty
    table gives an empty result; other columns are ignored.

    A URL's records are cut into spans of time, searched apart; a span that starts without a response takes the last of
    the spans before it, so that one URL with a third of all records is still spread out. Payloads never move.
    """
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    rows = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("canonical_url"),
        "time",
        ((F.col("type") == "response") & (F.col("status") == 200)).alias("full"),
        (F.col("type") == "revisit").alias("revisit"),
        headers.alias("headers"),
        "payload_digest",
    ).where("full or revisit")
    keyed = rows.where("canonical_url is not null and time is not null").withColumn("span", F.floor(F.unix_micros("time") / (span_seconds * 1_000_000)).cast("long"))
    # The struct of a response sorts by time, then by id.
    slim = keyed.withColumn("own", F.when(F.col("full"), F.struct("time", "record_id", "payload_digest")))
    order = F.unix_micros("time")
    before = W.partitionBy("canonical_url", "span").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    within = slim.select("record_id", "canonical_url", "time", "span", "revisit", "payload_digest", F.max("own").over(before).alias("near")).where("revisit")
    spans = slim.groupBy("canonical_url", "span").agg(F.max("own").alias("last"))
    earlier = W.partitionBy("canonical_url").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select(F.col("canonical_url").alias("u"), F.col("span").alias("s"), F.max("last").over(earlier).alias("carry"))
    found = within.join(carried, (F.col("canonical_url") == F.col("u")) & (F.col("span") == F.col("s")), "left").select("record_id", "canonical_url", "time", "payload_digest", F.coalesce("near", "carry").alias("hit"))
    lost = rows.where("revisit and (canonical_url is null or time is null)").select("record_id", "canonical_url", "time", "payload_digest", F.lit(None).cast(found.schema["hit"].dataType).alias("hit"))

    # Written before the join, so that the revisits of one response, however many, are split over tasks.
    stored = materialize(keyed.where("full").groupBy("canonical_url", "time", "record_id", "payload_digest").agg(F.max_by("headers", F.to_json("headers")).alias("stored")))
    own = rows.where("revisit").select("record_id", "canonical_url", "time", "payload_digest", F.col("headers").alias("sent"))
    asked = found.union(lost).distinct().alias("a")
    same = lambda x, y, names: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names]
    joined = asked.join(own.alias("o"), same("a", "o", ["record_id", "canonical_url", "time", "payload_digest"]))
    joined = joined.join(
        stored.alias("r"),
        [F.col("a.canonical_url") == F.col("r.canonical_url"), F.col("a.hit.time") == F.col("r.time"), F.col("a.hit.record_id").eqNullSafe(F.col("r.record_id")), F.col("a.hit.payload_digest").eqNullSafe(F.col("r.payload_digest"))],
        "left",
    )
    flat = joined.select("a.record_id", "a.canonical_url", "a.time", "a.payload_digest", "a.hit", "r.stored", "o.sent")
    tag = _tag(F.col("sent")["etag"]) == _tag(F.col("stored")["etag"])
    date = F.trim(F.col("sent")["last-modified"]) == F.trim(F.col("stored")["last-modified"])
    same_validator = F.coalesce(tag, date, F.col("payload_digest") == F.col("hit.payload_digest"))
    outcome = F.when(F.col("hit").isNull(), "unresolved").when(same_validator.isNull(), "unchecked").when(same_validator, "matched").otherwise("mismatch")
    fresh = F.map_filter("sent", lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    return flat.select(
        "record_id",
        "canonical_url",
        "time",
        F.col("hit.record_id").alias("refers_to"),
        outcome.alias("outcome"),
        F.when(outcome.isin("matched", "unchecked"), merged).alias("headers"),
    )
