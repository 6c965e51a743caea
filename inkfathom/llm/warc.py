"""WARC archives of pages, and their capture index merged from sorted runs.

write_archives() makes one record per page: a response with the payload, or, for a payload of at least `revisit_bytes`
that an earlier page has, a revisit without it. Spark's own text writer makes the files, so that they go through the
commit protocol to whatever store the cluster shares; a record ends in the two line ends that WARC asks for because that
is the writer's line separator. read_archives() splits on the records' first two lines, the second of which names this
capture set by a random identifier, so no payload can hold the separator; it checks every length and digest.

capture_index() merges the archives' entries into one global order by URL key, time and page: every archive is a locally
sorted run, whose rows keep their run's and their place's number. Runs are cut at the bounds of key ranges of a bounded
number of rows; a range's pieces arrive run by run, each in its own order, and a loser tree merges them without sorting
any key again. A URL key, or a page, with a third of all captures spreads over many ranges, as the numbers are the
order's last part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written
from .losertree import LoserTree

REVISIT_BYTES = 100
EPOCH = "2024-01-01T00:00:00Z"
INDEX = "url_key string, ts string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
#: Entries that one task of the merge holds, about.
RANGE_ROWS = 100_000
_END = "\r\n\r\n"


def url_key(url: Column) -> Column:
    """Host reversed by its dots, then path and query, lower-cased, without scheme, port 80/443, fragment and leading www."""
    low = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(low, r"^([^/?]*)", 1), r"^www\.|:(80|443)$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(low, r"^[^/?]*(.*)$", 1))


def captures(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload, its size and digest, record_type and refers_to.

    Only (digest, smallest page, rows) of payloads held by several pages are joined back; the group of a very common
    payload is summed before the shuffle, and its side of the join can be split.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    firsts = (
        p.filter(F.col("payload_bytes") >= revisit_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_rows"))
        .filter("_rows > 1")
        .drop("_rows")
    )
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    joined = p.join(firsts, (p.payload_digest == F.col("_digest")) & (p.payload_bytes >= revisit_bytes), "left")
    return joined.select(*p.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def _record(capture_set: str) -> Column:
    ts = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(EPOCH))) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    refers = F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">\r\n"))).otherwise("")
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    # fmt: off
    return F.concat(
        F.lit(f"WARC/1.1\r\nX-Capture-Set: {capture_set}\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), urn, F.lit("\r\nWARC-Date: "), ts,
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), uri)), F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes"), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\n"), refers,
        F.lit("Content-Length: "), F.octet_length(body), F.lit(_END), body,
    )
    # fmt: on


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, records_per_file: int = 10_000) -> str:
    """Writes gzipped WARC files below path; gives the capture set's identifier, which reading needs."""
    capture_set = uuid.uuid4().hex
    records = captures(pages, revisit_bytes).select(_record(capture_set).alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    return capture_set


def read_archives(spark: SparkSession, path: str, capture_set: str) -> DataFrame:
    """One row per record: INDEX's columns and `payload` (binary, null for revisits). A record whose length or digest is
    wrong stops the read."""
    raw = spark.read.option("lineSep", f"{_END}WARC/1.1\r\nX-Capture-Set: {capture_set}\r\n").text(path)
    first = f"WARC/1.1\r\nX-Capture-Set: {capture_set}\r\n"
    raw = raw.select(F.when(F.col("value").startswith(first), F.expr(f"substring(value, {len(first) + 1})")).otherwise(F.col("value")).alias("value"))
    head = raw.select("value", F.substring_index("value", _END, 1).alias("head"))

    def field(name: str, group: str = "([^\r\n]*)") -> Column:
        return F.regexp_extract("head", rf"(?:^|\r\n){name}: {group}", 1)

    def number(c: Column) -> Column:
        return F.when(c.rlike("^-?[0-9]+$"), c).cast("long")

    r = head.select(
        field("WARC-Target-URI").alias("url"), F.col("head").contains("\r\nWARC-Target-URI: ").alias("has_url"), field("WARC-Date").alias("ts"), number(field("WARC-Record-ID", "<urn:page:([^>]*)>")).alias("page_id"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("payload_digest"), field("X-Payload-Length").cast("long").alias("payload_bytes"), field("WARC-Type").alias("record_type"),
        number(field("WARC-Refers-To", "<urn:page:([^>]*)>")).alias("refers_to"), field("Content-Length").cast("int").alias("n"), F.expr(f"substring(value, length(head) + {len(_END) + 1})").cast("binary").alias("rest"),
    )
    r = r.withColumn("payload", F.when(F.col("record_type") == "response", F.expr("substring(rest, 1, n)")))
    whole = F.when(F.col("payload").isNull(), F.col("n") == 0).otherwise((F.length("payload") == F.col("payload_bytes")) & (F.sha2("payload", 256) == F.col("payload_digest")))
    r = r.withColumn("record_type", F.when(whole, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged WARC record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))))
    return r.select(url_key(F.col("url")).alias("url_key"), "ts", "page_id", F.when(F.col("has_url"), F.col("url")).alias("url"), "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's entries in order; they come run by run (`_place`: the run's number, shifted by 33 bits, and the place in it)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    place = np.array(table["_place"])
    keys = list(zip(table["url_key"].to_pylist(), table["ts"].to_pylist(), ((x is None, x or 0) for x in table["page_id"].to_pylist()), table["payload_digest"].to_pylist(), place.tolist()))
    bounds = [0, *(np.flatnonzero(np.diff(place >> 33)) + 1).tolist(), len(place)]
    order = list(LoserTree([range(a, b) for a, b in zip(bounds, bounds[1:])], keys.__getitem__))
    table = table.drop_columns("_place")
    for at in range(0, len(order), 10_000):
        yield from table.take(order[at : at + 10_000]).combine_chunks().to_batches()


def capture_index(entries: DataFrame) -> DataFrame:
    """entries (INDEX's columns) in global order by url_key, ts, page_id over consecutive partitions."""
    order = [F.asc_nulls_last(c) for c in ("url_key", "ts", "page_id", "payload_digest")]
    names = [x.split()[0] for x in INDEX.split(", ")]
    runs = written(entries.select(*names).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "runs")
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(ranges, *order, F.asc("_place")).sortWithinPartitions("_place").mapInArrow(_merge, INDEX)


def archived_captures(pages: DataFrame, path: str | None = None, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes pages to WARC archives at path (a scratch folder without one), reads them back and gives their merged index.

    One row per page, in INDEX's columns. A null html is an empty payload, a null url stays null (its key is that of an
    empty one), a null page_id stays null and comes last among equals. Repeated rows (same page and payload) are records
    of their own; those of the smallest page are all responses. No pages give no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    capture_set = write_archives(pages, path, revisit_bytes)
    return capture_index(read_archives(spark, path, capture_set).drop("payload"))
