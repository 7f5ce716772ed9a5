"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing. A record's text ends with two line ends, so records are rows of Spark's text writer with that separator.
Of records with equal payloads of some size, the one with the smallest id is a response and the others revisit it.
Only ids and digests are shuffled to find that out.

Reading. A file is cut at the record magic, in as many tasks as it has splits. Each piece is a candidate record,
with its offset (a running sum of lengths per file) and, from its header, its successor's offset. Magic inside a
payload gives false candidates. Pieces that follow each other as announced form runs, a run also starting where a
successor lands; pointer jumping over runs from each file's start keeps what is reachable. A record that is one
piece is digested where it was read; only records cut by magic in their payload are put together from their pieces.

Defined results: a null payload counts as empty; a null URL leaves out the target header, and line ends in a URL
are taken out; rows with equal ids are written one by one, and those with the smallest id of equal payloads are all
responses; rows with a null id are never referred to; an empty table gives an empty archive and no rows; extra
columns are ignored. A chain that breaks (a truncated file) ends that file's records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, scratch, through_disk

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
FILE_RECORDS = 4096
REVISIT_BYTES = 100
JUMPS = 64


def record_kinds(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that revisit another's payload."""
    keys = pages.select("page_id", F.octet_length("html").alias("n"), F.sha2(F.col("html").cast("binary"), 256).alias("digest")).where(F.col("n") >= least_bytes)
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 AND refers_to IS NOT NULL").drop("copies")
    return keys.join(first, "digest").where("page_id > refers_to OR page_id IS NULL").select("page_id", "digest", "refers_to").distinct()


def record(page_id: Column, url: Column, html: Column, digest: Column, refers_to: Column, date: str = DATE) -> Column:
    """A whole WARC record without its closing line ends."""
    urn = F.concat(F.lit("<urn:hirelake:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END))
    block = F.when(refers_to.isNull(), F.concat(http, html)).otherwise(http)
    head = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(refers_to.isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), urn),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, "[\\r\\n]", "")),
        F.when(refers_to.isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:hirelake:page:"), refers_to.cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(F.lit(MAGIC), head, F.lit(END), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = REVISIT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """One WARC record per row of pages (page_id, url, html), in files of at most file_records records below path."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    revisits = through_disk(record_kinds(rows, least_bytes), "revisits")
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    same = rows["page_id"].eqNullSafe(revisits["page_id"]) & (rows["digest"] == revisits["digest"])
    out = rows.join(revisits, same, "left").select(record(rows["page_id"], rows["url"], rows["html"], rows["digest"], revisits["refers_to"]).alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the magics of each file, with its place: the file, the split, the row in it."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.octet_length("value").cast("long").alias("len"), F.xxhash64("value").alias("hash"), "value")


def _field(head: Column, name: str, pattern: str) -> Column:
    found = F.regexp_extract(head, f"(?im)^{name}:[ \\t]*{pattern}", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> list[Column]:
    """Columns of one record from its text after the magic."""
    head = F.substring_index(value, END, 1)
    raw = value.cast("binary")
    head_len = F.octet_length(head).cast("long") + len(END)
    content = _field(head, "Content-Length", "(\\d{1,15})").cast("long")
    http = F.substring_index(F.substr(value, F.length(head) + 1 + len(END)), END, 1)
    http_len = F.octet_length(http).cast("long") + len(END)
    kind = F.lower(_field(head, "WARC-Type", "(\\S+)"))
    payload = F.substr(raw, (head_len + http_len + 1).cast("int"), (content - http_len).cast("int"))
    response = kind == "response"
    return [
        kind.alias("record_type"),
        _field(head, "WARC-Record-ID", "<urn:hirelake:page:(-?\\d+)>").cast("long").alias("page_id"),
        _field(head, "WARC-Target-URI", "([^\\r\\n]*)").alias("url"),
        _field(head, "WARC-Refers-To", "<urn:hirelake:page:(-?\\d+)>").cast("long").alias("refers_to"),
        F.when(response, content - http_len).otherwise(_field(http, "Content-Length", "(\\d{1,15})").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2(payload, 256)).otherwise(_field(head, "WARC-Payload-Digest", "sha256:([0-9a-f]+)")).alias("payload_digest"),
    ]


def _length(value: Column) -> Column:
    """A record's announced length after the magic, closing line ends included; null if its header is none."""
    head = F.substring_index(value, END, 1)
    content = _field(head, "Content-Length", "(\\d{1,15})").cast("long")
    ended = F.octet_length(head) < F.octet_length(value)
    return F.when(ended & head.rlike("(?i)^WARC-[A-Za-z-]+:"), F.octet_length(head).cast("long") + len(END) + content + len(END))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, next, whole, split, row, len, hash, fields): each candidate record, its offset and its successor's."""
    pieces = _pieces(spark, path)
    told = _length(F.col("value"))
    whole = F.coalesce(told == F.col("len"), F.lit(False))
    fields = F.when(whole, F.struct(*_parsed(F.col("value"))))
    narrow = pieces.select("file", "split", "row", "len", "hash", told.alias("told"), whole.alias("whole"), fields.alias("fields"))
    placed = _placed(narrow).withColumn("next", F.col("at") + len(MAGIC) + F.col("told"))
    return through_disk(placed.where("at >= 0").select("file", "at", "next", "whole", "split", "row", "len", "hash", "fields"), "candidates")


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with `at`, the offset in the file of the magic before them."""
    before = Window.partitionBy("file").orderBy("split", "row").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("at", F.coalesce(F.sum(F.col("len") + len(MAGIC)).over(before), F.lit(0)) - len(MAGIC))


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from each file's start reaches, by pointer jumping over runs."""
    order = Window.partitionBy("file").orderBy("at")
    linked = found.withColumn("linked", F.coalesce(F.lag("next").over(order) == F.col("at"), F.lit(False))).withColumn("joined", F.coalesce(F.lead("at").over(order) == F.col("next"), F.lit(False)))
    landings = linked.where("NOT joined AND next IS NOT NULL").select("file", F.col("next").alias("at")).distinct().withColumn("landing", F.lit(True))
    headed = linked.join(landings, ["file", "at"], "left").withColumn("head", ~F.col("linked") | F.coalesce("landing", F.lit(False)))
    numbered = saved(headed.withColumn("run", F.sum(F.col("head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("linked", "joined", "landing"))
    runs = numbered.groupBy("file", "run").agg(F.min("at").alias("head_at"), F.max_by("next", "at").alias("exit"))
    ends = runs.select("file", F.col("head_at").alias("exit"), F.col("run").alias("to"))
    jump = saved(runs.join(ends, ["file", "exit"]).select("file", "run", "to"))
    reached = saved(runs.where("head_at = 0").select("file", "run"))
    known = reached.count()
    for _ in range(JUMPS):
        new = reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = saved(reached.unionByName(new).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        on = jump.select("file", F.col("run").alias("to"), F.col("to").alias("beyond"))
        jump = saved(jump.join(on, ["file", "to"]).select("file", "run", F.col("beyond").alias("to")))
    return numbered.join(reached, ["file", "run"]).drop("run", "head")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest) of each record below path."""
    found = candidates(spark, path)
    records = reachable(found)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    whole = records.where("whole").select("fields.*").select(names)
    # of a record cut by magic: all candidates up to its successor are its pieces
    cut = saved(records.where("NOT whole").select("file", F.col("at").alias("begin"), F.col("next").alias("end")))
    place = ["file", "split", "row", "hash"]
    begin = Window.partitionBy("file").orderBy("at", "begin").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.select("at", *place).join(cut.select("file", F.col("begin").alias("at"), "begin", "end"), ["file", "at"], "left")
    inside = marked.withColumn("b", F.last("begin", True).over(begin)).withColumn("e", F.last("end", True).over(begin)).where("at < e").select(*place, "at", F.col("b").alias("begin"))
    needed = through_disk(inside, "pieces")
    parts = through_disk(_pieces(spark, path).join(needed, place).select("file", "begin", "at", "value"), "parts")
    if parts.count() < needed.count():
        # the files were split otherwise than in the first read, as when executors are lost: pieces are found by their offsets
        parts = _placed(_pieces(spark, path)).join(needed.select("file", "at", "begin"), ["file", "at"]).select("file", "begin", "at", "value")
    put = parts.groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("p"))
    joined = put.select(F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))
    again = joined.select(*_parsed(F.col("value"))).select(names)
    return whole.unionByName(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to new archives in the shared folder and returns what reading them back gives."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
