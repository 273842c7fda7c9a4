"""Streaming forms of queries, run over what is there now and held against the batch SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import samples as S
from packetloom.operators.scan import settle, shared_dir
from packetloom.sources import pcm
from packetloom.sources.live_lists import LiveLists
from packetloom.sources.pcm_files import PcmFiles
from packetloom.sources.stream_files import StreamFiles, in_order
from packetloom.streaming import inband, live

from .proxies import FEW, IDX, PACKETS, packets_of, table
from .registry import ORACLE_SQL, query
from .text_queries import PAGES


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    alone = batch.inputFiles()[0].endswith("/events.parquet")  # a file; else a folder of files
    return packets_of(reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else reader.parquet(path))


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return live.run_available(stream, f"{folder}/out", f"{folder}/checkpoint", mode)


def _tee(spark: SparkSession, stream: DataFrame, part: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], columns: list[str]) -> DataFrame:
    """What part finds in the micro-batches of a stream, with the state that it leaves to the next one."""
    folder = f"{shared_dir(spark)}/tee-{uuid.uuid4().hex}"

    def outputs(batch: DataFrame, before: DataFrame | None) -> tuple[dict[str, DataFrame], DataFrame]:
        found, state = part(batch, before)
        return {"found": found}, state

    live.tee(stream, outputs, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out/found").select(*columns)


@query(ORACLE_SQL["stream_stats"])
def streaming_stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, live.stream_stats(_stream(spark, sf_dir)), "complete")


@query(ORACLE_SQL["state_changes"])
def streaming_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir).select("stream_id", "idx", F.col("event_type").alias("value"))
    return _tee(spark, events, lambda batch, before: live.changes_in(batch, before, width=IDX), ["stream_id", "idx", "value"])


@query(f"""WITH s AS (SELECT stream_id, idx, event_type, keyframe, count(*) FILTER (keyframe) OVER (PARTITION BY stream_id ORDER BY idx) AS n FROM {PACKETS})
    SELECT stream_id, min(idx) AS idx, count(*) AS parts, string_agg(event_type, '' ORDER BY idx) AS payload FROM s WHERE n > 0 GROUP BY stream_id, n QUALIFY n < max(n) OVER (PARTITION BY stream_id)""")
def streaming_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete packets only: the last of each stream stays open."""
    p = _stream(spark, sf_dir).select("stream_id", "idx", F.col("keyframe").alias("start"), F.col("event_type").alias("payload"))
    return _tee(spark, p, lambda batch, before: live.packets_in(batch, before, width=IDX), ["stream_id", "idx", "parts", "payload"])


@query("""WITH p AS (SELECT vec_id, [CAST(greatest(least(floor(x::DOUBLE * 32767 + 0.5), 32767), -32768) AS BIGINT) for x in embedding] AS p FROM embeddings)
    SELECT vec_id::VARCHAR AS source, k AS idx, k * 8 AS pts, least(8, len(p) // 2 - k * 8) AS duration, 44 + k * 32 AS position, CAST(list_sum(p[k * 16 + 1:k * 16 + 16]) AS BIGINT) AS total
    FROM p, LATERAL (SELECT unnest(range(0, (len(p) // 2 + 7) // 8)) AS k)""")
def wav_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as stereo WAV files, cut into packets of eight blocks and decoded."""
    pair = lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFF)), 4, "0")
    e = table(spark, sf_dir, "embeddings").select("vec_id", S.to_int16(F.col("embedding")).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.concat(F.substring(pair(x), 3, 2), F.substring(pair(x), 1, 2))), ""))
    files = e.select(F.col("vec_id").cast("string").alias("source"), pcm.write_wav(data, 2, 44100, 16).alias("content"))
    got = pcm.packets(files, 32).withColumn("data", S.decode_pcm(F.col("payload"), "s16le"))
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x).cast("long")
    return got.select("source", "idx", "pts", "duration", "position", total.alias("total"))


@query(f"""SELECT stream_id::VARCHAR AS source, idx AS poll, idx AS seq, event_type AS uri, coalesce(idx > lag(idx) OVER (PARTITION BY stream_id ORDER BY idx) + 1, false) AS late FROM {PACKETS}""")
def streaming_new_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a live list that is polled at each event, and shows it alone: what came between has left the list."""
    p = _stream(spark, sf_dir).select(F.col("stream_id").cast("string").alias("source"), F.col("idx").alias("poll"), F.col("idx").alias("seq"), F.col("event_type").alias("uri"))
    return _tee(spark, p, lambda batch, before: live.segments_in(batch, before, IDX), ["source", "poll", "seq", "uri", "late"])


# --- live lists as a source -----------------------------------------------------------------------------------


def _poll_lists(spark: SparkSession, sf_dir: str, start: str, step: int, window: int = 12, polls: int = 3) -> DataFrame:
    """Each host's pages as the segments of a live list that shows `window` of them and goes on by `step` between polls. Every poll is a run of the
    query, restarted from its checkpoint."""
    folder = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    p = table(spark, sf_dir, "pages").withColumn("host", F.concat(host, F.lit("-"), F.floor(F.col("page_id") / PAGES).cast("string")))
    p = p.withColumn("ord", (F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1).cast("long"))  # PAGES at most; long, as their microseconds are
    gone = lambda n: F.when(F.col("page_id") % 4 == 0, n).otherwise(0)
    p = p.withColumn("gone", F.coalesce(F.sum(gone(1)).over(Window.partitionBy("host").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    date = F.concat(F.lit("#EXT-X-PROGRAM-DATE-TIME:"), F.date_format(F.timestamp_micros(F.col("ord") * 6_500_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("\n"))
    entry = F.concat(F.when(F.col("page_id") % 4 == 0, "#EXT-X-DISCONTINUITY\n").otherwise(""), F.when(F.col("ord") % 3 == 0, date).otherwise(""), F.lit("#EXTINF:6.5,\npage"), F.col("page_id").cast("string"))
    p = settle(p.select("host", "ord", "gone", entry.alias("entry")))
    spark.dataSource.register(LiveLists)
    stream = spark.readStream.format("live_list").options(path=f"{folder}/lists/host=*", start=start, lost="skip").load()
    stream = stream.withColumn("host", F.regexp_extract("source", "host=([^/]*)", 1)).select("host", "seq", "dseq", "uri", "clock_us", "duration_us", "late")
    for k in range(polls):
        shown = p.filter((F.col("ord") >= k * step) & (F.col("ord") < k * step + window))
        listed = shown.groupBy("host").agg(F.min("ord").alias("first"), F.min_by("gone", "ord").alias("gone"), F.array_sort(F.collect_list(F.struct("ord", "entry"))).alias("e"))
        head = F.concat(F.lit("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:"), (F.col("first") + 100).cast("string"), F.lit("\n#EXT-X-DISCONTINUITY-SEQUENCE:"), F.col("gone").cast("string"), F.lit("\n"))
        text = F.concat(head, F.array_join(F.transform("e", lambda x: x["entry"]), "\n"))
        listed.select("host", text.alias("value")).write.mode("overwrite").partitionBy("host").text(f"{folder}/lists")
        out = live.run_available(stream, f"{folder}/out", f"{folder}/checkpoint", "append")
    return out


def _live_sql(start: str, step: int) -> str:
    """What three polls of windows of 12 show: start is the rule's first ord among those of the first poll (n of them, the first being 0)."""
    return f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS ord, CAST(count(*) FILTER (page_id % 4 = 0) OVER (PARTITION BY host ORDER BY page_id) AS BIGINT) AS dseq
            FROM (SELECT regexp_extract(url, '^https?://([^/]*)', 1) || '-' || page_id // {PAGES} AS host, page_id FROM pages)),
        w AS (SELECT p.*, k, min(ord) OVER (PARTITION BY host, k) AS low FROM p, (VALUES (0), (1), (2)) AS s(k) WHERE ord >= k * {step} AND ord < k * {step} + 12),
        s AS (SELECT host, {start} AS begin FROM (SELECT host, ord, dseq, count(*) OVER (PARTITION BY host) AS n FROM w WHERE k = 0) GROUP BY host),
        r AS (SELECT *, CASE WHEN k = 0 THEN begin ELSE greatest(begin, (SELECT max(ord) + 1 FROM w AS v WHERE v.host = w.host AND v.k < w.k)) END AS begun FROM w JOIN s USING (host))
        SELECT host, ord + 100 AS seq, dseq, 'page' || page_id AS uri, CASE WHEN clocked THEN ord * 6500000 END AS clock_us, 6500000::BIGINT AS duration_us, ord = low AND low > begun AS late
        FROM (SELECT *, max(ord % 3 = 0) OVER (PARTITION BY host, k ORDER BY ord) AS clocked FROM r) WHERE ord >= begun"""


@query(_live_sql("CAST(CASE WHEN max(n) <= 10 THEN max(n) // 2 ELSE max(n) - 2 END AS BIGINT)", 6))
def live_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that a new reader enters in the middle or near the end."""
    return _poll_lists(spark, sf_dir, "live", 6)


@query(_live_sql("CAST(coalesce(max(ord) FILTER (ord * 6500000 <= 20000000), 0) AS BIGINT)", 20))
def live_source_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that are entered by clock and go on faster than they are polled, so segments are lost."""
    return _poll_lists(spark, sf_dir, "clock:20000000", 20)


@query(_live_sql("CAST(coalesce(min(ord) FILTER (dseq = 2), CASE WHEN max(n) <= 10 THEN max(n) // 2 ELSE max(n) - 2 END) AS BIGINT)", 6))
def live_source_discontinuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that are entered at a discontinuity, or as any other where they don't show it."""
    return _poll_lists(spark, sf_dir, "dseq:2", 6)


# --- files by stream, and by range ----------------------------------------------------------------------------


@query("""WITH p AS (SELECT vec_id, [CAST(greatest(least(floor(x::DOUBLE * 32767 + 0.5), 32767), -32768) AS BIGINT) for x in embedding] AS p FROM embeddings)
    SELECT vec_id, k AS idx, k * 8 AS pts, least(8, len(p) // 2 - k * 8) AS duration, 44 + k * 32 AS position, CAST(list_sum(p[k * 16 + 1:k * 16 + 16]) AS BIGINT) AS total
    FROM p, LATERAL (SELECT unnest(range(1, least(3, (len(p) // 2 + 7) // 8))) AS k)""")
def pcm_file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as WAV files, a file a vector, in pieces that follow each other; then what is played from the 8th to the 24th block of each."""
    pair = lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFF)), 4, "0")
    e = table(spark, sf_dir, "embeddings").select("vec_id", S.to_int16(F.col("embedding")).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.concat(F.substring(pair(x), 3, 2), F.substring(pair(x), 1, 2))), ""))
    files = e.select(F.col("vec_id").cast("string").alias("source"), pcm.write_wav(data, 2, 44100, 16).alias("content"))
    cut_ = files.select("source", "content", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("content") / 100).cast("int") - 1)).alias("idx"))
    pieces = cut_.select("source", F.col("idx").cast("long").alias("idx"), F.substring("content", F.col("idx") * 100 + 1, F.lit(100)).alias("payload"))
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    for source in (StreamFiles, PcmFiles):
        spark.dataSource.register(source)
    in_order(pieces, "source", "idx", whole=True).write.format("stream_files").option("path", folder).mode("append").save()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    got = spark.read.format("pcm").options(path=folder, packet_bytes="32").load().filter("pts >= 8 and pts < 24")
    total = F.aggregate(S.decode_pcm(F.col("payload"), "s16le"), F.lit(0.0), lambda a, x: a + x).cast("long")
    return got.select(F.regexp_extract("source", "([^/]*)/[^/]*$", 1).cast("long").alias("vec_id"), "idx", "pts", "duration", "position", total.alias("total"))


# --- metadata inside byte streams -----------------------------------------------------------------------------

#: Bytes of sound between texts, and of a chunk.
INTERVAL, CHUNK = 500, 777


@query(f"""SELECT doc_id AS stream_id, (k + 1) * {INTERVAL} AS position, 'Title ' || doc_id || ', ' || k AS title, octet_length(encode(text)) AS n
    FROM documents, LATERAL (SELECT unnest(range(0, octet_length(encode(text)) // {INTERVAL})) AS k) WHERE k % 3 <> 1""")
def inband_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sound, with a title after every INTERVAL bytes (each third is left out), cut into chunks that fit no cycle and come in any order, in several micro-batches."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.encode("text", "UTF-8").alias("b"))

    def text(k):
        said = F.concat(F.lit("StreamTitle='Title "), F.col("stream_id").cast("string"), F.lit(", "), k.cast("string"), F.lit("';"))
        units = F.ceil(F.octet_length(said) / inband.UNIT).cast("int")
        padded = F.concat(F.lpad(F.hex(units), 2, "0"), F.rpad(F.hex(F.encode(said, "UTF-8")), units * 2 * inband.UNIT, F.lit("0")))
        return F.when(k % 3 == 1, "00").otherwise(padded)

    def piece(k):
        sound = F.hex(F.substring(F.col("b"), k * INTERVAL + 1, F.lit(INTERVAL)))
        return F.concat(sound, F.when(F.length(sound) == 2 * INTERVAL, text(k)).otherwise(""))

    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("b") / INTERVAL).cast("int")), piece)
    coded = d.filter("octet_length(b) > 0").select("stream_id", F.octet_length("b").alias("n"), F.unhex(F.array_join(pieces, "")).alias("c"))
    n = F.ceil(F.octet_length("c") / CHUNK).cast("int")
    cut_ = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("c"), k * CHUNK + 1, F.lit(CHUNK)))
    chunks = coded.select("stream_id", "n", F.posexplode(cut_).alias("idx", "payload")).withColumn("idx", F.col("idx").cast("long"))
    folder = f"{shared_dir(spark)}/inband-{uuid.uuid4().hex}"
    each = spark.sparkContext.defaultParallelism  # files of a third of the chunks
    chunks.repartition(3 * each, F.xxhash64("stream_id", "idx")).write.parquet(f"{folder}/chunks")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 2 * each).parquet(f"{folder}/chunks")
    found = live.run_available(inband.split(stream, INTERVAL), f"{folder}/out", f"{folder}/checkpoint", "append")
    sizes = d.select("stream_id", F.octet_length("b").cast("long").alias("n"))
    return found.filter("title is not null").join(sizes, "stream_id").select("stream_id", "position", "title", "n")


@query(f"""WITH p AS (SELECT host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS ord FROM (SELECT regexp_extract(url, '^https?://([^/]*)', 1) || '-' || page_id // {PAGES} AS host, page_id FROM pages)),
    w AS (SELECT host, k AS batch, min(ord) * 1000000000 AS start_us, (max(ord) + 1) * 1000000000 AS end_us FROM p, (VALUES (0), (1), (2)) AS s(k) WHERE ord >= k * 2 AND ord < k * 2 + 5 GROUP BY host, k)
    SELECT host, CAST(batch AS INTEGER) AS batch, start_us, end_us FROM w WHERE end_us - start_us > 1800000000 AND NOT EXISTS (SELECT 1 FROM w AS v WHERE v.host = w.host AND v.batch = w.batch - 1 AND v.start_us = w.start_us AND v.end_us = w.end_us)""")
def seek_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of live lists, a micro-batch each: an event for each list whose time that can be sought has moved."""
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    host = F.concat(F.regexp_extract("url", "^https?://([^/]*)", 1), F.lit("-"), F.floor(F.col("page_id") / PAGES).cast("string"))
    p = table(spark, sf_dir, "pages").select(host.alias("host"), "page_id")
    p = p.withColumn("seq", (F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1).cast("long"))  # PAGES at most
    p = p.select("host", "seq", F.lit(False).alias("discontinuity"), (F.col("seq") * 1_000_000_000).alias("program_us"), F.lit(1_000_000_000).cast("long").alias("duration_us"))
    p = settle(p)

    def outputs(batch: DataFrame, before: DataFrame | None) -> tuple[dict[str, DataFrame], DataFrame]:
        events, state = live.window_events(batch, before, ["host"], FEW)
        return {"events": events, "segments": batch}, state

    for k in range(3):
        p.filter((F.col("seq") >= k * 2) & (F.col("seq") < k * 2 + 5)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live.tee(spark.readStream.schema(p.schema).parquet(f"{folder}/in"), outputs, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out/events").select("host", "batch", "start_us", "end_us")
