"""Queries on texts, tables of runs and chunks, samples and tags.

Files are proxies too: they are made by Spark from the driver's tables and parsed back, so the work grows with these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import bits
from packetloom.functions import samples as S
from packetloom.functions import text as X
from packetloom.operators import expand, lookup, metadata
from packetloom.sources import cues as C
from packetloom.sources import playlists as L
from packetloom.sources import tag_blocks as B
from packetloom.sources import tags as T

from .proxies import CUES, FEW, IDX, RUNS, cues, runs, table
from .registry import query

# --- run-length, chunk and edit tables ------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT *, coalesce(sum(count * delta) OVER w, 0)::BIGINT AS a0 FROM (SELECT track, ord, delta, count FROM {RUNS}) WINDOW w AS (PARTITION BY track ORDER BY ord, delta ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT track, ord, delta, a0 + k AS sample FROM r, LATERAL (SELECT unnest(range(0, count * delta)) AS k)""")
def expand_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return expand.runs(r, ["track"], "ord", F.col("count") * F.col("delta"), "sample", FEW, ["delta"]).select("track", "ord", "delta", "sample")


@query(f"""WITH r AS (SELECT *, coalesce(sum(count) OVER w, 0)::BIGINT AS s, coalesce(sum(count * delta) OVER w, 0)::BIGINT AS t FROM {RUNS} WINDOW w AS (PARTITION BY track ORDER BY ord, delta ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT track, s + k AS sample, t + k * delta AS dts, delta AS duration FROM r, LATERAL (SELECT unnest(range(0, count)) AS k)""")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.sample_times(runs(spark, sf_dir), ["track"], "ord", F.col("count"), F.col("delta"), FEW, ["delta"]).select("track", "sample", "dts", "duration")


_STEPS = "(SELECT c_custkey AS track, CAST(k * 3 + 1 AS BIGINT) AS first_chunk, CAST(1 + (c_custkey + k) % 4 AS BIGINT) AS samples_per_chunk FROM customer, range(0, 3) AS r(k))"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return c.select("track", (F.col("k") * 3 + 1).cast("long").alias("first_chunk"), (1 + (F.col("track") + F.col("k")) % 4).cast("long").alias("samples_per_chunk"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track"))
    return c.select("track", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("chunk"))


_CHUNKS = "(SELECT c_custkey AS track, CAST(k AS BIGINT) AS chunk FROM customer, range(1, 11) AS r(k))"


@query(f"SELECT c.track, c.chunk, s.samples_per_chunk FROM {_CHUNKS} c ASOF LEFT JOIN {_STEPS} s ON c.track = s.track AND c.chunk >= s.first_chunk")
def chunk_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.range_lookup(_chunks(spark, sf_dir), _steps(spark, sf_dir), ["track"], "chunk", "first_chunk", ["samples_per_chunk"], FEW)


@query(f"""WITH c AS (SELECT c.track, c.chunk, s.samples_per_chunk AS n FROM {_CHUNKS} c ASOF LEFT JOIN {_STEPS} s ON c.track = s.track AND c.chunk >= s.first_chunk),
    o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY track ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a0 FROM c),
    x AS (SELECT track, chunk, a0 + k AS sample, CAST((a0 + k) * 13 % 97 AS BIGINT) AS size, chunk * 10000 AS o FROM o, LATERAL (SELECT unnest(range(0, n)) AS k))
    SELECT track, chunk, sample, o + coalesce(sum(size) OVER (PARTITION BY track, chunk ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position,
        sample % 5 = 0 OR track % 2 = 1 AS keyframe FROM x""")
def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = expand.chunks_to_samples(_steps(spark, sf_dir), _chunks(spark, sf_dir), ["track"], FEW)
    s = s.withColumns({"size": F.col("sample") * 13 % 97, "offset": F.col("chunk") * 10000})
    placed = expand.chunk_offsets(s, ["track"], "chunk", "sample", "size")
    sync = s.filter("track % 2 = 0 and sample % 5 = 0").select("track", "sample")
    return expand.keyframe_table(placed, sync, ["track"], "sample").select("track", "chunk", "sample", "position", "keyframe")


@query(f"""WITH e AS (SELECT track, ord, delta, count, CASE WHEN delta % 7 = 0 THEN -1 ELSE delta * 100 END AS media_time, (delta * 1000 * 48000 * 2 + 600) // 1200 AS d FROM {RUNS}),
    s AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY track ORDER BY ord, delta ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS dst_time FROM e)
    SELECT track, ord, media_time, dst_time, d AS duration FROM s WHERE media_time <> -1""")
def edl_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs(spark, sf_dir).withColumns({"media_time": F.when(F.col("delta") % 7 == 0, -1).otherwise(F.col("delta") * 100).cast("long"), "duration": F.col("delta") * 1000})
    return expand.edit_list(e, ["track"], "ord", 48_000, 600, FEW, ["delta"]).select("track", "ord", "media_time", "dst_time", "duration")


@query("""WITH b AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda x: CAST(length(x) AS BIGINT)) AS s FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS lace, size, doc_id * 1000 + coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM (SELECT doc_id, unnest(s) AS size, unnest(range(0, len(s))) AS i FROM b)""")
def lacing_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    sizes = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda x: F.length(x).cast("long"))
    b = d.select("doc_id", sizes.alias("sizes"), (F.col("doc_id") * 1000).alias("position"))
    return expand.lacing(b, ["doc_id"], "doc_id", "sizes", "position").select("doc_id", "lace", "size", "position")


@query("""WITH b AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda x: CAST(octet_length(encode(x)) AS BIGINT)) AS s FROM documents),
    c AS (SELECT doc_id, k, s[k * 200 + 1:k * 200 + 200] AS s, CAST((doc_id + k) % 4 AS INTEGER) AS kind FROM b, LATERAL (SELECT unnest(range(0, (len(s) + 199) // 200)) AS k)),
    l AS (SELECT doc_id, k, kind, unnest(CASE kind WHEN 0 THEN [CAST(list_sum(s) AS BIGINT)] WHEN 2 THEN list_transform(s, lambda x: 3::BIGINT) ELSE s END) AS size, unnest(range(0, CASE kind WHEN 0 THEN 1 ELSE len(s) END)) AS i FROM c)
    SELECT doc_id, k AS block, kind, CAST(i AS INTEGER) AS lace, size FROM l""")
def lacing_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole texts as frames, 200 a block, laced in each of four ways and read back from the blocks' bytes."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    b = d.select("doc_id", F.posexplode(F.expr("transform(sequence(0, (size(w) + 199) div 200 - 1), k -> slice(w, CAST(k AS INT) * 200 + 1, 200))")).alias("block", "w")).withColumn("block", F.col("block").cast("long"))
    b = b.withColumns({"kind": ((F.col("doc_id") + F.col("block")) % 4).cast("int"), "sizes": F.transform("w", lambda x: F.octet_length(x).cast("long"))})
    frames = F.when(F.col("kind") == 2, F.repeat(F.lit("414243"), F.size("w"))).otherwise(F.hex(F.encode(F.array_join("w", ""), "UTF-8")))
    b = b.select("doc_id", "block", "kind", F.unhex(F.concat(bits.write_laces(F.col("sizes"), F.col("kind")), frames)).alias("payload"))
    return expand.coded_lacing(b, ["doc_id"], "block", "payload", "kind").select("doc_id", "block", "kind", "lace", "size")


# --- text functions -------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS p FROM documents), n AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM l)
    SELECT doc_id, i - 1 AS line_no, p[i] AS line FROM n, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(X.lines(F.coalesce("text", F.lit("")))).alias("n", "line")).select("doc_id", F.col("n").cast("long").alias("line_no"), "line")


@query(r"""SELECT doc_id, md5(regexp_replace(text, '^[ \t\r\n\x0B\f]+|[ \t\r\n\x0B\f]+$', '', 'g')) AS stripped, md5(replace(text, chr(13), '')) AS no_cr FROM documents""")
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip("text")).alias("stripped"), F.md5(X.cue_text("text")).alias("no_cr"))


@query("SELECT doc_id, md5(base64(encode(text))) AS coded, true AS same FROM documents WHERE text IS NOT NULL")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")
    return d.select("doc_id", F.md5(coded).alias("coded"), (F.unbase64(coded) == F.encode("text", "UTF-8")).alias("same"))


@query("SELECT doc_id, 'UTF-8' AS charset, length(text)::BIGINT AS n, length(text)::BIGINT AS n16, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def charset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    plain = F.encode("text", "UTF-8")
    return d.select("doc_id", X.charset(plain).alias("charset"), F.length(X.to_text(plain)).cast("long").alias("n"), F.length(X.to_text(wide)).cast("long").alias("n16"), F.md5(X.to_text(wide)).alias("digest"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, 'lang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, 'href="([^"]*)"', 1), '') AS href, regexp_replace(url, '^http(s?)://', 'hls\1://') AS live,
    regexp_matches(url, '^https?://[^/]+/(de|fr)/') AS chosen FROM pages""")
def attr_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.attribute("html", "lang").alias("lang"), X.attribute("html", "href").alias("href"), X.live_scheme("url").alias("live"), F.col("url").rlike("^https?://[^/]+/(de|fr)/").alias("chosen"))


@query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages)
    SELECT page_id, nullif(page, '') AS page, nullif(ref, '') AS ref, regexp_extract(url, '^([^#]*)', 1) || CASE WHEN contains(regexp_extract(url, '^([^#]*)', 1), '?') THEN '&' ELSE '?' END || 'id=' || page_id || '&x=y' || regexp_extract(url, '(#.*)$', 1) AS more,
        regexp_matches(url, '^https:') OR regexp_matches(lower(url), '#top$') AS chosen FROM u""")
def url_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("v", X.url_variables("url"))
    more = X.with_variables("url", F.create_map(F.lit("x"), F.lit("y"), F.lit("id"), F.col("page_id").cast("string")))
    return p.select("page_id", F.col("v")["page"].alias("page"), F.col("v")["ref"].alias("ref"), more.alias("more"), X.named_like("url", ["HTTPS:"], ["#TOP"]).alias("chosen"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' WHEN 'fr' THEN 'fre' WHEN 'es' THEN 'spa' ELSE lang END AS language, CASE WHEN doc_id % 2 = 0 THEN 'chi' ELSE 'klingon' END AS other FROM documents")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("doc_id") % 2 == 0, "ZH-Hant").otherwise("klingon")
    return table(spark, sf_dir, "documents").select("doc_id", metadata.language(F.col("lang")).alias("language"), metadata.language(other).alias("other"))


@query(f"SELECT track, CAST(sum(count) AS BIGINT) AS samples FROM {RUNS} GROUP BY track")
def timecode_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.total_samples(runs(spark, sf_dir), ["track"])


@query("""WITH c AS (SELECT c_custkey, abs(c_acctbal) / 90 AS percent, [least(255, i * 5 // 2 + c_custkey % 3) for i in range(0, 100)] AS toc, c_custkey * 1000 AS size FROM customer), p AS (SELECT *, least(greatest(percent, 0), 100) AS pc, CAST(least(floor(least(greatest(percent, 0), 100)), 99) AS INTEGER) AS low FROM c)
    SELECT c_custkey, CAST(floor((toc[low + 1] + (coalesce(toc[low + 2], 256) - toc[low + 1]) * (pc - low)) * size / 256) AS BIGINT) AS position FROM p""")
def toc_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    toc = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.least(F.lit(255), F.floor(i * 5 / 2) + F.col("c_custkey") % 3))
    return c.select("c_custkey", lookup.table_of_contents(F.abs("c_acctbal") / 90, toc, F.col("c_custkey") * 1000).alias("position"))


@query("SELECT o_orderkey, CAST(o_orderkey * 1000 + 7 AS BIGINT) AS srt_ms, CAST(((o_orderkey % 75) + 75 * (o_orderkey % 60 + 60 * (o_orderkey % 90))) * 588 AS BIGINT) AS cd_samples FROM orders")
def cue_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    srt = F.concat(F.floor(k / 3600).cast("string"), F.lit(":"), two(F.floor(k / 60).cast("long") % 60), F.lit("."), two(k % 60), F.lit(",007"))
    cd = F.concat(two(k % 90), F.lit(":"), two(k % 60), F.lit(":"), two(k % 75))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.srt_time(srt).alias("srt_ms"), X.cd_frames(cd, 588).alias("cd_samples"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Track ' || lpad(p_size::VARCHAR, 2, '0') WHEN p_size % 3 = 1 THEN lpad(p_size::VARCHAR, 2, '0') || ' ' || p_name ELSE lpad(p_size::VARCHAR, 2, '0') || ' ' || p_brand || ' - ' || p_name END AS label FROM part""")
def label_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    title, artist = F.when(F.col("p_size") % 3 != 0, F.col("p_name")), F.when(F.col("p_size") % 3 == 2, F.col("p_brand"))
    return p.select("p_partkey", X.track_label(F.col("p_size"), artist, title).alias("label"))


# --- metadata -------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT o_custkey, o_orderkey AS pos, CASE o_orderstatus WHEN 'P' THEN 'TITLE' WHEN 'F' THEN 'ARTIST' ELSE 'GENRE' END AS key, o_orderpriority AS value FROM orders)
    SELECT o_custkey, key, CASE key WHEN 'TITLE' THEN arg_min(value, pos) ELSE string_agg(value, '|' ORDER BY pos) END AS "values" FROM e GROUP BY o_custkey, key""")
def multi_value_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("o_orderstatus") == "P", "TITLE").when(F.col("o_orderstatus") == "F", "ARTIST").otherwise("GENRE")
    e = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), key.alias("key"), F.col("o_orderpriority").alias("value"))
    return metadata.collect_tags(e, ["o_custkey"]).select("o_custkey", "key", F.array_join("values", "|").alias("values"))


@query("""SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS rank, source FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    own = F.when(F.col("quality") == 1, F.create_map(F.lit("rank"), F.lit("good")))
    merged = metadata.merge_maps(own, F.create_map(F.lit("rank"), F.col("lang"), F.lit("source"), F.col("source")))
    return d.select("doc_id", merged.alias("m")).select("doc_id", F.col("m")["rank"].alias("rank"), F.col("m")["source"].alias("source"))


@query("SELECT c_custkey, rtrim(c_name) AS title, c_mktsegment AS artist, '199' || (c_nationkey % 10)::VARCHAR AS year, CASE WHEN c_nationkey < 8 THEN CAST(c_nationkey AS INTEGER) END AS genre, CAST(1 + c_custkey % 200 AS INTEGER) AS track FROM customer")
def id3v1_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    genre = F.when(F.col("c_nationkey") < 8, F.col("c_nationkey")).otherwise(255)
    made = T.write_id3v1(title=F.col("c_name"), artist=F.col("c_mktsegment"), album=F.lit("x"), year=F.concat(F.lit("199"), (F.col("c_nationkey") % 10).cast("string")), comment=F.lit(""), track=(1 + F.col("c_custkey") % 200), genre=genre)
    data = F.concat(F.encode("c_name", "UTF-8"), made)
    return c.select("c_custkey", T.id3v1(data).alias("t")).select("c_custkey", "t.title", "t.artist", "t.year", F.when(F.col("t.genre") < 8, F.col("t.genre")).alias("genre"), "t.track")


@query("""SELECT doc_id, coalesce(nullif(lang, ''), nullif(source, '')) AS first, CASE WHEN length(d) = 4 THEN 'YEAR' ELSE 'DATE' END AS key, d AS value
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN CAST(1900 + doc_id % 100 AS VARCHAR) ELSE (1900 + doc_id % 100) || '-05-01' END AS d FROM documents)""")
def tag_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several fields for one thing the first that isn't empty; dates that are years go under another key."""
    year = (1900 + F.col("doc_id") % 100).cast("string")
    d = table(spark, sf_dir, "documents").withColumn("value", F.when(F.col("doc_id") % 2 == 0, year).otherwise(F.concat(year, F.lit("-05-01"))))
    return d.select("doc_id", X.first_of(F.col("lang"), F.col("source")).alias("first"), X.date_tag("value").alias("key"), "value")


@query("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'ogg' WHEN p_size % 6 = 1 THEN 'wav' WHEN p_size % 6 = 2 THEN 'vtt' WHEN p_size % 6 = 3 THEN 'png' WHEN p_size % 6 = 4 THEN 'mpegts' END AS format FROM part""")
def probe_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the first bytes of several formats, and some of none."""
    p, kind = table(spark, sf_dir, "part"), F.col("p_size") % 6
    name = F.encode("p_name", "UTF-8")
    marks = {0: "4F676753", 1: "524946460000000057415645", 2: "574542565454", 3: "89504E470D0A1A0A", 4: "47" + "00" * 187 + "47" + "00" * 187 + "47"}
    head = F.unhex(F.lit("00"))
    for k, mark in marks.items():
        head = F.when(kind == k, F.unhex(F.lit(mark))).otherwise(head)
    return p.select("p_partkey", T.probe(F.concat(head, name)).alias("format"))


@query("""WITH f AS (SELECT doc_id, unnest(['Title', 'Artist', 'Genre', 'Comment']) AS key, unnest([source, lang, CASE doc_id % 3 WHEN 0 THEN 'Blues' WHEN 1 THEN 'Synthpop' ELSE '148' END, text]) AS value FROM documents)
    SELECT doc_id, format, key, md5(value) AS digest FROM f, (VALUES ('ape'), ('id3v2'), ('vorbis')) AS x(format) WHERE value IS NOT NULL""")
def tag_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts and their columns as tags of three formats, written and read back."""
    d = table(spark, sf_dir, "documents")
    genre = F.when(F.col("doc_id") % 3 == 0, "(0)").when(F.col("doc_id") % 3 == 1, "147").otherwise("148")
    pairs = lambda *keys: list(zip(keys, (F.col("source"), F.col("lang"), genre, F.col("text"))))
    made = {
        "id3v2": B.id3v2(F.concat(B.write_id3v2(pairs("TIT2", "TPE1", "TCON", "COMM")), F.unhex(F.lit("FFFB9064")))),
        "ape": B.ape(F.concat(F.unhex(F.lit("FFFB9064")), B.write_ape(pairs("Title", "Artist", "Genre", "Comment")))), "vorbis": B.vorbis(B.write_vorbis(pairs("title", "ARTIST", "genre", "comment"))),
    }
    each = F.array(*[F.struct(F.lit(k).alias("format"), B.named(v).alias("fields")) for k, v in made.items()])
    rows = d.select("doc_id", F.explode(each).alias("t")).select("doc_id", "t.format", F.explode("t.fields").alias("f"))
    return rows.select("doc_id", "format", "f.key", F.md5("f.value").alias("digest"))


# --- samples --------------------------------------------------------------------------------------------------


@query("""SELECT vec_id, list_sum(p)::BIGINT AS total, list_max(p) AS high, list_min(p) AS low, CAST(len(p) AS INTEGER) AS n FROM (SELECT vec_id, [CAST(greatest(least(floor(x::DOUBLE * 32767 + 0.5), 32767), -32768) AS INTEGER) for x in embedding] AS p FROM embeddings)""")
def pcm_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", S.to_int16(F.col("embedding")).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("vec_id", total.alias("total"), F.array_max("p").alias("high"), F.array_min("p").alias("low"), F.size("p").alias("n"))


@query("""WITH p AS (SELECT vec_id, [CAST(greatest(least(floor(x::DOUBLE * 32767 + 0.5), 32767), -32768) AS BIGINT) for x in embedding] AS p FROM embeddings)
    SELECT vec_id, list_sum(p)::BIGINT AS total, list_sum([p[i] for i in range(1, len(p) + 1, 2)])::BIGINT AS left_total, CAST(len(p) AS INTEGER) AS n FROM p""")
def pcm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", S.to_int16(F.col("embedding")).alias("p"))
    pair = lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFF)), 4, "0")
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.concat(F.substring(pair(x), 3, 2), F.substring(pair(x), 1, 2))), ""))
    d = e.select("vec_id", S.decode_pcm(data, "s16le").alias("q"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x).cast("long")
    return d.select("vec_id", add(F.col("q")).alias("total"), add(S.channel(F.col("q"), 2, 0)).alias("left_total"), F.size("q").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(r * 0.257::DOUBLE + g * 0.504::DOUBLE + b * 0.098::DOUBLE + 16) AS BIGINT) AS y,
    CAST(trunc(r * -0.148::DOUBLE + g * -0.291::DOUBLE + b * 0.439::DOUBLE + 128) AS BIGINT) AS u, CAST(trunc(r * 0.439::DOUBLE + g * -0.368::DOUBLE + b * -0.071::DOUBLE + 128) AS BIGINT) AS v
    FROM (SELECT *, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem)""")
def palette_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    c = S.palette_yuv(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c.*")


# --- files made from the tables and read back -----------------------------------------------------------------

#: Cue texts end at blank lines, so the proxies' texts have none.
_FLAT = r"trim(regexp_replace(text, '[ \t]*\n[ \t\n]*', chr(10), 'g'), chr(10) || ' ')"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return c.withColumn("text", F.btrim(F.regexp_replace("text", "[ \t]*\n[ \t\n]*", "\n"), F.lit("\n ")))


@query(f"SELECT stream_id::VARCHAR AS source, pts, duration, md5({_FLAT}) AS digest FROM {CUES}")
def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = C.write_srt(_flat(spark, sf_dir), "stream_id").withColumn("source", F.col("source").cast("string"))
    return C.parse_srt(files, FEW).select("source", "pts", "duration", F.md5("text").alias("digest"))


@query(f"SELECT stream_id::VARCHAR AS source, pts, duration, md5({_FLAT}) AS digest FROM {CUES}")
def vtt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = C.write_vtt(_flat(spark, sf_dir), "stream_id").withColumn("source", F.col("source").cast("string"))
    return C.parse_vtt(files).select("source", "pts", "duration", F.md5("text").alias("digest"))


PAGES = 10_000


def _lists(spark: SparkSession, sf_dir: str, header: str, entry, key: str = "host") -> DataFrame:
    """A playlist of each host's pages, in page order; of large hosts one for every PAGES pages, so that no list grows with the host."""
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    p = table(spark, sf_dir, "pages").withColumn("source", F.concat(host, F.lit("/"), F.floor(F.col("page_id") / PAGES).cast("string")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"])
    return p.groupBy("source").agg(F.concat(F.lit(header), F.array_join(ordered, "\r\n")).alias("text"))


_HOSTS = f"(SELECT source, row_number() OVER (PARTITION BY source ORDER BY page_id) - 1 AS ord, page_id, url FROM (SELECT *, regexp_extract(url, '^https?://([^/]*)', 1) || '/' || page_id // {PAGES} AS source FROM pages))"


@query(f"SELECT source, ord, url AS uri, 'Page, ' || page_id AS label, page_id * 1000000 + 500000 AS duration_us, 'g' || page_id % 3 || ';all' AS groups, 'logo' || page_id AS logo FROM {_HOSTS}")
def m3u_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    entry = F.concat(F.lit("#EXTINF:"), k, F.lit('.5 tvg-logo="logo'), k, F.lit('" group-title="g'), (F.col("page_id") % 3).cast("string"), F.lit(';all",Page, '), k, F.lit("\r\n"), F.col("url"))
    files = _lists(spark, sf_dir, "#EXTM3U\r\n", entry)
    return L.parse_m3u(files, FEW).select("source", "ord", "uri", "label", "duration_us", F.array_join("groups", ";").alias("groups"), "logo")


@query(f"SELECT source, ord, url AS uri, 'Page ' || page_id AS label FROM {_HOSTS}")
def pls_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    entry = F.concat(F.lit("File"), k, F.lit("="), F.col("url"), F.lit("\r\nTitle"), k, F.lit("=Page "), k)
    return L.parse_pls(_lists(spark, sf_dir, "[playlist]\r\n", entry), FEW)


@query(f"SELECT source, ord, url AS uri, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE 'Stream ' || (ord + 1) END AS label FROM {_HOSTS}")
def asx_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<Title>Page "), k, F.lit("</Title>"))).otherwise("")
    entry = F.concat(F.lit("<Entry>"), title, F.lit('<Ref HREF = "'), F.col("url"), F.lit('"/></Entry>'))
    return L.parse_asx(_lists(spark, sf_dir, '<ASX version="3.0">', entry))


@query(f"SELECT source, count(*) AS urls FROM {_HOSTS} GROUP BY source")
def asx_url_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("<Entry><Repeat>"), F.lit('<REF HREF = "'), F.col("url"), F.lit('"/></Repeat></Entry>'))
    return L.count_urls(_lists(spark, sf_dir, '<ASX version="3.0">', entry))


@query(f"SELECT source, seq, uri, duration_us, discontinuity FROM (SELECT source, 100 + ord AS seq, url AS uri, page_id % 9 * 1000000 + 250000 AS duration_us, page_id % 4 = 0 AS discontinuity FROM {_HOSTS})")
def live_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_ = F.when(F.col("page_id") % 4 == 0, "#EXT-X-DISCONTINUITY\r\n").otherwise("")
    entry = F.concat(cut_, F.lit("#EXTINF:"), (F.col("page_id") % 9).cast("string"), F.lit(".25,\r\n"), F.col("url"))
    files = _lists(spark, sf_dir, "#EXTM3U\r\n#EXT-X-MEDIA-SEQUENCE:100\r\n", entry)
    return L.parse_segments(files, FEW).select("source", "seq", "uri", "duration_us", "discontinuity")


@query(f"""WITH v AS (SELECT source, ord, url AS uri, page_id * 1000 AS bandwidth, CAST(page_id % 1920 AS INTEGER) AS width, 'g' || page_id % 3 AS audio FROM {_HOSTS}),
    m AS (SELECT source, 'g' || page_id % 3 AS audio, 'name ' || page_id AS name, 'u' || page_id AS uri FROM {_HOSTS} WHERE ord < 6 AND ord % 2 = 0)
    SELECT v.source, v.ord, v.uri, v.bandwidth, v.width, v.audio, m.name AS rendition, m.uri AS rendition_uri FROM v LEFT JOIN m USING (source, audio)""")
def hls_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master lists of a host's pages: each page a variant, every second of the first six a rendition with an address too, each other one without."""
    k, at = F.col("page_id").cast("string"), F.row_number().over(Window.partitionBy("source").orderBy("page_id")) - 1
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    p = table(spark, sf_dir, "pages").withColumn("source", F.concat(host, F.lit("/"), F.floor(F.col("page_id") / PAGES).cast("string"))).withColumn("at", at)
    group = F.concat(F.lit("g"), (F.col("page_id") % 3).cast("string"))
    uri = F.when(F.col("at") % 2 == 0, F.concat(F.lit(',URI="u'), k, F.lit('"'))).otherwise("")
    media = F.when(F.col("at") < 6, F.concat(F.lit('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="'), group, F.lit('",NAME="name '), k, F.lit('"'), uri, F.lit("\r\n"))).otherwise("")
    inf = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), (F.col("page_id") * 1000).cast("string"), F.lit(",RESOLUTION="), (F.col("page_id") % 1920).cast("string"), F.lit('x1,AUDIO="'), group, F.lit('"\r\n'), F.col("url"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.concat(media, inf).alias("e")))), lambda x: x["e"])
    files = p.groupBy("source").agg(F.concat(F.lit("#EXTM3U\r\n"), F.array_join(ordered, "\r\n")).alias("text"))
    variants = L.parse_variants(files, FEW).withColumn("group_id", F.col("audio"))
    media_rows = L.parse_media(files).filter("type = 'AUDIO'").select("source", "group_id", F.col("name").alias("rendition"), "uri")
    named = variants.withColumnRenamed("uri", "variant_uri")
    got = lookup.variant_groups(named, media_rows, ["source", "group_id"])
    return got.select("source", "ord", F.col("variant_uri").alias("uri"), "bandwidth", "width", "audio", "rendition", F.col("uri").alias("rendition_uri"))


_TRACKS = "(SELECT o_custkey, row_number() OVER w AS t, o_orderkey AS k, row_number() OVER w * 600 + o_orderkey % 75 AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"


@query(f"""SELECT o_custkey::VARCHAR AS source, CAST(t AS INTEGER) AS track, 'Song ' || k AS title, f * 588 AS start, lead(f) OVER (PARTITION BY o_custkey ORDER BY k) * 588 AS "end", lpad(t::VARCHAR, 2, '0') || ' Band - Song ' || k AS label FROM {_TRACKS}""")
def cue_sheet_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    o = table(spark, sf_dir, "orders")
    listed = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))

    def track(k, i):
        f = (i + 1) * 600 + k % 75
        at = F.concat(two(F.floor(f / 4500)), F.lit(":"), two(F.floor(f / 75) % 60), F.lit(":"), two(f % 75))
        return F.concat(F.lit("  TRACK "), two(i + 1), F.lit(' AUDIO\r\n    TITLE "Song '), k.cast("string"), F.lit('"\r\n    INDEX 01 '), at)

    text = F.concat(F.lit('PERFORMER "Band"\r\nTITLE "Disc"\r\nFILE "a.wav" WAVE\r\n'), F.array_join(F.transform("keys", track), "\r\n"))
    files = listed.select(F.col("o_custkey").cast("string").alias("source"), text.alias("text"))
    return L.parse_cue(files, 44100).select("source", "track", "title", "start", "end", "label")
