"""Queries on tables of which one stream, host or partition is larger than in the driver's small ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from packetloom.functions import bits
from packetloom.operators import scan
from packetloom.plans import ORACLE_SQL, QUERIES


def same(spark, folder, name, tables):
    """The query gives what its SQL gives on these tables."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert got and got == sorted(repr(list(r)) for r in want)


@pytest.mark.parametrize("name", ["live_source", "live_source_late", "live_source_discontinuity"])
def test_clock_of_a_host_with_many_pages(spark, tmp_path, name):
    """The 331st segment of a list begins after 2**31 microseconds."""
    duckdb.sql(f"COPY (SELECT i AS page_id, 'https://a.example/' || i AS url, '' AS html FROM range(0, 340) AS r(i)) TO '{tmp_path}/pages.parquet'")
    same(spark, tmp_path, name, ["pages"])


def test_files_are_not_cut_between_partitions(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT i AS vec_id, [sin(i * 64 + k)::FLOAT for k in range(0, 64)] AS embedding FROM range(0, 300) AS r(i)) TO '{tmp_path}/embeddings.parquet'")
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        same(spark, tmp_path, "pcm_file_ranges", ["embeddings"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["lacing_expand", "lacing_coded"])
def test_laces_are_summed_in_their_row(spark, tmp_path, name):
    """Blocks of thousands of frames, of one, of none and of a NULL text, without a shuffle."""
    duckdb.sql(f"""COPY (SELECT * FROM (VALUES (1, repeat('ab cdefg h ', 3000)), (2, NULL), (3, ''), (4, repeat('x', 1000) || ' y ' || repeat('zz', 400)), (5, ' '), (6, repeat('é ', 500))) AS t(doc_id, text))
        TO '{tmp_path}/documents.parquet'""")
    same(spark, tmp_path, name, ["documents"])
    assert "Exchange" not in QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_sums_before(spark):
    lists = [[3, None, 4], None, [], [5], [None, 2, 1]]
    rows = spark.createDataFrame([(x,) for x in lists], "v array<bigint>").coalesce(1).select(bits.sums_before(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == [[0, 3, 3], None, [], [0], [0, 0, 2]]


def test_blocks_of_pieces_are_a_short_expression(spark):
    """Not one that names every border, several times, for each row."""
    pieces = scan.Pieces(tuple(range(10_000_001, 10_000_141)), (7,) * 141)
    rows = spark.range(3).select(scan.block_of(F.col("id") + 10_000_050, pieces).alias("b"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("10000099") == 0
    assert [r.b for r in rows.orderBy("b").collect()] == [k * scan.SPAN for k in (50, 51, 52)]


def _orders(folder, n):
    """n orders of lines, one of ten of a customer who isn't known, one of twenty without lines; lines of no order, and some twice."""
    def copy(sql, name):
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet'")

    copy("SELECT i AS c_custkey, CAST(i % 25 AS INTEGER) AS c_nationkey FROM range(0, 90) AS r(i)", "customer")
    copy(f"SELECT i AS o_orderkey, i * 7 % 100 AS o_custkey FROM range(0, {n}) AS r(i) UNION ALL SELECT {n}, NULL", "orders")
    copy(
        f"""SELECT o AS l_orderkey, k * 31 % 40 AS l_partkey, CAST(k % 5 + 1 AS INTEGER) AS l_linenumber, CASE WHEN k % 9 > 0 THEN k % 11 + 0.5 END AS l_quantity, CASE (o + k) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS l_returnflag
        FROM range(0, {n + 5}) AS r(o), range(0, 8) AS s(k), range(0, 2) AS t(j) WHERE o % 20 > 0 AND (j = 0 OR k % 7 = 0)""",
        "lineitem",
    )


def test_fragments_of_unknown_tracks_and_runs_that_are_told_in_vain(spark, tmp_path):
    _orders(tmp_path, 400)
    same(spark, tmp_path, "fragment_samples", ["customer", "orders", "lineitem"])


def test_samples_of_fragments_are_shuffled_three_times(spark, tmp_path):
    """By order, by fragment and by block of the track; what else is shuffled has a row a fragment or track."""
    _orders(tmp_path, 2000)
    context = spark.sparkContext._jsc.sc()
    store, first = context.statusStore(), context.dagScheduler().nextStageId()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        QUERIES["fragment_samples"](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    context.listenerBus().waitUntilEmpty()
    shuffled = 0
    for stage in range(first, context.dagScheduler().nextStageId()):
        try:
            shuffled += store.lastStageAttempt(stage).shuffleWriteRecords()
        except Exception as e:  # stages that were planned and never sent
            assert "NoSuchElement" in str(e)
    lines, orders = (spark.read.parquet(f"{tmp_path}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert 2 * lines < shuffled < 3 * lines + 9 * orders, (shuffled, lines, orders)
