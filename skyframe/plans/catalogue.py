"""Registered queries by name, and their SQL twins."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..codecs import tiles as codec
from ..format import tables
from ..functions import checksum
from ..functions import columns as C
from ..operators import edits, sky, subint, tiles
from ..sources import files
from ..sources.compressed import write_compressed_image, write_compressed_pixels
from ..sources.fits import fits_columns, fits_hdus, fits_headers, read_fits, read_fits_content, resize_image, write_fits, write_image, write_pixels, write_rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path for a file, in the folder that the cluster shares if there is one."""
    base = files.local(spark.conf.get("spark.checkpoint.dir", None) or "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a mounted folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="skyframe-")
    os.makedirs(base, exist_ok=True)
    return f"{base}/fits-{uuid.uuid4().hex}"


LINE = {"l_returnflag": "1A", "l_linestatus": "1A"}
NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def round_trip(df: DataFrame, read: dict | None = None, **options) -> DataFrame:
    path = scratch(df.sparkSession)
    write_fits(df, path, **options)
    return read_fits(df.sparkSession, path, **(read or {}))


@query(f"SELECT {', '.join(NUMBERS)}, epoch_us(l_shipdate)::BIGINT AS l_shipdate FROM lineitem")
def bintable_scan(spark, sf):
    return round_trip(table(spark, sf, "lineitem").select(*NUMBERS, "l_shipdate"), tform=LINE)


@query("SELECT l_returnflag, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_quantity < 30 GROUP BY 1")
def bintable_filter_agg(spark, sf):
    d = round_trip(table(spark, sf, "lineitem").select(*NUMBERS), {"columns": "l_returnflag,l_quantity,l_extendedprice"}, tform=LINE)
    return d.where("l_quantity < 30").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("SELECT row::BIGINT AS row, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS row, o_orderkey FROM orders) WHERE row BETWEEN 101 AND 250")
def bintable_row_range(spark, sf):
    d = round_trip(table(spark, sf, "orders").select("o_orderkey").coalesce(1).sortWithinPartitions("o_orderkey"), {"rowid": "true"}, single=True)
    return d.where("_row between 101 and 250").withColumnRenamed("_row", "row")


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def asciitable_roundtrip(spark, sf):
    return round_trip(table(spark, sf, "supplier"), kind="ascii", tform={"s_suppkey": "I12", "s_name": "A25", "s_nationkey": "I4", "s_acctbal": "F14.2"})


@query("SELECT * FROM nation")
def gzip_roundtrip(spark, sf):
    return round_trip(table(spark, sf, "nation"), compression="gzip", tform={"n_name": "25A"})


@query("SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS open, l_linestatus = 'O' AS bit1, l_returnflag = 'R' AS bit2 FROM lineitem")
def bool_bit_roundtrip(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").alias("open"), F.array(F.col("l_linestatus") == "O", F.col("l_returnflag") == "R").alias("bits"))
    return round_trip(d, tform={"bits": "2X"}).select("l_orderkey", "l_linenumber", "open", F.col("bits")[0].alias("bit1"), F.col("bits")[1].alias("bit2"))


@query("SELECT l_orderkey, l_linenumber, nullif(l_quantity, 50)::INTEGER AS q FROM lineitem")
def null_tnull_roundtrip(spark, sf):
    return round_trip(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("nullif(l_quantity, 50)").cast("int").alias("q")), tnull={"q": -1})


@query("SELECT p_partkey, (p_size - 25)::TINYINT AS s, (p_size + 40000)::INTEGER AS u, (p_partkey + 3000000000)::BIGINT AS v, ((p_partkey::DECIMAL(20, 0) + 9223372036854775808)::DECIMAL(20, 0))::VARCHAR AS w FROM part")
def unsigned_offset(spark, sf):
    p = table(spark, sf, "part")
    d = p.select("p_partkey", (F.col("p_size") - 25).cast("byte").alias("s"), (F.col("p_size") + 40000).alias("u"), (F.col("p_partkey") + 3000000000).alias("v"), (F.col("p_partkey").cast("decimal(19,0)") + F.expr("9223372036854775808BD")).cast("decimal(20,0)").alias("w"))
    return round_trip(d, tform={"s": "1S", "u": "1U", "v": "1V", "w": "1W"}).withColumn("w", F.col("w").cast("string"))


@query("SELECT l_orderkey, l_linenumber, round((l_discount - 0.05) / 0.01)::BIGINT AS stored, round(round((l_discount - 0.05) / 0.01) * 0.01 + 0.05, 6) AS physical FROM lineitem")
def linear_scale_i16(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.to_stored(F.col("l_discount"), 0.01, 0.05).alias("stored"))
    return d.withColumn("physical", F.round(C.to_physical(F.col("stored"), 0.01, 0.05), 6))


@query("SELECT vec_id, label, unnest(range(1, 65))::INTEGER AS elem, unnest(embedding)::FLOAT AS elem_value FROM embeddings")
def vector_explode(spark, sf):
    d = round_trip(table(spark, sf, "embeddings"), tform={"embedding": "64E"}, tdim={"embedding": "(8,8)"})
    return C.explode_cells(d, "embedding").select("vec_id", "label", "elem", "elem_value")


@query("SELECT e::BIGINT AS e, ((e - 1) % 8 + 1)::BIGINT AS x, ((e - 1) // 8 + 1)::BIGINT AS y, e::BIGINT AS back FROM range(1, 65) t(e)")
def tdim_index(spark, sf):
    d = spark.range(1, 65).withColumnRenamed("id", "e")
    x, y = C.tdim_coords([8, 8], F.col("e"))
    d = d.withColumns({"x": x, "y": y})
    return d.withColumn("back", C.tdim_elem([8, 8], [F.col("x"), F.col("y")]))


@query("SELECT l_orderkey, unnest(list(l_quantity ORDER BY l_linenumber, l_quantity)) AS q, unnest(range(1, count(*) + 1))::INTEGER AS n FROM lineitem GROUP BY l_orderkey")
def vla_roundtrip(spark, sf):
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(pairs, lambda x: x["l_quantity"]).alias("q"))
    return round_trip(d, tform={"q": "1PD"}).select("l_orderkey", F.posexplode("q").alias("n", "q")).withColumn("n", F.col("n") + 1)


@query("SELECT row::BIGINT AS row, key FROM (SELECT row_number() OVER (ORDER BY n_nationkey) + CASE WHEN row_number() OVER (ORDER BY n_nationkey) > 5 THEN 2 ELSE 0 END AS row, n_nationkey AS key FROM nation UNION ALL VALUES (6, NULL), (7, NULL)) WHERE row < 20")
def row_insert_delete(spark, sf):
    n = table(spark, sf, "nation").select(F.row_number().over(Window.orderBy("n_nationkey")).cast("long").alias("_row"), F.col("n_nationkey").alias("key"))
    return edits.delete_rows(edits.insert_rows(n, 5, 2), 20, 100).withColumnRenamed("_row", "row")


@query("SELECT l_shipdate, l_orderkey FROM lineitem")
def col_glob(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.select(*edits.find_columns(d, "L_SHIP*"), edits.find_column(d, "l_orderk?y"))


@query("SELECT c_custkey, rpad('CUSTKEY = ' || lpad(c_custkey::VARCHAR, 20, ' ') || ' / key', 80, ' ') AS num, rpad('NAME    = ''' || rpad(c_name, greatest(8, length(c_name))::INTEGER, ' ') || '''', 80, ' ') AS str, rpad('HIERARCH A LONG NAME = ' || c_custkey::VARCHAR || ' / key', 80, ' ') AS long, 'NAME    = ''' || substr(rpad(c_name, 75, 'x'), 1, 68) || '''' AS cut, rpad('HIERARCH ' || repeat('N', 25) || '= ''' || substr(rpad(c_name, 75, 'y'), 1, 42) || '''', 80, ' ') AS tight FROM customer")
def card_format(spark, sf):
    """Short and long names, a string too long for its card, and one that leaves no room for the blank before =."""
    c = table(spark, sf, "customer")
    long_ = lambda n, fill: C.quote(F.rpad("c_name", F.lit(n), F.lit(fill)))
    return c.select(
        "c_custkey", C.card(F.lit("CUSTKEY"), F.col("c_custkey").cast("string"), F.lit("key")).alias("num"), C.card(F.lit("NAME"), C.quote(F.col("c_name"))).alias("str"),
        C.card(F.lit("A LONG NAME"), F.col("c_custkey").cast("string"), F.lit("key")).alias("long"), C.card(F.lit("NAME"), long_(75, "x")).alias("cut"),
        C.card(F.lit("N" * 25), long_(42, "y")).alias("tight"),
    )


@query("SELECT c_custkey, 'NAME' AS keyword, c_name AS value, 'of ' || c_mktsegment AS comment, 150 AS class FROM customer")
def card_parse(spark, sf):
    c = table(spark, sf, "customer").withColumn("card", C.card(F.lit("NAME"), C.quote(F.col("c_name")), F.concat(F.lit("of "), "c_mktsegment")))
    card = F.col("card")
    return c.select("c_custkey", C.card_keyword(card).alias("keyword"), C.unquote(C.card_value(card)).alias("value"), C.card_comment(card).alias("comment"), C.key_class(card).alias("class"))


KEYS = [("SIMPLE", 10), ("ZIMAGE", 20), ("TSCAL1", 30), ("TNULL3", 40), ("TDIM2", 50), ("DATAMAX", 60), ("TUNIT9", 70), ("TDISP1", 80), ("EXTNAME", 90), ("CHECKSUM", 100), ("CRVAL1", 110), ("DATE-OBS", 120), ("COMMENT", 130), ("CONTINUE", 140), ("OBJECT", 150)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {c})" for k, c in KEYS) + ") t(keyword, class)")
def key_class(spark, sf):
    return spark.createDataFrame([(k,) for k, _ in KEYS], "keyword string").withColumn("class", C.key_class(F.col("keyword")))


@query("SELECT doc_id, i::INTEGER AS n, 'COMMENT ' || substr(text, (i - 1) * 72 + 1, 72) AS card FROM (SELECT doc_id, text, unnest(range(1, greatest(ceil(length(text) / 72.0)::INTEGER, 1) + 1)) AS i FROM documents)")
def comment_chunks(spark, sf):
    return C.comment_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", F.col("n").cast("int"), "card")


@query("SELECT o_orderkey, printf('%.5E', o_totalprice) AS e, printf('%.1f', o_totalprice) AS f FROM orders")
def number_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.number_text(F.col("o_totalprice"), 5, True).alias("e"), C.number_text(F.col("o_totalprice"), 1, False).alias("f"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, true AS valid FROM orders")
def fits_datetime(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", C.fits_datetime(F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000000)).alias("date"))
    return d.withColumn("valid", C.is_fits_date(F.col("date")))


IMAGE = "SELECT row_number() OVER (ORDER BY p_partkey) AS pix, p_size AS value FROM part"


def part_image(spark, sf) -> DataFrame:
    """Sizes of parts in order of their dense key from 0: pixel numbers without a window over all rows."""
    return table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("_pix"), F.col("p_size").alias("value"))


def price_image(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("_pix"), F.col("p_retailprice").alias("value"))


@query("SELECT (p_partkey + 1)::BIGINT AS pix, (p_size + 40000)::INTEGER AS value FROM part")
def image_write_read_u16(spark, sf):
    d, path = part_image(spark, sf), scratch(spark)
    n = d.agg(F.max("_pix")).first()[0]
    write_image(d.withColumn("value", F.col("value") + 40000), path, [n], "u16")
    return read_fits(spark, path, hdu=1).select(F.col("_pix").alias("pix"), "value")


def whole_rows(d: DataFrame, width: int = 50) -> tuple[DataFrame, int, int]:
    """(d with pixels of 0 up to the end of its last row, rows, pixels before)."""
    n = d.agg(F.max("_pix")).first()[0]
    rows = -(-n // width)
    fill = d.sparkSession.range(n + 1, width * rows + 1).select(F.col("id").alias("_pix"), F.lit(0).cast(d.schema["value"].dataType).alias("value"))
    return d.unionByName(fill), rows, n


def _zimage(name: str):
    @query("SELECT (p_partkey + 1)::BIGINT AS pix, (p_size + 40000)::INTEGER AS value FROM part")
    def f(spark, sf):
        (d, rows, n), path = whole_rows(part_image(spark, sf)), scratch(spark)
        write_compressed_image(d.withColumn("value", F.col("value") + 40000), path, [50, rows], "u16", name)
        return read_fits(spark, path, hdu=2).where(F.col("_pix") <= n).select(F.col("_pix").alias("pix"), "value")

    return f


for _name in ("RICE_1", "GZIP_2", "HCOMPRESS_1"):
    _zimage(_name)
    QUERIES[f"zimage_{_name.lower()}"] = QUERIES.pop("f")
    ORACLE_SQL[f"zimage_{_name.lower()}"] = ORACLE_SQL.pop("f")


@query("SELECT (p_partkey + 1)::BIGINT AS pix, p_retailprice::DOUBLE AS value FROM part")
def zimage_whole_floats(spark, sf):
    (d, rows, n), path = whole_rows(price_image(spark, sf)), scratch(spark)
    write_compressed_image(d, path, [50, rows], "f64", "GZIP_2", tile=[16, 8], level=0)
    return read_fits(spark, path, hdu=2).where(F.col("_pix") <= n).select(F.col("_pix").alias("pix"), "value")


@query("SELECT (p_partkey + 1)::BIGINT AS pix, CASE WHEN p_partkey BETWEEN 9 AND 70 AND p_partkey % 3 = 1 THEN p_size + 500 ELSE p_size + 40000 END::INTEGER AS value FROM part")
def zimage_partial_write(spark, sf):
    """Some pixels of a compressed image written anew: only their tiles are coded again."""
    (d, rows, n), path = whole_rows(part_image(spark, sf)), scratch(spark)
    write_compressed_image(d.withColumn("value", F.col("value") + 40000), path, [50, rows], "u16", tile=[16, 8])
    write_compressed_pixels(d.where("_pix between 10 and 71 and _pix % 3 = 2").withColumn("value", F.col("value") + 500), path)
    return read_fits(spark, path, hdu=2).where(F.col("_pix") <= n).select(F.col("_pix").alias("pix"), "value")


@query("SELECT min(p_retailprice::FLOAT) AS low, max(p_retailprice::FLOAT) AS high, count(*)::BIGINT AS n FROM part")
def image_minmax_f32(spark, sf):
    d, path = table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("_pix"), F.col("p_retailprice").alias("value")), scratch(spark)
    n = d.agg(F.max("_pix")).first()[0]
    write_image(d, path, [n], "f32")
    return read_fits(spark, path, hdu=1).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


GRID = "SELECT p_partkey, p_size, p_partkey % 50 AS x, p_partkey // 50 AS y FROM part"


@query(f"SELECT ((x // 16) + 4 * (y // 8) + 1)::BIGINT AS tile, sum(p_size)::BIGINT AS total, count(*)::BIGINT AS n FROM ({GRID}) GROUP BY 1")
def tile_enumerate(spark, sf):
    d = part_image(spark, sf)
    rows = d.agg(F.ceil(F.max("_pix") / 50)).first()[0]
    number, _ = tiles.tile_of(F.col("_pix"), [50, rows], [16, 8])
    return d.groupBy(number.alias("tile")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def _codec(name: str, bytepix: int):
    @query("SELECT (p_partkey + 1)::BIGINT AS pix, p_size::BIGINT AS value FROM part")
    def f(spark, sf):
        d, rows, n = whole_rows(part_image(spark, sf))
        axes, shape = [50, rows], [50, 8]
        cut = tiles.gather(d, axes, shape)
        back = tiles.decompress(tiles.compress(cut, name, bytepix, axes, shape), name, bytepix)
        return tiles.scatter(back, axes, shape).withColumnRenamed("_pix", "pix").where(F.col("pix") <= n)

    return f


for _name, _bytes in (("RICE_1", 2), ("GZIP_1", 4), ("GZIP_2", 4), ("PLIO_1", 4), ("HCOMPRESS_1", 4), ("NOCOMPRESS", 2)):
    QUERIES.pop("f", None)
    _f = _codec(_name, _bytes)
    QUERIES[f"tile_{_name.lower()}"] = QUERIES.pop("f")
    ORACLE_SQL[f"tile_{_name.lower()}"] = ORACLE_SQL.pop("f")


@query("SELECT (y + 1)::BIGINT AS tile, true AS close FROM (SELECT DISTINCT p_partkey // 50 AS y FROM part)")
def quantize_roundtrip(spark, sf):
    """The largest error of each tile in steps: half a step at most."""
    d, rows, _ = whole_rows(price_image(spark, sf))
    cut = tiles.gather(d, [50, rows], [50, 1])
    q = tiles.quantize(cut)
    back = tiles.dequantize(q).withColumnRenamed("values", "back")
    off = F.array_max(F.zip_with("values", "back", lambda a, b: F.abs(a - b)))
    return cut.join(back, "tile").join(q.select("tile", "step"), "tile").select("tile", (off <= F.coalesce(F.col("step"), F.lit(0.0)) * 0.5000001).alias("close"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) AS diff FROM lineitem")
def adjacent_diff(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") - F.lag("l_quantity").over(w)).alias("diff"))


@query("WITH RECURSIVE g(i, s) AS (SELECT 0, 16807::BIGINT UNION ALL SELECT i + 1, s * 16807 % 2147483647 FROM g WHERE i < 9999) SELECT i, (s::DOUBLE / 2147483647)::FLOAT::DOUBLE AS value FROM g")
def dither_table(spark, sf):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(codec.dither_table())], "i int, value double")


@query("SELECT l_returnflag, CASE WHEN sum(l_orderkey) = 0 THEN 0 ELSE ((sum(l_orderkey * 65536 + l_partkey) - 1) % 4294967295 + 1) END::BIGINT AS sum FROM lineitem GROUP BY 1")
def checksum_words(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.groupBy("l_returnflag").agg(checksum.fold_column(F.sum(F.col("l_orderkey") * 65536 + F.col("l_partkey"))).alias("sum"))


@query("SELECT o_orderkey, o_orderkey * 4093 % 4294967295 AS value FROM orders")
def checksum_text(spark, sf):
    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda v: checksum.encode(int(v)))

    d = table(spark, sf, "orders").select("o_orderkey", text(F.col("o_orderkey") * 4093 % 4294967295).alias("t"))
    return d.select("o_orderkey", checksum.decode_column(F.col("t")).alias("value"))


REF = {"ref": (45.83, 63.57), "pix": (256.0, 257.0), "inc": (-0.00277777, 0.00277777)}
_A = "0.01745329252"
_TAN = f"""SELECT p_partkey, (p_size - 256.0) * -0.00277777 * {_A} AS l, (p_partkey % 512 - 257.0) * 0.00277777 * {_A} AS m, 45.83 * {_A} AS ra0, 63.57 * {_A} AS dec0 FROM part"""
_XYZ = f"SELECT p_partkey, cos(dec0) * cos(ra0) - l * sin(ra0) - m * cos(ra0) * sin(dec0) AS a, cos(dec0) * sin(ra0) + l * cos(ra0) - m * sin(ra0) * sin(dec0) AS b, sin(dec0) + m * cos(dec0) AS z FROM ({_TAN})"


@query(f"SELECT p_partkey, round(atan2(b, a) / {_A}, 8) AS lon, round(atan(z / sqrt(a * a + b * b)) / {_A}, 8) AS lat FROM ({_XYZ})")
def wcs_tan(spark, sf):
    lon, lat = C.pix_to_world(F.col("p_size"), F.col("p_partkey") % 512, **REF)
    return table(spark, sf, "part").select("p_partkey", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 512)::DOUBLE AS y FROM part")
def wcs_inverse(spark, sf):
    d = table(spark, sf, "part")
    lon, lat = C.pix_to_world(F.col("p_size"), F.col("p_partkey") % 512, **REF)
    x, y = C.world_to_pix(F.col("lon"), F.col("lat"), **REF)
    return d.select("p_partkey", lon.alias("lon"), lat.alias("lat")).select("p_partkey", (F.round(x, 5) + 0.0).alias("x"), (F.round(y, 5) + 0.0).alias("y"))


@query(f"SELECT p_partkey, round((45.83 * {_A} + (p_size - 256.0) * -0.00277777 * {_A}) / {_A}, 8) AS lon, round((63.57 * {_A} + (p_partkey % 512 - 257.0) * 0.00277777 * {_A}) / {_A}, 8) AS lat FROM part")
def wcs_car(spark, sf):
    lon, lat = C.pix_to_world(F.col("p_size"), F.col("p_partkey") % 512, projection="-CAR", **REF)
    return table(spark, sf, "part").select("p_partkey", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


def _nbit(n: int):
    @query(f"SELECT (event_id // {8 // n})::BIGINT AS byte_index, sum((event_id % {1 << n}) * (1 << ({8 - n} - {n} * (event_id % {8 // n})))::BIGINT)::BIGINT AS byte FROM events GROUP BY 1")
    def packed(spark, sf):
        return C.pack(table(spark, sf, "events").select("event_id", (F.col("event_id") % (1 << n)).alias("s")), "event_id", "s", n)

    @query(f"SELECT e::BIGINT AS sample_index, CASE WHEN e % {1 << n} >= {1 << (n - 1)} AND {n} > 1 THEN e % {1 << n} - {1 << n} ELSE e % {1 << n} END::BIGINT AS sample FROM (SELECT unnest(range(0, (SELECT (max(event_id) // {8 // n} + 1) * {8 // n} FROM events))) AS e) WHERE e <= (SELECT max(event_id) FROM events)")
    def unpacked(spark, sf):
        out = C.unpack(packed(spark, sf), "byte_index", "byte", n)
        most = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
        return out.where(F.col("sample_index") <= most).select("sample_index", (C.signed(F.col("sample"), n) if n > 1 else F.col("sample")).alias("sample"))

    for f in (packed, unpacked):
        for d in (QUERIES, ORACLE_SQL):
            d[f"nbit_{f.__name__}_{n}"] = d.pop(f.__name__)


for _n in (1, 2, 4, 8):
    _nbit(_n)


@query("SELECT vec_id, i - 1 AS i, plane, plane % 4 AS chan, round((v * 100 - 2) * (plane + 0.5) + plane * 10, 3) AS physical FROM (SELECT vec_id, i, (i - 1) // 8 AS plane, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))")
def cube_scale_fold(spark, sf):
    """Cells of 64 as (8 bins, 4 channels, 2 polarisations), calibrated by plane."""
    d = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    plane, chan = C.fold_index(F.col("i"), 8, 4)
    d = d.select("vec_id", F.col("i").cast("long").alias("i"), plane.alias("plane"), chan.alias("chan"), F.col("v").cast("double").alias("v"))
    raw = F.col("v") * 100
    return d.select("vec_id", "i", "plane", "chan", F.round(C.calibrate(raw, F.col("plane") + 0.5, F.col("plane") * 10, 2), 3).alias("physical"))


@query("SELECT (e)::BIGINT AS i, (e % 8)::BIGINT AS plane, (e % 4)::BIGINT AS chan FROM range(0, 64) t(e)")
def cube_index_search(spark, sf):
    plane, chan = C.search_index(F.col("id"), 4, 2)
    return spark.range(64).select(F.col("id").alias("i"), plane.alias("plane"), chan.alias("chan"))


@query("SELECT code::INTEGER AS code, text FROM (VALUES (0, 'OK - no error'), (104, 'could not open the named file'), (412, 'datatype conversion overflow'), (600, 'unknown error status')) t(code, text)")
def status_text(spark, sf):
    return spark.createDataFrame([(c,) for c in (0, 104, 412, 600)], "code int").withColumn("text", C.status_text(F.col("code")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def hdu_surgery(spark, sf):
    """The nation table copied behind others, and these deleted."""
    path = scratch(spark)
    write_fits(table(spark, sf, "nation"), path, single=True, tform={"n_name": "25A"})
    a, b = edits.Container.open(path), edits.Container()
    a.copy(2, b)
    b.insert(1, a.units[0][0])
    b.delete(2)
    out = scratch(spark)
    with open(out, "wb") as f:
        f.write(b.to_bytes())
    return read_fits(spark, out)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(round((l_discount - 0.05) / 0.01) * 0.01 + 0.05, 6) AS physical FROM lineitem")
def scaled_column_file(spark, sf):
    """A column stored as 16-bit integers with a scale and an offset."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("physical"))
    return round_trip(d, tform={"physical": "1I"}, tscal={"physical": 0.01}, tzero={"physical": 0.05}).withColumn("physical", F.round("physical", 6))


_ROT = f"""SELECT p_partkey, (dx * cos(10 * {_A}) - dy * sin(10 * {_A})) * {_A} AS l, (dy * cos(10 * {_A}) + dx * sin(10 * {_A})) * {_A} AS m, 45.83 * {_A} AS ra0, 63.57 * {_A} AS dec0
FROM (SELECT p_partkey, (p_size - 256.0) * -0.00277777 AS dx, (p_partkey % 512 - 257.0) * 0.00277777 AS dy FROM part)"""


@query(f"SELECT p_partkey, round(atan2(b, a) / {_A}, 8) AS lon, round(atan(z / sqrt(a * a + b * b)) / {_A}, 8) AS lat FROM ({_XYZ.replace(_TAN, _ROT)})")
def wcs_header(spark, sf):
    """Pixels to the sky by the parameters of a file's header, with a rotation."""
    path = scratch(spark)
    cards = [["CRVAL1", 45.83], ["CRVAL2", 63.57], ["CRPIX1", 256.0], ["CRPIX2", 257.0], ["CDELT1", -0.00277777], ["CDELT2", 0.00277777], ["CROTA2", 10.0], ["CTYPE1", "RA---TAN"]]
    write_fits(table(spark, sf, "part").select("p_partkey", "p_size"), path, single=True, cards={"cards": cards})
    with files.open_bytes(path) as f:
        where = sky.img_coord(files.scan(f)[1].header)
    d = read_fits(spark, path)
    lon, lat = C.pix_to_world(F.col("p_size"), F.col("p_partkey") % 512, **where)
    return d.select("p_partkey", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


def _subint(spark, d: DataFrame, cards: dict, **options) -> str:
    """A SUBINT table of one file, its rows in the order of vec_id."""
    path = scratch(spark)
    write_fits(d.coalesce(1).sortWithinPartitions("vec_id"), path, single=True, extname="SUBINT", cards={"cards": [[k, v] for k, v in cards.items()]}, **options)
    return path


_CELLS = "SELECT vec_id, label, i, embedding[i + 1]::DOUBLE AS v, row_number() OVER (PARTITION BY i ORDER BY vec_id) AS row FROM (SELECT vec_id, label, embedding, unnest(range(0, 64)) AS i FROM embeddings)"


@query(f"SELECT row::BIGINT AS row, i::INTEGER AS i, round((round(v * 1000) - 3) * (i // 8 + 1) * 0.5 + (i // 8) - 2, 6) AS value FROM ({_CELLS})")
def subint_fold(spark, sf):
    """Cells of 64 as 8 bins, 4 channels and 2 polarisations of 16 bits, calibrated by plane."""
    d = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("short")).alias("DATA"),
        F.array(*[F.lit((p + 1) * 0.5).cast("float") for p in range(8)]).alias("DAT_SCL"), F.array(*[F.lit(p - 2.0).cast("float") for p in range(8)]).alias("DAT_OFFS"),
    )
    path = _subint(spark, d, {"NPOL": 2, "NBIN": 8, "NCHAN": 4, "NBITS": 16, "NSBLK": 1, "ZERO_OFF": 3}, tform={"DATA": "64I", "DAT_SCL": "8E", "DAT_OFFS": "8E"}, tdim={"DATA": "(8,4,2)"})
    out = subint.read_subint_data(spark, path, extname="SUBINT")
    return out.select(F.col("_row").alias("row"), F.posexplode("values").alias("i", "value")).withColumn("value", F.round("value", 6))


def _search(signed: bool):
    sample = "((label + i) % 4)" if not signed else "(CASE WHEN (label + i) % 4 >= 2 THEN (label + i) % 4 - 4 ELSE (label + i) % 4 END)"

    @query(f"SELECT row::BIGINT AS row, i::INTEGER AS i, round(({sample} - 1.5) * 1.0 * (i % 4 + 1) * 0.25, 6) AS value FROM ({_CELLS})")
    def f(spark, sf):
        """64 samples of 2 bits in 16 bytes, as 4 channels, 2 polarisations and 8 times; no scales, but weights of channels."""
        byte = lambda b: sum((((F.col("label") + 4 * b + k) % 4) * (1 << (6 - 2 * k)) for k in range(4)), F.lit(0)).cast("short")
        d = table(spark, sf, "embeddings").select("vec_id", F.array(*[byte(b) for b in range(16)]).alias("DATA"), F.array(*[F.lit((c + 1) * 0.25).cast("float") for c in range(4)]).alias("DAT_WTS"))
        path = _subint(spark, d, {"NPOL": 2, "NCHAN": 4, "NBITS": 2, "NSBLK": 8, "ZERO_OFFS": 1.5, "SIGNINT": int(signed)}, tform={"DATA": "16B", "DAT_WTS": "4E"})
        out = subint.read_subint_data(spark, path, extname="SUBINT", weights=True)
        return out.select(F.col("_row").alias("row"), F.posexplode("values").alias("i", "value")).withColumn("value", F.round("value", 6))

    return f


for _name, _signed in (("subint_search", False), ("subint_search_signed", True)):
    _search(_signed)
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


@query(f"SELECT vec_id, i::INTEGER AS i, round(v, 4) + 0.0 AS raw FROM ({_CELLS})")
def cube_unscale(spark, sf):
    """Calibrated and back."""
    d = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    plane, _ = C.fold_index(F.col("i"), 8, 4)
    x = C.calibrate(F.col("v").cast("double"), plane + 0.5, plane * 10, 2)
    return d.select("vec_id", "i", F.round(C.uncalibrate(x, plane + 0.5, plane * 10, 2), 4).alias("raw")).withColumn("raw", F.col("raw") + 0.0)


EDITED = [
    ("OBJECT", "'M 31    '", "a galaxy"), ("EXPOSURE", "1.50000E+03", "[ms] how long"), ("NEWNAME", "7", "was old"), ("FLAG", "T", ""), ("HISTORY", "", "made by hand"), ("COMMENT", "", "c" * 72), ("COMMENT", "", "c" * 8),
    ("LONGSTR", "'" + "x" * 67 + "&'", ""), ("CONTINUE", "'" + "x" * 33 + "'", ""), ("A LONG NAME", "3", ""), ("KEY1", "10", "of 2"), ("KEY2", "20", "of 2"), ("TEMPL", "'word    '", "from a template"), ("MJD", "51234.2500000000000000", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{v.replace(chr(39), chr(39) * 2)}', '{c}')" for i, (k, v, c) in enumerate(EDITED, 1)) + ") t(n, keyword, value, comment)")
def header_edits(spark, sf):
    """A header's cards written, updated, renamed, deleted, templated, continued; read back as rows."""
    path, out = scratch(spark), scratch(spark)
    write_fits(table(spark, sf, "nation").select("n_nationkey"), path, single=True)
    box = edits.Container.open(path)
    h = box.units[1][0]
    first = len(h) + 1
    h.write("OBJECT", "M 30", "a galaxy").write("GONE", 1).write("EXPOSURE", 1500.0, "how long", decimals=5).write("OLDNAME", 7, "was old").write("FLAG", False)
    h.update("OBJECT", "M 31").modify("FLAG", True).rename("OLDNAME", "NEWNAME").delete("GONE").set_unit("EXPOSURE", "ms")
    h.comment("made by hand", "HISTORY").comment("c" * 80).write_long("LONGSTR", "x" * 100).write("A LONG NAME", 3).write_keys("KEY", [10, 20], comment="of 2")
    h.template(["TEMPL = word / from a template", "-NOTHERE"]).write_time("MJD", 51234, 0.25)
    with open(out, "wb") as f:
        f.write(box.to_bytes())
    cards = fits_headers(spark, out).where((F.col("hdu") == 2) & (F.col("idx") >= first))
    return cards.select((F.col("idx") - (first - 1)).alias("n"), "keyword", "value", "comment")


@query("SELECT ((sum(k // 4294967296 + k % 4294967296) - 1) % 4294967295 + 1)::BIGINT AS datasum, 1 AS data_right, 1 AS hdu_right FROM (SELECT l_orderkey * 1000003 + l_partkey AS k FROM lineitem)")
def file_checksum(spark, sf):
    """The sums that a file's cards hold, and whether they are right."""
    path = scratch(spark)
    write_fits(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 1000003 + F.col("l_partkey")).alias("k")), path, single=True, checksum=True)
    header, data = edits.Container.open(path).units[1]
    right = checksum.verify(header, header.to_bytes(), tables.padded(data))
    d = fits_headers(spark, path).where("hdu = 2 and keyword = 'DATASUM'").select(C.unquote(F.col("value")).cast("long").alias("datasum"))
    return d.withColumns({"data_right": F.lit(right[0]), "hdu_right": F.lit(right[1])})


@query("SELECT * FROM (VALUES (1, 'image', NULL, 0), (2, 'binary', 'ROWS', (SELECT count(*) * 8 FROM supplier)), (3, 'image', NULL, (SELECT count(*) * 2 FROM part))) t(hdu, type, extname, data_bytes)")
def hdu_list(spark, sf):
    """A table with an image appended to its file."""
    path = scratch(spark)
    write_fits(table(spark, sf, "supplier").select("s_suppkey"), path, single=True, extname="ROWS")
    d = part_image(spark, sf)
    write_image(d, path, [d.agg(F.max("_pix")).first()[0]], "i16", append=True)
    return fits_hdus(spark, path).select("hdu", "type", "extname", "data_bytes")


@query("SELECT n::BIGINT AS row, printf('%08x%08x', n_nationkey, n_regionkey) AS cells FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation)")
def raw_rows(spark, sf):
    path = scratch(spark)
    write_fits(table(spark, sf, "nation").select("n_nationkey", "n_regionkey").coalesce(1).sortWithinPartitions("n_nationkey"), path, single=True)
    return read_fits(spark, path, raw=True).select("row", F.lower(F.hex("bytes")).alias("cells"))


@query("SELECT n::BIGINT AS row, CASE WHEN n = 3 THEN 77 ELSE key END::INTEGER AS key FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS n, n_nationkey AS key FROM nation) UNION ALL SELECT count(*) + 1, 0 FROM nation UNION ALL SELECT count(*) + 2, 78 FROM nation")
def raw_row_write(spark, sf):
    """A row replaced and one written past the end: the table grows."""
    path = scratch(spark)
    d = table(spark, sf, "nation").select("n_nationkey")
    write_fits(d.coalesce(1).sortWithinPartitions("n_nationkey"), path, single=True)
    rows = spark.createDataFrame([(3, bytearray((77).to_bytes(4))), (d.count() + 2, bytearray((78).to_bytes(4)))], "row long, bytes binary")
    write_rows(rows, path)
    return read_fits(spark, path, rowid=True).select(F.col("_row").alias("row"), F.col("n_nationkey").alias("key"))


@query("SELECT n_nationkey, NULL::INTEGER AS added, n_name FROM nation")
def column_insert_delete(spark, sf):
    d = edits.insert_column(table(spark, sf, "nation"), 2, "added", "int").drop("n_regionkey")
    return round_trip(d, tform={"n_name": "25A"}, tnull={"added": -99})


@query("SELECT (p_partkey + 1)::BIGINT AS pix, CASE WHEN p_partkey % 3 = 1 THEN -p_size ELSE p_size END::INTEGER AS value FROM part")
def image_partial_write(spark, sf):
    """Every third pixel of an image written anew, the others as they were."""
    d, path = part_image(spark, sf), scratch(spark)
    write_image(d, path, [d.agg(F.max("_pix")).first()[0]], "i32")
    write_pixels(d.where("_pix % 3 = 2").withColumn("value", -F.col("value")), path)
    return read_fits(spark, path, hdu=1).select(F.col("_pix").alias("pix"), "value")


@query("SELECT i::BIGINT AS pix, CASE WHEN i = 5 THEN 60000 ELSE 0 END::INTEGER AS value FROM range(1, 22) t(i)")
def image_resize(spark, sf):
    """An image made smaller and of another type: its pixels are 0 until they are written."""
    d, path = part_image(spark, sf), scratch(spark)
    write_image(d, path, [d.agg(F.max("_pix")).first()[0]], "i32")
    resize_image(spark, path, [7, 3], "u16")
    write_pixels(spark.createDataFrame([(5, 60000)], "_pix long, value int"), path)
    return read_fits(spark, path, hdu=1).select(F.col("_pix").alias("pix"), "value")


@query("SELECT l_returnflag, max(CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END) = 1 AS any_null, sum(CASE WHEN l_quantity = 50 THEN -7 ELSE l_quantity END)::BIGINT AS total FROM lineitem GROUP BY 1")
def null_values(spark, sf):
    """Nulls read from a file as another value, and whether there were any."""
    d = table(spark, sf, "lineitem").select("l_returnflag", F.expr("nullif(l_quantity, 50)").cast("int").alias("q"))
    back = round_trip(d, tform={"l_returnflag": "1A"}, tnull={"q": -1})
    return back.groupBy("l_returnflag").agg(C.any_null(F.col("q")).alias("any_null"), F.sum(C.null_to(F.col("q"), -7)).alias("total"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, 'ORDERS' AS object FROM orders")
def content_rows(spark, sf):
    """Files in a binary column, gzipped; a card written into each of them; their rows and that card."""
    path = scratch(spark)
    write_fits(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, compression="gzip")
    found = spark.read.format("binaryFile").load(path).select("content")

    def edit(box):
        box.units[1][0].update("OBJECT", "ORDERS")

    done = edits.map_files(found, edit)
    box = edits.Container(bytes(done.first()["content"]))
    return read_fits_content(done).withColumn("object", F.lit(box.units[1][0].get("OBJECT")))


@query("""SELECT pos::INTEGER AS pos, name, tform, start::BIGINT AS start, nbytes::BIGINT AS nbytes, unit, (SELECT count(*) FROM embeddings)::BIGINT AS rows, dims
FROM (VALUES (1, 'vec_id', '1K', 0, 8, NULL, '1'), (2, 'embedding', '64E', 8, 256, 'mV', '4,16'), (3, 'label', '1K', 264, 8, NULL, '1')) t(pos, name, tform, start, nbytes, unit, dims)""")
def column_list(spark, sf):
    """Columns of a file; axes and units come back with the DataFrame and go into the next file."""
    d = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    path = scratch(spark)
    write_fits(round_trip(d, tform={"embedding": "64E"}, tdim={"embedding": "(4,16)"}, tunit={"embedding": "mV"}), path, single=True, tform={"embedding": "64E"})
    return fits_columns(spark, path).select("pos", "name", "tform", "start", "nbytes", "unit", "rows", F.array_join("dims", ",").alias("dims"))
