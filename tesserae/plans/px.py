"""Image kernels over pixels made of the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import pixels
from tesserae.registry import query

_PX = """WITH p AS (SELECT (l_orderkey % 500) AS img, CAST(l_orderkey // 500 % 8 AS INT) AS y, CAST(l_linenumber - 1 AS INT) AS x, CAST(l_partkey * 7 % 256 AS INT) AS r, CAST(l_suppkey * 13 % 256 AS INT) AS g, CAST(l_quantity AS INT) * 5 AS b, CAST(l_orderkey * 11 % 256 AS INT) AS a FROM lineitem),
q AS (SELECT img, y, x, max(r) AS r, max(g) AS g, max(b) AS b, max(a) AS a FROM p GROUP BY img, y, x)"""


def pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 500 images of up to eight by seven; of several for one place the largest values."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    i = lambda c, n: c.cast("int").alias(n)
    p = li.select((F.col("l_orderkey") % 500).alias("img"), i(F.floor(F.col("l_orderkey") / 500) % 8, "y"), i(F.col("l_linenumber") - 1, "x"), i(F.col("l_partkey") * 7 % 256, "r"), i(F.col("l_suppkey") * 13 % 256, "g"), (F.col("l_quantity").cast("int") * 5).alias("b"), i(F.col("l_orderkey") * 11 % 256, "a"))
    return p.groupBy("img", "y", "x").agg(*[F.max(c).alias(c) for c in "rgba"])


@query(_PX + """, c AS (SELECT img, y, x, ((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) AS c FROM q) SELECT img, y, x, CAST(c AS INT) AS packed, CAST(((c >> 11) << 3) | ((c >> 11) >> 2) AS INT) AS r, CAST((((c >> 5) & 63) << 2) | (((c >> 5) & 63) >> 4) AS INT) AS g, CAST(((c & 31) << 3) | ((c & 31) >> 2) AS INT) AS b FROM c""")
def px_rgb565(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixel_rows(spark, sf_dir).select("img", "y", "x", pixels.pack565(F.col("r"), F.col("g"), F.col("b")).alias("packed"))
    r, g, b = pixels.unpack565(F.col("packed"))
    return p.select("img", "y", "x", "packed", r.alias("r"), g.alias("g"), b.alias("b"))


@query(_PX + """ SELECT img, y // 2 AS y, x // 2 AS x, CAST(sum(r) // 4 AS INT) AS r, CAST(sum(g) // 4 AS INT) AS g, CAST(sum(b) // 4 AS INT) AS b, CAST(sum(a) // 4 AS INT) AS a FROM q GROUP BY 1, 2, 3 HAVING count(*) = 4""")
def px_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.halved(pixel_rows(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block per part: sixteen pixels that follow from its key."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    byte = lambda m, s: lambda i: F.lpad(F.hex(((F.col("p_partkey") * m + i * s) % 256).cast("long")), 2, "0")
    one = lambda i: F.concat(byte(7, 13)(i), byte(11, 29)(i), byte(5, 3)(i), byte(3, 17)(i))
    return p.select(F.col("p_partkey").alias("id"), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), one), "")).alias("rgba"))


def _hex(x: str, n: int) -> str:
    """Little-endian bytes of a number, as hex."""
    return " || ".join(f"format('{{:02x}}', ({x} >> {8 * i}) & 255)" for i in range(n))


_R, _G, _B = "(((({c} >> 11) & 31) << 3) | ((({c} >> 11) & 31) >> 2))", "(((({c} >> 5) & 63) << 2) | ((({c} >> 5) & 63) >> 4))", "((({c} & 31) << 3) | (({c} & 31) >> 2))"
_PAL = ", ".join(f"[{h}, {lo}, (2 * {h} + {lo}) // 3, ({h} + 2 * {lo}) // 3] AS p{n}" for n, c in (("r", _R), ("g", _G), ("b", _B)) for h, lo in ((c.format(c="h"), c.format(c="l")),))
_BC1 = f"""WITH x AS (SELECT p_partkey AS id, i.range AS i, (p_partkey * 7 + i.range * 13) % 256 AS r, (p_partkey * 11 + i.range * 29) % 256 AS g, (p_partkey * 5 + i.range * 3) % 256 AS b, (p_partkey * 3 + i.range * 17) % 256 AS a FROM part, range(16) i),
c AS (SELECT id, ((max(r) >> 3) << 11) | ((max(g) >> 2) << 5) | (max(b) >> 3) AS c0, ((min(r) >> 3) << 11) | ((min(g) >> 2) << 5) | (min(b) >> 3) AS c1, max(a) AS a0, min(a) AS a1 FROM x GROUP BY id),
e AS (SELECT id, greatest(c0, c1) AS h, least(c0, c1) AS l, a0, a1 FROM c), pal AS (SELECT *, {_PAL}, [a0, a1, (6 * a0 + a1) // 7, (5 * a0 + 2 * a1) // 7, (4 * a0 + 3 * a1) // 7, (3 * a0 + 4 * a1) // 7, (2 * a0 + 5 * a1) // 7, (a0 + 6 * a1) // 7] AS la FROM e),
d AS (SELECT id, i, j.range AS j, pow((r - pr[j.range + 1]) * {pixels.RED}, 2) + pow((g - pg[j.range + 1]) * {pixels.GREEN}, 2) + pow(b - pb[j.range + 1], 2) AS d FROM x JOIN pal USING (id), range(4) j),
k AS (SELECT id, i, arg_min(j, d * 8 + j) AS pick FROM d GROUP BY id, i), bits AS (SELECT id, CAST(sum(pick << CAST(2 * i AS INT)) AS BIGINT) AS bits FROM k GROUP BY id),
da AS (SELECT id, i, arg_min(j.range, abs(a - la[j.range + 1]) * 8 + j.range) AS pick FROM x JOIN pal USING (id), range(8) j GROUP BY id, i), ba AS (SELECT id, CAST(sum(pick << CAST(3 * i AS INT)) AS BIGINT) AS bits FROM da GROUP BY id),
o AS (SELECT id, {_hex("h", 2)} || {_hex("l", 2)} || {_hex("bits", 4)} AS colours FROM e JOIN bits USING (id)),
oa AS (SELECT id, format('{{:02x}}', a0) || format('{{:02x}}', a1) || {_hex("bits", 6)} AS alphas FROM e JOIN ba USING (id))"""


@query(_BC1 + " SELECT id, colours AS block FROM o")
def px_bc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.compressed(_blocks(spark, sf_dir), "BC1").select("id", F.lower(F.hex("block")).alias("block"))


@query(_BC1 + " SELECT id, alphas || colours AS block FROM o JOIN oa USING (id)")
def px_bc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.compressed(_blocks(spark, sf_dir), "BC3").select("id", F.lower(F.hex("block")).alias("block"))


@query("""SELECT p_partkey AS id, CAST(list_sum(list_transform(range(5), lambda i: CAST(ceil(greatest(floor(p_size * 64 / pow(2, i)), 1) / 4) AS BIGINT) * CAST(ceil(greatest(floor(4096 / pow(2, i)), 1) / 4) AS BIGINT) * 8)) + 128 AS BIGINT) AS bytes FROM part""")
def px_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of textures as wide as 64 times the part's size, five levels, with their header."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), (pixels.data_size(F.col("p_size") * 64, F.lit(4096), "BC1", 5) + 128).alias("bytes"))


@query("""WITH c AS (SELECT l_suppkey AS "row", l_orderkey % 256 AS k, max(l_partkey) AS v, max(l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
g AS (SELECT "row", r.range AS k FROM (SELECT DISTINCT "row" FROM c), range(256) r),
f AS (SELECT "row", k, CASE WHEN n % 5 <> 0 THEN format('{:08x}', v * 65521 % 4294967296) ELSE 'ff00ffff' END AS px FROM g LEFT JOIN c USING ("row", k))
SELECT "row", sha256(unhex(string_agg(px, '' ORDER BY k))) AS digest FROM f GROUP BY ALL""")
def px_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of sixteen by sixteen chunks of one pixel, by supplier; a digest of each image."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_orderkey") % 256
    c = li.groupBy(F.col("l_suppkey").alias("row"), k.alias("k")).agg(F.max("l_partkey").alias("v"), F.max("l_linenumber").alias("n"))
    data = F.unhex(F.lpad(F.hex(F.col("v") * 65521 % 4294967296), 8, "0"))
    c = c.select("row", F.lit(0).cast("long").alias("col"), F.lit(12).alias("zoom"), F.floor(F.col("k") / 16).cast("int").alias("chunk_row"), (F.col("k") % 16).cast("int").alias("chunk_col"), (F.col("n") % 5 != 0).alias("ok"), data.alias("data"))
    return pixels.mosaic(c, side=1).select("row", F.sha2("image", 256).alias("digest"))
