"""Readers of landed geodata: tagged elements, features, XML records, grids, logs, tile catalogues.

Network fetches end in files; every reader takes a path and gives a table with a
fixed schema. Files are read by Spark's own sources, so splits, pruning and
remote stores come with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ELEMENTS = (
    "elements array<struct<type: string, id: bigint, lat: double, lon: double, tags: map<string, string>,"
    " geometry: array<struct<lat: double, lon: double>>, members: array<struct<type: string, ref: bigint, role: string, geometry: array<struct<lat: double, lon: double>>>>>>"
)
FEATURES = "type string, features array<struct<type: string, id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
SOURCE_EVENTS = "ts timestamp, event string, key string, label string, countries array<string>, code int, detail string, kind string, fatal boolean"


def elements_json(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """Nodes, ways and relations of query answers, one row an element; repeated ids of overlapping tiles count once."""
    rows = spark.read.schema(ELEMENTS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    return (rows if only is None else rows.where(only)).dropDuplicates(["type", "id"])


def elements_lines(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """The same from answers as JSON lines, which Spark can split."""
    rows = spark.read.schema(ELEMENTS).json(path).select(F.explode("elements").alias("e")).select("e.*")
    return (rows if only is None else rows.where(only)).dropDuplicates(["type", "id"])


def ways_xml(spark: SparkSession, path: str) -> DataFrame:
    """Ways of a map extract with their nodes' places, in order: (id, tags, line)."""
    ways = spark.read.format("xml").option("rowTag", "way").schema("_id bigint, nd array<struct<_ref: bigint>>, tag array<struct<_k: string, _v: string>>").load(path)
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id bigint, _lat double, _lon double").load(path).select(F.col("_id").alias("ref"), "_lat", "_lon")
    flat = ways.select("_id", F.posexplode("nd").alias("i", "nd")).select("_id", "i", F.col("nd._ref").alias("ref")).join(nodes, "ref")
    lines = flat.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_lat", "_lon"))), lambda p: F.struct(p["_lat"].alias("lat"), p["_lon"].alias("lon"))).alias("line"))
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")), lambda t: F.struct(t["_k"], t["_v"])))
    return ways.select("_id", tags.alias("tags")).join(lines, "_id").withColumnRenamed("_id", "id")


TECHNICAL = "_type string, level string, attribute array<struct<_name: string, _VALUE: string>>, posList string"


def tech_objects(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of a large-scale map in XML: all attributes as text, the place list as points, the level as a number."""
    return _technical(spark.read.format("xml").option("rowTag", record).schema(TECHNICAL).load(path))


def tech_object_stream(spark: SparkSession, path: str, record: str, types: list[str] | None = None, files_per_batch: int = 4) -> DataFrame:
    """The same records from the files of a folder as they arrive, of the types asked for; records are read one by one, so a file may be of any size."""
    raw = spark.readStream.format("xml").option("rowTag", record).option("maxFilesPerTrigger", files_per_batch).schema(TECHNICAL).load(path)
    return _technical(raw if types is None else raw.where(F.col("_type").isin(*types)))


def _technical(raw: DataFrame) -> DataFrame:
    numbers = F.transform(F.filter(F.split("posList", r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    pts = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2) - 1), lambda i: F.struct(F.element_at(numbers, (2 * i + 1).cast("int")).alias("x"), F.element_at(numbers, (2 * i + 2).cast("int")).alias("y")))
    attrs = F.map_from_entries(F.transform(F.coalesce("attribute", F.array().cast("array<struct<_name: string, _VALUE: string>>")), lambda a: F.struct(a["_name"], a["_VALUE"])))
    return raw.select(F.col("_type").alias("type"), F.coalesce(F.col("level").try_cast("int"), F.lit(0)).alias("level"), attrs.alias("attrs"), F.when(F.size(numbers) >= 2, pts).alias("pts"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features: (layer, id, properties, geom_type, coordinates as JSON text); pages and tiles overlap, so ids count once a layer."""
    rows = spark.read.schema(FEATURES).option("multiLine", True).json(path).withColumn("layer", F.regexp_extract(F.input_file_name(), r"/([^/]+?)(?:_\d+)?\.(?:geo)?json$", 1))
    flat = rows.select("layer", F.explode("features").alias("f")).select("layer", "f.id", "f.properties", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))
    return flat.dropDuplicates(["layer", "id"])


def feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features as JSON lines in a folder a layer (``layer=`` or ``kind=``): as ``features``, but in files that Spark can split."""
    one = "type string, id string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
    rows = spark.read.text(path)
    layer = F.col("kind") if "kind" in rows.columns else F.col("layer")
    flat = rows.select(layer.cast("string").alias("layer"), F.from_json("value", one).alias("f"))
    return flat.select("layer", "f.id", "f.properties", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates")).dropDuplicates(["layer", "id"])


def points(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None, classes: tuple[int, ...] = ()) -> DataFrame:
    """Points (x, y, z, cls, rn, nr) of a window; both conditions reach the files' statistics."""
    p = spark.read.parquet(path).select("x", "y", "z", "cls", "rn", "nr")
    if window:
        p = p.where((F.col("x") >= window[0]) & (F.col("x") < window[2]) & (F.col("y") >= window[1]) & (F.col("y") < window[3]))
    return p.where(F.col("cls").isin(*classes)) if classes else p


def raster_window(spark: SparkSession, path: str, window: tuple[int, int, int, int], tile: int) -> DataFrame:
    """Cells (rr, cc) from the first row and column up to the last ones of a window; tiles that don't meet it are pruned."""
    r0, c0, r1, c1 = window
    tiles = F.col("tile_y").between(r0 // tile, (r1 - 1) // tile) & F.col("tile_x").between(c0 // tile, (c1 - 1) // tile)
    return spark.read.parquet(path).where(tiles & (F.col("rr") >= r0) & (F.col("rr") < r1) & (F.col("cc") >= c0) & (F.col("cc") < c1))


def rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Rules (condition, code) of a small file in their order; they become Column expressions, so they go through the driver."""
    return [(r["condition"], r["code"]) for r in spark.read.json(path).orderBy("place").collect()]


def line_coordinates(coordinates: Column) -> Column:
    """Coordinates of a line as points."""
    return F.transform(F.from_json(coordinates, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def xyz_cells(spark: SparkSession, path: str, size: float) -> DataFrame:
    """Cells of an x y z list in any order; the last value of a repeated place is not defined, so the highest counts."""
    rows = spark.read.option("sep", " ").schema("x double, y double, z double").csv(path)
    return rows.groupBy(F.floor(F.col("y") / size).cast("long").alias("rr"), F.floor(F.col("x") / size).cast("long").alias("cc")).agg(F.max("z").alias("v"))


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of an ESRI ASCII grid, rows counted from the top; values equal to nodata are null."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "").alias("lines"))
    number = lambda key: F.regexp_extract(F.array_join("lines", "\n"), rf"(?i)(?m)^{key}\s+(\S+)", 1).try_cast("double")
    head = F.size(F.filter("lines", lambda s: s.rlike(r"^\s*[A-Za-z]")))
    body = text.select("file", number("xllcorner").alias("x0"), number("yllcorner").alias("y0"), number("cellsize").alias("cell"), number("nrows").cast("int").alias("nrows"), number("NODATA_value").alias("nodata"), F.posexplode(F.slice("lines", head + 1, F.size("lines"))).alias("row", "line"))
    cells = body.select("file", "x0", "y0", "cell", "nrows", "nodata", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    v = F.col("v").try_cast("double")
    return cells.select("file", "row", "col", (F.col("x0") + (F.col("col") + 0.5) * F.col("cell")).alias("x"), (F.col("y0") + (F.col("nrows") - F.col("row") - 0.5) * F.col("cell")).alias("y"), F.when(v != F.coalesce("nodata", F.lit(-9999.0)), v).alias("v"))


def dxf_lines(spark: SparkSession, path: str) -> DataFrame:
    """LINE entities of DXF text: code and value lines in pairs, grouped from one entity mark to the next."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)).alias("t"))
    pairs = text.select("file", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 2) - 1), lambda i: F.struct(F.element_at("t", (2 * i + 1).cast("int")).alias("code"), F.element_at("t", (2 * i + 2).cast("int")).alias("value")))).alias("i", "p")).select("file", "i", "p.code", "p.value")
    entity = pairs.withColumn("entity", F.sum((F.col("code") == "0").cast("int")).over(Window.partitionBy("file").orderBy("i")))
    got = entity.groupBy("file", "entity").agg(*(F.max(F.when(F.col("code") == c, F.col("value"))).alias(n) for c, n in (("0", "kind"), ("8", "layer"), ("10", "x0"), ("20", "y0"), ("11", "x1"), ("21", "y1"))))
    return got.where("kind = 'LINE'").select("file", "layer", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))


def source_events(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """An append-only log of JSON lines; broken lines are left out."""
    rows = spark.read.schema(SOURCE_EVENTS).option("mode", "DROPMALFORMED").json(path).where("ts is not null and key is not null")
    return rows if since is None else rows.where(F.col("ts") >= since)


def split_extent(spark: SparkSession, west: float, south: float, east: float, north: float, step: float) -> DataFrame:
    """An extent cut into tiles of at most ``step``."""
    nx, ny = max(1, int(-(-(east - west) // step))), max(1, int(-(-(north - south) // step)))
    t = spark.range(nx * ny).select((F.col("id") % nx).alias("tx"), F.floor(F.col("id") / nx).alias("ty"))
    return t.select("tx", "ty", (F.lit(west) + F.col("tx") * step).alias("west"), (F.lit(south) + F.col("ty") * step).alias("south"), F.least(F.lit(east), F.lit(west) + (F.col("tx") + 1) * step).alias("east"), F.least(F.lit(north), F.lit(south) + (F.col("ty") + 1) * step).alias("north"))


def sheet_bounds(name: Column) -> Column:
    """Bounds of a kilometre sheet 'E123_N456' in metres."""
    e, n = F.regexp_extract(name, r"E(\d+)", 1).try_cast("long") * 1000, F.regexp_extract(name, r"N(\d+)", 1).try_cast("long") * 1000
    return F.when(e.isNotNull() & n.isNotNull(), F.struct(e.alias("x0"), n.alias("y0"), (e + 1000).alias("x1"), (n + 1000).alias("y1")))


def octree_nodes(nodes: DataFrame, cube: tuple[float, float, float, float], span: int, window: tuple[float, float, float, float], least_spacing: float) -> DataFrame:
    """Nodes (d, x, y, z, count) of a point octree whose cell meets the window and is not finer than wanted."""
    x0, y0, _, side = cube
    size = F.lit(side) / F.pow(F.lit(2.0), F.col("d"))
    nx, ny = F.lit(x0) + F.col("x") * size, F.lit(y0) + F.col("y") * size
    w = window
    return nodes.where((size / span >= least_spacing) & (nx < w[2]) & (nx + size > w[0]) & (ny < w[3]) & (ny + size > w[1]))


def newest_assets(items: DataFrame, tile: str, year: str, gsd: str, wanted: float) -> DataFrame:
    """The newest item of each tile at a ground resolution."""
    w = Window.partitionBy(tile).orderBy(F.desc(year))
    return items.where(F.col(gsd) == wanted).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def inventory(terrain: DataFrame, surface: DataFrame, key: str, low: str, high: str, bounds: tuple[float, float]) -> DataFrame:
    """Sheets of two inventories side by side with what is wrong about each."""
    t = terrain.select(key, F.col(low).alias("t_low"), F.col(high).alias("t_high"), F.lit(True).alias("in_terrain"))
    s = surface.select(key, F.col(low).alias("s_low"), F.col(high).alias("s_high"), F.lit(True).alias("in_surface"))
    odd = lambda a, b: (F.col(a) < bounds[0]) | (F.col(b) > bounds[1])
    problem = F.when(F.col("in_terrain").isNull(), "no terrain").when(F.col("in_surface").isNull(), "no surface").when(odd("t_low", "t_high") | odd("s_low", "s_high"), "odd heights").when(F.col("s_high") < F.col("t_low"), "surface below terrain")
    return t.join(s, key, "full").select(key, problem.alias("problem"))
