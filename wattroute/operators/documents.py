"""Documents in JSON or XML: charger packs, trip logs, placemarks; written by Spark and read back with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattroute.functions import text

PACK_FORMAT, LOG_FORMAT = "cpack-1", "tlog-1"  # fixed values: formats that readers accept
PACK = "format string, region_id string, built_at_epoch bigint, charger_count bigint, chargers array<struct<id:string,name:string,lat:double,lon:double,operator:string,country:string,max_power_kw:double>>"
LOG = "format string, id string, vehicle string, start_unix bigint, samples array<struct<t_s:double,lat:double,lon:double,speed_mps:double,alt_m:double>>"


def charger_packs(chargers: DataFrame, region: str, epoch: int) -> DataFrame:
    """region, body: one JSON document of a region's chargers, in order of id. A region is one document by its format: bounded by its area."""
    row = F.struct("id", "name", "lat", "lon", "operator", "country", "max_power_kw")
    packs = chargers.groupBy(F.col(region).alias("region_id")).agg(F.array_sort(F.collect_list(row)).alias("chargers"), F.count(F.lit(1)).alias("charger_count"))
    doc = F.struct(F.lit(PACK_FORMAT).alias("format"), "region_id", F.lit(epoch).alias("built_at_epoch"), "charger_count", "chargers")
    return packs.select(F.col("region_id").alias("region"), F.to_json(doc).alias("body"))


def _checked(df: DataFrame, body: str, schema: str, wanted: str) -> DataFrame:
    doc = df.select("*", F.from_json(body, schema).alias("_doc"))
    wrong = F.coalesce(F.col("_doc.format"), F.lit("none")) != wanted
    return doc.withColumn("_doc", F.when(wrong, F.raise_error(F.concat(F.lit(f"format must be {wanted}, not "), F.coalesce("_doc.format", F.lit("none"))))).otherwise(F.col("_doc")))


def read_packs(packs: DataFrame, body: str = "body") -> DataFrame:
    """The chargers of pack documents; another format is an error."""
    return _checked(packs, body, PACK, PACK_FORMAT).select(F.col("_doc.region_id").alias("region"), F.inline("_doc.chargers"))


def trip_logs(trips: DataFrame, fixes: DataFrame) -> DataFrame:
    """file, start_unix, body of each trip: a JSON document named after its start and the first eight characters of its id."""
    samples = fixes.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "t_s", "lat", "lon", "speed_mps", "alt_m"))).alias("s"))
    samples = samples.select("trip_id", F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in ("t_s", "lat", "lon", "speed_mps", "alt_m")])).alias("samples"))
    name = F.sha2(F.col("trip_id").cast("string").cast("binary"), 256)
    doc = F.struct(F.lit(LOG_FORMAT).alias("format"), F.col("trip_id").cast("string").alias("id"), "vehicle", F.col("start_unix").cast("bigint").alias("start_unix"), "samples")
    return trips.join(samples, "trip_id").select(F.concat(F.lit("tlog-"), F.col("start_unix").cast("string"), F.lit("-"), F.substring(name, 1, 8)).alias("file"), F.col("start_unix").cast("bigint").alias("start_unix"), F.to_json(doc).alias("body"))


def read_logs(logs: DataFrame, body: str = "body") -> DataFrame:
    """id, vehicle, start_unix, seq and the samples of trip logs; another format is an error; missing speeds and heights are null."""
    doc = _checked(logs, body, LOG, LOG_FORMAT)
    each = doc.select("_doc.id", "_doc.vehicle", "_doc.start_unix", F.posexplode("_doc.samples").alias("seq", "s"))
    return each.select("id", "vehicle", "start_unix", "seq", "s.*")


def tag(chunk: Column, name: str) -> Column:
    """Text of the first <name> element of a chunk; null if there is none."""
    found = F.regexp_extract(chunk, f"(?s)<{name}>(.*?)</{name}>", 1)
    return F.when(chunk.rlike(f"(?s)<{name}>.*?</{name}>"), found)


def placemarks(files: DataFrame, key: str, body: str, wanted: str = "SuperChargy", source: str = "chargy") -> DataFrame:
    """key, id, name, lat, lon of the placemarks of XML documents whose name holds ``wanted`` and whose place can be read; numbered among those kept."""
    chunks = files.select(key, F.transform(F.slice(F.split(body, "<Placemark>"), F.lit(2), F.greatest(F.size(F.split(body, "<Placemark>")) - 1, F.lit(0))), lambda c: F.split(c, "</Placemark>")[0]).alias("chunks"))

    def read(chunk: Column) -> Column:
        at = F.split(F.trim(tag(chunk, "coordinates")), ",")
        return F.struct(tag(chunk, "name").alias("name"), F.get(at, F.lit(1)).try_cast("double").alias("lat"), F.get(at, F.lit(0)).try_cast("double").alias("lon"))

    good = lambda r: r["name"].contains(wanted) & r["lat"].isNotNull() & r["lon"].isNotNull()
    each = chunks.select(key, F.posexplode(F.filter(F.transform("chunks", read), good)).alias("i", "r"))
    return each.select(key, F.concat(F.lit(f"{source}:"), F.col("i").cast("string")).alias("id"), "r.name", "r.lat", "r.lon")


def epoch_of(stamp: Column) -> Column:
    """Seconds since 1970 of "YYYY-MM-DDTHH:MM:SSZ"; null for other texts."""
    return F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))


def catalog_problems(rows: DataFrame) -> DataFrame:
    """(region, file, rule) for each rule that an artifact row (region, file, sha256) of a remote catalog breaks."""
    rules = {
        "region": ~F.col("region").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "sha256": ~F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "path": F.col("file").contains("..") | F.col("file").startswith("/") | F.col("file").contains("\\\\") | (F.col("file") == ""),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(True)), F.lit(name)) for name, wrong in rules.items()]))
    return rows.select("region", "file", F.explode(broken).alias("rule"))


def publish_plan(built: DataFrame, remote: DataFrame) -> DataFrame:
    """path, action of each built file (path, md5): upload if it is not there, skip if it is the same, abort if another file has its name."""
    r = remote.select("path", F.col("md5").alias("have"))
    action = F.when(F.col("have").isNull(), "upload").when(F.col("have") == F.col("md5"), "skip").otherwise("abort")
    return built.join(r, "path", "left").select("path", action.alias("action"))


def feed_outcome(rows: DataFrame, required: DataFrame, allow_partial: bool = False) -> DataFrame:
    """feed, n, ok of every required feed: one without rows fails unless partial results are allowed."""
    n = rows.groupBy("feed").agg(F.count(F.lit(1)).alias("n"))
    return required.join(n, "feed", "left").select("feed", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.coalesce("n", F.lit(0)) > 0) | F.lit(allow_partial).alias("ok")).toDF("feed", "n", "ok")


def lon_lat_of(column: Column) -> Column:
    return text.lon_lat(column)
