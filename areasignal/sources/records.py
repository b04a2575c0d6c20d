"""Evidence, predictions, truth and tiles from JSON lines, CSV and Parquet; sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areasignal.functions.text import level, parsed_counts, parsed_total, poi_summary, whole
from areasignal.functions.vectors import finite
from areasignal.operators.tables import remaining, resolve

# Names of targets and of the indicators that a record scores from 0 to 4.
DOMAINS = ("Income", "Employment", "Health", "Education", "Access", "Crime", "Housing")
#: A perception record; evidence and indicators stay text, as their shape differs from record to record.
PERCEPTION = "patch_id string, datazone string, streetview_indices array<int>, reasoning_json string"
OOF = T.StructType([T.StructField("datazone", T.StringType()), T.StructField("fold", T.IntegerType()), *(T.StructField(n, T.StructType([T.StructField(d, T.DoubleType()) for d in DOMAINS])) for n in ("prediction_json", "target_raw"))])


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, tolerant: bool = True, lines: int | None = None) -> DataFrame:
    """Blank lines are skipped; broken ones too if tolerant, else they stop the read. lines: only so many physical lines, blank
    ones too, in the order of the files' names and of the lines in them."""
    if lines is not None:
        at = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
        first = spark.read.text(path).select("value", *(c.alias(f"_{i}") for i, c in enumerate(at))).orderBy("_0", "_1", "_2").limit(lines).where(F.trim("value") != "")
        found = first.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "PERMISSIVE" if tolerant else "FAILFAST"}).alias("r")).where("r is not null")
        return found.select("r.*")
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, required: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """CSV or JSON by suffix; required columns are asserted, numbers are cast, rows without them go."""
    df = spark.read.option("header", True).csv(path) if path.lower().endswith(".csv") else spark.read.json(path, multiLine=path.lower().endswith(".json"))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numbers}).na.drop(subset=list(numbers))


def read_oof(spark: SparkSession, path: str, default_fold: int = -1) -> DataFrame:
    """unit_id, fold, pred_<domain>, target_<domain>; no rows are an error."""
    df = read_json_lines(spark, path, OOF, tolerant=False)
    out = df.select(F.col("datazone").alias("unit_id"), F.coalesce("fold", F.lit(default_fold)).alias("fold"), *(F.col(f"{s}.{d}").alias(f"{n}_{d}") for n, s in (("pred", "prediction_json"), ("target", "target_raw")) for d in DOMAINS))
    if out.isEmpty():
        raise ValueError(f"no rows in {path}")
    return out


def parsed_evidence(df: DataFrame, raw: str = "reasoning_json", unit: str = "datazone") -> DataFrame:
    """unit, sat, ntl, sv (arrays of phrases; sv of all street images in the order of their keys), poi_text, counts, total.

    POI may be a map of counts or a list whose first entry is a summary. Evidence may be wrapped in another reasoning_json.
    """
    v = F.coalesce(F.get_json_object(raw, "$.reasoning_json.evidence"), F.get_json_object(raw, "$.evidence"), F.lit("{}"))
    keys = F.coalesce(F.json_object_keys(v), F.array().cast("array<string>"))
    phrases = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
    entries = F.from_json(v, "map<string,string>")
    street = F.transform(F.array_sort(F.filter(keys, lambda k: k.startswith("streetview_"))), lambda k: phrases(F.try_element_at(entries, k)))
    poi = F.try_element_at(entries, F.lit("POI"))
    is_map = F.coalesce(poi, F.lit("")).startswith("{")
    given = F.map_filter(F.from_json(poi, "map<string,bigint>"), lambda k, n: k != "total")
    text = F.coalesce(F.get(phrases(poi), F.lit(0)), F.lit("(no POI recorded)"))
    counts = F.when(is_map, given).otherwise(parsed_counts(text))
    return df.select(
        unit, phrases(F.get_json_object(v, "$.satellite")).alias("sat"), phrases(F.get_json_object(v, "$.nightlight")).alias("ntl"), F.flatten(street).alias("sv"), F.when(is_map, poi_summary(given)).otherwise(text).alias("poi_text"), counts.alias("counts"),
        F.when(is_map, F.coalesce(F.get_json_object(poi, "$.total").try_cast("bigint"), F.aggregate(F.map_values(given), F.lit(0).cast("long"), lambda a, x: a + x))).otherwise(parsed_total(text)).alias("total"),
    )


def indicator_vector(raw: Column, keys: Sequence[str]) -> tuple[Column, Column]:
    """Scores of all keys from JSON {key: {score: x}}, and 1 if any is missing, not a number or not from 0 to 4: then all are 0."""
    text = [F.get_json_object(raw, f"$.{k}.score") for k in keys]
    number = [t.try_cast("double") for t in text]  # true and false aren't numbers
    fine = F.lit(True)
    for n in number:
        fine = fine & F.coalesce(finite(n) & n.between(0, 4), F.lit(False))
    return F.when(fine, F.array(*number)).otherwise(F.array(*[F.lit(0.0)] * len(keys))), (~fine).cast("int")


def indicators(raw: Column, keys: Sequence[str]) -> Column:
    """A map of structs score and cue for all keys, from JSON {key: {score, cue}}: scores cut to whole numbers, cues to 120
    characters. Null if any key is missing or its score isn't a number from 0 to 4."""
    number = {k: F.get_json_object(raw, f"$.{k}.score").try_cast("double") for k in keys}
    whole = {k: n.cast("int") for k, n in number.items()}
    fine = F.lit(True)
    for k in keys:
        fine = fine & F.coalesce(finite(number[k]) & whole[k].between(0, 4), F.lit(False))
    cue = lambda k: F.substring(F.coalesce(F.get_json_object(raw, f"$.{k}.cue"), F.lit("")), 1, 120)
    return F.when(fine, F.create_map(*(x for k in keys for x in (F.lit(k), F.struct(whole[k].alias("score"), cue(k).alias("cue"))))))


def element(raw: Column, key: str) -> Column:
    """A place from a map server's JSON element: osm_type, osm_id, poi_name, poi_type (the key), poi_subtype, lat and lon (of the
    centre where it has none of its own), tags_json (sorted). Null without a type, an id or a place."""
    of = lambda path: F.get_json_object(raw, path)
    tags = F.coalesce(F.from_json(of("$.tags"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    both = of("$.lat").isNotNull() & of("$.lon").isNotNull()
    lat, lon = (F.when(both, of(f"$.{c}")).otherwise(of(f"$.center.{c}")).try_cast("double") for c in ("lat", "lon"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(tags)))
    there = of("$.type").isNotNull() & of("$.id").isNotNull() & lat.isNotNull() & lon.isNotNull()
    return F.when(there, F.struct(of("$.type").alias("osm_type"), of("$.id").cast("bigint").alias("osm_id"), F.try_element_at(tags, F.lit("name")).alias("poi_name"), F.lit(key).alias("poi_type"), F.try_element_at(tags, F.lit(key)).alias("poi_subtype"), lat.alias("lat"), lon.alias("lon"), F.to_json(ordered).alias("tags_json")))


def tiles(df: DataFrame) -> DataFrame:
    """Tile metadata: patch_id falls back to the unit, the flag is text, coordinates that aren't numbers are null."""
    number = lambda c: F.col(c).cast("string").try_cast("double").alias(c)
    return df.select(F.coalesce(F.nullif(F.trim("patch_id"), F.lit("")), "datazone").alias("patch_id"), "datazone", (F.lower(F.trim("has_streetview")) == "true").alias("has_streetview"), *(number(c) for c in df.columns if c.startswith(("bbox_", "centroid_"))))


def sparse_counts(columns: Sequence[str]) -> Column:
    """Wide counts as a map of those above 0."""
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).try_cast("int").alias("v")) for c in columns))
    return F.map_from_entries(F.filter(pairs, lambda e: F.coalesce(e["v"], F.lit(0)) > 0))


def truth_lookup(df: DataFrame, unit: str, rank: str, quintile: str) -> DataFrame:
    """unit_id, rank, quintile and level of each unit, whole numbers from text; an empty table or a missing column is an error."""
    if unit not in df.columns:
        raise ValueError(f"missing column {unit}")
    if df.isEmpty():
        raise ValueError("no rows")
    number = lambda c: whole(F.col(c).cast("string")).cast("int") if c in df.columns else F.lit(None).cast("int")
    out = df.where(F.col(unit).isNotNull()).select(F.col(unit).cast("string").alias("unit_id"), number(rank).alias("rank"), number(quintile).alias("quintile"))
    return out.withColumn("level", level(F.col("quintile")))


def truth(df: DataFrame) -> DataFrame:
    """unit_id and a column for each domain (lower case), from either convention of names."""
    unit = resolve(df.columns, ("unit_id", "datazone", "DataZone", "Data_Zone", "zone"), ("zone", "dz"))
    lower = {c.lower(): c for c in df.columns}
    name = lambda d: lower.get(f"{d.lower()}_score") if "income_score" in lower else lower.get(d.lower())
    if missing := [d for d in DOMAINS if not name(d)]:
        raise ValueError(f"missing domains {missing}")
    return df.select(F.col(unit).alias("unit_id"), *(F.col(name(d)).cast("double").alias(d.lower()) for d in DOMAINS))


def images(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """path, tile (the folder) and pano_index: the number in the name, else the place by name within the folder."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    place = F.row_number().over(Window.partitionBy("tile").orderBy("path")) - 1
    return files.withColumn("tile", F.element_at(parts, -2)).withColumn("pano_index", F.coalesce(stem.try_cast("int"), place))


def image_state(content: Column) -> Column:
    """ok for bytes that begin as a JPEG or PNG file does, corrupt for others, missing for null."""
    start = F.hex(F.substring(content, 1, 8))
    return F.when(content.isNull(), "missing").when(start.startswith("FFD8FF") | (start == "89504E470D0A1A0A"), "ok").otherwise("corrupt")


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """Decimals with a fixed number of digits."""
    fixed = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*fixed).write.mode("overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows whose key isn't there yet; a first run makes the table."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = remaining(df, spark.read.parquet(path), keys) if there else df
    fresh.write.mode("append").parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes its paths."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def _renamed(spark: SparkSession, source: str, target: str) -> None:
    files, of = _files(spark, target)
    if not files.rename(of(source), of(target)):
        raise OSError(f"{source} couldn't be moved to {target}")


def recovered(spark: SparkSession, path: str) -> None:
    """Ends a replacement of the table at a path that was stopped between its steps: the new table goes to its place if it was
    written whole, else the old one back. Called before each replacement, and by who reads a table that others replace."""
    files, of = _files(spark, path)
    there = lambda p: files.exists(of(p))
    old, new = f"{path.rstrip('/')}.old", f"{path.rstrip('/')}.new"
    if there(old) and not there(path):
        _renamed(spark, new if there(f"{new}/_SUCCESS") else old, path)
    if there(old) and there(path):
        files.delete(of(old), True)


def _replaced(df: DataFrame, path: str, fmt: str, **options: object) -> None:
    """Written beside the old table, which then moves aside, gives its place to the new one and goes. At every step a whole table
    is there under one of three names, and `recovered` tells which counts."""
    spark, old, new = df.sparkSession, f"{path.rstrip('/')}.old", f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").format(fmt).options(**options).save(new)
    files, of = _files(spark, path)
    if files.exists(of(path)):
        _renamed(spark, path, old)
    _renamed(spark, new, path)
    files.delete(of(old), True)


def replace(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A table written whole beside the old one, which only then gives way: a failed write leaves the old one. df may read the
    old table, if nothing was left undone there (`recovered`)."""
    recovered(df.sparkSession, path)
    _replaced(df, path, fmt)


def append_aliased(df: DataFrame, path: str, name: str, aliases: Sequence[str]) -> None:
    """Appends to a CSV table whose older files may name a column otherwise: all is written anew under one header."""
    recovered(df.sparkSession, path)
    old = df.sparkSession.read.option("header", True).csv(path)
    both = aliased(old, name, aliases).unionByName(df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)), allowMissingColumns=True)
    _replaced(both, path, "csv", header=True)


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """A run's summary (plain values, lists, dictionaries) as one JSON object."""
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def cached(path: str, wanted: DataFrame, unit: str, meta: dict, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """Vectors of the wanted units from a cache, if it has the same settings and the same units; else they are made and it is
    written. Second: whether the cache was used."""
    spark = wanted.sparkSession
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(of):
        there = spark.read.parquet(f"{path}/rows")
        if same_cache(there, json.loads(spark.read.text(f"{path}/meta").first()[0]), wanted, meta, unit):
            return there, True
    of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True)  # rows without settings count for nothing
    make(wanted).write.mode("overwrite").parquet(f"{path}/rows")
    write_summary(spark, f"{path}/meta", meta)
    return spark.read.parquet(f"{path}/rows"), False


def same_cache(cache: DataFrame, meta: dict, wanted: DataFrame, wanted_meta: dict, unit: str) -> bool:
    """Whether an embedding cache can be used: the same settings and the same ids."""
    a, b = cache.select(unit).distinct(), wanted.select(unit).distinct()
    return meta == wanted_meta and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def aliased(df: DataFrame, name: str, aliases: Sequence[str]) -> DataFrame:
    """df with one column for what older files name otherwise."""
    found = [c for c in (name, *aliases) if c in df.columns]
    return df.withColumn(name, F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in found))).drop(*(c for c in found if c != name))
