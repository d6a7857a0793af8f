"""Readers: records, extractions, sidecars, suites, logs, tables, XML, JSON. A file that can't be parsed is a row, not a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible import schemas
from crucible.functions import text


def _json(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.json") -> DataFrame:
    """One JSON document (or array of them) for each file, with ``stem``, ``run`` (its folder) and ``_corrupt_record``."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(whole).option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path, multiLine=True)
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # a path comes as a URI
    return df.select("*", text.path_stem(name).alias("stem") if "stem" not in df.columns else F.coalesce("stem", text.path_stem(name)).alias("_stem"), text.path_parent(name).alias("run"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records, one for each file."""
    return _json(spark, path, schemas.RECORD)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extractor output; files that only accompany it are left out."""
    return _json(spark, path, schemas.EXTRACTION).where(~F.col("stem").rlike(r"_insight$|\.original$|\.meta$"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Cost sidecars (``*.meta.json``) with their run."""
    df = _json(spark, path, schemas.SIDECAR, "*.meta.json")
    return df.withColumn("stem", F.regexp_replace("_stem", r"\.meta$", "")).drop("_stem")


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """A row for each image of each suite, with the suite's total time: as stated, else the sum over its images."""
    df = _json(spark, path, schemas.SUITE)
    total = F.coalesce("elapsed_total_s", "elapsed_s", F.aggregate(F.transform("per_image", lambda x: F.coalesce(x["elapsed_s"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x))
    rows = df.select("suite_id", "kind", F.coalesce("model", "vision_model").alias("model"), total.alias("suite_elapsed_s"), F.posexplode_outer("per_image").alias("pos", "i"))
    return rows.select("suite_id", "kind", "model", "suite_elapsed_s", "pos", "i.*")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.VARIANTS)


def read_gold_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of gold records: a row for each; a single object is one row."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tabular gold in Latin-1; every column is text, and rows keep their order in ``row_no``."""
    return spark.read.csv(path, header=True, encoding="ISO-8859-1", mode="PERMISSIVE", multiLine=True).withColumn("row_no", F.monotonically_increasing_id())


LOG_LINE = r"^\[(\d+)/(\d+)\]\s+(\w+)\s+(\S+)\s+\(([\d.]+)s,\s*(\d+) tools?,\s*in=(\d+),\s*out=(\d+)\)"


def parse_run_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Progress lines of a run log as sidecar rows; other lines are dropped."""
    part = lambda k, kind: F.regexp_extract(column, LOG_LINE, k).cast(kind)
    hit = lines.where(F.col(column).rlike(LOG_LINE))
    return hit.select(text.path_stem(part(4, "string")).alias("stem"), (F.regexp_extract(column, LOG_LINE, 3) == "OK").alias("ok"), part(5, "double").alias("elapsed_s"), part(6, "int").alias("tool_calls"), part(7, "long").alias("input_tokens"), part(8, "long").alias("output_tokens"))


HEADER = r"^-{6,} \S+ \((\w+)\) -{6,}$"


def parse_conversation(lines: DataFrame, file: str = "file", number: str = "line_no", column: str = "value") -> DataFrame:
    """Transcript lines as messages (file, message, agent, text) in order; what stands before the first header is dropped."""
    by_file = Window.partitionBy(file).orderBy(number)
    marked = lines.withColumn("_agent", F.nullif(F.regexp_extract(column, HEADER, 1), F.lit(""))).withColumn("message", F.sum(F.when(F.col("_agent").isNotNull(), 1).otherwise(0)).over(by_file))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_agent").isNull(), F.struct(number, column)))), lambda x: x[column]), "\n")
    return marked.where("message > 0").groupBy(file, "message").agg(F.max("_agent").alias("agent"), F.trim(body).alias("text"))


def read_reaction_xml(spark: SparkSession, path: str) -> DataFrame:
    """Patent reactions: the reaction string, and reactants, products and agents joined by dots per role."""
    smiles = "struct<identifier: array<struct<_dictRef: string, _value: string>>, _role: string>"
    schema = schemas.schema(f"reactionSmiles string, productList struct<product: array<{smiles}>>, reactantList struct<reactant: array<{smiles}>>, spectatorList struct<spectator: array<{smiles}>>, source struct<documentId: string, paragraphText: string>")
    df = spark.read.format("xml").schema(schema).option("rowTag", "reaction").option("valueTag", "_value").load(path)
    one = lambda x: F.get(F.transform(F.filter(x["identifier"], lambda i: F.endswith(i["_dictRef"], F.lit("smiles"))), lambda i: i["_value"]), F.lit(0))
    joined = lambda c, role=None: F.coalesce(F.array_join(F.filter(F.transform(F.filter(c, lambda x: F.lit(True) if role is None else x["_role"] == role), one), lambda s: s.isNotNull()), "."), F.lit(""))
    sides = F.split("reactionSmiles", ">")
    return df.select(
        "reactionSmiles", F.get(sides, F.lit(0)).alias("REACTANTS"), F.element_at(sides, -1).alias("PRODUCTS"), joined(F.col("productList.product")).alias("product"), joined(F.col("reactantList.reactant")).alias("reactant"),
        joined(F.col("spectatorList.spectator"), "solvent").alias("SOLVENT"), joined(F.col("spectatorList.spectator"), "catalyst").alias("CATALYST"), F.col("source.documentId").alias("REF"),
    )


ORD = schemas.schema(
    "reaction_id string, inputs map<string, struct<components: array<struct<identifiers: array<struct<type: string, value: string>>, reaction_role: string>>>>, "
    "outcomes array<struct<reaction_time: struct<value: double, units: string>, products: array<struct<identifiers: array<struct<type: string, value: string>>, is_desired_product: boolean, "
    "measurements: array<struct<type: string, percentage: struct<value: double>, float_value: struct<value: double>>>>>>>, notes struct<procedure_details: string>, provenance struct<doi: string>"
)


def flatten_ord(df: DataFrame) -> DataFrame:
    """Open-reaction documents as flat rows: structures by role, the last stated time, the best yield, procedure and source.

    The yield is the greatest over desired products, else over all; a float value goes before a percentage. Solvents are sorted.
    """
    parts = F.flatten(F.transform(F.map_values("inputs"), lambda x: x["components"]))
    structure = lambda x: F.get(F.transform(F.filter(x["identifiers"], lambda i: i["type"] == "SMILES"), lambda i: i["value"]), F.lit(0))
    of = lambda *roles: F.filter(F.transform(F.filter(parts, lambda c: c["reaction_role"].isin(*roles)), structure), lambda s: s.isNotNull())
    products = F.flatten(F.transform("outcomes", lambda o: F.coalesce(o["products"], F.array().cast(ORD["outcomes"].dataType.elementType["products"].dataType))))
    measured = lambda ps: F.array_max(F.flatten(F.transform(ps, lambda p: F.transform(F.filter(p["measurements"], lambda m: m["type"] == "YIELD"), lambda m: F.coalesce(m["float_value"]["value"], m["percentage"]["value"])))))
    times = F.filter("outcomes", lambda o: o["reaction_time"].isNotNull())
    last = F.when(F.size(times) > 0, F.element_at(times, -1)["reaction_time"])
    solvents, made = F.array_sort(F.array_distinct(of("SOLVENT"))), F.filter(F.transform(products, structure), lambda s: s.isNotNull())
    return df.select(
        "reaction_id", F.concat(F.array_join(of("REACTANT"), "."), F.lit(">>"), F.array_join(made, ".")).alias("REACTION"), F.array_join(solvents, ".").alias("SOLVENT"), F.array_join(of("CATALYST"), ".").alias("CATALYST"), F.array_join(of("REAGENT"), ".").alias("REAGENT"),
        last["value"].alias("time"), last["units"].alias("time_units"), F.coalesce(measured(F.filter(products, lambda p: p["is_desired_product"])), measured(products)).alias("YIELD"), F.col("notes.procedure_details").alias("procedure"), F.col("provenance.doi").alias("DOI"),
    )


def read_db(spark: SparkSession, path: str) -> DataFrame:
    """A reaction database as ``write_db`` left it."""
    return spark.read.parquet(path)


def read_db_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A reaction database from CSV with a header: text, but for the yield."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    return df.withColumns({c: F.col(c).try_cast("double") for c in df.columns if c == "YIELD"})


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """A pattern database of JSON lines, ordered by its ``pos`` column."""
    return spark.read.schema(schemas.PATTERN).json(path)


def list_corpus(spark: SparkSession, path: str, extension: str = "*") -> DataFrame:
    """Files below a folder: path, stem, suffix, length, time. Their contents are never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension.lstrip('.')}" if extension != "*" else "*").load(path)
    return df.select("path", text.path_stem("path").alias("stem"), text.path_suffix("path").alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def list_runs(files: DataFrame, folders: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Runs (folders of result files) by latest change, with their size and the user's folder for them; 1 to 500 of them."""
    runs = files.groupBy(text.path_parent("path").alias("run")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modified").alias("modified"))
    if folders is not None:
        runs = runs.join(folders.select("run", "folder"), "run", "left")
    return runs.orderBy(F.desc("modified"), "run").limit(max(1, min(500, limit)))


def read_trend(spark: SparkSession, path: str, sep: str = ",", year: str = "year") -> DataFrame:
    """A wide yearly table as (year, series, value)."""
    df = spark.read.csv(path, header=True, sep=sep)
    return df.unpivot(year, [c for c in df.columns if c != year], "series", "value").select(F.col(year).cast("int").alias("year"), "series", F.col("value").try_cast("double").alias("value"))


def read_dimension(spark: SparkSession, path: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """A reference table from CSV: one row for each key, the first by its other columns where it has several."""
    df = spark.read.csv(path, header=True)
    columns = columns or [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_r")).select(key, "_r.*")


def read_ghs(documents: DataFrame, column: str = "document") -> DataFrame:
    """Hazard statements of safety documents (JSON trees as text): (name, codes, statements, pictograms, signal).

    Of the sections on hazards, the statements of the first reference count. List columns are arrays; join them at the sink.
    """
    schema = (
        "struct<Record: struct<RecordTitle: string, Section: array<struct<TOCHeading: string, Section: array<struct<TOCHeading: string, Section: array<struct<TOCHeading: string, "
        "Information: array<struct<ReferenceNumber: int, Name: string, Value: struct<StringWithMarkup: array<struct<String: string>>>>>>>>>>>, Reference: array<struct<ReferenceNumber: int, SourceName: string>>>>"
    )
    doc = documents.select(F.from_json(column, schema).alias("d"))
    first = F.get(F.transform(F.filter("d.Record.Reference", lambda r: F.contains(r["SourceName"], F.lit("ECHA"))), lambda r: r["ReferenceNumber"]), F.lit(0))
    rows = doc.select(F.col("d.Record.RecordTitle").alias("name"), first.alias("reference"), F.explode("d.Record.Section").alias("s")).where("s.TOCHeading = 'Safety and Hazards'")
    rows = rows.select("name", "reference", F.explode("s.Section").alias("s")).where("s.TOCHeading = 'Hazards Identification'").select("name", "reference", F.explode("s.Section").alias("s")).where("s.TOCHeading = 'GHS Classification'")
    info = rows.select("name", "reference", F.explode("s.Information").alias("i")).where("i.ReferenceNumber = reference")
    values = info.select("name", F.col("i.Name").alias("kind"), F.explode("i.Value.StringWithMarkup").alias("v")).select("name", "kind", F.col("v.String").alias("value"))
    lines = values.withColumns({"code": F.regexp_extract("value", r"^(H\d{3}[A-Za-z]*)", 1), "statement": F.trim(F.element_at(F.split("value", ":", 2), -1))})
    keep = lambda kind, c: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.nullif(c, F.lit("")))))
    return lines.groupBy("name").agg(keep("GHS Hazard Statements", "code").alias("codes"), keep("GHS Hazard Statements", "statement").alias("statements"), keep("Pictogram(s)", "value").alias("pictograms"), F.max(F.when(F.col("kind") == "Signal", F.col("value"))).alias("signal"))
