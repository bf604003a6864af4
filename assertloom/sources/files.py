"""Readers and writers of datasets, generated sets, pairs and HDL text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "SVA STRING, sva STRING, SVAD STRING, CoT STRING, metadata MAP<STRING, STRING>"
PROPERTY = "name STRING, sva STRING, svad STRING, property_block STRING, translation STRING"
EXTENSIONS = ("sv", "sva", "svh")
BLOCKS, INLINES = r"(?i)property\s+\w+\s*;[\s\S]*?endproperty", r"(?i)(?:assert|assume|cover)\s+property\s*\([^;]*\)\s*;"


def _json(spark: SparkSession, path: str) -> DataFrame:
    """Each file's text as a VARIANT, which keeps absent keys apart from nulls."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.json*").select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("v"))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(pos, SVA, SVAD, CoT, metadata) of a JSON list of entries, or of an object with the list as `data`; anything else raises.

    `SVA` decides where its key is there, even if null; only without it does `sva` count. `pos` is the place in the list.
    """
    v = _json(spark, path)
    root = F.coalesce(F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")), F.try_variant_get("v", "$.data", "variant"))
    rows = v.select(F.when(F.coalesce(F.schema_of_variant(root).startswith("ARRAY"), F.lit(False)), root).otherwise(F.raise_error(F.lit("neither a list of entries nor an object with a list as data"))).alias("v"))
    each = rows.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "e"))

    def text(key: str) -> Column:
        return F.try_variant_get("e", f"$.{key}", "string")

    has = F.map_contains_key(F.try_variant_get("e", "$", "map<string, variant>"), "SVA")
    return each.select("pos", F.when(has, text("SVA")).otherwise(text("sva")).alias("SVA"), text("SVAD").alias("SVAD"), text("CoT").alias("CoT"), F.try_variant_get("e", "$.metadata", "map<string, string>").alias("metadata"))


def entries_of(lines: DataFrame) -> DataFrame:
    """Rows with SVA or sva columns as entries with an assertion; empty ones are dropped."""
    sva = F.coalesce(*[F.col(c) for c in ("SVA", "sva") if c in lines.columns])
    return lines.withColumn("SVA", sva).where(F.length("SVA") > 0)


def benchmarkable(items: DataFrame) -> DataFrame:
    return items.where((F.length("SVAD") > 0) & (F.length("SVA") > 0))


def as_json(entries: DataFrame) -> DataFrame:
    """One column `value`: each entry as JSON, without parts that are null and without empty metadata."""
    meta = F.when(F.size("metadata") > 0, F.col("metadata"))
    return entries.select(F.to_json(F.struct(F.coalesce("SVA", F.lit("")).alias("SVA"), "SVAD", "CoT", meta.alias("metadata"))).alias("value"))


def write_dataset(entries: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Entries as JSON Lines; with metadata, a file of it beside them in `path`-metadata."""
    as_json(entries).write.mode("overwrite").text(path)
    if metadata:
        entries.sparkSession.createDataFrame([(json.dumps(metadata, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-metadata")


def export_json(entries: DataFrame, path: str, metadata: dict | None = None, order: str = "pos") -> None:
    """One pretty JSON file on the driver's disk, for small datasets that people read: a list, or {metadata, data}. Rows pass one by one."""
    with open(path, "w", encoding="utf-8") as f:
        if metadata:
            f.write('{\n  "metadata": ' + json.dumps(metadata, ensure_ascii=False, indent=2) + ',\n  "data": ')
        f.write("[")
        for i, r in enumerate(as_json(entries.orderBy(order)).toLocalIterator()):
            f.write((",\n" if i else "\n") + json.dumps(json.loads(r.value), ensure_ascii=False, indent=2))
        f.write("\n]" + ("\n}" if metadata else "") + "\n")


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, sva, svad, property_block, translation) of {"properties": [...]}, old or new; a list element may be the bare text."""
    v = _json(spark, path)
    root = F.coalesce(F.try_variant_get("v", "$.properties", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    each = v.select(F.posexplode(root).alias("pos", "e"))
    columns = [F.try_variant_get("e", f"$.{c.split()[0]}", "string").alias(c.split()[0]) for c in PROPERTY.split(", ")]
    bare = F.when(F.schema_of_variant("e") == "STRING", F.try_variant_get("e", "$", "string"))
    return each.select("pos", *columns, bare.alias("_bare")).withColumn("sva", F.coalesce("sva", "_bare")).drop("_bare")


def write_generated(properties: DataFrame, path: str, coverage: DataFrame | None = None) -> None:
    """Properties as JSON Lines, and coverage beside them in `path`-coverage."""
    properties.write.mode("overwrite").json(path)
    if coverage is not None:
        coverage.write.mode("overwrite").json(f"{path}-coverage")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, sva1, sva2) of a JSON list with either spelling of the sides; entries that are no objects or lack a side are dropped.

    An entry without an id is entry_N by its place; a file that is no list raises.
    """
    v = _json(spark, path)
    ok = F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False))
    rows = v.select(F.posexplode(F.when(ok, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.raise_error(F.lit("not a list of pairs")))).alias("pos", "e"))

    def text(*keys: str) -> Column:
        return F.coalesce(*[F.try_variant_get("e", f"$.{k}", "string") for k in keys])

    out = rows.select(F.coalesce(text("id"), F.concat(F.lit("entry_"), F.col("pos").cast("string"))).alias("id"), text("sva1", "antecedent").alias("sva1"), text("sva2", "consequent").alias("sva2"))
    return out.where((F.length("sva1") > 0) & (F.length("sva2") > 0))


def read_hdl(spark: SparkSession, path: str, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, text) of the HDL files of a folder, or of one file."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    out = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if recursive:
        return out
    own = path.removeprefix("file:").rstrip("/")
    return out.where(F.regexp_replace("path", "/[^/]*$", "").endswith(own) | F.col("path").endswith(own))


def write_hdl(texts: DataFrame, path: str, text: str = "text") -> None:
    texts.select(text).write.mode("overwrite").text(path)


def properties_of(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, pass, pos, sva): the property blocks of each text (pass 0), then its inline assertions (pass 1), each in order."""
    both = [files.select(path, F.lit(i).alias("pass"), F.posexplode(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("pos", "sva")) for i, p in enumerate((BLOCKS, INLINES))]
    return both[0].unionByName(both[1])


def translated(properties: DataFrame, describe, sva: str = "sva") -> DataFrame:
    """properties with `translation`, "" for a text that is null or blank."""
    return properties.withColumn("translation", F.when(F.trim(F.regexp_replace(sva, r"\s+", " ")) != "", describe(F.col(sva))).otherwise(F.lit("")))


def chat_samples(entries: DataFrame, system: str = "You write SystemVerilog assertions.") -> DataFrame:
    """One column `value`: {"messages": [system, user, assistant]} as JSON for each entry with both sides and no error."""

    def message(role: str, c: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), c.alias("content"))

    failed = F.col("metadata").isNotNull() & (F.map_contains_key("metadata", "svad_error") | F.map_contains_key("metadata", "cot_error"))
    good = benchmarkable(entries).where(~failed)
    return good.select(F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", F.col("SVAD")), message("assistant", F.col("SVA"))).alias("messages"))).alias("value"))


def first_rows(data: DataFrame, n: int = 1000, order: str = "pos", sva: str = "SVA") -> DataFrame:
    """(sva, sva_id) of the first n rows in order: a projection for small trials."""
    return data.orderBy(order).limit(n).select(F.col(sva).alias("sva"), F.col(order).alias("sva_id"))


def training_samples(properties: DataFrame, order: str = "pos") -> DataFrame:
    """(id, sva, svad, property_block) for export."""
    return properties.select(F.col(order).alias("id"), "sva", "svad", "property_block")


def prover_config(top: Column, depth: int = 20, engine: str = "smtbmc", mode: str = "prove") -> Column:
    """The text of a prover's configuration for a top module in TOP.sv."""
    head = f"[options]\nmode {mode}\ndepth {depth}\n\n[engines]\n{engine}\n\n[script]\nread -formal "
    return F.concat(F.lit(head), top, F.lit(".sv\nprep -top "), top, F.lit("\n\n[files]\n"), top, F.lit(".sv\n"))
