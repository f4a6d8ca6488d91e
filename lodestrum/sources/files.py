"""Files in and out: unions of files, triggers by template and detector, dictionaries, text series and XML tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that triggers are dealt to by template, so that a reader of few templates opens few files.
PARTS = 32


def scan(spark: SparkSession, paths: list[str], columns: list[str] | None = None, where: str | None = None, origin: str | None = None) -> DataFrame:
    """Rows of many Parquet files or folders that meet where; columns a file lacks are null.

    Only the named columns are read, and what of where the format can judge is judged there.
    origin names a column for the file a row came from.
    """
    d = spark.read.option("mergeSchema", "true").parquet(*paths)
    if origin:
        d = d.withColumn(origin, F.input_file_name())
        columns = [*columns, origin] if columns else None
    d = d.where(where) if where else d
    return d.select(*columns) if columns else d


def write_triggers(d: DataFrame, path: str, detector: str = "k", template: str = "tid") -> None:
    """Triggers by detector and by a hash of their template, sorted by it within a file."""
    part = F.pmod(F.hash(template), F.lit(PARTS)).alias("part")
    d = d.withColumn("part", part)
    d.repartition(detector, "part").sortWithinPartitions(detector, "part", template).write.partitionBy(detector, "part").parquet(path)


def read_triggers(spark: SparkSession, path: str, detectors: list[str] | None = None, templates: list[int] | None = None, detector: str = "k", template: str = "tid") -> DataFrame:
    """Triggers of the detectors and templates; folders that hold none of them are not opened."""
    d = spark.read.parquet(path)
    if detectors is not None:
        d = d.where(F.col(detector).isin(detectors))
    if templates is not None:
        kind = d.schema[template].dataType
        parts = F.array(*[F.pmod(F.hash(F.lit(x).cast(kind)), F.lit(PARTS)) for x in templates])
        found = spark.range(1).select(F.array_distinct(parts).alias("p")).first()["p"]  # one row: the wanted folders
        d = d.where(F.col("part").isin(found) & F.col(template).isin(templates))
    return d.drop("part")


def save(path: str, values: dict, spark: SparkSession) -> None:
    """A dictionary of tables, numbers, texts, lists and dictionaries, each table a folder of its own."""
    plain: dict = {}
    for name, v in values.items():
        if isinstance(v, DataFrame):
            v.write.parquet(f"{path}/{name}")
        elif isinstance(v, dict):
            save(f"{path}/{name}", v, spark)
            plain[name] = {"__group__": True}
        else:
            plain[name] = v
    tables = [n for n, v in values.items() if isinstance(v, DataFrame)]
    spark.createDataFrame([(json.dumps({"tables": tables, "plain": plain}),)], "value string").coalesce(1).write.text(f"{path}/_index")


def load(path: str, spark: SparkSession) -> dict:
    """What save() put there."""
    index = json.loads(spark.read.text(f"{path}/_index").first()["value"])  # one row
    out = {n: load(f"{path}/{n}", spark) if isinstance(v, dict) and v.get("__group__") else v for n, v in index["plain"].items()}
    return out | {n: spark.read.parquet(f"{path}/{n}") for n in index["tables"]}


def text_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Numbers in columns between white space, as doubles; lines that begin with # are comments."""
    t = spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'")
    parts = F.split(F.trim("value"), r"\s+")
    return t.select(*[F.get(parts, i).cast("double").alias(n) for i, n in enumerate(names)])


def spectrum_text(spark: SparkSession, path: str, low: float = 0.0, amplitude: bool = True) -> DataFrame:
    """(f, psd) of a text file of frequencies and amplitudes (else powers), from low on."""
    t = text_columns(spark, path, ["f", "v"]).where(F.col("f") >= low)
    return t.select("f", (F.col("v") * F.col("v") if amplitude else F.col("v")).alias("psd"))


def xml_rows(text: Column, table: str, columns: dict[str, str]) -> Column:
    """The rows of a table in a light-weight XML document: columns by name as it lists them, cast to the given types."""
    def of(what: str) -> str:
        return f"//Table[starts-with(@Name, '{table}')]/{what}"

    names = F.transform(F.xpath(text, F.lit(of("Column/@Name"))), lambda n: F.element_at(F.split(n, ":"), -1))
    cells = F.transform(F.split(F.xpath_string(text, F.lit(of("Stream"))), ","), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s", " ")), '^"|"$', ""))
    place = lambda found, n: F.nullif(F.array_position(found, n).cast("int"), F.lit(0)) - 1
    # The document is taken apart once: what a lambda does not take as its variable it works out anew for every row.
    parts = F.array(F.struct(names.alias("n"), cells.alias("c")))
    parts = F.transform(parts, lambda p: F.struct(F.size(p["n"]).alias("wide"), p["c"].alias("c"), *[place(p["n"], n).alias(f"_{k}") for k, n in enumerate(columns)]))

    def rows(p: Column) -> Column:
        row = lambda i: F.struct(*[F.get(p["c"], i * p["wide"] + p[f"_{k}"]).cast(t).alias(n) for k, (n, t) in enumerate(columns.items())])
        return F.when(F.size(p["c"]) >= p["wide"], F.transform(F.sequence(F.lit(0), F.floor(F.size(p["c"]) / p["wide"]).cast("int") - 1), row))

    return F.get(F.transform(parts, rows), F.lit(0))


def xml_table(spark: SparkSession, path: str, table: str, columns: dict[str, str]) -> DataFrame:
    """Rows of a table of light-weight XML files; a file is one row until then."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.explode(xml_rows(F.col("value"), table, columns)).alias("x")).select("x.*")
