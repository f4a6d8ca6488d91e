"""Queries that write files in the engine's formats and read them back, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources import tables as T
from .catalog import query, r

C = F.col


@query("SELECT event_id, value, user_id, NULL::VARCHAR AS event_type FROM events WHERE event_type = 'click' AND value > 20 UNION ALL SELECT event_id, value, NULL, event_type FROM events WHERE event_type = 'view' AND value > 20")
def union_scan(spark, d):
    """Two files with unlike columns under one another, filtered as they are read."""
    e, path = T.read(spark, d, "events"), T.new_path(spark, "union")
    e.where("event_type = 'click'").select("event_id", "value", "user_id").write.parquet(f"{path}/a")
    e.where("event_type = 'view'").select("event_id", "value", "event_type").write.parquet(f"{path}/b")
    return files.scan(spark, [f"{path}/a", f"{path}/b"], ["event_id", "value", "user_id", "event_type"], "value > 20")


@query("SELECT id, k, tid, t, stat FROM {T} WHERE tid IN (1, 2, 3, 5, 8, 13, 21, 34) AND k IN ('click', 'view')")
def triggers_of_templates(spark, d):
    """Triggers written by detector and template, and those of a few templates in two detectors read back."""
    path = T.new_path(spark, "triggers")
    files.write_triggers(T.triggers(spark, d), path)
    return files.read_triggers(spark, path, ["click", "view"], [1, 2, 3, 5, 8, 13, 21, 34]).select("id", "k", "tid", "t", "stat")


@query("SELECT n_nationkey, n_name, 'run 1' AS name, 2.5::DOUBLE AS rate, 'x' AS note FROM nation WHERE n_regionkey = 1")
def saved_dictionary(spark, d):
    """A dictionary with a table, a text and a group within, saved and loaded."""
    path = T.new_path(spark, "dictionary")
    nation = T.read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    files.save(path, {"nation": nation, "name": "run 1", "inner": {"rate": 2.5, "notes": ["x", "y"]}}, spark)
    x = files.load(path, spark)
    return x["nation"].where("n_regionkey = 1").select("n_nationkey", "n_name", F.lit(x["name"]).alias("name"), F.lit(x["inner"]["rate"]).alias("rate"), F.lit(x["inner"]["notes"][0]).alias("note"))


@query("SELECT p_partkey::DOUBLE AS f, round(p_retailprice * p_retailprice, 4) AS psd FROM part WHERE p_partkey >= 15")
def spectrum_of_text(spark, d):
    """Amplitudes written as text, read as a spectrum from a lowest frequency on."""
    path = T.new_path(spark, "spectrum")
    line = F.concat(F.lit("  "), C("p_partkey").cast("string"), F.lit(" \t "), C("p_retailprice").cast("string"))
    T.read(spark, d, "part").select(line.alias("value")).union(spark.createDataFrame([("# f amplitude",), ("",)], "value string")).write.text(path)
    return files.spectrum_text(spark, path, 15.0).select("f", r(C("psd"), 4).alias("psd"))


@query("SELECT s_suppkey AS event, s_name AS name, s_acctbal AS snr FROM supplier")
def xml_table(spark, d):
    """Rows put into a light-weight XML document for each nation, and read as a table."""
    path = T.new_path(spark, "xml")
    row = F.concat_ws(",", C("s_suppkey").cast("string"), F.concat(F.lit('"'), "s_name", F.lit('"')), C("s_acctbal").cast("string"))
    rows = F.array_join(F.sort_array(F.collect_list(row)), ",\n")
    columns = "".join(f'<Column Name="sngl:{n}" Type="{t}"/>' for n, t in (("event", "int_8s"), ("name", "lstring"), ("snr", "real_8")))
    text = F.concat(F.lit(f'<Doc><Table Name="sngl:table">{columns}<Stream Name="sngl:table" Delimiter=",">'), rows, F.lit("</Stream></Table></Doc>"))
    s = T.read(spark, d, "supplier").groupBy("s_nationkey").agg(text.alias("value"))
    for n in range(2):  # two documents
        half = s.where(C("s_nationkey") % 2 == n).orderBy("s_nationkey").agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
        half.select(F.concat(F.lit("<All>"), "value", F.lit("</All>")).alias("value")).coalesce(1).write.text(f"{path}/{n}")
    return _documents(spark, path)


def _documents(spark, path):
    whole = spark.read.text([f"{path}/0", f"{path}/1"], wholetext=True)
    each = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<Doc>.*?</Doc>"), 0)).alias("value"))
    return each.select(F.explode(files.xml_rows(C("value"), "sngl", {"event": "bigint", "name": "string", "snr": "double"})).alias("x")).select("x.*")
