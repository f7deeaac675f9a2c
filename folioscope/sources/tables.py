"""Reading the tables, settled results, and the session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table. Columns and filters of what follows are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(app: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.master(master) if master else builder
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, one of this machine in local mode (tests); else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nlm_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of `key: value` lines between dashed rules, as a map column `fields`.

    A line is cut at its first colon; of a repeated key the last value stays; records without id, title or ISSN go.
    """
    from pyspark.sql import functions as F

    blocks = spark.read.option("lineSep", "--------------------------------------------------------").text(path)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    # An entry stays if no later one has its key.
    last = F.filter("p", lambda x, i: ~F.exists(F.slice("p", i + 2, F.size("p")), lambda y: y["k"] == x["k"]))
    fields = blocks.select(pairs.alias("p")).select(F.map_from_entries(last).alias("fields"))
    named = [F.coalesce(*[F.try_element_at("fields", F.lit(k)) for k in keys], F.lit("")) != "" for keys in (("NlmId",), ("JournalTitle",), ("ISSN (Print)", "ISSN (Online)"))]
    return fields.where(named[0] & named[1] & named[2])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Delimited records with a header, all columns text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')
