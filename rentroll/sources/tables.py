"""Tables by name, files by path, snapshots in the shared folder."""

import uuid

from pyspark.sql import functions as F

from rentroll.session import shared_folder


class Tables:
    """Named Parquet tables below one root; a call reads lazily, so Spark prunes columns and filters."""

    def __init__(self, spark, root):
        self.spark = spark
        self.root = str(root).rstrip("/")
        self._read = {}

    def __call__(self, name):
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]

    def path(self, name):
        return f"{self.root}/{name.split('.')[-1]}.parquet"

    def sql(self, text, tables=(), **params):
        """SQL with named parameters; ``{table}`` marks are bound to tables, never pasted as text."""
        return self.spark.sql(text, args=params, **{n: self(n) for n in tables})


def read_csv(spark, path, schema):
    """CSV with a header and a declared schema: no inference pass over the files."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_csv_checked(spark, path, schema, header=True):
    """(good rows, rejects) of a CSV with a declared schema.

    Lines that don't fit the schema become no rows with nulls: the rejects have ``line``, ``reason`` (the first column whose
    text has another type, or the number of fields) and ``file``. The files are parsed once; the result is stored, so
    that both tables come from the same parse.
    """
    fields = spark.createDataFrame([], schema).schema
    parsed = (
        spark.read.option("header", header)
        .option("columnNameOfCorruptRecord", "_line")
        .schema(f"{schema}, _line string")
        .csv(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    parsed = materialise(parsed, "parsed_csv")
    texts = F.from_csv("_line", ", ".join(f"`{f.name}` string" for f in fields), {"mode": "PERMISSIVE"})
    wrong = [
        F.when(texts[f.name].isNotNull() & texts[f.name].try_cast(f.dataType).isNull(), F.lit(f"{f.name}: no {f.dataType.simpleString()}"))
        for f in fields
    ]
    rejects = parsed.filter(F.col("_line").isNotNull())
    rejects = rejects.select(F.col("_line").alias("line"), F.coalesce(*wrong, F.lit("number of fields")).alias("reason"), F.col("_file").alias("file"))
    return parsed.filter(F.col("_line").isNull()).drop("_line", "_file"), rejects


def overwrite(df, path, partition_by=()):
    """Replace the table at ``path``; name it by a folder the whole cluster can reach."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark, name):
    return f"{shared_folder(spark)}/rentroll/{name}-{uuid.uuid4().hex}"


def materialise(df, name):
    """Write once, read many: a lost executor re-reads files instead of the lineage."""
    return overwrite(df, scratch_path(df.sparkSession, name))
