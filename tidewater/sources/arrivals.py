"""Files that arrive over time, each read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def absorb_new_files(spark: SparkSession, folder: str, pattern: str, schema: StructType | str, store: str, log: str,
                     sep: str = ",", kind: str = "csv", files_per_batch: int | None = None) -> DataFrame:
    """Add the rows of files that are new in ``folder`` to the Parquet table ``store`` and give the whole table.

    A stream over what is there now: ``log``, a folder that outlives the job, remembers which files were read, and the
    store lists the files of finished batches. A run that is repeated, or started again after a failure, therefore reads
    only what is new, and a batch that is done twice is added once. Files are found below ``folder`` by ``pattern``; a file
    that is changed after it was read is not read again. ``files_per_batch`` bounds a batch. Rows carry their ``file``.
    """
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": True}
    if kind == "csv":
        options |= {"sep": sep, "header": True}
    if files_per_batch:
        options["maxFilesPerTrigger"] = files_per_batch
    arrived = spark.readStream.format(kind).schema(schema).options(**options).load(folder)
    rows = arrived.select("*", F.col("_metadata.file_path").alias("file"))
    job = rows.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(store)
    job.awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(store)
