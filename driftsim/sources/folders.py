"""Names, small texts and deletions below a folder of any store that Spark reads."""

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is not there."""
    files, where = _at(spark, path)
    if not files.exists(where):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(where))


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file with all below it; nothing happens if it is gone already."""
    files, where = _at(spark, path)
    files.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _at(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a text in place in one step: a reader finds all of it or none."""
    files, where = _at(spark, path)
    _, part = _at(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    stream = files.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not files.rename(part, where):
        files.delete(part, False)
        raise FileExistsError(path)
