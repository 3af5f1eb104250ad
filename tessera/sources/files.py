"""Small files and folders of any store that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all that it holds, if there is one."""
    _system(spark, path).delete(_path(spark, path), True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _system(spark, path).listStatus(_path(spark, path)) if s.isDirectory())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file, or None."""
    if not exists(spark, path):
        return None
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in the place of another by one rename: readers see the old one or the new one, never a part."""
    new = f"{path}.new"
    out = _system(spark, new).create(_path(spark, new), True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(_path(spark, new), _path(spark, path), options)
