"""Loaders: what turns a path into a frame, and the ones that this package has."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import SparkSession

from tabwright.frame import Frame
from tabwright.sources.csv import load_csv
from tabwright.sources.excel import load_excel
from tabwright.sources.json import load_json
from tabwright.sources.options import LoadOptions


@runtime_checkable
class Loader(Protocol):
    """A source of frames; tests and callers can bring their own."""

    def load(self, spark: SparkSession, path: str, options: LoadOptions | None = None) -> Frame: ...


class CsvLoader:
    def load(self, spark: SparkSession, path: str, options: LoadOptions | None = None) -> Frame:
        return load_csv(spark, path, options)


class JsonLoader:
    def load(self, spark: SparkSession, path: str, options: LoadOptions | None = None) -> Frame:
        return load_json(spark, path, options)


class ExcelLoader:
    def load(self, spark: SparkSession, path: str, options: LoadOptions | None = None) -> Frame:
        return load_excel(spark, path, options)


class ParquetLoader:
    """An extension: the columns' own types, whatever the options say."""

    def load(self, spark: SparkSession, path: str, options: LoadOptions | None = None) -> Frame:
        return Frame.read_parquet(spark, path)


LOADERS: dict[str, Loader] = {".csv": CsvLoader(), ".txt": CsvLoader(), ".json": JsonLoader(), ".xlsx": ExcelLoader(), ".xls": ExcelLoader(), ".parquet": ParquetLoader()}


def load(spark: SparkSession, path: str, options: LoadOptions | None = None) -> Frame:
    """A frame of a file, by its name's ending."""
    for ending, loader in LOADERS.items():
        if path.lower().rstrip("/").endswith(ending):
            return loader.load(spark, path, options)
    raise ValueError(f"no loader for {path}; there are loaders for {', '.join(LOADERS)}")
