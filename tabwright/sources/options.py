"""Options of readers and writers."""

from __future__ import annotations

import enum
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class LoadOptions:
    """categorical_threshold: text whose distinct values are a smaller share of all rows becomes categorical; 1 never does."""

    categorical_threshold: float = 0.5
    has_header: bool = True

    def __post_init__(self):
        if not 0.0 <= self.categorical_threshold <= 1.0:
            raise ValueError(f"categorical_threshold {self.categorical_threshold} isn't between 0 and 1")


@dataclass(frozen=True)
class CsvOptions(LoadOptions):
    """multi_line allows line breaks in quotes, at the price of reading each file by one task."""

    delimiter: str = ","
    quote: str = '"'
    encoding: str = "UTF-8"
    empty_as_null: bool = True
    multi_line: bool = False

    def __post_init__(self):
        super().__post_init__()
        if self.delimiter == self.quote:
            raise ValueError("delimiter and quote must differ")

    @classmethod
    def european(cls) -> CsvOptions:
        return cls(delimiter=";")

    @classmethod
    def tab(cls) -> CsvOptions:
        return cls(delimiter="\t")

    @classmethod
    def of(cls, options: LoadOptions | None) -> CsvOptions:
        """CSV options with what general options say."""
        if options is None or isinstance(options, cls):
            return options or cls()
        return cls(options.categorical_threshold, options.has_header)


class JsonOrientation(enum.Enum):
    RECORDS = "records"
    COLUMNS = "columns"
    SPLIT = "split"


@dataclass(frozen=True)
class JsonOptions(LoadOptions):
    """orientation None: found from the text."""

    orientation: JsonOrientation | None = None
    indented: bool = True

    @classmethod
    def of(cls, options: LoadOptions | None) -> JsonOptions:
        if options is None or isinstance(options, cls):
            return options or cls()
        return cls(options.categorical_threshold, options.has_header)


@dataclass(frozen=True)
class ExcelOptions:
    sheet_name: str = "Sheet1"

    def renamed(self, name: str) -> ExcelOptions:
        return replace(self, sheet_name=name)
