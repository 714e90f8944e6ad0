"""A data source of positioned text: JSON-lines dumps of pages' text items as the items table.

Decks are decoded outside; a dump has one JSON object a line with doc, page and
items of [text, x, y, font size, font name, width].  Each file is a partition.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from deckweave.sources.files import file_system, files_below

SCHEMA = "doc string, page int, seq int, text string, x double, y double, font_size double, font_name string, width double"


class PositionedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "positioned_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        return [_File(p) for p in files_below(self.path, ".jsonl")]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, place = file_system(partition.path)
        with io.TextIOWrapper(io.BufferedReader(system.open_input_stream(place)), encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    page = json.loads(line)
                    for seq, (text, x, y, size, font, width) in enumerate(page["items"]):
                        yield page["doc"], int(page["page"]), seq, text, float(x), float(y), abs(float(size)), font, None if width is None else float(width)
