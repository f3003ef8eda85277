"""Sources and sinks: the raw panel, driver test tables, written stages."""

from paddock.sources.fixtures import panel_fixture, read_table, vector_fixture
from paddock.sources.io import read_raw_panel, write_panel, write_report

__all__ = [
    "panel_fixture",
    "read_table",
    "vector_fixture",
    "read_raw_panel",
    "write_panel",
    "write_report",
]
