"""Scans and sinks: feature tables (CSV or Parquet), the dataset catalogue,
first-available file choice, recorded model replies."""

from synthlens.sources.catalog import CATALOG, DARPA99, NB15, DatasetSpec, catalog_frame
from synthlens.sources.files import (first_available, path_exists, read_table, scan_clean, scan_features,
                                     write_sheet)

__all__ = ["CATALOG", "DARPA99", "NB15", "DatasetSpec", "catalog_frame", "first_available", "path_exists",
           "read_table", "scan_clean", "scan_features", "write_sheet"]
