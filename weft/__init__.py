"""weft: a PySpark-native engine for versioned, typed datasets."""

from . import models
from .api import (
    Values, datasets, delete_dataset, from_csv, from_database, from_dataset, from_hf, from_json, from_pandas, from_parquet, from_records, from_storage, from_values, listings, move_dataset,
    read_csv, read_database, read_hf, read_json, read_listing_dataset, read_pandas, read_parquet, read_records, read_saved, read_storage, read_values,
)
from .chain import Chain, DatasetNotFoundError, read_dataset
from .columns import C
from .files import AudioFile, File, ImageFile, TextFile
from .operators.udf import Aggregator, BatchMapper, Generator, Mapper, UserCodeError
from .params import metrics, param
from .plans.catalog import Catalog

__version__ = "0.2.0"
__all__ = [
    "Aggregator", "AudioFile", "BatchMapper", "C", "Catalog", "Chain", "DatasetNotFoundError", "File", "Generator", "ImageFile", "Mapper", "TextFile", "UserCodeError", "Values", "datasets",
    "delete_dataset", "from_csv", "from_database", "from_dataset", "from_hf", "from_json", "from_pandas", "from_parquet", "from_records", "from_storage", "from_values", "listings", "metrics",
    "models", "move_dataset", "param", "read_csv", "read_database", "read_dataset", "read_hf", "read_json", "read_listing_dataset", "read_pandas", "read_parquet", "read_records", "read_saved",
    "read_storage", "read_values",
]
