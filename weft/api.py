"""Chains from sources, in the active session."""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession

from .chain import Chain, read_dataset
from .plans.catalog import Catalog
from .sources import listing, readers


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _chain(reader):
    @functools.wraps(reader)
    def read(*args, **kwargs) -> Chain:
        return Chain(reader(_spark(), *args, **kwargs))

    return read


read_csv = _chain(readers.read_csv)
read_json = _chain(readers.read_json)
read_parquet = _chain(readers.read_parquet)
read_values = _chain(readers.read_values)
read_records = _chain(readers.read_records)
read_pandas = _chain(readers.read_pandas)
read_database = _chain(readers.read_database)
read_hf = _chain(readers.read_hf)
read_storage = _chain(listing.list_files)


# names of earlier releases
from_csv, from_json, from_parquet, from_values, from_pandas = read_csv, read_json, read_parquet, read_values, read_pandas
from_records, from_database, from_hf, from_storage = read_records, read_database, read_hf, read_storage
Values = read_values


def read_listing_dataset(name: str, version: str | None = None, path: str = "") -> Chain:
    return Chain(listing.read_listing_dataset(_spark(), name, version, path))


def read_saved(name: str, version: str | int | None = None, **kwargs) -> Chain:
    """A saved dataset in the active session."""
    return read_dataset(_spark(), name, version, **kwargs)


from_dataset = read_saved


def datasets(attrs: list[str] | None = None) -> Chain:
    return Chain(Catalog(_spark()).datasets(attrs))


def listings() -> Chain:
    return Chain(Catalog(_spark()).datasets(prefix="lst__", exclude=None))


def delete_dataset(name: str, version: str | None = None, force: bool = False) -> None:
    Catalog(_spark()).delete(name, version, force)


def move_dataset(source: str, target: str) -> None:
    Catalog(_spark()).move(source, target)
