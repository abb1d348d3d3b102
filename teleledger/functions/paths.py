"""Recording file paths: ``//server/folder/to/file``; the empty path means the file is gone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shape every stored path has.
VALID_PATH = "//[^/]+/[^/]+/.*"


def is_valid(path: Column) -> Column:
    return F.coalesce(path.rlike(rf"(?d)\A{VALID_PATH}\z"), F.lit(False))


def in_folder(path: Column, folder: str) -> Column:
    """The folder is a regular expression of the caller's; a missing path never matches."""
    return F.coalesce(path.rlike(f"(?d)^//[^/]+/{folder}/.*$"), F.lit(False))


def folder_of(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(4))


def server_of(path: Column) -> Column:
    return F.when(path.startswith("//"), F.try_element_at(F.split(path, "/"), F.lit(3)))


def parent_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "(?s)^(.*)/", 1), F.lit(""))


def with_folder(path: Column, folder: Column) -> Column:
    """Swap the folder part; null where the path has no such part."""
    parts = F.split(path, "/")
    swapped = F.concat(F.slice(parts, 1, 3), F.array(folder), F.slice(parts, F.lit(5), F.size(parts)))
    return F.when(F.size(parts) >= 4, F.array_join(swapped, "/"))


def from_recorder(prefix: str, path: Column) -> Column:
    return F.translate(F.concat(F.lit(prefix), path), "\\", "/")


def first_given(file_path: Column, old_path: Column) -> Column:
    return F.coalesce(F.nullif(file_path, F.lit("")), old_path)
