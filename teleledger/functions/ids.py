"""Identifiers that come out the same when a job runs again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minted(*natural_key: Column) -> Column:
    """A text id from a natural key; 256 bits, so no collision at any table size."""
    return F.sha2(F.concat_ws("|", *[k.cast("string") for k in natural_key]), 256)


def service_key(onid: Column, tsid: Column, sid: Column) -> Column:
    """Network, stream and service numbers packed in 64 bits, 16 bits each from the low end."""
    return (F.shiftleft(onid.cast("bigint"), 32)
            .bitwiseOR(F.shiftleft(tsid.cast("bigint"), 16))
            .bitwiseOR(sid.cast("bigint")))


def matches_masked(key: Column, target: Column, mask: Column) -> Column:
    """Equal but for the bits set in the mask."""
    return key.bitwiseOR(mask) == target.bitwiseOR(mask)
