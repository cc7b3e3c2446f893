"""Settings: word coercion as columns, and merging of configuration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide.functions import constants as K

MERGED_KEYS = ["model_overrides", "api_keys", "cloud_chain", "cloud_models"]


def as_flag(word: Column) -> Column:
    return F.lower(F.trim(word)).isin(K.TRUE_WORDS)


def as_number(word: Column) -> Column:
    return word.try_cast("double")


def as_mode(word: Column) -> Column:
    """local or cloud, NULL for anything else."""
    word = F.lower(F.trim(word))
    return F.when(word.isin("local", "cloud"), word)


def merged(defaults: dict, user: dict, merged_keys=MERGED_KEYS) -> dict:
    """User settings over defaults; listed keys that hold maps are merged."""
    result = dict(defaults)
    for key, value in user.items():
        old = defaults.get(key)
        both = key in merged_keys and isinstance(value, dict) and isinstance(old, dict)
        result[key] = {**old, **value} if both else value
    return result
