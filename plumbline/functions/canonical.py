"""Canonical JSON and the identities derived from it."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions.hashing import HEX64

#: The tag of chunk identities; pass another one to read inventories made under another recipe.
CHUNK_TAG = "plumbline.chunk.v1"


def check_native(value: Any) -> None:
    """Only what JSON has: text keys, lists, finite numbers."""
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise ValueError("keys must be text")
            check_native(v)
    elif isinstance(value, list):
        for v in value:
            check_native(v)
    elif isinstance(value, float) and not math.isfinite(value):
        raise ValueError("numbers must be finite")
    elif value is not None and not isinstance(value, (str, int, float, bool)):
        raise ValueError("not a JSON value")


def canonical(value: Any) -> str:
    """Sorted keys, no blanks, ASCII only."""
    check_native(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


@F.pandas_udf(StringType())
def _quoted(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else json.dumps(x))


def quoted(text: Column) -> Column:
    """Text as ASCII JSON. Plain text takes the short way inside the JVM: only what needs escapes goes to Python."""
    plain = text.rlike(r'^[\x20\x21\x23-\x5B\x5D-\x7E]*$')
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(_quoted(F.when(~plain, text)))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def json_list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def text_hash(text: Column) -> Column:
    return sha(quoted(text))


def chunk_id(namespace: Column, document_id: Column, chunk_key: Column, tag: str = CHUNK_TAG) -> Column:
    """Identity by namespace, document and key; text and version have no part in it."""
    return sha(json_list(F.lit(json.dumps(tag)), quoted(namespace), quoted(document_id), quoted(chunk_key)))


def embedding_hash(text_hash: Column, model: str, pipeline: str) -> Column:
    return sha(json_list(F.concat(F.lit('"'), text_hash, F.lit('"')), F.lit(json.dumps(model)), F.lit(json.dumps(pipeline))))


@F.pandas_udf(StringType())
def canonical_map(s: pd.Series) -> pd.Series:
    """A map of text as canonical JSON."""
    return s.map(lambda m: None if m is None else canonical(dict(m)))


def metadata_hash(metadata: Column) -> Column:
    return sha(canonical_map(metadata))


def is_hash(col: Column) -> Column:
    return F.coalesce(col.rlike(HEX64), F.lit(False))
