"""Content hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def text_hash(text: Column) -> Column:
    """SHA-256 of the text without white space at its ends."""
    return F.sha2(F.regexp_replace(text, "^\\s+|\\s+$", ""), 256)


def fields_hash(*fields: Column) -> Column:
    """One hash of several fields in the order given; null differs from empty."""
    marked = [F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("!")) for f in fields]
    return F.sha2(F.concat_ws("\x1f", *marked), 256)


def canonical_json(value: object) -> str:
    """JSON with sorted keys, no spaces and characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical_json_hash(texts: pd.Series) -> pd.Series:
    """SHA-256 of JSON texts once they are canonical; null and broken JSON give null."""

    def one(text: str | None) -> str | None:
        try:
            return hashlib.sha256(canonical_json(json.loads(text)).encode()).hexdigest() if text is not None else None
        except ValueError:
            return None

    return texts.map(one)


def deep_merge(base: object, overlay: object) -> object:
    """Two JSON values as one: objects key by key, anything else from the overlay."""
    if isinstance(base, dict) and isinstance(overlay, dict):
        return base | {k: deep_merge(base[k], v) if k in base else v for k, v in overlay.items()}
    return overlay


#: Settings that what is written depends on, and those that pages and segments depend on.
TRANSLATION_SETTINGS, EXTRACTION_SETTINGS = ("source.language", "target", "custom_instructions"), ("source", "chunking", "visual")


def settings_hash(settings: dict, wanted: tuple[str, ...], defaults: dict[str, object] | None = None) -> str:
    """SHA-256 of the wanted settings only, so that no other one makes a difference; ``a.b`` is key b of a."""
    chosen = {}
    for name in wanted:
        value: object = settings
        for key in name.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        chosen[name.replace(".", "_")] = (defaults or {}).get(name) if value is None else value
    return hashlib.sha256(canonical_json(chosen).encode()).hexdigest()
