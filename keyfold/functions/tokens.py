"""Page cursors: base64 of the JSON of the last key."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def cursor(*keys: str) -> Column:
    """Cursor that continues after the row; times keep their microseconds, NULL is a value of its own."""
    options = {
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    }
    if len(keys) > 1:
        options["ignoreNullFields"] = "false"
    return F.base64(F.encode(F.to_json(F.struct(*keys), options), "UTF-8"))


def cursor_values(token: str | None, keys: Sequence[str]) -> dict[str, object] | None:
    """The values of all keys inside a cursor, fractions as exact text.

    An unreadable cursor, or one of another order, starts from the beginning.
    """
    if not token:
        return None
    try:
        found = json.loads(base64.b64decode(token, validate=True), parse_float=str)
    except (ValueError, binascii.Error):
        return None
    if not isinstance(found, dict) or set(found) != set(keys):
        return None
    return found


def cursor_value(token: str | None, key: str) -> object | None:
    """Key value inside a cursor; an unreadable cursor starts from the beginning."""
    if not token:
        return None
    try:
        return json.loads(base64.b64decode(token, validate=True)).get(key)
    except (ValueError, binascii.Error, AttributeError):
        return None
