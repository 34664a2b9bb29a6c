"""Ids: one canonical key for every spelling of a UUID, and name-based UUIDs (version 5).

A key is binary. A UUID is its 16 bytes; a reference that is no UUID is its trimmed text followed by 17 zero bytes, so
the two never collide. Null, blank text and the nil UUID have no key (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL = "00000000-0000-0000-0000-000000000000"
_BLANK = " \t\r\n\f\v ​﻿"
_PAD = 17


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


#: Spellings that need no cleaning: dashed or plain hex digits in either case.
_PLAIN = "^(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32})$"


def _other_key(c: Column) -> Column:
    """The key of a text that is not plainly spelled: a decorated UUID, or no UUID."""
    text = _trimmed(c)
    squeezed = F.translate(F.lower(text), "{}()-\"'", "")
    digits = F.regexp_replace(squeezed, "^urn:uuid:", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.unhex(digits)).when(
        text != "", F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("00" * _PAD)))
    )


def id_key(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    key = F.when(c.rlike(_PLAIN), F.unhex(F.replace(c, F.lit("-"), F.lit("")))).otherwise(_other_key(c))
    return F.nullif(key, F.unhex(F.lit("00" * 16)))


def id_text(key: Column | str) -> Column:
    """The text of a key: lower case with hyphens for a UUID, else the trimmed text."""
    key = F.col(key) if isinstance(key, str) else key
    h = F.lower(F.hex(key))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(F.octet_length(key) == 16, dashed).otherwise(
        F.decode(key.substr(F.lit(1), F.octet_length(key) - _PAD), "UTF-8")
    )


def key_to_text(key: bytes | None) -> str | None:
    """``id_text`` for Python."""
    if key is None:
        return None
    if len(key) == 16:
        h = key.hex()
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
    return key[:-_PAD].decode("utf-8", "replace")


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of ``name`` (text) in ``namespace`` (a UUID's text), as built-in expressions."""
    ns = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(ns, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )
