"""Identifiers that only depend on what they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS name space of RFC 4122.
_NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Version 5 UUID of a name in the DNS name space, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE_DNS)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(digest.substr(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        digest.substr(1, 8),
        digest.substr(9, 4),
        F.concat(F.lit("5"), digest.substr(14, 3)),
        F.concat(variant, digest.substr(18, 3)),
        digest.substr(21, 12),
    )


# Values longer than this are grouped by their digest, so that a shuffle carries
# 71 characters instead of a whole document. Shorter ones never look like a token,
# because a token is itself longer than any value kept as it is.
LONG_TEXT = 64


def text_key(c: Column) -> Column:
    """The text itself when short, else a SHA-256 token of the whole text."""
    return F.when(F.length(c) <= LONG_TEXT, c).otherwise(
        F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))
    )


def is_token(key: Column) -> Column:
    return F.length(key) > LONG_TEXT
