"""Content hashes and name-based UUIDs, all JVM-side."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

from .base import col

# Fixed value: any UUID.
UUID_ANY = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# Fixed value: request ids accepted by the chat and the feedback form (versions 1 to 5).
UUID_V1_TO_V5 = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def uuid5(namespace: uuid.UUID, name: Column | str) -> Column:
    """UUID version 5 (RFC 9562): SHA-1 of namespace bytes and name, version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), col(name).cast("binary")))
    # the variant nibble keeps its two low bits and gets binary 10 in front
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def chunk_record_id(file_id, page_number, chunk_index, hash_) -> Column:
    """Stable chunk key; repeats of a text within a file keep separate ids."""
    name = F.concat_ws(
        ":", col(file_id), col(page_number).cast("string"), col(chunk_index).cast("string"), col(hash_)
    )
    return uuid5(uuid.NAMESPACE_URL, name)


def is_uuid(c: Column | str) -> Column:
    return F.coalesce(F.rlike(col(c), F.lit(UUID_ANY)), F.lit(False))


def normalize_session_id(c: Column | str) -> Column:
    """A canonical UUID stays verbatim, any other id becomes a UUIDv5 in the DNS namespace."""
    return F.when(is_uuid(c), col(c)).otherwise(uuid5(uuid.NAMESPACE_DNS, c))


def anonymize_session(c: Column | str) -> Column:
    return F.concat(F.lit("session-"), F.substring(content_hash(c), 1, 12))
