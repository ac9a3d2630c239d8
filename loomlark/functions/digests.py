"""Content digests and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def named_hash(*named: tuple[Column, Column]) -> Column:
    """``sha256:`` and the digest over name, zero byte, body, 0xFF of each pair."""
    parts = [x for name, body in named for x in (name.cast("binary"), F.unhex(F.lit("00")), body.cast("binary"), F.unhex(F.lit("ff")))]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*parts), 256))


def chunk_id(path: Column, artifact: Column, start: Column, end: Column, segment: Column, separator: str = "\x00") -> Column:
    """Digest of place and, from the second segment of a long line on, segment."""
    place = F.concat_ws(separator, path, artifact, start.cast("string"), end.cast("string"), F.when(segment > 0, segment.cast("string")))
    return F.sha2(place, 256)


def event_id(sequence: Column) -> Column:
    return F.format_string("evt-%06d", sequence)
