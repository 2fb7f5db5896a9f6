"""Schemas and the dimension of stream kinds.

A file's metadata is a long table of fields: (path, kind_id, kind, pos, name, value, is_extra, ord). A stream is
(path, kind, pos); ord is the order in which a stream's fields were written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind names in the order of their ids.
KINDS = ("General", "Video", "Audio", "Text", "Other", "Image", "Menu", "Exif", "Iptc", "Xmp", "Icc", "C2pa", "MakerNotes")

FIELDS = "path string, kind_id int, kind string, pos int, name string, value string, is_extra boolean, ord int"
KERNEL_FIELD = "struct<kind_id: int, pos: int, name: string, value: string, is_extra: boolean>"


def kind_name(kind_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind_id.cast("int") + 1)


def kind_id(kind: Column) -> Column:
    """The id of a kind by its name, case-sensitive; null if there's no such kind."""
    at = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    return F.when(at > 0, (at - 1).cast("int"))
