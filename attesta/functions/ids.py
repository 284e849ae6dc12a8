"""Content ids: 128-bit hashes of names and of what a row says.

The hash is MD5, which Spark computes inside its generated code; ids so agree between runs, engines and machines, but not
with systems that hash otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = b"\0" * 16


def hash128(data: Column | str) -> Column:
    return F.unhex(F.md5(F.col(data) if isinstance(data, str) else data))


def canonical_id(name: Column | str) -> Column:
    """The id of a name; relations and entity types have theirs by name, too."""
    return hash128(F.encode(F.col(name) if isinstance(name, str) else name, "utf-8"))


relation_type_id = entity_type_id = canonical_id


def source_id(name: Column | str) -> Column:
    return canonical_id(F.concat(F.lit("substrate/source/"), F.col(name) if isinstance(name, str) else name, F.lit("/v1")))


def _or_zero(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(ZERO))


def triple_id(subject: str = "subject_id", relation: str = "type_id", obj: str = "object_id") -> Column:
    return hash128(F.concat(F.col(subject), F.col(relation), _or_zero(obj)))


def evidence_id(subject: str = "subject_id", relation: str = "type_id", obj: str = "object_id", source: str = "source_id", context: str = "context_id") -> Column:
    return hash128(F.concat(F.col(subject), F.col(relation), _or_zero(obj), F.col(source), _or_zero(context)))


def composition_id(children: Column | str) -> Column:
    """The id of an ordered composition; its tier plays no part and a single child is itself the composition."""
    c = F.col(children) if isinstance(children, str) else children
    joined = F.aggregate(c, F.lit(b"\x01"), lambda acc, x: F.concat(acc, x))
    return F.when(F.size(c) == 1, F.element_at(c, 1)).otherwise(hash128(joined))


def hash128_lo(x: Column | str) -> Column:
    """The leading 64 bits as a signed number."""
    return F.conv(F.substring(F.hex(F.col(x) if isinstance(x, str) else x), 1, 16), 16, -10).cast("long")


def shown(x: Column | str) -> Column:
    return F.lower(F.hex(F.col(x) if isinstance(x, str) else x))
