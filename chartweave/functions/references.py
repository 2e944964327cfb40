"""Ids and references: FHIR references and stable ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids that are already stable (synthetic prefixes, or a GUID).
GUID_SHAPE = (
    r"(?i)^(?:feedface-|00000000-)[0-9a-f-]+$"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ref_id(col: Column | str) -> Column:
    """FN-22. Bare id of ``Type/x``, ``urn:uuid:x`` or a URL."""
    ref = F.nullif(_c(col), F.lit(""))
    return F.when(ref.startswith("urn:uuid:"), F.substring(ref, 10, 2**31 - 11)).otherwise(
        F.substring_index(ref, "/", -1)
    )


def patient_ref(patient: Column | str, subject: Column | str, beneficiary: Column | str) -> Column:
    """FN-22. The patient id under the first reference field that has one."""
    return F.coalesce(ref_id(patient), ref_id(subject), ref_id(beneficiary))


def uuid5(namespace: uuid.UUID, name: Column | str) -> Column:
    """Name-based UUID (version 5), computed with SHA-1 in the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), _c(name).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 19, 2), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def stable_id(root: Column | str, source_file: Column | str, index: Column | str) -> Column:
    """FN-25. Keep a GUID-shaped id; otherwise a UUID of file and position."""
    own = _c(root)
    name = F.concat(F.lit("ccda:"), F.coalesce(_c(source_file), F.lit("")), F.lit(":encounter:"), _c(index).cast("string"))
    return F.when(own.rlike(GUID_SHAPE), own).otherwise(uuid5(uuid.NAMESPACE_URL, name))
