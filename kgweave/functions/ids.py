"""Deterministic ids and curies as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The OID namespace of RFC 4122 (fixed value).
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"
#: Prefixes that curies write with an underscore (fixed values).
UNDERSCORED = ("UBERON", "HP", "MONDO", "GO", "CL", "Orphanet")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uuid5(x: Column | str) -> Column:
    """Name-based UUID (version 5, OID namespace) of a string; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID)), F.encode(_col(x), "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def identity_id(kind: str, *keys: Column | str) -> Column:
    """Id of an object from its identity fields: lower case, blanks as underscores, no apostrophes. A null key
    gives a null id."""
    parts = [F.replace(F.replace(F.lower(_col(k).cast("string")), F.lit(" "), F.lit("_")), F.lit("'"), F.lit("")) for k in keys]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return uuid5(F.concat(F.lit(f"{kind}:"), joined))


def curie_to_entity_id(curie: Column | str) -> Column:
    return uuid5(F.concat(F.lit("Entity:curie:"), F.trim(_col(curie))))


def relation_id(head: Column | str, kind: Column | str, tail: Column | str) -> Column:
    return uuid5(F.concat(F.lit("Relation:"), _col(head), F.lit("|"), _col(kind), F.lit("|"), _col(tail)))


def to_biolink(curie: Column | str) -> Column:
    """``MONDO:1`` -> ``MONDO_1`` for the known ontologies; others stay."""
    return F.regexp_replace(_col(curie), f"^({'|'.join(UNDERSCORED)}):", "$1_")


def prefixed(x: Column | str, prefix: str) -> Column:
    """The prefix exactly once."""
    return F.when(_col(x).startswith(prefix), _col(x)).otherwise(F.concat(F.lit(prefix), _col(x)))


def content_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by NUL; null if any part is null."""
    ok = _col(parts[0]).isNotNull()
    for p in parts[1:]:
        ok = ok & _col(p).isNotNull()
    return F.when(ok, F.sha2(F.concat_ws("\0", *[_col(p) for p in parts]), 256))


def duck_uuid5(x: str) -> str:
    """The same UUID as DuckDB SQL, for the oracles."""
    h = f"sha1(unhex('{NAMESPACE_OID}') || encode({x}))"
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)||'-'||substr({h},21,12))"
