"""Canonical text and SHA-256 identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SHA256 = "^[0-9a-f]{64}$"
#: Fixed value: form of a global instrument identifier, whole text.
GLOBAL_ID = r"\ABBG[0-9A-Z]{9}\z"


def decimal_string(value: Column) -> Column:
    """Minimal plain decimal text: no exponent, no trailing zeros, zero is ``0``."""
    text = value.cast("string")
    trimmed = F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    return F.when(value == 0, F.lit("0")).otherwise(trimmed)


#: An escape of four digits, another escape, a run of plain characters, or one character outside printable ASCII.
_JSON_PARTS = r"\\u[0-9A-Fa-f]{4}|\\.|[ -\[\]-~]+|[^ -~]"


def ascii_json(json: Column) -> Column:
    """JSON text in printable ASCII: other characters as ``\\uXXXX`` with small digits, those past U+FFFF as surrogate pairs."""

    def part(p: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(p, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(p.rlike("^[^ -~]"), units).when(p.rlike(r"^\\u."), F.lower(p)).otherwise(p)

    plain = ~json.rlike(r"[^ -~]|\\u")
    return F.when(plain, json).otherwise(F.array_join(F.transform(F.regexp_extract_all(json, F.lit(_JSON_PARTS), F.lit(0)), part), ""))


def canonical_json(**fields: Column) -> Column:
    """JSON object with sorted keys, no spaces, ISO dates, explicit nulls and every text in ASCII."""
    return ascii_json(
        F.to_json(
            F.struct(*[fields[name].alias(name) for name in sorted(fields)]),
            {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"},
        )
    )


def identity(domain: str, **payload: Column) -> Column:
    """SHA-256 over ``{"domain": ..., "payload": {...}}`` in canonical form."""
    body = F.struct(*[payload[name].alias(name) for name in sorted(payload)])
    return F.sha2(canonical_json(domain=F.lit(domain), payload=body), 256)


def tie_break(domain: str, strategy: Column, session: Column, security: Column) -> Column:
    """Order-independent tie key over strategy, signal session and security."""
    return identity(
        domain, strategy_revision_identity=strategy, signal_session=session, permanent_id=security
    )


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(SHA256), F.lit(False))
