"""Opaque deterministic keys as built-in expressions: canonical JSON, SHA-256, base32, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"  # fixed value: RFC 4648 base32 in lower case
MIN_LENGTH, MAX_LENGTH, DEFAULT_LENGTH = 8, 52, 26


def json_string(value: Column) -> Column:
    """A JSON string literal; control characters are escaped with lower-case digits."""
    quoted = F.substring(F.to_json(F.struct(value.cast("string").alias("v")), {"ignoreNullFields": "false"}), 6, 1 << 30)
    body = F.rtrim(quoted, F.lit("}"))  # the one that follows the closing quote or null
    for code in range(32):
        if f"{code:04X}" != f"{code:04x}":
            body = F.replace(body, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return body


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_array(*parts: Column) -> Column:
    """A compact JSON array of parts that are JSON texts already."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def base32_sha256(text: Column, length: int = MAX_LENGTH) -> Column:
    """The first base32 digits of the text's SHA-256, unpadded; there are 52.

    15 hexadecimal digits at a time become 12 of base 32; the last five, a zero added, become four.  No part is
    conditional, so the hash is computed once, and all of it is compiled.
    """
    hexed = F.rpad(F.sha2(text, 256), 65, "0")
    digits = [F.lpad(F.conv(F.substring(hexed, 15 * g + 1, 15), 16, 32), 12 if g < 4 else 4, "0") for g in range(-(-length // 12))]
    return F.translate(F.substring(F.concat(*digits), 1, length), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def opaque_key(namespace: str, *parts: Column, length: int = DEFAULT_LENGTH) -> Column:
    """Key of JSON-text ``parts`` within a namespace.  Parts keep their JSON types: 1 and "1" differ."""
    if not MIN_LENGTH <= length <= MAX_LENGTH:
        raise ValueError(f"length must be {MIN_LENGTH} to {MAX_LENGTH}")
    body = F.concat(F.lit('{"namespace":'), json_string(F.lit(namespace)), F.lit(',"parts":'), json_array(*parts), F.lit("}"))
    return base32_sha256(body, length)


def composite_id(prefix: str, *components: Column) -> Column:
    """``prefix/a/b/...``; null if any component is."""
    return F.concat(F.lit(prefix), *(x for c in components for x in (F.lit("/"), c)))


def component(value: Column, namespace: str) -> Column:
    return opaque_key(namespace, json_string(value))


def generation_component(generation: Column) -> Column:
    """A readable generation; negative ones are not valid and give null."""
    return F.when(generation >= 0, generation.cast("string"))


def json_bytes(value: Column) -> Column:
    """Typed JSON of bytes: base64 in its URL-safe alphabet."""
    return F.concat(F.lit('{"__bytes__":"'), F.translate(F.base64(value), "+/\r\n", "-_"), F.lit('"}'))


def json_enum(value: Column) -> Column:
    return F.concat(F.lit('{"__enum__":'), json_string(value), F.lit("}"))


def json_datetime(value: Column) -> Column:
    """Typed JSON of a timestamp in UTC: ISO 8601, microseconds only where there are any."""
    seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(value) % 1_000_000
    parts = F.concat(seconds, F.when(micros == 0, "").otherwise(F.date_format(value, ".SSSSSS")))
    return F.concat(F.lit('{"__datetime__":"'), parts, F.lit('+00:00"}'))


def json_date(value: Column) -> Column:
    return F.concat(F.lit('{"__datetime__":"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"}'))


def json_record(fields: dict[str, Column]) -> Column:
    """Typed JSON of a record of JSON texts, by name."""
    body = F.concat_ws(",", *(F.concat(json_string(F.lit(k)), F.lit(":"), fields[k]) for k in sorted(fields)))
    return F.concat(F.lit('{"__dataclass__":{'), body, F.lit("}}"))


# For each kind of id its components by namespace; a generation is readable.
ID_PARTS = {
    "store-controller": ("store",),
    "store-sync": ("store", "generation", "sync-sequence"),
    "failed-user-remediation": ("store", "generation", "sync-sequence"),
    "user-sync": ("store", "generation", "sync-sequence", "user"),
    "resource-sync": ("store", "generation", "sync-sequence", "user", "resource"),
    "files-page": ("resource-workflow", "page"),
    "document-ingest": ("store", "generation", "document", "source-version"),
    "store-deactivation": ("store", "generation"),
}


def operation_id(kind: str, *values: Column) -> Column:
    """Id of a kind from ``ID_PARTS``: JSON texts for its components, a number for a generation.  Null if any is null or the generation negative."""
    names = ID_PARTS[kind]
    if len(values) != len(names):
        raise ValueError(f"{kind} takes {', '.join(names)}")
    # a null value makes its part null without a condition, so that equal keys of several ids are computed once
    parts = [generation_component(v) if n == "generation" else F.concat(opaque_key(n, v), F.left(v, F.lit(0))) for n, v in zip(names, values, strict=True)]
    return composite_id(kind, *parts)


def operation_id_py(kind: str, *values: object) -> str:
    """The same id in Python, for the keyed folds."""
    return "/".join([kind, *(str(v) if n == "generation" else opaque_key_py(n, v) for n, v in zip(ID_PARTS[kind], values, strict=True))])


def quota_coordinator_id(provider: Column, credential: Column, quota_class: Column) -> Column:
    return composite_id("user-quota", quota_scope_key(provider, credential, quota_class))


def search_attributes(store: Column, generation: Column, operation_type: Column, phase: Column, sequence: Column, provider: Column, credential: Column, quota_class: Column, work_class: Column) -> dict[str, Column]:
    """Attributes by which operations are found; what identifies a store, sequence or credential is opaque, absent parts are null.

    Sequences and scopes have namespaces of their own, so these values join with no id.
    """
    scope = opaque_key("search-quota-scope", json_string(provider), json_string(credential), json_string(quota_class))
    return {
        "store_key_hash": component(store, "store"),
        "lifecycle_generation": generation,
        "operation_type": operation_type,
        "current_phase": phase,
        "sync_sequence_hash": F.when(sequence.isNotNull(), opaque_key("search-sync-sequence", json_string(sequence))),
        "provider": provider,
        "quota_scope_hash": F.when(provider.isNotNull(), scope),
        "work_class": work_class,
    }


def quota_scope_key(provider: Column, credential: Column, quota_class: Column) -> Column:
    return opaque_key("quota-scope", json_string(provider), json_string(credential), json_string(quota_class))


def permit_request_id(store: Column, generation: Column, sequence: Column, user: Column, resource: Column, cursor: Column, attempt: Column, operation: Column, quota_class: Column) -> Column:
    """The generation is a string here, and the cursor and attempt are one nested array."""
    nested = json_array(json_string(cursor), json_number(attempt))
    parts = [json_string(c) for c in (store, generation.cast("string"), sequence, user, resource)] + [nested] + [json_string(c) for c in (operation, quota_class)]
    return F.concat(F.lit("permit-request/"), opaque_key("permit-request", *parts))


def permit_id(request_id: Column, window_id: Column) -> Column:
    return F.concat(F.lit("permit/"), opaque_key("permit-reservation", json_string(request_id), json_string(window_id)))


def opaque_key_py(namespace: str, *parts: object, length: int = DEFAULT_LENGTH) -> str:
    """The same key in Python, for the keyed folds and as a check of the expression."""
    import base64
    import hashlib
    import json

    text = json.dumps({"namespace": namespace, "parts": parts}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return base64.b32encode(hashlib.sha256(text.encode()).digest()).decode().rstrip("=").lower()[:length]
