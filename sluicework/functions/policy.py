"""Parsing and checking of string settings as column expressions: a value column and a validity column each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for booleans, work classes by priority, pending ceiling, bounds of a fairness weight.
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")
WORK_CLASS_PRIORITY = {"interactive": 1, "recent_activation": 2, "incremental": 3, "cleanup": 4, "backfill": 5}
MAX_PENDING = 350
WEIGHT_BOUNDS = (0.001, 1000.0)

DURATION = r"^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*(ms|s|m|h)?\s*$"


def positive_int(raw: Column, default: int) -> tuple[Column, Column]:
    """Absent: the default.  Valid if a whole number above 0."""
    value = F.coalesce(raw.try_cast("bigint"), F.when(raw.isNull(), F.lit(default)))
    return value.cast("long"), F.coalesce(value > 0, F.lit(False))


def parsed_bool(raw: Column, default: bool, blank_is_default: bool = True) -> tuple[Column, Column]:
    """Blank counts as absent, or is an error where ``blank_is_default`` is false."""
    word = F.lower(F.trim(raw))
    absent = raw.isNull() | (word == "") if blank_is_default else raw.isNull()
    value = F.when(absent, F.lit(default)).when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    return value, value.isNotNull()


def duration_millis(raw: Column) -> Column:
    """Number and unit ms, s, m or h in either case, seconds without a unit; null if it is neither."""
    low = F.lower(raw)
    number = F.regexp_extract(low, DURATION, 1).try_cast("double")
    unit = F.regexp_extract(low, DURATION, 2)
    scale = F.when(unit == "ms", 1).when(unit == "m", 60_000).when(unit == "h", 3_600_000).otherwise(1_000)
    return F.when(low.rlike(DURATION), F.round(number * scale).cast("long"))


def fairness_weight(raw: Column) -> tuple[Column, Column]:
    """Absent: null and valid.  Else a number within the bounds; NaN isn't."""
    value = raw.try_cast("double")
    lo, hi = WEIGHT_BOUNDS
    return value, raw.isNull() | F.coalesce((value >= lo) & (value <= hi), F.lit(False))


def resource_list(raw: Column, default: str = "files") -> Column:
    """Comma-separated names, trimmed, without empty ones; the default if none is left."""
    names = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(raw.isNull() | (F.size(names) == 0), F.array(F.lit(default))).otherwise(names)


def work_class_priority(work_class: Column, urgent: Column | None = None) -> Column:
    """1 is first; urgent interactive and cleanup work is 1 in any case."""
    rank = F.lit(None).cast("int")
    for name, r in WORK_CLASS_PRIORITY.items():
        rank = F.when(work_class == name, F.lit(r)).otherwise(rank)
    if urgent is None:
        return rank
    return F.when(urgent & work_class.isin("interactive", "cleanup"), F.lit(1)).otherwise(rank)


def quota_limits_valid(pending: Column, in_flight: Column, dedup: Column) -> Column:
    """Positive; the dedup window and the queue hold at least what is in flight; the queue keeps its ceiling."""
    return F.coalesce((pending > 0) & (in_flight > 0) & (dedup > 0) & (dedup >= in_flight) & (pending >= in_flight) & (pending <= MAX_PENDING), F.lit(False))


def optional_float(raw: Column) -> tuple[Column, Column]:
    """Blank counts as absent: null and valid."""
    absent = raw.isNull() | (F.trim(raw) == "")
    value = F.when(~absent, F.trim(raw).try_cast("double"))
    return value, absent | value.isNotNull()


def parsed_int(raw: Column, default: int) -> tuple[Column, Column]:
    """Blank counts as absent: the default."""
    value = F.when(raw.isNull() | (F.trim(raw) == ""), F.lit(default)).otherwise(F.trim(raw).try_cast("bigint")).cast("long")
    return value, value.isNotNull()


# Names of a sync's settings, how each is read, and its default.
SYNC_SETTINGS = (
    ("max_active_users", "count", 20),
    ("user_page_size", "count", 100),
    ("round_user_window_size", "count", 20),
    ("round_page_slice_size", "count", 5),
    ("resource_concurrency", "count", 8),
    ("files_page_window_size", "count", 5),
    ("files_per_page_concurrency", "count", 10),
    ("document_ingestion_concurrency", "count", 20),
    ("provider_page_size", "count", 100),
    ("activation_recent_page_cap", "count", 5),
)
MODES = ("ordinary", "round")


def quota_scope(settings: Column) -> tuple[Column, Column]:
    """(provider, credential_key, quota_class, fairness_weight) or null without a provider and credential, and validity.

    The weight is only looked at if there is a scope.
    """
    get = lambda k, d=None: F.coalesce(F.try_element_at(settings, F.lit(k)), F.lit(d))
    some = (F.coalesce(get("provider"), F.lit("")) != "") & (F.coalesce(get("credential_key"), F.lit("")) != "")
    weight = get("fairness_weight", "1").try_cast("double")
    lo, hi = WEIGHT_BOUNDS
    scope = F.struct(get("provider").alias("provider"), get("credential_key").alias("credential_key"), get("quota_class", "default").alias("quota_class"), weight.alias("fairness_weight"))
    return F.when(some, scope), ~some | F.coalesce((weight >= lo) & (weight <= hi), F.lit(False))


def sync_policy(settings: Column, default_queue: str) -> dict[str, Column]:
    """All settings of a sync from a string map, each by name, and ``error``: the first that is not valid, else null.

    Scope comes before mode, mode before the counts in their order.
    """
    out: dict[str, Column] = {}
    scope, scope_ok = quota_scope(settings)
    mode = F.coalesce(F.try_element_at(settings, F.lit("mode")), F.lit("ordinary"))
    error = F.when(~scope_ok, "fairness_weight").when(~mode.isin(*MODES), "mode")
    out["quota_scope"], out["mode"] = scope, mode
    out["resource_types"] = resource_list(F.try_element_at(settings, F.lit("resource_types")))
    for name, _, default in SYNC_SETTINGS:
        out[name], ok = positive_int(F.try_element_at(settings, F.lit(name)), default)
        error = error.when(~ok, name)
    out["provider_task_queue"] = F.coalesce(F.try_element_at(settings, F.lit("provider_task_queue")), F.lit(default_queue))
    out["priority_fairness_enabled"] = F.lower(F.coalesce(F.try_element_at(settings, F.lit("priority_fairness_enabled")), F.lit("false"))).isin(*TRUE_WORDS)
    out["error"] = error
    return out


# Settings of an environment in lower case (names there are in upper case), how each is read, and its default.
ENVIRONMENT = (
    ("store_sync_max_active_users", "int", 20),
    ("store_sync_user_page_size", "int", 100),
    ("round_user_window_size", "int", 20),
    ("round_page_slice_size", "int", 5),
    ("resource_concurrency", "int", 8),
    ("files_page_window_size", "int", 5),
    ("files_per_page_concurrency", "int", 10),
    ("document_ingestion_concurrency", "int", 20),
    ("user_quota_max_in_flight", "int", 4),
    ("user_quota_max_pending_requests", "int", MAX_PENDING),
    ("user_quota_dedup_window_size", "int", 2000),
    ("user_quota_continue_as_new_message_count", "int", 10000),
    ("deactivation_drain_timeout", "duration", 300_000),
    ("enable_priority_fairness", "bool", False),
    ("provider_queue_rps", "float", None),
    ("fairness_key_rps_default", "float", None),
)
# Connection settings; "secret" defaults to null, "tls" to whether there is an API key.
CONNECTION = (
    ("address", "text", "localhost:7233"),
    ("namespace", "text", "default"),
    ("api_key", "secret", None),
    ("tls", "tls", None),
    ("deployment_name", "text", None),
    ("build_id", "text", "local"),
    ("use_worker_versioning", "strict_bool", False),
    ("register_legacy_drain_types", "strict_bool", False),
    ("server_priority_fairness_supported", "strict_bool", False),
    ("enable_search_attributes", "strict_bool", False),
)


def environment(settings: Column, spec: tuple = ENVIRONMENT, prefix: str = "") -> dict[str, Column]:
    """Typed columns of a map of environment variables (``prefix`` and the name in upper case), and ``invalid``: names that don't parse.

    Counts and flags of ``ENVIRONMENT`` take blank as absent; the flags of ``CONNECTION`` take it as an error.
    """
    out, bad = {}, []
    for name, kind, default in spec:
        raw = F.try_element_at(settings, F.lit((prefix + name).upper()))
        if kind == "int":
            value, ok = parsed_int(raw, default)
        elif kind == "float":
            value, ok = optional_float(raw)
        elif kind == "duration":
            blank = raw.isNull() | (F.trim(raw) == "")
            value = F.when(blank, F.lit(default).cast("long")).otherwise(duration_millis(F.trim(raw)))
            ok = value.isNotNull()
        elif kind in ("bool", "strict_bool"):
            value, ok = parsed_bool(raw, default, blank_is_default=kind == "bool")
        elif kind == "tls":
            key = F.coalesce(F.try_element_at(settings, F.lit((prefix + "api_key").upper())), F.lit(""))
            value, ok = parsed_bool(raw, False, blank_is_default=False)
            value = F.when(raw.isNull(), key != "").otherwise(value)
        elif kind == "secret":
            value, ok = F.nullif(raw, F.lit("")), F.lit(True)
        else:
            value, ok = F.coalesce(raw, F.lit(default).cast("string")), F.lit(True)
        out[name] = value
        bad.append(F.when(~ok, F.lit(name)))
    out["invalid"] = F.filter(F.array(*bad), lambda x: x.isNotNull())
    return out


def priority_metadata(enabled: Column, sdk: Column, server: Column, work_class: Column, urgent: Column, weight: Column) -> dict[str, Column]:
    """``mode`` of the capability, and ``priority`` and ``weight`` of a call: null unless configured and supported on both sides; ``weight_ok``."""
    lo, hi = WEIGHT_BOUNDS
    active = enabled & sdk & server
    ok = F.coalesce((weight >= lo) & (weight <= hi), F.lit(False))
    mode = F.when(~enabled, "disabled_by_configuration").when(~sdk, "disabled_unsupported_sdk").otherwise("priority_and_fairness")
    return {"mode": mode, "priority": F.when(active & ok, work_class_priority(work_class, urgent)), "weight": F.when(active & ok, weight), "weight_ok": ~active | ok}


def defaults_under(defaults: dict[str, str], given: Column) -> Column:
    """A string map with the caller's entries over the defaults."""
    base = F.create_map(*(F.lit(x) for kv in sorted(defaults.items()) for x in kv))
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.when(given.isNull(), base).otherwise(F.map_concat(kept, given))


def min_of_ceilings(*ceilings: Column) -> Column:
    return F.greatest(F.lit(1), F.least(*ceilings))
