"""Delivery errors and retry schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


#: Words of error texts and codes that decide a class: fixed values.
SERVICE = {
    "buffer_code": ["ServiceUnavailable", "BufferFull"],
    "buffer_text": ["buffer", "capacity", "full", "unavailable"],
    "buffer_any": ["service unavailable", "buffer full", "capacity exceeded"],
    "rate_code": ["Throttling", "TooManyRequests", "RateLimit"],
    "rate_text": ["throttling", "rate limit", "too many requests", "exceeded throughput"],
    "rate_sdk": ["throttling", "rate limit", "429"],
    "network_any": ["connection timeout", "connect timed out", "network unreachable", "no route to host", "connection refused", "dns resolution failed"],
}
NETWORK_CLASSES = ["ConnectException", "SocketTimeoutException", "UnknownHostException"]


def classify_error(kind: Column, code: Column, message: Column, cause: Column | None = None) -> Column:
    """I-07: BUFFER_FULL before RATE_LIMIT before NETWORK_ISSUE, else GENERIC_FAILURE.

    ``kind`` is the class of the error: ServiceUnavailableException, FirehoseException, SdkException, one
    of ``NETWORK_CLASSES`` or another; ``cause`` the class of what an SdkException wraps.
    """
    code, said = F.coalesce(code, F.lit("")), F.lower(F.coalesce(message, F.lit("")))
    cause = F.coalesce(cause, F.lit("")) if cause is not None else F.lit("")
    service = kind.isin("FirehoseException", "ServiceUnavailableException")
    sdk = service | (kind == "SdkException")
    buffer = (kind == "ServiceUnavailableException") | F.when(service, _any(code, SERVICE["buffer_code"]) | _any(said, SERVICE["buffer_text"])).otherwise(_any(said, SERVICE["buffer_any"]))
    rate = F.when(service, _any(code, SERVICE["rate_code"]) | _any(said, SERVICE["rate_text"])).when(sdk, _any(said, SERVICE["rate_sdk"])).otherwise(F.lit(False))
    network = kind.isin(*NETWORK_CLASSES) | _any(said, SERVICE["network_any"]) | (sdk & cause.isin(*NETWORK_CLASSES))
    return F.when(kind.isNull(), "GENERIC_FAILURE").when(buffer, "BUFFER_FULL").when(rate, "RATE_LIMIT").when(network, "NETWORK_ISSUE").otherwise("GENERIC_FAILURE")


def retry_delay_ms(kind: Column, attempt: Column) -> Column:
    """I-08 without jitter (12.5 % either way in operation); ``attempt`` counts from 0."""
    steps = F.array(*map(F.lit, (5_000, 15_000, 45_000, 120_000, 300_000)))
    doubling = lambda base: F.least(F.lit(30_000.0), base * F.pow(F.lit(2.0), attempt))
    return (
        F.when(kind == "BUFFER_FULL", F.element_at(steps, F.least(attempt, F.lit(4)) + 1))
        .when(kind == "RATE_LIMIT", doubling(F.lit(1000.0)))
        .when(kind == "NETWORK_ISSUE", F.element_at(F.array(*map(F.lit, (1000, 2000, 4000))), F.least(attempt, F.lit(2)) + 1))
        .otherwise(doubling(F.lit(2000.0)))
        .cast("long")
    )


#: I-09: retries after which the service and the strategy give up; whichever is reached first.
CEILINGS = {"BUFFER_FULL": (7, 7), "RATE_LIMIT": (6, 5), "NETWORK_ISSUE": (5, 3), "GENERIC_FAILURE": (5, 5)}


def should_stop(kind: Column, attempt: Column) -> Column:
    """I-09."""
    most = reduce(lambda c, x: c.when(kind == x[0], min(x[1])), CEILINGS.items(), F.when(F.lit(False), 0))
    return F.coalesce(attempt >= most, F.lit(True))


def sink_backoff_ms(base_ms: Column, attempt: Column, u: Column | None = None) -> Column:
    """I-10: doubling to 30 s; ``u`` in [0, 1) is the jitter of a quarter either way."""
    plain = F.least(F.lit(30_000.0), base_ms * F.pow(F.lit(2.0), attempt))
    return (plain if u is None else plain * (F.lit(0.75) + u * 0.5)).cast("long")


PERMANENT = ["ResourceNotFoundException", "InvalidArgumentException"]
RETRIABLE = ["ServiceUnavailableException", "ThrottlingException", "LimitExceededException", "InternalFailure", "RequestTimeout"]


def put_error(code: Column) -> Column:
    """I-11."""
    return F.when(code.isin(*PERMANENT), "permanent").when(code.isin(*RETRIABLE), "retriable").otherwise("unknown")
