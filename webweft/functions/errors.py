"""Error classes, retry rules and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers that another try may mend; most tries by status; factor of the pause by status.
TRANSIENT = (408, 429, 500, 502, 503, 504)
RETRIES_BY_STATUS = {500: 2}
DELAY_BY_STATUS = {429: 3.0}
#: Exceptions by what they stand for, in the order in which they are looked for.
EXCEPTIONS = (
    ("TransientError", ("TimeoutError", "ServerTimeoutError", "ConnectionTimeoutError", "SocketTimeoutError")),
    ("PermanentError", ("InvalidURL", "TooManyRedirects", "NonHttpUrlClientError")),
    ("NetworkError", ("ClientError", "ClientConnectorError", "ClientOSError", "ServerDisconnectedError", "ClientPayloadError", "ConnectionResetError", "ConnectionRefusedError", "OSError")),
)


def _table(of: Column, values: dict, default: Column | None = None) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(of == k, F.lit(v)).otherwise(out)
    return out if default is None else F.coalesce(out, default)


def classify_status(status: Column) -> Column:
    """Null under 400, else TransientError or PermanentError."""
    return F.when(status >= 400, F.when(status.isin(*TRANSIENT), "TransientError").otherwise("PermanentError"))


def classify_exception(name: Column, status: Column | None = None) -> Column:
    """Class of an exception by its name; classes of ours stay, unknown ones are permanent."""
    out = F.when(name.isin("TransientError", "PermanentError", "NetworkError", "ParseError", "CircuitOpenError"), name)
    for kind, names in EXCEPTIONS:
        out = out.when(name.isin(*names), F.lit(kind))
        if kind == "TransientError" and status is not None:
            out = out.when(name == "ClientResponseError", classify_status(status))
    return out.otherwise("PermanentError")


def should_retry(kind: Column, retry_on: tuple[str, ...] = ("TransientError", "NetworkError")) -> Column:
    return F.coalesce(kind.isin(*retry_on), F.lit(False))


def retry_limit(status: Column, kind: Column, most: int = 3, by_status: dict | None = None, by_kind: dict | None = None) -> Column:
    """Most retries: the status's rule, else the class's, else the general one. A status rule holds even if most is 0."""
    by_status = RETRIES_BY_STATUS if by_status is None else by_status
    return F.coalesce(_table(status, by_status).cast("int"), _table(kind, by_kind or {}).cast("int"), F.lit(most))


def backoff(retry: Column, status: Column | None = None, retry_after: Column | None = None, base: float = 1.0, factor: float = 2.0, most: float = 30.0, jitter: float = 0.0, seed: int = 0) -> Column:
    """Pause before a retry (from 0): base * factor ** retry up to most, then jitter; Retry-After, up to most, comes first."""
    start = F.lit(base) * (_table(status, DELAY_BY_STATUS, F.lit(1.0)) if status is not None else F.lit(1.0))
    pause = F.least(F.lit(most), start * F.pow(F.lit(factor), retry.cast("double")))
    if jitter:
        pause = pause * (1 + F.rand(seed) * jitter)
    return pause if retry_after is None else F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(most))).otherwise(pause)


def timeout(attempt: Column, base: float = 10.0, growth: float = 1.5, most: float = 60.0) -> Column:
    """Seconds that a try (from 0) may take."""
    return F.least(F.lit(max(base, most)), F.lit(base) * F.pow(F.lit(growth), attempt.cast("double")))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, a number or an HTTP date; null for anything else."""
    value = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]+, *", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    wait = (F.unix_micros(date) - F.unix_micros(now)) / 1e6
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("double")).when(date.isNotNull(), F.greatest(F.lit(0.0), wait))


def failure_name(kind: Column, reason: Column) -> Column:
    """What a failure is counted as: its class, else the reason up to the first colon."""
    return F.coalesce(kind, F.split(reason, ":")[0])
