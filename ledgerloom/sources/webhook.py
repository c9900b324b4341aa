"""Chat events from a signed webhook, as columns: no network, the requests are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "v0"
WINDOW = 300  # seconds that a request's time may differ from now
_BLOCK = 64  # bytes of a block of the hash


def hmac_sha256(secret: str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a binary column under one secret."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def verified(requests: DataFrame, secret: str, now: Column, window: int = WINDOW) -> DataFrame:
    """Adds ``verdict`` to rows (timestamp, signature, body as strings): accepted, bad_signature, stale or malformed.

    ``now``: seconds. A null or non-numeric timestamp, and a null signature, are malformed.
    """
    at = F.col("timestamp").try_cast("long")
    base = F.concat(F.lit(f"{VERSION}:"), F.col("timestamp"), F.lit(":"), F.coalesce("body", F.lit(""))).cast("binary")
    good = F.concat(F.lit(f"{VERSION}="), hmac_sha256(secret, base)) == F.col("signature")
    return requests.withColumn(
        "verdict",
        F.when(at.isNull() | F.col("signature").isNull(), "malformed").when(F.abs(now - at) > window, "stale")
        .when(good, "accepted").otherwise("bad_signature"),
    )


def chat_events(requests: DataFrame) -> DataFrame:
    """Accepted requests as events: one for each (team, channel, time) that the body names."""
    part = lambda path: F.get_json_object("body", path)
    return requests.where("verdict = 'accepted'").select(
        F.lit("slack").alias("source"), F.concat_ws(":", part("$.team_id"), part("$.event.channel"), part("$.event.ts")).alias("source_ref"),
        part("$.event.text").alias("raw_content"), part("$.event.user").alias("user"), F.timestamp_seconds(part("$.event.ts").try_cast("double")).alias("received_at"),
    ).dropDuplicates(["source_ref"])
