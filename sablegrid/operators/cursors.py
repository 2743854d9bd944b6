"""Pages over two phases of a list, with an opaque cursor: what lies in shops first, then what is held directly."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The format's version, rows of a page if none are asked for, and at most.
VERSION, PAGE, MOST = 1, 50, 1000


@dataclass(frozen=True)
class Cursor:
    """Where a list goes on. kiosks: the shops as they were at the first page, so that a new one doesn't move what
    comes; ki: the shop that is read, past the last one in the direct phase; kc and dc: the last row given of each."""

    kiosks: tuple[str, ...]
    ki: int = 0
    kc: str | None = None
    dc: str | None = None


def encode(cursor: Cursor) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": VERSION, **asdict(cursor)}).encode()).decode().rstrip("=")


def decode(token: str) -> Cursor:
    """The cursor of a token; ValueError if it is none."""
    try:
        said = json.loads(base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True))
    except (binascii.Error, UnicodeError, ValueError) as e:
        raise ValueError(f"invalid cursor: {e}") from None
    text = lambda x: x is None or isinstance(x, str)
    if not isinstance(said, dict) or said.get("v") != VERSION:
        raise ValueError("invalid cursor: another version")
    kiosks, ki, kc, dc = (said.get(k) for k in ("kiosks", "ki", "kc", "dc"))
    if not isinstance(kiosks, list) or not all(isinstance(k, str) for k in kiosks) or not isinstance(ki, int) or isinstance(ki, bool) or not 0 <= ki <= len(kiosks) or not text(kc) or not text(dc):
        raise ValueError("invalid cursor: malformed")
    return Cursor(tuple(kiosks), ki, kc, dc)


def remaining(items: DataFrame, direct: DataFrame, owner: str, cursor: Cursor, limit: int) -> DataFrame:
    """The first `limit` rows after the cursor: phase (0 shop, 1 direct), place (of the shop), kiosk, id.

    items: kiosk, id; direct: owner, id. Both phases are filtered by plain comparisons of their own columns, which
    reach the scan: a shop before the cursor, or a row up to it, is not read.
    """
    left = cursor.kiosks[cursor.ki :]
    out = direct.where(F.col("owner") == owner)
    if cursor.dc is not None:
        out = out.where(F.col("id") > cursor.dc)
    out = out.select(F.lit(1).alias("phase"), F.lit(len(cursor.kiosks)).alias("place"), F.lit(None).cast("string").alias("kiosk"), "id")
    if left:
        now = items.where(F.col("kiosk").isin(*left))
        if cursor.kc is not None:
            now = now.where((F.col("kiosk") != left[0]) | (F.col("id") > cursor.kc))
        place = F.array_position(F.array(*map(F.lit, left)), F.col("kiosk")).cast("int") - 1 + cursor.ki
        out = now.select(F.lit(0).alias("phase"), place.alias("place"), "kiosk", "id").orderBy("place", "id").limit(limit).unionByName(out.orderBy("id").limit(limit))
    return out.orderBy("phase", "place", "id").limit(limit)


def page(items: DataFrame, direct: DataFrame, caps: DataFrame, owner: str, token: str | None = None, limit: int = PAGE) -> tuple[DataFrame, str | None]:
    """A page of what owner has, and the token of the next one, None after the last row.

    caps: owner, kiosk. The first call takes down the owner's shops; a shop that is gone since has no rows. A page
    has 1 to 1000 rows, of which the driver sees the ids.
    """
    limit = min(max(limit, 1), MOST)
    cursor = decode(token) if token else Cursor(tuple(r[0] for r in caps.where(F.col("owner") == owner).select("kiosk").distinct().orderBy("kiosk").collect()))
    rows = remaining(items, direct, owner, cursor, limit + 1).collect()
    found = items.sparkSession.createDataFrame(rows[:limit], "phase int, place int, kiosk string, id string")
    if len(rows) <= limit:
        return found, None
    last = rows[limit - 1]
    return found, encode(replace(cursor, ki=last.place, kc=last.id, dc=None) if last.phase == 0 else replace(cursor, ki=len(cursor.kiosks), kc=None, dc=last.id))
