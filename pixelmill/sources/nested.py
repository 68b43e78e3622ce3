"""Values from free-form JSON sidecars: depth-first search by key, names, texts, times and places."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys under which sidecars keep each thing, in order of preference.
KEYS = {
    "time": ["photoTakenTime", "creationTime", "mediaCreationTime", "captureTime", "timestamp"],
    "place": ["geoData", "geoDataExif", "location", "geo", "coordinates", "position"],
    "title": ["title", "filename", "name"],
    "description": ["description", "caption", "Caption", "story"],
    "people": ["people", "faces", "faceNames", "recognizedFaces", "faceAnnotations"],
}
MAX_DEPTH = 6


def _walk(obj, depth: int = 0) -> Iterator[tuple[str, object]]:
    """All (key, value) of nested objects, a level's own keys before what is below them."""
    if depth > MAX_DEPTH:
        return
    if isinstance(obj, dict):
        yield from obj.items()
        for v in obj.values():
            yield from _walk(v, depth + 1)
    elif isinstance(obj, list):
        for v in obj:
            yield from _walk(v, depth + 1)


def first_value(obj, keys: list[str]):
    """The first value, depth first, whose key is one of ``keys`` in any case and that isn't empty."""
    wanted = {k.lower() for k in keys}
    return next((v for k, v in _walk(obj) if str(k).lower() in wanted and v not in (None, "", False)), None)


def names_of(value) -> list[str]:
    """Names in a list of texts or of objects with a name, label or title."""
    if isinstance(value, dict):
        inner = next((value[k] for k in ("name", "label", "title", "displayName") if value.get(k)), None)
        return names_of(inner) if inner is not None else [n for v in value.values() if isinstance(v, (dict, list)) for n in names_of(v)]
    if isinstance(value, list):
        return list(dict.fromkeys(n for v in value for n in names_of(v)))
    return [str(value).strip()] if value not in (None, "", False) and str(value).strip() else []


def text_of(value) -> str | None:
    if isinstance(value, dict):
        return next((t for k in ("text", "value", "title", "name") if (t := text_of(value.get(k)))), None) or next((t for v in value.values() if (t := text_of(v))), None)
    if isinstance(value, list):
        return next((t for v in value if (t := text_of(v))), None)
    return (str(value).strip() or None) if value not in (None, False) else None


def epoch_of(value) -> float | None:
    """Seconds since 1970 of a number, a digit text, an ISO text or an object with one of them; 1e10 and more are milliseconds."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, dict):
        return next((e for k in ("timestamp", "seconds", "epoch", "value", "formatted") if (e := epoch_of(value.get(k))) is not None), None)
    if isinstance(value, list):
        return next((e for v in value if (e := epoch_of(v)) is not None), None)
    try:
        number = float(value)
        return float(number // 1000 if abs(number) >= 1e10 else number)
    except ValueError:
        pass
    try:
        found = datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return (found if found.tzinfo else found.replace(tzinfo=timezone.utc)).timestamp()


def place_of(value) -> dict[str, float] | None:
    """lat, lon and alt of an object in degrees or ten-millionths, whatever its keys are called."""
    if not isinstance(value, (dict, list)):
        return None
    low = {}
    for k, v in _walk(value):
        low.setdefault(str(k).lower(), v)

    def number(*keys: str, scale: float = 1.0) -> float | None:
        for k in keys:
            try:
                return float(low[k]) / scale
            except (KeyError, TypeError, ValueError):
                continue
        return None

    lat = number("latitude", "lat")
    lon = number("longitude", "lon", "lng")
    lat = number("latitudee7", scale=1e7) if lat is None else lat
    lon = number("longitudee7", scale=1e7) if lon is None else lon
    if lat is None or lon is None or abs(lat) > 90 or abs(lon) > 180 or (lat == 0 and lon == 0):
        return None
    return {"lat": lat, "lon": lon, "alt": number("altitude", "alt")}


SIDECAR = "epoch double, lat double, lon double, alt double, title string, description string, people array<string>"


def parse_sidecar(text: str | None) -> dict:
    try:
        obj = json.loads(text) if text else None
    except ValueError:
        obj = None
    place = place_of(first_value(obj, KEYS["place"])) or place_of(obj) or {}
    return {
        "epoch": epoch_of(first_value(obj, KEYS["time"])), "lat": place.get("lat"), "lon": place.get("lon"), "alt": place.get("alt"),
        "title": text_of(first_value(obj, KEYS["title"])), "description": text_of(first_value(obj, KEYS["description"])), "people": names_of(first_value(obj, KEYS["people"])) or None,
    }


def sidecar(json_text: Column) -> Column:
    """A sidecar's fields as a struct; Arrow batches, because its nesting is free."""

    @F.pandas_udf(SIDECAR)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_sidecar(t) for t in texts], columns=["epoch", "lat", "lon", "alt", "title", "description", "people"])

    return parse(json_text)


def wire_records(text: str) -> list[dict]:
    """Top-level field 1 of protobuf text (``3: value`` and ``2 { ... }`` lines) as nested lists by field number."""
    root: dict = {}
    stack = [root]
    for line in (x.strip() for x in text.splitlines()):
        if line.endswith("{") and line[:-1].strip().isdigit():
            inner: dict = {}
            stack[-1].setdefault(line[:-1].strip(), []).append(inner)
            stack.append(inner)
        elif line == "}" and len(stack) > 1:
            stack.pop()
        elif ":" in line and line.split(":", 1)[0].isdigit():
            field, value = line.split(":", 1)
            value = value.strip()
            stack[-1].setdefault(field, []).append(int(value) if value.lstrip("-").isdigit() else value.strip('"'))
    return [r for r in root.get("1", []) if isinstance(r, dict)]
