"""Result records from JSON bodies: a bounded walk over all objects of a body, with aliased keys."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

# Key aliases of each field, compared without case, and the bounds of the walk.
ALIASES = {
    "title": ("title", "name", "headline", "label"),
    "url": ("url", "link", "href", "permalink", "webpage_url", "canonicalUrl", "contentUrl"),
    "description": ("description", "summary", "excerpt", "snippet"),
    "thumbnail": ("thumbnail", "thumbnailUrl", "image", "poster", "cover", "artwork"),
    "category": ("category", "type", "genre"),
    "duration": ("duration", "length"),
    "quality": ("quality", "resolution"),
}
MOST_DEPTH, MOST_OBJECTS, MOST_RESULTS = 8, 500, 150
_NAMES = {field: {a.lower() for a in names} for field, names in ALIASES.items()}
_LINK = {"url", "src", "href"}


def _text(value, depth: int = 0) -> str | None:
    """A scalar as text; of an object its link, of an array its first element."""
    if isinstance(value, dict):
        return _text(_find(value, _LINK), depth + 1) if depth < MOST_DEPTH else None
    if isinstance(value, list):
        return _text(value[0], depth + 1) if value and depth < MOST_DEPTH else None
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def _find(item: dict, names: set[str]):
    """The value of the first key, in the object's order, that is one of the names; it decides even if it is null."""
    return next((v for k, v in item.items() if k.lower() in names), None)


def _objects(root) -> list[dict]:
    found, stack = [], [(root, 0)]
    while stack and len(found) < MOST_OBJECTS:
        value, depth = stack.pop()
        if depth > MOST_DEPTH:
            continue
        if isinstance(value, dict):
            found.append(value)
            stack += [(v, depth + 1) for v in reversed(value.values())]
        elif isinstance(value, list):
            stack += [(v, depth + 1) for v in reversed(value)]
    return found


def records(body: str | None, base: str) -> list[dict]:
    """The records of one body: a title of 3 characters and an http URL at least; the first of each URL."""
    try:
        root = json.loads(body or "")
    except ValueError:
        return []
    out: dict[str, dict] = {}
    for item in _objects(root):
        row = {field: _text(_find(item, names)) for field, names in _NAMES.items()}
        row["title"], link = (row["title"] or "").strip(), (row["url"] or "").strip()
        if len(row["title"]) < 3 or not link:
            continue
        row["url"] = urljoin(base, link)
        if row["thumbnail"]:
            row["thumbnail"] = urljoin(base, row["thumbnail"])
        if row["url"].startswith("http"):
            out.setdefault(row["url"], row)
    return list(out.values())[:MOST_RESULTS]


def json_records(bodies: DataFrame) -> DataFrame:
    """bodies: body_id, base_url, body. A row for each record with its place; bodies that are no JSON give none."""
    fields = list(ALIASES)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *(r[f] for f in fields)) for i, base, body in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, r in enumerate(records(body, base or ""))]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * len(fields)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["body_id", "place", *fields])

    schema = "body_id long, place long, " + ", ".join(f"{f} string" for f in fields)
    return bodies.select(bodies["body_id"].cast("long"), "base_url", "body").mapInArrow(walk, schema)
