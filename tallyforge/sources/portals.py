"""Connectors to open-data portals.

Paging, retrying and shaping are pure functions over a ``fetch`` callable, so they work without a network in tests; a
Python data source wraps the paged layer, with one partition per page range.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, dict], dict]


def http_fetch(url: str, params: dict, retries: int = 3, wait: float = 1.0) -> dict:
    """JSON of a URL; tried again with growing waits."""
    full = f"{url}?{urllib.parse.urlencode(params)}"
    for k in range(retries):
        try:
            with urllib.request.urlopen(full, timeout=60) as r:  # noqa: S310
                return json.load(r)
        except OSError:
            if k + 1 == retries:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


def layer_url(url: str) -> str:
    """The base address of a layer, without a trailing query part."""
    base = url.split("?")[0].rstrip("/")
    return base[: -len("/query")] if base.endswith("/query") else base


def layer_records(url: str, fetch: Fetch = http_fetch, where: str = "1=1", fields: str = "*", batch: int = 2000) -> Iterator[dict]:
    """All records of a feature layer, page by page.

    The offset advances by the rows that came, as servers cap pages as they like; it stops at an empty page or when the
    server says there is no more, and breaks off when more comes than was counted.
    """
    total = int(fetch(f"{url}/query", {"where": where, "returnCountOnly": "true", "f": "json"})["count"])
    offset = 0
    while True:
        page = fetch(f"{url}/query", {"where": where, "outFields": fields, "resultOffset": offset, "resultRecordCount": batch, "f": "json", "returnGeometry": "false"})
        rows = [f["attributes"] for f in page.get("features", [])]
        if not rows:
            return
        offset += len(rows)
        if offset > total + batch:
            raise RuntimeError(f"{offset} rows came of {total}: the server ignores the offset")
        yield from rows
        if not page.get("exceededTransferLimit") and offset >= total:
            return


def layer_dictionary(meta: dict) -> list[dict]:
    """Fields of a layer with their coded values as ``code=name; ...``."""
    out = []
    for f in meta.get("fields", []):
        coded = (f.get("domain") or {}).get("codedValues") or []
        out.append({"name": f["name"], "alias": f.get("alias", f["name"]), "type": f.get("type", ""), "values": "; ".join(f"{c['code']}={c['name']}" for c in coded)})
    return out


def matters(fetch: Callable[[str, dict], list], url: str, since: str | None = None, top: int = 1000) -> Iterator[dict]:
    """Council matters, paged by skip; blank texts are left out, white space is one blank, dates are days."""
    skip = 0
    while True:
        params = {"$top": top, "$skip": skip, "$orderby": "MatterId"}
        if since:
            params["$filter"] = f"MatterIntroDate ge datetime'{since}'"
        page = fetch(url, params)
        if not page:
            return
        skip += len(page)
        for m in page:
            text = " ".join((m.get("MatterTitle") or m.get("MatterName") or "").split())
            if text:
                day = lambda k, m=m: (m.get(k) or "")[:10] or None
                yield {"doc_id": m["MatterId"], "file_no": m.get("MatterFile"), "matter_type": m.get("MatterTypeName"), "status": m.get("MatterStatusName"), "intro_date": day("MatterIntroDate"), "passed_date": day("MatterPassedDate"), "enactment_no": m.get("MatterEnactmentNumber"), "text": text}
        if len(page) < top:
            return


def matter_url(url: str | None, matter_id, web: str) -> str | None:
    """A page address of a matter: detail addresses with an outdated form are made anew from the id."""
    if url and "LegislationDetail.aspx" in url and "GUID=" not in url:
        return f"{web.rstrip('/')}/gateway.aspx?m=l&id={matter_id}"
    return url or (f"{web.rstrip('/')}/gateway.aspx?m=l&id={matter_id}" if matter_id is not None else None)


class _Page(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


class FeatureLayerSource(DataSource):
    """``spark.read.format("feature_layer").schema(...).option("url", ...)``: one partition per page range."""

    @classmethod
    def name(cls) -> str:
        return "feature_layer"

    def reader(self, schema):
        return _LayerReader(self.options, schema)


class _LayerReader(DataSourceReader):
    def __init__(self, options, schema):
        self.url, self.batch, self.schema = layer_url(options["url"]), int(options.get("batch", "2000")), schema

    def partitions(self):
        n = int(http_fetch(f"{self.url}/query", {"where": "1=1", "returnCountOnly": "true", "f": "json"})["count"])
        return [_Page(o, self.batch) for o in range(0, n, self.batch)] or [_Page(0, self.batch)]

    def read(self, partition):
        """All rows of the partition's range: a server may send fewer than asked for, so the offset follows what came."""
        offset, end = partition.offset, partition.offset + partition.size
        while offset < end:
            page = http_fetch(f"{self.url}/query", {"where": "1=1", "outFields": "*", "resultOffset": offset, "resultRecordCount": end - offset, "f": "json"})
            rows = [f["attributes"] for f in page.get("features", [])][: end - offset]
            if not rows:
                return
            offset += len(rows)
            for a in rows:
                yield tuple(a.get(c) for c in self.schema.names)


# ---- registry pages: choosing among search results, formatting officers ----


def best_entity(results: list[dict], name: str) -> dict | None:
    """The active entity of exactly the name, else the first with an id."""
    for r in results:
        if (r.get("name") or "").strip().casefold() == name.strip().casefold() and (r.get("status") or "").casefold() == "active" and r.get("id"):
            return r
    return next((r for r in results if r.get("id")), None)


def format_officers(officers: list[dict]) -> str:
    """``Title: Name; ...`` in order, each once."""
    seen = dict.fromkeys(f"{o['title']}: {o['name']}" if o.get("title") else o["name"] for o in officers if o.get("name"))
    return "; ".join(seen)


#: Words of companies that only serve as registered agents (fixed values).
AGENT_SERVICES = ("REGISTERED AGENT", "CORPORATION SERVICE", "CT CORPORATION", "C T CORPORATION", "INCORP SERVICES", "NATIONAL REGISTERED", "LEGALZOOM", "NORTHWEST REGISTERED", "COGENCY GLOBAL", "UNITED AGENT")


def is_agent_service(name: str | None) -> bool:
    up = (name or "").upper()
    return any(w in up for w in AGENT_SERVICES)


# ---- bulk files, environment files ----


def bulk_file(open_url: Callable[[str], object], url: str, path: str, retries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """A bulk download as a file, in place at once; returns its size. ``open_url`` gives a binary reader."""
    import os
    import shutil

    part = path + ".part"
    for k in range(retries):
        try:
            with open_url(url) as src, open(part, "wb") as out:
                shutil.copyfileobj(src, out)
            os.replace(part, path)
            return os.path.getsize(path)
        except OSError:
            if os.path.exists(part):
                os.remove(part)
            if k + 1 == retries:
                raise
            sleep(wait * 2**k)
    raise AssertionError


def set_env_key(path: str, key: str, value: str) -> None:
    """One key of an environment file set or added; other lines stay, the file is replaced at once and private."""
    import os

    lines = open(path, encoding="utf-8").read().splitlines() if os.path.exists(path) else []
    new = f"{key}={value}"
    hit = [k for k, line in enumerate(lines) if line.split("=", 1)[0].removeprefix("export ").strip() == key]
    for k in hit:
        lines[k] = new
    part = path + ".part"
    with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write("\n".join(lines if hit else [*lines, new]) + "\n")
    os.replace(part, path)
