"""What is asked of services, and fetching of files they give."""

from __future__ import annotations

import os
import urllib.request

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_request(south: Column, west: Column, north: Column, east: Column, key: str, values: list[str], seconds: int = 300) -> Column:
    """The text that asks a map service for nodes and ways with one of a tag's values in a box, with centres."""
    box = F.format_string("(%.4f,%.4f,%.4f,%.4f)", south, west, north, east)
    tag = f'["{key}"~"{"|".join(values)}"]'
    return F.concat(F.lit(f"[out:json][timeout:{seconds}];(node{tag}"), box, F.lit(f";way{tag}"), box, F.lit(";);out center;"))


def shapes_url(year: int, state: str, kind: str = "bg", host: str = "https://www2.census.gov/geo/tiger") -> str:
    """Where a state's census shapes of a year are."""
    return f"{host}/TIGER{year}/{kind.upper()}/tl_{year}_{state}_{kind}.zip"


def download(url: str, path: str, chunk: int = 1 << 20) -> bool:
    """Fetch a file piece by piece; one that is there already stays. Whether it was fetched. A broken fetch leaves no file."""
    if os.path.exists(path):
        return False
    part = f"{path}.part"
    with urllib.request.urlopen(url, timeout=60) as r, open(part, "wb") as f:
        while piece := r.read(chunk):
            f.write(piece)
    os.replace(part, path)
    return True
