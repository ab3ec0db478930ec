"""A folder for each region: summary, validation, rasters and overlays; listing and reading them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Row

from terrachron.functions.geo import NAME


class Refused(Exception):
    """A request that can't be served, with its HTTP status."""

    def __init__(self, status: int, why: str) -> None:
        super().__init__(why)
        self.status = status


class Bundles:
    def __init__(self, root: str | Path) -> None:
        self.root = Path(root)

    def write(self, region: object, name: str, text: str) -> None:
        """A file of a region's bundle, replaced in one step."""
        path = self.root / str(region) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(path.name + ".part")
        part.write_text(text)
        part.replace(path)

    def write_tiles(self, tiles: Iterable[Row], kind: str, suffix: str) -> int:
        """Files of tiles as they come, one at a time."""
        n = 0
        for n, t in enumerate(tiles, 1):
            path = self.root / str(t.region) / kind / f"{t.layer}_{t.tr}_{t.tc}.{suffix}"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(t.image)
        return n

    def summary(self, region: str) -> dict | None:
        found = self._inside(region, ("summary.json",))
        return json.loads(found.read_text()) if found else None

    def listing(self) -> list[dict]:
        """What each bundle's summary says of itself, by the time it was written, the last first; others aren't listed."""
        found = []
        for entry in self._entries(self.root).values():
            at = self._inside(entry.name, ("summary.json",)) if entry.is_dir() else None
            row = _card(at) if at else None
            if row:
                found.append((at.stat().st_mtime, row))
        return [row for _, row in sorted(found, key=lambda x: (-x[0], str(x[1]["region"])))]

    def file(self, region: str, *parts: str) -> Path:
        """A file of a region's bundle. Every step must be the name of something in the folder before, so none leads out."""
        if not re.match(NAME, region) or any(set(p) & set("/\\\0") or p.strip(".") == "" for p in parts):
            raise Refused(400, f"{'/'.join((region, *parts))!r} can't name a file of a bundle")
        found = self._inside(region, parts)
        if found is None:
            raise Refused(404, f"the bundle of {region} holds no {'/'.join(parts)}")
        return found

    @staticmethod
    def _entries(folder: Path) -> dict[str, os.DirEntry]:
        """What a folder holds by name, without links."""
        try:
            with os.scandir(folder) as entries:
                return {e.name: e for e in entries if not e.is_symlink()}
        except OSError:
            return {}

    def _inside(self, region: str, parts: tuple[str, ...]) -> Path | None:
        at = self.root
        for step in (region, *parts):
            if step not in self._entries(at):
                return None
            at = at / step
        return at if at.is_file() else None


def _card(path: Path) -> dict | None:
    """The listed values of a summary; null where an older one has none. Nothing of one that can't be read."""
    try:
        s = json.loads(path.read_text())
        return {k: s[k] for k in ("region", "years", "area_km2")} | {"event_fraction": s["change"]["event_fraction"]} | {k: s.get(k) for k in ("display_name", "bbox", "generated_at")}
    except (OSError, ValueError, KeyError, TypeError):
        return None
