"""Bundles over HTTP: analyses run one at a time behind a queue, and everything else reads files."""

from __future__ import annotations

import json
import math
import mimetypes
import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from terrachron.functions.dims import BBox
from terrachron.functions.geo import KM_PER_DEGREE, MAX_AREA_KM2, NAME, aoi_name
from terrachron.sinks.bundles import Bundles, Refused

#: Characters of a place search, its results, and seconds between two searches.
MAX_QUERY, MAX_PLACES, SPACING = 200, 5, 1.1


class Jobs:
    """Work that runs one after the other; what is known of a job is read from its future."""

    def __init__(self) -> None:
        self._pool = ThreadPoolExecutor(max_workers=1)
        self._known: dict[str, tuple[Future, dict, dict]] = {}

    def submit(self, region: str, work: Callable[[], None]) -> str:
        times = {"started": time.time()}
        future = self._pool.submit(work)
        future.add_done_callback(lambda _: times.update(finished=time.time()))
        name = uuid.uuid4().hex[:12]
        self._known[name] = (future, {"id": name, "region": region} | times, times)
        return name

    def get(self, job: str) -> dict:
        if job not in self._known:
            raise Refused(404, f"there is no job {job}")
        future, about, times = self._known[job]
        if not future.done():
            return about | {"status": "running" if future.running() else "queued"}
        failure = future.exception()
        return about | times | ({"status": "error", "error": str(failure)} if failure else {"status": "done"})


class Places:
    """Searches for places through ``search``, remembered by lower-cased text and spaced in time."""

    def __init__(self, search: Callable[[str, int], list[dict]] | None, spacing: float = SPACING) -> None:
        self._search, self._spacing, self._known, self._lock, self._last = search, spacing, {}, threading.Lock(), -math.inf

    def find(self, text: str) -> list[dict]:
        text = text.strip()[:MAX_QUERY]
        if len(text) < 2:
            return []
        with self._lock:
            if text.lower() not in self._known:
                if self._search is None:
                    raise Refused(502, "geocoding unavailable")
                time.sleep(max(0.0, self._last + self._spacing - time.monotonic()))
                self._last = time.monotonic()
                try:
                    self._known[text.lower()] = self._search(text, MAX_PLACES)[:MAX_PLACES]
                except OSError as e:
                    raise Refused(502, f"geocoding unavailable: {e}") from e
            return self._known[text.lower()]


class Service:
    """Answers requests; ``analyse`` (region, years) makes a region's bundle."""

    def __init__(self, bundles: Bundles, analyse: Callable[[str, list[int] | None], None], years: tuple[int, ...] = (), search: Callable[[str, int], list[dict]] | None = None) -> None:
        self.bundles, self.analyse, self.years = bundles, analyse, years
        self.jobs, self.places = Jobs(), Places(search)

    def request(self, body: dict) -> dict:
        """Answers with the bundle that a request means, or with the job that will make it."""
        years = self._years(body.get("years"))
        region = self._region(body, years)
        if self.bundles.summary(region):
            return {"status": "done", "region": region}
        return {"status": "queued", "region": region, "job": self.jobs.submit(region, lambda: self.analyse(region, years))}

    def _years(self, asked: list[int] | None) -> list[int] | None:
        missing = set(asked or ()).difference(self.years) if self.years else ()
        if missing:
            raise Refused(400, f"no observations in {', '.join(map(str, sorted(missing)))}")
        return asked

    def _region(self, body: dict, years: list[int] | None) -> str:
        """The request's name, or one that stands for its box and years."""
        sides = [body.get(side) for side in ("west", "south", "east", "north")]
        region = body.get("name")
        if sides != [None] * 4:
            box = self._box(sides)
            region = region or aoi_name(box.west, box.south, box.east, box.north, tuple(years or self.years))
        if isinstance(region, str) and re.match(NAME, region):
            return region
        raise Refused(400, f"a name of the form {NAME} is needed, or a box")

    @staticmethod
    def _box(sides: list) -> BBox:
        try:
            box = BBox(*map(float, sides))
        except (TypeError, ValueError) as e:
            raise Refused(400, f"the box can't be used: {e}") from e
        wide, high = box.east - box.west, box.north - box.south
        km2 = wide * high * KM_PER_DEGREE**2 * math.cos(math.radians(box.south + high / 2))
        if km2 > MAX_AREA_KM2:
            raise Refused(400, f"{km2:.0f} km² are too many: at most {MAX_AREA_KM2:.0f}")
        return box

    def prewarm(self, regions: list[str]) -> list[str]:
        """Jobs for ``regions``, if there is no bundle yet."""
        return [] if self.bundles.listing() else [self.jobs.submit(r, lambda r=r: self.analyse(r, None)) for r in regions]

    def get(self, path: str, query: dict[str, list[str]]) -> dict | list | Path:
        match [unquote(p) for p in path.strip("/").split("/")]:
            case ["api", "health"]:
                return {"status": "ok"}
            case ["api", "regions"]:
                return self.bundles.listing()
            case ["api", "jobs", job]:
                return self.jobs.get(job)
            case ["api", "geocode"]:
                return self.places.find(query.get("q", [""])[0])
            case ["api", "region", region, "summary" | "validation" as what]:
                return json.loads(self.bundles.file(region, f"{what}.json").read_text())
            case ["api", "region", region, "overlays" | "evidence" as what]:
                return json.loads(self.bundles.file(region, what, f"{what}.json").read_text())
            case ["api", "region", region, "overlays" | "figures" | "evidence" | "rasters" as kind, name]:
                return self.bundles.file(region, kind, name)
        raise Refused(404, "no such path")


def serve(service: Service, port: int, host: str = "127.0.0.1") -> None:
    server(service, port, host).serve_forever()


def server(service: Service, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, make: Callable[[], dict | list | Path]) -> None:
            status, kind = 200, "application/json"
            try:
                out = make()
            except Refused as e:
                status, out = e.status, {"detail": str(e)}
            if isinstance(out, Path):
                kind, raw = mimetypes.guess_type(out.name)[0] or "application/octet-stream", out.read_bytes()
            else:
                raw = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            self._answer(lambda: service.get(url.path, parse_qs(url.query)))

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))

            def make() -> dict:
                if urlsplit(self.path).path != "/api/analyze":
                    raise Refused(404, "no such path")
                try:
                    body = json.loads(raw)
                except ValueError as e:
                    raise Refused(400, f"not JSON: {e}") from e
                if not isinstance(body, dict):
                    raise Refused(400, "not a JSON object")
                return service.request(body)

            self._answer(make)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
