"""A paged candle endpoint as a Python data source: pages go back in time until there is nothing older.

The transport is a callable (item, max_time, limit) -> reply {"success", "errorCode", "data"}, named by "module:function";
a file-backed one serves tests, as there is no network here. Each item is a partition of its own.

As a batch, an item's whole history comes at once. As a stream, its offset is the oldest time asked for, per item: each batch goes back by `span` seconds from
there until `floor`, every item and batch a task of its own. Offsets are known before anything is fetched, so what a batch covers is in
Spark's checkpoint: a query that was stopped goes on where it was, and a batch that is run again asks for the same times. The source keeps
its own place beside it (`journal`, a folder of its own for each checkpoint, on the cluster's file system), as a restarted source is not told the last offset before it must name
the next. With the trigger availableNow each run takes one span.

Transport faults (an OSError, a reply that is no JSON object) are tried again after waits that double; if the last try fails, the task fails
and Spark runs it, or the batch, again: nothing is skipped. Rate limits wait as RatePolicy says.
"""

from __future__ import annotations

import importlib
import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Reply codes of the endpoint.
SHORT_LIMIT, LONG_LIMIT, BLOCKED, MISSING = 107, 108, 106, 404


@dataclass
class RatePolicy:
    """What to do about an error code: seconds to wait, or stop after the third block in a row."""

    blocks: int = 0

    def react(self, code: int) -> tuple[str, int]:
        if code == SHORT_LIMIT:
            return "wait", 60
        if code == LONG_LIMIT:
            return "wait", 120
        if code == BLOCKED:
            self.blocks += 1
            return ("stop", 0) if self.blocks >= 3 else ("wait", 0)
        return "stop", 0

    def succeeded(self) -> None:
        self.blocks = 0


def pages(fetch: Callable[[str, int | None, int], dict], item: str, limit: int = 500, most: int = 24, wait: Callable[[int], None] = lambda s: None) -> Iterator[list]:
    """Candle rows, page by page, newest page first: ends on an empty page, one that begins where the last did, an error, or `most` pages."""
    policy, max_time, first = RatePolicy(), None, None
    done = 0
    while done < most:
        reply = fetch(item, max_time, limit)
        if not reply.get("success"):
            what, seconds = policy.react(int(reply.get("errorCode") or 0))
            if what == "stop":
                return
            wait(seconds)
            done += 1
            continue
        policy.succeeded()
        rows = reply.get("data") or []
        if not rows:
            return
        begins = min(int(r[0]) for r in rows)
        if begins == first:
            return
        yield rows
        first, max_time = begins, begins - 1
        done += 1


def from_folder(folder: str) -> Callable[[str, int | None, int], dict]:
    """Serves {folder}/{item}.json, an array of candle rows, as pages of the newest rows up to max_time."""

    def fetch(item: str, max_time: int | None, limit: int) -> dict:
        try:
            rows = json.load(open(f"{folder}/{item}.json", encoding="utf-8"))
        except FileNotFoundError:
            return {"success": False, "errorCode": 404}
        rows = sorted((r for r in rows if max_time is None or int(r[0]) <= max_time), key=lambda r: int(r[0]))
        return {"success": True, "data": rows[-limit:]}

    return fetch


def from_address(address: str, timeout: float = 30.0) -> Callable[[str, int | None, int], dict]:
    """Serves an HTTP endpoint; address has {item}, {limit} and {max_time} (empty for the newest page) in it."""

    def fetch(item: str, max_time: int | None, limit: int) -> dict:
        url = address.format(item=urllib.parse.quote(item), limit=limit, max_time="" if max_time is None else max_time)
        with urllib.request.urlopen(url, timeout=timeout) as reply:
            return json.loads(reply.read())

    return fetch


def retried(fetch: Callable[[str, int | None, int], dict], tries: int = 5, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, int | None, int], dict]:
    """fetch with transport faults tried again after `first` seconds, then twice as long each time; the last fault is raised."""

    def again(item: str, max_time: int | None, limit: int) -> dict:
        for turn in range(tries):
            try:
                reply = fetch(item, max_time, limit)
                if not isinstance(reply, dict):
                    raise ValueError("the reply is no object")
                return reply
            except (OSError, ValueError):
                if turn == tries - 1:
                    raise
                sleep(first * 2**turn)

    return again


class Unreachable(RuntimeError):
    """The endpoint refused for good; the batch must be run again."""


def rows_between(fetch: Callable[[str, int | None, int], dict], item: str, low: int, high: int, limit: int = 500, sleep: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """Rows of low <= time < high, page by page back from high; a refusal that RatePolicy gives up on raises Unreachable."""
    policy, until = RatePolicy(), high - 1
    while until >= low:
        reply = fetch(item, until, limit)
        if not reply.get("success"):
            code = int(reply.get("errorCode") or 0)
            if code == MISSING:
                return
            what, seconds = policy.react(code)
            if what == "stop":
                raise Unreachable(f"{item}: code {code}")
            sleep(seconds)
            continue
        policy.succeeded()
        rows = [r for r in reply.get("data") or [] if int(r[0]) <= until]
        if not rows:
            return
        yield [r for r in rows if int(r[0]) >= low]
        until = min(int(r[0]) for r in rows) - 1


def transport(options: dict) -> Callable[[str, int | None, int], dict]:
    """The callable that the options name: fetch ("module:function"), address (HTTP) or folder."""
    if "fetch" in options:
        module, name = options["fetch"].split(":")
        fetch = getattr(importlib.import_module(module), name)
    else:
        fetch = from_address(options["address"]) if "address" in options else from_folder(options["folder"])
    return retried(fetch, int(options.get("tries", 5)), float(options.get("wait", 1.0)))


def named_items(options: dict) -> list[str]:
    return [i.strip() for i in options.get("items", "").split(",") if i.strip()]


class PagedCandles(DataSource):
    """spark.read.format("paged_candles").option("items", "1,2").option("folder", ...): (item_id, data array<array<string>>).

    spark.readStream takes the same options and `until` (the newest time, exclusive), `floor`, `span` (seconds) and `journal`.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_candles"

    def schema(self) -> str:
        return "item_id string, data array<array<string>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def _texts(rows: list) -> list[list[str | None]]:
    return [[None if v is None else str(v) for v in r] for r in rows]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in named_items(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for rows in pages(transport(self.options), partition.value, int(self.options.get("limit", 500)), int(self.options.get("pages", 24))):
            yield partition.value, _texts(rows)


@dataclass
class Stretch(InputPartition):
    """An item's times low <= t < high."""

    item: str
    low: int
    high: int


class _StreamReader(DataSourceStreamReader):
    """Offsets are {item: oldest time asked for}; an item without one begins at `until`."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.until, self.floor = int(options["until"]), int(options.get("floor", 0))
        self.span, self.place = int(options.get("span", 500 * 3600)), None

    def initialOffset(self) -> dict:
        return {i: self.until for i in named_items(self.options)}

    def latestOffset(self) -> dict:
        """One span further back than what was named last, by this reader or the one before it."""
        if self.place is None:
            self.place = self.initialOffset() | self._read()
        self.place = {i: max(self.floor, t - self.span) for i, t in self.place.items()}
        return dict(self.place)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # Spark has logged `end` by now: wherever a run is lost, it comes back to this batch, and the source goes on behind it.
        known = self._read()
        self.place = {i: min(t, known.get(i, t), (self.place or {}).get(i, t)) for i, t in end.items()}
        self._write(self.place)
        return [Stretch(i, low, start.get(i, self.until)) for i, low in sorted(end.items()) if low < start.get(i, self.until)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for rows in rows_between(transport(self.options), partition.item, partition.low, partition.high, int(self.options.get("limit", 500))):
            yield partition.item, _texts(rows)

    def _file(self):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.options["journal"])
        return where, f"{path.rstrip('/')}/oldest.json"

    def _write(self, place: dict) -> None:
        if "journal" in self.options:
            where, path = self._file()
            where.create_dir(os.path.dirname(path), recursive=True)
            with where.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(place).encode())
            where.move(f"{path}.new", path)

    def _read(self) -> dict:
        if "journal" not in self.options:
            return {}
        where, path = self._file()
        if not where.get_file_info(path).is_file:
            return {}
        with where.open_input_stream(path) as f:
            return {i: int(t) for i, t in json.loads(f.read()).items()}
