"""Sources on other machines, by the Data Source API.

luminal_http reads lines of resources by byte ranges, so that executors read parts of one resource at a time; as a stream it
follows resources that grow, its offsets being byte positions. luminal_sse follows an event stream, its offset being
the id of the last event. Both go on after a broken connection where they stood, and after a restart from the offset in the
checkpoint, so no line or event is lost or doubled."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

LINE = "url string, offset long, value string"
EVENT = "id string, event string, data string"
TAIL = 1 << 16
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)


class _Settings:
    def __init__(self, options: dict) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        self.urls = [u for u in (get("url") or get("path") or "").split("\n") if u]
        if not self.urls:
            raise ValueError("a url is needed")
        self.chunk, self.retries, self.backoff = int(get("chunk", 32 << 20)), int(get("retries", 5)), float(get("backoff", 0.5))
        self.timeout, self.most, self.wait = float(get("timeout", 30)), int(get("most", 10_000)), float(get("wait", 1.0))

    def retried(self, work: Callable, progress: Callable[[], object] = lambda: None):
        """work(), again after an error that may pass, ever more slowly. Progress starts the count of tries anew."""
        tries, stood = 0, progress()
        while True:
            try:
                return work()
            except urllib.error.HTTPError as e:
                if e.code not in TRANSIENT:
                    raise
                error = e
            except (OSError, EOFError) as e:  # URLError, resets, timeouts, bodies that end too soon
                error = e
            tries, stood = (0 if progress() != stood else tries + 1), progress()
            if tries > self.retries:
                raise error
            time.sleep(self.backoff * 2**tries)

    def open(self, url: str, **headers: str):
        return urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=self.timeout)

    def size(self, url: str) -> int | None:
        """Bytes of a resource that is served by ranges, None for one that is not."""

        def ask():
            with self.open(url, Range="bytes=0-0") as r:
                total = (r.headers.get("Content-Range") or "").rpartition("/")[2]
                return int(total) if r.status == 206 and total.isdigit() else None

        try:
            return self.retried(ask)
        except urllib.error.HTTPError as e:
            if e.code == 416:  # an empty resource has no first byte
                return 0
            raise

    def bytes_of(self, url: str, start: int, stop: int) -> bytes:
        got = b""

        def ask():
            nonlocal got
            with self.open(url, Range=f"bytes={start + len(got)}-{stop - 1}") as r:
                while part := r.read(1 << 16):
                    got += part
            if len(got) < stop - start:
                raise EOFError(f"{url} broke off")
            return got

        return self.retried(ask, lambda: len(got))

    def lines(self, url: str, start: int, stop: int | None, size: int | None) -> Iterator[tuple[str, int, str]]:
        """The lines that begin from start on and before stop, with where they begin. After a broken connection reading
        goes on behind the last whole line. Without ranges (size None) the resource is read anew and what has been
        read is passed over."""
        at, held, skip = start, b"", False
        if start and size is not None:
            at, skip = start - 1, True  # a line that begins at start follows a line feed
        out: list[tuple[str, int, str]] = []
        place = at

        def read():
            nonlocal place, held, skip
            if size is not None and place >= size:
                return True
            held = b""
            headers = {} if size is None else {"Range": f"bytes={place}-{size - 1}"}
            with self.open(url, **headers) as r:
                passed = place if size is None else 0
                left = r.headers.get("Content-Length")
                taken = 0
                while part := r.read(1 << 16):
                    taken += len(part)
                    if passed:
                        cut = min(passed, len(part))
                        passed, part = passed - cut, part[cut:]
                    held += part
                    *whole, held = held.split(b"\n")
                    for line in whole:
                        begin, place = place, place + len(line) + 1
                        if skip:
                            skip = False
                        elif stop is not None and begin >= stop:
                            return True
                        else:
                            out.append((url, begin, line.removesuffix(b"\r").decode("utf-8", "replace")))
                    if stop is not None and place >= stop and not skip:
                        return True
                    if len(out) >= 4096:
                        return False
                if left is not None and taken < int(left):
                    raise EOFError(f"{url} broke off")
            if held and not skip and (stop is None or place < stop):
                out.append((url, place, held.removesuffix(b"\r").decode("utf-8", "replace")))
                place += len(held)
            return True

        ended = False
        while not ended:
            try:
                ended = self.retried(read, lambda: place)
            finally:
                batch, out[:] = list(out), []
            yield from batch


class Range(InputPartition):
    def __init__(self, url: str, start: int, stop: int | None, size: int | None) -> None:
        self.url, self.start, self.stop, self.size = url, start, stop, size


class _HttpReader(DataSourceReader):
    def __init__(self, settings: _Settings) -> None:
        self.settings = settings

    def partitions(self) -> list[Range]:
        out = []
        for url in self.settings.urls:
            size = self.settings.size(url)
            if size is None:
                out.append(Range(url, 0, None, None))
            else:
                out += [Range(url, a, min(size, a + self.settings.chunk), size) for a in range(0, size, self.settings.chunk)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.settings.lines(partition.url, partition.start, partition.stop, partition.size)


class _HttpStream(DataSourceStreamReader):
    def __init__(self, settings: _Settings) -> None:
        self.settings = settings

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.settings.urls, 0)

    def latestOffset(self) -> dict:
        return {u: self._whole(u) for u in self.settings.urls}

    def _whole(self, url: str) -> int:
        """Where the last whole line ends."""
        size = self.settings.size(url)
        if size is None:
            raise ValueError(f"{url} is not served by ranges and cannot be followed")
        stop = size
        while stop > 0:
            start = max(0, stop - TAIL)
            end = self.settings.bytes_of(url, start, stop).rfind(b"\n")
            if end >= 0:
                return start + end + 1
            stop = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for url, stop in end.items():
            out += [Range(url, a, min(stop, a + self.settings.chunk), stop) for a in range(start.get(url, 0), stop, self.settings.chunk)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.settings.lines(partition.url, partition.start, partition.stop, partition.size)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class HttpSource(DataSource):
    """Options: url (several by line feeds), chunk (bytes of a partition), retries, backoff, timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "luminal_http"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(_Settings(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _HttpStream(_Settings(self.options))


class _SseStream(SimpleDataSourceStreamReader):
    def __init__(self, settings: _Settings) -> None:
        self.settings = settings

    def initialOffset(self) -> dict:
        return {"id": ""}

    def _events(self, after: str, until: str | None) -> list[tuple[str, str, str]]:
        """Events after the one named, up to most of them or until; less where none comes for wait seconds."""
        s, out, last = self.settings, [], after

        def ask():
            nonlocal last
            headers = {"Accept": "text/event-stream"} | ({"Last-Event-ID": last} if last else {})
            name, data, own = "message", [], last
            quiet = time.monotonic()
            with urllib.request.urlopen(urllib.request.Request(s.urls[0], headers=headers), timeout=max(0.1, s.wait)) as r:
                while until is not None or len(out) < s.most:
                    try:
                        line = r.readline()
                    except TimeoutError:
                        return True
                    if not line:
                        # the server ended the stream; where it gave nothing new there is nothing now
                        return last == after or time.monotonic() - quiet > s.wait
                    text = line.decode("utf-8", "replace").rstrip("\r\n")
                    if text.startswith(":"):
                        if time.monotonic() - quiet > s.wait:
                            return True
                        continue
                    key, _, value = text.partition(":")
                    value = value.removeprefix(" ")
                    if key == "data":
                        data.append(value)
                    elif key == "event":
                        name = value
                    elif key == "id":
                        own = value
                    elif not text and data:
                        out.append((own, name, "\n".join(data)))
                        name, data, last, quiet = "message", [], own, time.monotonic()
                        if until is not None and own == until:
                            return True
            return True

        before = None
        while before != last:  # again as long as something comes
            before = last
            s.retried(ask, lambda: last)
            if until is None and len(out) >= s.most or until is not None and last == until or not out:
                break
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        events = self._events(start["id"], None)
        return iter(events), {"id": events[-1][0] if events else start["id"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._events(start["id"], end["id"]) if start != end else [])

    def commit(self, end: dict) -> None:
        pass


class SseSource(DataSource):
    """Options: url, most (events a micro-batch; they pass through the driver), wait (seconds without an event that end
    it), retries, backoff. The server must name its events and take Last-Event-ID."""

    @classmethod
    def name(cls) -> str:
        return "luminal_sse"

    def schema(self) -> str:
        return EVENT

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _SseStream(_Settings(self.options))


def _format(spark: SparkSession, source: type[DataSource], reader, urls: str | list[str], options: dict):
    spark.dataSource.register(source)
    text = urls if isinstance(urls, str) else "\n".join(urls)
    return reader.format(source.name()).options(url=text, **options).load()


def http_lines(spark: SparkSession, urls: str | list[str], **options) -> DataFrame:
    """url, offset, value: the lines of resources, read by ranges where the server gives them."""
    return _format(spark, HttpSource, spark.read, urls, options)


def follow_lines(spark: SparkSession, urls: str | list[str], **options) -> DataFrame:
    """A stream of the lines of resources that grow. A line counts once its line feed is there."""
    return _format(spark, HttpSource, spark.readStream, urls, options)


def follow_events(spark: SparkSession, url: str, **options) -> DataFrame:
    """A stream of the events (id, event, data) of a server."""
    return _format(spark, SseSource, spark.readStream, url, options)


def http_json(spark: SparkSession, urls: str | list[str], schema: str, **options) -> DataFrame:
    """Records of JSON lines; a line that cannot be read is dropped."""
    return _parsed(http_lines(spark, urls, **options), F.from_json("value", schema))


def http_csv(spark: SparkSession, urls: str | list[str], schema: str, header: bool = True, **options) -> DataFrame:
    """Rows of CSV whose fields hold no line feeds; with header the first line of each resource is passed over."""
    lines = http_lines(spark, urls, **options)
    return _parsed(lines.filter("offset > 0") if header else lines, F.from_csv("value", schema))


def _parsed(lines: DataFrame, record) -> DataFrame:
    rows = lines.filter("trim(value) <> ''").withColumn("_r", record)
    return rows.filter(F.coalesce(F.expr("size(filter(array(" + ", ".join(f"_r.`{f.name}` is not null" for f in rows.schema["_r"].dataType) + "), x -> x)) > 0"), F.lit(False))).select("_r.*")


def follow_messages(spark: SparkSession, url: str, schema: str | None = None, **options) -> DataFrame:
    """Messages (type, data) from the JSON of a server's events; those that cannot be read are dropped."""
    from luminal.streaming.stateful import MESSAGE, messages

    return messages(follow_events(spark, url, **options), "data", schema or MESSAGE)


