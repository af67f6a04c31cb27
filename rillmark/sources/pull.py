"""Spark data sources for systems that are polled over HTTP or subscribed to.

One request is one input partition, so many queues, shards or time slices are
fetched by many tasks.  A row is the raw response; ``sources.landing`` turns
responses into records with DataFrame functions.
"""

from __future__ import annotations

import base64
import json
import string
import sys
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import quote, urlencode

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Spark plans data sources in a Python process of the driver that has no shipped packages: they travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "system string, request string, poll bigint, response string"


@dataclass(frozen=True)
class Tls:
    """Trust and identity of a connection: an own authority, a client certificate with its key (files of every machine)."""

    authority: str | None = None
    certificate: str | None = None
    key: str | None = None

    def context(self):
        """An SSL context, or None where the machine's own trust is enough."""
        import ssl

        if not (self.authority or self.certificate):
            return None
        context = ssl.create_default_context(cafile=self.authority)
        if self.certificate:
            context.load_cert_chain(self.certificate, self.key)
        return context


@dataclass(frozen=True)
class Login:
    """Who asks: a user with a password, a token, or a header of its own; without any of them nobody in particular."""

    user: str = ""
    password: str = ""
    token: str = ""
    header: str = ""

    def headers(self) -> dict[str, str]:
        found = {}
        if self.user:
            found["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode()
        if self.token:
            found["Authorization"] = "Bearer " + self.token
        if self.header:
            name, _, value = self.header.partition(":")
            found[name.strip()] = value.strip()
        return found


@dataclass(frozen=True)
class Request:
    """One HTTP request of a system."""

    method: str
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    body: str | None = None
    tls: Tls = Tls()


Transport = Callable[[Request], str]


def http(request: Request) -> str:
    """Fetch a response text; errors fail the task, which Spark retries."""
    from urllib.request import Request as HttpRequest
    from urllib.request import urlopen

    data = None if request.body is None else request.body.encode("utf-8")
    ask = HttpRequest(request.url, data, request.headers, method=request.method)
    with urlopen(ask, timeout=60, context=request.tls.context()) as reply:
        return reply.read().decode("utf-8")


@dataclass(frozen=True)
class Form:
    """How a system is asked: address and body with ``{places}``, filled from settings.

    A body is JSON, a form or plain text by its ``kind``; in JSON a text that is one place takes the setting as it is.
    """

    method: str
    address: str
    body: object = None
    kind: str = "application/json"
    accept: str | None = None


# Addresses and bodies that the systems' public HTTP interfaces ask for, per step of a poll.  ``read``
# leaves messages where they are, ``done`` lets go of them when Spark has stored what was read.
FORMS: dict[str, dict[str, Form]] = {
    "kafka": {
        "open": Form("POST", "/consumers/{group}", {"name": "{member}", "format": "json", "auto.commit.enable": "false"}, "application/vnd.kafka.v2+json"),
        "subscribe": Form("POST", "/consumers/{group}/instances/{member}/subscription", {"topics": "{topics}"}, "application/vnd.kafka.v2+json"),
        "read": Form("GET", "/consumers/{group}/instances/{member}/records?max_bytes={bytes}", accept="application/vnd.kafka.json.v2+json"),
        "done": Form("POST", "/consumers/{group}/instances/{member}/offsets", {}, "application/vnd.kafka.v2+json")},
    "rabbitmq": {
        "read": Form("POST", "/api/queues/{vhost}/{queue}/get", {"count": "{count}", "ackmode": "ack_requeue_true", "encoding": "auto"}),
        "done": Form("POST", "/api/queues/{vhost}/{queue}/get", {"count": "{count}", "ackmode": "ack_requeue_false", "encoding": "auto"})},
    "redis": {"read": Form("GET", "/{command}/{key}")},
    "scada": {"read": Form("GET", "/{path}")},
    "splunk": {"read": Form("POST", "/services/search/jobs", {"search": "{search}", "output_mode": "json", "exec_mode": "oneshot"}, "application/x-www-form-urlencoded")},
    "elasticsearch": {"read": Form("POST", "/{index}/_search", "{search}")},
    "clickhouse": {"read": Form("POST", "/?database={database}", "{statement}", "text/plain")},
    "influxdb": {"read": Form("POST", "/api/v2/query?org={org}", {"query": "{flux}", "type": "flux"}, accept="application/json")},
    "logstash": {"read": Form("GET", "/{path}")},
}
DEFAULTS = {"bytes": 1 << 20, "count": 100}


def _filled(part: object, settings: Mapping[str, object]) -> object:
    """A body with its places filled; one place alone keeps the setting's type."""
    if isinstance(part, dict):
        return {k: _filled(v, settings) for k, v in part.items()}
    places = [name for _, name, _, _ in string.Formatter().parse(str(part)) if name]
    if len(places) == 1 and part == "{" + places[0] + "}":
        return settings[places[0]]
    return str(part).format_map(settings)


def build_request(system: str, settings: Mapping, step: str = "read") -> Request:
    """A step of a system's poll: ``at`` is its base address, ``login`` and ``tls`` are optional groups, all else fills places."""
    if system not in FORMS:
        raise ValueError(f"unsupported system: {system}")
    form = FORMS[system][step]
    known = {**DEFAULTS, **{k: v for k, v in settings.items() if k not in ("login", "tls")}}
    path, _, ask = form.address.partition("?")
    url = known["at"].rstrip("/") + path.format_map({k: quote(str(v).lstrip("/"), safe="/") if k == "path" else quote(str(v), safe="") for k, v in known.items()})
    if ask:
        url += "?" + ask.format_map({k: quote(str(v), safe="") for k, v in known.items()})
    head = Login(**settings.get("login", {})).headers() | ({"Accept": form.accept} if form.accept else {})
    body = None
    if form.body is not None:
        filled = _filled(form.body, known)
        body = {"text/plain": str, "application/x-www-form-urlencoded": urlencode}.get(form.kind, json.dumps)(filled)
        head["Content-Type"] = form.kind
    return Request(form.method, url, head, body, Tls(**settings.get("tls", {})))


@dataclass
class Poll(InputPartition):
    """One request of one poll."""

    system: str
    settings: str
    number: int


def _each(options: dict) -> list[str]:
    given = json.loads(options["requests"])
    return [json.dumps(one) for one in (given if isinstance(given, list) else [given])]


def pull_source(transport: Transport = http, clock: Callable[[], float] = time.time) -> type[DataSource]:
    """Data source ``pull``: options ``system``, ``requests`` (JSON settings, one or a list) and ``interval`` in seconds.

    Register with ``spark.dataSource.register(pull_source())``.  ``transport`` and ``clock`` are shipped to the tasks and
    can be replaced in tests.  Polls are numbered by the clock, so a query that is started again goes on behind the
    number in its checkpoint, and what a source keeps for its readers is let go (``done``) only when Spark reports a
    batch as stored; until then it is read again.
    """

    def fetch(partition: Poll) -> Iterator[tuple]:
        request = build_request(partition.system, json.loads(partition.settings))
        yield partition.system, request.url, partition.number, transport(request)

    class Batch(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [Poll(self.options["system"], one, 0) for one in _each(self.options)]

        def read(self, partition):
            return fetch(partition)

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options
            self.opened = False

        def _now(self) -> int:
            return int(clock() // float(self.options.get("interval", "1")))

        def _all(self, step: str) -> None:
            if step in FORMS[self.options["system"]]:
                for one in _each(self.options):
                    transport(build_request(self.options["system"], json.loads(one), step))

        def initialOffset(self):
            return {"poll": self._now() - 1}

        def latestOffset(self):
            if not self.opened:
                for step in ("open", "subscribe"):
                    self._all(step)
                self.opened = True
            return {"poll": self._now()}

        def partitions(self, start, end):
            if end["poll"] <= start["poll"]:  # the clock was set back
                return []
            return [Poll(self.options["system"], one, end["poll"]) for one in _each(self.options)]

        def read(self, partition):
            return fetch(partition)

        def commit(self, end):
            self._all("done")

    class Pull(DataSource):
        @classmethod
        def name(cls):
            return "pull"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Batch(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    return Pull


@dataclass
class Shelf(InputPartition):
    """Messages numbered from ``start`` to ``end`` of one subscription."""

    topic: str
    start: int
    end: int


def subscription_source(feed: Callable[[str, int, int], Iterator[str]], size: Callable[[str], int]) -> type[DataSource]:
    """Data source ``subscription``: a message feed per topic (MQTT through a numbered store).

    ``feed(topic, start, end)`` yields messages and ``size(topic)`` tells how
    many there are.  Each topic is its own partition, so a batch can be read
    again after a failure.
    """

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.topics = [t.strip() for t in options["topics"].split(",")]

        def initialOffset(self):
            return {t: 0 for t in self.topics}

        def latestOffset(self):
            return {t: size(t) for t in self.topics}

        def partitions(self, start, end):
            return [Shelf(t, start.get(t, 0), end[t]) for t in self.topics if end[t] > start.get(t, 0)]

        def read(self, partition):
            for i, message in enumerate(feed(partition.topic, partition.start, partition.end)):
                yield partition.topic, partition.start + i, message

    class Batch(DataSourceReader):
        def __init__(self, options: dict):
            self.stream = Stream(options)

        def partitions(self):
            return self.stream.partitions(self.stream.initialOffset(), self.stream.latestOffset())

        def read(self, partition):
            return self.stream.read(partition)

    class Subscription(DataSource):
        @classmethod
        def name(cls):
            return "subscription"

        def schema(self):
            return "topic string, offset bigint, value string"

        def reader(self, schema):
            return Batch(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    return Subscription
