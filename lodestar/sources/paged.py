"""Catalogues that servers give page by page, as a Spark data source: a partition for each server, followed by cursor."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: ``(server, cursor or None) -> (tools of the page as (name, about), next cursor or None)``.
Client = Callable[[str, str | None], tuple[list[tuple[str, str]], str | None]]
FORMAT = "lodestar_catalogue"


def _escaped(value: str) -> str:
    """A value in the name of a partition's folder."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or c < " " else c for c in value)


def folder_client(root: str) -> Client:
    """Pages that lie as JSON files ``root/server=<name>/cursor=<cursor or start>/*.json``, one object with ``tools`` and
    ``next`` to a page: recorded listings as Spark writes them, partitioned by server and cursor."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)

    def page(server: str, cursor: str | None) -> tuple[list[tuple[str, str]], str | None]:
        place = f"{base}/server={_escaped(server)}/cursor={_escaped(cursor or 'start')}"
        tools: list[tuple[str, str]] = []
        following = None
        for info in sorted(system.get_file_info(fs.FileSelector(place)), key=lambda f: f.path):
            if info.path.endswith(".json"):
                with system.open_input_stream(info.path) as source:
                    for line in source.read().splitlines():
                        found = json.loads(line)
                        tools += [(t["name"], t.get("about", "")) for t in found["tools"]]
                        following = found.get("next", following)
        return tools, following

    return page


class Server(InputPartition):
    def __init__(self, name: str, cursor: str | None) -> None:
        self.name, self.cursor = name, cursor


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.servers = json.loads(options["servers"])
        self.after = json.loads(options.get("after", "{}"))
        self.client, self.place = options["client"], options.get("path", "")

    def partitions(self) -> list[InputPartition]:
        return [Server(name, self.after.get(name)) for name in self.servers]

    def read(self, partition: Server) -> Iterator[tuple]:
        module, _, name = self.client.partition(":")
        ask: Client = getattr(importlib.import_module(module), name)(self.place)
        cursor, number, seen = partition.cursor, 0, set()
        while True:
            tools, following = ask(partition.name, cursor)
            for tool, about in tools:
                yield partition.name, tool, f"{partition.name}__{tool}", about, number, cursor
            if following is None:
                return
            if following in seen:
                raise ValueError(f"{partition.name} gives the cursor {following!r} twice")
            seen.add(following)
            cursor, number = following, number + 1


class CatalogueSource(DataSource):
    """``spark.read.format("lodestar_catalogue")`` → ``(server, tool, name, about, page, cursor)``.

    Options: ``servers``, a JSON list; ``client``, the ``module:function`` that makes a :data:`Client` from ``path``;
    ``after``, a JSON object of cursors to begin at, by server. Executors ask; a page at a time is held, and a server
    that never ends its listing by a cursor it gave before stops the job.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "server string, tool string, name string, about string, page int, cursor string"

    def reader(self, schema) -> DataSourceReader:
        return CatalogueReader(dict(self.options))


def read_catalogue(spark: SparkSession, servers: list[str], path: str, client: str = "lodestar.sources.paged:folder_client", after: dict[str, str] | None = None):
    """The tools of all servers; see :class:`CatalogueSource`."""
    spark.dataSource.register(CatalogueSource)
    reader = spark.read.format(FORMAT).option("servers", json.dumps(servers)).option("client", client).option("after", json.dumps(after or {}))
    return reader.load(path)
