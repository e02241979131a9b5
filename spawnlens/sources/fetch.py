"""A data source of contract sources behind a provider.

The offline provider reads files root/<match>/<chain>/<address>/: `metadata.json` and what it lists. A provider for a network service implements
`get(path)` and is given by its class; retries wait 0.5 s times the attempt.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Kinds of matches in the order in which they are tried.
MATCHES, TRIES, WAIT_S = ("full_match", "partial_match"), 3, 0.5


class FolderProvider:
    def __init__(self, root: str):
        self.root = root

    def get(self, path: str) -> str | None:
        full = os.path.join(self.root, path)
        if not os.path.exists(full):
            return None
        with open(full, encoding="utf-8") as f:
            return f.read()


def fetch(provider, chain: str, address: str, wait_s: float = WAIT_S) -> dict | None:
    """A package, or None if no kind of match has it. Content that is no file of its own is taken from the metadata."""

    def get(path: str) -> str | None:
        for attempt in range(TRIES):
            try:
                return provider.get(path)
            except OSError:
                if attempt + 1 < TRIES:
                    time.sleep(wait_s * (attempt + 1))
        return None

    for match in MATCHES:
        base = f"{match}/{chain}/{address}"
        if (text := get(f"{base}/metadata.json")) is None:
            continue
        meta = json.loads(text)
        files = []
        for path, entry in sorted((meta.get("sources") or {}).items()):
            content = get(f"{base}/sources/{path}")
            if content is None:
                content = entry.get("content")
            if content is not None:
                files.append((path, content))
        if files:
            return {"chain": chain, "address": address.lower(), "source_status": match, "compiler": (meta.get("compiler") or {}).get("version"), "files": files}
    return None


def provider_class(name: str) -> type:
    """The class module:Class; FolderProvider if no name is given."""
    if not name:
        return FolderProvider
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)


class _Part(InputPartition):
    def __init__(self, chain: str, addresses: list[str]):
        self.chain, self.addresses = chain, addresses


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.chain, self.provider = options["path"], options["chain"], options.get("provider", "")
        self.addresses = [a for a in options.get("addresses", "").split(",") if a]
        self.at_once = int(options.get("batch", "50"))

    def partitions(self):
        return [_Part(self.chain, self.addresses[k : k + self.at_once]) for k in range(0, len(self.addresses), self.at_once)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        provider = provider_class(self.provider)(self.root)
        for address in partition.addresses:
            if found := fetch(provider, partition.chain, address):
                yield found["chain"], found["address"], found["source_status"], found["compiler"], found["files"]


class PackageSource(DataSource):
    """spark.read.format("contract_sources").options(chain=..., addresses="0x..,0x..").load(root); provider="module:Class" names another provider, made from root."""

    @classmethod
    def name(cls) -> str:
        return "contract_sources"

    def schema(self) -> str:
        return "chain string, address string, source_status string, compiler string, files array<struct<path: string, content: string>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
