"""Source and code of contracts from an explorer's service, for addresses that stand in a table.

Addresses are dealt over `tasks` tasks, each of which has at most `in_flight` requests open, so that the service sees at most their product; answers are handed on
in the order of the addresses as they come, and no more than `in_flight` are held. A request that fails for a while (no connection, too many requests, an error of the service)
is tried again after a wait that doubles; what fails for good is told in the row and does not end the job.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

#: Requests that a task has open, tries of one, first wait and longest wait in seconds, and seconds that an answer may take.
IN_FLIGHT, TRIES, WAIT_S, LONGEST_S, TIMEOUT_S = 4, 4, 0.5, 30.0, 10.0
#: Answers of the service that may be better a while later.
FOR_A_WHILE = {408, 425, 429, 500, 502, 503, 504}
FOUND = "address string, source_code string, contract_name string, compiler string, bytecode string, problem string"


class Refused(OSError):
    """An answer that no further try will change."""


def get(url: str, tries: int = TRIES, wait_s: float = WAIT_S, timeout_s: float = TIMEOUT_S) -> bytes | None:
    """The body at url, None where there is nothing (404, 410). Waits as long as the service says, if it does."""
    wait = wait_s
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout_s) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return None
            if e.code not in FOR_A_WHILE:
                raise Refused(f"status {e.code}") from e
            last, told = f"status {e.code}", e.headers.get("Retry-After", "")
        except OSError as e:  # no connection, no answer in time
            last, told = str(e), ""
        if attempt + 1 < tries:
            time.sleep(min(LONGEST_S, float(told) if told.isdigit() else wait))
            wait *= 2
    raise OSError(f"{last}, {tries} times")


class Explorer:
    """The service at `url`. ask(parameters) gives what an answer holds."""

    def __init__(self, url: str, key: str = "", tries: int = TRIES, wait_s: float = WAIT_S, timeout_s: float = TIMEOUT_S):
        self.url, self.key, self.how = url, key, (tries, wait_s, timeout_s)

    def ask(self, **parameters: str) -> dict:
        body = get(f"{self.url}?{urllib.parse.urlencode({**parameters, 'apikey': self.key})}", *self.how)
        found = json.loads(body) if body else {}
        return found if isinstance(found, dict) else {}

    def source(self, address: str) -> dict | None:
        """The verified source's record; None unless the answer's status is 1 and the source is not empty."""
        found = self.ask(module="contract", action="getsourcecode", address=address)
        rows = found.get("result")
        first = rows[0] if found.get("status") == "1" and isinstance(rows, list) and rows else None
        return first if isinstance(first, dict) and first.get("SourceCode") else None

    def code(self, address: str) -> str | None:
        """The deployed code; None where there is none, which the service says as 0x."""
        found = self.ask(module="proxy", action="eth_getCode", address=address, tag="latest").get("result")
        return found if isinstance(found, str) and found not in ("", "0x") else None

    def look_up(self, address: str) -> tuple:
        """A row of FOUND. A failed request gives nulls and says why."""
        problems, source, code = [], None, None
        try:
            source = self.source(address)
        except (OSError, ValueError) as e:
            problems.append(f"source: {e}")
        try:
            code = self.code(address)
        except (OSError, ValueError) as e:
            problems.append(f"code: {e}")
        source = source or {}
        return address, source.get("SourceCode"), source.get("ContractName"), source.get("CompilerVersion"), code, "; ".join(problems) or None


def in_order(items: Iterable, work: Callable, at_once: int) -> Iterator:
    """work(item) of each item in their order, at most `at_once` begun and not yet handed on."""
    with ThreadPoolExecutor(at_once) as pool:
        begun: deque = deque()
        for item in items:
            begun.append(pool.submit(work, item))
            if len(begun) >= at_once:
                yield begun.popleft().result()
        while begun:
            yield begun.popleft().result()


def look_up(addresses: DataFrame, explorer: Explorer, tasks: int = 4, in_flight: int = IN_FLIGHT, address_col: str = "address") -> DataFrame:
    """FOUND for each different address; null addresses are left out."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(in_order(batch.column(0).to_pylist(), explorer.look_up, in_flight))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names=names)

    wanted = addresses.where(addresses[address_col].isNotNull()).select(address_col).distinct()
    return wanted.repartition(tasks, address_col).mapInArrow(run, FOUND)


class HttpProvider:
    """A provider of source packages for the contract_sources data source: files below a service's address. Spaces and the like in paths are quoted."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def get(self, path: str) -> str | None:
        body = get(f"{self.root}/{urllib.parse.quote(path)}", tries=1)
        return None if body is None else body.decode("utf-8", "replace")
