"""A session over text streams: one JSON request a line, one JSON response a line."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row

from .engine import Engine, Receipt
from .functions.edn import DatalogError, ParseError
from .functions.times import ALL_TIME, FOREVER
from .functions.values import KINDS
from .plans.parser import parse
from .sources.log import ParquetLog


def tagged(value: object) -> object:
    """A result's cell as lossless JSON: refs, keywords and floats that aren't numbers are marked."""
    if isinstance(value, Row) and set(value.asDict()) == {"t", "i", "d", "s"}:
        kind = KINDS[value.t]
        if kind == "ref":
            return {"$ref": value.s}
        if kind == "kw":
            return {"$kw": value.s}
        return tagged({"nil": None, "bool": bool(value.i), "int": value.i, "float": value.d, "string": value.s}[kind])
    if isinstance(value, float) and not math.isfinite(value):
        return {"$float": "nan" if math.isnan(value) else "inf" if value > 0 else "-inf"}
    return value


def record(r: Row) -> dict:
    """A log record in the export form."""
    everything = not r.asserted and r.valid_from == ALL_TIME and r.valid_to == FOREVER
    window = {"valid_from": r.valid_from, "valid_to": None if r.valid_to == FOREVER else r.valid_to}
    return {"entity": r.e, "attribute": r.a, "value": tagged(r.v), "tx_id": r.tx_id, "tx_count": r.tx_count, "valid_time": "all" if everything else window, "asserted": r.asserted}


class Session:
    """Answers requests; a broken line is answered with an error, and the next line begins anew."""

    def __init__(self, engine: Engine):
        self.engine, self.done = engine, False

    def answer(self, line: str) -> dict:
        """The response to one line."""
        request: object = None
        try:
            request = json.loads(line)
            if not isinstance(request, dict) or not isinstance(request.get("op"), str):
                raise KeyError("an object with a string op is expected")
            run = getattr(self, f"_{request['op']}", None)
            if run is None or request["op"] not in ("execute", "status", "checkpoint", "maintenance", "backup", "export_since", "ping", "shutdown"):
                raise KeyError(f"unknown op {request['op']!r}")
            out = {"ok": True, "result": run(request)}
        except (json.JSONDecodeError, KeyError) as e:
            out = _error("protocol", e.args[0] if isinstance(e, KeyError) else str(e))
        except ParseError as e:
            out = _error("parse", str(e))
        except (DatalogError, PySparkException) as e:
            out = _error("execution", str(e))
        except OSError as e:
            out = _error("storage", str(e))
        if isinstance(request, dict) and "id" in request:
            out["id"] = request["id"]
        return out

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        """Responses to lines until shutdown or their end; empty lines have none."""
        for line in lines:
            if line.strip():
                yield json.dumps(self.answer(line), ensure_ascii=False)
            if self.done:
                return

    def run(self, source: TextIO, sink: TextIO) -> None:
        for response in self.serve(source):
            sink.write(response + "\n")
            sink.flush()

    def _execute(self, request: dict) -> dict:
        if not isinstance(request.get("datalog"), str):
            raise KeyError("execute needs datalog")
        got = self.engine.run(parse(request["datalog"]))
        if isinstance(got, DataFrame):
            return {"type": "query", "variables": got.columns, "results": [[tagged(x) for x in row] for row in got.collect()]}
        return self._receipt(got)

    @staticmethod
    def _receipt(got: Receipt) -> dict:
        if got.kind == "ok":
            return {"type": "ok"}
        out = {"type": got.kind, "tx_id": got.tx_id, "tx_count": got.tx_count, "durability": "applied"}
        return out | ({"forgotten": got.count} if got.kind == "forgotten" else {})

    def _status(self, request: dict) -> dict:
        log = self.engine._log()
        segments = len(log._ranges()) if isinstance(log, ParquetLog) else None
        return {"type": "status", "fact_count": log.read().count(), "pending_facts": 0, "tx_count": log.head, "wal_bytes": None, "delta_segments": segments, "delta_pages": None, "last_checkpoint_unix_ms": None, "last_checkpoint_outcome": None}

    def _checkpoint(self, request: dict) -> dict:
        return {"type": "checkpoint", "durability": "published"}  # every commit is published when it returns

    def _maintenance(self, request: dict) -> dict:
        return {"type": "maintenance", "checkpoint": "noop", "delta": "recompacted" if self.engine.compact() else "noop", "advice": "none"}

    def _backup(self, request: dict) -> dict:
        to = request.get("destination")
        if not isinstance(to, str) or not to:
            raise KeyError("backup needs a destination")
        return {"type": "backup", "destination": to, "tx_count": self.engine.backup(to), "durability": "published"}

    def _export_since(self, request: dict) -> dict:
        since = request.get("since_tx_count")
        if not isinstance(since, int) or isinstance(since, bool) or since < 0:
            raise KeyError("export_since needs since_tx_count")
        return {"type": "fact_log", "since_tx_count": since, "head_tx_count": self.engine._log().head, "records": [record(r) for r in self.engine.export_fact_log_since(since).collect()]}

    def _ping(self, request: dict) -> dict:
        return {"type": "pong"}

    def _shutdown(self, request: dict) -> dict:
        self.done = True
        return {"type": "shutdown"}


def _error(kind: str, message: str) -> dict:
    return {"ok": False, "error": {"kind": kind, "message": message}}
