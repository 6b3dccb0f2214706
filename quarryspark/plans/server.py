"""The tools over JSON-RPC on standard input and output, a message a line, as tool hosts speak it.

Standard output holds messages only; what the server has to say of itself is logged.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from typing import IO

from quarryspark.plans.tools import ToolResult

log = logging.getLogger(__name__)
#: fixed values: the protocol's version and error codes
PROTOCOL = "2024-11-05"
BAD_JSON, BAD_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602
_FOCUS = {"type": "string", "description": "What to pay attention to."}
DEFINITIONS = [
    {
        "name": "web_search",
        "description": "Search the web and condense what is found into one digest with sources.",
        "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "max_results": {"type": "integer", "minimum": 1, "default": 5}, "focus": _FOCUS}, "required": ["query"], "additionalProperties": False},
    },
    {"name": "web_fetch", "description": "Fetch a page and condense it.", "inputSchema": {"type": "object", "properties": {"url": {"type": "string"}, "focus": _FOCUS}, "required": ["url"], "additionalProperties": False}},
]


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class ToolServer:
    """Answers messages with ``call(name, arguments)``, as ``tools.dispatcher`` makes it."""

    def __init__(self, call: Callable[[str, object], ToolResult], name: str = "quarryspark", version: str = "1.0.0"):
        self.call, self.about = call, {"name": name, "version": version}

    def _result(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": params.get("protocolVersion") or PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": self.about}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": DEFINITIONS}
        if method == "tools/call":
            if not isinstance(params.get("name"), str):
                raise RpcError(BAD_PARAMS, "name must be a string")
            got = self.call(params["name"], params.get("arguments") or {})
            return {"content": [{"type": "text", "text": got.text}], "isError": got.is_error}
        raise RpcError(NO_METHOD, f"Method not found: {method}")

    def answer(self, line: str) -> str | None:
        """The answer to one message; None for notifications."""
        number = None
        try:
            try:
                m = json.loads(line)
            except ValueError:
                raise RpcError(BAD_JSON, "Parse error") from None
            if not isinstance(m, dict) or not isinstance(m.get("method"), str):
                raise RpcError(BAD_REQUEST, "Invalid request")
            if "id" not in m:
                if m["method"] == "notifications/initialized":
                    log.info("session ready")
                return None
            number, params = m["id"], m.get("params") or {}
            if not isinstance(params, dict):
                raise RpcError(BAD_PARAMS, "params must be an object")
            said = {"result": self._result(m["method"], params)}
        except RpcError as e:
            said = {"error": {"code": e.code, "message": str(e)}}
        return json.dumps({"jsonrpc": "2.0", "id": number} | said, ensure_ascii=False)

    def serve(self, read: IO[str], write: IO[str]) -> None:
        """Until the input ends."""
        log.info("listening on stdio")
        for line in read:
            if line.strip() and (said := self.answer(line)) is not None:
                write.write(said + "\n")
                write.flush()
        log.info("input closed")
