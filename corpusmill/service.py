"""A JSON-RPC service on a pair of streams, a request a line: cleaning and reporting as tools for an assistant.

One session serves all calls. A request without an id is a notification and gets no answer; ``shutdown`` ends the service.
"""

from __future__ import annotations

import json
from typing import Any, TextIO

from corpusmill import __version__, api
from corpusmill.errors import CorpusmillError
from corpusmill.functions import patterns as P
from corpusmill.operators import clean as C
from corpusmill.sources import files

# Fixed values of the protocol.
PROTOCOL = "2025-11-25"
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS = -32700, -32600, -32601, -32602

SCHEMA = {
    "type": "object",
    "properties": {
        "text": {"type": "string", "description": "Text, HTML or log to clean."},
        "input": {"type": "string", "description": "The same as text."},
        "path": {"type": "string", "description": "File or directory to read."},
        "sourceName": {"type": "string"},
        "mode": {"type": "string", "enum": list(C.MODES)},
        "format": {"type": "string", "enum": list(C.FORMATS)},
        "maxTokens": {"type": "integer", "minimum": 5},
        "fit": {"type": "string", "enum": list(P.PRESETS)},
        "stripComments": {"type": "boolean"},
        "redactSecrets": {"type": "boolean"},
        "includeSensitive": {"type": "boolean"},
    },
    "oneOf": [{"required": ["text"]}, {"required": ["input"]}, {"required": ["path"]}],
}


class BadParams(ValueError):
    """Arguments of a call that cannot be used."""


def argument(given: dict, kind: type, *names: str, default: Any = None) -> Any:
    """The first argument of these names that is there, if it is of the kind; camel and snake case are the same."""
    for name in names:
        for spelled in (name, "".join("_" + c.lower() if c.isupper() else c for c in name)):
            if spelled in given:
                value = given[spelled]
                fits = isinstance(value, kind) and not (kind is int and (isinstance(value, bool) or value < 0))
                return value if fits else default
    return default


def source_of(given: dict) -> tuple[str, str, list]:
    text, path = argument(given, str, "text", "input"), argument(given, str, "path")
    if (text is None) == (path is None):
        raise BadParams("tool arguments require exactly one of text/input or path")
    if text is not None:
        return argument(given, str, "sourceName", "source", default="service-input"), text, []
    if path == "-":
        raise BadParams("path input cannot be '-' because stdin is the protocol stream")
    return files.read_input(path, argument(given, bool, "includeSensitive", default=False))


def options_of(given: dict) -> C.CleanOptions:
    """Unlike the command line's, budgets here may be small and larger than a preset's."""
    chosen = {}
    for name, known, default in (("mode", C.MODES, "standard"), ("format", C.FORMATS, "markdown"), ("fit", tuple(P.PRESETS), None)):
        chosen[name] = argument(given, str, name, default=default)
        if chosen[name] is not None and chosen[name] not in known:
            raise BadParams(f"unsupported {name}: {chosen[name]}")
    return C.CleanOptions(
        **chosen, max_tokens=argument(given, int, "maxTokens"), strip_comments=argument(given, bool, "stripComments", default=False),
        redact_secrets=argument(given, bool, "redactSecrets", default=True), bounded=False,
    )


def clean_tool(given: dict) -> str:
    return api.rendered(source_of(given), options_of(given))[0]


def report_tool(given: dict) -> str:
    return api.reported(source_of(given), options_of(given), argument(given, bool, "includeSensitive", default=False))[0]


TOOLS = {
    "corpusmill_clean": (clean_tool, "Clean noisy text, HTML, logs or local files."),
    "corpusmill_report": (report_tool, "Tokens saved, noise sources, removed sections and a recommended command."),
}


def call(params: Any) -> dict:
    name = params.get("name") if isinstance(params, dict) else None
    if not isinstance(name, str):
        raise BadParams("tools/call requires params.name")
    if name not in TOOLS:
        raise BadParams(f"unknown tool: {name}")
    given = params.get("arguments")
    text = TOOLS[name][0](given if isinstance(given, dict) else {})
    return {"content": [{"type": "text", "text": text}], "isError": False}


def answer(request: Any) -> dict:
    """The response to a parsed request."""
    own = {"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None}
    method = request.get("method") if isinstance(request, dict) else None
    if not isinstance(method, str):
        return own | {"error": {"code": INVALID_REQUEST, "message": "invalid request"}}
    if method == "initialize":
        about = {"name": "corpusmill", "title": "corpusmill service", "version": __version__}
        how = "Use corpusmill_clean to clean text or files before they become context; use corpusmill_report to explain what that saves."
        return own | {"result": {"protocolVersion": PROTOCOL, "serverInfo": about, "capabilities": {"tools": {"listChanged": False}}, "instructions": how}}
    if method == "ping":
        return own | {"result": {}}
    if method == "tools/list":
        return own | {"result": {"tools": [{"name": n, "description": d, "inputSchema": SCHEMA} for n, (_, d) in TOOLS.items()]}}
    if method == "tools/call":
        try:
            return own | {"result": call(request.get("params"))}
        except (BadParams, CorpusmillError, ValueError) as e:
            return own | {"error": {"code": INVALID_PARAMS, "message": str(e)}}
    if method == "shutdown":
        return own | {"result": None}
    return own | {"error": {"code": NO_METHOD, "message": "method not found"}}


def serve(requests: TextIO, responses: TextIO) -> None:
    def send(response: dict) -> None:
        responses.write(json.dumps(response, ensure_ascii=False) + "\n")
        responses.flush()

    for line in requests:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError as e:
            send({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}})
            continue
        if not isinstance(request, dict) or "id" not in request:
            continue
        send(answer(request))
        if request.get("method") == "shutdown":
            return
