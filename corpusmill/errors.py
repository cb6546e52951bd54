"""Errors of the entry points, each with the exit code it ends a command with."""

from __future__ import annotations

OK, FAILED, USAGE, PROCESSING = 0, 1, 2, 3


class CorpusmillError(RuntimeError):
    exit_code = FAILED


class MissingInput(CorpusmillError):
    exit_code = USAGE

    def __init__(self):
        super().__init__("missing input; pass a file path or pipe content on stdin")


class InputNotFound(CorpusmillError):
    exit_code = USAGE

    def __init__(self, path: str):
        super().__init__(f"input file not found: {path}")


class ReadInput(CorpusmillError):
    exit_code = PROCESSING

    def __init__(self, reason: str):
        super().__init__(f"failed to read input: {reason}")


class WriteOutput(CorpusmillError):
    exit_code = PROCESSING

    def __init__(self, reason: str):
        super().__init__(f"failed to write output: {reason}")


class OutputExists(CorpusmillError):
    exit_code = USAGE

    def __init__(self, path: str):
        super().__init__(f"output file already exists; use --force to overwrite: {path}")


class Usage(CorpusmillError):
    exit_code = USAGE
