"""Runs a command: its output goes through untouched if it succeeds, and is cleaned if it fails. The exit code stays.

Both streams go to temporary files, so nothing is held in memory but what the limit of captured bytes allows.
"""

from __future__ import annotations

import argparse
import shutil
import subprocess
import sys
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass
from typing import BinaryIO

from corpusmill import api, cli, errors

# Exit codes, and bytes of each stream that are cleaned.
TIMED_OUT, NOT_FOUND = 124, 127
CAPTURED_BYTES = 4 * 1024 * 1024


@dataclass
class Outcome:
    """How a command ended; a code below 0 is a signal's."""

    code: int
    timed_out: bool
    stdout: BinaryIO
    stderr: BinaryIO

    def head(self, stream: BinaryIO, limit: int) -> tuple[str, bool]:
        """The first bytes of a stream as text, and whether there are more."""
        stream.seek(0)
        raw = stream.read(limit + 1)
        return raw[:limit].decode(errors="replace"), len(raw) > limit


def execute(command: Sequence[str], timeout: float | None, stdout: BinaryIO, stderr: BinaryIO) -> Outcome:
    try:
        child = subprocess.Popen(command, stdout=stdout, stderr=stderr)
    except FileNotFoundError as e:
        failed = errors.CorpusmillError(f"failed to run {command[0]}: {e.strerror}")
        failed.exit_code = NOT_FOUND
        raise failed from e
    except OSError as e:
        raise errors.ReadInput(f"failed to run {command[0]}: {e.strerror}") from e
    try:
        return Outcome(child.wait(timeout), False, stdout, stderr)
    except subprocess.TimeoutExpired:
        child.kill()
        return Outcome(child.wait(), True, stdout, stderr)


def captured(command: Sequence[str], out: Outcome, limit: int, timeout: float | None) -> str:
    """What is cleaned: the command, both streams under headings, and marks for what is missing."""
    text = f"$ {' '.join(command)}\n"
    if out.timed_out:
        text += f"\n[{PROG}: command timed out after {timeout} second(s)]\n"
    for name, stream in (("stdout", out.stdout), ("stderr", out.stderr)):
        own, more = out.head(stream, limit)
        if own:
            text += f"\n## {name}\n\n{own}"
            text += f"\n[{PROG}: {name} truncated after {limit} bytes]\n" if more else ""
    return text


PROG = "corpusmill-run"


def parser() -> argparse.ArgumentParser:
    own = cli.shared(argparse.ArgumentParser(prog=PROG, description=__doc__))
    own.add_argument("--capture-limit-bytes", type=cli.positive, default=CAPTURED_BYTES)
    own.add_argument("--timeout-seconds", type=cli.positive)
    own.add_argument("command", nargs=argparse.REMAINDER)
    return own


def run(args: argparse.Namespace) -> int:
    cli.validate(args)
    command = args.command[1:] if args.command[:1] == ["--"] else args.command
    if not command:
        raise errors.Usage("no command to run")
    with tempfile.TemporaryFile() as stdout, tempfile.TemporaryFile() as stderr:
        out = execute(command, args.timeout_seconds, stdout, stderr)
        if out.code == 0 and not out.timed_out:
            for stream, to in ((stdout, sys.stdout), (stderr, sys.stderr)):
                stream.seek(0)
                to.flush()
                shutil.copyfileobj(stream, to.buffer)
                to.flush()
            return errors.OK
        status = "terminated by signal" if out.code < 0 else f"exit code {out.code}"
        cli.say(args, f"{PROG}: command failed with {status}; cleaned output follows")
        text = captured(command, out, args.capture_limit_bytes, args.timeout_seconds)
        if args.verbose:
            cut = [str(out.head(s, args.capture_limit_bytes)[1]).lower() for s in (stdout, stderr)]
            cli.say(args, f"{PROG}: command: {' '.join(command)}\n{PROG}: capture_limit_bytes={args.capture_limit_bytes} stdout_truncated={cut[0]} stderr_truncated={cut[1]}")
    print(api.rendered((f"{PROG} {' '.join(command)}", text, []), cli.options_of(args, "aggressive"))[0])
    return TIMED_OUT if out.timed_out else errors.PROCESSING if out.code < 0 else out.code


def main(argv: Sequence[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except errors.CorpusmillError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    except SystemExit as e:
        return int(e.code or 0)


if __name__ == "__main__":
    sys.exit(main())
