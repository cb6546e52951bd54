"""The command line: clean an input (also as ``gha`` for CI logs and ``repo`` for directories), ``report`` on it, or ``serve``."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from corpusmill import api, errors
from corpusmill.functions import patterns as P
from corpusmill.functions import tokens
from corpusmill.operators import clean as C
from corpusmill.sources import files

#: Default mode of each command; ``clean`` is what runs without a command's name.
COMMANDS = {"clean": "standard", "gha": "aggressive", "repo": "standard", "report": "standard"}


def positive(value: str) -> int:
    try:
        n = int(value)
    except ValueError:
        raise argparse.ArgumentTypeError("must be a positive integer") from None
    if n <= 0:
        raise argparse.ArgumentTypeError("must be greater than 0" if n == 0 else "must be a positive integer")
    return n


def explainable(value: str) -> int:
    """A budget that leaves room for the mark of a cut."""
    n = positive(value)
    if n < tokens.LEAST_BUDGET:
        raise argparse.ArgumentTypeError(f"must be at least {tokens.LEAST_BUDGET} so truncation can be explained")
    return n


def shared(parser: argparse.ArgumentParser) -> argparse.ArgumentParser:
    """Options of every command."""
    add = parser.add_argument
    add("-t", "--max-tokens", type=explainable, help="most tokens of the content")
    add("--fit", choices=tuple(P.PRESETS), help="budget of a known model")
    add("-m", "--mode", choices=C.MODES)
    add("-f", "--format", choices=C.FORMATS, default="markdown")
    add("-c", "--strip-comments", action="store_true")
    add("--redact-secrets", action="store_true", help="the default, said aloud")
    add("--no-redact-secrets", action="store_true")
    add("-q", "--quiet", action="store_true")
    add("-v", "--verbose", action="store_true")
    return parser


def parser_for(command: str) -> argparse.ArgumentParser:
    own = shared(argparse.ArgumentParser(prog="corpusmill" + ("" if command == "clean" else f" {command}"), description=__doc__))
    own.add_argument("input", nargs="?" if command == "clean" else None, help="file, directory or - for standard input")
    own.add_argument("-o", "--output", "--out", help="file to write instead of standard output")
    own.add_argument("--dry-run", action="store_true", help="print, write no file")
    own.add_argument("--include-sensitive", action="store_true")
    own.add_argument("--force", action="store_true", help="replace an existing output file")
    return own


def validate(args: argparse.Namespace) -> None:
    if args.quiet and args.verbose:
        raise errors.Usage("--quiet and --verbose cannot be used together")
    if args.redact_secrets and args.no_redact_secrets:
        raise errors.Usage("--redact-secrets and --no-redact-secrets cannot be used together")
    if args.fit and args.max_tokens and args.max_tokens > P.PRESETS[args.fit][1]:
        raise errors.Usage(f"--max-tokens {args.max_tokens} exceeds --fit {args.fit} preset limit of {P.PRESETS[args.fit][1]}")


def options_of(args: argparse.Namespace, default_mode: str) -> C.CleanOptions:
    return C.CleanOptions(args.mode or default_mode, args.format, args.max_tokens, args.fit, args.strip_comments, not args.no_redact_secrets)


def say(args: argparse.Namespace, text: str) -> None:
    """Diagnostics go to standard error, unless they are not wanted."""
    if not args.quiet:
        print(text, file=sys.stderr)


def put(out: str, args: argparse.Namespace, what: str) -> None:
    if args.output and not args.dry_run:
        files.write_text(out, args.output, args.force)
        say(args, f"wrote {what} to {args.output}")
        return
    if args.output:
        say(args, f"dry run: not writing output to {args.output}")
    print(out)


def run(command: str, args: argparse.Namespace) -> None:
    validate(args)
    if args.no_redact_secrets:
        say(args, "warning: secret redaction disabled by --no-redact-secrets")
    source, options, began = files.read_input(args.input, args.include_sensitive), options_of(args, COMMANDS[command]), time.monotonic()
    if command == "report":
        out, result = api.reported((str(args.input), *source[1:]), options, args.include_sensitive)
    else:
        out, result = api.rendered(source, options)
    if args.verbose:
        took = int(1000 * (time.monotonic() - began))
        say(args, f"source: {source[0]}; input_tokens: {result['metrics']['input_tokens']}; output_tokens: {result['metrics']['output_tokens']}; elapsed_ms: {took}")
    put(out, args, "report" if command == "report" else "cleaned output")


def main(argv: Sequence[str] | None = None) -> int:
    """Exit code: 0 done, 1 failed, 2 wrong use or no input, 3 reading or writing failed."""
    argv = list(sys.argv[1:] if argv is None else argv)
    try:
        if argv[:1] == ["serve"]:
            from corpusmill import service

            service.serve(sys.stdin, sys.stdout)
            return errors.OK
        command = argv.pop(0) if argv and argv[0] in ("gha", "repo", "report") else "clean"
        run(command, parser_for(command).parse_args(argv))
        return errors.OK
    except errors.CorpusmillError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    except SystemExit as e:  # argparse: 2 for wrong use, 0 for help
        return int(e.code or 0)


if __name__ == "__main__":
    sys.exit(main())
