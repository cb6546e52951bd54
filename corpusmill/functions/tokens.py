"""Exact token counts and packing to a token budget: plain Python on one text."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

FOOTER = "[Context Truncated]"


# Counted as one token each, and the tokens of the shortest mark, the least budget that explains a cut.
SPECIAL = ("<|endoftext|>", "<|endofprompt|>")
LEAST_BUDGET = 5


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """A byte-level BPE from a rank file; by default the public 50k vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t: max(ranks.values()) + 1 + k for k, t in enumerate(SPECIAL)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def count(text: str) -> int:
    return len(encoder().encode(text, allowed_special="all")) if text else 0


def chunks(text: str) -> list[str]:
    """Cut after the first blank line of each gap that is not inside a code fence."""
    out, start, at, fenced, blank = [], 0, 0, False, False
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        at += len(line)
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if not fenced and not line.strip():
            if not blank:
                out.append(text[start:at])
                start = at
            blank = True
        else:
            blank = False
    return [*out, text[start:]] if start < len(text) else out


def hard_prefix(text: str, most: int) -> str:
    """The longest prefix of at most so many tokens that bisection over its bytes finds."""
    raw = text.encode()
    reach = max(64, 8 * most)
    while reach < len(raw) and count(raw[:reach].decode(errors="ignore")) <= most:
        reach *= 2
    low, high, best = 0, min(reach, len(raw)), 0
    while low <= high:
        at = (low + high) // 2
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        if count(raw[:at].decode()) <= most:
            best, low = at, at + 1
            while low < len(raw) and raw[low] & 0xC0 == 0x80:
                low += 1
        elif at == 0:
            break
        else:
            high = at - 1
    return raw[:best].decode().rstrip()


class Prefixes:
    """Token counts of a text's prefixes that end with a chunk. A chunk ends in a line end, where pieces of text are cut
    for encoding, so a prefix is encoded from its last chunk on only: counts add up."""

    def __init__(self, parts: list[str]):
        self.parts, self.ends, self.upto = parts, [0], [0]
        for p in parts:
            self.ends.append(self.ends[-1] + len(p))

    def tokens(self, text: str, k: int) -> int:
        """Tokens of the first k chunks."""
        while len(self.upto) <= k:
            n = len(self.upto)
            self.upto.append(count(text[: self.ends[n]]) if n < 3 else self._grown(text, n))
        return self.upto[k]

    def _grown(self, text: str, n: int) -> int:
        # Where the white space of one chunk meets the next, encoding may differ: the last two are encoded together.
        last, both = text[self.ends[n - 2] : self.ends[n - 1]], text[self.ends[n - 2] : self.ends[n]]
        return self.upto[n - 1] + count(both) - count(last)


def pack(text: str, most: int) -> tuple[str, int, bool]:
    """The text within ``most`` tokens, tokens removed, and whether it was cut.

    What is kept shrinks until it fits with its footer: chunk by chunk as long as whole chunks fit, then token by token.
    """
    total = count(text)
    if total <= most:
        return text, 0, False
    if most <= 0:
        return "", total, True
    parts = chunks(text)
    known = Prefixes(parts)
    whole = 0
    while whole < len(parts) and known.tokens(text, whole + 1) <= most:
        whole += 1

    def made(kept: str) -> tuple[str, int, bool] | None:
        kept = kept.rstrip()
        removed = total - count(kept)
        footer = f"[Context Truncated: Removed {removed} tokens to fit {most}-token budget]"
        footer = footer if count(footer) <= most else FOOTER
        out = f"{kept}\n\n{footer}" if kept else footer
        return (out, removed, True) if count(out) <= most else None

    while whole and text[: known.ends[whole]].strip():
        if out := made(text[: known.ends[whole]]):
            return out
        whole -= 1
    if "```" not in "".join(parts[:1]):
        # Budgets below the first chunks with text: the longest prefix of fewer and fewer tokens.
        first = known.tokens(text, min(whole + 1, len(parts)))
        for budget in range(first - 1 if first <= most else most, 0, -1):
            if out := made(hard_prefix(text, budget)):
                return out
    return made("") or (hard_prefix(FOOTER, most), total, True)


def body_within(prefix: str, content: str, footer: str, most: int) -> str:
    """Prefix, as much of the content as fits, and footer within ``most`` tokens."""
    fits = lambda n: count(f"{prefix}{content[:n].rstrip()}{footer}") <= most
    n = min(len(content), 4 * max(0, most - count(prefix) - count(footer)))
    # One character less at a time until it fits. A character takes four tokens with it at most, so far beyond the budget
    # larger steps skip no length that fits; the last step is walked back, as white space before the end goes at once.
    step = 0
    while n and not fits(n):
        step = min(n, max(1, (count(f"{prefix}{content[:n].rstrip()}{footer}") - most) // 8))
        n -= step
    n = next((m for m in range(n + step - 1, n, -1) if fits(m)), n)
    return f"{prefix}{content[:n].rstrip()}{footer}" if n or fits(0) else f"{prefix}{footer}"[: 4 * most]
