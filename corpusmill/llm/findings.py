"""Labelled findings made by rule, for training the secret scanner where no reviewed ones are at hand.

The rules come from the public forms of keys and tokens, from how configuration files, code and prose name passwords, and
from what scanners usually report wrongly: digests, ids, versions, paths, card numbers, placeholders, references in code.
No table of documents is looked at.
"""

from __future__ import annotations

import random
import string

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.secrets import WORDS

#: Endings of the paths that findings are given.
PLACES = ("", ".py", ".js", ".yml", ".env", ".txt", ".md", "/config.json", "/main.go")


def findings_by_rule(spark: SparkSession, rows: int = 6000, seed: int = 7) -> DataFrame:
    """Labelled findings: word, the two words before, path and label (1: a secret); half of each, always the same for a seed.

    To ``rows`` of the usual kinds come two thirds as many whose label hangs on a telling name or neighbouring word.
    """
    rng = random.Random(seed)
    of = lambda chars, n: "".join(rng.choices(chars, k=n))
    low, hexa, upper = string.ascii_lowercase, "0123456789abcdef", string.ascii_uppercase + string.digits
    every = string.ascii_letters + string.digits
    plain = lambda: of(low, rng.randint(2, 9))
    place = lambda: "/".join(rng.choices(WORDS, k=rng.randint(1, 3))) + rng.choice(PLACES)
    name = lambda: rng.choice(("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "PASSWORD", "API_TOKEN", "db_password"))
    quote = lambda s: rng.choice((s, s, f'"{s}"', f"'{s}'"))

    def secret() -> tuple[str, str, str]:
        body = rng.choice((of(hexa, rng.choice((16, 18, 20, 24, 32, 40, 64))), of(every, rng.randint(16, 44)), of(every + "+/", 40)))
        kind = rng.randrange(8)
        if kind == 0:
            return "AKIA" + of(upper, 16), plain(), plain()
        if kind == 1:
            return rng.choice(("ghp_", "gho_", "npm_")) + of(every, 36), plain(), plain()
        if kind == 2:
            return "sk-" + of(every, rng.randint(24, 48)), plain(), plain()
        if kind == 3:
            return "eyJ" + of(every, 20) + "." + of(every, 40) + "." + of(every, 30), rng.choice(("Bearer", plain())), plain()
        if kind in (4, 5):
            return name() + rng.choice("=:") + quote(body), plain(), plain()
        if kind == 6:
            return quote(body), rng.choice(("=", ":", "is")), name()
        return quote(body), name() + rng.choice((":", "=", "")), plain()

    def harmless() -> tuple[str, str, str]:
        word, kind = plain(), rng.randrange(13)
        if kind == 0:
            return f"{plain()}.{rng.randint(0, 99):02}@{plain()}{rng.randint(0, 9)}.example.com", word, plain()
        if kind == 1:
            return "4" + of(string.digits, 15), word, plain()
        if kind == 2:
            return "-".join(of(hexa, n) for n in (8, 4, 4, 4, 12)), rng.choice(("id", "uuid", word)), plain()
        if kind == 3:
            return of(hexa, rng.choice((32, 40, 64))), rng.choice(("commit", "sha1", "sha256", "md5", "checksum", "digest")), plain()
        if kind == 4:
            return f"https://www.{plain()}.com/{plain()}/{rng.randint(1, 9999)}", word, plain()
        if kind == 5:
            return f"src/{rng.choice(WORDS)}/{plain()}_{rng.randint(1, 99)}.py", word, plain()
        if kind == 6:
            return f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00Z", word, plain()
        if kind == 7:
            return "".join(rng.choices(WORDS, k=3)) + str(rng.randint(1, 999)), word, plain()
        if kind == 8:
            return "_".join(rng.choices(WORDS, k=3)) + str(rng.randint(1, 99)), rng.choice((word, "=")), plain()
        if kind == 9:
            return f"+{rng.randint(1, 99)}-{of(string.digits, 3)}-{of(string.digits, 7)}", word, plain()
        if kind == 10:
            return of(low, rng.randint(10, 25)) + rng.choice(("", ".", "!!")) + str(rng.randint(0, 99)), word, plain()
        if kind == 11:
            return name() + "=" + rng.choice(("your", "example", "sample", "test", "changeme")) + "_" + "_".join(rng.choices(WORDS, k=2)) + "1", word, plain()
        return "978-" + of(string.digits, 10), rng.choice(("ISBN", word)), plain()

    out = []
    for k in range(rows):
        word, before, before2 = secret() if k % 2 else harmless()
        tests = rng.random() < (0.1 if k % 2 else 0.3)
        out.append((word, before, before2, "tests/fixtures/data.txt" if tests else place(), k % 2))

    def weak() -> tuple[str, str, str]:
        """A secret that only its name or a neighbouring word tells: short, without digits, or with other characters."""
        phrase = rng.choice((of(low, rng.randint(8, 26)), of(low, rng.randint(8, 26)), "".join(rng.choices(WORDS, k=rng.randint(4, 6)))))
        mixed = rng.choice((of(low, rng.randint(4, 8)) + of(string.digits, rng.randint(1, 3)) + of(low, rng.randint(3, 5)), of(low + string.digits, rng.randint(7, 11)) + "7", of(every, rng.randint(8, 15))))
        other = of(every, rng.randint(3, 9)) + rng.choice("&!#$%^*?@:") + of(every, rng.randint(5, 12))
        body, kind = rng.choice((phrase, mixed, mixed, other)), rng.randrange(6)
        if kind < 3:
            return name() + rng.choice("=:") + quote(body), plain(), plain()
        if kind == 3:
            return quote(rng.choice((phrase, mixed))), rng.choice(("=", ":", "is")), name()
        if kind == 4:
            return quote(rng.choice((phrase, mixed))), name() + rng.choice((":", "=")), plain()
        return quote(mixed), name(), plain()

    def named_harmless() -> tuple[str, str, str]:
        """A word that follows a telling one and is no secret: a placeholder, a reference in code, prose."""
        pick, kind = (lambda k: rng.choices(WORDS, k=k)), rng.randrange(10)
        tell = rng.choice((name(), "private", "tokens", "passwords", "credentials", "secret", "authentication", "token", "password"))
        if kind == 0:
            return name() + rng.choice("=:") + quote(rng.choice(("your", "example", "sample", "test", "changeme", "my")) + rng.choice("_-") + rng.choice("_-").join(pick(2))), plain(), plain()
        if kind == 1:
            return name() + rng.choice("=:") + rng.choice(("process.env", "os.environ", "self", "request.form", "config", "this")) + "." + rng.choice("_.").join(pick(2)), plain(), plain()
        if kind == 2:
            return name() + rng.choice("=:") + quote(rng.choice("*x.X-") * rng.randint(8, 20)), plain(), plain()
        if kind in (3, 8, 9):
            return name() + rng.choice("=:") + rng.choice(("_".join(pick(2)), pick(1)[0] + "".join(w.title() for w in pick(2)))), plain(), plain()
        if kind == 4:
            return rng.choice((of(low, rng.randint(8, 14)), "".join(pick(2)), of(low, rng.randint(8, 12)).title())) + rng.choice(("", "", ",", ".")), tell, plain()
        if kind == 5:
            return rng.choice((of(low, rng.randint(8, 14)), "".join(pick(2)))) + rng.choice(("", "", ",", ".")), rng.choice(("of", "and", "for", plain())), tell
        if kind == 6:
            return rng.choice(("required", "optional", "disabled", "undefined", "protected", "unlimited", "settings", "management", "development", "_".join(pick(2)))), rng.choice((name() + ":", "is")), tell
        return f"https://www.{plain()}.com/{plain()}/{rng.choice(WORDS)}", tell, plain()

    for k in range(rows * 2 // 3):
        word, before, before2 = weak() if k % 2 else named_harmless()
        out.append((word, before, before2, place(), k % 2))
    return spark.createDataFrame(out, "word string, before string, before2 string, path string, label int")
