"""Made words for fitting the tagger of secrets: secrets that no pattern matches, and what only looks like one.

All are drawn from a generator that the caller seeds, so the same text gives the same words.
"""

from __future__ import annotations

import random
import string
import uuid

_ALNUM = string.ascii_letters + string.digits
#: Alphabets of keys and tokens; the last one is that of passwords.
ALPHABETS = (
    _ALNUM,
    _ALNUM + "+/",
    _ALNUM + "-_",
    string.ascii_lowercase + string.digits,
    string.ascii_uppercase + string.digits,
    string.ascii_uppercase + "234567",
    "0123456789ABCDEF",
    _ALNUM + "!@#$%^&*",
)
#: Words before a secret: that name it in ways the patterns do not match, or that do not name it.
NAMED = ("key", "Key:", "auth", "Authorization:", "Bearer", "bearer", "credential", "credentials:", "login", "signed", "pin:")
UNNAMED = ("is", "with", "use", "->", "=", "id", "see")


def _drawn(rng: random.Random, alphabet: str, size: int) -> str:
    return "".join(rng.choices(alphabet, k=size))


def secret(rng: random.Random) -> str:
    """A random key of some alphabet and length, perhaps with a prefix or in dotted parts."""
    alphabet = rng.choice(ALPHABETS)
    form = rng.random()
    if form < 0.2:
        parts = [_drawn(rng, ALPHABETS[2], rng.randint(16, 90)) for _ in range(rng.randint(2, 3))]
        return ".".join(parts)
    # Lengths spread evenly on a logarithmic scale.
    word = _drawn(rng, alphabet, int(16 * 6 ** rng.random()))
    if form < 0.5:
        joint = rng.choice("_-")
        heads = [_drawn(rng, string.ascii_lowercase, rng.randint(2, 6)) for _ in range(rng.randint(1, 2))]
        word = joint.join([*heads, word])
    return word + rng.choice(("", "", "", "=", "==")) if alphabet is ALPHABETS[1] else word


def with_secret(rng: random.Random) -> tuple[list[str], str]:
    """Words that lead to a secret, perhaps none, and the secret, perhaps quoted or before a stop."""
    lead: list[str] = []
    if rng.random() < 0.6:
        lead = [rng.choice(NAMED if rng.random() < 0.6 else UNNAMED)]
    word = secret(rng)
    frame = rng.random()
    return lead, f'"{word}"' if frame < 0.2 else f"'{word}'" if frame < 0.3 else word + "." if frame < 0.4 else word


def lure(rng: random.Random, words: list[str]) -> str:
    """A word that is no secret but has digits, signs or capitals; built of the given words."""

    def some() -> str:
        return rng.choice(words)

    def digits(least: int, most: int) -> str:
        return _drawn(rng, string.digits, rng.randint(least, most))

    joined = [some() for _ in range(rng.randint(2, 5))]
    made = (
        lambda: f"https://www.{some()}.com/" + "/".join(joined) + rng.choice(("", f"?id={digits(1, 6)}", ".html")),
        lambda: f"http://{some()}.org/{some()}-{digits(1, 8)}",
        lambda: "/".join(["", *joined]) + rng.choice(("", ".py", ".txt", "/")),
        lambda: "_".join(joined),
        lambda: "-".join(joined),
        lambda: ".".join(joined) + rng.choice(("", "()", "();")),
        lambda: joined[0] + "".join(w.capitalize() for w in joined[1:]),
        lambda: "".join(w.capitalize() for w in joined) + rng.choice(("", digits(1, 3))),
        lambda: "_".join(w.upper() for w in joined),
        lambda: "".join(joined).upper(),
        lambda: f"{some()}.{digits(1, 4)}@{some()}{digits(0, 2)}.example.com",
        lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        lambda: f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}" + rng.choice(("", f"T{digits(2, 2)}:{digits(2, 2)}:{digits(2, 2)}Z")),
        lambda: f"v{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}" + rng.choice(("", "-rc1", "-beta2", "+build" + digits(1, 4))),
        lambda: ".".join(digits(1, 3) for _ in range(4)),
        lambda: digits(1, 20),
        lambda: f"{digits(3, 3)}-{digits(4, 4)}",
        lambda: "-".join(digits(4, 4) for _ in range(4)),
        lambda: f"+{digits(2, 2)}-{digits(3, 4)}-{digits(6, 8)}",
        lambda: f"{_drawn(rng, string.ascii_uppercase, rng.randint(2, 4))}-{digits(3, 7)}",
        lambda: f"IMG_{digits(8, 8)}_{digits(6, 6)}.jpg",
        lambda: f"10.{digits(4, 4)}/{some()}.{digits(4, 6)}",
        lambda: ":".join(_drawn(rng, string.hexdigits[:16], 2) for _ in range(6)),
        lambda: _drawn(rng, string.hexdigits[:16], rng.randint(6, 12)),
        lambda: some() + rng.choice("#*$%&!=~") * rng.randint(2, 9),
        lambda: some() + digits(1, 4),
        lambda: f"{some()}={some()}",
        lambda: f"{some()}:{digits(1, 5)}",
    )
    return rng.choice(made)()
