"""Labelled findings that the secret scanner learns from where no reviewed ones are given.

The tables hold no reviewed secrets, so findings are drawn from a seed: values of the
KEYS and PASSWORDS kinds in contexts where people put secrets, and look-alikes (digests,
identifiers, paths, inline data, placeholders, numbers, plain words) in contexts of
their own. What stands around is filled up with ordinary words. Labels follow from how a
finding was made, not from any pattern that the scanner's features test.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

HEX, UPPER, DIGITS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LOWER = UPPER.lower()
ANY = UPPER + LOWER + DIGITS


@dataclass(frozen=True)
class Finding:
    kind: str
    context: str
    value: str
    before: str
    after: str
    label: int


def _run(rng: random.Random, chars: str, *sizes: int) -> str:
    return "".join(rng.choices(chars, k=rng.choice(sizes)))


def _uuid(rng: random.Random) -> str:
    return "-".join(_run(rng, HEX, n) for n in (8, 4, 4, 4, 12))


def _password(rng: random.Random, words: Sequence[str]) -> str:
    made = [_run(rng, ANY, 8, 10, 12, 16), rng.choice(words).capitalize() + _run(rng, DIGITS, 2, 4) + rng.choice("!#%*+"), _run(rng, LOWER + DIGITS, 8, 9, 12) + rng.choice("!7")]
    value = rng.choice(made)
    return value if any(c.isdigit() for c in value) else value + _run(rng, DIGITS, 2)


#: Values of secrets, by kind.
KEYS = {
    "hex": lambda r, w: _run(r, HEX, 16, 18, 24, 32, 40, 64),
    "mixed": lambda r, w: _run(r, ANY, 20, 24, 32, 40, 48),
    "base64": lambda r, w: _run(r, ANY + "+/", 32, 40, 64) + r.choice(["", "=", "=="]),
    "prefixed": lambda r, w: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "npm_", "key-"]) + _run(r, ANY, 20, 24, 36),
    "access_id": lambda r, w: r.choice(["AKIA", "ASIA"]) + _run(r, UPPER + DIGITS, 16),
}
PASSWORDS = {"password": _password}
#: Contexts of secrets: {} is where the value stands.
KEY_CONTEXTS = (
    'token = "{}"', "token: {}", "api_key = '{}'", "apiKey: \"{}\"", "export API_TOKEN={}", "export AWS_SECRET_ACCESS_KEY={}", "?access_token={}&x=1", "&key={} ", '"client_secret": "{}",',
    "secret={}", "private_key: {}", "auth_token={}", "credential = {}", "Authorization: Bearer {}", "X-Api-Key: {}", "MY_SERVICE_SECRET={}", "password={}", 'db_password: "{}"', "passwd = {}",
    "api key {}", "secret key: {}", "the token is {}", "--secret {}", "access token {}", "--key={}",
)
PASSWORD_CONTEXTS = ('password: "{}"', "password={}", "passwd: {}", "pwd = '{}'", 'db_password = "{}"', "user=admin password={}", "secret: {}", 'MYSQL_PASSWORD="{}"', "password is: {}")
#: Keys that tell by themselves, without a name before them, in any text.
BARE_KINDS = ("access_id", "prefixed", "mixed")
BARE_CONTEXTS = ("{}", "{}", "{}", "{},", "({})", '"{}"', "of {} and", "the {}", 'sign in with "{}"', "use {} to connect", 'login("{}")', "connect with {}", 'header "{}"')
#: Contexts never learnt from, for measuring: names and forms that training doesn't hold.
NEW_KEY_CONTEXTS = ('signing_secret = "{}"', "--api-token {}", "SENTRY_AUTH_TOKEN={}", "accessKey: '{}'", "oauth token {}", "webhook_secret: {}")
NEW_PASSWORD_CONTEXTS = ('smtp_password: "{}"', "DB_PASSWD={}", "root password = {}")

#: Look-alikes: values and their contexts, by kind.
LOOK_ALIKES = {
    "digest": (lambda r, w: _run(r, HEX, 32, 40, 64), ("commit {}", "sha256:{}", "md5 {}", 'etag: "{}"', "checksum = {}", "digest: {}", "revision {}", "image@sha256:{}", 'integrity="sha384-{}"', "tree {}", "merge {} into", "hash {}", "{}", "({})", "of {} and", "the {}")),
    "uuid": (lambda r, w: _uuid(r), ("request {}", "id: {}", "trace id {}", 'uuid="{}"', "job {}", "device {}", "{}", "({})", '"{}"', "the {}")),
    "address": (lambda r, w: _run(r, HEX, 16, 32, 40), ("https://example.com/a/{}/index", "https://cdn.example.org/{}.js", "/static/app.{}.css", "http://host.example.net/img/{}", "/cache/{}/data")),
    "path": (lambda r, w: "/".join(r.choice(w) for _ in range(r.choice([3, 4, 5]))), ("/usr/{}", "path=/{}", "/home/{}", "import {}", "see {}", "./{}")),
    "identifier": (lambda r, w: r.choice(["_", "-"]).join(r.choice(w) for _ in range(r.choice([3, 4, 5]))), ("def {}", "class {}", "token = {}", "call {}", "password = {}", 'id="{}"', "the {}")),
    "camel": (lambda r, w: "".join(r.choice(w).capitalize() for _ in range(r.choice([3, 4, 5]))), ("new {}", "token = get{}", "import {}", "secret: {}", "the {}", "method {}")),
    "inline": (lambda r, w: r.choice(["iVBORw0KGgo", "R0lGODlh", "PHN2ZyB4"]) + _run(r, ANY + "+/", 40, 64), ("data:image/png;base64,{}", "data:image/gif;base64,{}", "url(data:image/svg+xml;base64,{}")),
    "placeholder": (lambda r, w: r.choice(["xxxxxxxxxxxxxxxxxxxx", "0000000000000000", "your-token-goes-here", "your_api_key_here", "changeme-changeme", "insert-your-password", "EXAMPLE_EXAMPLE_EXAMPLE", "****************"]), ('token = "{}"', "password={}", "api_key: {}", "secret = '{}'", "export API_TOKEN={}")),
    "number": (lambda r, w: _run(r, DIGITS, 16, 17, 18, 20), ("order {}", "account {}", "number: {}", "isbn {}", "invoice = {}", "timestamp {}", "{}", "of {} and")),
    "word": (lambda r, w: "".join(r.choice(w) for _ in range(r.choice([3, 4, 5, 6]))), ("the {}", "in {} of", "und {}", "{}", "of {} and", "de {}")),
    "setting": (lambda r, w: r.choice(w) + r.choice(w), ("password: {}", "token = {}", "secret = {}", "auth: {}")),
}
#: Contexts of look-alikes never learnt from, for measuring.
NEW_LOOK_ALIKES = {
    "digest": ("parent {}", "sha1={}", "content hash {}", "blob {}"), "uuid": ("guid {}", "correlation: {}"), "address": ("http://files.example.net/p/{}?q=1", "src=/img/{}.png"),
    "identifier": ("function {}", "var {}", "secret = {}"), "camel": ("extends {}", "password = {}"), "number": ("serial {}", "ref: {}"), "setting": ("api_token: {}", "smtp_password = {}"),
    "placeholder": ('client_secret: "{}"', "DB_PASSWORD={}"), "path": ("open {}", "/var/{}"),
}
#: Words that fill up contexts and make look-alikes where a corpus has given none.
PLAIN = "the of and to in is that for it with as was on be by not this are from at you have they which one all were we when there can an your more if will each about how up out them then many some so these would other into has".split()


def _placed(rng: random.Random, kind: str, context: str, value: str, words: Sequence[str], label: int) -> Finding:
    fill = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 6])))
    left, right = context.split("{}")
    before, after = f"{fill()} {left}"[-48:], f"{right} {fill()}"[:48]
    return Finding(kind, context, value, before, after, label)


def _contexts() -> list[str]:
    every = [*KEY_CONTEXTS, *PASSWORD_CONTEXTS, *BARE_CONTEXTS, *NEW_KEY_CONTEXTS, *NEW_PASSWORD_CONTEXTS]
    return every + [c for k, (_, contexts) in LOOK_ALIKES.items() if k != "word" for c in (*contexts, *NEW_LOOK_ALIKES.get(k, ()))]


def drawn(n: int, words: Sequence[str] = (), long_words: Sequence[str] = (), seed: int = 11, unseen: bool = False) -> Iterator[Finding]:
    """``n`` findings of each label.

    ``words`` are ordinary words of the corpus, ``long_words`` such as are long enough to be
    candidates; both are negative findings too. ``unseen`` draws from the
    contexts kept for measuring.
    """
    rng = random.Random(seed)
    # Words of the contexts aren't ordinary, however common they are in the corpus, function words apart.
    telling = {w for c in _contexts() for w in re.findall("[a-z]+", c.lower())} - set(PLAIN)
    plain = [w for w in words if len(w) > 1 and w not in telling] or PLAIN
    keys, passwords = (NEW_KEY_CONTEXTS, NEW_PASSWORD_CONTEXTS) if unseen else (KEY_CONTEXTS, PASSWORD_CONTEXTS)
    for i in range(n):
        part = i % 10
        if part < 5:
            kind = list(KEYS)[i // 10 % len(KEYS)]
            yield _placed(rng, kind, rng.choice(keys), KEYS[kind](rng, plain), plain, 1)
        elif part < 7:
            yield _placed(rng, "password", rng.choice(passwords), _password(rng, plain), plain, 1)
        else:
            kind = BARE_KINDS[i % len(BARE_KINDS)]
            yield _placed(rng, kind, rng.choice(BARE_CONTEXTS), KEYS[kind](rng, plain), plain, 1)
    kinds = list(LOOK_ALIKES)
    for i in range(n):
        if long_words and i % 4 == 0:
            yield _placed(rng, "word", rng.choice(LOOK_ALIKES["word"][1]), rng.choice(long_words), plain, 0)
            continue
        kind = kinds[i % len(kinds)]
        value, contexts = LOOK_ALIKES[kind]
        contexts = NEW_LOOK_ALIKES.get(kind, contexts) if unseen else contexts
        yield _placed(rng, kind, rng.choice(contexts), value(rng, plain), plain, 0)
