"""Commands as lines of text: splitting, dispatch over a store, and reply frames.

Each command is one small plan over the store; batches of keys are joins. Errors in use or in numbers are
replies, never exceptions. Lists, sets and hashes are read, changed and written back as one version, without
an expiry; emptied ones stay.
"""

from __future__ import annotations

import base64
import re
from typing import NamedTuple

from pyspark.sql import functions as F

from ..functions.codec import SEPARATOR, TAGS
from ..functions.codec import text as as_text
from ..operators import reads
from ..operators.writes import Batch
from ..sources.store import VersionStore

PROTOCOL = "SKSP/1.0"
NIL = "(nil)"
LONG = range(-(1 << 63), 1 << 63)


class Reply(NamedTuple):
    status: str
    code: int
    lines: list[str]

    @property
    def ok(self) -> bool:
        return self.status == "OK"

    @property
    def first(self) -> str | None:
        return None if not self.lines or self.lines[0] == NIL else self.lines[0]

    def frame(self) -> str:
        return "\r\n".join([f"{PROTOCOL} {self.status} {self.code}", str(len(self.lines)), *self.lines]) + "\r\n"


def tokenize(line: str) -> list[str]:
    """Words at white space; single and double quotes group, a backslash takes the next character as it is."""
    out, word, i = [], "", 0
    quote = ""
    while i < len(line):
        c = line[i]
        if c == "\\":
            word += line[i + 1] if i + 1 < len(line) else c
            i += 1
        elif quote:
            quote, word = ("", word) if c == quote else (quote, word + c)
        elif c in "'\"":
            quote = c
        elif c.isspace():
            out, word = ([*out, word], "") if word else (out, "")
        else:
            word += c
        i += 1
    if quote:
        raise ValueError("unterminated quoted string")
    return [*out, word] if word else out


class Usage(Exception):
    """The command was used wrongly; its text is the reply."""


def _whole(text: str) -> int:
    if not re.fullmatch(r"[+-]?[0-9]+", text) or int(text) not in LONG:
        raise Usage("value is not an integer or out of range")
    return int(text)


def _tokens(items) -> str:
    return ",".join(base64.b64encode(x.encode()).decode() for x in items)


def _untokens(payload: str) -> list[str]:
    return [base64.b64decode(x).decode("utf-8", "replace") for x in payload.split(",")] if payload else []


#: The commands and how they are used.
USAGE = """PING [message]
QUIT
ECHO <message>
SET <key> <value>
GET <key>
DEL <key> [key ...]
EXISTS <key> [key ...]
INCR <key>
DECR <key>
MSET <key> <value> [key value ...]
MGET <key> [key ...]
LPUSH <key> <value> [value ...]
RPUSH <key> <value> [value ...]
LPOP <key>
RPOP <key>
LLEN <key>
LRANGE <key> <start> <stop>
SADD <key> <member> [member ...]
SREM <key> <member> [member ...]
SMEMBERS <key>
SISMEMBER <key> <member>
SCARD <key>
HSET <key> <field> <value> [field value ...]
HGET <key> <field>
HDEL <key> <field> [field ...]
HEXISTS <key> <field>
HLEN <key>
HGETALL <key>
KEYS <pattern>
INFO
COMMAND
HELP""".splitlines()


def _arity() -> dict[str, tuple[int, int | None]]:
    """Least and most arguments of each command, read off the usage lines."""
    out = {}
    for line in USAGE:
        name, *args = re.findall(r"<[^>]*>|\[[^\]]*\]|\S+", line)
        needed = [a for a in args if a[0] == "<"]
        free = len(needed) < len(args) or name in ("ECHO", "SET", "INFO", "COMMAND", "HELP", "QUIT")
        out[name] = (len(needed), None if free else len(needed))
    return out | {"EXIT": (0, None)}


ARITY = _arity()


class Session:
    """Runs commands against a store."""

    def __init__(self, store: VersionStore):
        self.store = store

    def run(self, line: str) -> Reply:
        try:
            words = tokenize(line)
        except ValueError as e:
            return Reply("ERR", 2, [f"invalid command: {e}"])
        if not words:
            return Reply("ERR", 2, ["empty command"])
        return self.execute(*words)

    def execute(self, name: str, *args: str) -> Reply:
        if name.upper() not in ARITY:
            return self._shell(name, *args)
        name = name.upper()
        least, most = ARITY[name]
        paired = name in ("MSET", "HSET") and (len(args) - (name == "HSET")) % 2
        if len(args) < least or most is not None and len(args) > most or paired:
            return Reply("ERR", 2, ["usage: " + next(u for u in USAGE if u.split()[0] == name)])
        try:
            found = getattr(self, "do_" + name.lower())(*args)
        except (Usage, ValueError) as e:
            return Reply("ERR", 2, [str(e)])
        return Reply("OK", 0, [str(x) for x in (found if isinstance(found, list) else [found])])

    def _shell(self, *words: str) -> Reply:
        """A command that is none of the protocol's runs as one of the shell's; its output is the reply's lines."""
        from .cli import Shell

        code, lines = Shell(self.store, self).words(list(words))
        return Reply("ERR" if code else "OK", code, lines)

    # Values of keys, as text, in one join.

    def _many(self, keys) -> dict[str, str]:
        spark = self.store.spark
        wanted = spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string")
        held = reads._wanted(self.store.log(), wanted, self.store.clock())
        return {r["key"]: r["t"] for r in held.select("key", as_text(F.col("value")).alias("t")).collect()}  # at most the keys asked for

    def _put(self, pairs: dict[str, str]) -> None:
        batch = Batch()
        for key, value in pairs.items():
            batch.put(key, value.encode())
        self.store.write(batch)

    def _load(self, key: str, tag: str) -> list[str]:
        held = self._many([key]).get(key)
        if held is None:
            return []
        if not held.startswith(TAGS[tag]):
            raise Usage(reads.WRONG_TYPE)
        return _untokens(held[len(TAGS[tag]) :])

    def _save(self, key: str, tag: str, items) -> None:
        self._put({key: TAGS[tag] + _tokens(items)})

    def _hash(self, key: str) -> dict[str, str]:
        pairs = (p.partition(SEPARATOR) for p in self._load(key, "hash"))
        return {f: v for f, mark, v in pairs if f and mark}

    def _save_hash(self, key: str, fields: dict[str, str]) -> None:
        self._save(key, "hash", [f + SEPARATOR + v for f, v in fields.items()])

    def do_ping(self, *message):
        return " ".join(message) or "PONG"

    def do_quit(self, *_):
        return "bye"

    do_exit = do_quit

    def do_echo(self, *message):
        return " ".join(message)

    def do_set(self, key, *value):
        self._put({key: " ".join(value)})
        return "OK"

    def do_get(self, key):
        value = self._many([key]).get(key, NIL)
        if value.startswith(tuple(TAGS.values())):
            raise Usage(reads.WRONG_TYPE)
        return value

    def do_del(self, *keys):
        present = sorted(self._many(keys))
        batch = Batch()
        for key in present:
            batch.delete(key)
        self.store.write(batch)
        return len(present)

    def do_exists(self, *keys):
        present = self._many(keys)
        return sum(k in present for k in keys)

    def _step(self, key, by):
        value = _whole(self._many([key]).get(key, "0")) + by
        if value not in LONG:
            raise Usage("value is not an integer or out of range")
        self._put({key: str(value)})
        return value

    def do_incr(self, key):
        return self._step(key, 1)

    def do_decr(self, key):
        return self._step(key, -1)

    def do_mset(self, *pairs):
        batch = Batch()
        for key, value in zip(pairs[::2], pairs[1::2], strict=True):
            batch.put(key, value.encode())
        self.store.write(batch)
        return "OK"

    def do_mget(self, *keys):
        found = self._many(keys)
        show = lambda v: f"(error) {reads.WRONG_TYPE}" if v.startswith(tuple(TAGS.values())) else v
        return [show(found.get(k, NIL)) for k in keys]

    def do_lpush(self, key, *values):
        items = [*reversed(values), *self._load(key, "list")]
        self._save(key, "list", items)
        return len(items)

    def do_rpush(self, key, *values):
        items = [*self._load(key, "list"), *values]
        self._save(key, "list", items)
        return len(items)

    def _pop(self, key, at):
        items = self._load(key, "list")
        if not items:
            return NIL
        value = items.pop(at)
        self._save(key, "list", items)
        return value

    def do_lpop(self, key):
        return self._pop(key, 0)

    def do_rpop(self, key):
        return self._pop(key, -1)

    def do_llen(self, key):
        return len(self._load(key, "list"))

    def do_lrange(self, key, start, stop):
        items = self._load(key, "list")
        first, last = (n if n >= 0 else len(items) + n for n in (_whole(start), _whole(stop)))
        return items[max(first, 0) : last + 1] if last >= 0 else []

    def do_sadd(self, key, *members):
        held = dict.fromkeys(self._load(key, "set"))
        new = held | dict.fromkeys(members)
        self._save(key, "set", new)
        return len(new) - len(held)

    def do_srem(self, key, *members):
        held = dict.fromkeys(self._load(key, "set"))
        left = [m for m in held if m not in members]
        self._save(key, "set", left)
        return len(held) - len(left)

    def do_smembers(self, key):
        return sorted(dict.fromkeys(self._load(key, "set")), key=lambda m: m.encode("utf-16-be"))

    def do_sismember(self, key, member):
        return int(member in self._load(key, "set"))

    def do_scard(self, key):
        return len(set(self._load(key, "set")))

    def do_hset(self, key, *pairs):
        held = self._hash(key)
        new = held | dict(zip(pairs[::2], pairs[1::2], strict=True))
        self._save_hash(key, new)
        return len(new) - len(held)

    def do_hget(self, key, field):
        return self._hash(key).get(field, NIL)

    def do_hdel(self, key, *fields):
        held = self._hash(key)
        left = {f: v for f, v in held.items() if f not in fields}
        self._save_hash(key, left)
        return len(held) - len(left)

    def do_hexists(self, key, field):
        return int(field in self._hash(key))

    def do_hlen(self, key):
        return len(self._hash(key))

    def do_hgetall(self, key):
        return [x for pair in self._hash(key).items() for x in pair]

    def do_keys(self, pattern):
        return [key for key, _ in self.store.fetch(reads.keys(self.store.log(), pattern, self.store.clock()).withColumn("value", F.lit(b"")))]  # at most KEYS_LIMIT

    def do_info(self, *_):
        found = self.store.stats()
        return ["server:tidelog", f"protocol:{PROTOCOL}", *(f"{n}:{found[n]}" for n in ("writes", "reads", "deletes", "scans", "l0Files", "l1Files"))]

    def do_command(self, *_):
        return list(USAGE)

    do_help = do_command
