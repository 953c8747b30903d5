"""Commands as a shell gives them: JSON results and exit codes (0 done, 2 wrong use, 1 failed)."""

from __future__ import annotations

import json

from ..functions.codec import TAGS
from ..operators import reads
from ..sources.store import VersionStore
from .protocol import NIL, Session, Usage, _whole, tokenize

#: The commands that work as in the protocol, by least arguments, and those of this form alone.
SHARED = {"lpush": 2, "rpush": 2, "lpop": 1, "rpop": 1, "llen": 1, "lrange": 3, "sadd": 2, "srem": 2, "smembers": 1, "sismember": 2, "scard": 1, "hset": 3, "hget": 2, "hdel": 2, "hexists": 2, "hlen": 1, "hgetall": 1}
OWN = {"put": 2, "ttl-put": 3, "get": 1, "delete": 1, "scan": 2, "prefix": 1, "stats": 0, "sst-dump": 0, "recover": 0, "compact": 0, "trace-key": 1, "wal-tail": 0, "sst-inspect": 0, "manifest-inspect": 0}
INTERACTIVE = ("repl", "connect", "shell")


def help_text(topic: str | None = None) -> str:
    named = {n: f"{n} ({k} arguments or more)" for n, k in sorted((OWN | SHARED).items())}
    return named.get(topic or "", "\n".join(named.values()))


class Shell:
    def __init__(self, store: VersionStore, session: Session | None = None):
        self.store, self.session = store, session or Session(store)

    def run(self, *args: str) -> tuple[int, str]:
        """Exit code and output."""
        args = list(args)
        as_json = args[:1] == ["--json"]
        args = args[as_json:]
        if not args or args[0].lower() == "help":
            return 0, help_text(args[1] if len(args) > 1 else None)
        try:
            found = self.execute(args[0].lower(), args[1:])
        except (Usage, ValueError) as e:
            return 2, str(e)
        except (OSError, RuntimeError) as e:
            return 1, str(e)
        return 0, found if isinstance(found, str) and not as_json else json.dumps(found, ensure_ascii=False)

    def line(self, line: str) -> tuple[int, list[str]]:
        """A line of the protocol that is not a protocol command."""
        return self.words(tokenize(line))

    def words(self, words: list[str]) -> tuple[int, list[str]]:
        if words and words[0].lower() in INTERACTIVE:
            return 2, [f"{words[0].lower()} is interactive"]
        code, out = self.run(*words)
        return code, out.splitlines()

    def execute(self, name: str, args: list[str]):
        least = (OWN | SHARED).get(name)
        if least is None:
            raise Usage(f"unknown command: {name}")
        if len(args) < least or name == "hset" and len(args) % 2 == 0:
            raise Usage(f"usage: {name} needs {least} arguments or more")
        if name in SHARED:
            return self._shared(name, args)
        return getattr(self, "do_" + name.replace("-", "_"))(*args)

    def _shared(self, name, args):
        if name == "hgetall":
            return self.session._hash(args[0])
        found = getattr(self.session, "do_" + name)(*args[: {"lpop": 1, "rpop": 1, "llen": 1, "lrange": 3, "smembers": 1, "sismember": 2, "scard": 1, "hget": 2, "hexists": 2, "hlen": 1}.get(name, len(args))])
        return None if found == NIL else found

    def _pairs(self, found):
        return [{"key": k, "value": v.decode("utf-8", "replace")} for k, v in self.store.fetch(found)]  # at most the limit

    def do_put(self, key, value, *_):
        self.store.put(key, value.encode())
        return {"status": "ok", "operation": "put", "key": key}

    def do_ttl_put(self, key, value, at, *_):
        self.store.ttl_put(key, value.encode(), _whole(at))
        return {"status": "ok", "operation": "ttl-put", "key": key}

    def do_get(self, key, *_):
        value = self.store.get(key)
        if value is not None and value.decode("utf-8", "replace").startswith(tuple(TAGS.values())):
            raise Usage(reads.WRONG_TYPE)
        return {"key": key, "found": value is not None, "value": None if value is None else value.decode("utf-8", "replace")}

    def do_delete(self, key, *_):
        self.store.delete(key)
        return {"status": "ok", "operation": "delete", "key": key}

    def _limit(self, given):
        return _whole(given[0]) if given else self.store.options.scan_limit

    def do_scan(self, start, end, *limit):
        return self._pairs(self.store.scan(start, end, self._limit(limit)))

    def do_prefix(self, prefix, *limit):
        return self._pairs(self.store.prefix_scan(prefix, self._limit(limit)))

    def do_stats(self, *_):
        return {"summary": self.store.stats_text(), "stats": self.store.stats()}

    def do_sst_dump(self, *_):
        return "\n".join(self.store.sst_dump())

    def do_manifest_inspect(self, *_):
        m = self.store.manifest
        return {"nextFileId": m["nextFileId"], "lastFlushedSequence": m["lastFlushedSequence"], "fileCount": len(m["files"]), "files": m["files"]}

    def do_recover(self, *_):
        return {"dataDir": self.store.files.root, "stats": self.store.stats(), "manifest": self.do_manifest_inspect()}

    def do_compact(self, *_):
        self.store.flush()
        return {"status": "ok", "operation": "compact", "detail": "flush-triggered"}

    def do_trace_key(self, key, *_):
        value = self.store.get(key)
        near = self._pairs(self.store.scan(key, key + "~", self.store.options.scan_limit))
        return {"key": key, "found": value is not None, "value": None if value is None else value.decode("utf-8", "replace"), "nearby": near, "manifest": self.do_manifest_inspect(), "stats": self.store.stats()}

    def do_wal_tail(self, *n):
        rows = self.store.wal_tail(_whole(n[0]) if n else 20).collect()
        return [{"sequence": r["seq"], "type": r["type"], "key": r["key"], "valueSize": r["value_size"], "expireAtMillis": r["expire_at_ms"]} for r in rows]

    def do_sst_inspect(self, *_):
        return [r.asDict() for r in self.store.inspect().collect()]
