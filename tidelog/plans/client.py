"""A client's typed calls over a store in the same process."""

from __future__ import annotations

from ..sources.store import VersionStore
from .protocol import Reply, Session


class Client:
    """execute() gives the reply; the named calls give its value and raise ValueError on an error reply."""

    def __init__(self, store: VersionStore):
        self.session = Session(store)

    def execute(self, name: str, *args) -> Reply:
        return self.session.execute(name, *map(str, args))

    def _value(self, name: str, *args, whole=False, many=False):
        reply = self.execute(name, *args)
        if not reply.ok:
            raise ValueError(reply.lines[0])
        return reply.lines if many else int(reply.lines[0]) if whole else reply.first


def _call(name: str, **kind):
    def call(self, *args):
        return self._value(name, *args, **kind)

    call.__name__, call.__doc__ = name, f"The command {name.upper()}."
    return call


#: The calls by what they give back: a text or None, a number, or all lines.
for _name in ("set", "get", "lpop", "rpop", "hget", "ping", "echo", "mset"):
    setattr(Client, _name, _call(_name))
for _name in ("delete", "exists", "lpush", "rpush", "llen", "sadd", "srem", "sismember", "scard", "hset", "hdel", "hexists", "hlen", "incr", "decr"):
    setattr(Client, _name, _call("del" if _name == "delete" else _name, whole=True))
for _name in ("lrange", "smembers", "hgetall", "mget", "keys", "info"):
    setattr(Client, _name, _call(_name, many=True))
