"""Keyspace structures: an ordered log of operations, its folds, and reads over the folded state.

Mutations whose result does not depend on order within a key are aggregates with a map-side part (the last SET,
sums of increments, the last change of a member). The others are replayed per key in order: rows are sorted
within partitions and streamed, so that a task holds the state of one key, not its log.
"""

from __future__ import annotations

import bisect
import heapq
import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

I64 = 2**63


def visible(expires: Column, now: int) -> Column:
    """An entry is gone at the very time of its expiry."""
    return expires.isNull() | (expires > F.lit(now))


def last_write(log: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of the last operation of every key."""
    return log.groupBy(*keys).agg(*[F.max_by(F.col(v), F.col(order)).alias(v) for v in values])


def counters(log: DataFrame, key: str, delta: str, order: str | None = None) -> DataFrame:
    """Sums of increments; an error where one leaves 64 bits: the total, and with ``order`` every step on the way to it.

    Steps are running sums of a key's sorted rows (which may spill); without an order, sums combine on the map side.
    """
    step = F.col(delta).cast("decimal(38,0)")
    if order is None:
        summed = log.groupBy(key).agg(F.sum(step).alias("_t"), F.sum(step).alias("_lo"), F.sum(step).alias("_hi"))
    else:
        running = F.sum(step).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        summed = log.select(key, order, step.alias("_d"), running.alias("_run")).groupBy(key).agg(F.sum("_d").alias("_t"), F.min("_run").alias("_lo"), F.max("_run").alias("_hi"))
    inside = (F.col("_lo") >= F.lit(-I64)) & (F.col("_hi") <= F.lit(I64 - 1))
    checked = F.when(inside, F.col("_t").cast("bigint")).otherwise(F.raise_error(F.lit("counter overflow")).cast("bigint"))
    return summed.select(key, checked.alias("value"))


def due(df: DataFrame, expires: str, now: int, order: list[str], limit: int) -> DataFrame:
    """The entries that a sweep of at most ``limit`` removes at a time: the longest expired first, ties by key."""
    return df.filter(F.col(expires).isNotNull() & (F.col(expires) <= F.lit(now))).orderBy(expires, *order).limit(limit)


def sweep(df: DataFrame, expires: str, now: int, keys: list[str], limit: int) -> DataFrame:
    """The entries that are left after one sweep."""
    return df.join(due(df, expires, now, keys, limit).select(*keys), keys, "left_anti")


def ttl(df: DataFrame, expires: str, now: int) -> DataFrame:
    """``state`` (missing, persistent or remaining) and ``remaining`` microseconds."""
    e = F.col(expires)
    state = F.when(e.isNull(), "persistent").when(e > F.lit(now), "remaining").otherwise("missing")
    return df.withColumn("state", state).withColumn("remaining", F.when(e > F.lit(now), e - F.lit(now)))


def getrange(value: Column, start: int, end: int) -> Column:
    """Bytes start..end of a text or binary value, both inclusive, negative from the end, clamped: BINARY, for a cut may fall inside a character."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    a = F.greatest(F.lit(0), F.when(F.lit(start) < 0, n + start).otherwise(F.lit(start)))
    b = F.least(n - 1, F.when(F.lit(end) < 0, n + end).otherwise(F.lit(end)))
    return F.when(a <= b, F.substring(raw, a + 1, b - a + 1)).otherwise(F.when(value.isNotNull(), F.lit(b"")))


def lrange(items: Column, start: int, end: int) -> Column:
    """Elements start..end of an array, both inclusive, negative from the end, clamped."""
    n = F.size(items)
    a = F.greatest(F.lit(0), F.when(F.lit(start) < 0, n + start).otherwise(F.lit(start)))
    b = F.least(n - 1, F.when(F.lit(end) < 0, n + end).otherwise(F.lit(end)))
    return F.when((a <= b) & (n > 0), F.slice(items, a + 1, F.greatest(b - a + 1, F.lit(0)))).otherwise(F.slice(items, 1, 0))


def static_list(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Lists of pushed values in order of push. A list is one value; its size is the size of the structure read."""
    return log.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))


def scan(df: DataFrame, order: list[str], after: list | None, limit: int, reverse: bool = False) -> DataFrame:
    """Members in byte order, strictly after the cursor."""
    from .relational import page

    return page(df, order, after, limit, reverse)


def scan_match(df: DataFrame, order: list[str], member: str, pattern: bytes, after: list | None, output: int, visits: int, expires: str | None = None, now: int = 0) -> DataFrame:
    """Members that match a byte glob, of at most ``visits`` visited after the cursor; ``last`` marks the last visited one.

    The continuation is the row marked ``last`` (matching or not), and there is none once all are visited. An expired member costs
    a visit and is no match. A pattern without wildcards is a point read. Names are compared byte by byte, each as a Latin-1 character.
    """
    from ..functions.text import glob_regex

    if not set(pattern) & set(b"*?[\\"):
        hit = df.filter(F.col(member).cast("binary") == F.lit(pattern))
        hit = hit if expires is None else hit.filter(visible(F.col(expires), now))
        return hit.withColumn("last", F.lit(False)).withColumn("match", F.lit(True))
    seen = scan(df, order, after, visits + 1)
    n = F.row_number().over(Window.orderBy(*order))
    rows = seen.withColumn("_n", n)
    more = F.count("*").over(Window.partitionBy(F.lit(1))) > visits
    found = F.decode(F.col(member).cast("binary"), "ISO-8859-1").rlike("(?s)^" + glob_regex(pattern).pattern.decode("latin-1").replace("\\Z", "\\z"))
    found = found if expires is None else found & visible(F.col(expires), now)
    marked = rows.withColumn("last", more & (F.col("_n") == visits)).filter(F.col("_n") <= visits).withColumn("match", found)
    kept = marked.withColumn("_m", F.sum(F.col("match").cast("int")).over(Window.orderBy("_n")))
    return kept.filter((F.col("match") & (F.col("_m") <= output)) | F.col("last")).drop("_n", "_m")


def hash_get(fields: DataFrame, keys: list[str], field: str, value: str, wanted: list[str]) -> DataFrame:
    """``keys, pos, field, value`` of the wanted fields of each hash, in the order and as often as they are asked for; null where there is none."""
    hashes = fields.select(*keys).distinct()
    asked = hashes.select(*keys, F.posexplode(F.array(*[F.lit(w) for w in wanted])).alias("pos", field))
    return asked.join(fields.select(*keys, field, value), [*keys, field], "left").select(*keys, "pos", field, value)


def ranked(df: DataFrame, key: str, score: str, member: str, reverse: bool = False) -> DataFrame:
    """``rank``, from 0, by score then member."""
    order = [F.desc(score), F.desc(member)] if reverse else [F.col(score), F.col(member)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def zrange(df: DataFrame, key: str, score: str, member: str, start: int, end: int, reverse: bool = False) -> DataFrame:
    """Members of rank start..end, both inclusive, negative from the end. Non-negative bounds prune before the shuffle."""
    r = ranked(df, key, score, member, reverse)
    if start >= 0 and end >= 0:
        return r.filter((F.col("rank") <= end) & (F.col("rank") >= start))
    n = r.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    lo = F.lit(start) if start >= 0 else F.col("_n") + start
    hi = F.lit(end) if end >= 0 else F.col("_n") + end
    return n.filter((F.col("rank") >= lo) & (F.col("rank") <= hi)).drop("_n")


def zrange_by_score(df: DataFrame, score: str, member: str, low: float | None, high: float | None, inclusive: tuple[bool, bool] = (True, True), offset: int = 0, limit: int = 100, reverse: bool = False) -> DataFrame:
    c = F.col(score)
    if low is not None:
        df = df.filter(c >= low if inclusive[0] else c > low)
    if high is not None:
        df = df.filter(c <= high if inclusive[1] else c < high)
    order = [F.desc(score), F.desc(member)] if reverse else [F.col(score), F.col(member)]
    return df.orderBy(*order).offset(offset).limit(limit)


def splitmix64(seed: int) -> int:
    m = 2**64 - 1
    z = (seed + 0x9E3779B97F4A7C15) & m
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
    return z ^ (z >> 31)


def srandmember(df: DataFrame, key: str, member: str, seed: int, count: int) -> DataFrame:
    """Members from a seeded rank on, in byte order, wrapping once; ``count`` 1 is the member that SPOP takes."""
    w = Window.partitionBy(key)
    rows = df.select(key, member).distinct().withColumn("_r", F.row_number().over(w.orderBy(member)) - 1).withColumn("_n", F.count("*").over(w))
    start = F.lit(str(splitmix64(seed))).cast("decimal(20,0)") % F.col("_n")
    at = F.pmod(F.col("_r") - start.cast("bigint"), F.col("_n"))
    return rows.filter(at < count).select(key, member, at.cast("int").alias("pos"))


def xadd(log: DataFrame, key: str, order: str) -> DataFrame:
    """``id`` of each appended entry, from 1 per stream."""
    return log.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy(order)))


# The families of structures, and the operations of each.
FAMILIES = {
    "string": "set setnx setxx get getrange append setrange incrby",
    "hash": "hset hsetnx hget hdel hlen hincrby hexpire httl hmset hmget hmdel",
    "list": "lpush rpush lpop rpop llen lrange",
    "set": "sadd srem sismember smismember scard spop srandmember",
    "zset": "zadd zrem zincrby zpopmin zpopmax zscore zcard zrank zrevrank",
    "stream": "xadd xlen",
}
_FAMILY = {op: family for family, ops in FAMILIES.items() for op in ops.split()}


def replay(log: DataFrame, now_column: str = "at") -> DataFrame:
    """Replays ``key, seq, op, arg, value, at`` and gives ``key, seq, changed, result`` of every operation.

    Operations: those of ``FAMILIES``, and create and drop (arg = family), del, expire (value = time) and ttl. ``arg`` is the
    field, member, offset or range ('start:end'), ``value`` the text, number, time or seed; hm... and smismember take JSON arrays. ``at`` is the
    logical time. Every family but strings is created before use: an operation on a key that is not there answers 'missing', one on a
    key of another family 'wrongtype', and a number that is none or leaves its range an error text; none of them changes anything.
    Texts are bytes: lengths and offsets count those. A null key is an error of the log and is left out.

    The order of a key's operations is sequential by nature: its rows are sorted, and may spill, and one task holds its state, not its log.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Key()
        for frame in frames:
            out = []
            for k, seq, op, arg, value, at in frame.itertuples(index=False):
                if k != key:
                    key, state = k, Key()
                changed, result = state.apply(op, None if pd.isna(arg) else arg, None if pd.isna(value) else value, int(at))
                out.append((k, seq, changed, result))
            yield pd.DataFrame(out, columns=["key", "seq", "changed", "result"])

    columns = log.select("key", "seq", "op", "arg", "value", F.coalesce(F.col(now_column), F.lit(0)).alias("at")).filter("key is not null")
    return columns.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, "key string, seq bigint, changed boolean, result string")


Answer = tuple[bool, str | None]


def _whole(text: str | bytes | None) -> int | None:
    """A canonical decimal of 64 bits, or null."""
    try:
        n = int(text or 0)
    except ValueError:
        return None
    written = text.decode() if isinstance(text, bytes) else text
    return n if -I64 <= n < I64 and (not written or str(n) == written) else None


def _span(n: int, start: int, end: int) -> range:
    """Places start..end of n, both inclusive, negative from the end, clamped."""
    a, b = (x + n if x < 0 else x for x in (start, end))
    return range(max(0, a), min(n - 1, b) + 1)


class _Last:
    """Orders the other way round, for a heap of the greatest."""

    def __init__(self, v: tuple[float, bytes]) -> None:
        self.v = v

    def __lt__(self, other: _Last) -> bool:
        return other.v < self.v


class Scores:
    """A sorted set: scores by member, and heaps in which outdated entries are passed over when they come up."""

    def __init__(self) -> None:
        self.of: dict[str, float] = {}
        self.low: list[tuple[float, bytes]] = []
        self.high: list[_Last] = []

    def put(self, member: str, score: float) -> None:
        self.of[member] = score
        entry = (score, member.encode())
        heapq.heappush(self.low, entry)
        heapq.heappush(self.high, _Last(entry))

    def pop(self, least: bool) -> tuple[str, float] | None:
        while self.of:
            score, name = heapq.heappop(self.low) if least else heapq.heappop(self.high).v
            member = name.decode()
            if self.of.get(member) == score:
                return member, self.of.pop(member)
        return None

    def rank(self, member: str) -> int:
        own = (self.of[member], member.encode())
        return sum((s, m.encode()) < own for m, s in self.of.items())


class Key:
    """The state of one key."""

    def __init__(self) -> None:
        self.family, self.value, self.expires = None, None, None
        self.due: dict[str, int] = {}

    def apply(self, op: str, arg: str | None, value: str | None, now: int) -> Answer:
        if self.family and self.expires is not None and self.expires <= now:
            self.__init__()
        if op in ("del", "drop"):
            there = self.family is not None and op == "del" or self.family == arg is not None
            if there:
                self.__init__()
            return there, None
        if op == "create":
            if self.family or arg not in FAMILIES or arg == "string":
                return False, "wrongtype" if self.family not in (None, arg) else None
            self.family = arg
            self.value = {"hash": dict, "list": deque, "set": list, "zset": Scores, "stream": list}[arg]()
            return True, None
        if op == "expire":
            if self.family is None:
                return False, None
            self.expires = int(value)
            return True, None
        if op == "ttl":
            return False, "missing" if self.family is None else self._left(self.expires, now)
        family = _FAMILY[op]
        if self.family not in (None, family) and op != "set":
            return False, "wrongtype"
        if self.family is None and family != "string":
            return False, "missing"
        return getattr(self, "_" + family)(op, arg, value, now)

    @staticmethod
    def _left(expires: int | None, now: int) -> str:
        return "persistent" if expires is None else str(expires - now)

    def _string(self, op: str, arg: str | None, value: str | None, now: int) -> Answer:
        there, raw = self.family == "string", (value or "").encode()
        if op == "get":
            return False, self.value.decode("utf-8", "replace") if there else None
        if op == "getrange":
            a, b = map(int, arg.split(":"))
            places = _span(len(self.value), a, b) if there else range(0)
            return False, self.value[places.start : places.stop].decode("utf-8", "replace") if there else None
        if op in ("set", "setnx", "setxx"):
            if op != "set" and there == (op == "setnx"):
                return False, None
            self.family, self.value, self.expires = "string", raw, None
            return True, None
        old = self.value if there else b""
        if op == "append":
            new = old + raw
        elif op == "setrange":
            at = int(arg)
            padded = old.ljust(at, b"\0")
            new = padded[:at] + raw + padded[at + len(raw) :]
        else:
            held, step = _whole(old), _whole(value)
            if held is None or step is None:
                return False, "not an integer"
            if not -I64 <= held + step < I64:
                return False, "overflow"
            new = str(held + step).encode()
        if len(new) > 8 << 20:
            return False, "too long"
        self.family, self.value = "string", new
        return True, new.decode() if op == "incrby" else str(len(new))

    def _list(self, op: str, arg: str | None, value: str | None, now: int) -> Answer:
        items = self.value
        if op == "llen":
            return False, str(len(items))
        if op == "lrange":
            places = _span(len(items), *map(int, arg.split(":")))
            return False, json.dumps([items[i] for i in places], ensure_ascii=False)
        if op.endswith("push"):
            (items.appendleft if op[0] == "l" else items.append)(value)
            return True, str(len(items))
        if not items:
            return False, None
        return True, items.popleft() if op[0] == "l" else items.pop()

    def _field(self, name: str, now: int) -> str | None:
        """The value of a live field; an expired one goes when it is met."""
        if self.due.get(name, now + 1) <= now:
            del self.due[name]
            self.value.pop(name, None)
        return self.value.get(name)

    def _put(self, name: str, value: str | None) -> None:
        self.due.pop(name, None)
        self.value[name] = value

    def _hash(self, op: str, arg: str | None, value: str | None, now: int) -> Answer:
        if op == "hlen":
            return False, str(sum(self.due.get(f, now + 1) > now for f in self.value))
        if op in ("hmset", "hmget", "hmdel"):
            names = json.loads(arg)
            if op == "hmget":
                return False, json.dumps([self._field(f, now) for f in names], ensure_ascii=False)
            if len(set(names)) < len(names):
                return False, "duplicate field"
            for f in names:
                self._field(f, now)
            there = sum(f in self.value for f in names)
            for i, f in enumerate(names):
                if op == "hmset":
                    self._put(f, json.loads(value)[i])
                else:
                    self.value.pop(f, None)
                    self.due.pop(f, None)
            return (True, str(len(names) - there)) if op == "hmset" else (there > 0, str(there))
        held = self._field(arg, now)
        there = arg in self.value
        if op == "hget":
            return False, held
        if op == "httl":
            return False, self._left(self.due.get(arg), now) if there else "missing"
        if op == "hexpire":
            if there:
                self.due[arg] = int(value)
            return there, None
        if op == "hdel":
            self.due.pop(arg, None)
            self.value.pop(arg, None)
            return there, None
        if op == "hsetnx" and there:
            return False, None
        if op == "hincrby":
            base, step = _whole(held), _whole(value)
            if base is None or step is None:
                return False, "not an integer"
            if not -I64 <= base + step < I64:
                return False, "overflow"
            value = str(base + step)
        self._put(arg, value)
        return True, value if op == "hincrby" else str(int(not there)) if op == "hset" else None

    def _set(self, op: str, arg: str | None, value: str | None, now: int) -> Answer:
        """Members are kept as a list of bytes in order, so that a rank is a place."""
        members = self.value
        if op == "scard":
            return False, str(len(members))
        if op in ("spop", "srandmember"):
            if not members:
                return False, None if op == "spop" else "[]"
            first = splitmix64(int(value)) % len(members)
            if op == "spop":
                return True, members.pop(first).decode()
            count = min(int(arg), len(members))
            return False, json.dumps([members[(first + i) % len(members)].decode() for i in range(count)], ensure_ascii=False)
        if op == "smismember":
            held = set(members)
            return False, json.dumps([int(m.encode() in held) for m in json.loads(value)])
        raw = value.encode()
        at = bisect.bisect_left(members, raw)
        there = at < len(members) and members[at] == raw
        if op == "sismember":
            return False, str(int(there))
        if there == (op == "sadd"):
            return False, None
        if op == "sadd":
            members.insert(at, raw)
        else:
            del members[at]
        return True, None

    def _zset(self, op: str, arg: str | None, value: str | None, now: int) -> Answer:
        scores: Scores = self.value
        held = scores.of.get(arg)
        if op == "zcard":
            return False, str(len(scores.of))
        if op == "zscore":
            return False, None if held is None else repr(held)
        if op in ("zrank", "zrevrank"):
            rank = None if held is None else scores.rank(arg)
            return False, None if rank is None else str(rank if op == "zrank" else len(scores.of) - 1 - rank)
        if op == "zrem":
            return scores.of.pop(arg, None) is not None, None
        if op in ("zadd", "zincrby"):
            score = float(value) + (held or 0.0 if op == "zincrby" else 0.0)
            if score != score or (op == "zincrby" and score in (float("inf"), float("-inf"))):
                return False, "not a number"
            if held != score:
                scores.put(arg, score + 0.0)
            return held != score, repr(score + 0.0) if op == "zincrby" else None
        got = scores.pop(op == "zpopmin")
        return (True, f"{got[0]}={got[1]!r}") if got else (False, None)

    def _stream(self, op: str, arg: str | None, value: str | None, now: int) -> Answer:
        """Entries count from 1; the fields of one (a JSON array) are at least one, each once."""
        if op == "xlen":
            return False, str(len(self.value))
        names = json.loads(arg or "[]")
        if not names or len(set(names)) < len(names):
            return False, "duplicate field" if names else "no field"
        self.value.append((names, value))
        return True, str(len(self.value))
