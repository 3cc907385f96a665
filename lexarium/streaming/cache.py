"""Caches with LRU eviction and time to live, replayed from a log of operations: batch and streaming."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "cache_id string, seq long, op string, key string, hit boolean, evicted string, expired boolean"


class Replay:
    """One cache. get refreshes recency but not the time to live; put of a held key begins its entry anew; expiry is seen
    on get, strictly after the time to live; clear keeps the counters."""

    def __init__(self, capacity: int, default_ttl: float, entries: list | None = None):
        self.capacity, self.default_ttl = capacity, default_ttl
        self.entries: OrderedDict[str, list] = OrderedDict((k, [created, ttl, n]) for k, created, ttl, n in entries or [])

    def state(self) -> list[tuple]:
        return [(k, *v) for k, v in self.entries.items()]

    def apply(self, now: float, op: str, key: str | None, ttl: float | None) -> tuple[bool | None, str | None, bool]:
        """(hit, evicted key, expired)."""
        if op == "clear":
            self.entries.clear()
        elif op == "delete":
            return self.entries.pop(key, None) is not None, None, False
        elif op == "get":
            entry = self.entries.get(key)
            if entry is None:
                return False, None, False
            if now - entry[0] > entry[1]:
                del self.entries[key]
                return False, None, True
            entry[2] += 1
            self.entries.move_to_end(key)
            return True, None, False
        elif op == "put":
            self.entries.pop(key, None)
            evicted = self.entries.popitem(last=False)[0] if len(self.entries) >= self.capacity else None
            self.entries[key] = [now, self.default_ttl if ttl is None else ttl, 0]
            return None, evicted, False
        return None, None, False


def _seconds(ts: pd.Timestamp) -> float:
    return ts.timestamp()


def replay(log: DataFrame, capacity: int, default_ttl: float = 3600) -> DataFrame:
    """The log (cache_id, seq, ts, op, key, ttl_seconds) with hit, evicted and expired. A cache is one sequence by nature:
    caches run in parallel, and of each only its entries are held while its log streams by in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cache = None, None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.cache_id != current:
                    current, cache = r.cache_id, Replay(capacity, default_ttl)
                ttl = None if pd.isna(r.ttl_seconds) else float(r.ttl_seconds)
                rows.append((r.cache_id, r.seq, r.op, r.key, *cache.apply(_seconds(r.ts), r.op, r.key, ttl)))
            yield pd.DataFrame(rows, columns=["cache_id", "seq", "op", "key", "hit", "evicted", "expired"])

    ordered = log.select("cache_id", "seq", "ts", "op", "key", "ttl_seconds").repartition("cache_id").sortWithinPartitions("cache_id", "seq")
    return ordered.mapInPandas(run, LOG)


def replay_stream(log: DataFrame, capacity: int, default_ttl: float = 3600) -> DataFrame:
    """The same over a streaming log: the entries of each cache are the operator's state."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        entries = list(zip(*state.get, strict=True)) if state.exists else []
        cache = Replay(capacity, default_ttl, entries)
        every = pd.concat(list(batches)).sort_values("seq")
        rows = [(r.cache_id, r.seq, r.op, r.key, *cache.apply(_seconds(r.ts), r.op, r.key, None if pd.isna(r.ttl_seconds) else float(r.ttl_seconds))) for r in every.itertuples(index=False)]
        kept = cache.state()
        state.update(tuple(list(x) for x in zip(*kept, strict=True)) if kept else ([], [], [], []))
        yield pd.DataFrame(rows, columns=["cache_id", "seq", "op", "key", "hit", "evicted", "expired"])

    return log.groupBy("cache_id").applyInPandasWithState(run, LOG, "keys array<string>, created array<double>, ttl array<double>, uses array<long>", "append", "NoTimeout")


def statistics(replayed: DataFrame) -> DataFrame:
    """Per cache: hits, misses, rate, evictions."""
    gets = lambda hit: F.count_if((F.col("op") == "get") & (F.col("hit") == hit))
    out = replayed.groupBy("cache_id").agg(gets(True).alias("hits"), gets(False).alias("misses"), F.count("evicted").alias("evictions"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))


def reuse_hits(accesses: DataFrame, capacity: int, key: str = "key", order: tuple[str, ...] = ("ts", "event_id"), chunks: int | None = None) -> DataFrame:
    """Hits of an LRU cache without expiry, every access of which leaves its key as the most recent: (seq, key, hit); seq numbers
    all accesses of the log, which is one cache's.

    The log is cut by range into chunks that are read in parallel. A chunk's last `capacity` distinct keys are all of it that a later
    one can find in the cache, so the cache at the beginning of each follows from those before.
    """
    chunks = chunks or int(accesses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = accesses.select(F.col(key).alias("key"), *order).repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    cut = cut.select(F.spark_partition_id().alias("chunk"), "key").checkpoint()
    key_type = cut.schema["key"].dataType.simpleString()

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: OrderedDict = OrderedDict()
        chunk, n = None, 0
        for batch in batches:
            for chunk, used in zip(batch["chunk"], batch["key"], strict=True):
                n += 1
                last.pop(used, None)
                last[used] = None
                if len(last) > capacity:
                    last.popitem(last=False)
        if n:
            yield pd.DataFrame({"chunk": chunk, "n": n, "place": range(len(last)), "key": list(last)}).astype({"key": object})

    # At most `capacity` rows a chunk come to the driver, one chunk at a time; what goes back is the cache at each chunk's beginning.
    found = cut.mapInPandas(tails, f"chunk int, n long, place int, key {key_type}").orderBy("chunk", "place").checkpoint()
    begin: dict[int, tuple[int, list]] = {}
    cache: OrderedDict = OrderedDict()
    seen, length = 0, 0
    for r in found.toLocalIterator():
        if r.place == 0:
            seen += length
            begin[r.chunk], length = (seen, list(cache)), r.n
        cache.pop(r.key, None)
        cache[r.key] = None
        if len(cache) > capacity:
            cache.popitem(last=False)
    shared = accesses.sparkSession.sparkContext.broadcast(begin)

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict | None = None
        at = 0
        for batch in batches:
            hits = []
            for chunk, used in zip(batch["chunk"], batch["key"], strict=True):
                if held is None:
                    at, keys = shared.value[chunk]
                    held = OrderedDict.fromkeys(keys)
                hits.append(used in held)
                held.pop(used, None)
                held[used] = None
                if len(held) > capacity:
                    held.popitem(last=False)
            yield pd.DataFrame({"seq": range(at + 1, at + 1 + len(hits)), "key": batch["key"], "hit": hits})
            at += len(hits)

    return cut.mapInPandas(replayed, f"seq long, key {key_type}, hit boolean")


def ranking(replayed: DataFrame, limit: int = 10) -> DataFrame:
    """(cache_id, key, access_count): the entries still held that were found most often since they were put, ties by key."""
    ended = replayed.filter("op = 'clear'").groupBy("cache_id").agg(F.max("seq").alias("_clear"))
    gone = replayed.filter("evicted IS NOT NULL").select("cache_id", F.col("evicted").alias("key"), "seq").unionByName(replayed.filter("op = 'delete' OR expired").select("cache_id", "key", "seq"))
    gone = gone.groupBy("cache_id", "key").agg(F.max("seq").alias("_gone"))
    puts = replayed.filter("op = 'put'").groupBy("cache_id", "key").agg(F.max("seq").alias("_put"))
    held = puts.join(gone, ["cache_id", "key"], "left").join(ended, "cache_id", "left").filter("coalesce(_gone, -1) < _put AND coalesce(_clear, -1) < _put")
    uses = replayed.filter("op = 'get' AND hit").select("cache_id", "key", "seq")
    counts = held.join(uses, ["cache_id", "key"], "left").groupBy("cache_id", "key").agg(F.count_if(F.col("seq") > F.col("_put")).alias("access_count"))
    return counts.orderBy(F.col("access_count").desc(), "cache_id", "key").limit(limit)


def read_through(requests: DataFrame, stored: DataFrame, made: Column) -> DataFrame:
    """requests (key, format, ..) with content and source: what is stored (key, format, content), else what `made` gives."""
    out = requests.join(stored.select("key", "format", F.col("content").alias("_content")), ["key", "format"], "left")
    return out.withColumns({"source": F.when(F.col("_content").isNotNull(), "cache").otherwise("made"), "content": F.coalesce("_content", made)}).drop("_content")


def warmed(uses: DataFrame, contents: DataFrame, limit: int) -> DataFrame:
    """(key, format, content) of the keys that were used most: what a cache is filled with before requests come."""
    best = uses.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "key").limit(limit)
    return contents.join(F.broadcast(best.select("key")), "key", "left_semi")


def live(entries: DataFrame, as_of: Column) -> DataFrame:
    """Entries (created_at, ttl_seconds) that haven't expired."""
    return entries.filter(F.unix_micros(as_of) - F.unix_micros("created_at") <= F.col("ttl_seconds") * 1_000_000)


def metadata(cases: DataFrame) -> DataFrame:
    """What a cache keeps beside a judgment: first judges and subjects, and sizes."""
    return cases.select("citation", F.slice("judges", 1, 3).alias("judges"), F.slice("subjects", 1, 5).alias("subjects"), F.length("text").alias("text_length"), F.octet_length("text").alias("bytes"), F.size("citations").alias("n_citations"))
