"""Size-aware heavy-light Jaccard join of word n-gram sets.

Light sets (few shingles) enumerate the subsets of the size that a partner must share: sets with a common subset are
candidates. Heavy sets scan inverted lists: a set's shingles are put into one order for all sets, frequent ones last, and the
set stands in the lists of the first of them, as many as a linked set can lack and one more. Two linked sets meet in the list of the first
shingle that they share, where what follows must be enough for both, and in as many more as their sizes demand: a list of a few
entries gives its pairs, and pairs with enough hits are candidates. A longer list isn't paired: read by size, it is cut into
runs wherever no set before allows a partner of the next one's size, and each run is one candidate; a pair is let off as many hits as
either set stands in such lists. The size where
subsets give way to lists is where enumeration would cost more rows.

Each task reduces long lists to their runs before they are shuffled, and lists of frequent shingles are reduced in shares first, so
that no list brings a row of each set to one task. Candidates give the families that may be linked; inside a family all pairs are
verified exactly, in bounded groups: blocks of a large family first meet a few common anchors and their own members, and
only what then stands apart from the family's largest part meets every block. Texts are read for members of families only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, discard, row_keys, small, text_of, written
from .components import components
from .exact_dedup import with_groups

#: Sets in a group of pairs, and the anchors that every block of a large family meets.
GROUP, ANCHORS = 128, 8
#: Words whose hashes a worker keeps, shingles that a task gathers before it passes them on (of list entries, which are six numbers
#: each, a quarter), and texts that it holds as strings at once.
KNOWN_WORDS, GATHERED, TEXTS = 1 << 19, 2_000_000, 1024
#: Buckets of shingles whose frequency is known (one byte each is broadcast), and shingles that may fill them; which order a clash
#: gives doesn't change the result.
LEVEL_BITS, LEVELLED = 23, 1 << 21
#: Lists of shingles that were seen 2 ** HOT_LEVEL times or more are reduced in so many shares first.
HOT_LEVEL, SHARES = 12, 64
#: Entries of a list that gives its pairs; a longer one gives its runs. Entries of one list that a task holds before it reduces them.
PAIRED, HELD = 32, 1 << 16
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the splitmix64 finaliser)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word n-grams: ASCII white space parts words, A-Z are lower-cased; fewer words than n make one shingle."""

    def __init__(self, n: int):
        self.n = n
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        size = min(self.n, len(h))
        rolled = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            rolled = mix(rolled * _MIX[3] + h[i : len(h) - size + 1 + i])
        return np.unique(rolled)


class Sizes:
    """What sizes linked sets have, for a similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.light = self._boundary()
        #: Shingles below are counted exactly: a tenth of all more than the lists of a set take.
        self.counted = np.uint64(min(10 * den, 11 * den - 10 * num) * (2**64 - 1) // (10 * den))

    def shared(self, n: int, m: int) -> int:
        """The least intersection of linked sets of n and m elements."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def most(self, n: int) -> int:
        return n * self.den // self.num

    def least(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def partner(self, n: int, rest: np.ndarray) -> np.ndarray:
        """The largest set that a set of n may be linked with if they share at most `rest` elements."""
        return rest * (self.num + self.den) // self.num - n

    def hits(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The least number of lists in which linked sets of n and m >= n elements meet.

        Of the elements they share, the k-th stands behind at most n - shared others in one set and m - shared in the other.
        """
        return -(-self.num * (n + m) // (self.num + self.den)) + m * self.num // -self.den + 1

    def subset_rows(self, n: int) -> int:
        """How many subsets a light set of n emits."""
        return sum(comb(n, t) for m in range(self.least(n), self.most(n) + 1) if (t := self.shared(n, m)) <= min(n, m))

    def _boundary(self) -> int:
        """The largest size up to which subsets are no more than the rows of lists and the shingles to verify."""
        n = 1
        while n < 64 and self.subset_rows(n + 1) <= 2 * (n + 2 - self.least(n + 1)) + n + 1:
            n += 1
        return n

    def entries(self, h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, size, largest partner, level of the shingle) of each list in which a set (sorted hashes) stands; size 0: list of a subset."""
        n, out = len(h), []
        if n and n <= self.light:
            mixed = mix(h ^ _MIX[1])
            total, values = int(mixed.sum(dtype=np.uint64)), [int(x) for x in mixed]
            for m in range(self.least(n), min(self.light, self.most(n)) + 1):
                t = self.shared(n, m)
                if t <= min(n, m):
                    salt = min(n, m) * 1000003 + max(n, m)
                    out += [(total - sum(left) & 0xFFFFFFFFFFFFFFFF) ^ (salt << 20) for left in combinations(values, n - t)]
        lists = mix(np.array(out, np.uint64)).view(np.int64)
        sizes, partners, ranks = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64), np.zeros(len(out), np.uint8)
        if n and self.most(n) > self.light:
            level = levels[(h & np.uint64((1 << LEVEL_BITS) - 1)).astype(np.int64)]
            # Counted and rare ones come first, then those that nothing is known of.
            order = np.argsort(np.where(h < self.counted, level, np.maximum(level, 1)), kind="stable")[: n - self.shared(n, self.least(n)) + 1]
            lists = np.append(lists, h[order].view(np.int64))
            sizes = np.append(sizes, np.full(len(order), n))
            partners = np.append(partners, self.partner(n, n - np.arange(len(order))))
            ranks = np.append(ranks, level[order])
        return lists, sizes, partners, ranks


def _digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits for a set."""
    d = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sets(docs: DataFrame, id_column: str, text_column: str, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, _row, _row2) of each document, and (shingle, seen): how many sets of a task hold a shingle, for all
    that are counted exactly and for others that several sets hold. The rows of either kind leave the other's columns null.

    shingle is 32 bits of the hash: a clash makes a shingle seem more frequent, which changes the order of lists only.
    """
    id_type = docs.schema[id_column].dataType
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).select("doc_id", "text", *row_keys("doc_id", "text"))

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(id_type), *[pa.int64()] * 5, pa.int32(), pa.int32()]
        names = ["doc_id", "n_shingles", "d1", "d2", "_row", "_row2", "shingle", "seen"]
        shingler, limit = Shingler(n), Sizes(num, den).counted
        gathered: list[np.ndarray] = []
        known: set[int] = set()
        held = 0

        def table(columns: dict, rows: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(rows, t) for c, t in zip(names, kinds, strict=True)], names=names)

        def counted() -> pa.RecordBatch:
            every, times = np.unique(np.concatenate(gathered) if gathered else np.zeros(0, np.uint64), return_counts=True)
            told = (times > 1) | (every < limit)
            shingle = every[told].astype(np.uint32).view(np.int32)
            return table({"shingle": pa.array(shingle), "seen": pa.array(times[told].astype(np.int32))}, len(shingle))

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = []
                for h in map(shingler, part.column(1).to_pylist()):
                    found.append((len(h), *_digest(h)))
                    if found[-1][1] not in known:
                        known.add(found[-1][1])
                        gathered.append(h)
                        held += len(h)
                sizes, d1, d2 = (pa.array(c, pa.int64()) for c in zip(*found, strict=True))
                yield table({"doc_id": part.column(0), "n_shingles": sizes, "d1": d1, "d2": d2, "_row": part.column(2), "_row2": part.column(3)}, part.num_rows)
                if held > GATHERED:
                    yield counted()
                    gathered.clear()
                    known.clear()
                    held = 0
        yield counted()

    return source.mapInArrow(sets, f"doc_id {id_type.simpleString()}, n_shingles long, d1 long, d2 long, _row long, _row2 long, shingle int, seen int")


def _levels(seen: DataFrame) -> np.ndarray:
    """The binary order of magnitude of the frequency of each bucket's most frequent shingle: 0 for rare ones, others from 2 on. One byte
    a bucket, whatever the size of the corpus: the least frequent count as rare where more than LEVELLED would be told apart."""
    counts = seen.groupBy("shingle").agg(F.sum("seen").alias("seen")).filter("seen >= 4")
    counts = written(counts.select(F.col("shingle").bitwiseAND((1 << LEVEL_BITS) - 1).alias("bucket"), F.floor(F.log2("seen")).cast("tinyint").alias("level")), "frequent")
    many, least = {r.level: r.n for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}, 2
    while sum(n for level, n in many.items() if level >= least) > LEVELLED:
        least += 1
    found = counts.filter(F.col("level") >= least).groupBy("bucket").agg(F.max("level").alias("level")).toArrow()
    discard(counts)
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    out[found["bucket"].to_numpy()] = found["level"].to_numpy()
    return out


#: Columns of list entries: the set or run that stands there, its size and largest partner, and how many entries it stands for.
ENTRY = ["list", "share", "size", "partner", "member", "stands"]
FOUND = "a long, b long, needed int, placed boolean, list long, share int, size int, partner int, member long, stands int"


def _reduced(entries: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The runs of each list as entries, and the links (member, member) inside them.

    A list's entries, by size, are one run as long as a set before allows a partner of the next one's size.
    """
    list_, share, size, partner, member, stands = entries
    order = np.lexsort((size, share, list_))
    list_, share, size, partner, member, stands = (x[order] for x in (list_, share, size, partner, member, stands))
    first = np.append(True, (list_[1:] != list_[:-1]) | (share[1:] != share[:-1]))[: len(list_)]
    part = np.cumsum(first) - 1
    step = int(partner.max(initial=0)) + 1
    reach = np.maximum.accumulate(partner + part * step) - part * step
    starts = first.copy()
    starts[1:] |= size[1:] > reach[:-1]
    at = np.flatnonzero(starts)
    if not len(at):
        return [x[:0] for x in entries], np.zeros((0, 2), np.int64)
    head = member[at][np.cumsum(starts) - 1]
    links = np.unique(np.column_stack([head, member])[head != member], axis=0)
    together = np.clip(np.add.reduceat(stands, at), PAIRED + 1, 1 << 30)
    return [list_[at], share[at], size[at], np.maximum.reduceat(partner, at), member[at], together], links


def _unpaired(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets among entries of long lists that aren't reduced yet, and in how many lists each stands."""
    return np.unique(entries[4][entries[5] == 1], return_counts=True)


def _lengths(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the lists of sorted entries begin, their numbers of entries and what they stand for."""
    list_, share, stands = entries[0], entries[1], entries[5]
    at = np.flatnonzero(np.append(True, (list_[1:] != list_[:-1]) | (share[1:] != share[:-1]))[: len(list_)])
    return at, np.diff(np.append(at, len(list_))), np.add.reduceat(stands, at) if len(at) else stands


def _sorted(entries: list[np.ndarray]) -> list[np.ndarray]:
    """entries by list, share, size and member, without those that copies of a set repeat."""
    list_, share, size, _, member, _ = entries
    order = np.lexsort((member, size, share, list_))
    entries = [x[order] for x in entries]
    list_, share, _, _, member, _ = entries
    stay = np.append(True, (list_[1:] != list_[:-1]) | (share[1:] != share[:-1]) | (member[1:] != member[:-1]))[: len(list_)]
    return [x[stay] for x in entries]


def _paired(entries: list[np.ndarray], at: np.ndarray, length: np.ndarray, sizes: Sizes) -> list[np.ndarray]:
    """(a, b, hits needed, placed) of all pairs of lists of up to PAIRED entries that sizes allow.

    placed: what follows this shingle is enough for both, which holds where linked sets first meet.
    """
    _, _, size, partner, member, _ = entries
    out = [[np.zeros(0, np.int64)] * 4]
    for n in np.unique(length):
        starts = at[length == n]
        for i, j in combinations(range(n), 2):
            x, y = starts + i, starts + j
            fits = size[y] <= sizes.most(size[x])
            x, y = x[fits], y[fits]
            placed = (size[y] <= partner[x]) & (size[x] <= partner[y])
            out.append([np.minimum(member[x], member[y]), np.maximum(member[x], member[y]), sizes.hits(size[x], size[y]), placed])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _entries(docs: DataFrame, levels: np.ndarray, text_column: str, n: int, num: int, den: int) -> DataFrame:
    """The entries of all lists, those of long lists reduced to the task's runs, and the task's own links as long lists of two.

    share is -1 but for lists that are so frequent that they are reduced in shares first. Rows of share -2 give for a set (list)
    how many of its lists (size) were reduced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def entries(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shingler, sizes, levels = Shingler(n), Sizes(num, den), shared.value
        share = TaskContext.get().partitionId() % SHARES
        gathered: list[list[np.ndarray]] = []
        seen: set[tuple[int, int]] = set()
        held = 0

        def passed() -> pa.RecordBatch:
            every = _sorted([np.concatenate(c) for c in zip(*gathered, strict=True)])
            at, length, _ = _lengths(every)
            long_ = np.repeat(length > PAIRED, length)
            runs, links = _reduced([x[long_] for x in every])
            parts = [np.concatenate([x[~long_], y]) for x, y in zip(every, runs, strict=True)]
            # In order of members, so that equal ones stand together and the shuffle compresses them.
            order = np.argsort(parts[4], kind="stable")
            link = mix(links[:, 0].astype(np.uint64) * _MIX[3] + links[:, 1].astype(np.uint64)).view(np.int64)
            none = np.zeros(2 * len(links), np.int64)
            linked = [np.concatenate([link, link]), none - 1, none, none, links.T.reshape(-1), none + PAIRED]
            members, times = _unpaired([x[long_] for x in every])
            counts = [members, np.full(len(members), -2), times, times * 0, members, times * 0]
            columns = [np.concatenate(c) for c in zip([x[order] for x in parts], linked, counts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if name in ("list", "member") else np.int32)) for c, name in zip(columns, ENTRY, strict=True)], names=ENTRY)

        for text in (t for b in batches for at in range(0, b.num_rows, TEXTS) for t in b.column(0).slice(at, TEXTS).to_pylist()):
            h = shingler(text)
            digest = _digest(h)
            if not len(h) or digest in seen:
                continue
            seen.add(digest)
            list_, size, partner, level = sizes.entries(h, levels)
            # A subset in common links its sets already: such lists count as long ones, which give their runs.
            gathered.append([list_, np.where(level >= HOT_LEVEL, share, -1), size, partner, np.full(len(list_), digest[0]), np.where(size > 0, 1, PAIRED)])
            held += len(list_)
            if held > GATHERED // 4:
                yield passed()
                gathered.clear()
                seen.clear()
                held = 0
        if gathered:
            yield passed()

    return docs.select(text_column).mapInArrow(entries, "list long, share int, size int, partner int, member long, stands int")


def _read(entries: DataFrame, num: int, den: int) -> DataFrame:
    """What reading the lists gives: pairs (a, b, needed, placed), for sets of long lists (a) how many those are (needed; b is null),
    and entries again for lists that were reduced in shares."""
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(tasks, "list", "share").sortWithinPartitions("list", "share", "size", "member")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sizes = Sizes(num, den)
        names = ["a", "b", "needed", "placed", *ENTRY]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

        def table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
            rows = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[c]).cast(t) if c in columns else pa.nulls(rows, t) for c, t in zip(names, kinds, strict=True)], names=names)

        def linked(links: np.ndarray) -> pa.RecordBatch:
            return table({"a": links.min(1, initial=2**63 - 1), "b": links.max(1, initial=-(2**63)), "needed": np.ones(len(links), np.int32), "placed": np.ones(len(links), bool)})

        def unpaired(members: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return table({"a": members, "needed": times})

        def done(entries: list[np.ndarray]) -> Iterator:
            counts = entries[1] == -2
            yield unpaired(entries[0][counts], entries[2][counts])
            entries = _sorted([x[~counts] for x in entries])
            at, length, stands = _lengths(entries)
            hot, long_ = entries[1][at] >= 0, stands > PAIRED
            short = ~hot & ~long_ & (length > 1)
            pairs = _paired(entries, at[short], length[short], sizes)
            yield table(dict(zip(names, pairs, strict=False)))
            chosen = [x[np.repeat(long_, length)] for x in entries]
            yield unpaired(*_unpaired(chosen))
            runs, links = _reduced(chosen)
            yield linked(links)
            again = [np.concatenate([x[np.repeat(hot & ~long_, length)], y[runs[1] >= 0]]) for x, y in zip(entries, runs, strict=True)]
            again[1] = again[1] * 0 - 1
            yield table(dict(zip(ENTRY, again, strict=True)))

        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            if not last.all():
                yield from done([x[~last] for x in held])
                held = [x[last] for x in held]
            elif len(held[0]) > HELD and held[1][0] > -2:
                held = _sorted(held)
                if len(held[0]) > PAIRED:
                    yield unpaired(*_unpaired(held))
                    held, links = _reduced(held)
                    yield linked(links)
        if held is not None and len(held[0]):
            yield from done(held)

    return dealt.mapInArrow(read, FOUND)


def _candidates(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs that meet often enough in short lists, and the links of the runs of long ones."""
    found = written(_read(entries, num, den), "lists")
    rows = found.filter("a IS NOT NULL").select("a", "b", "needed", "placed")
    again = found.filter("list IS NOT NULL").select(*ENTRY)
    if not again.isEmpty():
        rows = written(rows.unionByName(_read(again, num, den).filter("a IS NOT NULL").select("a", "b", "needed", "placed")), "lists")
    let_off = written(rows.filter("b IS NULL").groupBy("a").agg(F.sum("needed").alias("off")), "let-off")
    near = F.broadcast(let_off) if small(let_off) else let_off
    pairs = rows.filter("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.min("needed").alias("needed"), F.max("placed").alias("placed"))
    both = pairs.filter("placed").join(near.withColumnRenamed("off", "off_a"), "a", "left").join(near.select(F.col("a").alias("b"), F.col("off").alias("off_b")), "b", "left")
    off = F.least(F.coalesce("off_a", F.lit(0)), F.coalesce("off_b", F.lit(0)))
    return both.filter(F.col("hits") + off >= F.col("needed")).select("a", "b")


def linked_pairs(sets: list[np.ndarray], num: int, den: int, columns: int = 1 << 14) -> list[tuple[int, int]]:
    """The indices of linked sets, by counting shared elements exactly; elements of one set only are left out first."""
    n = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.append(True, every[1:] != every[:-1])
    column = np.cumsum(first) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], column[several]
    common = np.zeros((len(sets), len(sets)), np.float64)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for start in range(0, int(column[-1]) + 1, columns):
            lo, hi = np.searchsorted(column, [start, start + columns])
            x = np.zeros((len(sets), columns), np.float32)
            x[owner[lo:hi], column[lo:hi] - start] = 1
            common += x @ x.T
    links = (num + den) * common >= num * (n[:, None] + n[None, :])
    return [(int(a), int(b)) for a, b in np.argwhere(np.triu(links, 1))]


def _links(groups: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): the links inside each group of (g1, g2, g3, node, body), thinned to one tree for each part that is linked."""
    keys = ["g1", "g2", "g3"]
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select(*keys, "node", "body").repartition(tasks, *keys).sortWithinPartitions(*keys)

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler(n)
        current, nodes, sets = None, [], []

        def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], names=["a", "b"])

        def links() -> list[tuple[int, int]]:
            if len(nodes) < 2:
                return []
            top = list(range(len(nodes)))

            def root(i: int) -> int:
                while top[i] != i:
                    top[i] = top[top[i]]
                    i = top[i]
                return i

            for a, b in linked_pairs(sets, num, den):
                top[root(a)] = root(b)
            return [(nodes[i], nodes[root(i)]) for i in range(len(nodes)) if root(i) != i]

        for batch in batches:
            found: list[tuple[int, int]] = []
            for *key, node, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != current:
                    found += links()
                    current, nodes, sets = key, [], []
                if node not in nodes:
                    nodes.append(node)
                    sets.append(shingler(body))
            yield table(found)
        yield table(links())

    return dealt.mapInArrow(verify, "a long, b long")


def ngram_components(
    docs: DataFrame,
    n: int = 3,
    similarity: tuple[int, int] = (90, 100),
    id_column: str = "doc_id",
    text_column: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
    with_rows: bool = False,
) -> DataFrame:
    """One row per row of docs: id, n_shingles (long), component_id: the smallest id reachable by links, the own included.

    with_rows adds row1 and row2, the row_keys() of id and text, and kept (boolean): true for the row that stands for its component,
    one of the smallest id, and for those that repeat its id and text; true for rows without a shingle.

    Sets of n-word shingles (fewer words: the sequence as one shingle) are linked from a Jaccard similarity of
    similarity[0] / similarity[1] on. Null and empty texts and those without words have no shingle, no link, and their own id as component.
    Rows of one id with different texts are different documents of one name; null ids take part, and a component of null ids only has
    a null component_id. An empty table gives no rows; further columns are ignored.
    """
    num, den = similarity
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    first = written(_sets(source, "doc_id", "text", n, num, den), "sets")
    sets = first.filter("shingle IS NULL").select("doc_id", "n_shingles", "d1", "d2", "_row", "_row2")
    levels = _levels(first.filter("shingle IS NOT NULL").select("shingle", "seen"))
    family = written(components(_candidates(_entries(source, levels, "text", n, num, den), num, den)), "families")

    # One row stands for all rows of one set; only the texts of such rows are read again, and only in families.
    classes = sets.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "_row2")).alias("row"))
    classes = written(classes.select("d1", "d2", "least", "n", "row"), "classes")
    family = family.select(F.col("node").alias("d1"), F.col("component").alias("family"))
    members = classes.join(F.broadcast(family) if small(family, broadcast_rows) else family, "d1")
    members = written(members.select("d1", "d2", "row._row", "row._row2", "family").withColumn("node", F.monotonically_increasing_id()), "members")
    total = members.count()
    keys = members.select("_row", "_row2", "node", "family")
    texts = source.select(*row_keys("doc_id", "text"), text_of("text").alias("body"))
    bodies = written(texts.join(F.broadcast(keys) if total <= broadcast_rows else keys, ["_row", "_row2"]).select("node", "family", "body"), "bodies")
    if bodies.count() > total:  # rows that repeat id and text
        bodies = written(bodies.groupBy("node", "family").agg(F.first("body").alias("body")), "bodies")

    counts = members.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = with_groups(bodies, counts.select("family", "n", F.lit(True).alias("several")), "family", total, broadcast_rows).filter("several")
    spread = F.xxhash64("node")
    blocks = F.ceil(F.col("n") / GROUP)
    own = sized.select("family", "node", "body", F.pmod(spread, blocks).alias("block"))
    anchor = sized.filter(F.col("n") > GROUP).filter(F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < 2 * ANCHORS)
    anchors = anchor.select("family", "node", "body", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    groups = own.unionByName(anchors).select(F.col("family").alias("g1"), F.col("block").alias("g2"), F.lit(-1).cast("long").alias("g3"), "node", "body")
    links = written(_links(groups, n, num, den), "links")
    parts = components(links)

    large = written(counts.filter(F.col("n") > GROUP), "large-families")
    if not large.isEmpty():
        part = parts.select("node", F.col("component").alias("part"))
        inside = with_groups(members.select("node", "family"), large.withColumn("large", F.lit(True)), "family", total, broadcast_rows).filter("large").select("node", "family")
        inside = written(inside.join(F.broadcast(part) if small(part, broadcast_rows) else part, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
        by_part = inside.groupBy("family", "part").agg(F.count(F.lit(1)).alias("m"))
        main = by_part.groupBy("family").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.sum("m").alias("n"), F.max("m").alias("m"))
        main = written(main.filter(F.col("n") > F.col("m")).select("family", "main", "n", F.ceil(F.col("n") / GROUP).alias("all_blocks"), F.ceil((F.col("n") - F.col("m")) / GROUP).alias("apart_blocks")), "main-parts")
        marked = with_groups(inside, main, "family", total, broadcast_rows).filter("main IS NOT NULL")
        marked = marked.select("node", (F.col("part") != F.col("main")).alias("apart"), "all_blocks", "apart_blocks")
        rows = bodies.join(F.broadcast(marked) if small(marked, broadcast_rows) else marked, "node")
        to = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
        spread = F.xxhash64("node", F.lit(2))
        apart = rows.filter("apart").select("family", F.pmod(spread, F.col("apart_blocks")).alias("g2"), to("all_blocks").alias("g3"), "node", "body")
        every = rows.select("family", to("apart_blocks").alias("g2"), F.pmod(spread, F.col("all_blocks")).alias("g3"), "node", "body")
        cells = apart.unionByName(every).withColumnRenamed("family", "g1")
        links = written(links.unionByName(_links(cells, n, num, den)), "links")
        parts = components(links)

    part = members.select("d1", "d2", "node").join(F.broadcast(parts) if small(parts, broadcast_rows) else parts, "node").select("d1", "d2", "component")
    placed = written(classes.select("d1", "d2", "least", "n", "row").join(F.broadcast(part) if small(part, broadcast_rows) else part, ["d1", "d2"], "left"), "placed")
    least = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_least"), F.min("row").alias("component_row"), F.count(F.lit(1)).alias("n"))
    named = with_groups(placed.withColumnRenamed("n", "copies"), least, "component", total, broadcast_rows)
    groups = written(named.select(F.struct("d1", "d2").alias("set"), F.col("copies").alias("n"), F.coalesce("component_least", "least").alias("component_id"), F.coalesce("component_row", "row").alias("stays")), "groups")
    discard(family, classes, members, bodies, links, placed)
    rows = sets.select("doc_id", "n_shingles", F.struct("d1", "d2").alias("set"), F.col("_row").alias("row1"), F.col("_row2").alias("row2"))
    found = with_groups(rows.filter("n_shingles > 0"), groups, "set", sets.count(), broadcast_rows)
    kept = (F.col("row1") == F.col("stays._row")) & (F.col("row2") == F.col("stays._row2"))
    linked = found.select("doc_id", "n_shingles", "component_id", "row1", "row2", kept.alias("kept"))
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row1", "row2", F.lit(True).alias("kept"))
    out = linked.unionByName(alone).withColumnRenamed("doc_id", id_column)
    return out if with_rows else out.drop("row1", "row2", "kept")
