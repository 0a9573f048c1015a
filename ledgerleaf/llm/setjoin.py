"""Exact Jaccard join of word shingle sets by pigeonhole over a partitioned universe.

**Bands.** Sizes fall into bands whose ends differ by the similarity, so a set is resident
in its own band and visits the one below; linked sets meet in the band of the smaller.

**Segments.** A band with sets of up to ``hi`` shingles allows ``d = hi (1 - t) / t``
different shingles between linked sets. Its universe is hashed into ``d + 1`` segments and
some spare ones. Each set is cut into one subset for each segment. Its allocation gives
every segment 0 (skipped), 1 (subsets equal) or 2 (at most one shingle apart) with a sum of
``d + 1``; by the pigeonhole principle a linked set agrees in some segment. Small subsets are
shared by many sets and cost most, so the spare zeros go to the smallest, and where another
small one is left, it is skipped and the reserve segment takes 2. Every set indexes all its
subsets and the one-deletion neighbours of its reserve subset; its allocation says which
of them also probe.

**Hot groups.** A task first resolves the sets it holds: sets that share a key are verified
on the spot and joined to local groups, and of each group one entry for each key leaves.
So a key gets no more entries than there are tasks. Across tasks every key links its first
entry with the others (a star). Keys whose entries still lie in several components then
give all their cross-component pairs. No pair is capped or dropped; all are verified exactly.

**Rows.** Null text counts as empty; an empty set is linked with nothing. Rows with a null
identifier get no component. Rows that share an identifier count as one document. Equal
sets are one vertex.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.bpe import small_batches
from ledgerleaf.llm.components import components
from ledgerleaf.llm.memory import drop, settle, settled

#: Shingles that a task resolves together, words it remembers, bits of a set's parity map.
TOKENS, WORDS, BITS = 400_000, 150_000, 512
#: Entries of a key that are compared together; a key with more is cut into blocks that meet pairwise.
BLOCK = 1_000
#: Most bits of the wider maps, which sets of more than ``BITS`` shingles have beside the others.
WIDE = 1 << 13
#: Bytes of text that are cut into words at once, and buckets of keys for each partition.
TEXT, SPREAD = 2 << 20, 2
#: A subset with one shingle less is taken to be shared by so many times more sets.
RARER = 8.0
#: Bits of the map of wanted rows that is sent to all tasks (1 MB, whatever the input).
WANTED = 1 << 23

_A, _B, _C, _D, _E = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _E
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int):
        self.words = words
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.hash = np.zeros(0, np.uint64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > WORDS:
            self._forget()
        known = len(self.number)
        split = [(t or "").encode().lower().split() for t in texts]
        sizes = list(map(len, split))
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        if len(self.number) > known:
            fresh = list(self.number)[known:]
            self.hash = np.concatenate([self.hash, np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))])
        h = self.hash[ids]
        k, n = self.words, len(h)
        rolled = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            rolled = mixed(rolled * _A + h[j : n - k + 1 + j]) if len(rolled) else rolled
        out, at = [], 0
        for size in sizes:
            if size >= k:
                one = np.sort(rolled[at : at + size - k + 1])
                out.append(one[np.append(True, one[1:] != one[:-1])])
            elif size:
                one = np.full(1, size, np.uint64)
                for x in h[at : at + size]:
                    one = mixed(one * _C + x)
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
            at += size
        return out


def parity(s: np.ndarray, bits: int = BITS) -> bytes:
    """Parity of the shingles in each of the cells: maps of two sets differ in no more places than the sets."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def width(n: int) -> int:
    """Bits of the map of a set of ``n`` shingles: as many or more, so that it tells sets apart; up to ``WIDE``."""
    return min(max(BITS, 1 << (max(n, 1) - 1).bit_length()), WIDE)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """The maps, one a row, in the narrower form of so many 64-bit words."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def narrowed(maps: list[bytes]) -> np.ndarray:
    """The maps in the form of ``BITS`` bits."""
    sizes = np.fromiter(map(len, maps), np.int64, len(maps))
    out = np.empty((len(maps), BITS // 64), np.uint64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = folded(np.frombuffer(b"".join(maps[k] for k in at.tolist()), np.uint64).reshape(len(at), -1), BITS // 64)
    return out


def pairwise_apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Places in which each map of ``a`` differs from the one of ``b`` beside it, in the narrower form of the two."""
    sizes = np.array([list(map(len, a)), list(map(len, b))], np.int64)
    out = np.zeros(len(a), np.int64)
    for la, lb in np.unique(sizes, axis=1).T.tolist():
        at = np.flatnonzero((sizes[0] == la) & (sizes[1] == lb))
        step = max(1, TEXT // (la + lb))
        for i in range(0, len(at), step):
            now = at[i : i + step]
            x, y = (np.frombuffer(b"".join(m[k] for k in now.tolist()), np.uint64).reshape(len(now), -1) for m in (a, b))
            words = min(la, lb) // 8
            out[now] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(axis=1)
    return out


@cache
def bands(percent: int) -> list[tuple[int, int]]:
    """First and last size of each band, up to 2^31."""
    out, low = [], 1
    while low < 1 << 31:
        high = max(low, math.ceil(low * 100 / percent) - 1)
        out.append((low, high))
        low = high + 1
    return out


class Plan:
    """Segments and spare segments of each band."""

    def __init__(self, percent: int):
        table = bands(percent)
        self.percent = percent
        self.low = np.array([a for a, _ in table])
        self.most = np.array([b * (100 - percent) // percent for _, b in table])
        self.spare = np.where(self.most > 0, 2 + self.most // 16, 0)
        self.segments = self.most + 1 + self.spare

    def units(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Set, band and residence of each place where a set is entered; bands of equal sets only are left out."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        who = np.arange(len(sizes))
        at = np.concatenate([who, who])
        band = np.concatenate([own, own - 1])
        resident = np.concatenate([np.ones(len(who), bool), np.zeros(len(who), bool)])
        keep = (band >= 0) & (np.concatenate([sizes, sizes]) > 0)
        keep &= self.most[np.maximum(band, 0)] > 0
        return at[keep], band[keep], resident[keep]

    def entries(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, set, whether it probes, whether it is resident, of every entry of the sets."""
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        who, band, resident = self.units(sizes)
        if not len(who):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none.astype(bool), none.astype(bool)
        flat = np.concatenate(sets)
        begin = np.cumsum(sizes) - sizes
        n = sizes[who]
        to = np.cumsum(n)
        source = np.arange(to[-1]) + np.repeat(begin[who] - (to - n), n)
        token = flat[source]
        m = self.segments[band]
        first = np.cumsum(m) - m
        seed = mixed(band.astype(np.uint64) + np.uint64(1))
        # The upper half of the hash, scaled to the number of segments.
        segment = ((mixed(token ^ np.repeat(seed, n)) >> np.uint64(32)) * np.repeat(m.astype(np.uint64), n) >> np.uint64(32)).astype(np.int64)
        place = np.repeat(first, n) + segment
        value = mixed(flat + _D)[source]
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, place, value)
        held = np.bincount(place, minlength=len(total))
        unit = np.repeat(np.arange(len(who)), m)
        # Allocation: the spare zeros go to the smallest subsets.
        order = np.lexsort((held, unit))
        rank = np.empty(len(total), np.int64)
        rank[order] = np.arange(len(total)) - first[unit[order]]
        spare = self.spare[band]
        probe = rank >= spare[unit]
        # One more is skipped where it is more common than the neighbours of the reserve subset.
        reserve = held[first]
        nxt = order[first + np.minimum(spare, m - 1)]
        swap = probe[first] & (nxt != first) & (reserve > 1) & (RARER ** -held[nxt].astype(float) > reserve * RARER ** -(reserve - 1.0))
        probe[nxt[swap]] = False
        salt = mixed(np.repeat(seed, m) + (np.arange(len(total)) - first[unit]).astype(np.uint64) * _A)
        keys = [mixed(total ^ salt)]
        sets_at, probes, residents = [who[unit]], [probe], [resident[unit]]
        # One-deletion neighbours of the reserve subsets.
        in_reserve = np.flatnonzero(segment == 0)
        owner = np.repeat(np.arange(len(who)), n)[in_reserve]
        keys.append(mixed((total[first[owner]] - value[in_reserve]) ^ salt[first[owner]]))
        sets_at.append(who[owner])
        probes.append(swap[owner])
        residents.append(resident[owner])
        return tuple(np.concatenate(x) for x in (keys, sets_at, probes, residents))


class Union:
    """Groups of the sets of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class Resolver:
    """Links among the sets that a task holds."""

    def __init__(self, sets: list[np.ndarray], maps: list[bytes], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.maps = np.frombuffer(b"".join(maps), np.uint64).reshape(len(sets), BITS // 64)
        self.groups = Union(len(sets))
        self.links: list[tuple[int, int]] = []
        self.seen: set[tuple[int, int]] = set()

    def may(self, x: int, others: np.ndarray) -> np.ndarray:
        """Whether sizes and parity maps let the sets be linked."""
        both = self.sizes[x] + self.sizes[others]
        apart = np.bitwise_count(self.maps[others] ^ self.maps[x]).sum(axis=1)
        # Difference <= (100 - p) / 100 of the union, and the union is half of sizes and difference together.
        return apart * (100 + self.percent) <= (100 - self.percent) * both

    def verify(self, x: int, y: int) -> bool:
        a, b = self.sets[x], self.sets[y]
        same = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * same >= self.percent * (len(a) + len(b) - same)

    def meet(self, x: int, y: int) -> None:
        if self.groups.find(x) != self.groups.find(y) and (x, y) not in self.seen:
            self.seen.add((x, y))
            if self.verify(x, y):
                self.groups.join(x, y)
                self.links.append((x, y))

    def resolve(self, key: np.ndarray, who: np.ndarray, probe: np.ndarray, resident: np.ndarray) -> None:
        """All sets that share a key with a probe and a resident among them; entries are sorted by key."""
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(begin, append=len(key))
        good = (size > 1) & np.logical_or.reduceat(probe, begin) & np.logical_or.reduceat(resident, begin)
        open_runs = []
        for a, n in zip(begin[good].tolist(), size[good].tolist()):
            members = np.unique(who[a : a + n])
            if len(members) < 2:
                continue
            head = int(members[0])
            for y in members[1:][self.may(head, members[1:])].tolist():
                self.meet(head, y)
            if len(members) > 2:
                open_runs.append(members)
        for members in open_runs:
            if len({self.groups.find(x) for x in members.tolist()}) < 2:
                continue
            for i, x in enumerate(members.tolist()):
                rest = members[i + 1 :]
                for y in rest[self.may(x, rest)].tolist():
                    self.meet(x, y)


def _chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Identifiers and sets of the rows of a task, by bounded chunks."""
    shingler, ids, sets, held = Shingler(words), [], [], 0
    for b in small_batches(batches, TEXT):
        found = shingler(b.column(1).to_pylist())
        ids.append(b.column(0).to_numpy())
        sets += found
        held += sum(map(len, found))
        if held > TOKENS:
            yield np.concatenate(ids), sets
            ids, sets, held = [], [], 0
    if sets:
        yield np.concatenate(ids), sets


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _both_maps(maps: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """The narrow form of the maps, and those that are wider."""
    return pa.array([m.tobytes() for m in narrowed(maps)], pa.binary()), pa.array([m if len(m) > BITS // 8 else None for m in maps], pa.binary())


def _described(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in small_batches(batches, TEXT):
            sets = shingler(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(_fingerprint, sets), pa.binary()), *_both_maps([parity(s, width(len(s))) for s in sets])],
                names=["id", "n", "mark", "map", "wide"],
            )

    return run


SENT = "bucket int, a binary, b binary, c binary, d binary"
PROBE, RESIDENT, MANY = 1, 2, 4
#: Buckets of what isn't keyed: links that a task has verified, and descriptions of its rows.
LINKS, ROWS = -1, -2


def _entered(words: int, percent: int, buckets: int):
    """Entries of a task by bucket of their keys, its verified links, and its rows' sizes, fingerprints and maps."""
    names = [c.split()[0] for c in SENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(percent)
        for ids, sets in _chunks(batches, words):
            marks, maps = list(map(_fingerprint, sets)), list(map(parity, sets))
            wide = [parity(s, width(len(s))) if width(len(s)) > BITS else m for s, m in zip(sets, maps)]
            rows = [(ROWS, ids.tobytes(), np.fromiter(map(len, sets), np.int64).tobytes(), b"".join(marks), b"".join(wide))]
            # Equal sets are one vertex: the smallest identifier.
            first: dict[bytes, int] = {}
            for k in np.argsort(ids, kind="stable").tolist():
                if len(sets[k]):
                    first.setdefault(marks[k], k)
            at = list(first.values())
            vertex, sets = ids[at], [sets[k] for k in at]
            key, who, probe, resident = plan.entries(sets)
            if len(key):
                order = np.argsort(key, kind="stable")
                key, who, probe, resident = key[order], who[order], probe[order], resident[order]
                resolver = Resolver(sets, [maps[k] for k in at], percent)
                resolver.resolve(key, who, probe, resident)
                links = np.array(resolver.links, np.int64).reshape(-1, 2)
                rows.append((LINKS, vertex[links[:, 0]].tobytes(), vertex[links[:, 1]].tobytes(), b"", b""))
                # Of each local group one entry for each key leaves.
                group = np.array([resolver.groups.find(x) for x in range(len(sets))])[who]
                flags = (probe * PROBE + resident * RESIDENT).astype(np.uint8)
                again = np.flatnonzero(key[1:] == key[:-1])
                if len(again):
                    runs = np.zeros(len(key), bool)
                    runs[again] = runs[again + 1] = True
                    single, many = np.flatnonzero(~runs), np.flatnonzero(runs)
                    many = many[np.lexsort((who[many], group[many], key[many]))]
                    begin = np.flatnonzero(np.append(True, (key[many][1:] != key[many][:-1]) | (group[many][1:] != group[many][:-1])))
                    last = np.append(begin[1:], len(many)) - 1
                    joint = np.bitwise_or.reduceat(flags[many], begin) | np.where(who[many[last]] != who[many[begin]], MANY, 0).astype(np.uint8)
                    at = np.concatenate([single, many[begin]])
                    key, who, flags = key[at], who[at], np.concatenate([flags[single], joint])
                bucket = (key % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                key, owner, flags = key[order], vertex[who[order]], flags[order]
                rows += [(b, key[x:y].tobytes(), owner[x:y].tobytes(), flags[x:y].tobytes(), b"") for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


STARS = "kind int, key bigint, a bigint, b bigint, open boolean, many boolean, mark binary, map binary, wide binary"


def _met(kind: int, a: np.ndarray, b: np.ndarray, key=None, open_=None, many=None, mark=None, map_=None, wide=None) -> pa.RecordBatch:
    n, none = len(a), lambda x, t: pa.nulls(len(a), t) if x is None else pa.array(x, t)
    columns = [pa.array(np.full(n, kind, np.int32)), none(key, pa.int64()), pa.array(a), pa.array(b), none(open_, pa.bool_()), none(many, pa.bool_()), none(mark, pa.binary()), none(map_, pa.binary()), none(wide, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STARS.split(", ")])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and links of the tasks as they came, and for each key its first entry with each of the others."""
    keys, vertices, flags = [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] == ROWS:
                n = np.frombuffer(r["b"], np.int64)
                marks = [r["c"][i : i + 16] for i in range(0, len(r["c"]), 16)]
                ends = np.cumsum([width(x) // 8 for x in n.tolist()]).tolist()
                narrow, wide = _both_maps([r["d"][i:j] for i, j in zip([0, *ends], ends)])
                yield _met(ROWS, np.frombuffer(r["a"], np.int64), n, mark=marks, map_=narrow, wide=wide)
            elif r["bucket"] == LINKS:
                yield _met(LINKS, np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64))
            else:
                keys.append(np.frombuffer(r["a"], np.uint64))
                vertices.append(np.frombuffer(r["b"], np.int64))
                flags.append(np.frombuffer(r["c"], np.uint8))
    if not keys:
        return
    key, vertex, flag = np.concatenate(keys), np.concatenate(vertices), np.concatenate(flags)
    keys = vertices = flags = None
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    wanted = np.zeros(len(order), bool)
    wanted[same] = wanted[same + 1] = True
    order = order[wanted]
    order = order[np.lexsort((vertex[order], key[order]))]
    key, vertex, flag = key[order], vertex[order], flag[order]
    if not len(key):
        return
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(begin, append=len(key))
    any_flag = np.bitwise_or.reduceat(flag, begin)
    good = ((any_flag & PROBE) > 0) & ((any_flag & RESIDENT) > 0)
    many = (any_flag & MANY) > 0
    head = np.repeat(vertex[begin], size)
    keep = np.repeat(good, size) & (head != vertex)
    yield _met(0, head[keep], vertex[keep], key[keep].view(np.int64), np.repeat((size > 2) | many, size)[keep], np.repeat(many, size)[keep])


def _bits(cells: DataFrame) -> np.ndarray:
    """Bounded map of hash cells, for leaving out rows that can't be wanted."""
    words = cells.groupBy((F.col("cell") / 64).cast("int").alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 AS int))")).alias("bits")).toPandas()
    out = np.zeros(WANTED // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``id`` may be wanted: all that are, and few others while the bounded map isn't full.

    What is broadcast is the map, at most ``WANTED`` / 64 rows, whatever the input.
    """
    cell = F.pmod(F.xxhash64("id"), F.lit(WANTED))
    words = wanted.select(cell.alias("cell")).groupBy((F.col("cell") / 64).cast("int").alias("word"))
    bits = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 AS int))")).alias("bits"))
    tested = rows.withColumn("cell", cell).join(F.broadcast(bits), (F.col("cell") / 64).cast("int") == F.col("word"))
    return tested.filter("(bits & shiftleft(1L, cast(cell % 64 AS int))) <> 0").select(*rows.columns)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in small_batches(batches, TEXT):
            sets = shingler(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles binary")


def _nearer(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that sizes and maps (``k, n, map``) let be linked."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            # Sets differ in no fewer shingles than their maps and their sizes do.
            apart = np.maximum(pairwise_apart(b.column(4).to_pylist(), b.column(5).to_pylist()), np.abs(na - nb))
            keep = apart * (100 + percent) <= (100 - percent) * (na + nb)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    with_a = pairs.join(maps, F.col("a") == F.col("k")).select("a", "b", F.col("n").alias("na"), F.col("map").alias("ma"))
    both = with_a.join(maps, F.col("b") == F.col("k")).select("a", "b", "na", F.col("n").alias("nb"), "ma", F.col("map").alias("mb"))
    return both.mapInArrow(near, "a bigint, b bigint")


def _verified(close: DataFrame, texts: DataFrame, words: int, percent: int, used: list[str]) -> DataFrame:
    """The pairs ``a, b`` of vertices that are linked; whole sets are made and sent for these pairs, so maps come before."""
    ends = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct()
    sets = settled(_sets(_likely(texts, ends).join(ends, "id", "left_semi"), words), "sets", used).dropDuplicates(["id"])

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = close.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return two.mapInArrow(equal, "a bigint, b bigint")


def _members(words: int, percent: int, marked):
    """Entries of all sets at the keys that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(percent)
        for ids, sets in _chunks(batches, words):
            key, who, *_ = plan.entries(sets)
            cell = (mixed(key) % np.uint64(WANTED)).astype(np.int64)
            keep = (marked.value[cell >> 6] >> (cell & 63)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(ids[who[keep]])], names=["key", "id"])

    return run


def _open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cell = (mixed(b.column(0).to_numpy().view(np.uint64)) % np.uint64(WANTED)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell)], names=["cell"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which each map of ``a`` differs from each of ``b``."""
    return sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.int64) for k in range(a.shape[1]))


def _close_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of vertices of one key and several roots that sizes and maps let be linked.

    The entries of a key are dealt into blocks by hash; each two blocks meet in a cell of their own.
    """
    blocks = entries.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "vertex", "root", "n", "map")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            block, vertex, root, n = (part.column(k).to_numpy() for k in ("block", "vertex", "root", "n"))
            wide = part.column("map").to_pylist()
            maps = narrowed(wide)
            x, y = part.column("x")[0].as_py(), part.column("y")[0].as_py()
            left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
            for at in range(0, len(left), 256):
                i = left[at : at + 256]
                apart = np.maximum(_apart(maps[i], maps[right]), np.abs(n[i][:, None] - n[right][None, :]))
                may = apart * (100 + percent) <= (100 - percent) * (n[i][:, None] + n[right][None, :])
                may &= root[i][:, None] != root[right][None, :]
                p, q = np.nonzero(may)
                p, q = i[p], right[q]
                # The wider maps tell long texts apart before a pair becomes a row.
                long = np.flatnonzero((n[p] > BITS) | (n[q] > BITS))
                apart = pairwise_apart([wide[k] for k in p[long].tolist()], [wide[k] for k in q[long].tolist()])
                near = np.ones(len(p), bool)
                near[long] = apart * (100 + percent) <= (100 - percent) * (n[p[long]] + n[q[long]])
                a, b = vertex[p[near]], vertex[q[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            key, x, y = (batch.column(k).to_numpy() for k in ("key", "x", "y"))
            begin = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(key)] if len(key) else [0]
            for a, b in zip(begin, begin[1:]):
                part = batch.slice(a, b - a)
                if held and any(held[0].column(k)[0] != part.column(k)[0] for k in ("key", "x", "y")):
                    yield from compare(pa.concat_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from compare(pa.concat_batches(held))

    return cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(meet, "a bigint, b bigint")


def linked(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_shingles, component_id`` of every row: sets linked at a Jaccard similarity of ``percent`` / 100."""
    spark = docs.sparkSession
    settle(spark)
    used: list[str] = []
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    known = texts.filter("id IS NOT NULL")
    buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = known.mapInArrow(_entered(words, percent, buckets), SENT)
    met = settled(sent.repartition(F.when(F.col("bucket") < 0, F.xxhash64("a")).otherwise(F.col("bucket"))).mapInArrow(_stars, STARS), "stars", used)

    nameless = texts.filter("id IS NULL").mapInArrow(_described(words), "id bigint, n bigint, mark binary, map binary, wide binary")
    described = met.filter(F.col("kind") == ROWS).select(F.col("a").alias("id"), F.col("b").alias("n"), "mark", "map", "wide").unionByName(nameless)
    same = described.filter("n > 0 AND id IS NOT NULL").groupBy("mark").agg(F.min("id").alias("vertex"))
    rows = settled(described.join(same, "mark", "left").select("id", "n", "map", "wide", "vertex"), "vertices")
    vertices = rows.filter("id = vertex").dropDuplicates(["id"])
    to = rows.filter("vertex IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("vertex").alias("vertex"))

    def of_vertices(pairs: DataFrame, *keep: str) -> DataFrame:
        left = to.select(F.col("id").alias("a"), F.col("vertex").alias("va"))
        right = to.select(F.col("id").alias("b"), F.col("vertex").alias("vb"))
        found = pairs.join(left, "a").join(right, "b")
        return found.select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b"), *keep)

    sure = of_vertices(met.filter(F.col("kind") == LINKS).select("a", "b").distinct())
    stars = settled(of_vertices(met.filter("kind = 0"), "key", "open", "many"), "candidates")
    widest = vertices.select("id", "n", F.coalesce("wide", "map").alias("map"))
    close = settled(_nearer(stars.filter("a <> b").select("a", "b").distinct(), vertices.select(F.col("id").alias("k"), "n", "map"), percent), "near", used)
    close = settled(_nearer(close, widest.withColumnRenamed("id", "k"), percent), "nearer", used)
    links = settled(sure.unionByName(_verified(close, known, words, percent, used)), "verified")
    drop(spark, used)
    roots = components(links)

    # Keys whose entries lie in several components, and that have more pairs than the star tried.
    def rooted(df: DataFrame, column: str, name: str) -> DataFrame:
        r = roots.select(F.col("vertex").alias("rv"), F.col("root").alias("rr"))
        return df.join(r, F.col(column) == F.col("rv"), "left").withColumn(name, F.coalesce("rr", column)).drop("rv", "rr")

    apart = rooted(rooted(stars.filter("open"), "a", "ra"), "b", "rb").filter("ra <> rb")
    apart = settled(apart.groupBy("key").agg(F.max("many").alias("many")), "apart")
    if apart.isEmpty():
        final = roots
    else:
        here = stars.filter("open").join(apart.select("key"), "key", "left_semi")
        ends = here.select("key", F.col("a").alias("vertex")).unionByName(here.select("key", F.col("b").alias("vertex")))
        # At keys where a task has left out members of a group, these are read again; they share a component with an entry.
        hidden = apart.filter("many").select("key")
        wanted = rooted(ends.join(hidden, "key", "left_semi").select("vertex").distinct(), "vertex", "root").select("root").distinct()
        members = rooted(to, "vertex", "root").join(wanted, "root", "left_semi").select("id", "vertex")
        members = settled(members, "members", used)
        keys = spark.sparkContext.broadcast(_bits(hidden.mapInArrow(_open_cells, "cell bigint")))
        again = _likely(known, members.select("id").distinct()).mapInArrow(_members(words, percent, keys), "key bigint, id bigint")
        again = again.join(hidden, "key", "left_semi").join(members, "id").select("key", "vertex")
        entries = settled(rooted(ends.unionByName(again).distinct(), "vertex", "root"), "entries", used)
        pairs = _close_pairs(entries.join(widest.withColumnRenamed("id", "vertex"), "vertex"), percent).distinct()
        tried = stars.select("a", "b").distinct()
        close = settled(pairs.join(tried, ["a", "b"], "left_anti"), "close", used)
        second = _verified(close, known, words, percent, used)
        final = components(links.unionByName(second))
        drop(spark, used)
    found = rows.join(final.select(F.col("vertex"), "root"), "vertex", "left")
    return found.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "vertex", "id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that are the first of their component, or that have no identifier, whole."""
    found = linked(docs, words, percent, id_column, text_column)
    gone = found.filter(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("gone_id")).distinct()
    return docs.join(gone, docs[id_column] == gone["gone_id"], "left_anti")
