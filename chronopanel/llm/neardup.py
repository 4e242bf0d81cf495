"""Near copies of records by tensored banding over minhashes.

A record is the bag of its words; minhashes of its (word, occurrence) elements agree as often as bags overlap. Two small
collections of sub-keys are made, A and B, each sub-key of a few minhashes. Every pair of one A and one B sub-key is a
table key, so a.keys x b.keys tables cost only the minhashes of a.keys + b.keys sub-keys. Only A sub-keys are shuffled; the
tables of one A sub-key are formed where its records meet. Candidates pass a parity sketch, which bounds the number of
elements that two bags don't share and so loses no pair, and are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.sources.tables import cut, drop_cut


@dataclass(frozen=True)
class Banding:
    """a, b: sub-keys of either collection, of rows minhashes each. words: 32-bit words of the parity sketch; more of them
    tell longer texts apart. hot: records of one A sub-key beyond which its tables are spread over tasks. The chance to
    find a pair of overlap s is chance(s); at() derives a and b from the threshold. For much larger collections raise rows
    there, so that unlike records rarely meet."""

    a: int
    b: int
    rows: int = 3
    words: int = 5
    hot: int = 100_000

    @classmethod
    def at(cls, threshold: float, recall: float = 0.95, rows: int = 3) -> Banding:
        """The fewest A sub-keys that find at least `recall` of the pairs that lie at the threshold itself; B sub-keys, which
        aren't shuffled, miss 0.6 % of them at most. At 0.65: a = 10, b = 16, recall 0.954 at 0.65, 0.982 at 0.70, 0.995 at
        0.75; at 0.8: a = 5, b = 8."""
        miss = math.log1p(-(threshold**rows))
        b = max(1, math.ceil(math.log(0.006) / miss))
        found = recall / -math.expm1(b * miss)
        if not found < 1:
            raise ValueError("this recall is out of reach")
        return cls(max(1, math.ceil(math.log1p(-found) / miss)), b, rows)

    def chance(self, s: float) -> float:
        """The chance that a pair of overlap s shares a table key."""
        miss = 1 - s**self.rows
        return (1 - miss**self.a) * (1 - miss**self.b)

    @property
    def hashes(self) -> int:
        return (self.a + self.b) * self.rows

    @property
    def width(self) -> int:
        """Bytes of a sketch: the number of words, a byte for each B sub-key, the parity sketch."""
        return 4 + self.b + 4 * self.words


def words_of(text: Column) -> Column:
    """The longest runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _elements(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the (word, occurrence) elements of all records, and where each record starts."""
    coded = pc.dictionary_encode(lists.flatten())
    each = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False) if len(coded) else np.empty(0, np.uint64)
    code = np.asarray(coded.indices, np.int64) if len(coded) else np.empty(0, np.int64)
    offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
    record = np.repeat(np.arange(len(lists)), np.diff(offsets))
    order = np.lexsort((code, record))
    new = np.ones(len(order), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (record[order][1:] != record[order][:-1])
    at = np.arange(len(order))
    nth = np.empty(len(order), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mix(each[code] + nth * np.uint64(0x9E3779B97F4A7C15)), offsets


def _signer(key: str, cfg: Banding):
    rng = np.random.default_rng(20_240_607)
    factors = rng.integers(1, 2**31, cfg.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, cfg.hashes, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, offsets = _elements(b.column("_words"))
            n = len(b)
            least = np.empty((n, cfg.hashes), np.uint32)
            if n:
                small, turned = (e >> np.uint64(32)).astype(np.uint32), np.empty(len(e), np.uint32)
                for k in range(cfg.hashes):
                    np.multiply(small, factors[k], out=turned)
                    np.add(turned, shifts[k], out=turned)
                    least[:, k] = np.minimum.reduceat(turned, offsets[:-1])
            sums = [np.add.reduceat(_mix(e ^ np.uint64(s)), offsets[:-1]).view(np.int64) if n else np.empty(0, np.int64) for s in (0x1234567, 0x7654321)]
            keys = np.zeros((n, cfg.a), np.uint64)
            for i in range(cfg.a):
                for k in range(i * cfg.rows, (i + 1) * cfg.rows):
                    keys[:, i] = _mix(keys[:, i] * np.uint64(31) + least[:, k].astype(np.uint64))
            keys = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            packed = np.empty((n, cfg.width), np.uint8)
            packed[:, :4] = np.diff(offsets).astype("<u4")[:, None].view(np.uint8)
            for j in range(cfg.b):
                sub = np.zeros(n, np.uint64)
                for k in range((cfg.a + j) * cfg.rows, (cfg.a + j + 1) * cfg.rows):
                    sub = _mix(sub * np.uint64(31) + least[:, k].astype(np.uint64))
                packed[:, 4 + j] = (sub >> np.uint64(56)).astype(np.uint8)
            # Every element turns one bit: equal elements of two bags cancel out in the exclusive or of their sketches.
            spot = _mix(e ^ np.uint64(0xABCDEF)) % np.uint64(32 * cfg.words)
            bit, word = np.uint32(1) << (spot & np.uint64(31)).astype(np.uint32), spot >> np.uint64(5)
            for w in range(cfg.words):
                part = np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint32(0)), offsets[:-1]) if n else np.empty(0, np.uint32)
                packed[:, 4 + cfg.b + 4 * w : 8 + cfg.b + 4 * w] = part.astype("<u4")[:, None].view(np.uint8)
            width = cfg.width
            sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(packed.tobytes())])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * cfg.a), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.diff(offsets).astype(np.int32)), pa.array(sums[0]), pa.array(sums[1]), sketch, lists], names=[key, "n", "h1", "h2", "sketch", "keys"])

    return run


def _unpack(sketches: pa.Array, cfg: Banding) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sketches: numbers of words, B sub-keys, parity sketches."""
    flat = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, cfg.width)
    n = np.ascontiguousarray(flat[:, :4]).view("<u4")[:, 0].astype(np.int64)
    return n, np.ascontiguousarray(flat[:, 4 : 4 + cfg.b].T), np.ascontiguousarray(flat[:, 4 + cfg.b :]).view("<u4")


def _pairs_of(table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal values, by their distance in sorted order: the work is the number of pairs."""
    order = np.argsort(table)
    s = table[order]
    at, d = np.flatnonzero(s[1:] == s[:-1]), 1
    while len(at):
        yield order[at], order[at + d]
        d += 1
        at = at[at + d < len(s)]
        at = at[s[at] == s[at + d]]


def _split_tables(cfg: Banding):
    """Every record once a table: its key mixed with each of its B sub-keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, sub, _ = _unpack(b.column("sketch"), cfg)
            for j in range(cfg.b):
                key = _mix(np.asarray(b.column("key")).view(np.uint64) * np.uint64(31) + _mix(np.uint64(j << 8) | sub[j].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("id"), b.column("sketch")], names=["key", "id", "sketch"])

    return run


def _matcher(cfg: Banding, least: float):
    apart = (1 - least) / (1 + least)

    def block(key: np.ndarray, ids: np.ndarray, n: np.ndarray, sub: np.ndarray, odd: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, group, size = np.unique(key, return_inverse=True, return_counts=True)
        shared = size[group] > 1
        group, ids, n, sub, odd = group[shared].astype(np.int64) << 8, ids[shared], n[shared], sub[shared], odd[shared]
        for j in range(cfg.b):
            for x, y in _pairs_of(group | sub[:, j]):
                for at in range(0, len(x), 200_000):
                    p, q = x[at : at + 200_000], y[at : at + 200_000]
                    # What two bags don't share is at least the bits in which their sketches differ.
                    most = np.floor(apart * (n[p] + n[q]) + 1e-9)
                    good = np.abs(n[p] - n[q]) <= most
                    p, q, most = p[good], q[good], most[good]
                    good = np.bitwise_count(odd[p] ^ odd[q]).sum(1) <= most
                    if good.any():
                        yield ids[p[good]], ids[q[good]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; those of the last key of a batch wait for the next."""
        held: list[np.ndarray] | None = None

        def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            seen: list[np.ndarray] = []
            size = 0
            for a, b in block(*parts):
                seen.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
                size += len(a)
                if size > 500_000:
                    u = np.unique(np.concatenate(seen), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["id_1", "id_2"])
                    seen, size = [], 0
            if seen:
                u = np.unique(np.concatenate(seen), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["id_1", "id_2"])

        for b in batches:
            if not len(b):
                continue
            n, sub, odd = _unpack(b.column("sketch"), cfg)
            parts = [np.asarray(b.column("key")), np.asarray(b.column("id")), n, sub.T, odd]
            if held is not None:
                parts = [np.concatenate([h, p]) for h, p in zip(held, parts, strict=True)]
            start = int(np.searchsorted(parts[0], parts[0][-1], "left"))
            held = [p[start:] for p in parts]
            if start:
                yield from emit([p[:start] for p in parts])
        if held is not None:
            yield from emit(held)

    return run


def signatures(df: DataFrame, key: str, text: str, least_words: int, cfg: Banding) -> DataFrame:
    """id, n, h1, h2, sketch, keys of the records with enough words."""
    w = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), words_of(F.col(text)).alias("_words")).where(F.size("_words") >= least_words)
    return w.mapInArrow(_signer("id", cfg), "id long, n int, h1 long, h2 long, sketch binary, keys array<int>")


def candidates(reps: DataFrame, threshold: float, cfg: Banding) -> DataFrame:
    """id_1, id_2: pairs that share a table key and pass the sketch."""
    each = reps.select("id", "sketch", F.posexplode("keys").alias("i", "k"))
    entries = each.select("id", "sketch", (F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("k").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("key"))
    hot = entries.groupBy("key").count().where(F.col("count") > cfg.hot).select("key")
    if hot.take(1):  # rare: one A sub-key of very many records is split by the B sub-keys, that is by its tables
        big = entries.select("key", "id", "sketch").join(hot, "key", "left_semi").mapInArrow(_split_tables(cfg), "key long, id long, sketch binary")
        entries = entries.select("key", "id", "sketch").join(hot, "key", "left_anti").unionByName(big)
    sorted_ = entries.select("key", "id", "sketch").repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(_matcher(cfg, threshold), "id_1 long, id_2 long").distinct()


def _bag(df: DataFrame, key: str, text: str, wanted: DataFrame, least_words: int) -> DataFrame:
    """id, bag: element hashes of the records that stand in wanted (id_1, id_2), and of few others.

    What isn't wanted is dropped before the shuffle by a bitmap of hashed ids: 16 bits for each wanted pair, rounded up to
    a power of two, between 2^20 and 2^28 (32 MB); beyond, it lets more through, which the joins drop.
    """
    bits = 1 << min(28, max(20, (16 * wanted.count()).bit_length()))
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    spots = wanted.select(F.explode(F.array("id_1", "id_2")).alias("id")).select((h(F.col("id")) + 1).alias("h"))  # Spark's bitmaps count from 1
    chunks = spots.groupBy(F.bitmap_bucket_number("h").alias("c")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("b")).collect()
    bitmap = bytearray(bits // 8)
    for r in chunks:
        bitmap[(r["c"] - 1) * 4096 : r["c"] * 4096] = r["b"]
    full = np.frombuffer(bytes(bitmap), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, offsets = _elements(b.column("_words"))
            small = (e & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(small))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], names=["id", "bag"])

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        x = h.to_numpy(np.int64)
        return pd.Series((full[x // 8] >> (x % 8).astype(np.uint8)) & 1 == 1)

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("_t")).where(may(h(F.col("id"))))
    lists = rows.select("id", words_of(F.col("_t")).alias("_words")).where(F.size("_words") >= least_words)
    return lists.mapInArrow(run, "id long, bag array<int>")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8, least_words: int = 1, cfg: Banding | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives and the members that they stand for.

    Returns links (rep_1, rep_2, overlap), rep_1 < rep_2, between different bags of words of at least the threshold
    (words in both by words in either, each as often as it occurs), and members (id, rep) of the bags that several
    records share; a representative is the least id of its bag. Records with null id, null text or fewer words are left
    out; repeated rows count once; order, case and punctuation don't matter. cfg: Banding.at(threshold) by default, which
    finds 95 % of the pairs at the threshold and more of closer ones.
    """
    cfg = cfg or Banding.at(threshold)
    signed = cut(signatures(df, key, text, least_words, cfg))
    bags = signed.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.max("id").alias("_last"), F.min_by(F.struct("sketch", "keys"), "id").alias("s"))
    found = cut(candidates(bags.select("id", "s.sketch", "s.keys"), threshold, cfg))
    shared = bags.where("_last <> id").select("h1", "h2", "n", F.col("id").alias("rep"))
    members = cut(signed.select("id", "h1", "h2", "n").join(shared, ["h1", "h2", "n"]).select("id", "rep").distinct())
    drop_cut(signed)
    bag = cut(_bag(df, key, text, found, least_words))
    one = bag.select(F.col("id").alias("id_1"), F.col("bag").alias("bag_1"))
    two = bag.select(F.col("id").alias("id_2"), F.col("bag").alias("bag_2"))
    both = F.size(F.array_intersect("bag_1", "bag_2"))
    either = F.size("bag_1") + F.size("bag_2") - both
    measured = found.join(one, "id_1").join(two, "id_2").select("id_1", "id_2", both.alias("both"), either.alias("either"))
    links = measured.where(F.col("both") >= F.ceil(F.lit(threshold) * F.col("either") - F.lit(1e-9))).select(F.col("id_1").alias("rep_1"), F.col("id_2").alias("rep_2"), (F.col("both") / F.col("either")).alias("overlap")).distinct()  # records may be repeated
    return links, members


#: Members of one class that one task pairs with members of another.
SALTED = 2_000


def expanded_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """id_1, id_2 (id_1 < id_2): all pairs of records behind links and members, each once.

    Links and members say the same in less; this is for those who need the pairs. A class of n members is salted: its
    rows on one side are dealt to n / SALTED slices, and the other side goes to each of them.
    """
    size = members.groupBy("rep").agg(F.ceil(F.count("*") / F.lit(SALTED)).cast("int").alias("slices"))
    sized = members.join(size, "rep")
    m1 = members.select(F.col("rep").alias("r1"), F.col("id").alias("a"))
    dealt = sized.select(F.col("rep").alias("r1"), F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("s1"))
    everywhere = sized.select(F.col("rep").alias("r2"), F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s2"))
    left = links.join(m1, links["rep_1"] == F.col("r1"), "left").select(F.coalesce("a", "rep_1").alias("x"), "rep_2")
    left = left.join(size.withColumnRenamed("rep", "_r"), F.col("rep_2") == F.col("_r"), "left").select("x", "rep_2", F.coalesce(F.pmod(F.xxhash64("x"), F.col("slices")), F.lit(0)).cast("int").alias("s"))
    wide = left.join(everywhere, (F.col("rep_2") == F.col("r2")) & (F.col("s") == F.col("s2")), "left").select("x", F.coalesce("b", "rep_2").alias("y"))
    same = dealt.join(everywhere, (F.col("r1") == F.col("r2")) & (F.col("s1") == F.col("s2"))).where("a < b").select(F.col("a").alias("x"), F.col("b").alias("y"))
    return wide.unionByName(same).select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"))


def linked_classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """id, class_id, n_links of every record that has a copy: its bag's representative, and how many other records it is
    linked with. With links, this is the whole result: no class is expanded into pairs."""
    size = members.groupBy("rep").agg(F.count("*").alias("_n"))
    ends = links.select(F.explode(F.array(F.struct(F.col("rep_1").alias("rep"), F.col("rep_2").alias("other")), F.struct(F.col("rep_2").alias("rep"), F.col("rep_1").alias("other")))).alias("e")).select("e.*")
    n = size.select(F.col("rep").alias("_o"), F.col("_n").alias("_on"))
    reach = ends.join(n, F.col("other") == F.col("_o"), "left").groupBy("rep").agg(F.sum(F.coalesce("_on", F.lit(1))).alias("_out"))
    classes = reach.join(size, "rep", "full_outer").select("rep", (F.coalesce("_out", F.lit(0)) + F.coalesce("_n", F.lit(1)) - 1).alias("n_links"))
    mine = members.select(F.col("rep").alias("_m"), "id")
    return classes.join(mine, F.col("rep") == F.col("_m"), "left").select(F.coalesce("id", "rep").alias("id"), F.col("rep").alias("class_id"), "n_links")


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """id, group_id: connected groups of records, named by their least id; only records that have a copy.

    Least ids spread along links and, by pointer jumping, along earlier results, about log2(longest chain) rounds.
    """
    edges = cut(links.select(F.col("rep_1").alias("a"), F.col("rep_2").alias("b")))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("v"), "l"))
    while True:
        near = edges.join(label, F.col("b") == F.col("v")).groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, F.col("v") == F.col("a")).select("v", F.least("l", "m").alias("l"), (F.col("m") < F.col("l")).alias("c"))
        jump = step.select(F.col("v").alias("j"), F.col("l").alias("jl"))
        new = cut(step.join(jump, step["l"] == F.col("j"), "left").select("v", F.least("l", F.coalesce("jl", "l")).alias("l"), "c"))
        moved = new.where("c").limit(1).count()
        drop_cut(label)
        label = new.select("v", "l")
        label._cut_path = new._cut_path
        if not moved:
            break
    linked = members.select("id", "rep").join(label, F.col("rep") == F.col("v"), "left").select("id", F.coalesce("l", "rep").alias("group_id"))
    alone = label.join(members.select(F.col("rep").alias("_r")).distinct(), F.col("v") == F.col("_r"), "left_anti").select(F.col("v").alias("id"), F.col("l").alias("group_id"))
    return linked.unionByName(alone)
