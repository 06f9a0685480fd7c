"""Near duplicates: an exact n-gram Jaccard join with bitmap signatures.

A text's set is that of its lower-cased five-word shingles, as 64 bit hashes.
Two texts link when ``100 * |A & B| >= 75 * |A | B|``.

* Texts with equal sets are one class from the start; only classes are joined.
* All sets are ordered alike (shingles that are frequent within some run of
  texts last, else by hash). Linked sets share one of their first
  ``n - ceil(0.75 n) + 1`` shingles, so only classes that share such a key can
  link. The list of frequent shingles only orders; it decides nothing.
* Each class lives in one tile: its commonest key, its size band, and a salt
  that bounds the tile's residents, who meet first. Where a key fills several tiles, one
  class of each component found so far meets the others' on a higher level, until
  nothing more links. A class then visits the tiles of classes of other components that it
  shares a key with, where their sizes allow a link (of two such tiles the one
  with the lesser label), so every two classes that can link and aren't connected meet once.
* A tile first holds hashed bitmaps. Bit counts bound the overlap of two sets
  from above; classes without any pair within the bound are out. For the
  others the tile gets the sets, exact sorted-array intersection verifies
  pairs that aren't connected yet, and a spanning forest of the links comes
  out. Visitors stream past the residents, so a tile's memory is bounded.
* Components of the forests' links follow from star contraction.

Defined cases: null text and text without words have an empty set and link
with nothing; exact copies and repeated rows share a class; fewer than five
words make one shingle; an empty table gives an empty result; null ids are
kept as rows, whose class they don't represent if another id has it; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from halyard.operators.graphs import connected

from .storage import Scratch, bounded_batches, highest, sparing
from .text import U64, chunks, mix, shingle_sets

NUM, DEN = 75, 100
TILE = 1024
HOT_IN_RUN = 3
RUN_SHINGLES = 5_000_000
HOT_KEYS = 500_000
SALTS = 1024


def need(a, b):
    """The least intersection with which sets of these sizes link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_size(n: int) -> int:
    return n + 1 + (-NUM * n // DEN)


def _frequent(docs: DataFrame, scratch: Scratch) -> np.ndarray:
    """Upper halves of hashes that several of some 10,000 neighbouring texts have, those of most such runs first, some HOT_KEYS at most; they only order keys."""
    def often(parts):
        h = np.concatenate(parts)
        h.sort()
        found = np.unique(h[: 1 - HOT_IN_RUN][h[HOT_IN_RUN - 1 :] == h[: 1 - HOT_IN_RUN]])
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], names=["h"])

    def count(batches):
        parts, size = [], 0
        for b in batches:
            for chunk in chunks(b.column(0)):
                for s in shingle_sets(chunk):
                    parts.append((s >> U64(32)).astype(np.uint32))
                    size += len(s)
            if size > RUN_SHINGLES:
                yield often(parts)
                parts, size = [], 0
        if parts:
            yield often(parts)

    counts = scratch.keep(docs.select("text").mapInArrow(sparing(count), "h long").groupBy("h").agg(F.count("*").alias("n")))
    found = highest(counts, "n", "h", HOT_KEYS).select("h").toArrow()
    scratch.drop(counts)
    return np.sort(found.column(0).to_numpy().astype(np.uint32)) if found.num_rows else np.empty(0, np.uint32)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    np.bitwise_or.at(out, (s >> U64(3)).astype(np.int64) & (bits // 8 - 1), np.left_shift(np.uint8(1), (s & U64(7)).astype(np.uint8)))
    return out.view(U64)


def bitmap_bits(n: int) -> int:
    """A power of two of at least three times the size, 64 to 65536."""
    return int(min(1 << 16, max(64, 1 << (3 * n - 1).bit_length())))


def folded(maps: list[np.ndarray], words: int) -> np.ndarray:
    """The bitmaps at the width of ``words`` 64 bit words; wider ones are folded by OR, which only loosens the bound."""
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, words), axis=0) for m in maps])


def upper_bounds(x: np.ndarray, nx: int, ys: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """No intersection is larger: each bit that only one side has stands for an element that only it has."""
    return np.minimum(nx - np.bitwise_count(x & ~ys).sum(axis=1, dtype=np.int64), ny - np.bitwise_count(ys & ~x).sum(axis=1, dtype=np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


class Side:
    """Rows of a tile by rising size: ids, sizes, bitmaps and, in the second step, sets."""

    def __init__(self, cols: dict):
        self.s, self.n, self.c = cols["s"], cols["n"], cols["c"]
        self.sets = [np.frombuffer(x, U64) for x in cols["shingles"]] if "shingles" in cols else None
        self.maps = [np.frombuffer(x, U64) for x in cols["bits"]] if "bits" in cols else [bitmap(x, bitmap_bits(len(x))) for x in self.sets]
        self._at: dict[int, np.ndarray] = {}

    def at(self, words: int) -> np.ndarray:
        if words not in self._at:
            self._at[words] = folded(self.maps, words)
        return self._at[words]

    @property
    def words(self) -> int:
        return min(len(m) for m in self.maps)

    def within_bound(self, bits: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
        """Places lo..hi of rows that the bitmaps let link with a set."""
        words = min(self.words, len(bits))
        bound = upper_bounds(np.bitwise_or.reduce(bits.reshape(-1, words), axis=0), n, self.at(words)[lo:hi], self.n[lo:hi])
        return np.flatnonzero(bound >= need(n, self.n[lo:hi])) + lo


class Tile:
    """Residents of a tile and what is found about them; ``exact``: the second step."""

    def __init__(self, exact: bool):
        self.exact, self.parts, self.home, self.hits, self.links = exact, [], None, set(), []
        self.up: dict[int, int] = {}

    def residents(self, cols: dict) -> None:
        self.parts.append(cols)

    def settle(self) -> None:
        if self.home is not None or not self.parts:
            return
        cols = {c: [x for p in self.parts for x in p[c]] if isinstance(self.parts[0][c], list) else np.concatenate([p[c] for p in self.parts]) for c in self.parts[0]}
        self.home = Side(cols)
        for i in range(len(self.home.n) - 1) if not self.home.c.any() else ():  # those with components have met already
            end = int(np.searchsorted(self.home.n, self.home.n[i] * DEN // NUM, "right"))
            if end > i + 1:
                self.pairs(self.home, i, i + 1, end)

    def visitors(self, cols: dict) -> None:
        self.settle()
        if self.home is None:
            return
        side = Side(cols)
        for i in range(len(side.n)):
            lo, hi = np.searchsorted(self.home.n, -(-NUM * side.n[i] // DEN)), np.searchsorted(self.home.n, side.n[i] * DEN // NUM, "right")
            if hi > lo:
                self.pairs(side, i, int(lo), int(hi))

    def root(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def pairs(self, side: Side, i: int, lo: int, hi: int) -> None:
        near = self.home.within_bound(side.maps[i], int(side.n[i]), lo, hi)
        if side.c[i]:  # components known before: only others are of interest
            near = near[self.home.c[near] != side.c[i]]
        if not len(near):
            return
        a = int(side.s[i])
        if not self.exact:
            self.hits.add(a)
            self.hits.update(self.home.s[near].tolist())
            return
        for j in near.tolist():
            b = int(self.home.s[j])
            if self.root(a) != self.root(b) and overlap(side.sets[i], self.home.sets[j]) >= need(int(side.n[i]), int(self.home.n[j])):
                self.up[self.root(a)] = self.root(b)
                self.links.append((a, b))

    def close(self, label: int) -> pa.RecordBatch | None:
        self.settle()
        if self.exact:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in self.links], pa.int64()) for i in (0, 1)], names=["a", "b"]) if self.links else None
        return pa.RecordBatch.from_arrays([pa.array([label] * len(self.hits), pa.int64()), pa.array(sorted(self.hits), pa.int64())], names=["tile", "s"]) if self.hits else None


def _tiles(exact: bool):
    """Runs batches sorted by (tile, visitor, n, s) through their tiles."""
    def run(batches):
        label, tile = None, None
        for b in batches:
            if not len(b):
                continue
            cols = {c: b.column(c).to_pylist() if pa.types.is_binary(b.schema.field(c).type) else b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            t, v = cols["tile"], cols["visitor"]
            cuts = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (v[1:] != v[:-1])) + 1).tolist(), len(t)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if t[lo] != label:
                    if tile is not None and (out := tile.close(label)) is not None:
                        yield out
                    label, tile = int(t[lo]), Tile(exact)
                (tile.visitors if v[lo] else tile.residents)({c: x[lo:hi] for c, x in cols.items()})
        if tile is not None and (out := tile.close(label)) is not None:
            yield out
    return run


def set_id(s: np.ndarray) -> int:
    """A signed 64 bit id of a set of hashes; 0 for the empty one."""
    return int((mix(s).sum(dtype=U64) ^ mix(np.array([len(s)], U64))).view(np.int64)[0]) if len(s) else 0


def _sketch(hot):
    """(doc_id, s, n, prefix, rare, bits): set id, size, keys, how many of them come first as rare ones, and bitmap; texts with a set that the task has seen carry no keys again."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids, sizes, keys, rare, maps = [], [], [], [], []
            if len(seen) > 1_000_000:  # only spares work
                seen.clear()
            rank = hot.value
            for chunk in chunks(b.column(1)):
                for s in shingle_sets(chunk):
                    sid = set_id(s)
                    ids.append(sid)
                    sizes.append(len(s))
                    rare.append(0)
                    if not len(s) or sid in seen:
                        keys.append(None)
                        maps.append(None)
                        continue
                    maps.append(bitmap(s, bitmap_bits(len(s))).tobytes())
                    seen.add(sid)
                    p, first = prefix_size(len(s)), s
                    if len(rank):
                        half = (s >> U64(32)).astype(np.uint32)
                        often = rank[np.minimum(np.searchsorted(rank, half), len(rank) - 1)] == half
                        first = s[~often]
                        s = np.concatenate([first[:p], s[often][: max(p - len(first), 0)]])
                    keys.append(s[:p].tobytes())
                    rare[-1] = min(p, len(first))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rare, pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", "s", "n", "prefix", "rare", "bits"])
    return run


def _explode(batches):
    """(key, salt, s) of (s, prefix, rare): frequent keys have salts of 1 or more, others 0."""
    for b in batches:
        keys = [np.frombuffer(k, np.int64) for k in b.column(1).to_pylist()]
        sizes = np.array([len(k) for k in keys], np.int64)
        if sizes.sum():
            s, place = np.repeat(b.column(0).to_numpy(), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            salt = np.where(place < np.repeat(b.column(2).to_numpy(), sizes), 0, 1 + (s & (SALTS - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(salt), pa.array(s)], names=["key", "salt", "s"])


def _arrays(batches):
    """(s, shingles) of the representatives' texts."""
    done: set[int] = set()
    for b in batches:
        wanted, own, sets = b.column(0).to_pylist(), [], []
        for chunk in chunks(b.column(1)):
            for i, s in enumerate(shingle_sets(chunk), chunk.first):
                if wanted[i] not in done and len(s) and set_id(s) == wanted[i]:  # an id may stand on several texts
                    done.add(wanted[i])
                    own.append(i)
                    sets.append(s)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary())], names=["s", "shingles"])


def _classes(batches):
    """(s, text) of (doc_id, text)."""
    for b in batches:
        ids = [set_id(s) for chunk in chunks(b.column(1)) for s in shingle_sets(chunk)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column(1)], names=["s", "text"])


#: Ids of texts to fetch are broadcast up to this count (16 bytes each), beyond it the texts are joined by shuffle.
FETCH = 1_000_000


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) of every row; component_id is the least doc_id that links reach."""
    return _grouped(docs).drop("c")


def _grouped(docs: DataFrame) -> DataFrame:
    """The columns of near_duplicates, and c, the component's own label; null without words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    hot = spark.sparkContext.broadcast(_frequent(docs, scratch))
    sketch = scratch.keep(docs.mapInArrow(sparing(_sketch(hot)), f"doc_id {kind}, s long, n long, prefix binary, rare int, bits binary"))
    # keys of two different sets, and all frequent keys, whose rows would be too many for one task; copies that went through different tasks are the same row
    rows = sketch.where("prefix is not null").select("s", "prefix", "rare").mapInArrow(sparing(_explode), "key long, salt long, s long")
    spread = rows.selectExpr("key", "salt", "s", "min(s) over (partition by key, salt) lo", "max(s) over (partition by key, salt) hi").where("salt > 0 or lo != hi")
    shared = scratch.keep(spread.select("key", "salt", "s").distinct().drop("salt"))
    # of keys with the same classes one is enough
    same = shared.groupBy("key").agg(F.count("*").alias("k"), F.expr("bit_xor(xxhash64(s))").alias("x"), F.expr("bit_xor(xxhash64(s, 1))").alias("y"))
    keys = same.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key", "k")
    members = scratch.keep(sketch.select("doc_id", "s", "n"))
    reps = members.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    nameless = bool(reps.where("doc_id is null").limit(1).count()) if members.where("doc_id is null").limit(1).count() else False
    shared = scratch.keep(shared.join(keys, "key").join(reps.select("s", "n"), "s"), shared.count())
    n_shared = shared.count()
    pick = shared.groupBy("s", "n").agg(F.max(F.struct("k", "key")).alias("top")).select("s", "n", "top.key", "top.k")
    bits = scratch.keep(sketch.where("bits is not null").select("s", "bits").join(pick.select("s"), "s", "left_semi").dropDuplicates(["s"]))
    scratch.drop(sketch)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)))
    home = scratch.keep(pick.select("s", "n", F.xxhash64("key", band).alias("group"), F.xxhash64("key", band, F.pmod(F.xxhash64("s"), F.ceil(F.col("k") / TILE))).alias("home")), n_shared)
    order = ["tile", "visitor", "n", "s"]

    def links(where: DataFrame) -> DataFrame:
        """Spanning links of the tiles' residents with each other and with their visitors: bounds first, then sets."""
        hits = scratch.keep(where.join(bits, "s").repartition("tile").sortWithinPartitions(*order).mapInArrow(sparing(_tiles(exact=False)), "tile long, s long"))
        wanted = scratch.keep(reps.join(hits.select("s").distinct(), "s").select("doc_id", "s"), hits.count())
        fetch = F.broadcast(wanted) if wanted.count() <= FETCH else wanted
        texts = docs.join(fetch, "doc_id").select("s", "text")
        if nameless:  # classes without any id are fetched by the set itself
            own = docs.where("doc_id is null").select("doc_id", "text").mapInArrow(sparing(_classes), "s long, text string")
            texts = texts.unionByName(own.join(wanted.where("doc_id is null").select("s"), "s", "left_semi").dropDuplicates(["s"]))
        arrays = scratch.keep(texts.mapInArrow(sparing(_arrays), "s long, shingles binary"))
        out = scratch.keep(where.join(hits, ["tile", "s"]).join(arrays, "s").repartition("tile").sortWithinPartitions(*order).mapInArrow(sparing(_tiles(exact=True)), "a long, b long"))
        for done in (arrays, wanted, hits):
            scratch.drop(done)
        return out

    at_home = home.select("s", "n", F.col("home").alias("tile"), F.lit(False).alias("visitor"), F.lit(0).cast("long").alias("c"))
    found = links(at_home)
    comp = scratch.keep(connected(found, scratch))
    while True:
        # of a key and band that fill several tiles, one class of each component meets the others' in tiles of a higher level
        lead = home.join(comp.withColumnRenamed("v", "s"), "s", "left").groupBy("group", F.coalesce("c", "s").alias("c")).agg(F.min(F.struct("s", "n")).alias("r"), F.count_distinct("home").alias("tiles"))
        sizes = lead.groupBy("group").agg(F.count("*").alias("k"), F.max("tiles").alias("tiles")).where("tiles > 1 and k > 1")
        lead = scratch.keep(lead.join(sizes.select("group", "k"), "group").select(F.col("r.s").alias("s"), F.col("r.n").alias("n"), F.xxhash64("group", F.pmod(F.xxhash64("r.s", F.lit(1)), F.ceil(F.col("k") / TILE))).alias("tile"), F.lit(False).alias("visitor"), F.lit(0).cast("long").alias("c")))
        more = links(lead) if lead.limit(1).count() else None
        if more is None or not more.limit(1).count():
            break
        found = scratch.keep(found.unionByName(more))
        comp = scratch.keep(connected(found, scratch))
    placed = home.join(comp.withColumnRenamed("v", "s"), "s", "left").select("s", "home", F.coalesce("c", "s").alias("c"))
    placed_keys = scratch.keep(shared.join(placed, "s"), n_shared)
    # a key's largest component doesn't visit the tiles that hold nothing else, and a key of one component only is done with
    main = placed_keys.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    # both kept: no aggregate stands between the shuffles by key and the joins, so that Spark can split a key of many classes over tasks
    main = scratch.keep(main.drop("parts"), n_shared)
    housed = scratch.keep(placed_keys.join(main, "key"))
    for done in (placed_keys, main):
        scratch.drop(done)
    tiles = housed.groupBy("key", F.col("home").alias("tile"), "main").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))
    tiles = tiles.withColumn("pure", (F.col("c_lo") == F.col("main")) & (F.col("c_hi") == F.col("main"))).drop("main")
    callers = housed.withColumn("pure", F.explode(F.when(F.col("c") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    meets = (F.col("tile") < F.col("home")) & (NUM * F.col("n") <= DEN * F.col("most")) & (DEN * F.col("n") >= NUM * F.col("least")) & ((F.col("c_lo") != F.col("c")) | (F.col("c_hi") != F.col("c")))
    visits = scratch.keep(callers.join(tiles, ["key", "pure"]).where(meets).select("tile", "s", "n", "c").distinct())
    hosts = placed.join(home.select("s", "n"), "s").join(visits.select(F.col("tile").alias("home")).distinct(), "home", "left_semi")
    where = scratch.keep(hosts.select("s", "n", F.col("home").alias("tile"), F.lit(False).alias("visitor"), "c").unionByName(visits.select("s", "n", "tile", F.lit(True).alias("visitor"), "c")))
    found = scratch.keep(found.unionByName(links(where)))
    for done in (bits, where, visits, home, shared, housed):
        scratch.drop(done)
    comp = connected(found, scratch)
    least = reps.select("s", F.col("doc_id").alias("d")).join(comp.withColumnRenamed("v", "s"), "s", "left").select("s", "d", F.coalesce("c", "s").alias("c"))
    by_comp = least.groupBy("c").agg(F.min("d").alias("component_id"))
    label = least.join(by_comp, "c").select("s", "c", "component_id")
    return (members.join(label, "s", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("s")).alias("set_id"),
            F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "c"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each group: the rows whose id is the least of its component.

    Of rows that repeat an id one stays in each component. Rows without an id stay where no row with one is in their component, and share that fate.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    rows = scratch.keep(_grouped(docs).select("doc_id", "set_id", "component_id", "c"))
    groups = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # most documents stay, so the list of ids grows with the input: never broadcast
    if not rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.join(groups.select(F.col("doc_id").alias("_kept")).hint("merge"), docs["doc_id"].eqNullSafe(F.col("_kept")), "left_semi")
    # an id doesn't tell the row: id and set do; of a component's rows with its least id those with the least set
    named = groups.where("doc_id is not null").groupBy("doc_id", "c").agg(F.min("set_id").alias("set_id")).select("doc_id", "set_id")
    kept = named.unionByName(groups.where("doc_id is null").select("doc_id", "set_id").distinct())
    kept = kept.select(F.col("doc_id").alias("_kept"), F.coalesce("set_id", F.lit(0)).alias("_of"))
    names = docs.columns
    at = names.index("text")

    def tag(batches):
        for b in batches:
            ids = [set_id(s) for chunk in chunks(b.column(at)) for s in shingle_sets(chunk)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], names=[*names, "_set"])

    bounded_batches(docs.sparkSession)
    tagged = docs.mapInArrow(sparing(tag), StructType([*docs.schema.fields, StructField("_set", LongType())]))
    own = scratch.keep(tagged.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_set") == F.col("_of")), "left_semi"))
    return own.where("doc_id is not null").dropDuplicates(["doc_id", "_set"]).unionByName(own.where("doc_id is null")).drop("_set")
