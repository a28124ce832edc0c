"""N-gram Jaccard join: tiles of like size, bitmap bounds, exact intersections.

A text is the set of its word shingles, as sorted 64-bit hashes. Equal sets are
one class; the work is done on classes.

*Tiles.* Sets are banded by size; a set goes to the tile of its own band and to
those that larger partners can be in. Within a tile the hash range is cut into
more parts than two linked sets can differ in elements, so two linked sets have
at least one whole part in common, and a part that is not empty unless both
sets leave unusually many parts empty (such sets give their empty parts too).
The hashes of the parts are the keys on which sets of a tile meet. A part holds
several shingles, so a passage that many texts share is not a meeting place.

*Bounds.* A signature of 512 bits is toggled once per element. The bits in which
two signatures differ are at most the elements in which the sets differ, which
bounds the overlap from above. Sets so large that most bits of it differ between
any two have a second one of about a bit per element, for the pairs that pass the
first. Only pairs that pass get their sets intersected, as sorted arrays; they
travel as packed texts.

*No pairs of whole groups.* First every set of a meeting place is compared with
its first one; what this links is connected. Only meeting places that still hold
sets of different components compare the rest, block against block, and only
across components. The result is the components, so no link between different
texts is lost by comparing only what is not connected already.

*Texts travel by block.* Pairs to be intersected are dealt out by the components
they make and these by blocks, so a text goes once to each pair of blocks, not to
each partner. Texts that no pair needs are held back where they are read.

* NULL texts and texts without words have the empty set and are linked with
  nothing. A text with fewer words than a shingle is one shingle.
* Ties do not arise; repeated rows are one class. A NULL id takes part, but
  the smallest id of a component is one that is not NULL, if there is any.
* An empty table gives an empty result; other columns are ignored.
"""

import functools
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from seston.durable import Staged
from seston.llm.common import Sieve, components, let_go, over_texts, unused

WORDS = 3
#: linked if 100 * intersection >= PERCENT * union
PERCENT = 90
BITS = 512
LANES = BITS // 64
BLOCK = 512
#: sizes in a band: this many steps of the largest possible ratio of linked sizes
STEPS = 3
#: elements of the sets of a block whose pairs are intersected
BLOCK_ELEMENTS = 262_144
#: elements of sets a task keeps while it intersects pairs
KEPT = 4_000_000
#: keys of meeting places that a task counts and joins
KEYS_A_TASK = 400_000


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        total = mixed(total + h[k : k + n] + np.uint64(k + 1 + 16 * min(words, len(h))))
    return np.unique(total)


def most_apart(n: int, percent: int) -> int:
    """Elements in which a set of n and a larger set linked with it can differ."""
    return (100 - percent) * n // percent


@functools.cache
def band_start(band: int, percent: int) -> int:
    if band == 0:
        return 1
    before = band_start(band - 1, percent)
    return max(before + 1, math.ceil(before * (100 / percent) ** STEPS))


@functools.cache
def band_of(n: int, percent: int) -> int:
    band = 0
    while band_start(band + 1, percent) <= n:
        band += 1
    return band


@functools.cache
def parts_of(band: int, percent: int) -> int:
    """Parts of a tile: enough that even with some of them empty more are left
    than the largest set of the band can differ in."""
    n = band_start(band + 1, percent) - 1
    # no linked sets of at most n elements each differ in more
    apart = 2 * (100 - percent) * n // (100 + percent)
    if not apart:
        return 1
    likely = {}
    for k in range(apart + 1, 2 * apart + 8):
        empty = k * math.exp(-n / k)
        likely[k] = k - empty - 3 * math.sqrt(empty)
        if likely[k] >= apart + 1:
            return k
    return max(likely, key=likely.get)


def keys(elements: np.ndarray, percent: int) -> np.ndarray:
    """Meeting places of a set: a hash per tile and part."""
    n = len(elements)
    if not n:
        return elements
    apart = most_apart(n, percent)
    spread = mixed(elements + np.uint64(0x9E3779B97F4A7C15))
    out = []
    for band in range(band_of(n, percent), band_of(n + apart, percent) + 1):
        k = parts_of(band, percent)
        part = ((elements >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.add.reduceat(spread, first)
        full = part[first]
        if len(full) <= apart and len(full) < k:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), full)
            full, sums = np.r_[full, empty], np.r_[sums, np.zeros(len(empty), np.uint64)]
        out.append(mixed(sums ^ mixed(full + np.uint64((band + 1) << 40))))
    return np.concatenate(out)


def signature(elements: np.ndarray) -> np.ndarray:
    odd = np.bincount((elements & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_signature(elements: np.ndarray) -> np.ndarray | None:
    """A signature of two thirds to four thirds of a bit per element, a power of
    two; None if it is no longer than the other one. Its halves, one toggled by
    the other, are the signature of half the length."""
    bits = 1 << max(0, (4 * len(elements) // 3).bit_length() - 1)
    if bits <= BITS:
        return None
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketched(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """doc_id, mark (hash of the text), n, d1, d2 (digest of the set), signature
    lanes b0.., the long signature, keys and their number."""

    def make():
        let_go()

        def work(texts: list) -> dict[str, pa.Array]:
            sets = [shingle_set(t, words) for t in texts]
            out = {"n": pa.array([len(s) for s in sets], pa.int64())}
            for name, salt in (("d1", 1), ("d2", 2)):
                sums = [int(mixed(s + np.uint64(salt)).sum()) for s in sets]
                out[name] = pa.array(np.array(sums, np.uint64).view(np.int64))
            lanes = np.array([signature(s) for s in sets]).reshape(len(sets), LANES)
            for i in range(LANES):
                out[f"b{i}"] = pa.array(lanes[:, i])
            out["long"] = pa.array([long_signature(s) for s in sets], pa.list_(pa.int64()))
            each = [keys(s, percent) for s in sets]
            ends = np.cumsum([0] + [len(k) for k in each]).astype(np.int32)
            values = np.concatenate(each).astype(np.uint64).view(np.int64)
            out["keys"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            out["n_keys"] = pa.array([len(k) for k in each], pa.int64())
            return out

        return work

    lanes = ", ".join(f"b{i} bigint" for i in range(LANES))
    mark = F.xxhash64(F.col(text)).alias("mark")
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), mark, F.col(text).alias("text"))
    return over_texts(base, "text", make, f"n bigint, d1 bigint, d2 bigint, {lanes}, long array<bigint>, keys array<bigint>, n_keys bigint")


def dealt_by_key(places: DataFrame, total: int) -> DataFrame:
    """``places``, at most ``total`` rows, in parts that fit a task: the maps and
    sorts of the count and the join by key take some 300 bytes of heap a row."""
    return places.repartition(max(1, math.ceil(total / KEYS_A_TASK)), "key")


def linked(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * inter >= percent * (a + b - inter)


def apart_at_least(x: Column, y: Column) -> Column:
    """Bits in which two long signatures differ, NULL if one is missing. Of two
    lengths the longer one is folded; more than twice as long says nothing."""
    size = F.least(F.size(x), F.size(y))

    def lane(of: Column, i: Column) -> Column:
        return F.when(F.size(of) == size, F.get(of, i)).otherwise(F.get(of, i).bitwiseXOR(F.get(of, i + size)))

    differ = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda sum_, i: sum_ + F.bit_count(lane(x, i).bitwiseXOR(lane(y, i))))
    return F.when(x.isNotNull() & y.isNotNull() & (F.greatest(F.size(x), F.size(y)) <= 2 * size), differ)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and signatures of two rows allow a link."""
    differ = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(1, LANES)),
                 F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = F.greatest(differ.cast("bigint"), F.abs(na - nb))
    return linked(F.floor((na + nb - least) / 2), na, nb, percent)


def linked_members(words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The linked pairs (a, b) of rows (g, i, j, id, other, packed) in the order
    of the cells (g, i, j): first the packed texts of a cell, without ``other``,
    then its pairs of an id and an other. The sets last met, up to ``KEPT``
    elements, are not made again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        unpack = zstandard.ZstdDecompressor().decompress
        texts: dict[int, bytes] = {}
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        held, cell = 0, None

        def elements(key: int) -> np.ndarray:
            nonlocal held
            if key in known:
                known.move_to_end(key)
                return known[key]
            if key not in texts:
                raise RuntimeError("a text is gone that was there before")
            found = known[key] = shingle_set(unpack(texts[key]).decode("utf-8", "surrogatepass"), words)
            held += len(found)
            while held > KEPT and len(known) > 1:
                held -= len(known.popitem(last=False)[1])
            return found

        def common(x: np.ndarray, y: np.ndarray) -> int:
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            return int((y[np.minimum(at, len(y) - 1)] == x).sum())

        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("g", "i", "j", "id", "other")]
            for row, (*here, a, b) in enumerate(zip(*columns, strict=True)):
                if here != cell:
                    cell = here
                    texts.clear()
                if b is None:
                    texts[a] = batch.column("packed")[row].as_py()
                    continue
                x, y = elements(a), elements(b)
                shared = common(x, y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    found.append((a, b))
            ends = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return run


class Join:
    """State of one join: the sketches and the classes of equal sets."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int, percent: int):
        self._docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        self._words, self._percent = words, percent
        rows = sketched(docs, doc_id, text, words, percent).withColumn("row", F.monotonically_increasing_id())
        self._wide = Staged(rows)
        # the keys are by far the largest part and are dropped once they are dealt out
        self.rows = Staged(self._wide.df.drop("keys"))
        same = ["n", "d1", "d2"]
        self.classes = Staged(
            self.rows.df.where("n > 0").groupBy(*same).agg(
                F.min("row").alias("id"),
                F.min("doc_id").alias("least"),
                F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "mark")).alias("first"),
            )
        )

    def named(self) -> DataFrame:
        """The classes, each with the id ``c`` of its component."""
        lanes = [f"b{i}" for i in range(LANES)]
        ids = self.classes.df.select("id")
        of_class = lambda t: t.withColumnRenamed("row", "id").join(ids, "id", "left_semi")
        small = of_class(self.rows.df).select("id", "doc_id", "mark", "n", *lanes, "long")
        # dealt by key once: the count and the join below read the same shuffle
        total = self.rows.df.agg(F.sum("n_keys")).first()[0] or 0
        # most rows are the first of their class, as the sieve shows without moving their keys
        repeats = Staged(self.rows.df.where("n > 0").join(ids, F.col("row") == F.col("id"), "left_anti").select(F.xxhash64("row").alias("h")))
        sieve = Sieve(repeats.df)
        doubtful, clear = sieve.parted(self._wide.df.select("row", "keys"), F.xxhash64("row"))
        places = of_class(doubtful).unionByName(clear.withColumnRenamed("row", "id"))
        places = dealt_by_key(places.select("id", F.explode("keys").alias("key")), total)
        shared = places.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).where("members > 1")
        met = Staged(places.join(shared, "key"))
        for table in (self._wide, repeats, sieve):
            table.drop()
        stars = met.df.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        alike = Staged(self.bounded(stars, small))
        # one pair for each set that is not a first one; the others are compared
        # only where that left their ends apart
        lead = alike.df.groupBy("b").agg(F.min("a").alias("a"))
        first = [Staged(self.verified(lead.select("a", "b"), small))]
        part = Staged(components(first[0].df))
        of = lambda c: part.df.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
        apart = F.coalesce("_a", "a") != F.coalesce("_b", "b")
        others = alike.df.join(lead, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        first.append(Staged(self.verified(others.where(apart).select("a", "b"), small)))
        alike.drop()
        part.drop()
        linked_pairs = first[0].df.unionByName(first[1].df)
        part = components(linked_pairs)
        whole = Staged(
            met.df.where("members > 2").join(part, "id", "left").select(
                "key", "id", "members", F.coalesce("component", "id").alias("c")
            )
        )
        met.drop()
        mixed_places = whole.df.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
        rest = whole.df.join(mixed_places, "key", "left_semi")
        second = Staged(self.verified(self.across(rest, small), small))
        whole.drop()
        part = components(linked_pairs.unionByName(second.df))
        for table in (*first, second):
            table.drop()
        return self.classes.df.join(part, "id", "left").withColumn("c", F.coalesce("component", "id"))

    def representatives(self) -> DataFrame:
        """doc_id and mark of one row of each component: its smallest id, and
        of this the smallest hash of a text."""
        first = self.named().groupBy("c").agg(F.min("first").alias("first"))
        return first.select("first.doc_id", "first.mark")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        named = self.named()
        least = named.groupBy("c").agg(F.min("least").alias("component_id"))
        answer = named.join(least, "c").select("n", "d1", "d2", "component_id")
        rows = self.rows.df.select("doc_id", "n", "d1", "d2").join(answer, ["n", "d1", "d2"], "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))

    def across(self, rest: DataFrame, small: DataFrame) -> DataFrame:
        """Pairs of different components that meet and may link. A place is cut
        into blocks; two blocks are compared under a key of their own."""
        lanes = [f"b{i}" for i in range(LANES)]
        rest = rest.join(small.select("id", "n", *lanes), "id")
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        rest = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        left = rest.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
        right = rest.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block"))))
        a, b = left.alias("a"), right.alias("b")
        on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "i", "j")]
        once = (F.col("a.i") < F.col("a.j")) | (F.col("a.id") < F.col("b.id"))
        condition = functools.reduce(lambda x, y: x & y, on) & (F.col("a.c") != F.col("b.c")) & once
        pairs = a.join(b, condition & may_link("a", "b", self._percent))
        pairs = pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
        return self.narrowed(pairs, small)

    def bounded(self, pairs: DataFrame, small: DataFrame) -> DataFrame:
        """The pairs (a, b) of class ids whose sizes and signatures allow a link."""
        lanes = [f"b{i}" for i in range(LANES)]
        narrow = small.select("id", "n", *lanes)
        x, y = narrow.alias("x"), narrow.alias("y")
        pairs = (
            pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
            .where(may_link("x", "y", self._percent))
            .select("a", "b")
        )
        return self.narrowed(pairs, small)

    def narrowed(self, pairs: DataFrame, small: DataFrame) -> DataFrame:
        """The pairs whose long signatures allow a link, or that lack one."""
        long = small.where(F.col("long").isNotNull())
        for c in ("a", "b"):
            pairs = pairs.join(long.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("long").alias(f"long_{c}")), c, "left")
        differ = apart_at_least(F.col("long_a"), F.col("long_b")).cast("bigint")
        may = linked(F.floor((F.col("n_a") + F.col("n_b") - differ) / 2), F.col("n_a"), F.col("n_b"), self._percent)
        return pairs.where(F.coalesce(may, F.lit(True))).select("a", "b")

    def verified(self, pairs: DataFrame, small: DataFrame) -> DataFrame:
        """The pairs (a, b) of class ids that are linked; all passed the bounds.

        The ids of a component of the pairs are dealt into blocks, its pairs into
        cells of two blocks. A text goes straight to the cells that need it."""
        kept = Staged(pairs)
        near = Staged(components(kept.df).join(small.select("id", "n"), "id"))
        blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_ELEMENTS), F.ceil(F.count("*") / BLOCK)).alias("blocks")
        dealt = near.df.join(near.df.groupBy("component").agg(blocks), "component")
        dealt = Staged(dealt.select("id", F.col("component").alias("g"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("k")))
        of_a = dealt.df.select(F.col("id").alias("a"), "g", F.col("k").alias("_a"))
        of_b = dealt.df.select(F.col("id").alias("b"), F.col("k").alias("_b"))
        cell = ["g", F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j")]
        cells = Staged(kept.df.join(of_a, "a").join(of_b, "b").select(*cell, "a", "b"))
        for table in (kept, near, dealt):
            table.drop()
        ends = cells.df.select("g", "i", "j", F.explode(F.array("a", "b")).alias("id")).distinct()
        of = Staged(small.select("id", F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).join(ends, "id"))
        sieve = Sieve(of.df.select(F.xxhash64("_doc", "_mark").alias("h")))
        docs, _ = sieve.parted(self._docs, F.xxhash64("doc_id", F.xxhash64("text")))
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_mark"))
        texts = docs.join(of.df, same).select("g", "i", "j", "id", "text")

        def make():
            let_go()
            pack = zstandard.ZstdCompressor(level=3).compress

            def work(texts: list) -> dict[str, pa.Array]:
                packed = [pack((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                return {"packed": pa.array(packed, pa.binary())}

            return work

        # packed texts are much smaller than their sets, of which each element is eight random bytes
        packed = over_texts(texts, "text", make, "packed binary")
        rows = packed.withColumn("other", F.lit(None).cast("bigint")).unionByName(
            cells.df.select("g", "i", "j", F.col("a").alias("id"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("packed"))
        )
        rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", F.col("other").isNotNull(), "id", "other")
        return rows.mapInArrow(linked_members(self._words, self._percent), "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row (see the module)."""
    return Join(docs, doc_id, text, words, percent).run()


def one_per_component(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row of ``docs`` of each component, with its columns of any name: a
    row of the smallest id, NULL last; of several texts of that id the one of
    the smallest hash, of equal ones the one whose columns have the smallest
    hash. Rows without words are linked with nothing, so each of them stays."""
    join = Join(docs, doc_id, text, words, percent)
    chosen = Staged(join.representatives())
    keep = chosen.df.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    rows = join.rows.df.where("n > 0").select("doc_id", "mark")
    # rows that agree in id and text are one component, of which one row stays
    several = rows.join(keep, same, "left_semi").groupBy("doc_id", "mark").count().where("count > 1").drop("count")
    several = Staged(several)
    gone = rows.join(keep, same, "left_anti")
    hashed = Staged(gone.unionByName(several.df).select(F.xxhash64("doc_id", "mark").alias("h")))
    join.rows.drop()
    join.classes.drop()
    its_id, its_mark = F.col(f"`{doc_id}`").cast("bigint"), F.xxhash64(F.col(f"`{text}`"))
    has_words = F.coalesce(F.col(f"`{text}`").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    mark = unused("_of", docs)
    keep = chosen.df.select(F.struct("doc_id", "mark").alias(mark))
    same = its_id.eqNullSafe(F.col(mark)["doc_id"]) & (its_mark == F.col(mark)["mark"])
    # rows without words and rows that are certain to stay are not moved; NULL is the hash of the former
    doubtful, clear = Sieve(hashed.df).parted(docs, F.when(has_words, F.xxhash64(its_id, its_mark)))
    hashed.drop()
    kept = doubtful.join(keep, same, "left_semi")
    place = [its_id.alias("id"), its_mark.alias("mark")]
    repeated = several.df.select(F.struct(F.col("doc_id").alias("id"), "mark").alias(mark))
    if not repeated.isEmpty():
        again = its_id.eqNullSafe(F.col(mark)["id"]) & (its_mark == F.col(mark)["mark"])
        plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        once = kept.join(repeated, again, "left_semi").groupBy(*place).agg(F.min_by(whole, F.xxhash64(*plain)).alias("row"))
        kept = kept.join(repeated, again, "left_anti").unionByName(once.select("row.*"))
    return kept.unionByName(clear)
