"""Grouping of spelling variants by a trie of letter-group counts.

A word is arranged by its length and then by how many of its letters lie in each
of ``LEVELS`` groups, one group a level: a trie of frequency vectors. Words one
letter apart differ by at most a surplus of one in one group and a deficit of one
in another, so a depth-first search that may spend one of each visits every
near word's leaf; what it finds in a leaf is verified letter by letter.

To find each pair once, the shorter word visits the longer one (it spends a
surplus only), and of two words of one length the one that spends its surplus
before its deficit visits; words of one leaf are compared in word order.

*Spark walks the top of the trie.* A node with more than ``MOST`` words is opened,
one level of all such nodes a round; words go to the children that their budget
allows. Nodes that stay closed are searched in tasks, each below its own node. A
node with very many visitors is searched by several tasks that share them out,
and one that is still too large below the last level is cut into blocks of which
each is compared with all its visitors, so no link is lost and no task holds more
than a few ``MOST`` words. A task returns one row per word with near words, not
pairs.

* NULL texts have no words. A NULL id is written as an empty text in what is
  hashed. Repeated rows count as often as they are there.
* Equally frequent near words: the first in code-point order is the form.
* Whole texts of any length; other columns are ignored; an empty table gives an
  empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seston.durable import Staged

SHORTEST, FEWEST, RATIO, EVERY = 7, 2, 10, 31
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
LEVELS = 16
#: frequent letters first, so that the first levels tell words apart best
ORDER = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
GROUPS = [ORDER[i::LEVELS] for i in range(LEVELS)]
MOST = 20_000
LEAF = 32
#: what a search may still spend: both, a deficit, a surplus, nothing
BOTH, DEFICIT, SURPLUS, NOTHING = 0, 1, 2, 3


def word_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """word, n: runs of letters, one in ``EVERY`` (by a hash of id and run) with
    a letter left out, of ``SHORTEST`` letters and found ``FEWEST`` times at least."""
    long = F.filter(F.regexp_extract_all(F.translate(F.col(text), CAPITALS, SMALL), F.lit(RUN), 0), lambda r: F.length(r) >= SHORTEST)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(long).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)


def in_group(word: str, level: int) -> Column:
    return (F.length(word) - F.length(F.translate(word, GROUPS[level], ""))).cast("int")


def child(node: str, count: Column) -> Column:
    return F.concat(node, F.lit("."), count.cast("string"))


def placed(words: DataFrame, most: int = MOST) -> Staged:
    """Rows (node, depth, budget, own, word, n) of closed nodes: the words of
    each node and those that visit it, written to the shared folder."""
    length = F.length("word")
    start = words.select(
        "word", "n",
        F.explode(F.array(
            F.struct(length.cast("string").alias("node"), F.lit(BOTH).alias("budget")),
            F.struct((length + 1).cast("string").alias("node"), F.lit(SURPLUS).alias("budget")),
        )).alias("to"),
    ).select("to.node", F.lit(0).alias("depth"), "to.budget", "word", "n")
    current, closed = Staged(start), []
    for level in range(LEVELS + 1):
        own = F.col("budget") == BOTH
        counts = current.df.groupBy("node").agg(F.count_if(own).alias("members"), F.count("*").alias("rows")).where("members > 0")
        sized = Staged(current.df.join(counts, "node"))
        current.drop()
        large = F.col("members") > most if level < LEVELS else F.lit(False)
        closed.append(sized)
        if sized.df.where(large).isEmpty():
            break
        c = F.col("c")
        option = lambda count, budget, when: F.when(when, F.struct(count.alias("count"), F.lit(budget).alias("budget")))
        b = F.col("budget")
        options = F.array_compact(F.array(
            F.struct(c.alias("count"), b.alias("budget")),
            option(c + 1, DEFICIT, b == BOTH), option(c + 1, NOTHING, b == SURPLUS), option(c - 1, NOTHING, (b == DEFICIT) & (c > 0)),
        ))
        stepped = sized.df.where(large).withColumn("c", in_group("word", level)).withColumn("to", F.explode(options))
        current = Staged(
            stepped.select(child("node", F.col("to.count")).alias("node"), F.lit(level + 1).alias("depth"), "to.budget", "word", "n")
        )
    small = [t.df.where(F.col("members") <= most) if t is not closed[-1] else t.df for t in closed]
    done = Staged(reduce(DataFrame.unionByName, small))
    for t in closed:
        t.drop()
    return done


class Trie:
    """Depth-first search below one node for all its visitors at once."""

    def __init__(self, words: list[str], member: np.ndarray, query: np.ndarray, budget: np.ndarray):
        """``words`` sorted and distinct; ``member`` and ``query`` are indexes
        into them, ``budget`` is that of each query."""
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.length.max())
        codes = np.zeros((len(words), width), np.uint8)
        codes[np.arange(width) < self.length[:, None]] = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.codes = codes
        self.ends = np.zeros_like(codes)  # the same words set to the right
        at = np.arange(width)
        inside = at >= width - self.length[:, None]
        self.ends[inside] = codes[at < self.length[:, None]]
        group = np.full(256, LEVELS, np.uint8)
        for k, letters in enumerate(GROUPS):
            group[[ord(c) for c in letters]] = k
        grouped = group[codes]
        grouped[codes == 0] = LEVELS
        self.counts = np.stack([(grouped == k).sum(1) for k in range(LEVELS)], 1).astype(np.int16)
        order = np.lexsort(self.counts[member].T[::-1])
        self.member = member[order]
        self.vectors = self.counts[self.member]
        self.query, self.budget = query, budget
        self.found: list[np.ndarray] = []

    def pairs(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        stack = [(0, len(self.member), depth, np.arange(len(self.query)), self.budget)]
        while stack:
            lo, hi, level, q, budget = stack.pop()
            if hi - lo <= LEAF or level == LEVELS:
                for a in range(0, len(q), 4096):
                    for b in range(lo, hi, 4096):
                        self.verify(b, min(b + 4096, hi), q[a : a + 4096], budget[a : a + 4096])
                continue
            column = self.vectors[lo:hi, level]
            if column[0] == column[-1]:
                starts = np.array([0, hi - lo])
            else:
                starts = np.r_[0, np.flatnonzero(np.diff(column)) + 1, hi - lo]
            its = self.counts[self.query[q], level]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                c = int(column[a])
                same, more, less = its == c, its == c - 1, its == c + 1
                more &= (budget == BOTH) | (budget == SURPLUS)
                less &= budget == DEFICIT
                go = same | more | less
                if go.any():
                    left = np.where(same, budget, np.where(more & (budget == BOTH), DEFICIT, NOTHING))[go]
                    stack.append((lo + int(a), lo + int(b), level + 1, q[go], left))
        both = np.concatenate(self.found) if self.found else np.empty((0, 2), np.int64)
        return both[:, 0], both[:, 1]

    def verify(self, lo: int, hi: int, q: np.ndarray, budget: np.ndarray) -> None:
        """Compare queries with the words of a leaf, letter by letter where the vectors allow."""
        words, leaf = self.query[q], self.member[lo:hi]
        apart = np.zeros((len(q), hi - lo), np.int16)
        for k in range(LEVELS):
            apart += np.abs(self.counts[words, k][:, None] - self.vectors[lo:hi, k])
        longer = self.length[leaf] - self.length[words][:, None]
        may = (apart <= 2) & ((longer == 0) | (longer == 1) & (apart <= 1))
        may &= (budget != BOTH)[:, None] | (words[:, None] < leaf)
        i, j = np.nonzero(may)
        u, v = words[i], leaf[j]
        one = longer[i, j] == 1
        differ = self.codes[u] != self.codes[v]
        good = ~one & (differ.sum(1) == 1)
        # one letter more: what agrees from the left and from the right covers the shorter word
        if one.any():
            w = np.flatnonzero(one)
            left = np.argmax(differ[w], 1)
            right = np.argmax((self.ends[u[w]] != self.ends[v[w]])[:, ::-1], 1)
            good[w] = left + right >= self.length[u[w]]
        if good.any():
            self.found.append(np.stack([u[good], v[good]], 1))


RESULT = "word string, near bigint, best_n bigint, best string"


def search(table: pa.Table) -> pa.Table:
    """Near words of a node: for every word that has some, their number and the
    most frequent one."""
    words, at = np.unique(np.array(table.column("word").to_pylist(), object), return_inverse=True)
    n = np.zeros(len(words), np.int64)
    n[at] = table.column("n").to_numpy()
    query = table.column("asks").to_numpy(zero_copy_only=False)
    trie = Trie(words.tolist(), at[~query], at[query], table.column("budget").to_numpy()[query].astype(np.int64))
    u, v = trie.pairs(int(table.column("depth")[0].as_py()))
    u, v = np.r_[u, v], np.r_[v, u]
    order = np.lexsort((v, -n[v], u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.empty(0, np.int64)
    return pa.table({
        "word": pa.array(words[u[first]].tolist(), pa.string()),
        "near": pa.array(np.diff(np.r_[first, len(u)]), pa.int64()),
        "best_n": pa.array(n[v[first]], pa.int64()),
        "best": pa.array(words[v[first]].tolist(), pa.string()),
    })


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n_near, best, best_n for all words of ``words`` (word, n) that
    have a near word."""
    rows = placed(words, most).df
    own = F.col("budget") == BOTH
    # shares of visitors and blocks of words; the latter only below the last level
    rows = rows.withColumn("shares", F.ceil(F.col("rows") / (8 * most)).cast("int")).withColumn(
        "blocks", F.ceil(F.col("members") / most).cast("int")
    )
    hashed = F.xxhash64("word")
    asking = rows.withColumn("share", F.pmod(hashed, "shares").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = rows.where(own).withColumn("block", F.pmod(hashed, "blocks").cast("int")).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    )
    columns = ["node", "share", "block", "depth", "budget", "word", "n"]
    both = asking.select(*columns, F.lit(True).alias("asks")).unionByName(asked.select(*columns, F.lit(False).alias("asks")))
    found = both.groupBy("node", "share", "block").applyInArrow(search, RESULT)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n")
    )


def followed(forms: DataFrame) -> Staged:
    """word, root: the last form that is reached from each word of ``forms``
    (word, form). A form is at least ``RATIO`` times as frequent as its word, so
    there are no circles, and each round doubles the steps taken. At most as many
    words as there are words one letter away share a form, so no key is hot."""
    current = Staged(forms.select("word", F.col("form").alias("root")))
    while True:
        after = current.df.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = current.df.join(after, F.col("root") == F.col("_word"), "left")
        fresh = Staged(step.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        current.drop()
        if fresh.df.where("moved").isEmpty():
            return fresh
        current = fresh


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    words = Staged(word_counts(docs, doc_id, text)).df
    near = near_words(words, most)
    frequent = F.col("best_n") >= RATIO * F.col("n")
    named = Staged(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n"),
        )
    ).df
    roots = followed(named.where("form IS NOT NULL")).df.select("word", "root")
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: the same rows in SQL: words that agree when a letter of one or both is left out
SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
r AS (
  SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-zÀ-ÿ]{7,}'))) AS run FROM documents),
b AS (
  SELECT DISTINCT run, id, hex(encode(id || ':' || run)) AS x FROM r),
h AS (
  SELECT run, id, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
           lambda c, v: xor(t[xor(c, v) % 256 + 1], c // 256))) AS h FROM b, t),
o AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run
  FROM documents),
c AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM o JOIN h USING (id, run)),
w AS (SELECT word, count(*) AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM d x JOIN d y USING (part, i) WHERE x.word <> y.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.part = w.word
  UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.part = w.word),
g AS (
  SELECT word, n, count(*) AS n_near, max(other_n) AS most,
         arg_min(other, struct_pack(a := -other_n, b := other)) AS best FROM p GROUP BY word, n),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN best END AS form,
         CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM w LEFT JOIN g USING (word)),
s AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON f.word = s.word JOIN f z ON z.word = s.root WHERE z.form IS NULL"""
