"""Exact n-gram Jaccard self-join through a token-group matrix.

Similar documents are partitioned into groups, each group stores the union of its members' signature tokens (a row of the
token-group matrix for each token), the overlap of a query with that union bounds the overlap with every member, and only
groups whose bound reaches what the threshold needs are opened and compared exactly.

* A document is the set of its distinct ``width``-word shingles (64-bit hashes). Equal sets collapse to one representative.
* A global token order puts frequent tokens last: counts come from one sketch summed over the whole corpus, so that a line
  shared by a third of all documents does not make them candidates of each other. The order changes cost, never results.
* A signature is the first ``n - ceil(t n) + 1`` tokens of a set in that order. Two linked sets share a number of signature
  tokens that grows with their sizes (`needed`): the bound that groups have to reach.
* Groups are trees of stars: every document joins the pivot (smallest id of a token) with which it shares most signature tokens.
* Members linked to their pivots form components first; opened groups are then compared only where that leaves members of
  different components, so large families of near copies need no pairs among themselves, and no link that could still
  connect anything is skipped.

Null, empty and white-space texts have an empty set and link with nothing (``component_id`` is their own id). Rows that share an
id, or have none, are documents of their own: they are told apart by id and text, a component's id is the smallest id of its
rows that have one (null without any), and equal rows are one document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.llm.common import components, discard, in_batches, joined, mixed, named, runs, stored, utf8, words

SKETCH_BITS = 22
#: Bits of the bitmap that tells which documents' whole sets are needed.
ID_BITS = 24
#: Tokens whose sketch bucket counts so many documents more than the mean bucket are joined where adaptive execution can split a key.
HOT = 2048
#: Documents of a side that one task compares at a time.
BLOCK = 128
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: list[bytes], width: int):
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, without words none."""
    for lo, hi in runs(texts):
        data, begin = joined(texts[lo:hi])
        start, _, h = words(data)
        cut = np.searchsorted(start, begin)
        for i in range(hi - lo):
            w = h[cut[i] : cut[i + 1]]
            if not len(w):
                yield w
            elif len(w) < width:
                total = np.array([len(w)], np.uint64)
                for k in range(len(w)):
                    total = total + w[k : k + 1] * _C[k]
                yield mixed(total)
            else:
                total = np.zeros(len(w) - width + 1, np.uint64)
                for k in range(width):
                    total += w[k : len(w) - width + 1 + k] * _C[k]
                yield np.unique(mixed(total))


#: Tables that one task of a tree of sums reads.
FAN_IN = 8
_PART = T.StructType([T.StructField("part", T.BinaryType())])


def _packed(table: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"part": [zstandard.compress(table.tobytes(), 1)]})


def _summed(parts: DataFrame, none: np.ndarray, add) -> np.ndarray:
    """One table from compressed ones, by a tree: no task reads more than ``FAN_IN`` of them, however many there are."""

    def merge(batches):
        total = None
        for pdf in batches:
            for b in pdf["part"]:
                x = np.frombuffer(zstandard.decompress(b), none.dtype)
                total = x.copy() if total is None else add(total, x)
        if total is not None:
            yield _packed(total)

    first = stored(parts, "sketch-parts")
    n, parts = first.count(), first
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = in_batches(parts.repartition(n), merge, _PART)
    rows = in_batches(parts.repartition(1), merge, _PART).collect()  # one table of fixed size
    discard(first)
    return np.frombuffer(zstandard.decompress(rows[0][0]), none.dtype) if rows else none


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """In how many documents the tokens of each hash bucket occur: fixed size, whole corpus."""
    none = np.zeros(1 << SKETCH_BITS, np.uint32)

    def count(batches):
        total = none.copy()
        for pdf in batches:
            for s in shingle_sets(utf8(pdf["text"]), width):
                place, m = np.unique((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                total[place] = np.minimum(total[place].astype(np.uint64) + m.astype(np.uint64), 2**32 - 1)
        yield _packed(total)

    return _summed(in_batches(docs.select("text"), count, _PART), none, lambda a, b: np.minimum(a.astype(np.uint64) + b, 2**32 - 1).astype(np.uint32))


def needed(n: F.Column, lo: F.Column, hi: F.Column, percent: int) -> F.Column:
    """Signature tokens that a set of ``n`` shares at least with any linked set of ``lo`` to ``hi`` tokens."""
    t = percent
    small = F.greatest(lo, F.ceil(n * t / 100))
    large = F.least(hi, F.floor(n * 100 / t))
    overlap = lambda m: F.ceil((n + m) * t / (100 + t))
    short = lambda m: overlap(m) - F.ceil(m * t / 100) + 1
    # where the larger set's signature ends first, the bound falls with its size, but for steps up by 1 that the two roundings
    # make: the least value is at most so many sizes below the largest
    near = -(-100 * (100 + t) // (t * t))
    least = [short(F.greatest(small, large - j)) for j in range(near)]
    return F.greatest(F.lit(1), F.least(overlap(small) - F.ceil(n * t / 100) + 1, *least))


def signatures(docs: DataFrame, width: int, percent: int, order) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, signature, hot): a 128-bit key of the set, its signature tokens in the order of ``order``, and
    those of them that many documents have."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, signature array<long>, hot array<long>"

    def sign(batches):
        often = order.value
        most = int(often.mean()) + HOT
        for pdf in batches:
            out = []
            for s in shingle_sets(utf8(pdf["text"]), width):
                n = len(s)
                if not n:
                    out.append((0, 0, 0, *[np.zeros(0, np.int64)] * 2))
                    continue
                seen = often[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                rank = np.argsort(seen, kind="stable")[: n - (n * percent + 99) // 100 + 1]
                k1, k2 = mixed(s).sum(dtype=np.uint64), mixed(s ^ _C[0]).sum(dtype=np.uint64)
                out.append((n, int(k1.astype(np.int64)), int(k2.astype(np.int64)), s[rank].view(np.int64), s[rank[seen[rank] > most]].view(np.int64)))
            lists = {c: pd.Series([x[k] for x in out], dtype=object) for k, c in ((3, "signature"), (4, "hot"))}
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_shingles": [x[0] for x in out], "k1": [x[1] for x in out], "k2": [x[2] for x in out], **lists})

    return in_batches(docs.select("doc_id", "text"), sign, schema)


def _marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for each of ``ids`` (doc_id)."""
    none = np.zeros(1 << ID_BITS >> 3, np.uint8)

    def mark(batches):
        bits = np.zeros(1 << ID_BITS, bool)
        for pdf in batches:
            bits[_id_places(pdf["doc_id"])] = True
        yield _packed(np.packbits(bits))

    return _summed(in_batches(ids.select("doc_id"), mark, _PART), none, np.bitwise_or)


def _id_places(ids: pd.Series) -> np.ndarray:
    return (mixed(ids.to_numpy(np.int64).view(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def _sets(docs: DataFrame, width: int, active: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the documents in ``active`` and of a few others that share their bits: texts are not shuffled."""
    marks = docs.sparkSession.sparkContext.broadcast(_marked(active))  # of fixed size

    def sets(batches):
        bits = marks.value
        for pdf in batches:
            place = _id_places(pdf["doc_id"])
            pdf = pdf[(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(np.int64), "tokens": pd.Series([s.view(np.int64) for s in shingle_sets(utf8(pdf["text"]), width)], dtype=object)})  # typed without rows too

    return in_batches(docs.select("doc_id", "text"), sets, "doc_id long, tokens array<long>")


def _of_like_size(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link."""
    x, y = (sizes.select(F.col("q").alias(c), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)).select("a", "b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").where(both * (100 + percent) >= (F.size("ta") + F.size("tb")) * percent).select("a", "b")


def _met(asks: DataFrame, held: DataFrame, data: DataFrame, compare, schema: str) -> DataFrame:
    """What ``compare(to, queries, members)`` yields for the queries (q, to, component) and members (q, to, component) of groups.

    Queries and members of a group are dealt into blocks of about ``BLOCK`` documents, and every block of queries meets every
    block of members in a task of its own, so that ``data`` (doc_id, ...) travels once for a block and not once for a pair,
    and no task grows with a group. Where all documents of two blocks are in the component of the group's pivot, they do not
    meet; without components (null) all do.
    """
    main = held.where("q = to").select("to", F.col("component").alias("main"))
    odd = F.coalesce((F.col("component") != F.col("main")).cast("int"), F.lit(1))
    asks, held = (stored(x.join(main, "to", "left").withColumn("odd", odd), "jaccard-sides") for x in (asks, held))
    n = lambda odd: F.ceil(F.sum(F.when(F.col("odd") == odd, 1).otherwise(0)) / BLOCK).cast("int")
    shape = asks.groupBy("to").agg(n(0).alias("q0"), n(1).alias("q1")).join(held.groupBy("to").agg(n(0).alias("y0"), n(1).alias("y1")), "to")
    shape = stored(shape.where("q1 > 0 or y1 > 0"), "jaccard-shapes")

    def dealt(side: DataFrame, me: str, you: str, first: bool) -> DataFrame:
        x = side.join(shape, "to")
        own = F.pmod(F.xxhash64("q"), F.when(F.col("odd") == 1, F.col(f"{me}1")).otherwise(F.col(f"{me}0"))).cast("int") * 2 + F.col("odd")
        labels = lambda odd: F.transform(F.sequence(F.lit(1), F.col(f"{you}{odd}")), lambda j: (j - 1) * 2 + odd)
        none = F.array().cast("array<int>")
        far = F.concat(F.when((F.col("odd") == 1) & (F.col(f"{you}0") > 0), labels(0)).otherwise(none), F.when(F.col(f"{you}1") > 0, labels(1)).otherwise(none))
        x = x.select("to", "q", "component", own.alias("mine"), F.explode(far).alias("theirs"))
        ql, yl = ("mine", "theirs") if first else ("theirs", "mine")
        return x.select("to", F.col(ql).alias("ql"), F.col(yl).alias("yl"), F.lit(first).alias("asks"), F.col("q").alias("doc_id"), "component")

    rows = dealt(asks, "q", "y", True).unionByName(dealt(held, "y", "q", False)).join(data, "doc_id")
    parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "to", "ql", "yl").sortWithinPartitions("to", "ql", "yl")
    names = [x.split()[0] for x in schema.split(", ")]
    rest = [c for c in data.columns if c != "doc_id"]

    def meet(batches):
        key, sides = None, ([], [])
        frame = lambda out: pd.DataFrame(out, columns=names).astype(np.int64)
        for pdf in batches:
            out = []
            for to, ql, yl, ask, *row in pdf.itertuples(index=False, name=None):
                if (to, ql, yl) != key:
                    if sides[0] and sides[1]:
                        out += compare(key[0], *sides)
                    key, sides = (to, ql, yl), ([], [])
                sides[0 if ask else 1].append(row)
            yield frame(out)
        if sides[0] and sides[1]:
            yield frame(list(compare(key[0], *sides)))

    return in_batches(rows.select("to", "ql", "yl", "asks", "doc_id", "component", *rest), meet, schema)


def _qualified(asks: DataFrame, held: DataFrame, sign: DataFrame, often, percent: int) -> DataFrame:
    """The groups (q, to) that have a member whose whole signature could still reach the threshold.

    Common tokens up to the end of the signature that ends first are in both signatures; of the r tokens that a set has up to
    there it may lack n - overlap at most.
    """

    def compare(to, queries, members):
        table = often.value
        spot = lambda t: (table[(t.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], t.view(np.uint64))
        placed = [[(spot(r[3]), np.sort(r[3])) for r in side] for side in (queries, members)]
        for (x, _, nx, sx), ((ox, hx), tx) in zip(queries, placed[0], strict=True):
            for (y, _, ny, sy), ((oy, hy), ty) in zip(members, placed[1], strict=True):
                if x == y or ny * 100 < nx * percent or ny * percent > nx * 100:
                    continue
                overlap = -(-(nx + ny) * percent // (100 + percent))
                end = min((ox[-1], hx[-1]), (oy[-1], hy[-1]))
                c = len(np.intersect1d(tx, ty, assume_unique=True))
                if all(c >= int(((o < end[0]) | ((o == end[0]) & (h <= end[1]))).sum()) - (n - overlap) for o, h, n in ((ox, hx, nx), (oy, hy, ny))):
                    yield x, to
                    break

    none = F.lit(None).cast("long").alias("component")
    data = sign.select("doc_id", "n_shingles", "signature")
    return _met(asks.select("q", "to", none), held.select("q", "to", none), data, compare, "q long, to long").distinct()


def _opened_links(asks: DataFrame, held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the queries of opened groups and their members, as (a, b), from whole sets."""

    def compare(to, queries, members):
        # overlap <= (|x| + |y| - bits that differ) / 2 for bitmaps of the sets: most pairs need no more than that
        bits = [_bitmap([r[2] for r in side]) for side in (queries, members)]
        size = [np.array([len(r[2]) for r in side]) for side in (queries, members)]
        for i, (x, cx, sx) in enumerate(queries):
            differ = np.bitwise_count(bits[0][i][None, :] ^ bits[1]).sum(1, dtype=np.int64)
            total = size[0][i] + size[1]
            for j in np.flatnonzero((total - differ) // 2 * (100 + percent) >= total * percent):
                y, cy, sy = members[j]
                if cx != cy and len(np.intersect1d(sx, sy, assume_unique=True)) * (100 + percent) >= total[j] * percent:
                    yield min(x, y), max(x, y)

    return stored(_met(asks, held, sets.select("doc_id", "tokens"), compare, "a long, b long"), "jaccard-second")


def _bitmap(sets: list[np.ndarray], bits: int = 4096) -> np.ndarray:
    out = np.zeros((len(sets), bits), np.uint8)
    for i, s in enumerate(sets):
        out[i, (s.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) where rows of one id are equal: documents linked, directly or over others."""
    order = docs.sparkSession.sparkContext.broadcast(_sketch(docs, width))  # of fixed size
    sign = stored(signatures(docs, width, percent, order), "jaccard-signatures")
    # Any key of a join may hold a third of all rows. Sums by it are written first: adaptive execution splits a key of a join only
    # where both sides come straight from an exchange.
    keyed, key = sign.where("n_shingles > 0").select("doc_id", "k1", "k2", "n_shingles"), ["k1", "k2", "n_shingles"]
    own = stored(keyed.groupBy(key).agg(F.min("doc_id").alias("rep")), "jaccard-own")
    classes = stored(keyed.join(own, key).select("doc_id", "rep"), "jaccard-classes")
    reps = own.select(F.col("rep").alias("doc_id"))
    exploded = lambda docs, tokens: docs.join(reps, "doc_id", "left_semi").select(F.explode(tokens).alias("token"), F.col("doc_id").alias("q"), F.col("n_shingles").alias("n"))
    hot = exploded(sign.where(F.size("hot") > 0).select("doc_id", "n_shingles", "hot"), "hot")
    hot_pivots = stored(hot.groupBy("token").agg(F.min("q").alias("pivot"), F.count("*").alias("m")).where("m > 1").drop("m"), "jaccard-hot")
    rows = exploded(sign, F.when(F.size("hot") == 0, F.col("signature")).otherwise(F.array_except("signature", "hot")))
    # counted and joined on one exchange: both sides read the same columns, so that it is written once
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")
    pivots = rows.groupBy("token").agg(F.min("q").alias("pivot"), F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least > 0").drop("m", "least")
    shared = stored(rows.join(pivots, "token").unionByName(hot.join(hot_pivots, "token")), "jaccard-shared")
    discard(own, hot_pivots)

    # stars: the pivot with which a document shares most signature tokens
    star = shared.where("q <> pivot").groupBy("q", "pivot", "n").agg(F.count("*").alias("c")).where("100 * c >= 2 * n")
    star = star.groupBy("q").agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("g"))
    star = stored(star, "jaccard-stars")
    tree = star  # pivots have pivots: a group is a tree, named by its root; ids fall along every path
    while True:
        up = tree.select(F.col("q").alias("g"), F.col("g").alias("top"))
        tree = stored(tree.join(up, "g", "left").select("q", F.coalesce("top", "g").alias("g"), F.col("top").isNotNull().alias("moved")), "jaccard-trees")
        if tree.where("moved").isEmpty():
            break
        tree = tree.drop("moved")
    # a tree is cut by size, so that the sizes of a group, and with them the bound, stay within one step of the threshold
    sizes = tree.select("q").union(tree.select("g")).distinct().join(sign.where("n_shingles > 0").groupBy(F.col("doc_id").alias("q")).agg(F.min("n_shingles").alias("n")), "q")
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(percent, 99)))
    cut = sizes.join(tree.select("q", F.col("g").alias("top")), "q", "left").select("q", "n", F.coalesce("top", "q").alias("top"), step.alias("step"))
    cut = stored(cut, "jaccard-steps")
    group = stored(cut.groupBy("top", "step").agg(F.min("q").alias("g"), F.count("*").alias("w"), F.min("n").alias("lo"), F.max("n").alias("hi")), "jaccard-groups")
    cut = cut.join(group, ["top", "step"]).select("q", "n", "g", "w", "lo", "hi")
    cut = stored(cut, "jaccard-cut")
    discard(group)
    # what the bound needs of a group travels with its members; who is in no tree is a group of one
    alone = {"g": "q", "w": F.lit(1), "lo": "n", "hi": "n"}
    member = shared.select("token", "q", "n").join(cut.drop("n"), "q", "left").withColumns({c: F.coalesce(c, x) for c, x in alone.items()})
    member = stored(member, "jaccard-members")
    discard(shared)

    # the matrix, the bound, the groups that qualify
    matrix = member.select("token", F.col("g").alias("to"), F.col("w").alias("wt"), "lo", "hi").distinct()
    fits = (F.col("hi") * 100 >= F.col("n") * percent) & (F.col("lo") * percent <= F.col("n") * 100)
    # of two groups the smaller one asks: either direction finds every link between them
    asking = (F.col("w") < F.col("wt")) | ((F.col("w") == F.col("wt")) & (F.col("g") < F.col("to")))
    bound = member.drop("lo", "hi").join(matrix, "token").where(asking & fits).groupBy("q", "n", "to", "lo", "hi").agg(F.count("*").alias("c"))
    opened = stored(bound.where(F.col("c") >= needed(F.col("n"), F.col("lo"), F.col("hi"), percent)).select("q", "to"), "jaccard-bound")
    size = stored(member.select("q", "n", "g").distinct(), "jaccard-sizes")
    opened = stored(_qualified(opened, size.select("q", F.col("g").alias("to")), sign, order, percent), "jaccard-opened")

    open_members = size.join(opened.select(F.col("to").alias("g")).distinct(), "g", "left_semi")
    arms = star.select(F.col("q").alias("a"), F.col("g").alias("b")).union(cut.where("q <> g").select(F.col("q").alias("a"), F.col("g").alias("b"))).distinct()
    arms = stored(_of_like_size(arms, cut.select("q", "n"), percent), "jaccard-arms")
    several = cut.join(cut.where("q <> g").select("g").distinct(), "g", "left_semi")  # members of groups of two and more
    active = several.select("q").union(arms.select("a")).union(arms.select("b")).union(opened.select("q")).union(open_members.select("q")).distinct().withColumnRenamed("q", "doc_id")
    sets = stored(_sets(docs, width, active), "jaccard-sets")

    first = stored(_linked(arms, sets, percent), "jaccard-links")
    root = components(first, "jaccard-first").withColumnRenamed("id", "q")
    placed = stored(size.join(root, "q", "left").withColumn("component", F.coalesce("component", "q")), "jaccard-placed")
    # a group is opened for a query from outside, and for its own members that the pivots did not join to its root
    main = placed.where("q = g").select("g", F.col("component").alias("main"))
    loose = placed.join(main, "g").where("component <> main").select("q", F.col("g").alias("to"), "component")
    asks = opened.select("q", "to").join(placed.select("q", "component"), "q").select("q", "to", "component").unionByName(loose)
    held = placed.select("q", F.col("g").alias("to"), "component")
    second = _opened_links(asks, held, sets, percent)
    root = components(first.union(second), "jaccard").withColumnRenamed("id", "rep")
    discard(star, cut, member, opened, size, arms, sets, first, placed, second)
    found = classes.join(root, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    # representatives are the smallest ids of their classes, so the smallest representative is the smallest id reached
    return sign.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def jaccard_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, str, bool]:
    """(rows, found, name, plain): ``docs`` with a column that names its rows, and (name, doc_id, n_shingles, component_id, kept).

    ``found`` has a row for each name; ``kept`` is true for one of each component: the one with the smallest id. ``plain``: ids
    are names.
    """
    rows, name, plain = named(docs)
    texts = rows.select(F.col(name).alias("doc_id"), "text")
    if plain:
        found = _components(texts, width, percent)
        return rows, found.select(F.col("doc_id").alias(name), "doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept")), name, plain
    found = _components(stored(texts.dropDuplicates(["doc_id"]), "jaccard-texts"), width, percent)
    ids = rows.select(name, F.col("doc_id").cast("long").alias("doc_id")).distinct()
    found = found.withColumnsRenamed({"doc_id": name, "component_id": "of"}).join(ids, name)
    # smallest ids first, rows without one last; one row for each component after partial aggregation
    first = found.groupBy("of").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", name))[name].alias("first"))
    found = found.join(first, "of").select(name, "doc_id", "n_shingles", "component_id", (F.col(name) == F.col("first")).alias("kept"))
    return rows, stored(found, "jaccard-rows"), name, plain


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents linked, directly or over others, at ``percent`` per cent similarity."""
    rows, found, name, plain = jaccard_rows(docs.select("doc_id", "text"), width, percent)
    if not plain:
        found = rows.select(name).join(found, name)
    return found.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest id stays, of rows equal in id and text one.

    Texts without words are copies of nothing and all stay.
    """
    rows, found, name, plain = jaccard_rows(docs, width, percent)
    gone = stored(found.where("not kept").select(name), "near-duplicates")
    left = rows.join(gone, name, "left_anti")
    if not plain:
        worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        left = left.where(worded).dropDuplicates([name]).unionByName(left.where(~worded))
    return left.select(*docs.columns)


#: The components by all pairs that share a shingle; for tables small enough for that.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a WHERE r.c < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY a) c USING (doc_id)
"""
