"""Jaccard join of documents on word n-grams with vertical partitioning.

Two documents link if their sets of shingles have a Jaccard similarity of at
least num/den. The global order of shingles is: rare first, then by hash.

1. Which shingles occur in several documents? Hashes are dealt by range. What
   a chunk of documents holds twice is known before anything is dealt, and
   goes out once a chunk: a shingle of a third of all documents costs a row a
   chunk. A document with too few shared shingles links with none and goes no
   further; the answer may err towards shared only.
2. Documents with equal sets become one representative.
3. The global order is cut into fragments, ranges of it that hold alike many
   shingles of sets (a histogram of frequencies gives the cuts), and each set
   into a segment for each fragment.
4. Each fragment finds pairs by itself: sets that link share one of the first
   size - ceil(num/den size) + 1 shingles of the order (the prefix), and each
   fragment lists the sets by those prefix shingles that are its own. First
   each list's members are compared with one hub; what links is one component
   and its members need no further comparison. When hubs find no more, members
   of different components are compared, so that no link is lost, and a group
   of near copies costs about its size. These last lists are split into blocks
   by size class and hash, and pairs of blocks are dealt: however long a list,
   a task holds two blocks.
5. Each fragment counts its partial overlap of a pair from the two sets'
   segments; the partial overlaps are summed per pair.
6. Components come from contracting links, round by round, as tables.

Nothing about single documents goes to the driver, only sizes of tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, materialize, release_memory, shuffle_partitions
from tessera.types import free_name

#: Characters and documents of a chunk; fragments that the order is cut into; members of a list that make a block.
CHUNK_CHARS, CHUNK_DOCS, FRAGMENTS, LIST_ROWS = 12_000_000, 60_000, 8, 2000
_MARK, _NO_ID = 0xFFFF, -(1 << 40)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; a text with fewer words has one of all its words, without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = max(1, len(h) - n + 1)
    width = min(n, len(h))
    out = np.full(size, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + size]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Chunks of documents: ids and sets. Texts are not held."""
    ids, sets, chars = [], [], 0
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = x.as_py()
            ids.append(i)
            sets.append(shingles(text, n))
            chars += len(text or "")
            if chars >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
                yield ids, sets
                ids, sets, chars = [], [], 0
    if ids:
        yield ids, sets


def _sizes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc, size (number of shingles) and may_link (enough of them occur elsewhere) for each row of docs (doc, text). Null docs may not link.

    A fragment's hashes are told apart by 32 further bits: their number in a
    fragment stays the same as fragments grow in number with the input.
    """
    fragments = shuffle_partitions(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (ids, sets) in enumerate(_chunks(batches, n)):
            size = np.array([len(s) for s in sets], np.int64)
            hashes = np.concatenate(sets)
            sets.clear()
            of = np.repeat(np.arange(len(ids), dtype=np.uint16), size)
            # equal chunks may come from several tasks; another attempt of a task gives the same key for the same rows only
            key = f"{TaskContext.get().partitionId()}:{number}:{xxhash.xxh3_64_intdigest(hashes.tobytes() + np.array([x or 0 for x in ids], np.int64).tobytes())}"
            order = np.argsort(hashes, kind="stable")
            h, o = hashes[order], of[order]
            del hashes, of, order
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            count = np.diff(np.append(start, len(h)))
            alone = np.repeat(count == 1, count)
            shared = np.bincount(o[~alone], minlength=len(ids)).astype(np.int64)
            shared[[i for i, x in enumerate(ids) if x is None]] = _NO_ID
            # the chunk's own documents first: a row that any fragment may hold
            yield pa.record_batch([pa.array([xxhash.xxh32_intdigest(key) % fragments], pa.int32()), pa.array([key]), pa.array([np.array([x if x is not None else 0 for x in ids], np.int64).tobytes()]), pa.array([size.tobytes()]), pa.array([shared.tobytes()])], ["fragment", "chunk", "a", "b", "c"])
            first = start[count > 1]
            h, o = np.concatenate([h[alone], h[first]]), np.concatenate([o[alone], np.full(len(first), _MARK, np.uint16)])
            fragment = ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
            order = np.lexsort((o, fragment))
            h, o, fragment = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], o[order], fragment[order]
            cuts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1], [True]])) if len(h) else [0]
            for a, z in zip(cuts, cuts[1:]):
                yield pa.record_batch([pa.array([fragment[a]], pa.int32()), pa.array([key]), pa.array([None], pa.binary()), pa.array([h[a:z].tobytes()]), pa.array([o[a:z].tobytes()])], ["fragment", "chunk", "a", "b", "c"])
            del h, o, fragment, order, first, alone
        release_memory()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each fragment in the partition: which hashes came twice, as numbers by document of each chunk."""
        parts: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}
        fields = ["chunk", "ids", "size", "shared"]
        for b in batches:
            for fragment, key, a, h, o in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if a is not None:
                    yield pa.record_batch([pa.array([key]), pa.array([a]), pa.array([h]), pa.array([o])], fields)
                else:
                    parts.setdefault(fragment, []).append((key, np.frombuffer(h, np.uint32), np.frombuffer(o, np.uint16)))
        for fragment in list(parts):
            rows = parts.pop(fragment)
            h = np.concatenate([r[1] for r in rows])
            marked = np.concatenate([r[2] for r in rows]) == _MARK
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            group = np.cumsum(new) - 1
            weight = np.bincount(group, 1 + marked[order])
            hit = np.empty(len(h), bool)
            hit[order] = weight[group] > 1
            at = 0
            for key, x, o in rows:
                some = o[hit[at : at + len(x)] & (o != _MARK)]
                at += len(x)
                if len(some):
                    yield pa.record_batch([pa.array([key]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([np.bincount(some).astype(np.int64).tobytes()])], fields)
            del rows, h, marked, order, s, new, group, weight, hit
        release_memory()

    def total(table: pa.Table) -> pa.Table:
        """One chunk: its documents with the sums."""
        ids = size = shared = None
        more = []
        for a, b, c in zip(*(table.column(x).to_pylist() for x in ("ids", "size", "shared")), strict=True):
            if a is not None:
                ids, size, shared = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(c, np.int64).copy()
            else:
                more.append(np.frombuffer(c, np.int64))
        for x in more:
            shared[: len(x)] += x
        return pa.table({"doc": pa.array(ids, pa.int64(), mask=shared < _NO_ID // 2), "size": size, "may_link": (den * shared >= num * size) & (size > 0)})

    dealt = docs.select("doc", "text").mapInArrow(deal, "fragment int, chunk string, a binary, b binary, c binary")
    answered = dealt.repartition(fragments, "fragment").mapInArrow(answer, "chunk string, ids binary, size binary, shared binary")
    return answered.groupBy("chunk").applyInArrow(total, "doc long, size long, may_link boolean")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc, size, s1, s2 (a 128-bit hash of the set), row (a number of its own) and hashes; within a task only the first of equal sets has hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        row = TaskContext.get().partitionId() << 33
        for b in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(x, n)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                new = d not in seen
                if len(seen) < 100_000:
                    seen.add(d)
                row += 1
                rows.append((i, len(s), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), row, s.view(np.int64) if new else None))
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((*[pa.int64()] * 5, pa.list_(pa.int64())))], ["doc", "size", "s1", "s2", "row", "hashes"])
        release_memory()

    return docs.select("doc", "text").mapInArrow(run, "doc long, size long, s1 long, s2 long, row long, hashes array<long>")


def contract(links: DataFrame) -> DataFrame:
    """node and root for every node of links (a, b); nodes that links connect share a root, the smallest of them. Contracts links until none is left."""
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc-links", 0, arrow=True)
    roots: DataFrame | None = None
    while not edges.isEmpty():
        # each node hangs on its smallest neighbour, if that is smaller; one jump shortens chains
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("up"))
        top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = materialize(up.join(top, "up").select("node", F.col("top").alias("up")), "cc-up", 0, arrow=True)
        if roots is None:
            roots = up.select("node", F.col("up").alias("root"))
        else:
            to = up.select(F.col("node").alias("root"), F.col("up").alias("new"))
            roots = materialize(roots.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "cc-roots", 0, arrow=True)
        x, y = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = edges.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = materialize(moved.filter("a < b").distinct(), "cc-links", 0, arrow=True)
    return roots if roots is not None else links.sparkSession.createDataFrame([], "node long, root long")


def _more_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after some more links."""
    r = roots.select("node", "root")
    x, y = (r.select(F.col("node").alias(f"n{k}"), F.col("root").alias(f"r{k}")) for k in "ab")
    moved = links.join(x, F.col("a") == F.col("na"), "left").join(y, F.col("b") == F.col("nb"), "left")
    new = contract(moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    to = new.select(F.col("node").alias("root"), F.col("root").alias("new"))
    old = r.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = new.join(r.select("node"), "node", "left_anti")
    return materialize(old.unionAll(fresh), "join-roots", 0, arrow=True)


def cuts(ordered: DataFrame) -> list[tuple[int, int]]:
    """Where the global order (df, h) is cut, ascending: FRAGMENTS - 1 places between which sets of ordered (g) have alike many shingles.

    A histogram of document frequencies (steps of an eighth of a doubling, a
    few hundred rows) gives them; within the few frequencies of a step a cut
    is at a hash, as hashes are even.
    """
    step = F.floor(F.log2(F.col("df").cast("double")) * 8).cast("int")
    found = ordered.select(F.explode("g.df").alias("df")).groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("df").alias("least"), F.max("df").alias("most")).orderBy("step").collect()
    total, upto, out = sum(r["n"] for r in found), 0, []
    for r in found:
        while len(out) < FRAGMENTS - 1 and total * (len(out) + 1) <= FRAGMENTS * (upto + r["n"]):
            share = (total * (len(out) + 1) / FRAGMENTS - upto) / r["n"]
            df = r["least"] + (r["most"] - r["least"] + 1) * share
            out.append((min(int(df), r["most"]), int((df - int(df)) * 2**64) - 2**63 if int(df) <= r["most"] else 2**63 - 1))
        upto += r["n"]
    return out


def segments_of(ordered: DataFrame, at: list[tuple[int, int]]) -> DataFrame:
    """rep, fragment and part (hashes) of the sets of ordered (rep, g), which are in order: where each cut falls in a set is counted, and the set is sliced there."""

    def before(df: int, h: int) -> Column:
        return F.size(F.filter("g", lambda x: (x["df"] < df) | ((x["df"] == df) & (x["h"] < h))))

    ends = F.array(F.lit(0), *[before(*cut) for cut in at], F.size("g"))
    cut = ordered.select("rep", F.col("g.h").alias("hashes"), ends.alias("ends"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(len(at))), lambda k: F.slice("hashes", F.get("ends", k) + 1, F.get("ends", k + 1) - F.get("ends", k)))
    return cut.select("rep", F.posexplode(parts).alias("fragment", "part")).filter(F.size("part") > 0)


def _counted(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) that link, by partial overlaps in the fragments of the two sets."""
    left = segments.select(F.col("rep").alias("a"), "fragment", F.col("part").alias("x"))
    right = segments.select(F.col("rep").alias("b"), F.col("fragment").alias("f2"), F.col("part").alias("y"))
    partial = pairs.join(left, "a").join(right.withColumnRenamed("b", "b2"), (F.col("b") == F.col("b2")) & (F.col("fragment") == F.col("f2")))
    overlap = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("both"))
    return overlap.filter((den + num) * F.col("both") >= num * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def _fits(num: int, den: int, rest: Column, size: Column, rest2: Column, size2: Column) -> Column:
    """Whether two sets may link whose first common shingle has rest and rest2 shingles from it on: sizes and what is left must allow enough in common."""
    return (den * F.least(size, size2) >= num * F.greatest(size, size2)) & ((den + num) * F.least(rest, rest2) >= num * (size + size2))


def _open_lists(lists: DataFrame, roots: DataFrame, turn: int) -> tuple[DataFrame, int]:
    """The rows of the lists whose members are not yet one component, each with its root and its list's hub for this turn; how many pairs across components they hold."""
    now = lists.join(roots, lists["rep"] == roots["node"], "left").select("h", "rep", "size", "rest", "own", F.coalesce("root", "rep").alias("root"))
    # first the set with the fewest shingles of its own, as that of which others are copies; then any
    rank = F.col("own").cast("long") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    parts = now.groupBy("h", "root").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("x"), "rep", "size", "rest")).alias("first"))
    by = parts.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.count("*").alias("k"), F.min(F.struct("first.x", "first.rep", "first.size", "first.rest", "root")).alias("hub")).filter("k > 1")
    by = materialize(by, "join-hubs", 0, arrow=True)
    across = by.agg(F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("sq")), F.lit(0))).first()[0] // 2
    return now.join(by.select("h", "hub", F.col("n").alias("members")), "h"), across


def _across(now: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a, b, size_a and size_b of members of one list in different components that may link.

    A list is dealt in blocks: by size class, since sizes of sets that link
    are of one class or of neighbouring ones, and, where it has more than
    LIST_ROWS members, by a hash of the member. Each pair of blocks is a key.
    """
    blocks = F.ceil(F.col("members") / LIST_ROWS).cast("int")
    # sizes that are den/num apart differ by a little less than one
    by_size = F.floor(F.log(F.col("size").cast("double")) * (0.999 / math.log(den / num)) if den > num else F.col("size")).cast("int")
    dealt = now.select("h", "rep", "size", "rest", "root", "members", blocks.alias("blocks"), by_size.alias("class"), F.pmod(F.xxhash64(F.lit("block"), "rep"), blocks).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = dealt.select("h", "class", F.col("block").alias("x"), every.alias("y"), "rep", "size", "rest", "root")
    # of two classes, the pairs are at the lower one
    two = dealt.withColumn("at", F.explode(F.array(F.col("class"), F.col("class") - 1)))
    two = two.select("h", F.col("at").alias("class"), every.alias("x"), F.col("block").alias("y"), *[F.col(c).alias(f"{c}2") for c in ("rep", "size", "rest", "root", "class")])
    met = one.join(two, ["h", "class", "x", "y"]).filter(((F.col("class") < F.col("class2")) | (F.col("rep") < F.col("rep2"))) & (F.col("root") != F.col("root2")) & _fits(num, den, F.col("rest"), F.col("size"), F.col("rest2"), F.col("size2")))
    swap = F.col("rep") > F.col("rep2")
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return met.select(either("rep", "rep2").alias("a"), either("rep2", "rep").alias("b"), either("size", "size2").alias("size_a"), either("size2", "size").alias("size_b"))


def _hopeful(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of lists that may link with the list's smallest set at least: others link with none in it."""
    least = lists.groupBy("h").agg(F.min("size").alias("least"), F.count("*").alias("n")).filter("n > 1").select("h", "least")
    return lists.join(least, "h").filter((den + num) * F.col("rest") >= num * (F.col("size") + F.greatest("least", F.ceil(F.col("size") * num / den) - 1))).drop("least")


def link_representatives(reps: DataFrame, num: int, den: int, given: DataFrame, hub_rounds: int = 3) -> DataFrame:
    """node and root for those of reps (rep, size, hashes; distinct sets) that link with others. given: links (a, b) that hold anyway."""
    n = reps.agg(F.sum("size")).first()[0] or 0
    grams = reps.select("rep", F.explode("hashes").alias("h"))
    twice = grams.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    # what is dealt by shingle is the shingle and the set's name; sizes come back by name
    ordered = grams.join(twice, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("g")).join(reps.select("rep", "size"), "rep")
    # shingles of one set only come first in the order; they are in the prefix but in no list
    ordered = ordered.withColumn("prefix", F.expr(f"cast(size(g) - (size * {num} + {den - 1}) div {den} + 1 as int)")).filter("prefix > 0")
    ordered = materialize(ordered.select("rep", "size", "prefix", "g"), "join-ordered", 2 * n)
    # rest: shingles of the set from this one on
    lists = ordered.select("rep", "size", (F.col("size") - F.size("g")).alias("own"), F.size("g").alias("m"), F.posexplode(F.slice("g", F.lit(1), F.col("prefix"))).alias("pos", "s"))
    lists = lists.select("rep", "size", "own", (F.col("m") - F.col("pos")).alias("rest"), F.col("s.h").alias("h"))
    lists = materialize(_hopeful(_hopeful(lists, num, den), num, den), "join-lists", 4 * n, arrow=True)
    segments = materialize(segments_of(ordered, cuts(ordered)), "join-segments", n)
    n_rows = lists.count()
    roots, done = contract(given), None
    for turn in range(hub_rounds + 1):
        now, across = _open_lists(lists, roots, turn)
        if not across:
            break
        last = turn == hub_rounds or across <= 2 * n_rows
        rep, size, rest = F.col("rep"), F.col("size"), F.col("rest")
        if last:  # all pairs across components
            pairs = _across(now, num, den)
        else:
            hub, hub_size = F.col("hub.rep"), F.col("hub.size")
            met = now.filter((F.col("root") != F.col("hub.root")) & _fits(num, den, rest, size, F.col("hub.rest"), hub_size))
            pairs = met.select(F.least(rep, hub).alias("a"), F.greatest(rep, hub).alias("b"), F.when(rep < hub, size).otherwise(hub_size).alias("size_a"), F.when(rep < hub, hub_size).otherwise(size).alias("size_b"))
        pairs = pairs.distinct()
        pairs = materialize(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "join-pairs", 0, arrow=True)
        found = materialize(_counted(pairs, segments, num, den), "join-links", 0, arrow=True)
        if not found.isEmpty():
            roots = _more_links(roots, found)
        if last:
            break
        done = pairs.select("a", "b") if done is None else done.unionAll(pairs.select("a", "b"))
    return roots


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    docs: doc_id and text; other columns are ignored. Documents link if den
    times the number of shared shingles is at least num times the number of
    all. component_id is the smallest doc_id that links reach. Null, empty and
    blank texts have no shingles and link with none. Rows of one doc_id are one
    document as far as components go, each with its own shingles. Rows with a
    null doc_id take no part: their component_id is null.
    Very long texts are read whole; an empty table gives no rows. There are no
    ties: every pair that may link is compared exactly.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    sizes = materialize(_sizes(base, n, num, den), "join-sizes", 0, arrow=True)
    may_link = broadcast_if_small(materialize(sizes.filter("may_link").select("doc").distinct(), "join-may-link", 0, arrow=True))
    sets = materialize(_sets(base.join(may_link, "doc", "left_semi"), n).filter("size > 0"), "join-sets")
    # one class for each distinct set, named by half of its hash
    chosen = broadcast_if_small(materialize(sets.filter("hashes is not null").groupBy("s1", "s2").agg(F.min("row").alias("row")).select("row"), "join-chosen", 0, arrow=True))
    classes = sets.join(chosen, "row", "left_semi").select(F.col("s1").alias("rep"), "size", "hashes")
    member = sets.select("doc", F.col("s1").alias("node")).distinct()
    several = member.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc", "a")
    given = member.join(several, "doc").filter("node <> a").select("a", F.col("node").alias("b"))
    roots = link_representatives(classes, num, den, materialize(given, "join-given", 0, arrow=True))
    placed = materialize(member.join(roots, "node", "left").select("doc", F.coalesce("root", "node").alias("root")), "join-placed", 0, arrow=True)
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    of = placed.join(least, "root").select("doc", "component_id").distinct()
    return sizes.join(of, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of docs with their columns, of each group that links hold together only those with the smallest doc_id. Rows with a null doc_id stay.

    Rows of one doc_id are one document, of which one row stays: the one whose
    text sorts first (nulls last), among equal texts the one whose JSON does.
    """
    own = free_name(docs)
    found = near_duplicates(docs, n, num, den).filter("doc_id = component_id").groupBy(F.col("doc_id").alias(f"{own}id")).agg(F.count("*").alias(f"{own}n"))
    kept = materialize(found, "join-kept", 0, arrow=True)
    of, often = F.col("doc_id").cast("long") == F.col(f"{own}id"), F.col(f"{own}n") > 1
    if kept.filter(often).isEmpty():
        out = docs.join(kept, of, "left_semi")
    else:  # repeated rows
        rows = docs.join(kept.filter(often), of, "left_semi").select(F.struct("*").alias("row"))
        text = F.col("row.text").cast("string")
        first = rows.groupBy(F.col("row.doc_id").alias("id")).agg(F.min_by("row", F.struct(text.isNull(), text, F.to_json("row"))).alias("row"))
        out = docs.join(kept.filter(~often), of, "left_semi").unionAll(first.select("row.*"))
    return out.unionAll(docs.filter("doc_id is null"))
