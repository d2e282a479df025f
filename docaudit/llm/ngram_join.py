"""Documents linked by the Jaccard similarity of their word shingles, found with adaptive multi-match prefixes.

A set's shingles are ordered by estimated frequency, rare first. Two sets that link share at least as many shingles as
``l`` within their first ``size - least overlap + l`` ones, for any l. Each document picks the l, so the prefix length and the number of
shared shingles asked for, at which its estimated cost is lowest; a pair goes by the smaller l of the two.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.bytetext import blank_table, fold_table, mix, shingles, utf8, words
from docaudit.llm.common import Scratch, SharedTable, arrow_map, in_filter, key_filter, small_pieces

#: Counters of the table of estimated shingle frequencies, and how many of them are sent at once; neither depends on the input.
SLOTS, RANGE = 1 << 22, 1 << 14
#: Largest number of shared prefix shingles that a document may ask for.
MOST_MATCHES = 4
#: Documents expected in one part of a prefix list in the first round of verification.
LIST_PART = 4096
#: The low bits of a list's number say which part of a shingle's list it is.
LOW = 4095
#: Bits of the short sketch of a set.
SHORT = 512
#: Size classes per doubling of a set's size, used to join only sets of fitting sizes: with 80 per cent, partners lie in the same class or the next one or two.
CLASSES = 3


def _sets(column: pa.Array, width: int):
    """For each text the sorted distinct hashes of its shingles."""
    data, offsets = utf8(column)
    starts, _, hashes = words(data, offsets, blank_table(), fold_table())
    values, bounds = shingles(hashes, np.searchsorted(starts, offsets), width)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(values[a:b])


def _node(own: np.ndarray, salt: int) -> int:
    """A number for a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        total = mix(own ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(own))
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _count_slots(width: int):
    def run(batches):
        counts = np.zeros(SLOTS, np.uint32)
        for batch in small_pieces(batches):
            own = list(_sets(batch.column("text"), width))
            if own:
                counts += np.bincount((np.concatenate(own) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        for low in range(0, SLOTS, RANGE):
            part = counts[low : low + RANGE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([low // RANGE], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], ["range", "counts"])

    return run


def _add_slots(batches):
    """Sums of the counters of each range; a task holds those of its ranges only."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column("range").to_pylist(), batch.column("counts").to_pylist()):
            own = sums.setdefault(at, np.zeros(RANGE, np.uint64))
            own += np.frombuffer(zlib.decompress(counts), np.uint32)
    for at, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)])], ["range", "counts"])


def shingle_weights(docs: DataFrame, width: int, text: str) -> np.ndarray:
    """How many documents have the shingles of each slot, over all documents; SLOTS numbers, whatever the input's size."""
    parts = arrow_map(docs.select(F.col(text).alias("text")), _count_slots(width), "range int, counts binary")
    rows = arrow_map(parts.repartition("range"), _add_slots, "range int, counts binary").toArrow()
    counts = np.zeros(SLOTS, np.uint64)
    for at, own in zip(rows["range"].to_pylist(), rows["counts"].to_pylist()):
        counts[at * RANGE : (at + 1) * RANGE] = np.frombuffer(zlib.decompress(own), np.uint64)
    return np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)


def _sketch(own: np.ndarray) -> bytes:
    """Bits that the shingles switch, four to eight per shingle: shingles that two sets share cancel out when their sketches are compared."""
    bits = max(64, 1 << (4 * len(own) - 1).bit_length())
    switched = np.bincount((mix(own ^ np.uint64(3)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(switched.astype(np.uint8)).tobytes()


def _short_sketch(own: np.ndarray) -> np.ndarray:
    """The same in SHORT bits for every set, as 64-bit numbers, to be compared inside a join."""
    switched = np.bincount((mix(own ^ np.uint64(3)) & np.uint64(SHORT - 1)).astype(np.int64), minlength=SHORT) & 1
    return np.packbits(switched.astype(np.uint8)).view(np.int64)


def _apart(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two sets only. The longer sketch is folded to the length of the shorter one."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _describe(width: int):
    def run(batches):
        for batch in small_pieces(batches):
            sizes, nodes, checks, sketches, bits = [], [], [], [], []
            for own in _sets(batch.column("text"), width):
                sizes.append(len(own))
                sketches.append(_sketch(own) if len(own) else b"")
                bits.append(_short_sketch(own))
                nodes.append(_node(own, 1))
                checks.append(_node(own, 2))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["id", "digest", "size", "node", "check", "sketch", "bits"])

    return run


def pick_matches(likely: np.ndarray, size: int, least: int, most: int = MOST_MATCHES) -> int:
    """The l of lowest estimated cost. ``likely``: estimated lengths of the lists of the first shingles, rare first.

    With l, a document reads the lists of its prefix; a candidate must occur l times in them, so at most their total over l are
    left, each of which costs a look at a whole set.
    """
    best, best_cost = 1, math.inf
    sums = np.cumsum(likely)
    for many in range(1, min(most, least) + 1):
        n = size - least + many
        read = float(sums[n - 1])
        cost = read + (read - n) / many * size / 8
        if cost < best_cost:
            best, best_cost = many, cost
    return best


def _prefixes(width: int, percent: int, counts):
    def run(batches):
        own_counts = counts.value
        mean = float(own_counts.mean())
        usual = math.ceil(mean + 4 * math.sqrt(mean + 1))
        seen: set[int] = set()
        for batch in small_pieces(batches):
            out: list[list[np.ndarray]] = []
            for own in _sets(batch.column("text"), width):
                size = len(own)
                node = _node(own, 1)
                if not size or node in seen:  # equal sets give equal rows
                    continue
                seen.add(node)
                least = -(-percent * size // 100)
                slots = own_counts[(own & np.uint64(SLOTS - 1)).astype(np.int64)]
                longest = min(size, size - least + MOST_MATCHES)
                common = np.maximum(slots.astype(np.int64) - usual, 0)
                order = np.lexsort((own, common))[:longest]
                likely = common[order] + 1
                many = pick_matches(likely, size, least)
                n = size - least + many
                parts = np.clip(likely[:n] // LIST_PART, 1, LOW + 1).astype(np.uint64)
                part = np.uint64(node & (1 << 62) - 1) % parts
                info = (size << 32) + (np.arange(n) << 4) + (many << 1) + (parts > 1)
                out.append([(own[order[:n]] & ~np.uint64(LOW) | part).view(np.int64), np.full(n, node, np.int64), info.astype(np.int64)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["list", "node", "info"])

    return run


def _lists(batches):
    """Rows sorted by list and place: keeps those of lists with two sets or more and of lists in parts, with the list's first row as pivot."""
    names = ["list", "node", "info"]
    last: dict | None = None  # the first row of the list that is open, and whether it is out
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        c = {k: batch.column(k).to_numpy() for k in names}
        begins = np.ones(n, bool)
        begins[1:] = np.diff(c["list"]) != 0
        begins[0] = last is None or last["list"] != c["list"][0]
        heads = np.flatnonzero(begins)
        out = []
        if not begins[0]:
            first = int(heads[0]) if len(heads) else n
            if not last["out"]:
                out.append([np.array([last[k]]) for k in names] + [np.array([last[k]]) for k in ("node", "info")])
                last["out"] = True
            out.append([c[k][:first] for k in names] + [np.full(first, last[k]) for k in ("node", "info")])
        if len(heads):
            lengths = np.diff(np.append(heads, n))
            keep = (lengths > 1) | (c["info"][heads] & 1 == 1)
            rows = np.repeat(keep, lengths)
            at, pivots = np.arange(heads[0], n)[rows], np.repeat(heads, lengths)[rows]
            out.append([c[k][at] for k in names] + [c[k][pivots] for k in ("node", "info")])
            last = {k: c[k][heads[-1]] for k in names} | {"out": bool(keep[-1])}
        out = [np.concatenate(x) for x in zip(*out)]
        if len(out) and len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["list", "node", "info", "p_node", "p_info"])


def _unpacked(rows: DataFrame, prefix: str = "") -> DataFrame:
    """info as the columns size, place, many."""
    info = F.col(f"{prefix}info")
    fields = {"size": F.shiftright(info, 32), "place": F.shiftright(info, 4).bitwiseAND((1 << 28) - 1), "many": F.shiftright(info, 1).bitwiseAND(7)}
    return rows.withColumns({f"{prefix}{k}": v.cast("int") for k, v in fields.items()}).drop(f"{prefix}info")


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether two rows of one token leave room for the overlap that a link needs, with the matches before this one allowed for.

    Overlap o of sizes m, n links when 100 o >= p (m + n - o), so when (100 + p) o >= p (m + n). At the q-th common shingle at places
    i, j, o <= q - 1 + min(m - i, n - j); the first l common ones have q - 1 < l.
    """
    l = F.least(f"{a}many", f"{b}many") - 1  # noqa: E741
    need = percent * (F.col(f"{a}size") + F.col(f"{b}size"))
    return ((100 + percent) * (F.col(f"{a}size") - F.col(f"{a}place") + l) >= need) & ((100 + percent) * (F.col(f"{b}size") - F.col(f"{b}place") + l) >= need)


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(f"{a}size", f"{b}size") >= percent * F.greatest(f"{a}size", f"{b}size")


def _counted(pairs: DataFrame) -> DataFrame:
    """Pairs a, b that share as many prefix shingles as the smaller of their two numbers asks for."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("l").alias("l")).filter("n >= l").select("a", "b")


def _may_link(percent: int):
    """Pairs whose sketches leave room for a link: what two sets share is at most half of their sizes less what is in one only."""

    def run(batches):
        for batch in batches:
            total = batch.column("a_size").to_numpy().astype(np.int64) + batch.column("b_size").to_numpy()
            apart = np.array([_apart(x, y) for x, y in zip(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist())], np.int64)
            good = pa.array((100 + percent) * (total - apart) >= 2 * percent * total, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return run


def _verify(width: int, percent: int):
    def run(batches):
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in small_pieces(batches):
            a, b, good = batch.column("a").to_pylist(), batch.column("b"), np.zeros(batch.num_rows, bool)
            b_sets = _sets(batch.column("b_text"), width)
            # Rows of one a stand together; its set is made once.
            firsts = [i for i, x in enumerate(a) if (i == 0 and x != last[0]) or (i and x != a[i - 1])]
            a_sets = dict(zip(firsts, _sets(batch.column("a_text").take(pa.array(firsts, pa.int64())), width)))
            for i, other in enumerate(b_sets):
                if i in a_sets:
                    last = (a[i], a_sets[i])
                shared = len(np.intersect1d(last[1], other, assume_unique=True))
                good[i] = shared > 0 and 100 * shared >= percent * (len(last[1]) + len(other) - shared)
            good = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), b.filter(good)], ["a", "b"])

    return run


def _components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of the edges a, b: nodes move to their smallest neighbour and edges shrink with them, until none is left."""
    whole: DataFrame | None = None
    edges = edges.filter("a <> b")
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        step = scratch.keep(step)
        if step.isEmpty():
            return whole if whole is not None else step.withColumnRenamed("to", "root")
        moved = edges.join(step.withColumnsRenamed({"node": "a", "to": "c"}), "a").join(step.withColumnsRenamed({"node": "b", "to": "d"}), "b")
        edges = scratch.keep(moved.filter("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
        if whole is None:
            whole = step.withColumnRenamed("to", "root")
        else:
            new = whole.join(step.withColumnsRenamed({"node": "root"}), "root", "left")
            whole = scratch.keep(new.select("node", F.coalesce("to", "root").alias("root")))


def text_digest(text: Column) -> Column:
    """A hash of a text, nulls as empty texts; with a key it tells which row of that key is meant."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, key: str = "doc_id", text: str = "text", digest: str | None = None) -> DataFrame:
    """One row per document: key, n_shingles, component (smallest key of the documents it is linked with, directly or not), node (the
    same for equal sets of shingles). ``digest``: name of a further column with the row's ``text_digest``.

    Words are what stands between blanks, A-Z in lower case. A set has the distinct runs of ``width`` words; fewer words make one
    run. Documents link when ``percent`` per cent of the union of their sets is shared.

    1. Frequencies of shingles are estimated over all documents in a table of fixed size. They only order shingles, so errors cost
    time, not links. 2. Equal sets become one node. 3. Prefixes are dealt by shingle, very common ones in parts. In each list the
    row with the earliest place becomes the pivot, and only pairs with the pivot are verified on whole texts; most groups of copies
    become one component here, with as many pairs as rows. 4. All other pairs of rows of one shingle that lie in different components
    are joined by shingle and size class, if places and sizes leave room for the overlap; pairs that share enough of them are
    ruled out or verified like the others. Rows of the main component of a list are never paired among themselves. No list, pair or candidate is left out.

    Shingles are compared by 64-bit hashes; two nodes whose 64-bit numbers are equal but whose sets are not raise an error.
    Null and empty texts have 0 shingles and are alone. Null keys have a component of their smallest non-null key, or null. Rows
    that repeat a key and text are one node; rows of one key with different texts are linked with what either is linked with on
    their own row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), content.alias("text"))
    with_digest = rows.select("id", text_digest(F.col("text")).alias("digest"), "text")
    counts = spark.sparkContext.broadcast(shingle_weights(docs, width, text))
    further = [F.col("digest").alias(digest)] if digest else []
    with Scratch() as scratch:
        described = scratch.keep(arrow_map(with_digest, _describe(width), "id long, digest long, size int, node long, check long, sketch binary, bits array<long>"))
        filled = described.filter("size > 0")
        nodes = filled.groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "digest", "size", "sketch", "bits")).alias("sample"), (F.min("check") == F.max("check")).alias("same"))
        nodes = nodes.filter(F.assert_true("same", F.lit("two sets of shingles have one number")).isNull())
        nodes = scratch.keep(nodes.select("node", "least", "sample.*"))
        parts = _linked(rows, with_digest, nodes, counts, percent, width, scratch)
        roots = nodes.select("node", "least").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = roots.groupBy("root").agg(F.min("least").alias("component"))
        roots = roots.join(smallest, "root").select("node", "component")
        out = filled.join(roots, "node").select("id", "size", "component", "node", "digest")
        alone = described.filter("size = 0").select("id", "size", F.col("id").alias("component"), F.lit(None).cast("long").alias("node"), "digest")
        out = out.union(alone).select(F.col("id").alias(key), F.col("size").cast("long").alias("n_shingles"), "component", "node", *further)
        # What is needed until here only, sketches above all, goes; the result stays in the shared folder.
        out = SharedTable(out).read()
    counts.destroy()
    return out


def _linked(rows: DataFrame, with_digest: DataFrame, nodes: DataFrame, counts, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """node, root of all nodes that link with others."""
    dealt = arrow_map(rows.select("text"), _prefixes(width, percent, counts), "list long, node long, info long")
    dealt = dealt.repartition("list").sortWithinPartitions("list", F.col("info").bitwiseAND((1 << 32) - 1), "node")
    shared = scratch.keep(arrow_map(dealt, _lists, "list long, node long, info long, p_node long, p_info long"))

    def verified(pairs: DataFrame) -> DataFrame:
        sketches = [nodes.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch")) for x in "ab"]
        pairs = scratch.keep(arrow_map(pairs.join(sketches[1], "b").join(sketches[0], "a"), _may_link(percent), "a long, b long"))
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", F.col("id").alias("i"), F.col("digest").alias("g"))
        texts = with_digest.filter(in_filter(key_filter(wanted, "g"), F.col("digest")))
        texts = texts.join(wanted.hint("shuffle_hash"), (F.col("digest") == F.col("g")) & F.col("id").eqNullSafe(F.col("i"))).select("node", "text")
        with Scratch() as own:
            texts = own.keep(texts)
            found = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "b_text"}), "b").join(texts.withColumnsRenamed({"node": "a", "text": "a_text"}), "a")
            return scratch.keep(arrow_map(found.select("a", "b", "a_text", "b_text"), _verify(width, percent), "a long, b long").distinct())

    pivots = _unpacked(_unpacked(shared.filter("node <> p_node")), "p_")
    pivots = pivots.filter(_similar_sizes("", "p_", percent) & _fits("", "p_", percent))
    links = verified(_counted(pivots.select(F.col("p_node").alias("a"), F.col("node").alias("b"), F.least("many", "p_many").alias("l"))))
    parts = _components(links, scratch)
    rest = shared.select(F.col("list").bitwiseAND(~LOW).alias("token"), "node", "info").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    place = F.col("info").bitwiseAND((1 << 32) - 1)
    mains = rest.groupBy("token").agg(F.min(F.struct(place.alias("place"), "node", "root")).alias("main"), F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s")
    mains = mains.select("token", F.col("main.root").alias("main"))
    short = nodes.select("node", *[F.get("bits", F.lit(i)).alias(b) for i, b in enumerate(_BITS)])
    rest = rest.join(mains, "token").select("token", "node", "info", "root", (F.col("root") == F.col("main")).alias("main"))
    with Scratch() as own:
        more = verified(_other_pairs(_unpacked(own.keep(rest.join(short, "node"))), percent))
    return _components(scratch.keep(links.union(more)), scratch)


_BITS = [f"b{i}" for i in range(SHORT // 64)]


def _other_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components. rest: token, node, size, place, many, root, main (whether root is the list's main one)."""
    p = 100 + percent
    size_class = lambda c: F.floor(F.log2(c.cast("double")) * CLASSES).cast("int")
    room = F.col("size") - F.col("place") + F.col("many") - 1
    # Of a pair, the smaller set needs room for a partner of its own size at least.
    small = rest.filter(p * room >= 2 * percent * F.col("size")).withColumn("class", size_class(F.col("size")))
    # The larger one has room for partners up to a size.
    most = F.least(F.floor((p * room - percent * F.col("size")) / percent), F.col("size"))
    least = F.ceil(F.col("size") * percent / 100)
    large = rest.withColumn("most", most).withColumn("least", least).filter("most >= least")
    large = large.withColumn("class", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))))
    names = ("node", "size", "place", "many", "root", "main", *_BITS)
    s = small.select("token", "class", *[F.col(c).alias(f"s_{c}") for c in names])
    l = large.select("token", "class", *[F.col(c).alias(f"l_{c}") for c in names])  # noqa: E741
    good = (F.col("s_root") != F.col("l_root")) & _fits("s_", "l_", percent) & _similar_sizes("s_", "l_", percent)
    good &= (F.col("s_size") < F.col("l_size")) | ((F.col("s_size") == F.col("l_size")) & (F.col("s_node") < F.col("l_node")))
    # What is in one of the sets only leaves less room for what they share.
    apart = sum((F.bit_count(F.col(f"s_{b}").bitwiseXOR(F.col(f"l_{b}"))) for b in _BITS), F.lit(0))
    total = F.col("s_size") + F.col("l_size")
    good &= p * (total - apart) >= 2 * percent * total
    pairs = [left.join(right, ["token", "class"]).filter(good) for left, right in ((l.filter("NOT l_main"), s), (l.filter("l_main"), s.filter("NOT s_main")))]
    pairs = pairs[0].unionByName(pairs[1])
    return _counted(pairs.select(F.least("s_node", "l_node").alias("a"), F.greatest("s_node", "l_node").alias("b"), F.least("s_many", "l_many").alias("l")))
