"""Sampled subword segmentations without replacement, and decoding, over the pieces of a SentencePiece model.

The segmentations of a text are the paths of a lattice whose arcs are pieces; a path's probability is proportional to the product
of its pieces' weights. Each set of paths has a perturbed score, the largest of its paths' log-probability plus Gumbel noise. The
search starts from the set of all paths and always splits the set with the highest score, from its best path outwards: at each
node of that path, the paths that leave it there are a set of their own, whose score is drawn below the score of the set that was
split. So paths come out in falling order of perturbed score, which are exact samples without replacement.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.bytetext import mix, span_hashes, utf8
from docaudit.llm.common import arrow_map, small_batches

SPACE = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """The pieces as arrays: a trie over their bytes, with blanks for U+2581; weights; bytes of each piece."""

    pairs: np.ndarray  # (node << 8 | byte) in order
    targets: np.ndarray  # the node behind each pair
    two: np.ndarray  # node behind two bytes from the root, -1 if none
    one: np.ndarray  # node behind one byte
    piece: np.ndarray  # the piece that ends in a node, or -1
    weights: np.ndarray  # logarithm of each piece's weight
    byte_piece: np.ndarray  # the piece of each single byte
    data: np.ndarray  # bytes of all pieces
    starts: np.ndarray  # where each piece's bytes begin, with the end


def vocabulary(model_file: str, scores: str = "ranks", flat: float = 10.0) -> Vocabulary:
    """Reads a model. scores="log": piece scores are log-probabilities. scores="ranks": they are negative merge ranks, as in BPE
    models; a piece of rank r then gets the weight 1 / (r + flat)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    weights, bytes_of, byte_piece = np.zeros(n), [b""] * n, np.full(256, -1, np.int32)
    nodes: list[dict[int, int]] = [{}]
    ends = {}
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        rank = min(-model.get_score(i), n) if not model.is_byte(i) else n
        weights[i] = model.get_score(i) if scores == "log" else -math.log(rank + flat)
        text = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_of[i] = bytes([int(text[3:5], 16)])
            byte_piece[bytes_of[i][0]] = i
            continue
        bytes_of[i] = text.replace(SPACE, " ").encode()
        at = 0
        for b in bytes_of[i]:
            if b not in nodes[at]:
                nodes[at][b] = len(nodes)
                nodes.append({})
            at = nodes[at][b]
        ends[at] = i
    if (byte_piece < 0).any():
        raise ValueError("the model has no pieces for single bytes, so some texts cannot be encoded")
    pairs = sorted((at << 8 | b, to) for at, node in enumerate(nodes) for b, to in node.items())
    one, two = np.full(256, -1, np.int32), np.full(1 << 16, -1, np.int32)
    for b, to in nodes[0].items():
        one[b] = to
        for c, then in nodes[to].items():
            two[b << 8 | c] = then
    piece = np.full(len(nodes), -1, np.int32)
    for at, i in ends.items():
        piece[at] = i
    starts = np.concatenate([[0], np.cumsum([len(x) for x in bytes_of])])
    return Vocabulary(np.array([p for p, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int32), two, one, piece, weights, byte_piece, np.frombuffer(b"".join(bytes_of), np.uint8), starts)


class Lattice:
    """All segmentations of some units: text parts that no piece reaches beyond.

    Nodes are byte positions; arcs are grouped by the node they leave. chance: of an arc among those of its node; upto: the sum of
    chances up to and with it.
    """

    def __init__(self, v: Vocabulary, data: np.ndarray, starts: np.ndarray):
        """data: the units' bytes one after another, starts: where each begins, with the end."""
        n = len(data)
        unit_end = np.repeat(starts[1:], np.diff(starts))
        wide = data.astype(np.int32)
        begin, length, piece = [], [], []
        at, node = np.arange(n), v.one[wide]
        depth = 1
        while True:
            alive = node >= 0
            at, node = at[alive], node[alive]
            found = v.piece[node]
            hit = found >= 0
            begin.append(at[hit])
            length.append(np.full(int(hit.sum()), depth, np.int32))
            piece.append(found[hit])
            more = at + depth < unit_end[at]
            at, node = at[more], node[more]
            if not len(at):
                break
            if depth == 1:
                node = v.two[wide[at] << 8 | wide[at + 1]]
            else:
                key = node.astype(np.int64) << 8 | wide[at + depth]
                i = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
                node = np.where(v.pairs[i] == key, v.targets[i], -1)
            depth += 1
        # A character that is no piece itself is spelled in bytes.
        heads = np.flatnonzero(data & 0xC0 != 0x80)
        sizes = np.diff(np.append(heads, n))
        known = np.zeros(n, bool)
        size_at = np.zeros(n, np.int32)
        size_at[heads] = sizes
        for b, m in zip(begin, length):
            known[b[m == size_at[b]]] = True
        spelled = np.repeat(~known[heads], sizes)
        odd = np.flatnonzero(spelled)
        begin.append(odd)
        length.append(np.ones(len(odd), np.int32))
        piece.append(v.byte_piece[data[odd]])
        begin, length, piece = (np.concatenate(x) for x in (begin, length, piece))
        # Arcs in order of what is left of the unit behind their start, so that sums run from the end backwards in slices.
        left = (unit_end - np.arange(n)).astype(np.int32)
        order = np.argsort(left[begin].astype(np.int64) * n + begin, kind="stable")
        begin, length, piece = begin[order], length[order], piece[order]
        self.end, self.piece, self.start = begin + length, piece, begin
        first = np.ones(len(begin), bool)
        first[1:] = np.diff(begin) != 0
        groups = np.flatnonzero(first)
        self.first = np.full(n + 1, -1, np.int64)
        self.first[begin[groups]] = groups
        steps = left[begin]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(steps)) + 1, [len(begin)]])
        group_of_cut = np.searchsorted(groups, cuts)
        rest = np.full(n + 1, -np.inf)
        rest_end = np.zeros(n + 1, bool)
        rest_end[starts[1:]] = True
        score = v.weights[piece]
        total = np.zeros(len(begin))
        reaches_end = rest_end[self.end] & (self.end == unit_end[begin])
        for a, b, g, h in zip(cuts[:-1], cuts[1:], group_of_cut[:-1], group_of_cut[1:]):
            value = score[a:b] + np.where(reaches_end[a:b], 0.0, rest[self.end[a:b]])
            total[a:b] = value
            heads_here = groups[g:h] - a
            top = np.maximum.reduceat(value, heads_here)
            size = np.diff(np.append(heads_here, b - a))
            safe = np.where(np.isfinite(top), top, 0.0)
            rest[begin[groups[g:h]]] = np.log(np.add.reduceat(np.exp(value - np.repeat(safe, size)), heads_here)) + safe
        with np.errstate(invalid="ignore"):
            self.log_chance = np.where(np.isfinite(total), total - rest[begin], -np.inf)
        self.chance = np.exp(self.log_chance)
        size = np.diff(np.append(groups, len(begin)))
        # Summed within each node, so that rounding does not depend on what else is in the batch.
        self.upto = self.chance.copy()
        for nth in range(1, int(size.max(initial=1))):
            more = groups[size > nth] + nth
            self.upto[more] += self.upto[more - 1]
        self.last = np.zeros(len(begin), bool)
        self.last[groups + size - 1] = True

    def arcs(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each node, the arc that a uniform number picks."""
        arc = self.first[at]
        open_ = np.flatnonzero((self.upto[arc] <= u) & ~self.last[arc])
        while len(open_):
            arc[open_] += 1
            open_ = open_[(self.upto[arc[open_]] <= u[open_]) & ~self.last[arc[open_]]]
        # Rounding may leave an arc of no chance, then the one before it.
        wrong = np.flatnonzero(self.chance[arc] == 0)
        while len(wrong):
            arc[wrong] -= 1
            wrong = wrong[self.chance[arc[wrong]] == 0]
        return arc


def _uniform(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a seed and a counter."""
    x = mix(mix(seed) + (number.astype(np.uint64) + np.uint64(1)) * _STEP)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _below(top: np.ndarray, place: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel noise around a place, given that it lies below top."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - place)


def _paths(lattice: Lattice, at: np.ndarray, ends: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of a random path from each ``at`` to its ``ends``, one after another, and how many each has. places: counters of the random numbers."""
    counts = np.zeros(len(at), np.int64)
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    active, at = np.flatnonzero(at < ends), at.copy()
    offset = places - at
    while len(active):
        here = at[active]
        arc = lattice.arcs(here, _uniform(seeds[active], here + offset[active]))
        taken.append((active, arc))
        counts[active] += 1
        at[active] = lattice.end[arc]
        active = active[at[active] < ends[active]]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.empty(int(counts.sum()), np.int64)
    for step, (which, arc) in enumerate(taken):
        out[starts[which] + step] = arc
    return out, counts


def sample_batch(v: Vocabulary, column: pa.Array, keys: np.ndarray, samples: int, seed: int):
    """For every text its samples: lists of (pieces, log-probability, inclusion). keys: a 64-bit number per text that seeds it."""
    data, offsets = utf8(column)
    docs = len(offsets) - 1
    # A blank before each text, as the model's encoder puts it.
    data = np.insert(data, offsets[:-1], 32)
    offsets = offsets + np.arange(docs + 1)
    n = len(data)
    new = np.zeros(n + 1, bool)
    blank, line = data == 32, data == 10
    new[1:n] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    new[offsets] = True
    bounds = np.flatnonzero(new)
    starts, ends = bounds[:-1], bounds[1:]
    _, sample_of, unit = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes = (ends - starts)[sample_of]
    unit_starts = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(starts[sample_of] - unit_starts[:-1], sizes) + np.arange(unit_starts[-1])
    lattice = Lattice(v, data[take], unit_starts)
    unit_first = np.searchsorted(starts, offsets)
    doc_of = np.repeat(np.arange(docs), np.diff(unit_first))
    seeds = mix(keys.view(np.uint64) ^ mix(np.array([seed], np.uint64)))
    place = starts - offsets[doc_of]
    arcs, counts = _paths(lattice, unit_starts[unit], unit_starts[unit + 1], seeds[doc_of], place)
    arc_first = np.concatenate([[0], np.cumsum(counts)])
    doc_first = arc_first[unit_first]

    def sets(arcs: np.ndarray, first: np.ndarray, before: np.ndarray, top: np.ndarray, stream: int, offset: np.ndarray):
        """Scores of the sets of paths that leave each path at each arc. before: the path's log-probability up to its first arc here."""
        size = np.diff(first)
        logs = lattice.log_chance[arcs]
        here, total = np.empty(len(arcs)), before.copy()
        for j, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if b > a:
                sums = np.cumsum(logs[a:b])
                here[a], here[a + 1 : b] = before[j], before[j] + sums[:-1]
                total[j] += sums[-1]
        with np.errstate(divide="ignore"):
            away = here + np.log1p(-np.minimum(lattice.chance[arcs], 1.0))
        which = np.repeat(np.arange(len(size)), size)
        number = np.arange(len(arcs)) - np.repeat(first[:-1] - offset, size)
        noise = _uniform(stream_seeds[which] + np.uint64(stream * 2 + 1), number)
        score = np.where(away > -np.inf, _below(np.repeat(top, size), np.where(away > -np.inf, away, 0.0), noise), -np.inf)
        return score, here, total

    stream_seeds = mix(seeds + np.uint64(77))
    tops = -np.log(-np.log(_uniform(stream_seeds, np.zeros(docs))))
    score, here, total = sets(arcs, doc_first, np.zeros(docs), tops, 0, np.zeros(docs, np.int64))
    paths: list[list] = [[] for _ in range(docs)]
    heaps: list[list] = []
    for d in range(docs):
        a, b = int(doc_first[d]), int(doc_first[d + 1])
        paths[d].append((arcs[a:b], float(total[d])))
        own = score[a:b]
        best = np.argpartition(own, len(own) - samples)[-samples:] if len(own) > samples else np.arange(len(own))
        # score, path, place, log-probability before it, arcs taken there
        heaps.append([(-float(own[i]), 0, int(i), float(here[a + i]), (int(arcs[a + i]),)) for i in best if own[i] > -np.inf])
        heapq.heapify(heaps[d])
    unit_of_arc = None
    for s in range(1, samples):
        todo = [d for d in range(docs) if heaps[d]]
        if not todo:
            break
        heads, tails_at, tails_end, tails_doc, tails_place, ranges = [], [], [], [], [], []
        for d in todo:
            g, path, i, before, taken = heapq.heappop(heaps[d])
            whole = paths[d][path][0]
            node = int(lattice.start[taken[0]])
            first = int(lattice.first[node])
            group = np.arange(first, first + 1 + int(np.argmax(lattice.last[first:])))
            chances = lattice.chance[group].copy()
            chances[np.isin(group, taken)] = 0
            sums = np.cumsum(chances)
            if sums[-1] <= 0:
                heads.append(None)
                ranges.append((len(tails_at), len(tails_at)))
                continue
            u = float(_uniform(stream_seeds[d : d + 1] + np.uint64(s * 2), np.array([i]))[0])
            arc = int(group[min(int(np.searchsorted(sums, u * sums[-1], "right")), int(np.flatnonzero(chances)[-1]))])
            left = 1.0 - float(lattice.chance[list(taken)].sum()) - float(lattice.chance[arc])
            if len(taken) + 1 < len(group) and left > 1e-15:
                again = float(_below(np.array([-g]), np.array([before + math.log(left)]), _uniform(stream_seeds[d : d + 1] + np.uint64(s * 2 + 1), np.array([-1 & 0x7FFFFFFF])))[0])
                heapq.heappush(heaps[d], (-again, path, i, before, (*taken, arc)))
            # Where the text goes on: the rest of this unit, then the units behind it.
            k = int(unit_first[d] + np.searchsorted(np.cumsum(np.diff(bounds[unit_first[d] : unit_first[d + 1] + 1])), _reached(lattice, whole[:i], arc), "left"))
            u_at = unit[k]
            at_first = int(lattice.end[arc])
            behind = np.arange(k + 1, unit_first[d + 1])
            ranges.append((len(tails_at), len(tails_at) + 1))
            tails_at.append(np.concatenate([[at_first], unit_starts[unit[behind]]]))
            tails_end.append(np.concatenate([[unit_starts[u_at + 1]], unit_starts[unit[behind] + 1]]))
            tails_doc.append(np.full(len(behind) + 1, d))
            tails_place.append(np.concatenate([[place[k] + at_first - unit_starts[u_at]], place[behind]]))
            heads.append((g, whole[:i], arc, before + float(lattice.log_chance[arc]), i))
        if not tails_at:
            continue
        docs_of = np.concatenate(tails_doc)
        new_arcs, new_counts = _paths(lattice, np.concatenate(tails_at), np.concatenate(tails_end), seeds[docs_of] + np.uint64(s), np.concatenate(tails_place))
        tail_first = np.concatenate([[0], np.cumsum([len(x) for x in tails_at])])
        first = np.concatenate([[0], np.cumsum(new_counts)])[tail_first]
        live = [(d, h) for d, h in zip(todo, heads) if h is not None]
        saved, stream_seeds_all = stream_seeds, stream_seeds
        stream_seeds = stream_seeds_all[[d for d, _ in live]]
        score, here, total = sets(new_arcs, first, np.array([h[3] for _, h in live]), np.array([-h[0] for _, h in live]), s, np.array([h[4] + 1 for _, h in live]))
        stream_seeds = saved
        for j, (d, (g, head, arc, before, i)) in enumerate(live):
            a, b = int(first[j]), int(first[j + 1])
            paths[d].append((np.concatenate([head, [arc], new_arcs[a:b]]), float(total[j])))
            own = score[a:b]
            best = np.argpartition(own, len(own) - samples)[-samples:] if len(own) > samples else np.arange(len(own))
            for m in best:
                if own[m] > -np.inf:
                    heapq.heappush(heaps[d], (-float(own[m]), len(paths[d]) - 1, i + 1 + int(m), float(here[a + m]), (int(new_arcs[a + m]),)))
    for d in range(docs):
        limit = -heaps[d][0][0] if heaps[d] else -math.inf
        yield [(lattice.piece[path], log, -math.expm1(-math.exp(min(log - limit, 50.0))) if limit > -math.inf else 1.0) for path, log in paths[d]]


def _reached(lattice: Lattice, head: np.ndarray, arc: int) -> int:
    """How many bytes of the text the head and the arc cover."""
    return int((lattice.end[head] - lattice.start[head]).sum() + lattice.end[arc] - lattice.start[arc])


def piece_bytes(v: Vocabulary, pieces: np.ndarray) -> bytes:
    """The text that pieces spell, without the blank before it; pieces without bytes, such as control pieces, spell nothing."""
    sizes = v.starts[pieces + 1] - v.starts[pieces]
    ends = np.cumsum(sizes)
    take = np.repeat(v.starts[pieces] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    text = v.data[take].tobytes()
    return text[1:] if text[:1] == b" " else text


def encode(docs: DataFrame, model_file: str, samples: int = 2, seed: int = 0, scores: str = "ranks", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct sampled segmentations of every text: key, sample (from 1), pieces, log_prob, inclusion, round_trip.

    ``samples`` rows per document, fewer if it has fewer segmentations. log_prob: of the segmentation given the text. inclusion: the
    chance that it is among the samples given the score of the best path left out, so that exp(log_prob) / inclusion weighs it;
    1 if no path is left out. round_trip: the pieces decode to the text. Characters that are no piece are spelled in byte
    pieces, U+2581 too, so that all texts come back.

    All random numbers come from the seed and the key, so rows do not depend on how the data is dealt. Null texts count as empty;
    an empty text has the pieces of a single blank. Rows that repeat a key and text get equal samples; null keys share one seed.
    An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file, scores))

    def run(batches):
        v = shared.value
        for batch in batches:
            keys = batch.column("seed").to_numpy()
            for low, high in _slices(batch.column("text")):
                texts = batch.column("text").slice(low, high - low)
                data, offsets = utf8(texts)
                rows, sample, pieces, logs, inclusion, good = [], [], [], [], [], []
                for i, found in enumerate(sample_batch(v, texts, keys[low:high], samples, seed)):
                    whole = data[offsets[i] : offsets[i + 1]].tobytes()
                    for j, (ids, log, chance) in enumerate(found):
                        rows.append(low + i)
                        sample.append(j + 1)
                        pieces.append(ids.astype(np.int32))
                        logs.append(log)
                        inclusion.append(chance)
                        good.append(piece_bytes(v, ids) == whole)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int32)))
                ids = batch.column("id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sample, pa.int32()), lists, pa.array(logs, pa.float64()), pa.array(inclusion, pa.float64()), pa.array(good, pa.bool_())], ["id", "sample", "pieces", "log_prob", "inclusion", "round_trip"])

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key).cast("string")).alias("seed"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = arrow_map(rows, run, f"id {kind}, sample int, pieces array<int>, log_prob double, inclusion double, round_trip boolean")
    return out.withColumnRenamed("id", key)


def _slices(column: pa.Array, most: int = 2 << 20):
    """Ranges of rows of some MB of text, one row at least, so that the lattices of a batch fit in memory."""
    _, offsets = utf8(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def decode(rows: DataFrame, model_file: str, pieces: str = "pieces", text: str = "text") -> DataFrame:
    """Adds the text that lists of pieces spell; null lists give null. A column of that name is replaced."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(model_file))

    @F.pandas_udf("string")
    def spell(column):
        v = shared.value
        return column.map(lambda ids: None if ids is None else piece_bytes(v, np.asarray(ids, np.int64)).decode("utf-8", "replace"))

    return rows.withColumn(text, spell(F.col(pieces)))
