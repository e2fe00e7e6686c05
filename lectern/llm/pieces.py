"""SentencePiece encoding and decoding with exact N-best segmentations.

The encoding of a text is the tokenizer's own: the model's merges, of which its scores are the ranks, applied to each unit (see
below). Only the character U+2581, which the tokenizer takes for a blank, becomes byte pieces, so that decoding gives it back.

The N-best are those of the lattice: a text, with a blank before it, is a lattice of a model's pieces; a path's score is the sum
of its pieces' scores. Forward Viterbi gives the best score up to every place. Backward A-star search from the end with these
scores as its heuristic, which is exact, meets complete segmentations in order of their score. Characters that no piece has
become byte pieces. As sums of ranks say little of merges, the encoding need not be among these N.

Where two neighbouring characters stand together in no piece, every segmentation has a cut and no merge crosses it; the text
falls into *units* that are merged and searched on their own and kept. The N best of a text are exact: only the N - 1 unit occurrences whose second-best costs
least can differ from the best in them, and their combinations are ranked.

Decoding joins the pieces and drops the first blank; it gives back every text exactly, whatever its white space or characters.

Time and memory are linear in a unit's length, dividers of a hundred thousand equal characters included.

Defined results: null and empty texts have no pieces, score 0 and one segmentation. Ties go to the segmentation that the search
meets first, which depends on the unit alone, and to the earlier unit. Repeated rows get equal results; columns other than the
text are passed on.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowmap import add_text_columns
from .words import CACHES, ranges

N_BEST = 4
#: Units kept by a worker process; above it the cache starts anew. Longer units than LONG are searched each time.
CACHE_UNITS, LONG = 500_000, 1 << 12
#: Characters below it are looked up in a table of pairs.
NEAR = 512
_BLANK = "▁"


_LITTLE = sys.byteorder == "little"


def tree(score: dict[str, tuple]) -> dict[str, tuple]:
    """Pieces by their characters: each node has what comes next, and the score and ids of the piece that ends there (None: none does)."""
    root: dict[str, tuple] = {}
    for p, (s, ids) in sorted(score.items(), key=lambda x: -len(x[0])):
        node = root
        for c in p[:-1]:
            node = node.setdefault(c, ({}, 0.0, None))[0]
        node[p[-1]] = (node.get(p[-1], ({},))[0], s, ids)
    return root


class Pieces:
    """The pieces of a model file: ids and scores by their characters, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        self.score: dict[str, tuple[float, int]] = {}
        self.byte: dict[int, int] = {}
        self.bytes: list[bytes] = []
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                p = p.replace(_BLANK, " ")
                self.score.setdefault(p, (model.get_score(i), (i,)))
                self.bytes.append(p.encode())
        #: (score, ids) of each piece; an empty tuple for what only begins one.
        self.known: dict[str, tuple] = dict.fromkeys((p[:k] for p in self.score for k in range(1, len(p))), ()) | self.score
        self.root = tree(self.score)
        least = min(s for s, _ in self.score.values())
        #: Score of a byte piece: below all others, so that it is used for unknown characters only.
        self.byte_score = least - 10.0
        self.score_of = np.array([self.byte_score if model.is_byte(i) else model.get_score(i) for i in range(model.get_piece_size())])
        together = np.array(sorted({(ord(a) << 21) | ord(b) for p in self.score for a, b in zip(p, p[1:])}), np.uint64)
        self.together = together
        #: For characters below NEAR, a table of what `together` says.
        a, b = (together >> np.uint64(21)).astype(np.int64), (together & np.uint64((1 << 21) - 1)).astype(np.int64)
        near = (a < NEAR) & (b < NEAR)
        self.apart = np.ones(NEAR * NEAR, bool)
        self.apart[a[near] * NEAR + b[near]] = False

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """For neighbouring characters: whether no piece has them together."""
        low = np.minimum(points, NEAR - 1).astype(np.int32)
        out = self.apart[low[:-1] * NEAR + low[1:]]
        far = points >= NEAR
        far = np.flatnonzero(far[:-1] | far[1:])
        if len(far):
            key = (points[far].astype(np.uint64) << np.uint64(21)) | points[far + 1].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.together, key), len(self.together) - 1)
            out[far] = self.together[at] != key
        return out

    def merged(self, units: list[str]) -> list[tuple[float, bytes]]:
        """Score and ids of each unit as the model's merges leave it. A line feed, which merges with nothing, keeps the blank
        that the tokenizer puts first away from the unit; both are dropped."""
        if not units:
            return []
        found = [[self.byte[b] for b in u.encode()] if _BLANK in u else ids[2:] for u, ids in zip(units, self.model.encode(["\n" + u for u in units], num_threads=1))]
        at = np.cumsum([0] + [len(x) for x in found])
        flat = np.fromiter(itertools.chain.from_iterable(found), "<u4", at[-1])
        score, data, at = np.add.reduceat(self.score_of[flat], at[:-1]).tolist(), flat.tobytes(), (at * 4).tolist()
        return [(s, data[a:b]) for s, a, b in zip(score, at, at[1:])]

    def two_best(self, unit: str) -> tuple[float, bytes, float]:
        """Best score of a unit, its ids, and what the second best costs more, as `n_best` finds them: forward alone, as the second
        best up to a place ends with the second best piece there, or with the best one behind the second best up to that one."""
        size, root = len(unit), self.root
        best, second, back, gap = [-math.inf] * (size + 1), [-math.inf] * (size + 1), [None] * (size + 1), [math.inf] * (size + 1)
        best[0] = 0.0
        for i, c in enumerate(unit):
            here = best[i]
            if i:
                g, before = here - second[i], gap[back[i][1]]
                gap[i] = g if g < before else before
            node, end = root.get(c), i + 1
            if node is None or node[2] is None:  # its bytes stand for the character
                ids = tuple([self.byte[b] for b in c.encode("utf-8", "surrogatepass")])
                arcs = ((end, self.byte_score * len(ids), ids),)
            else:
                arcs = ()
            while node is not None:
                follow, s, ids = node
                if ids is not None:
                    total, b = here + s, best[end]
                    if total > b:
                        best[end], second[end], back[end] = total, b, (ids, i, s)
                    elif total >= second[end]:
                        second[end] = total
                        if total == b and ids < back[end][0]:
                            back[end] = (ids, i, s)
                if end == size:
                    break
                node = follow.get(unit[end])
                end += 1
            for end, s, ids in arcs:
                total, b = here + s, best[end]
                if total > b:
                    best[end], second[end], back[end] = total, b, (ids, i, s)
                elif total >= second[end]:
                    second[end] = total
                    if total == b and ids < back[end][0]:
                        back[end] = (ids, i, s)
        if not size:
            return 0.0, b"", math.inf
        cost = min(best[size] - second[size], gap[back[size][1]])
        score, taken, i = 0.0, [], size
        while i:
            ids, i, s = back[i]
            score += s
            taken.append(ids)
        own = array("I", itertools.chain.from_iterable(reversed(taken)))
        return score, own.tobytes() if _LITTLE else np.array(own, "<u4").tobytes(), cost

    def _lattice(self, unit: str) -> tuple[list[float], list[list]]:
        """Forward Viterbi: the best score up to every place, and of each place the pieces that end there: (minus the score of the
        best way through the piece, ids, start, own score)."""
        size, known = len(unit), self.known.get
        best, arcs = [-math.inf] * (size + 1), [[] for _ in range(size + 1)]
        best[0] = 0.0
        for i in range(size):
            here, end = best[i], i + 1
            piece = known(unit[i])
            if not piece:  # its bytes stand for the character
                ids = tuple([self.byte[b] for b in unit[i].encode("utf-8", "surrogatepass")])
                s = self.byte_score * len(ids)
                arcs[end].append((-here - s, ids, i, s))
                if here + s > best[end]:
                    best[end] = here + s
            while piece is not None:
                if piece:
                    total = here + piece[0]
                    arcs[end].append((-total, piece[1], i, piece[0]))
                    if total > best[end]:
                        best[end] = total
                end += 1
                if end > size:
                    break
                piece = known(unit[i:end])
        return best, arcs

    def n_best(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The best n (score, ids as little-endian 32-bit numbers) of a unit, best first.

        A search entry is an arc behind a partial segmentation, and points to the entry that it continues. As the heuristic is
        exact, an entry that is met needs two others only: the best arc that continues it, and the next best in its own place.
        Entries are at most twice the arcs of the n segmentations."""
        if not unit:
            return [(0.0, b"")]
        arcs = self._lattice(unit)[1]
        out, push, pop, number = [], heapq.heappush, heapq.heappop, 0
        sorted_ = bytearray(len(arcs))
        sorted_[-1] = 1
        arcs[-1].sort()
        # entries: minus the best score through it, place, number; then its arc, rank, score behind that place, and parent
        heap = [(arcs[-1][0][0], len(unit), 0, arcs[-1][0], 0, 0.0, None)]
        while heap:
            entry = pop(heap)
            _, end, _, (_, _, start, s), rank, behind, parent = entry
            own = arcs[end]
            rank += 1
            if rank < len(own):
                number += 1
                arc = own[rank]
                push(heap, (arc[0] - behind, end, number, arc, rank, behind, parent))
            behind += s
            if start:
                own = arcs[start]
                if not sorted_[start]:
                    sorted_[start] = 1
                    own.sort()
                number += 1
                arc = own[0]
                push(heap, (arc[0] - behind, start, number, arc, 0, behind, entry))
                continue
            ids = array("I")
            while entry is not None:
                ids.extend(entry[3][1])
                entry = entry[6]
            out.append((behind, ids.tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()))
            if len(out) == n:
                break
        return out

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


@functools.cache
def load(path: str) -> Pieces:
    return Pieces(path)


@functools.cache
def _picks(sizes: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    """Ranks to take from lists of such sizes that can be among the n least sums: each has all picks of smaller ranks before it."""
    return [pick for pick in itertools.product(*map(range, sizes)) if math.prod([j + 1 for j in pick]) <= n]


def _laid_out(ids: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units in order of their codes, and where each unit's begin."""
    if not len(codes):
        return np.empty(0, "<u4"), np.zeros(1, np.int64)
    length = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
    at = np.concatenate([[0], np.cumsum(length)])
    flat = np.frombuffer(b"".join(ids), "<u4")[ranges(at[codes], length[codes])]
    return flat, np.concatenate([[0], np.cumsum(length[codes])])


class Encoder:
    def __init__(self, path: str, n: int):
        self.pieces, self.n = load(path), n
        self.own: dict[str, tuple[float, bytes]] = {}
        self.two: dict[str, tuple[float, bytes, float]] = {}
        self.more: dict[str, list[tuple[float, bytes]]] = {}

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, and the texts' units as codes with bounds."""
        joined = "".join(" " + t if t else "" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum([0] + [len(t) + 1 if t else 0 for t in texts])
        start = np.zeros(len(points) + 1, bool)
        start[first] = True
        start[1:-1] |= self.pieces.cuts(points) if len(points) else False
        at = np.flatnonzero(start)
        # where each unit begins in UTF-8: an ASCII character is a byte, others one to three more
        wide = np.flatnonzero(points >= 0x80)
        more = np.cumsum(np.concatenate([[0], 1 + (points[wide] >= 0x800) + (points[wide] >= 0x10000)]))
        place = at + more[np.searchsorted(wide, at)]
        parts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(place.astype("<i8")), pa.py_buffer(joined.encode())]).dictionary_encode()
        return parts.dictionary.to_pylist(), np.asarray(parts.indices, dtype=np.int64), np.searchsorted(at, first)

    def encode(self, texts: list[str]) -> list[list[tuple[float, np.ndarray]]]:
        """For each text its best n (score, ids), best first."""
        return self.both(texts)[1]

    def both(self, texts: list[str]) -> tuple[list[tuple[float, np.ndarray]], list[list[tuple[float, np.ndarray]]]]:
        """For each text the tokenizer's (score, ids), and its best n, best first."""
        vocab, codes, bounds = self.units(texts)
        if len(self.two) > CACHE_UNITS:
            self.own, self.two, self.more = {}, {}, {}
        own, two = self.own, self.two
        new = [u for u in vocab if u not in two]
        own.update(zip(new, self.pieces.merged(new)))
        for u in new:
            two[u] = self.pieces.two_best(u)
        merged = [own[u] for u in vocab]
        flat, place = _laid_out([m[1] for m in merged], codes)
        per_unit = np.array([m[0] for m in merged])[codes] if len(codes) else np.zeros(0)
        encoded = [(float(per_unit[a:b].sum()), flat[place[a] : place[b]]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        found = [two[u] for u in vocab]
        long = [u for u in new if len(u) > LONG]
        score, extra = np.array([f[0] for f in found]), np.array([f[2] for f in found])
        length = np.fromiter((len(f[1]) // 4 for f in found), np.int64, len(found))
        flat, place = _laid_out([f[1] for f in found], codes)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            best, total = flat[place[a] : place[b]], float(score[codes[a:b]].sum())
            cost, n = extra[codes[a:b]], self.n
            near = np.argsort(cost, kind="stable")[: n - 1] if b - a <= 4 * n else np.sort(np.argpartition(cost, n - 1)[: n - 1])
            near = sorted(near[np.isfinite(cost[near])].tolist(), key=lambda k: (cost[k], k))
            choices = []
            for k in near:
                u = vocab[codes[a + k]]
                if u not in self.more:
                    self.more[u] = self.pieces.n_best(u, n)
                top = self.more[u][0][0]
                choices.append([(top - s, x) for s, x in self.more[u]])
            ranked = sorted((sum([c[j][0] for c, j in zip(choices, pick)]), pick) for pick in _picks(tuple([len(c) for c in choices]), n))[:n]
            rows = []
            for more, pick in ranked:
                x, shift = best, 0
                for k, j, c in sorted(zip(near, pick, choices), key=lambda z: z[0]):
                    if j:
                        lo = int(place[a + k] - place[a]) + shift
                        hi = lo + int(length[codes[a + k]])
                        new = np.frombuffer(c[j][1], "<u4")
                        x = np.concatenate([x[:lo], new, x[hi:]])
                        shift += len(new) - (hi - lo)
                rows.append((total - more, x))
            out.append(rows)
        for u in long:
            del own[u], two[u]
            self.more.pop(u, None)
        return encoded, out


@functools.cache
def encoder(path: str, n: int) -> Encoder:
    """One per worker process, so that its units serve all tasks that run there."""
    return Encoder(path, n)


CACHES["pieces"] = encoder.cache_clear


def segment(docs: DataFrame, model_path: str, n: int = N_BEST, keep_ids: bool = True) -> DataFrame:
    """`docs` with n_pieces, ids_crc32 and score of the tokenizer's segmentation, n_best (score, n_pieces, ids_crc32 of the best n
    of the lattice), round_trip (decoding the former gives the text back), and its ids if wanted."""
    kinds = [("n_pieces", T.LongType()), ("ids_crc32", T.LongType()), ("score", T.DoubleType()), ("n_best", T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType())]))), ("round_trip", T.BooleanType())]
    kinds += [("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []

    def make():
        own = encoder(model_path, n)

        def per_batch(column: pa.Array) -> list[pa.Array]:
            texts = pc.fill_null(column, "").to_pylist()
            encoded, found = own.both(texts)
            digest = [[(s, len(x), zlib.crc32(x)) for s, x in rows] for rows in found]
            inner = pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())])
            cols = [pa.array([len(x) for _, x in encoded], pa.int64()), pa.array([zlib.crc32(x) for _, x in encoded], pa.int64()), pa.array([s for s, _ in encoded], pa.float64()), pa.array([[dict(zip(("score", "n_pieces", "ids_crc32"), y)) for y in d] for d in digest], pa.list_(inner)), pa.array([own.pieces.decode(x) == t for (_, x), t in zip(encoded, texts)])]
            return cols + ([pa.array([x.astype(np.int32) for _, x in encoded], pa.list_(pa.int32()))] if keep_ids else [])

        return per_batch

    return add_text_columns(docs, [T.StructField(k, t) for k, t in kinds], make, owner="pieces")
