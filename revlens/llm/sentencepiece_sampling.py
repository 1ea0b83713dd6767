"""SentencePiece encoding with sampled segmentations, and decoding (operator 3).

The piece lattice of a text is cut between two characters that stand side by
side in no piece of the loaded vocabulary, so no piece crosses a cut and the
text's lattice is a chain of small lattices, here called words.  Forward filtering sums, for every place of a
word, the weight of all segmentations up to it; backward sampling draws the
last piece by those sums, then the piece before it, and so on.  The draws are
hashes of (seed, row key, place), so a row always gets the same segmentation.
Frequent words keep their filtered lattice; draws are vectorised over all words
of a batch.

The model's scores are merge ranks; a piece of rank r has weight
(r + 1) ** -``alpha``.  A character without a piece, and a U+2581 of the text,
become byte pieces, so decoding gives back every text exactly.

Defined cases: a null or empty text has no pieces and decodes to the empty
text; equal rows get equal samples, equal texts under other keys their own; a
null key is a key; an empty table gives an empty result; other columns are
ignored.  A word of more than ``LONGEST`` characters is not cut: it is filtered
in blocks that overlap by the longest piece, and its blocks are filtered again
from their stored beginnings, last to first, for the draws.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship
from .words import mix, slices

MARK = "\u2581"
LONGEST = 64            # weights of longer words would underflow
_BLOCK = 4096
_CACHE = 400_000
_SLICE = 2 << 20
_models: dict[tuple[str, float], "Lattice"] = {}


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


_LITERAL = 0x110000     # a U+2581 of the text; no piece has it
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Filtered lattices of words, in one growing table of arcs.

    A node is a place of a word; its arcs are the pieces that end there, with
    running shares of the forward weight.  ``node + share`` ascends over the
    whole table, so one search finds the drawn arc of any number of nodes."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [b""] * sp.get_piece_size()
        self.byte = np.zeros(256, dtype=np.int64)
        found: list[tuple[str, int, float]] = []
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                texts[i] = bytes([int(name[3:5], 16)])
                self.byte[texts[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                texts[i] = name.replace(MARK, " ").encode()
                found.append((name, i, (1.0 - sp.get_score(i)) ** -alpha))
        self.longest = max(len(f[0]) for f in found)
        self.least = min(f[2] for f in found)
        key = np.array([int(self._hash(np.array([[ord(c) for c in f[0]]]))[len(f[0]) - 1][0, 0]) for f in found], dtype=np.uint64)
        order = np.argsort(key)
        self.key, self.id = key[order], np.array([f[1] for f in found])[order]
        self.weight = np.array([f[2] for f in found])[order]
        if (self.key[1:] == self.key[:-1]).any():
            raise ValueError("two pieces share a hash")
        pairs = {(ord(a), ord(b)) for f in found for a, b in zip(f[0].replace(MARK, " "), f[0].replace(MARK, " ")[1:])}
        self.pairs = np.array(sorted(a << 32 | b for a, b in pairs), dtype=np.int64)
        self.common = np.zeros((256, 256), dtype=bool)     # the pairs of small codes
        for a, b in pairs:
            if a < 256 and b < 256:
                self.common[a, b] = True
        self.sizes = np.array([len(t) for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.reset()

    def _hash(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each run length from 1: hashes of the runs that begin at each place."""
        n = codes.shape[1]
        h = np.zeros((codes.shape[0], n), dtype=np.uint64)
        out = []
        for k in range(1, min(n, getattr(self, "longest", n)) + 1):
            h = (h[:, :n - k + 1] + codes[:, k - 1:].astype(np.uint64) + np.uint64(1)) * _BASE
            out.append(h)
        return out

    def reset(self) -> None:
        self.last: dict[str, int] = {}      # word -> its final node
        self.nodes_used = self.arcs_used = 0
        self.cum, self.ids, self.back = np.empty(1 << 16), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.begins = np.empty(1 << 16, dtype=bool)

    def _room(self, arcs: int, nodes: int) -> None:
        for name, used, more in (("cum", self.arcs_used, arcs), ("ids", self.arcs_used, arcs),
                                 ("back", self.arcs_used, arcs), ("begins", self.nodes_used, nodes)):
            old = getattr(self, name)
            if used + more > len(old):
                new = np.empty(max(used + more, 2 * len(old)), dtype=old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)

    def _arcs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and id of the piece of k + 1 characters that ends at each place of each row."""
        g, n = codes.shape
        plain = codes
        codes = np.where(codes == ord(MARK), _LITERAL, np.where(codes == 32, ord(MARK), codes))
        most = min(n, self.longest)
        weight = np.zeros((g, n, most))
        piece = np.zeros((g, n, most), dtype=np.int64)
        for k, h in enumerate(self._hash(codes)):
            at = np.searchsorted(self.key, h)
            at[at == len(self.key)] = 0
            hit = self.key[at] == h
            weight[:, k:, k] = np.where(hit, self.weight[at], 0)
            piece[:, k:, k] = self.id[at]
        # A character without a piece is its bytes; the id tells the character.
        none = weight[:, :, 0] == 0
        piece[:, :, 0] = np.where(none, -1 - plain, piece[:, :, 0])
        weight[:, :, 0] = np.where(none, self.least, weight[:, :, 0])
        return weight, piece

    def words(self, text: str) -> list[str]:
        """The words of a text, before which a space is put."""
        if not text:
            return []
        text = " " + text
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        a, b = codes[:-1], codes[1:]
        joined = self.common[np.minimum(a, 255), np.minimum(b, 255)]
        far = np.flatnonzero((a > 254) | (b > 254))
        if len(far):
            pair = a[far].astype(np.int64) << 32 | b[far].astype(np.int64)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[far] = self.pairs[at] == pair
        cuts = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(text)]
        return [text[i:j] for i, j in zip(cuts, cuts[1:])]

    def draw_long(self, word: str, stream: int) -> np.ndarray:
        """A sampled segmentation of a word of any length, in memory for one
        block and the sums at the blocks' beginnings."""
        codes = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        n, most = len(codes), self.longest

        def block(lo: int, before: list[float]) -> tuple[list, list[float]]:
            """Arcs (k, share, id) that end at each place of a block; ``before``
            are the sums of the ``most`` places up to ``lo``, in one scale."""
            hi, back = min(lo + _BLOCK, n), max(0, lo - most)
            weight, piece = self._arcs(codes[None, back:hi])
            weight, piece = weight[0, lo - back:], piece[0, lo - back:]
            which, ks = np.nonzero(weight)
            w, ids, ks = weight[which, ks].tolist(), piece[which, ks].tolist(), ks.tolist()
            ptr = np.searchsorted(which, np.arange(hi - lo + 1)).tolist()
            ahead = list(before)             # ahead[-1 - k]: the sum k + 1 characters before the place's end
            arcs = []
            for e in range(hi - lo):
                here = [(ks[j], w[j] * ahead[-1 - ks[j]], ids[j]) for j in range(ptr[e], ptr[e + 1])]
                arcs.append(here)
                ahead.append(sum(x[1] for x in here))
                if ahead[-1] < 1e-100 or ahead[-1] > 1e100:    # only ratios count
                    scale = 1 / ahead[-1]
                    ahead[-most:] = [x * scale for x in ahead[-most:]]
            return arcs, ahead[-most:]

        begins = [[0.0] * (most - 1) + [1.0]]
        for lo in range(0, n - _BLOCK, _BLOCK):
            begins.append(block(lo, begins[-1])[1])
        drawn, at, step = [], n, 0
        for i in range(len(begins) - 1, -1, -1):
            lo = i * _BLOCK
            arcs = block(lo, begins[i])[0] if at > lo else []
            draws = mix(np.uint64(stream) + np.arange(step, step + max(0, at - lo), dtype=np.uint64) * _BASE)
            draws = ((draws >> np.uint64(11)) * 2.0 ** -53).tolist()
            first = step
            while at > lo:
                here = arcs[at - lo - 1]
                left = draws[step - first] * sum(x[1] for x in here)
                for k, share, piece in here:
                    left -= share
                    if left < 0:
                        break
                else:                        # rounding: the last arc with a share
                    k, share, piece = next(x for x in reversed(here) if x[1] > 0)
                drawn.append(piece)
                at -= k + 1
                step += 1
        return np.array(drawn[::-1], dtype=np.int64)

    def add(self, words: list[str]) -> None:
        """Filter the lattices of new words of one length forward."""
        g, n = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(g, n).astype(np.int64)
        weight, piece = self._arcs(codes)
        most = weight.shape[2]
        # Sums up to each place as logarithms, so that no weight runs out of range.
        with np.errstate(divide="ignore"):
            arcs = np.log(weight)
        ahead = np.zeros((g, n + 1))
        for e in range(1, n + 1):
            near = min(e, most)
            arc = arcs[:, e - 1, :near] + ahead[:, e - near:e][:, ::-1]
            top = arc.max(axis=1)
            here = np.exp(arc - top[:, None])
            total = here.sum(axis=1)
            weight[:, e - 1, :near] = here / total[:, None]
            ahead[:, e] = top + np.log(total)
        share = np.cumsum(weight, axis=2)
        word, place, k = np.nonzero(weight > 0)
        first = self.nodes_used + word * (n + 1)
        self._room(len(word), g * (n + 1))
        new = slice(self.arcs_used, self.arcs_used + len(word))
        last = np.append((word[1:] != word[:-1]) | (place[1:] != place[:-1]), True)
        run = share[word, place, k]
        self.cum[new] = first + place + 1 + np.where(last, 0.9999999, np.minimum(run, 0.999999))
        self.ids[new] = piece[word, place, k]
        self.back[new] = first + place - k
        begins = self.begins[self.nodes_used:self.nodes_used + g * (n + 1)].reshape(g, n + 1)
        begins[:] = False
        begins[:, 0] = True
        for i, w in enumerate(words):
            self.last[w] = self.nodes_used + i * (n + 1) + n
        self.arcs_used += len(word)
        self.nodes_used += g * (n + 1)

    def nodes(self, words: list[str]) -> np.ndarray:
        if len(self.last) > _CACHE:
            self.reset()
        last = self.last
        by_length: dict[int, list[str]] = {}
        last[""] = -1                         # a word that is too long for the table
        for w in set(words).difference(last):
            by_length.setdefault(len(w), []).append(w)
        for n, new in by_length.items():
            new.sort()                        # the table does not depend on hash order
            for i in range(0, len(new), 2000):
                self.add(new[i:i + 2000])
        return np.fromiter(map(last.__getitem__, words), dtype=np.int64, count=len(words))


def lattice(path: str, alpha: float) -> Lattice:
    if (path, alpha) not in _models:
        _models[path, alpha] = Lattice(path, alpha)
    return _models[path, alpha]


def sample(texts: list[str], keys: np.ndarray, lat: Lattice, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and where each begins."""
    words: list[str] = []
    count = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = lat.words(t)
        count[i] = len(w)
        words += w
    long = [i for i, w in enumerate(words) if len(w) > LONGEST]
    node = lat.nodes(["" if len(w) > LONGEST else w for w in words] if long else words)
    ptr = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(texts)), count)
    stream = mix(mix(keys.view(np.uint64) ^ np.uint64(seed))[doc] + (np.arange(len(words)) - ptr[doc]).astype(np.uint64))
    cum, ids, back, begins = lat.cum[:lat.arcs_used], lat.ids, lat.back, lat.begins
    order = np.argsort(node, kind="stable")     # neighbours in the table are looked up together
    length = np.zeros(len(words), dtype=np.int64)
    runs_of_long = [lat.draw_long(words[i], int(stream[i])) for i in long] if long else []
    if long:
        short = node[order] >= 0
        order = order[short]
    at, stream = node[order], stream[order]
    for i, r in zip(long, runs_of_long):
        length[i] = len(r)
    drawn = []
    step = 0
    while len(order):
        u = (mix(stream + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)) * 2.0 ** -53
        arc = np.searchsorted(cum, at + u * 0.9999998)
        drawn.append((order, ids[arc]))
        length[order] += 1
        at = back[arc]
        more = ~begins[at]
        order, at, stream = order[more], at[more], stream[more]
        step += 1
    place = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(place[-1], dtype=np.int64)
    for k, (w, i) in enumerate(drawn):          # the last piece was drawn first
        out[place[w] + length[w] - 1 - k] = i
    for i, r in zip(long, runs_of_long):
        out[place[i]:place[i + 1]] = r
    first = place[ptr]
    odd = np.flatnonzero(out < 0)
    if len(odd):                                # characters without a piece become byte pieces
        codes, which = np.unique(-1 - out[odd], return_inverse=True)
        runs = [lat.byte[list(chr(c).encode())] for c in codes]
        sizes = np.ones(len(out), dtype=np.int64)
        sizes[odd] = np.array([len(r) for r in runs])[which]
        moved = np.concatenate([[0], np.cumsum(sizes)])
        wide = np.repeat(out, sizes)
        for k, r in enumerate(runs):
            at = moved[odd[which == k]]
            for j, i in enumerate(r):
                wide[at + j] = i
        out, first = wide, moved[first]
    return out, first


def decode(ids: np.ndarray, first: np.ndarray, lat: Lattice) -> list[str]:
    """The texts of runs of piece ids; the space before the first word goes."""
    size = lat.sizes[ids]
    end = np.concatenate([[0], np.cumsum(size)])
    flat = lat.bytes[np.arange(end[-1]) + np.repeat(lat.starts[ids] - end[:-1], size)].tobytes()
    cut = end[first]
    return [flat[a + 1:b].decode() for a, b in zip(cut[:-1], cut[1:])]


def encode_documents(docs: DataFrame, path: str | None = None, alpha: float = 1.0, seed: int = 0,
                     with_ids: bool = True) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, lossless`` (and ``ids``): a sampled
    segmentation of every text, whether decoding gives the text back, and the
    CRC-32 of its ids as little-endian 32-bit numbers."""
    ship(docs.sparkSession)
    model = path or default_model()
    fields = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    names = ["doc_id", "n_pieces", "ids_crc32", "lossless"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, alpha)
        for b in batches:
            for t in slices(b.column(2), _SLICE):
                n = len(t.ptr) - 1
                texts = [x or "" for x in b.column(2).slice(t.first, n).to_pylist()]
                keys = b.column(1).slice(t.first, n).to_numpy()
                ids, first = sample(texts, keys, lat, seed)
                back = decode(ids, first, lat)
                small = ids.astype("<i4")
                out = [b.column(0).slice(t.first, n), pa.array(np.diff(first)),
                       pa.array([zlib.crc32(small[i:j].tobytes()) for i, j in zip(first[:-1], first[1:])], pa.int64()),
                       pa.array([x == y for x, y in zip(texts, back)])]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(small)))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("key"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def decode_documents(encoded: DataFrame, path: str | None = None, alpha: float = 1.0) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    ship(encoded.sparkSession)
    model = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, alpha)
        for b in batches:
            rows = [np.array(x or [], dtype=np.int64) for x in b.column(1).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            texts = decode(np.concatenate([*rows, np.zeros(0, np.int64)]), first, lat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
