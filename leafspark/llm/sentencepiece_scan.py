"""SentencePiece encoding and decoding by a max-plus scan.

A text's segmentation is the best path through the lattice of pieces. With a unigram model an edge weighs the
piece's log probability. With a BPE model, whose result is defined by merges, an edge weighs 0 and may only
follow a piece it is compatible with: two pieces are compatible if merging their joint text yields just those
two. Exactly one chain of compatible pieces spells a text, and it is what merging yields, so the same scan
gives the library's result for both kinds of model.

States: a node of the lattice is a position and, for BPE, the piece that ends there. At a *cut* all paths
meet in one state: between two characters that stand side by side in no piece of the vocabulary, such as the
end of a word and the next blank sign.

Giant documents are split into chunks of ``chunk`` characters at any place. Every chunk, with a piece's
length of context on either side, yields its transfer matrix: for each state in which a path can enter (a piece
that reaches into the chunk or ends at its border) the best weight to each state in which it can leave. The
matrices of a document are combined with the associative max-plus product, which gives the states at all
borders of the best path; then each chunk is traced back on its own between its two states. Chunks, not
documents, are spread over the cluster, and only matrices of a document meet in one task (a few hundred bytes
where a chunk has a cut). Other documents are one chunk, encoded in place without a shuffle: the distinct words
of some MB of texts are cut into stretches between cuts, which are scanned side by side in arrays, each once.
What a worker keeps from one slice of texts to the next is bounded in bytes.

Edge cases: null texts give null ids; the empty text gives no ids. Characters outside the vocabulary become
byte pieces (or the unknown piece if the model has none). Repeated rows are encoded one by one. A text that
holds the blank sign U+2581 itself decodes to a blank there, as with the library.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import SPREAD, Table
from ._common import fresh, shuffle_partitions, slices, tidy, written

BLANK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32768
_MEMO_BYTES = 24 << 20  # of the words whose ids a worker keeps from one slice of texts to the next
_ENTRY = 170  # bytes of one such entry beside its contents
_SLICE = 2 << 20  # bytes of text encoded at a time
_PAIRS, _PAIR_BITS = 60_000, 20  # pairs of pieces whose compatibility is kept
_SHORT, _LANES = 48, 16384  # characters of stretches that are scanned side by side, and how many at a time
_RUN = re.compile(r"[^\W\d_]+|.", re.S)
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


class Model:
    """Vocabulary and settings of a SentencePiece model file."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the blank sign before words are supported")
        kind = proto.trainer_spec.model_type
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.bpe = kind == 2
        self.prefix = bool(spec.add_dummy_prefix)
        self.pieces = [p.piece for p in proto.pieces]
        self.vocab = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER)}
        self.weights = {p.piece: p.score for p in proto.pieces if p.type in (_NORMAL, _USER)}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.longest = max(map(len, self.vocab))
        self.plain = [
            bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE
            else p.piece.replace(BLANK, " ").encode() if p.type in (_NORMAL, _USER)
            else " ⁇ ".encode() if p.type == _UNKNOWN else b""
            for p in proto.pieces
        ]
        self.beside = {v[i : i + 2] for v in self.vocab for i in range(len(v) - 1)}
        self.words_apart = not any(BLANK in v.lstrip(BLANK) for v in self.vocab)

    def merge(self, s: str, steps: list | None = None) -> list[str]:
        """The BPE segmentation of a short string: merge the best-scored pair, the leftmost of equals.

        ``steps`` receives the merged pairs in order.
        """
        parts, weights = list(s), self.weights
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                w = weights.get(parts[i] + parts[i + 1])
                if w is not None and (best is None or w > best):
                    best, at = w, i
            if at < 0:
                break
            if steps is not None:
                steps.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Lanes:
    """The scan over many short stretches side by side, for BPE models.

    Stretches advance one position at a time: at each, all walk down the trie of pieces together, and a piece
    that is compatible with the one ending there becomes the last piece where it ends.
    """

    def __init__(self, scanner: Scanner) -> None:
        model, weights = scanner.model, scanner.model.weights
        names = list(model.vocab)
        letters = {c for v in names for c in v} - set(names)
        self.own = {v: i for i, v in enumerate([*names, *sorted(letters)])}
        self.unknown = len(self.own)
        self.known = len(names)
        self.ids = np.array([model.vocab[v] for v in names], np.int32)
        self.length = np.array([*map(len, self.own), 1], np.int64)
        self.longest = int(self.length.max())
        self.spell = lambda c: scanner.ids([c])
        nodes: dict[str, int] = {"": 0}
        steps: dict[int, int] = {}
        pieces = {0: -1}
        for v in sorted(scanner.edges | letters):
            for k in range(1, len(v) + 1):
                if v[:k] not in nodes:
                    nodes[v[:k]] = len(nodes)
                    steps[nodes[v[: k - 1]] << 32 | ord(v[k - 1])] = nodes[v[:k]]
            pieces[nodes[v]] = self.own[v]
        self.steps = Table.of(steps)
        self.piece = np.array([pieces.get(i, -1) for i in range(len(nodes))], np.int32)
        order = {w: 2 * i for i, w in enumerate(sorted(set(weights.values())))}
        never = 2 * len(order) + 9
        self.rank = np.full(len(self.own) + 1, never, np.int64)  # of the merge that makes a piece
        self.left, self.right = (np.zeros(len(self.own) + 1, np.int64) for _ in range(2))
        for v, (x, y) in scanner.halves.items():
            i = self.own[v]
            self.rank[i], self.left[i], self.right[i] = order[weights[v]], self.own[x], self.own[y]
        self.never = never
        own = self.own
        self.crossing = Table.of(
            {own[v[:k]] << 32 | own[v[k:]]: order[weights[v]] for v in names for k in range(1, len(v)) if v[:k] in own and v[k:] in own}
        )
        self.asked = np.full(1 << _PAIR_BITS, 2**64 - 1, np.uint64)  # the last pair of each slot, and its answer
        self.answer = np.zeros(1 << _PAIR_BITS, bool)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces stay apart when their joint text is merged; recent answers are kept by slot."""
        pair = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = (pair * SPREAD) >> np.uint64(64 - _PAIR_BITS)
        out = self.answer[slot]
        new = np.flatnonzero(self.asked[slot] != pair)
        if len(new):
            out[new] = self.apart(a[new], b[new])
            self.asked[slot[new]] = pair[new]
            self.answer[slot[new]] = out[new]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As the scanner's method of this name, for arrays of pieces; weights are even ranks here."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, until = a.astype(np.int64), b.astype(np.int64), np.full(len(a), -1, np.int64)
        while len(live):
            met = self.crossing.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) > until
            ok[live[met]] = False
            left, right = self.rank[a], self.rank[b]
            go = ~met & (np.minimum(left, right) < self.never)
            live, a, b, left, right = live[go], a[go], b[go], left[go], right[go]
            first = left < right
            until = np.where(first, left, right - 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def segment(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches that begin at ``begin`` in ``codes``, longest first, and their bounds in the ids."""
        n = len(size)
        reach = np.searchsorted(-size, -np.arange(size[0] + 2), side="left")  # how many are longer than a position
        last = np.full((size[0] + 1, n), self.unknown, np.int32)
        for p in range(size[0]):
            state, lane = np.zeros(reach[p], np.uint64), np.arange(reach[p])
            before = last[p]
            for k in range(min(self.longest, size[0] - p)):
                if lane[-1] >= reach[p + k]:
                    some = np.searchsorted(lane, reach[p + k])
                    lane, state = lane[:some], state[:some]
                to = self.steps.get((state << np.uint64(32)) | codes[begin[lane] + (p + k)])
                on = to >= 0
                lane, to = lane[on], to[on]
                if not len(lane):
                    break
                piece = self.piece[to]
                ends = np.flatnonzero(piece >= 0)
                if len(ends):
                    into, own = lane[ends], piece[ends]
                    if p:
                        ok = self.follows(before[into], own)
                        into, own = into[ok], own[ok]
                    last[p + k + 1, into] = own
                state = to.astype(np.uint64)
        at, lane, found = size.copy(), np.arange(n), []
        while len(lane):
            piece = last[at[lane], lane]
            at[lane] -= self.length[piece]
            found.append((lane * size[0] + at[lane], piece))
            lane = lane[at[lane] > 0]
        place = np.concatenate([f[0] for f in found])
        order = np.argsort(place)
        place, piece = place[order], np.concatenate([f[1] for f in found])[order]
        return self._ids(piece, codes[begin[place // size[0]] + place % size[0]], np.searchsorted(place, np.arange(n + 1) * size[0]))

    def _ids(self, piece: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, those outside the vocabulary being spelt by ``code``, and the moved bounds."""
        outside = np.flatnonzero(piece >= self.known)
        if not len(outside):
            return self.ids[piece], bounds
        spelt = {int(c): self.spell(chr(c)) for c in np.unique(code[outside])}
        width = np.ones(len(piece), np.int64)
        width[outside] = [len(spelt[c]) for c in code[outside].tolist()]
        start = np.concatenate([[0], np.cumsum(width)])
        out = np.empty(start[-1], np.int32)
        out[start[:-1]] = self.ids[np.minimum(piece, self.known - 1)]
        for c, ids in spelt.items():
            places = start[outside[code[outside] == c]]
            for k, i in enumerate(ids):
                out[places + k] = i
        return out, start[bounds]

    def segment_all(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Stretches end to end: an order of them, and the packed ids of each in that order."""
        order, begin, out = np.argsort(-size, kind="stable"), np.cumsum(size) - size, []
        for k in range(0, len(order), _LANES):
            some = order[k : k + _LANES]
            ids, bounds = self.segment(codes, begin[some], size[some])
            packed, at = ids.tobytes(), (4 * bounds).tolist()
            out += [packed[i:j] for i, j in zip(at, at[1:], strict=False)]
        return order, out


class Scanner:
    """Lattice paths of one model. Pieces are strings here; unknown characters are pieces of their own."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.compatible: dict[tuple[str, str], bool] = {}
        self.words: dict[bytes, bytes] = {}  # ids of words, as many as fit in _MEMO_BYTES
        self.held = 0
        edges = set(model.vocab)
        self.halves: dict[str, tuple[str, str]] = {}
        if model.bpe:
            edges = set()
            for v in model.vocab:
                steps: list = []
                if model.merge(v, steps) == [v]:
                    edges.add(v)
                    if steps:
                        self.halves[v] = steps[-1]
        self.edges = edges
        least = min(model.weights.values(), default=0.0)
        self.weight = (lambda t: 0.0) if model.bpe else (lambda t: model.weights.get(t, least - 10))
        self.lanes = Lanes(self) if model.bpe else None

    def follows(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stay apart when their joint text is merged."""
        key = (a, b)
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) > _PAIRS:
                self.compatible.clear()
            # Pieces of blank signs alone share one score, so only merging itself tells their order.
            blanks = a[-1] == BLANK and b[0] == BLANK
            found = self.compatible[key] = self.model.merge(a + b) == [a, b] if blanks else self.apart(a, b)
        return found

    def apart(self, a: str, b: str) -> bool:
        """Undo the merges next to the border, the latest first, and see if the border could merge earlier."""
        weights, halves, until = self.model.weights, self.halves, -np.inf
        while True:
            crossing = weights.get(a + b)
            if crossing is not None and crossing > until:
                return False
            left = weights[a] if a in halves else np.inf
            right = weights[b] if b in halves else np.inf
            if left == right == np.inf:
                return True
            if left < right:
                until, a = left, halves[a][1]
            else:  # of equal merges the left one comes first, so one across the border precedes the right one
                until, b = np.nextafter(right, -np.inf), halves[b][0]

    def is_cut(self, s: str, at: int) -> bool:
        """Whether all paths meet between ``s[at - 1]`` and ``s[at]``."""
        if at <= 0 or at >= len(s):
            return True
        return s[at - 1 : at + 1] not in self.model.beside

    def segment(self, s: str) -> list[str]:
        """The best path over ``s``, entered and left at cuts."""
        n, longest, edges = len(s), self.model.longest, self.edges
        if self.model.bpe:
            return [s] if s in edges else self._chain(s)
        back: list[int] = [0] * (n + 1)
        best = [0.0] + [-np.inf] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                piece = s[start:end]
                if piece in edges or start == end - 1:
                    w = best[start] + self.weight(piece)
                    if w > best[end]:
                        best[end], back[end] = w, start
        out, at = [], n
        while at:
            out.append(s[back[at] : at])
            at = back[at]
        return out[::-1]

    def _chain(self, s: str) -> list[str]:
        """The chain of compatible pieces over ``s``: the last piece of every beginning, by position."""
        n, longest, edges, known = len(s), self.model.longest, self.edges, self.compatible.get
        last = [""] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = s[start:end]
                if piece in edges or start == end - 1:
                    ok = True
                    if start:
                        ok = known((last[start], piece))
                        if ok is None:
                            ok = self.follows(last[start], piece)
                    if ok:
                        last[end] = piece
                        break
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids(self, pieces: list[str]) -> list[int]:
        out, model = [], self.model
        for p in pieces:
            i = model.vocab.get(p)
            if i is not None:
                out.append(i)
            elif model.bytes:
                out += [model.bytes[c] for c in p.encode()]
            else:
                out.append(model.unknown)
        return out

    def stretches(self, s: str) -> list[str]:
        """``s``, entered and left at cuts, in parts between cuts next to signs; long parts at all cuts."""
        out, at, beside = [], 0, self.model.beside
        for m in _RUN.finditer(s):
            i = m.end()
            if i == len(s) or s[i - 1 : i + 1] not in beside:
                own, at = s[at:i], i
                if len(own) <= _SHORT:
                    out.append(own)
                else:
                    lo = 0
                    for k in range(1, len(own) + 1):
                        if k == len(own) or own[k - 1 : k + 1] not in beside:
                            out.append(own[lo:k])
                            lo = k
        return out

    def scanned(self, stretches: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct stretches; short ones of BPE models are scanned side by side."""
        short = [s for s in stretches if len(s) <= _SHORT and BLANK + BLANK not in s] if self.lanes else []
        out = {}
        if short:
            codes = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32).astype(np.uint64)
            order, ids = self.lanes.segment_all(codes, np.fromiter(map(len, short), np.int64, len(short)))
            out = dict(zip(map(short.__getitem__, order.tolist()), ids, strict=True))
        return out | {s: self.packed(s) for s in stretches if s not in out}

    def part(self, s: str) -> bytes:
        """Packed ids of ``s``, entered and left at cuts."""
        parts = self.stretches(s)
        made = self.scanned([*set(parts)])
        return b"".join([made[p] for p in parts])

    def packed(self, s: str) -> bytes:
        return array("i", self.ids(self.segment(s))).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, as packed 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes | None]) -> list[bytes | None]:
        """Packed ids of each text; every distinct word between blanks is segmented once."""
        blank, words, whole = BLANK.encode(), set(), {}
        by_word = self.model.prefix and self.model.words_apart
        for k, text in enumerate(texts):
            if text:
                if not by_word or text[:1] == b" " or text[-1:] == b" " or b"  " in text or blank in text:
                    whole[k] = self.part(self.normal(text.decode()))
                else:
                    words.update(text.split(b" "))
        if self.held > _MEMO_BYTES:
            self.words = {w: self.words[w] for w in words if w in self.words}
            self.held = sum(len(w) + len(ids) + _ENTRY for w, ids in self.words.items())
        known = self.words
        new = [*words.difference(known)]
        short = [w for w in new if len(w) < _SHORT] if self.lanes else []
        if short:  # no word holds the blank sign, so it marks where they begin
            codes = np.frombuffer((blank + blank.join(short)).decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
            order, ids = self.lanes.segment_all(codes, np.diff(np.append(np.flatnonzero(codes == ord(BLANK)), len(codes))))
            known.update(zip(map(short.__getitem__, order.tolist()), ids, strict=True))
        for w in new:
            if w not in known:
                known[w] = self.part(BLANK + w.decode())
        self.held += sum(map(len, new)) + sum(map(len, map(known.__getitem__, new))) + _ENTRY * len(new)
        get = known.__getitem__
        return [
            text if not text else whole[k] if k in whole else b"".join(map(get, text.split(b" ")))
            for k, text in enumerate(texts)
        ]

    def normal(self, text: str) -> str:
        return (BLANK if self.model.prefix and text else "") + text.replace(" ", BLANK)

    # Chunks: ``s`` is a stretch of the normalised text, of which s[a:b] is the chunk's own.

    def entries(self, s: str, a: int) -> list[tuple[int, str | None]]:
        """States, as (characters past the border, last piece), in which a path can enter at ``a``."""
        if a == 0:
            return [(0, None)]
        found = set()
        for start in range(max(0, a - self.model.longest), a):
            for end in range(a, min(len(s), start + self.model.longest) + 1):
                if s[start:end] in self.edges or end == start + 1:
                    found.add(self.state(s, end, s[start:end], a))
        return sorted(found, key=lambda x: (x[0], x[1] or ""))

    def state(self, s: str, at: int, piece: str | None, border: int) -> tuple[int, str | None]:
        return at - border, None if not self.model.bpe or self.is_cut(s, at) else piece

    def paths(self, s: str, start: int, last: str | None, stop: int) -> dict:
        """(position, last piece): (weight, state before, piece), by pieces that begin before ``stop``."""
        best = {(start, last): (0.0, None, None)}
        waiting = {start: [(start, last)]}
        longest, bpe = self.model.longest, self.model.bpe
        for at in range(start, stop):
            for state in waiting.pop(at, ()):
                weight = best[state][0]
                for end in range(at + 1, min(len(s), at + longest) + 1):
                    piece = s[at:end]
                    if piece not in self.edges and end > at + 1:
                        continue
                    if bpe and state[1] is not None and not self.follows(state[1], piece):
                        continue
                    to = (end, self.state(s, end, piece, 0)[1])
                    w = weight + self.weight(piece)
                    if to not in best:
                        waiting.setdefault(end, []).append(to)
                    elif w <= best[to][0]:
                        continue
                    best[to] = (w, state, piece)
        return best

    def cuts(self, s: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and the last cut in s[a:b]."""
        first = next((i for i in range(a, b) if i and self.is_cut(s, i)), None)
        return None if first is None else (first, next(i for i in range(b - 1, a - 1, -1) if self.is_cut(s, i)))

    def matrix(self, s: str, a: int, b: int) -> dict:
        """Transfer matrix of a chunk: {entry: {exit: weight}}, states relative to the borders."""
        exits = lambda best: {(p - b, last): w for (p, last), (w, _, _) in best.items() if p >= b}
        cut = self.cuts(s, a, b)
        if cut is None:
            made = {e: exits(self.paths(s, a + e[0], e[1], b)) for e in self.entries(s, a) if a + e[0] <= b}
            made |= {e: {(a + e[0] - b, e[1]): 0.0} for e in self.entries(s, a) if a + e[0] > b}
            return {e: x for e, x in made.items() if x}
        first, last = cut
        middle = 0.0 if self.model.bpe else sum(self.weight(p) for p in self.pieces_between(s, first, last))
        after = {x: w + middle for x, w in exits(self.paths(s, last, None, b)).items()}
        out = {}
        for e in self.entries(s, a):
            if a + e[0] <= first and (found := self.paths(s, a + e[0], e[1], first).get((first, None))):
                out[e] = {x: w + found[0] for x, w in after.items()}
        return out

    def pieces_between(self, s: str, a: int, b: int) -> list[str]:
        """The best path between two cuts."""
        out, at = [], a
        for i in range(a + 1, b + 1):
            if i == b or self.is_cut(s, i):
                out += self.segment(s[at:i])
                at = i
        return out

    def trace(self, s: str, a: int, b: int, entry: tuple, leave: tuple) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the path between the two states."""

        def back(best: dict, to: tuple) -> list[str]:
            out = []
            while best[to][1] is not None:
                out.append(best[to][2])
                to = best[to][1]
            return out[::-1]

        start, to = a + entry[0], (b + leave[0], leave[1])
        cut = self.cuts(s, a, b)
        if cut is None:
            return [] if start >= b else self.ids(back(self.paths(s, start, entry[1], b), to))
        head = back(self.paths(s, start, entry[1], cut[0]), (cut[0], None))
        tail = back(self.paths(s, cut[1], None, b), to)
        return self.ids(head) + np.frombuffer(self.part(s[cut[0] : cut[1]]), np.int32).tolist() + self.ids(tail)


def product(a: dict, b: dict) -> dict:
    """The max-plus product of two transfer matrices."""
    out = {}
    for entry, row in a.items():
        new: dict = {}
        for state, w in row.items():
            for leave, v in b.get(state, {}).items():
                if leave not in new or w + v > new[leave]:
                    new[leave] = w + v
        if new:
            out[entry] = new
    return out


def borders(matrices: list[dict]) -> list[tuple]:
    """The states of the best path at the borders of consecutive chunks, by a tree of products.

    Upwards neighbouring matrices are multiplied; downwards the state at the border between two halves is the
    best one between the outer states, which are known by then.
    """
    tree = [matrices]
    while len(tree[-1]) > 1:
        level = tree[-1]
        tree.append([product(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)])
    root = tree[-1][0]
    states = [(0, None), max(root[(0, None)].items(), key=lambda x: (x[0][0] == 0, x[1]))[0]]
    for level in reversed(tree[:-1]):
        finer = [states[0]]
        for k, (entry, leave) in enumerate(zip(states, states[1:], strict=False)):
            if 2 * k + 1 < len(level):
                left, right = level[2 * k][entry], level[2 * k + 1]
                finer.append(max((s for s in left if leave in right.get(s, {})), key=lambda s: left[s] + right[s][leave]))
            finer.append(leave)
        states = finer
    return states


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_models: dict[int, Model] = {}
_scanners: dict[int, Scanner] = {}


def _model(shared) -> Model:
    """One model per worker, until a task ends."""
    if shared.id not in _models:
        _models.clear()
        _models[shared.id] = Model(shared.value)
    return _models[shared.id]


def _scanner(shared) -> Scanner:
    """One scanner, with its memos, per worker and model, until a task ends."""
    if shared.id not in _scanners:
        _scanners.clear()
        _scanners[shared.id] = Scanner(_model(shared))
    return _scanners[shared.id]


def _forget() -> None:
    """Drop what a worker holds for its next task: it may be one of another operator."""
    _scanners.clear()
    _models.clear()


class _Shared:
    def __init__(self, broadcast, own: int) -> None:
        self.broadcast, self.id = broadcast, own

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _share(df: DataFrame, model: str | bytes) -> _Shared:
    data = model if isinstance(model, bytes) else load(model)
    return _Shared(df.sparkSession.sparkContext.broadcast(data), hash(data))


def _lists(packed: list[bytes | None]) -> pa.ListArray:
    sizes = [0 if p is None else len(p) // 4 for p in packed]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32))
    gone = pa.array([p is None for p in packed])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=gone)


def encode(
    docs: DataFrame, text_col: str = "text", out: str = "ids", model: str | bytes = MODEL, chunk: int = CHUNK
) -> DataFrame:
    """``docs`` with the array column ``out`` of piece ids. ``model``: a path on the driver, or the file's bytes."""
    shared = _share(docs, model)
    docs = docs.select(*[c for c in docs.columns if c != out])
    giant = F.coalesce(F.length(text_col) > chunk, F.lit(False))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = docs.columns.index(text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            for rows in slices(batch, at, _SLICE):
                packed = scanner.encode_all(rows.column(at).cast(pa.large_binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*rows.columns, _lists(packed)], names=schema.names)

    small = docs.where(~giant).mapInArrow(tidy(whole, _forget), schema)
    big = docs.where(giant)
    return small.unionByName(_encode_giants(big, text_col, out, shared, chunk))


def _encode_giants(docs: DataFrame, text_col: str, out: str, shared: _Shared, chunk: int) -> DataFrame:
    own = fresh(docs, "row")
    docs = written(docs.withColumn(own, F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        side = scanner.model.longest
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                s = scanner.normal(text.as_py())
                for k, at in enumerate(range(0, len(s), chunk)):
                    lo, end = max(0, at - side - 1), min(len(s), at + chunk)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": pa.array([row.as_py()], pa.int64()),
                            "k": pa.array([k], pa.int32()),
                            "s": pa.array([s[lo : end + side + 1]]),
                            "a": pa.array([at - lo], pa.int32()),
                            "b": pa.array([end - lo], pa.int32()),
                        }
                    )

    chunks = docs.select(own, text_col).mapInArrow(tidy(split, _forget), "row bigint, k int, s string, a int, b int")
    chunks = written(chunks.repartition(shuffle_partitions(docs), "row", "k"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            made = [
                pickle.dumps(scanner.matrix(s, a, b))
                for s, a, b in zip(*[batch.column(c).to_pylist() for c in ("s", "a", "b")], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(made, pa.binary())], names=["row", "k", "m"])

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        states = borders([pickle.loads(m.as_py()) for m in rows.column("m")])
        found = [pickle.dumps(pair) for pair in zip(states, states[1:], strict=False)]
        return pa.table({"row": rows.column("row"), "k": rows.column("k"), "states": pa.array(found, pa.binary())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            ids = [
                np.array(scanner.trace(s, a, b, *pickle.loads(states)), np.int32).tobytes()
                for s, a, b, states in zip(*[batch.column(c).to_pylist() for c in ("s", "a", "b", "states")], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), _lists(ids)], names=["row", "k", "ids"])

    made = chunks.mapInArrow(tidy(matrices, _forget), "row bigint, k int, m binary")
    states = made.groupBy("row").applyInArrow(scan, "row bigint, k int, states binary")
    traced = chunks.join(states, ["row", "k"]).mapInArrow(tidy(trace, _forget), "row bigint, k int, ids array<int>")
    ids = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    ids = ids.select(F.col("row").alias(own), F.flatten(F.col("parts.ids")).alias(out))
    return docs.join(ids, own).drop(own)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str | bytes = MODEL) -> DataFrame:
    """``df`` with the string column ``out``, the text of the piece ids; null for null."""
    shared = _share(df, model)
    df = df.select(*[c for c in df.columns if c != out])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        plain = model.plain.__getitem__
        for batch in batches:
            lists = batch.column(at)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = []
            for k in range(len(lists)):
                if not lists[k].is_valid:
                    texts.append(None)
                    continue
                text = b"".join(map(plain, values[offsets[k] : offsets[k + 1]].tolist()))
                text = text[1:] if model.prefix and text[:1] == b" " else text
                texts.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(tidy(run, _forget), schema)
