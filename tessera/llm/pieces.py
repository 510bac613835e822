"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over a trellis of text positions with a back pointer at each.
A position is extended by pieces of at most the longest piece's length, so a
window of that many positions is all that can still change. Whenever the back
pointers of all positions in the window lead through one boundary, the ids up
to it are final and leave.

What decides among paths depends on the model's type. A unigram model takes
the path with the greatest score. The ids of a BPE model are not those of the
greatest score; there a step is allowed just if the merge rules would leave
the two adjacent pieces apart (the `stable` test), which holds for exactly
one path into each position: the ids are then those of merging by rank.

Texts are cut before each space that follows something else, and around
control characters: no piece reaches over these, so all paths converge there
and the ids so far leave. A stretch between two such boundaries that is no
longer than the longest piece fits the window whole: distinct ones are searched
together, one trellis column at a time, with numpy. In a longer stretch the
window moves: it goes through the stream encoder, which commits on the way.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words as W

#: Stretches searched together.
MATRIX_ROWS = 1 << 16
#: Added to the least score for a character without a piece (fixed value of the format).
UNKNOWN_PENALTY = 10.0

SPACE_MARK = "▁"


@dataclass
class Vocabulary:
    """Pieces by id with scores; `surface` are the bytes matched (None for reserved ids), with the mark as a space."""

    surface: list[bytes | None]
    score: np.ndarray
    bpe: bool
    unknown: int
    byte_ids: list[int] | None
    children: np.ndarray = field(init=False)
    ends: np.ndarray = field(init=False)

    def __post_init__(self):
        index = {s: i for i, s in enumerate(self.surface) if s is not None}
        if any(after == 32 and before != 32 for s in index for before, after in zip(s, s[1:])):
            raise ValueError("pieces with a space behind something else are not supported: texts are cut there")
        self.index, self.longest = index, max(map(len, index), default=1)
        self.unk = len(self.surface)  # stands for a character without a piece, of which each byte may become an id
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for s, i in index.items():
            at = 0
            for byte in s:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][byte]
            ends[at] = i
        self.trie = nodes
        # Bytes that occur, renumbered, so that the table of children stays small.
        used = sorted({b for n in nodes for b in n})
        self.column = np.full(256, len(used), np.int32)
        self.column[used] = np.arange(len(used))
        self.children = np.full((len(nodes), len(used) + 1), -1, np.int32)
        for at, n in enumerate(nodes):
            for b, to in n.items():
                self.children[at, self.column[b]] = to
        self.ends = np.array(ends, np.int32)
        #: Control bytes that no piece holds.
        self.apart = np.array([b < 32 and b not in used for b in range(256)])
        if self.bpe:
            self._merges()

    def _merges(self) -> None:
        """Per piece, when and of which two it is merged; per mergeable pair, its piece."""
        n = len(self.surface)
        self.rank = np.zeros(n + 1, np.int64)  # 0: a character, else the later the greater
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        order = sorted((i for s, i in self.index.items() if _chars(s) > 1), key=lambda i: (-self.score[i], i))
        for r, i in enumerate(order):
            self.rank[i] = r + 1
        pairs: dict[tuple[int, int], int] = {}
        for s, i in self.index.items():
            for cut in range(1, len(s)):
                a, b = self.index.get(s[:cut]), self.index.get(s[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = pairs
        for s, i in self.index.items():
            if _chars(s) > 1:
                parts = self._merge(s)
                if parts is not None:
                    self.left[i], self.right[i] = parts
        keys = np.array([a * (n + 1) + b for a, b in pairs], np.int64)
        at = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[at], self.rank[np.array(list(pairs.values()), np.int64)][at]
        #: Pieces that merging never makes.
        self.dead = np.array([s is None or (_chars(s) > 1 and self.left[i] < 0) for i, s in enumerate(self.surface)] + [False])
        self.known: dict[int, bool] = {}

    def _merge(self, s: bytes) -> tuple[int, int] | None:
        """The last merge that makes s, or None if merging does not end in s."""
        at = [self.index.get(c.encode(), -1) for c in s.decode()]
        last = None
        while len(at) > 1:
            best = min(((self.rank[self.pairs[p]], j) for j, p in enumerate(zip(at, at[1:])) if p in self.pairs), default=None)
            if best is None:
                return None
            j = best[1]
            last = (at[j], at[j + 1])
            at[j : j + 2] = [self.pairs[last]]
        return last

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b, side by side, as they are.

        Undoes the merges of both, latest first: they stay apart if at no time
        the two symbols at the border would have merged with each other first.
        """
        n = len(self.surface) + 1
        ok = ~(self.dead[a] | self.dead[b])
        x, y, limit, right_undone = a.astype(np.int64), b.astype(np.int64), np.full(len(a), 1 << 60), np.zeros(len(a), bool)
        live = np.flatnonzero(ok & (x != self.unk) & (y != self.unk))
        while len(live):
            u, v = x[live], y[live]
            key = u * n + v
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            q = np.where(self.pair_keys[at] == key, self.pair_rank[at], 1 << 61) if len(self.pair_keys) else np.full(len(live), 1 << 61)
            bad = (q < limit[live]) | ((q == limit[live]) & right_undone[live])
            ok[live[bad]] = False
            go = ~bad & ((self.rank[u] > 0) | (self.rank[v] > 0))
            live, u, v = live[go], u[go], v[go]
            ru, rv = self.rank[u], self.rank[v]
            undo_left = ru > rv  # of equal pieces the left one is made first
            limit[live] = np.maximum(ru, rv)
            right_undone[live] = ~undo_left
            x[live] = np.where(undo_left, self.right[u], u)
            y[live] = np.where(undo_left, v, self.left[v])
        return ok

    def stable_pair(self, a: int, b: int) -> bool:
        key = a * (self.unk + 1) + b
        if key not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[key] = bool(self.stable(np.array([a]), np.array([b]))[0])
        return self.known[key]


def _chars(s: bytes) -> int:
    return sum((b & 0xC0) != 0x80 for b in s)


def _char_bytes(lead):
    return 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)


def load(path: str) -> Vocabulary:
    """Read a .model file whose normaliser is the identity with a dummy prefix."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kind = model.normalizer_spec, model.pieces[0]
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("only the identity normaliser with a dummy prefix is supported")
    if model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    plain = [p.piece.replace(SPACE_MARK, " ").encode() if p.type == kind.NORMAL else None for p in model.pieces]
    if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    byte_ids = [0] * 256 if model.trainer_spec.byte_fallback else None
    if byte_ids:
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                byte_ids[int(p.piece[1:-1], 16)] = i
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
    return Vocabulary(plain, np.array([p.score for p in model.pieces]), model.trainer_spec.model_type == 2, unknown, byte_ids)


class StreamEncoder:
    """Encode one stretch of bytes fed in pieces; `feed` and `finish` return the ids that have become final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text, self.base = b"", 0  # bytes from position `base` on
        self.nodes = {0: (None, -1, 0.0)}  # position: (position before, piece, score)
        self.at, self.done = 0, 0

    def _extend(self, until: int) -> list[int]:
        v, out = self.v, []
        floor = min((v.score[i] for i in v.index.values()), default=0.0) - UNKNOWN_PENALTY if not v.bpe else 0.0
        while self.at < until:
            here = self.nodes.get(self.at)
            if here is not None:
                node, whole = 0, False
                first = self.text[self.at - self.base]
                wide = _char_bytes(first)
                for i in range(self.at, min(self.base + len(self.text), self.at + v.longest)):
                    node = v.trie[node].get(self.text[i - self.base], -1)
                    if node < 0:
                        break
                    if v.ends[node] >= 0:
                        whole |= i + 1 - self.at == wide
                        self._offer(here, i + 1, int(v.ends[node]), here[2] + v.score[v.ends[node]])
                if not whole:
                    self._offer(here, self.at + wide, v.unk, here[2] + floor)
            self.at += 1
            if self.at % 64 == 0:
                out += self._commit()
        return out

    def _offer(self, here, to: int, piece: int, score: float) -> None:
        if self.v.bpe:
            if here[1] < 0 and not (piece < self.v.unk and self.v.dead[piece]) or here[1] >= 0 and self.v.stable_pair(here[1], piece):
                self.nodes[to] = (self.at, piece, score)
        elif to not in self.nodes or score > self.nodes[to][2]:
            self.nodes[to] = (self.at, piece, score)

    def _commit(self) -> list[int]:
        """Ids up to the boundary through which all surviving paths lead."""
        alive = {p for p in self.nodes if p >= self.at} | {p for p in self.nodes if self.at - self.v.longest < p < self.at}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            before = self.nodes[last][0]
            if before is None:
                return []
            alive.add(before)
        return self._emit(alive.pop()) if alive else []

    def _emit(self, boundary: int) -> list[int]:
        pieces, p = [], boundary
        while p > self.done:
            before, piece, _ = self.nodes[p]
            pieces.append((before, p, piece))
            p = before
        ids: list[int] = []
        for a, b, piece in reversed(pieces):
            ids += [piece] if piece < self.v.unk else self._unknown(self.text[a - self.base : b - self.base])
        if boundary > self.done:
            _, piece, score = self.nodes[boundary]
            self.nodes = {p: n for p, n in self.nodes.items() if p > boundary}
            self.nodes[boundary] = (None, piece, score)
            self.text, self.base, self.done = self.text[boundary - self.base :], boundary, boundary
        return ids

    def _unknown(self, char: bytes) -> list[int]:
        return [self.v.byte_ids[b] for b in char] if self.v.byte_ids else [self.v.unknown]

    def feed(self, data: bytes) -> list[int]:
        self.text += data
        return self._extend(self.base + len(self.text) - self.v.longest)

    def finish(self) -> list[int]:
        end = self.base + len(self.text)
        return self._extend(end) + self._emit(end)


def _matrix_ids(v: Vocabulary, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, where each stretch's pieces end) for stretches in the rows of a zero-padded matrix."""
    n, width = text.shape
    last = np.full((n, width + 1), -1, np.int32)
    back = np.zeros((n, width + 1), np.int32)
    total = None if v.bpe else np.full((n, width + 1), -np.inf)
    if total is not None:
        total[:, 0] = 0
    floor = 0.0 if v.bpe else min((v.score[i] for i in v.index.values()), default=0.0) - UNKNOWN_PENALTY
    column = v.column[text]

    def offer(rows, s, e, piece):
        if v.bpe:
            before = last[rows, s]
            if s:
                key = before.astype(np.int64) * (v.unk + 1) + piece
                kinds, where = np.unique(key, return_inverse=True)
                fits = v.stable(kinds // (v.unk + 1), kinds % (v.unk + 1))[where]
            else:
                fits = ~v.dead[piece]
            rows, piece = rows[fits], piece[fits]
        else:
            score = total[rows, s] + np.where(piece == v.unk, floor, v.score[np.minimum(piece, v.unk - 1)])
            end = e if np.ndim(e) else np.full(len(rows), e)
            better = score > total[rows, end]
            rows, piece = rows[better], piece[better]
            total[rows, end[better]] = score[better]
            e = end[better] if np.ndim(e) else e
            last[rows, e], back[rows, e] = piece, s
            return
        if np.ndim(e):
            e = e[fits]
        last[rows, e], back[rows, e] = piece, s

    for s in range(width):
        rows = np.flatnonzero((length > s) & ((last[:, s] >= 0) if s else True))
        if not len(rows):
            continue
        wide = _char_bytes(text[rows, s])
        whole = np.zeros(len(rows), bool)
        node, live = np.zeros(len(rows), np.int32), np.arange(len(rows))
        for e in range(s + 1, min(width, s + v.longest) + 1):
            node = v.children[node, column[rows[live], e - 1]]
            on = (node >= 0) & (length[rows[live]] >= e)
            node, live = node[on], live[on]
            if not len(live):
                break
            piece = v.ends[node]
            hit = piece >= 0
            if hit.any():
                whole[live[hit]] |= wide[live[hit]] == e - s
                offer(rows[live[hit]], s, e, piece[hit].astype(np.int64))
        lost = ~whole
        if lost.any():
            offer(rows[lost], s, s + wide[lost], np.full(lost.sum(), v.unk, np.int64))

    # Follow the back pointers from the ends of all rows.
    found, at, rows = [], length.astype(np.int64).copy(), np.arange(n)
    while len(rows):
        found.append((rows, back[rows, at], at, last[rows, at]))
        at = back[rows, at].astype(np.int64)
        rows, at = rows[at > 0], at[at > 0]
    row, start, end, piece = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, row))
    row, start, end, piece = row[order], start[order], end[order], piece[order]
    lost = piece == v.unk
    if lost.any():  # a character without a piece: its bytes' ids
        times = np.where(lost & (v.byte_ids is not None), end - start, 1)
        src = np.repeat(np.arange(len(row)), times)
        shift = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
        fall = np.array(v.byte_ids)[text[row[src], start[src] + shift]] if v.byte_ids else np.full(len(src), v.unknown)
        piece, row = np.where(lost[src], fall, piece[src]), row[src]
    return piece.astype(np.int32), np.searchsorted(row, np.arange(n), side="right")


def encode_texts(v: Vocabulary, texts: pa.Array) -> pa.ListArray:
    """Ids of each text; a null or empty text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(texts, SPACE_MARK)).as_py():
        texts = pc.replace_substring(texts, SPACE_MARK, " ")
    offsets, data = W.text_buffer(texts)
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes > 0)
    heads = offsets[:-1][some]
    if not len(some):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1), pa.int32()), pa.array([], pa.int32()))
    data = np.insert(data, heads, 32)  # the dummy prefix
    heads = heads + np.arange(len(heads))
    cut = np.zeros(len(data), bool)
    space = data == 32
    cut[1:] = space[1:] & ~space[:-1]
    control = v.apart[data]
    cut |= control
    cut[1:] |= control[:-1]
    cut[heads] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    # Distinct stretches by hash, and the bytes of all compared with their first one's.
    length = end - start
    _, first, which = np.unique(W.hashes(data, start, length)[0], return_index=True, return_inverse=True)
    same = length[first][which] == length
    if same.all():
        same = data == data[np.arange(len(data)) + np.repeat(start[first][which] - start, length)]
    if not same.all():
        first = which = np.arange(len(start))
    ids, stop = _distinct_ids(v, data, start[first], end[first])
    begin = np.concatenate([[0], stop[:-1]])
    count = (stop - begin)[which]
    src = np.repeat(begin[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    per_text = np.zeros(len(texts), np.int64)
    reached = np.concatenate([[0], np.cumsum(count)])
    per_text[some] = np.diff(np.append(reached[np.searchsorted(start, heads)], reached[-1]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), pa.array(ids[src], pa.int32()))


def _distinct_ids(v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each stretch's ids end) in the order given."""
    length = end - start
    order = np.argsort(length, kind="stable")
    parts, sizes, i = [], np.zeros(len(start), np.int64), 0
    while i < len(order):
        width = int(length[order[i]])
        if width > v.longest:
            for j in order[i:]:
                one, out = StreamEncoder(v), []
                for at in range(int(start[j]), int(end[j]), 1 << 16):
                    out += one.feed(data[at : min(at + (1 << 16), int(end[j]))].tobytes())
                out += one.finish()
                parts.append(np.array(out, np.int32))
                sizes[j] = len(out)
            break
        # Stretches of nearly one length, padded to the longest.
        to = min(i + MATRIX_ROWS, int(np.searchsorted(length[order], min(v.longest, width + max(3, width // 4)), side="right")))
        rows = order[i:to]
        wide = int(length[rows[-1]])
        at = start[rows][:, None] + np.arange(wide)
        inside = np.arange(wide) < length[rows][:, None]
        text = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
        ids, stop = _matrix_ids(v, text, length[rows])
        parts.append(ids)
        sizes[rows] = np.diff(np.concatenate([[0], stop]))
        i = to
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    # From length order back to the order given.
    held = np.cumsum(sizes[order]) - sizes[order]
    begin = np.empty(len(start), np.int64)
    begin[order] = held
    src = np.repeat(begin, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[src], np.cumsum(sizes)


def decode_ids(v: Vocabulary, ids: Iterable[int]) -> str:
    """The text of some ids: pieces joined, without the dummy prefix."""
    return _decoder(v)(ids)


def _decoder(v: Vocabulary):
    table: list[bytes] = [s or b"" for s in v.surface]
    for b, i in enumerate(v.byte_ids or []):
        table[i] = bytes([b])

    def decode(ids) -> str:
        raw = b"".join([table[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    return decode


def decode_lists(v: Vocabulary, lists: pa.Array) -> pa.Array:
    """Texts of lists of ids."""
    decode = _decoder(v)
    offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy().tolist()
    return pa.array([decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
