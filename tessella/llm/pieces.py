"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is cut where no merge can cross (between letters and other characters, before runs of spaces,
around characters that no longer piece holds); each chunk runs the merge agenda: the best-scored
adjacent pair first, the leftmost of equals. A candidate is skipped for good when a keyed hash of
(seed, document, the chunk's place, position, piece) falls below the dropout rate; merges around it
make new candidates. With a rate of 0 the result is the model's own encoding.

What a chunk becomes depends only on which candidates are skipped, so outcomes are remembered in a
tree: a node holds the ids of a chunk when a set of candidates is skipped and the merges that were
done then. If a place's hash skips none of these merges, the node is its outcome, whatever the hash
says of candidates that never came up; else the first merge that it skips leads to a child. Draws
are made at each place by itself; the tree only saves doing equal merges again. It is bounded
(`KEPT` nodes) and ends with the task.

Decoding joins pieces and turns space marks into spaces; a space mark that the text holds itself is
written as bytes, so every text comes back exactly, noncharacters and control characters included.

Defined cases: null texts have null ids and decode to null; empty texts have no ids; texts of any
length are encoded whole; ties between equal scores go to the leftmost pair. Ids of rows may be null
or repeat (equal id and text: equal segmentation). An empty table gives no rows. Other columns pass
through `encode` untouched, except those named like the outputs, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import arrow, small_batches
from tessella.llm.words import mix, runs, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 1
MARK = "▁"
KEPT = 300_000  # nodes of the tree of outcomes; it is emptied beyond that
WIDE = 40  # longest chunks that are merged many at a time
SLOTS = 20  # bits of the table of pairs
MANY = 8192  # chunks that are merged at once
DEEP = 6  # skips of a chunk that are remembered; with more it is merged for its place alone
RUN = 1 << 20  # bytes of text that are encoded at once; a longer text goes alone
NONE = np.int32(2**31 - 1)
ALONE, SPACE, LETTER, OTHER = range(4)  # classes of characters
PLACE, CANDIDATE, SPREAD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))

MADE = ("slot_key", "slot_piece", "roots", "children", "symbols", "begin", "length", "chunk", "parent", "skip", "flat", "flat_at", "flat_n", "cand", "cand_at", "cand_n")  # not sent


def load(model: str = MODEL) -> bytes:
    with open(model, "rb") as f:
        return f.read()


def borders(kind: np.ndarray) -> np.ndarray:
    """Where a chunk begins, from the classes of characters: spaces go with what follows them."""
    out = np.ones(len(kind), bool)
    before, own = kind[:-1], kind[1:]
    out[1:] = ((own != before) & (before != SPACE)) | (own == ALONE) | (before == ALONE)
    return out


class Growing:
    """An array that rows are added to."""

    def __init__(self, kind: type) -> None:
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(len(x), self.n), self.data.dtype)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


def spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times, for each i."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Pieces:
    """A model's tables; made on the driver and sent to tasks by value. The tree of outcomes is a task's own."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.dropout, self.seed, self.limit = dropout, seed, int(dropout * 2**64)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}  # of pieces that a merge can make
        self.byte = [0] * 256
        self.bytes: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                if len(piece) > 1:
                    self.scores[piece] = sp.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.prefix = bool(sp.encode("a", out_type=str)[0].startswith(MARK))
        self.kinds = self.classes()
        self.of_code = np.full(max([0x80, *(ord(c) + 1 for c in self.ids if len(c) == 1)]), -1, np.int32)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.of_code[ord(" " if c == MARK else c)] = i
        self.odd = {c for x in self.scores for c in x if c not in self.ids}  # characters of pieces that are none themselves
        self.pair_table()
        self.forget()

    def classes(self) -> np.ndarray:
        """The class of each code point: as fine as no piece is cut by it. Plain spaces stand for space marks."""
        inside = np.frombuffer("".join(self.scores).encode("utf-32-le"), np.uint32)
        joined = np.zeros(0x110000, bool)
        joined[inside] = True
        letter = np.zeros(0x110000, bool)
        text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        letter[np.frombuffer("".join(re.findall(r"[^\W\d_]", text)).encode("utf-32-le"), np.uint32)] = True
        odd = [c for c in np.flatnonzero(joined & letter).tolist() if not chr(c).isalpha()]  # as superscripts
        letter[odd] = False
        starts = np.cumsum([0, *map(len, self.scores)])[:-1]
        for one in (letter, np.zeros(0x110000, bool), None):
            kinds = np.full(0x110000, OTHER, np.uint8)
            if one is not None:
                kinds[one] = LETTER
                kinds[ord(MARK)] = SPACE
            kinds[~joined] = ALONE
            cuts = borders(kinds[inside])
            cuts[starts] = False
            if not cuts.any():
                break
        self.spaced = kinds[ord(MARK)] == SPACE
        kinds[ord(" ")], kinds[ord(MARK)] = kinds[ord(MARK)], ALONE  # a text's own mark is no space
        return kinds

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in MADE}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.fill_slots()
        self.forget()

    def skipped(self, place: int, at: int, piece: int) -> bool:
        """Whether the candidate of this position and piece is left out."""
        x = (place ^ (at << 24 | piece) * int(CANDIDATE)) & 0xFFFFFFFFFFFFFFFF
        return ((x ^ x >> 29) * int(SPREAD) & 0xFFFFFFFFFFFFFFFF) < self.limit

    def hits(self, x: np.ndarray) -> np.ndarray:
        if self.limit >= 2**64:
            return np.ones(len(x), bool)
        return (x ^ x >> np.uint64(29)) * SPREAD < np.uint64(self.limit)

    def merge(self, chunk: str, place: int = 0) -> list[int]:
        """Ids of one chunk of any length and characters, as the hash of its place has it."""
        if chunk == MARK:  # the text's own
            return [self.byte[b] for b in MARK.encode()]
        chunk = chunk.replace(" ", MARK)
        scores, ids, n = self.scores, self.ids, len(chunk)
        symbol, left, right = list(chunk), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-scores[a + b], i, i + 1, a + b) for i, (a, b) in enumerate(zip(chunk, chunk[1:])) if a + b in scores]
        heapify(heap)
        while heap:
            score, i, j, new = heappop(heap)
            if right[i] != j or not symbol[i] or symbol[i] + symbol[j] != new or (self.limit and self.skipped(place, i, ids[new])):
                continue
            symbol[i], symbol[j], right[i] = new, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
                both = new + symbol[right[j]]
                if both in scores:
                    heappush(heap, (-scores[both], i, right[j], both))
            if left[i] >= 0:
                both = symbol[left[i]] + new
                if both in scores:
                    heappush(heap, (-scores[both], left[i], i, both))
        return [x for s in symbol if s for x in ([ids[s]] if s in ids else [self.byte[b] for b in s.encode()])]

    def encode(self, text: str, salt: int = 0) -> list[int]:
        return self.encode_many(pa.array([text], pa.string()), [salt])[0].tolist()

    def encode_long(self, text: bytes, salt: int) -> np.ndarray:
        """Ids of one long text, in parts that end where a chunk does: before a space behind other bytes."""
        out, lo, chunks = [], 0, 0
        while lo < len(text):
            hi = text.find(b" ", lo + RUN) if len(text) - lo > 2 * RUN and self.spaced else -1
            while hi > 0 and text[hi - 1] == 32:
                hi = text.find(b" ", hi + 1)
            hi = hi if hi > 0 else len(text)
            ids, _, n = self.encoded(np.array([0, hi - lo]), np.frombuffer(text, np.uint8, hi - lo, lo), [salt], lo == 0, chunks)
            out.append(ids)
            lo, chunks = hi, chunks + n
        return np.concatenate([np.zeros(0, np.int32), *out])

    def encode_many(self, texts: pa.Array, salts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (int32) and where each text's begin, with one end more."""
        off, raw = texts_of(texts)
        if len(texts) == 1 and off[1] - off[0] > 2 * RUN:
            ids = self.encode_long(raw[off[0] : off[1]].tobytes(), salts[0])
            return ids, np.array([0, len(ids)])
        return self.encoded(off, raw, salts)[:2]

    def encoded(self, off: np.ndarray, raw: np.ndarray, salts: list[int], begun: bool = True, before: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids, where each text's begin, number of chunks; a text that goes on has `before` chunks already."""
        sizes = np.diff(off)
        if self.prefix and begun:  # a space before each text that holds anything
            lead = (sizes > 0).astype(np.int64)
            ends = np.cumsum(sizes + lead)
            whole = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
            whole[spread(sizes, ends - sizes)] = raw[off[0] : off[-1]]
        else:
            ends, whole = np.cumsum(sizes), raw[off[0] : off[-1]]
        begins = np.concatenate([[0], ends])
        first = np.flatnonzero((whole & 0xC0) != 0x80)  # first byte of each character
        codes = np.frombuffer(whole.tobytes().decode().encode("utf-32-le"), np.uint32)
        cut = borders(self.kinds[codes])
        cut[np.searchsorted(first, begins[:-1][begins[:-1] < begins[1:]])] = True
        starts = first[cut]
        n = len(starts)
        of_text = np.searchsorted(starts, begins)  # each text's first chunk
        if not n:
            return np.zeros(0, np.int32), of_text, 0
        found = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(starts, len(whole)).astype(np.int32)), pa.py_buffer(whole)]).dictionary_encode()
        at, data = texts_of(found.dictionary)
        data, at = data.tobytes(), at.tolist()
        chunks = [data[a:b] for a, b in zip(at, at[1:])]
        place = np.zeros(0, np.uint64)
        if self.limit:
            count = np.diff(of_text)
            with np.errstate(over="ignore"):
                place = mix(spread(count, np.full(len(count), before)).astype(np.uint64) * PLACE + np.repeat(np.array(salts, np.uint64), count))
                place = mix(place ^ mix(np.array([self.seed], np.int64).view(np.uint64)))
        ids, ends = self.drawn(chunks, found.indices.to_numpy(), place)
        return ids, np.concatenate([[0], ends])[of_text], n

    def forget(self) -> None:
        """Empties the tree of outcomes."""
        self.roots: dict[bytes, int] = {}  # nodes of chunks without a skip
        self.children: dict[int, int] = {}  # by node * 64 + the merge that is skipped
        self.symbols, self.begin, self.length = Growing(np.int32), Growing(np.int64), Growing(np.int64)  # characters of each chunk
        self.chunk, self.parent, self.skip = Growing(np.int64), Growing(np.int64), Growing(np.int32)  # of each node
        self.flat, self.flat_at, self.flat_n = Growing(np.int32), Growing(np.int64), Growing(np.int64)  # ids of each node
        self.cand, self.cand_at, self.cand_n = Growing(np.int32), Growing(np.int64), Growing(np.int64)  # merges of each node

    def hold(self, ids: np.ndarray, n_ids: np.ndarray, cand: np.ndarray, n_cand: np.ndarray) -> None:
        for kept, at, count, x, n in ((self.flat, self.flat_at, self.flat_n, ids, n_ids), (self.cand, self.cand_at, self.cand_n, cand, n_cand)):
            at.add(kept.n + np.cumsum(n) - n)
            count.add(n)
            kept.add(x)

    def grow(self, chunk: np.ndarray, parent: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """New nodes of chunks; what a node's parents skip is skipped too. Their numbers."""
        order = np.argsort(self.length.data[chunk], kind="stable")  # blocks of like lengths
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) + self.chunk.n
        for lo in range(0, len(order), MANY):
            at = order[lo : lo + MANY]
            left_out, up = [skip[at]] if (parent[at] >= 0).any() else [], parent[at]
            while (up >= 0).any():
                left_out.append(np.where(up >= 0, self.skip.data[up], -1))
                up = np.where(up >= 0, self.parent.data[up], -1)
            self.hold(*self.merge_block(chunk[at], left_out))
            self.chunk.add(chunk[at]), self.parent.add(parent[at]), self.skip.add(skip[at])
        return out

    def add_roots(self, chunks: list[bytes]) -> None:
        """Nodes of new chunks: short ones, whose characters have ids or stand alone."""
        data, size = b"".join(chunks), np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[np.cumsum(size) - size]
        size = np.diff(begin, append=len(codes))
        single = np.flatnonzero(size == 1)
        bare = [self.merge(chr(c)) for c in codes[begin[single]].tolist()]
        self.roots.update(zip((chunks[i] for i in single.tolist()), range(self.chunk.n, self.chunk.n + len(single))))
        none = np.full(len(bare), -1)
        self.chunk.add(none), self.parent.add(none), self.skip.add(none)
        self.hold(np.array([x for ids in bare for x in ids], np.int32), np.array([len(x) for x in bare], np.int64), np.zeros(0, np.int32), np.zeros(len(bare), np.int64))
        more = np.flatnonzero((size > 1) & (size <= WIDE))
        if self.odd:
            more = np.array([i for i in more.tolist() if not self.odd.intersection(chunks[i].decode())], np.int64)
        first, size = self.begin.n, size[more]
        self.begin.add(self.symbols.n + np.cumsum(size) - size), self.length.add(size)
        self.symbols.add(self.of_code[codes[spread(size, begin[more])]])
        none = np.full(len(more), -1)
        made = self.grow(np.arange(len(more)) + first, none, none)
        self.roots.update(zip(map(chunks.__getitem__, more.tolist()), made.tolist()))

    def drawn(self, chunks: list[bytes], index: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks[index], each candidate drawn by the hash of its place, and where each ends."""
        if self.chunk.n > KEPT:
            self.forget()
        known = list(map(self.roots.get, chunks))
        new = [c for c, x in zip(chunks, known) if x is None]
        if new:
            self.add_roots(new)
            known = [self.roots.get(c, -1) for c in chunks]
        node = np.array(known, np.int64)[index]
        alone = np.flatnonzero(node < 0)  # long, or of characters without a piece: each by itself
        live = np.flatnonzero(node >= 0) if self.limit else np.zeros(0, np.int64)
        for depth in range(DEEP + 1):
            at = node[live]
            start, count = self.cand_at.data[at], self.cand_n.data[at]
            row, which = np.repeat(np.arange(len(live)), count), spread(count, start)
            with np.errstate(over="ignore"):
                hit = np.flatnonzero(self.hits(place[live][row] ^ self.cand.data[which].astype(np.uint64) * CANDIDATE))
            row = row[hit]
            lead = np.ones(len(row), bool)
            lead[1:] = row[1:] != row[:-1]
            row, which = row[lead], which[hit[lead]]
            live = live[row]
            if not len(live) or depth == DEEP:
                break
            keys, inverse = np.unique(at[row] * 64 + which - start[row], return_inverse=True)
            to = list(map(self.children.get, keys.tolist()))
            gaps = np.array([i for i, x in enumerate(to) if x is None], np.int64)
            if len(gaps):
                parent = keys[gaps] >> 6
                made = self.grow(self.chunk.data[parent], parent, self.cand.data[self.cand_at.data[parent] + (keys[gaps] & 63)]).tolist()
                self.children.update(zip(keys[gaps].tolist(), made))
                for i, x in zip(gaps.tolist(), made):
                    to[i] = x
            node[live] = np.array(to, np.int64)[inverse]
        # Nodes of this call alone: places with more skips, and chunks by themselves.
        kept = [(g.n, g) for g in (self.flat, self.flat_at, self.flat_n, self.cand, self.cand_at, self.cand_n)]
        first = self.flat_at.n
        for lo in range(0, len(live), MANY):
            at = live[lo : lo + MANY]
            self.hold(*self.merge_block(self.chunk.data[node[at]], [], place[at]))
        ids = [self.merge(chunks[index[i]].decode(), int(place[i]) if self.limit else 0) for i in alone.tolist()]
        self.hold(np.array([x for y in ids for x in y], np.int32), np.array([len(x) for x in ids], np.int64), np.zeros(0, np.int32), np.zeros(len(ids), np.int64))
        own = np.concatenate([live, alone])
        node[own] = np.arange(len(own)) + first
        count = self.flat_n.data[node]
        out = self.flat.data[spread(count, self.flat_at.data[node])]
        for n, g in kept:
            g.n = n
        return out, np.cumsum(count)

    def merge_block(self, chunks: np.ndarray, left_out: list[np.ndarray], place: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Ids of many of the known chunks, how many of each; the merges done, how many of each.

        One merge of every chunk a round. Candidates are position << 24 | piece; left out are those in
        `left_out` (-1 is none), or those that the hash of `place` skips.
        """
        n, length = len(chunks), self.length.data[chunks]
        wide = int(length.max(initial=1))
        spot = np.arange(wide)[:, None]
        symbol = np.where(spot < length, self.symbols.data[np.minimum(self.begin.data[chunks] + spot, self.symbols.n - 1)], -1).astype(np.int32)
        nxt = np.where(spot + 1 < length, spot + 1, -1)
        prv = np.broadcast_to(spot - 1, (wide, n)).copy()
        made, best = np.full((wide, n), -1, np.int32), np.full((wide, n), NONE, np.int32)

        def offer(at: np.ndarray, who: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            """The pair of symbols a, b becomes the candidate of its position and chunk."""
            new = self.pair(a, b)
            key = self.rank[new] << 6 | at.astype(np.int32)
            key[new < 0] = NONE
            code = at.astype(np.int32) << 24 | new
            for x in left_out:
                key[code == x[who]] = NONE
            if place is not None and self.limit:
                with np.errstate(over="ignore"):
                    key[self.hits(place[who] ^ code.astype(np.uint64) * CANDIDATE)] = NONE
            made.ravel()[at * n + who], best.ravel()[at * n + who] = new, key

        at, who = np.nonzero(nxt >= 0)
        offer(at, who, symbol[at, who], symbol[at + 1, who])
        flat_symbol, flat_next, flat_prev, flat_made, flat_best = (x.ravel() for x in (symbol, nxt, prv, made, best))
        whose, done = [], []
        while True:
            top = best.min(axis=0)
            who = np.flatnonzero(top != NONE)
            if not len(who):
                break
            j = (top[who] & 63).astype(np.int64)
            here = j * n + who
            piece, there = flat_made[here], flat_next[here] * n + who
            after = flat_next[there]
            whose.append(who), done.append(j.astype(np.int32) << 24 | piece)
            flat_symbol[here], flat_symbol[there] = piece, -1
            flat_best[here], flat_best[there], flat_next[here] = NONE, NONE, after
            more = np.flatnonzero(after >= 0)
            flat_prev[after[more] * n + who[more]] = j[more]
            before = flat_prev[here]
            less = np.flatnonzero(before >= 0)
            offer(
                np.concatenate([j[more], before[less]]), np.concatenate([who[more], who[less]]),
                np.concatenate([piece[more], flat_symbol[before[less] * n + who[less]]]), np.concatenate([flat_symbol[after[more] * n + who[more]], piece[less]]))
        alive = symbol >= 0
        ids, n_ids = symbol.T[alive.T], alive.sum(axis=0)
        if not whose:
            return ids, n_ids, np.zeros(0, np.int32), np.zeros(n, np.int64)
        whose, done = np.concatenate(whose), np.concatenate(done)
        return ids, n_ids, done[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=n)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, -1 where there is none: open addressing with linear probes."""
        wanted = a.astype(np.int64) << 32 | b
        with np.errstate(over="ignore"):
            at = (wanted.view(np.uint64) * PLACE >> np.uint64(64 - SLOTS)).astype(np.int64)
        held = self.slot_key[at]
        out = np.where(held == wanted, self.slot_piece[at], np.int32(-1))
        left = np.flatnonzero((held != wanted) & (held != -1))
        while len(left):
            at[left] = at[left] + 1 & (1 << SLOTS) - 1
            held = self.slot_key[at[left]]
            hit = held == wanted[left]
            out[left[hit]] = self.slot_piece[at[left[hit]]]
            left = left[~hit & (held != -1)]
        return out

    def pair_table(self) -> None:
        """All ways to make a piece of two others, and the pieces' order by score."""
        ids, found = self.ids, {}
        for piece in self.scores:
            for i in range(1, len(piece)):
                a, b = ids.get(piece[:i]), ids.get(piece[i:])
                if a is not None and b is not None:
                    found[a << 32 | b] = ids[piece]
        if len(found) * 2 > 1 << SLOTS:
            raise ValueError(f"{len(found)} pairs of pieces are more than the table is made for")
        self.found = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        self.rank = np.zeros(len(self.bytes), np.int32)
        of_score = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank[[ids[x] for x in self.scores]] = [of_score[s] for s in self.scores.values()]
        self.fill_slots()

    def fill_slots(self) -> None:
        keys, pieces = self.found
        self.slot_key, self.slot_piece = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, np.int32)
        with np.errstate(over="ignore"):
            at = (keys.view(np.uint64) * PLACE >> np.uint64(64 - SLOTS)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.slot_key[at[left]] == -1]
            self.slot_key[at[free]] = keys[free]  # of several for a slot the last stays
            self.slot_piece[at[free]] = pieces[free]
            left = left[self.slot_key[at[left]] != keys[left]]
            at[left] = at[left] + 1 & (1 << SLOTS) - 1

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids))
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode()

    def salt(self, row_id: object) -> int:
        return int.from_bytes(hashlib.blake2b(str(row_id).encode(), digest_size=8, key=f"row:{self.seed}".encode()).digest(), "little")

    def over_runs(self, texts: pa.Array, who: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, where each row's ids begin) of runs of texts of a bounded size."""
        off, _ = texts_of(texts)
        for lo, hi in runs(off, RUN):
            yield lo, hi, *self.encode_many(texts.slice(lo, hi - lo), [self.salt(i) for i in who.slice(lo, hi - lo).to_pylist()])


def fields_of(df: DataFrame, but: list[str]) -> tuple[list[int], str]:
    """Places and schema of df's columns other than these."""
    kept = [i for i, c in enumerate(df.columns) if c not in but]
    return kept, "".join(f"`{df.columns[i]}` {df.schema.fields[i].dataType.simpleString()}, " for i in kept)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "ids", decoded: str | None = None, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs with the column `name` array<int>, and with the column `decoded` that its ids decode to, where named."""
    small_batches(docs.sparkSession)
    p, at, who = Pieces(load(model), dropout, seed), docs.columns.index(text_col), docs.columns.index(id_col)
    kept, fields = fields_of(docs, [name, decoded] if decoded else [name])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, begins in p.over_runs(batch.column(at), batch.column(who)):
                part = batch.slice(lo, hi - lo)
                null = part.column(at).is_null()
                made = [pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids), mask=null)]
                if decoded:
                    made.append(pa.array([None if gone else p.decode(ids[a:b].tolist()) for gone, a, b in zip(null.to_pylist(), begins, begins[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *made], names=[*(part.schema.names[i] for i in kept), name, *([decoded] if decoded else [])])

    return arrow(docs, over, f"{fields}`{name}` array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(rows: DataFrame, ids_col: str = "ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """rows with the column `name` string."""
    p, at = Pieces(load(model), 0.0), rows.columns.index(ids_col)
    kept, fields = fields_of(rows, [name])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                text = pa.array([None if x is None else p.decode(x) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), text], names=[*(part.schema.names[i] for i in kept), name])

    return arrow(rows, over, f"{fields}`{name}` string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """id, n_bytes, n_pieces, ids_sha256 (little-endian 32-bit ids), text_sha256 of what is decoded, lossless."""
    small_batches(docs.sparkSession)
    p = Pieces(load(model), dropout, seed)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi, ids, begins in p.over_runs(batch.column(1), batch.column(0)):
                texts = batch.column(1).slice(lo, hi - lo)
                for text, a, b in zip(texts, begins, begins[1:]):
                    raw = p.decode(ids[a:b].tolist()).encode()
                    rows.append((len(raw), int(b - a), hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), raw == (text.as_buffer().to_pybytes() if text.is_valid else b"")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n_bytes", "n_pieces", "ids_sha256", "text_sha256", "lossless"])

    kind = dict(docs.dtypes)[id_col]
    out = arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), over, f"id {kind}, n_bytes long, n_pieces long, ids_sha256 string, text_sha256 string, lossless boolean")
    return out.withColumnRenamed("id", id_col)
