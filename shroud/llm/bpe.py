"""Byte-level BPE without regex: vectorised pre-tokenisation and cached pair merging (numpy, no Spark here).

Pre-tokenisation follows the usual byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

as an eight-state automaton.  Every code point gets a class from an array; a class is a function from state to
state; functions compose associatively.  The few functions that can arise are numbered, their compositions are a
table, and a blocked prefix scan over the whole batch gives the state before every code point.  Token starts follow
from (state before, state after) by table look-up.
"""

from __future__ import annotations

import base64
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

# classes of code points
LETTER, NUMBER, OTHER, SPACE, WHITE, APOS1, APOS2, END = range(8)
# states: fresh (a token starts here), in letters / numbers / others, after a blank, after other white space,
# one / two code points of a contraction to come
FRESH, IN_L, IN_N, IN_O, AFTER_SP, AFTER_WS, LEFT1, LEFT2 = range(8)

# Unicode White_Space, and the contractions' letters
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER = "stmd"
TWO_LETTERS = ["re", "ve", "ll"]

BATCH_CODE_POINTS = 1 << 19  # code points handled at once; a longer document is cut where the pattern must cut
CACHE_BITS = 21  # slots of the table of pieces
CACHE_ENTRIES = 1 << 20  # pieces a worker remembers, half the slots; the table starts anew before it would hold more
AT_ONCE = 1 << 18  # pieces that are looked up and remembered together
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
NEVER = np.iinfo(np.int64).max
MERGED_AT_ONCE = 16_384  # pieces
LONG_PIECE = 256  # bytes; longer pieces merge through a heap instead of rounds


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(sys.maxunicode + 1):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            table[cp] = kind
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


def _transitions() -> np.ndarray:
    """next state [class, state]"""
    t = np.zeros((8, 8), np.uint8)
    for state in range(8):
        inside = {LEFT1: FRESH, LEFT2: LEFT1}.get(state)
        for cls, to in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (SPACE, AFTER_SP), (WHITE, AFTER_WS)):
            t[cls, state] = to if inside is None else inside
        joins = state in (IN_O, AFTER_SP)  # the apostrophe belongs to a run of others
        t[APOS1, state] = IN_O if joins else LEFT1
        t[APOS2, state] = IN_O if joins else LEFT2
        t[END, state] = FRESH
    return t


def _monoid(transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that the classes generate: their values [f, state], composition table [f, g] = g after f,
    and the number of each class's own function."""
    number = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    own = [tuple(int(x) for x in row) for row in transitions]
    for f in queue:
        for g in own:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                queue.append(h)
    values = np.array(queue, np.uint8)
    compose = np.array([[number[tuple(g[x] for x in f)] for g in queue] for f in queue], np.uint8)
    return values, compose, np.array([number[g] for g in own], np.uint8)


def _start_table() -> np.ndarray:
    """[state before * 8 + state after]: does a token start at this code point?  (The last white space of a run is
    treated apart: it needs the code point after it.)"""
    t = np.zeros((8, 8), bool)
    for before in range(8):
        for after in range(8):
            if after in (AFTER_SP, AFTER_WS):
                t[before, after] = before not in (AFTER_SP, AFTER_WS)
            elif before in (LEFT1, LEFT2, AFTER_SP):
                t[before, after] = False
            else:
                t[before, after] = before != after or before == FRESH
    return t.reshape(-1)


class Pretokenizer:
    def __init__(self) -> None:
        self.classes = _class_table()
        self.next_state = _transitions()
        self.values, self.compose, self.generator = _monoid(self.next_state)
        self.flat_next = self.next_state.reshape(-1)
        self.flat_compose = self.compose.reshape(-1)
        self.starts = _start_table()

    def states(self, cls: np.ndarray) -> np.ndarray:
        """State after every code point, from a fresh start: prefix scan over composed transition functions."""
        n = len(cls)
        steps = max(16, int(n**0.5) // 4)
        blocks = -(-n // steps)
        grid = np.full(blocks * steps, END, np.uint8)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(blocks, steps).T)
        width = len(self.values)
        # 1. the function of every block
        f = np.zeros(blocks, np.intp)
        for row in grid:
            f = self.flat_compose[f * width + self.generator[row]].astype(np.intp)
        # 2. inclusive scan over the blocks, doubling the reach
        reach = 1
        while reach < blocks:
            f[reach:] = self.flat_compose[f[:-reach] * width + f[reach:]]
            reach *= 2
        state = np.zeros(blocks, np.intp)
        state[1:] = self.values[f[:-1], FRESH]
        # 3. states inside the blocks
        out = np.empty((steps, blocks), np.uint8)
        for k, row in enumerate(grid):
            out[k] = self.flat_next[row.astype(np.intp) * 8 + state]
            state = out[k].astype(np.intp)
        return np.ascontiguousarray(out.T).reshape(-1)[:n]

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts (one byte between two texts), byte starts and ends of their tokens, and for
        every text the index of its first token (with a last entry for the end)."""
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        cls = self.classes[cp]
        apos = np.flatnonzero(cp == 0x27)
        if len(apos):
            one = cp[np.minimum(apos + 1, len(cp) - 1)]
            two = cp[np.minimum(apos + 2, len(cp) - 1)]
            cls[apos[np.isin(one, [ord(c) for c in ONE_LETTER])]] = APOS1
            for a, b in TWO_LETTERS:
                cls[apos[(one == ord(a)) & (two == ord(b))]] = APOS2
        cls[ends] = END
        after = self.states(cls)
        before = np.empty_like(after)
        before[0] = FRESH
        before[1:] = after[:-1]
        start = self.starts[before * 8 + after]
        white = (cls == SPACE) | (cls == WHITE)
        last_white = white[:-1] & ~white[1:] & (cls[1:] != END)
        start[:-1] |= last_white
        start[ends] = True
        at = np.flatnonzero(start)
        size = 1 + (cp >= 0x80).astype(np.uint8) + (cp >= 0x800) + (cp >= 0x10000)
        offset = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(size, out=offset[1:])
        bounds = offset[at]
        token = cls[at] != END
        starts = bounds[token]
        stops = np.append(bounds[1:], offset[-1])[token]
        first = np.zeros(len(texts) + 1, np.int64)
        first[1:] = np.cumsum(token)[np.searchsorted(at, ends)]
        return joined.encode("utf-8"), starts, stops, first

    def batches(self, texts: list[str]) -> Iterator[list[tuple[str, bool]]]:
        """(part, is it the last of its text) in groups of about ``BATCH_CODE_POINTS``.  A long text comes as several parts, in
        as many groups as it takes, cut where a token ends whatever comes next."""
        group, held = [], 0
        for text in texts:
            for part, last in self._parts(text):
                if group and held + len(part) > BATCH_CODE_POINTS:
                    yield group
                    group, held = [], 0
                group.append((part, last))
                held += len(part) + 1
        if group:
            yield group

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Cuts lie before white space that follows something else, and behind a run of letters or numbers.  (Others may go on
        into a contraction.)  A run of one class without end is one part: it is one token to merge."""
        begin = 0
        while len(text) - begin > 2 * BATCH_CODE_POINTS:
            at = begin + BATCH_CODE_POINTS
            while at < len(text):
                kinds = self.classes[np.frombuffer(text[at - 1:at + BATCH_CODE_POINTS].encode("utf-32-le"), np.uint32)]
                white = (kinds == SPACE) | (kinds == WHITE)
                run = (kinds == LETTER) | (kinds == NUMBER)
                cut = np.flatnonzero(white[1:] & ~white[:-1] | run[:-1] & (kinds[1:] != kinds[:-1]))
                if len(cut):
                    break
                at += BATCH_CODE_POINTS
            if at >= len(text):
                break
            at += int(cut[0])
            yield text[begin:at], False
            begin = at
        yield text[begin:], True


class Merger:
    """Ids of byte pieces by repeatedly merging the adjacent pair of lowest rank, many pieces at a time."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]] | None) -> None:
        self.vocabulary, self.whole = vocabulary, merges is None
        size = max(vocabulary.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for piece, i in vocabulary.items():
            self.bytes_of[i] = piece
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.byte_id = np.array([vocabulary[bytes([b])] for b in range(256)], np.int64)
        if merges is None:  # any two pieces whose concatenation has a rank
            pairs = [(vocabulary[p[:k]], vocabulary[p[k:]], i, i) for p, i in vocabulary.items()
                     for k in range(1, len(p)) if p[:k] in vocabulary and p[k:] in vocabulary]
        else:
            pairs = [(vocabulary[a], vocabulary[b], r, vocabulary[a + b]) for r, (a, b) in enumerate(merges)]
        rows = np.array(pairs, np.int64)
        self.pairs, self.pair_rank = rows, {}  # as a dict only once a long piece asks
        keys = (rows[:, 0] << 32) | rows[:, 1]
        self.bits = max(8, int(4 * len(keys) - 1).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_value = np.full(1 << self.bits, NEVER, np.int64)  # rank << 32 | merged id
        slots = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # open addressing, all keys of a round at once; the last writer of a slot keeps it
            free = left[self.slot_key[slots[left]] == -1]
            self.slot_key[slots[free]] = keys[free]
            kept = free[self.slot_key[slots[free]] == keys[free]]
            self.slot_value[slots[kept]] = (rows[kept, 2] << 32) | rows[kept, 3]
            left = np.setdiff1d(left, kept, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
        self.forget()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """rank << 32 | merged id of pairs; NEVER where the pair does not merge."""
        slots = self._slot(keys)
        there = self.slot_key[slots]
        value = np.where(there == keys, self.slot_value[slots], NEVER)
        todo = np.flatnonzero((there != keys) & (there != -1))
        slots = slots[todo]
        while len(todo):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            there = self.slot_key[slots]
            hit = there == keys[todo]
            value[todo[hit]] = self.slot_value[slots[hit]]
            go_on = ~hit & (there != -1)
            todo, slots = todo[go_on], slots[go_on]
        return value

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and their numbers."""
        long = [k for k, p in enumerate(pieces) if len(p) > LONG_PIECE]
        short = [p for p in pieces if len(p) <= LONG_PIECE]
        ids, counts = self.merge_short(np.frombuffer(b"".join(short), np.uint8), np.array([len(p) for p in short], np.int64))
        if not long:
            return ids, counts
        bounds = np.cumsum(counts)[:-1]
        parts = iter(np.split(ids, bounds) if short else [])
        every = [np.array(self._merge_long(p), np.uint32) if len(p) > LONG_PIECE else next(parts) for p in pieces]
        return np.concatenate(every), np.array([len(x) for x in every], np.int64)

    def merge_short(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, of pieces that lie one after the other in ``raw``."""
        parts, upto = [], np.append(0, np.cumsum(sizes))
        for begin in range(0, len(sizes), MERGED_AT_ONCE):
            end = min(begin + MERGED_AT_ONCE, len(sizes))
            parts.append(self._merge_rounds(raw[upto[begin]:upto[end]], sizes[begin:end]))
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _merge_rounds(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges, in every piece, all occurrences of its pair of lowest rank.  Pairs are looked up once,
        and again only beside a merge."""
        ids = self.byte_id[raw]
        seg = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        value = np.full(len(ids), NEVER)
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        value[inner] = self._look_up((ids[inner] << 32) | ids[inner + 1])
        ended_ids, ended_seg = [], []
        while len(ids):
            begins = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            lengths = np.diff(np.append(begins, len(ids)))
            least = np.minimum.reduceat(value, begins)
            done = least == NEVER
            if done.any():
                ended = np.repeat(done, lengths)
                ended_ids.append(ids[ended].astype(np.uint32))
                ended_seg.append(seg[ended])
                keep = ~ended
                ids, seg, value = ids[keep], seg[keep], value[keep]
                least, lengths = least[~done], lengths[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(value >> 32 == np.repeat(least >> 32, lengths))
            # equal neighbours overlap: of each run of hits take every other one, from the left
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            ids[at] = value[at] & 0xFFFFFFFF
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, seg, value = ids[keep], seg[keep], value[keep]
            at -= np.arange(len(at))  # places after the removal
            beside = np.concatenate([at, at[at > 0] - 1])
            value[beside] = NEVER
            beside = beside[beside + 1 < len(ids)]
            beside = beside[seg[beside] == seg[beside + 1]]
            value[beside] = self._look_up((ids[beside] << 32) | ids[beside + 1])
        seg = np.concatenate(ended_seg)
        return np.concatenate(ended_ids)[np.argsort(seg, kind="stable")], np.bincount(seg, minlength=len(sizes))

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long piece: a heap of (rank, place) over a linked list, n log n."""
        if not self.pair_rank:
            self.pair_rank = {(a << 32) | b: (r, to) for a, b, r, to in self.pairs.tolist()}
        ids: list[int] = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.pair_rank.get
        after, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get((ids[k] << 32) | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= n or ids[right] != b:
                continue
            ids[k], ids[right] = get((a << 32) | b)[1], -1
            after[k] = after[right]
            if after[k] < n:
                back[after[k]] = k
                if r := get((ids[k] << 32) | ids[after[k]]):
                    heapq.heappush(heap, (r[0], k, ids[k], ids[after[k]]))
            if back[k] >= 0 and (r := get((ids[back[k]] << 32) | ids[k])):
                heapq.heappush(heap, (r[0], back[k], ids[back[k]], ids[k]))
        return [i for i in ids if i >= 0]

    def remember(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of new pieces with their ids, one after the other."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(len(self.flat), np.uint32))
        while self.pieces + len(counts) + 1 > len(self.first):
            self.first = np.append(self.first, np.zeros(len(self.first), np.int64))
        self.flat[self.used:self.used + len(ids)] = ids
        self.first[self.pieces + 1:self.pieces + 1 + len(counts)] = self.used + np.cumsum(counts)
        numbers = np.arange(self.pieces, self.pieces + len(counts))
        self.used += len(ids)
        self.pieces += len(counts)
        return numbers

    def forget(self) -> None:
        size = 1 << CACHE_BITS
        self.words = np.zeros((3, size), np.uint64)
        self.held = np.full(size, -1, np.int32)  # length of the piece in a slot
        self.number = np.zeros(size, np.int32)
        self.long: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.pieces = np.zeros(1 << 16, np.int64), 0
        if self.whole:  # a piece with a rank is one token, whatever the merges would give
            items = sorted(self.vocabulary.items(), key=lambda x: x[1])
            numbers = self.remember(np.array([i for _, i in items], np.uint32), np.ones(len(items), np.int64))
            small = [k for k, (p, _) in enumerate(items) if len(p) <= 24]
            sizes = np.array([len(items[k][0]) for k in small], np.int64)
            stops = np.cumsum(sizes)
            keys, slot = self._keys(b"".join([items[k][0] for k in small]), stops - sizes, sizes)
            self._insert(keys, sizes, slot, numbers[small])
            self.long = {p: int(numbers[k]) for k, (p, _) in enumerate(items) if len(p) > 24}

    @staticmethod
    def _keys(data: bytes, starts: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Pieces of up to 24 bytes as three words, and their slots."""
        at = np.ndarray((len(data) + 1,), "<u8", data + bytes(32), 0, (1,))
        keys = []
        for k in range(3):
            here = np.clip(size - 8 * k, 0, 8)
            word = at[np.minimum(starts + 8 * k, len(data))]
            keys.append(word & MASKS[here])
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0x165667B19E3779F9)
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ size.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return keys, (mixed >> np.uint64(64 - CACHE_BITS)).astype(np.int64)

    def ids(self, data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces ``data[start:stop]``, one after the other, and their numbers."""
        parts, counts = [], []
        for at in range(0, len(starts), AT_ONCE):
            numbers = self.numbers(data, starts[at:at + AT_ONCE], stops[at:at + AT_ONCE])
            begin = self.first[numbers]
            count = self.first[numbers + 1] - begin
            upto = np.cumsum(count)
            parts.append(self.flat[np.arange(upto[-1]) + np.repeat(begin - (upto - count), count)])
            counts.append(count)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(parts), np.concatenate(counts)

    def numbers(self, data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Number of every piece ``data[start:stop]``, merging those not yet known.  Pieces of up to 24 bytes are
        looked up all at once: their bytes as three words, compared exactly in an open-addressing table, which is at
        most half full: at most ``AT_ONCE`` pieces come in a call."""
        if self.pieces + len(starts) > CACHE_ENTRIES or self.used > 8 * CACHE_ENTRIES:
            self.forget()
        lengths = stops - starts
        out = np.full(len(starts), -1, np.int64)
        small = np.flatnonzero(lengths <= 24)
        size = lengths[small]
        keys, slot = self._keys(data, starts[small], size)
        found = self._probe(keys, size, slot.copy())
        miss = np.flatnonzero(found < 0)
        while len(miss):  # a second turn only where two new pieces share their 64-bit mix
            mix = keys[0][miss] * np.uint64(0x9E3779B97F4A7C15) + keys[1][miss] * np.uint64(0xC2B2AE3D27D4EB4F) + (keys[2][miss] + size[miss].astype(np.uint64)) * np.uint64(0x165667B19E3779F9)
            own = miss[np.unique(mix, return_index=True)[1]]
            begin, n = starts[small[own]], size[own]
            upto = np.cumsum(n)
            raw = np.frombuffer(data, np.uint8)[np.arange(upto[-1]) + np.repeat(begin - (upto - n), n)]
            self._insert([x[own] for x in keys], n, slot[own], self.remember(*self.merge_short(raw, n)))
            found[miss] = self._probe([x[miss] for x in keys], size[miss], slot[miss])
            miss = miss[found[miss] < 0]
        out[small] = found
        big = np.flatnonzero(lengths > 24)
        if len(big):
            pieces = [data[a:b] for a, b in zip(starts[big].tolist(), stops[big].tolist())]
            fresh = list(dict.fromkeys(p for p in pieces if p not in self.long))
            if fresh:
                self.long.update(zip(fresh, self.remember(*self.merge(fresh)).tolist()))
            out[big] = [self.long[p] for p in pieces]
        return out

    def _probe(self, keys: list[np.ndarray], size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        found = np.full(len(size), -1, np.int64)
        todo = np.arange(len(size))
        while len(todo):
            at = slot[todo]
            held = self.held[at]
            same = held == size[todo]
            for k in range(3):
                same &= self.words[k][at] == keys[k][todo]
            found[todo[same]] = self.number[at[same]]
            todo = todo[~same & (held >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << CACHE_BITS) - 1)
        return found

    def _insert(self, keys: list[np.ndarray], size: np.ndarray, slot: np.ndarray, numbers: np.ndarray) -> None:
        left = np.arange(len(size))
        slot = slot.copy()
        while len(left):
            free = left[self.held[slot[left]] < 0]
            self.held[slot[free]] = size[free]
            self.number[slot[free]] = numbers[free]
            mine = free[self.number[slot[free]] == numbers[free]]  # the last writer of a slot keeps it
            self.held[slot[mine]] = size[mine]
            for k in range(3):
                self.words[k][slot[mine]] = keys[k][mine]
            left = np.setdiff1d(left, mine, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << CACHE_BITS) - 1)


class Encoder:
    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]] | None = None) -> None:
        self.cutter, self.merger = Pretokenizer(), Merger(vocabulary, merges)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (unsigned 32 bits) of every text."""
        held: list[np.ndarray] = []  # of a text whose last part is still to come
        for group in self.cutter.batches(texts):
            data, starts, stops, first = self.cutter.cut([part for part, _ in group])
            ids, count = self.merger.ids(data, starts, stops)
            bounds = np.append(0, np.cumsum(count))[first].tolist()
            for k, (_, last) in enumerate(group):
                held.append(ids[bounds[k]:bounds[k + 1]])
                if last:
                    yield np.concatenate(held) if len(held) > 1 else held[0]
                    held = []

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset behind every token."""
        return np.cumsum(self.merger.length[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        of = self.merger.bytes_of
        return b"".join([of[i] for i in ids.tolist()])


def rank_file(data: bytes) -> dict[bytes, int]:
    """Vocabulary of a rank file: lines of base64 bytes and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def json_file(data: bytes) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Vocabulary, merges and special strings of a byte-level tokenizer in JSON.  Its pieces are written with one
    printable character per byte: bytes that print as themselves keep their code point, the others follow from 256."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printing)]
    byte_of = {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(rest)}
    raw = lambda s: bytes(byte_of[c] for c in s)
    spec = json.loads(data)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return vocabulary, [(raw(a), raw(b)) for a, b in pairs], special
