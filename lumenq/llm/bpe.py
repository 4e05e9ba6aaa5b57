"""Byte-level BPE over whole partitions by a pair occurrence index, and its inverse.

Texts are cut into pieces with numpy, each distinct piece of a chunk is encoded once, and the ids are dealt back.
Encoding distinct pieces works on all of them together: an index holds, for each mergeable pair, all positions where
it stands; active ranks are applied in ascending order to all their positions at once, and the lists of the pairs that
appear on either side are extended. A pair made by rank r holds r's symbol, which only later ranks use, so one
ascending pass gives the same as merging each piece on its own.
"""

from __future__ import annotations

import heapq
import json
import sys

import numpy as np
import pandas as pd
import regex

from lumenq.llm.common import ragged_gather

NONE = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 0, 3
#: Pieces of more bytes are never shared or kept. Shared ones of up to EXACT bytes are told apart by a key that holds all
#: their bytes, others by a hash, after which their bytes are compared.
SHARED_LENGTH = 128
EXACT = 7
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(EXACT + 1)], np.uint64)
COUNTED = np.arange(EXACT + 1, dtype=np.uint64) << np.uint64(56)
KEPT_PIECES = 300_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    shown = [b for b in range(256) if (33 <= b <= 126) or (161 <= b <= 172) or b >= 174]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in set(shown):
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def character_classes() -> np.ndarray:
    """Letter, number, white space or other for each code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    # Separators that `regex` counts as white space and the tokenizer's pattern does not.
    for c in range(0x1C, 0x20):
        table[c] = OTHER
    return table


def alike(x: np.ndarray, a: np.ndarray, n: np.ndarray, y: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each i whether the n[i] >= 8 bytes of x from a[i] on are the m[i] bytes of y from b[i] on."""
    out = n == m
    if not out.any():
        return out
    x8, y8 = (np.ndarray((len(z) - 7,), "<u8", np.ascontiguousarray(z), strides=(1,)) for z in (x, y))  # eight bytes from each on
    some = np.nonzero(out)[0]
    a, b, n = a[some], b[some], n[some]
    same = (x8[a] == y8[b]) & (x8[a + n - 8] == y8[b + n - 8])
    longer = np.nonzero(same & (n > 16))[0]
    if len(longer):
        size = n[longer]
        differ = ragged_gather(x, a[longer], size) != ragged_gather(y, b[longer], size)
        same[longer] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
    out[some] = same
    return out


class ByteBpe:
    """One vocabulary file, read once in each process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.of_byte = np.array([vocab[c] for c in alphabet], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = (left << 20) | right
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        self.byte_pairs = np.full((256, 256), NONE, np.int32)
        byte_of = np.full(size, -1, np.int64)
        byte_of[self.of_byte] = np.arange(256)
        low = np.nonzero((byte_of[left] >= 0) & (byte_of[right] >= 0))[0]
        self.byte_pairs[byte_of[left[low]], byte_of[right[low]]] = low
        lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.token_length, self.token_start = lengths, np.cumsum(lengths) - lengths
        self.token_blob = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        digits = [b"%d," % i for i in range(size)]
        self.digit_length = np.array([len(d) for d in digits], np.int64)
        self.digit_start = np.cumsum(self.digit_length) - self.digit_length
        self.digit_blob = np.frombuffer(b"".join(digits), np.uint8)
        self.classes = character_classes()
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._forget()
        self._powers(1 << 16)

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.known_slot = np.empty(0, np.int64)
        self.known_bytes = np.empty(0, np.uint8)
        self.known_start, self.known_length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.piece_start, self.piece_length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.piece_ids = np.empty(0, np.int32)

    def _powers(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15
        for name, b in (("up", base), ("down", pow(base, -1, 2**64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p))

    # ---- merging -------------------------------------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def encode_pieces(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (bytes `raw`, each piece from its start to the next one's) and the number of ids of each."""
        n = len(raw)
        if n == 0:
            return np.empty(0, np.int32), np.zeros(len(starts), np.int64)
        symbol = np.append(self.of_byte[raw], np.int32(-1))
        following = np.arange(1, n + 2)
        before = np.arange(-1, n)
        first = starts[starts < n]
        following[np.append(first[1:], n) - 1] = n  # the end: index n
        before[first] = -1
        rank = np.full(n + 1, NONE, np.int32)
        rank[: n - 1] = self.byte_pairs[raw[:-1], raw[1:]]
        rank[first[1:] - 1] = NONE
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(positions: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks != NONE
            if not keep.all():
                positions, ranks = positions[keep], ranks[keep]
            if not len(ranks):
                return
            if len(ranks) > 1:
                order = np.argsort(ranks, kind="stable")
                positions, ranks = positions[order], ranks[order]
                cuts = np.nonzero(ranks[1:] != ranks[:-1])[0] + 1
                parts = np.split(positions, cuts) if len(cuts) else [positions]
                heads = ranks[np.append(0, cuts)].tolist() if len(cuts) else [int(ranks[0])]
            else:
                parts, heads = [positions], [int(ranks[0])]
            for r, p in zip(heads, parts):
                if r in lists:
                    lists[r].append(p)
                else:
                    lists[r] = [p]
                    heapq.heappush(active, r)

        index(np.arange(n), rank[:n])
        while active:
            r = heapq.heappop(active)
            held = lists.pop(r)
            p = held[0] if len(held) == 1 else np.concatenate(held)
            p = p[rank[p] == r]
            if not len(p):
                continue
            if len(held) > 1:
                p = np.unique(p)
            if self.left[r] == self.right[r] and len(p) > 1:
                p = np.sort(p)
                take, taken_to = [], -1
                for at, after in zip(p.tolist(), following[p].tolist()):
                    if at != taken_to:
                        take.append(at)
                        taken_to = after
                p = np.array(take)
            q = following[p]
            behind = following[q]
            symbol[p] = self.made[r]
            following[p] = behind
            before[behind] = p  # index n takes what has nothing behind it
            rank[q] = NONE
            symbol[q] = -2
            to_right = np.where(behind < n, self._ranks(symbol[p], symbol[behind]), NONE)
            rank[p] = to_right
            ahead = before[p]
            some = ahead >= 0
            l = ahead[some]
            to_left = self._ranks(symbol[l], symbol[p[some]])
            rank[l] = to_left
            index(np.concatenate((p, l)), np.concatenate((to_right, to_left)))
        alive = symbol[:n] != -2
        counts = np.add.reduceat(alive, first).astype(np.int64) if len(first) else np.empty(0, np.int64)
        return symbol[:n][alive], np.append(counts, np.zeros(len(starts) - len(first), np.int64))

    # ---- cutting -------------------------------------------------------------------------------------------------

    def _pieces(self, x: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """True where a piece begins; breaks: where a text begins."""
        n = len(x)
        kind = self.classes[x]
        begins = np.zeros(n + 1, bool)
        begins[breaks] = True
        begins[n] = True
        turn = begins[:n].copy()
        turn[1:] |= kind[1:] != kind[:-1]
        white = kind == SPACE
        joined = np.zeros(n, bool)  # stands behind a blank of the same text
        joined[1:] = (x[:-1] == 32) & ~begins[1:n]
        leads = np.zeros(n, bool)  # is followed by something else than white space in the same text
        leads[:-1] = ~white[1:] & ~begins[1:n]
        start = np.where(white, turn | leads, turn & ~joined)
        for i in np.nonzero((x == 39) & start)[0].tolist():  # apostrophes: few
            if i + 1 < n and not begins[i + 1] and kind[i + 1] == LETTER:
                two = chr(x[i + 1]) + (chr(x[i + 2]) if i + 2 < n and not begins[i + 2] else "")
                length = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
                if length:
                    start[i + 1] = False
                    if length == 2:
                        start[i + 2] = begins[i + 2]
                    if i + 1 + length < n:
                        start[i + 1 + length] = True
        return start

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as UTF-8 bytes and offsets, one text behind the other, and the number of ids of each."""
        n_texts = len(offsets) - 1
        if offsets[-1] == offsets[0]:
            return np.empty(0, np.int32), np.zeros(n_texts, np.int64)
        text = raw.tobytes().decode("utf-8", "surrogatepass")
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = (raw & 0xC0) != 0x80
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(lead, out=at[1:])
        edges = at[offsets]  # in code points
        breaks = edges[:-1][edges[:-1] < edges[1:]]
        forced: list[tuple[int, int, int]] = []
        if self.special_pattern is not None and any(s in text for s in self.special):
            edge_set = np.unique(edges)
            for m in self.special_pattern.finditer(text):
                if np.searchsorted(edge_set, m.start(), side="right") == np.searchsorted(edge_set, m.end(), side="left"):
                    forced.append((m.start(), m.end(), self.special[m[0]]))
            breaks = np.unique(np.concatenate([breaks, [a for a, _, _ in forced], [b for _, b, _ in forced if b < len(x)]]).astype(np.int64))
        start = self._pieces(x, breaks)
        for a, b, _ in forced:
            start[a] = True
            start[a + 1 : b] = False
        begin = np.nonzero(start)[0]
        length = np.diff(np.append(begin, len(x)))
        byte_at = np.append(np.nonzero(lead)[0], len(raw))
        first = byte_at[begin]
        size = byte_at[begin + length] - first
        code, distinct = pd.factorize(self._keys(raw, first, size))
        where = np.empty(len(distinct), np.int64)
        where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        slot = self._slots(distinct, first[where], size[where], raw)[code]
        alone = slot < 0  # long pieces, and those whose hash another piece has
        shown = where[code]
        hashed = np.nonzero((size > EXACT) & ~alone & (shown != np.arange(len(shown))))[0]
        alone[hashed] = ~alike(raw, first[hashed], size[hashed], raw, first[shown[hashed]], size[shown[hashed]])
        if len(self.piece_length):
            starts, lengths = self.piece_start[slot], self.piece_length[slot]
        else:  # all are alone
            starts, lengths = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        own = np.nonzero(alone)[0]
        store = self.piece_ids
        if len(own):
            n = size[own]
            ids, counts = self.encode_pieces(ragged_gather(raw, first[own], n), np.cumsum(n) - n)
            starts[own], lengths[own] = len(store) + np.cumsum(counts) - counts, counts
            store = np.concatenate((store, ids))
        if forced:
            piece = np.searchsorted(begin, [a for a, _, _ in forced])
            starts[piece], lengths[piece] = len(store) + np.arange(len(forced)), 1
            store = np.concatenate((store, np.array([i for _, _, i in forced], np.int32)))
        ids = ragged_gather(store, starts, lengths)
        total = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        return ids, np.diff(total[np.searchsorted(begin, edges)])

    def _keys(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number for each piece: its bytes and their count if it has at most EXACT, else a hash."""
        if len(raw) > len(self.up):
            self._powers(1 << int(len(raw)).bit_length())
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        key = np.empty(len(first), np.uint64)
        short = size <= EXACT
        at = first[~short]
        key[~short] = (((sums[at + size[~short]] - sums[at]) * self.down[at]) >> np.uint64(8)) | np.uint64(255 << 56)
        eight = np.ndarray((len(raw),), "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))  # from each byte on
        n = size[short]
        key[short] = (eight[first[short]] & FIRST_BYTES[n]) | COUNTED[n]
        return key

    def _slots(self, distinct: np.ndarray, first: np.ndarray, size: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """The kept entry of each distinct key's piece, or -1; those not yet kept are encoded together."""
        at = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        found[inside] = self.known[at[inside]] == distinct[inside]
        if len(self.known) > KEPT_PIECES and not found.all():
            self._forget()
            found[:] = False
        slot = np.full(len(distinct), -1, np.int64)
        had = np.nonzero(found)[0]
        if len(had):
            entry = self.known_slot[at[had]]
            same = size[had] <= EXACT
            far = np.nonzero(~same)[0]
            same[far] = alike(raw, first[had[far]], size[had[far]], self.known_bytes, self.known_start[entry[far]], self.known_length[entry[far]])
            slot[had] = np.where(same, entry, -1)
        new = np.nonzero(~found & (size <= SHARED_LENGTH))[0]
        if len(new):
            n = size[new]
            own = ragged_gather(raw, first[new], n)
            ids, counts = self.encode_pieces(own, np.cumsum(n) - n)
            slot[new] = np.arange(len(self.piece_length), len(self.piece_length) + len(new))
            self.piece_start = np.concatenate((self.piece_start, len(self.piece_ids) + np.cumsum(counts) - counts))
            self.piece_length = np.concatenate((self.piece_length, counts))
            self.piece_ids = np.concatenate((self.piece_ids, ids))
            self.known_start = np.concatenate((self.known_start, len(self.known_bytes) + np.cumsum(n) - n))
            self.known_length = np.concatenate((self.known_length, n))
            self.known_bytes = np.concatenate((self.known_bytes, own))
            known = np.concatenate((self.known, distinct[new]))
            slots = np.concatenate((self.known_slot, slot[new]))
            order = np.argsort(known, kind="stable")
            self.known, self.known_slot = known[order], slots[order]
        return slot

    # ---- and back ------------------------------------------------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for and the number of bytes of each row of `counts` ids."""
        size = self.token_length[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ends = np.cumsum(counts)
        return ragged_gather(self.token_blob, self.token_start[ids], size), total[ends] - total[ends - counts]

    def decimal(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in decimal, each with a comma behind it, and the number of bytes of each row."""
        size = self.digit_length[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ends = np.cumsum(counts)
        return ragged_gather(self.digit_blob, self.digit_start[ids], size), total[ends] - total[ends - counts]


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The vocabulary at `path`, read once in this process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
