"""BPE with word ends: speculative longest match, verified pair by pair, exact merges as the last resort.

Reads a public tokenizer file (NFC, lower case, a pattern of pieces, bytes as
characters, BPE with an end-of-word suffix) and encodes as that file prescribes.
All different words of a block of texts are encoded together, in arrays.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A rank that no merge has.
NEVER = np.iinfo(np.int64).max
#: Failing words of more bytes are merged one by one with a heap.
SHORT = 48
#: Characters of text that are encoded together; bounds the arrays.
BLOCK_CHARS = 6_000_000
#: Characters of different runs whose tokens are kept from block to block; bounds what a Python process holds.
KNOWN_CHARS = 3_000_000
#: Python's and Arrow's white space, but not the file's.
ODD_SPACE = "[\\x1c-\\x1f]"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def has_unassigned(text: str) -> bool:
    """Whether a text has characters that Python's Unicode tables do not know."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


@lru_cache(maxsize=4)
def load(path: str) -> "WordBPE":
    """One tokenizer per Python process and file."""
    return WordBPE(path)


class ArrayMap:
    """A hash table from non-negative integers to integers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self.keys[slots[won]], self.values[slots[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won)
            slots[left] = (slots[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], missing)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


def strings(texts: pa.Array) -> list[str]:
    """The Python strings of an array without nulls."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def expanded(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the given rows of a ragged array, one after the other."""
    sizes = np.diff(offsets)[rows]
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - (ends - sizes), sizes)
    return np.concatenate(([0], ends)), values[places]


class WordBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError(f"{path} is not a BPE file with word ends")
        self.path, self.reader = path, None
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern, regex.V1).findall
        self.pieces_and_breaks = regex.compile(f"{pattern}|\n", regex.V1).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.text_of = {**{i: t for t, i in self.ids.items()}, **{i: t for t, i in self.special.items()}}
        size = max(self.text_of) + 1
        self.names = pa.array([self.text_of.get(i, "") for i in range(size)], pa.large_string())
        characters = byte_characters()
        # A symbol is a byte, or 256 and a byte that ends its word.
        self.byte_of = {c: b for b, c in enumerate(characters)}
        self.symbol_ids = np.array([self.ids[c] for c in characters] + [self.ids[c + self.end] for c in characters])
        self._read_merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self._forget()

    def _read_merges(self, merges: list[tuple[str, str]]) -> None:
        size = max(self.ids.values()) + 1
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token, -1 for single bytes
        self.left, self.right, self.size = np.arange(size), np.arange(size), size
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge[x, y] = (rank, made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        keys = np.array([x * size + y for x, y in self.merge], np.int64)
        self.ranks = ArrayMap(keys, np.array([r for r, _ in self.merge.values()], np.int64))
        self.made = np.array([self.ids[a + b] for a, b in merges], np.int64)
        # Only tokens that their own text really merges to may be proposed, and only
        # where parts are always made before the whole is the pair test exact.
        made = np.flatnonzero(self.rank >= 0)
        sound = self.compatible(self.left[made], self.right[made], self.rank[made])
        sound &= (self.rank[self.left[made]] < self.rank[made]) & (self.rank[self.right[made]] < self.rank[made])
        whole = np.ones(size, bool)
        whole[made] = False
        for token, fine in sorted(zip(made.tolist(), sound.tolist()), key=lambda t: self.rank[t[0]]):
            whole[token] = fine and whole[self.left[token]] and whole[self.right[token]]
        self._grow_trie({t: i for t, i in self.ids.items() if whole[i]})

    def _grow_trie(self, tokens: dict[str, int]) -> None:
        steps: dict[int, int] = {}
        accepts = [-1]
        for text, token in tokens.items():
            last = text.endswith(self.end) and len(text) > len(self.end)
            symbols = [self.byte_of[c] for c in (text[: -len(self.end)] if last else text)]
            symbols[-1] += 256 * last
            node = 0
            for s in symbols:
                following = steps.get(512 * node + s)
                if following is None:
                    following = steps[512 * node + s] = len(accepts)
                    accepts.append(-1)
                node = following
            accepts[node] = token
        self.steps = ArrayMap(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64))
        self.accepts = np.array(accepts)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Which neighbours a, b stay apart while their two texts are merged side by side.

        Both tokens are taken apart again, the later made first. Wherever a part x
        that ends `a` meets a part y that begins `b`, a merge of x and y would have
        come first if it ranks before the merge that used up x (the one further left
        wins a tie) and not after the one that used up y.
        """
        x, y = np.array(a), np.array(b)
        x_gone, y_gone = np.broadcast_to(before, x.shape).copy(), np.broadcast_to(before, x.shape).copy()
        fine, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            xs, ys = x[open_], y[open_]
            joins = self.ranks.get(xs * self.size + ys, NEVER)
            clash = (joins < x_gone[open_]) & (joins <= y_gone[open_]) & (joins < NEVER)
            fine[open_[clash]] = False
            made_x, made_y = self.rank[xs], self.rank[ys]
            go = ~clash & ((made_x >= 0) | (made_y >= 0))
            undo_x = go & (made_x > made_y)
            undo_y = go & ~undo_x
            at = open_[undo_x]
            x_gone[at], x[at] = made_x[undo_x], self.right[xs[undo_x]]
            at = open_[undo_y]
            y_gone[at], y[at] = made_y[undo_y], self.left[ys[undo_y]]
            open_ = open_[go]
        return fine

    def propose(self, symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) in text order: each word's longest known token first, from left to right."""
        at, owners, tokens = start.copy(), [], []
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            best, best_end = np.full(len(open_), -1), at[open_]
            place, node, walking = at[open_], np.zeros(len(open_), np.int64), np.arange(len(open_))
            while len(walking):
                node = self.steps.get(512 * node + symbols[place], -1)
                alive = node >= 0
                walking, node, place = walking[alive], node[alive], place[alive] + 1
                token = self.accepts[node]
                found = token >= 0
                best[walking[found]], best_end[walking[found]] = token[found], place[found]
                inside = place < stop[open_[walking]]
                walking, node, place = walking[inside], node[inside], place[inside]
            owners.append(open_)
            tokens.append(best)
            at[open_] = best_end
            open_ = open_[best_end < stop[open_]]
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    def merged_together(self, offsets: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, tokens) of short words merged side by side: the lowest rank first, the leftmost of equals."""
        sizes = np.diff(offsets)
        grid = np.full((len(sizes), int(sizes.max()) + 1), -1, np.int64)
        columns = np.arange(grid.shape[1])
        grid[columns < sizes[:, None]] = self.symbol_ids[symbols]
        open_ = np.arange(len(sizes))
        while len(open_):
            a, b = grid[open_, :-1], grid[open_, 1:]
            ranks = self.ranks.get(np.where(b >= 0, a * self.size + b, -2).ravel(), NEVER).reshape(a.shape)
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(open_)), at]
            go = best < NEVER
            open_, at, best = open_[go], at[go], best[go]
            shifted = np.where(columns[:-1] > at[:, None], grid[open_, 1:], grid[open_, :-1])
            shifted[np.arange(len(open_)), at] = self.made[best]
            grid[open_, :-1] = shifted
            grid[open_, -1] = -1
        held = grid >= 0
        return held.sum(axis=1), grid[held]

    def merged_alone(self, tokens: list) -> list[int]:
        """The same for one word of any length, with a heap of candidates and linked neighbours."""
        n = len(tokens)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.merge[p][0], i, p) for i, p in enumerate(zip(tokens, tokens[1:])) if p in self.merge]
        heapify(queue)
        while queue:
            _, i, pair = heappop(queue)
            j = after[i] if tokens[i] is not None else n
            if j >= n or (tokens[i], tokens[j]) != pair:
                continue  # overtaken by an earlier merge
            tokens[i], tokens[j] = self.merge[pair][1], None
            after[i] = after[j]
            if after[i] < n:
                ahead[after[i]] = i
            for k in (ahead[i], i):
                if k >= 0 and after[k] < n and (near := (tokens[k], tokens[after[k]])) in self.merge:
                    heappush(queue, (self.merge[near][0], k, near))
        return [t for t in tokens if t is not None]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, tokens) of normalised pieces.

        All are proposed, all neighbours of all proposals are verified at once, and
        only the words that fail are merged step by step.
        """
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[offsets[1:] - 1] += 256
        owner, token = self.propose(symbols, offsets[:-1], offsets[1:])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fits = self.compatible(token[inner], token[inner + 1])
        bad = np.zeros(len(words), bool)
        bad[owner[inner[~fits]]] = True
        fine = ~bad[owner]
        owners, tokens = [owner[fine]], [token[fine]]
        for low, high in ((0, 8), (8, 16), (16, SHORT)):  # words of like length share a grid
            some = np.flatnonzero(bad & (sizes > low) & (sizes <= high))
            if len(some):
                counts, merged = self.merged_together(*expanded(offsets, symbols, some))
                owners.append(np.repeat(some, counts))
                tokens.append(merged)
        for w in np.flatnonzero(bad & (sizes > SHORT)).tolist():
            merged = self.merged_alone(self.symbol_ids[symbols[offsets[w] : offsets[w + 1]]].tolist())
            owners.append(np.full(len(merged), w))
            tokens.append(np.array(merged))
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(words))
        return np.concatenate(([0], np.cumsum(counts))), token[order]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, tokens) of texts whose pieces are given in turn, a newline after each text."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        different, which = strings(coded.dictionary), coded.indices.to_numpy()
        stop = different.index("\n")
        different[stop] = "."  # a stand-in, which gives no token below
        special = [(n, self.special[w]) for n, w in enumerate(different) if w in self.special]
        for n, _ in special:
            different[n] = "."
        offsets, tokens = self.encode_words(different)
        for n, token in special:
            tokens[offsets[n]] = token
        # The newline's row loses its token.
        tokens = np.delete(tokens, offsets[stop])
        offsets = offsets - (np.arange(len(offsets)) > stop)
        ends, found = expanded(offsets, tokens, which)
        return np.concatenate(([0], ends[1:][which == stop])), found

    @staticmethod
    def _normal(text: str) -> str:
        """NFC and lower case, character by character: a capital sigma is never a final one."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text, special tokens among them."""
        if (parts := self.apart.split(text))[1:]:
            return [p for n, part in enumerate(parts) for p in ([part] if n % 2 else self._pieces(part))]
        if not has_unassigned(text):
            return self.pieces(self._normal(text))
        # The library may know characters that this Unicode version lacks.
        from tokenizers import Tokenizer

        self.reader = self.reader or Tokenizer.from_file(self.path)
        normal = self.reader.normalizer.normalize_str(text)
        found = self.reader.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(self.byte_of[c] for c in piece).decode() for piece, _ in found]

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, tokens) of texts without newlines."""
        joined = "\n".join(runs)
        if "<|" in joined or has_unassigned(joined):
            pieces = [p for run in runs for p in (*self._pieces(run), "\n")]
        else:
            pieces = [*self.pieces_and_breaks(self._normal(joined)), "\n"]
        return self._encode_pieces(pieces)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_ends, self.known_tokens, self.held = np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def _encode_known(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `_encode_runs`, of different runs: only those that no block before had are encoded.

        A run's tokens depend on nothing beside it. What is known is forgotten as a whole where it
        would go beyond `KNOWN_CHARS`; a block that goes beyond it alone is not kept.
        """
        rows = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        new = np.flatnonzero(rows < 0)
        fresh = [runs[n] for n in new.tolist()]
        size = sum(map(len, fresh))
        if self.held + size > KNOWN_CHARS:
            self._forget()
            fresh, new, size = runs, np.arange(len(runs)), sum(map(len, runs))
            if size > KNOWN_CHARS:
                return self._encode_runs(runs)
        if fresh:
            offsets, tokens = self._encode_runs(fresh)
            rows[new] = len(self.known) + np.arange(len(fresh))
            self.known.update(zip(fresh, rows[new].tolist()))
            self.known_ends = np.concatenate((self.known_ends, self.known_ends[-1] + offsets[1:]))
            self.known_tokens = np.concatenate((self.known_tokens, tokens.astype(np.int32)))
            self.held += size
        return expanded(self.known_ends, self.known_tokens, rows)

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Token ids (lists of int32) of a string array without nulls; special tokens' strings become those tokens."""
        parts, start, held = [], 0, 0
        lengths = pc.utf8_length(texts).to_pylist()
        for n, length in enumerate(lengths):
            if held and held + length > BLOCK_CHARS:
                parts.append(self._encode_block(texts.slice(start, n - start)))
                start, held = n, 0
            held += length
        parts.append(self._encode_block(texts.slice(start)))
        return pa.concat_arrays(parts)

    def _encode_block(self, texts: pa.Array) -> pa.Array:
        """Pieces never hold white space, so every different run without it is encoded once."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = split.flatten().dictionary_encode()
        offsets, tokens = self._encode_known(strings(coded.dictionary))
        word_ends, tokens = expanded(offsets, tokens, coded.indices.to_numpy())
        ends = word_ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if pc.any(odd).as_py():  # rare texts that must not be split at these characters
            some = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            own = [self._encode_pieces([*self._pieces(t), "\n"])[1] for t in texts.take(pa.array(some)).to_pylist()]
            rows = np.split(tokens, ends[1:-1])
            for n, found in zip(some.tolist(), own):
                rows[n] = found
            ends, tokens = np.concatenate(([0], np.cumsum(list(map(len, rows))))), np.concatenate(rows)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32()))

    def decode_array(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids. The file names no decoder: tokens are joined by spaces."""
        names = self.names.take(ids.flatten())
        offsets = pa.array(ids.offsets.to_numpy() - ids.offsets[0].as_py(), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, names), pa.scalar(" ", pa.large_string()))
