"""Token counts by a compiled finite-state transducer.

The tokenizer's splitting pattern (contractions, letter runs, single digits, other runs) is compiled
into a deterministic transducer over character classes.  Each transition carries two output bits, "a
piece starts here" and "a piece started one character ago".  A batch of texts is cut into chunks of
equal length; all chunks are stepped together from every entry state, which gives one state map per
chunk; the maps compose associatively through a parallel prefix scan, which gives each chunk's true
entry state; a second pass then reads the outputs.  The end of a piece is a transition annotated with
the number of tokens that the piece emits.  The annotation is compiled once per distinct piece and task
from the vocabulary's merges (``Merges``) and kept in a table indexed by piece fingerprint (128 bits).

The library does not count: it names the class of code points that Python's own tables do not know
(once, on the driver), and normalises texts with characters whose case folding or composition is not
one to one.  Texts that hold a special token are split there.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows may repeat; other columns are
ignored; an empty table gives an empty result; text length is unbounded (chunks bound the work arrays).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visloom.llm.textbytes import mix, powers, slices, utf8

# White space of the splitting pattern, and blocks whose characters map one to one.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PLAIN_BLOCKS = [(0, 0x300), (0x370, 0x483), (0x48A, 0x530), (0x2000, 0x2100), (0x3000, 0x302A), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000)]

SPACE, LETTER, DIGIT, OTHER, QUOTE, STMD, R, V, L, E = range(10)
START, IN_LETTERS, IN_OTHER, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
HERE, BEFORE = 1, 2
CHUNK = 512
LONG, NONE = 64, 1 << 40  # bytes of a piece that is merged on its own; rank of a pair without a merge


def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output bits) by state and character class, flattened over 7 states of 10 classes."""
    step, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (LETTER, STMD, R, V, L, E)
    for state in range(7):
        late = BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0  # the quote stood alone after all
        for c in range(10):
            if c == SPACE:
                step[state, c], out[state, c] = START, late
            elif c in letters:
                inside = state == IN_LETTERS or late
                step[state, c], out[state, c] = IN_LETTERS, late or (0 if inside else HERE)
            elif c == DIGIT:
                step[state, c], out[state, c] = START, late | HERE
            elif c == QUOTE:
                run = state in (IN_OTHER, QUOTED)
                step[state, c], out[state, c] = (IN_OTHER, 0) if run else (QUOTED, late | HERE)
            else:
                run = state in (IN_OTHER, QUOTED)
                step[state, c], out[state, c] = IN_OTHER, 0 if run else late | HERE
    for c, to in ((STMD, START), (R, QUOTED_R), (V, QUOTED_V), (L, QUOTED_L)):
        step[QUOTED, c], out[QUOTED, c] = to, 0
    for state, c in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        step[state, c], out[state, c] = START, 0
    return step.ravel(), out.ravel()


def _unknown_classes(path: str) -> dict[int, int]:
    """Class of the code points that Python's tables call unassigned, as the tokenizer's own splitting has it.

    Planes 4 to 13 hold no characters in any version.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    ask = [c for plane in (0, 1, 2, 3, 14) for c in range(plane << 16, (plane + 1) << 16) if unicodedata.category(chr(c)) == "Cn"]

    def joined(before: str) -> list[bool]:
        """Whether each character is in one piece with the one before it."""
        spans = {a: b - a for _, (a, b) in split(" ".join(before + chr(c) for c in ask))}
        return [spans.get(3 * i) == 2 for i in range(len(ask))]

    return {c: LETTER if after else DIGIT for c, after, other in zip(ask, joined("b"), joined("!")) if after or not other}


_tables: dict[str, bytes] = {}


def class_tables(path: str) -> bytes:
    """By code point, packed: character class (1 byte), distance to lower case (4), and whether folding it alone is right (1).

    Built once on the driver; a table of fixed size, a few KB when packed.
    """
    if path in _tables:
        return _tables[path]
    top = 0x110000
    kind, low, plain = np.full(top, OTHER, np.uint8), np.arange(top, dtype=np.uint32), np.zeros(top, bool)
    for c in range(top):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kind[c] = LETTER
        elif major == "N":
            kind[c] = DIGIT
    for c, k in _unknown_classes(path).items():
        kind[c] = k
    kind[WHITE] = SPACE
    for chars, k in (("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        kind[[ord(x) for x in chars]] = k
    for a, b in PLAIN_BLOCKS:
        for c in range(a, b):
            x = chr(c)
            if unicodedata.category(x) != "Cn" and unicodedata.normalize("NFC", x) == x and not unicodedata.combining(x) and len(x.lower()) == 1:
                plain[c] = True
                low[c] = ord(x.lower())
    _tables[path] = zlib.compress(kind.tobytes() + (low - np.arange(top, dtype=np.uint32)).tobytes() + plain.tobytes())
    return _tables[path]


def byte_names() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


class Merges:
    """The vocabulary's merges, by which the tokens of one piece are counted."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.to = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner, self.last = (np.array([vocab[x + y] for x in byte_names()]) for y in ("", end))
        key, self.made = np.array([a << 32 | b for a, b in self.to]), np.array([new for _, new in self.to.values()])
        self.rank = np.argsort(key)  # pairs are in the order of their ranks
        self.key = key[self.rank]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the pair has no merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[offsets[i] : offsets[i + 1]]; all short pieces take one merge a step, together."""
        size = np.diff(offsets)
        left, live = size.copy(), np.flatnonzero((size > 1) & (size <= LONG))
        for i in np.flatnonzero(size > LONG):
            left[i] = self.count(data[offsets[i] : offsets[i + 1]].tobytes())
        inside = np.zeros(len(data) + 1, np.int32)
        inside[offsets[live]] += 1
        inside[offsets[live + 1]] -= 1
        ids = self.inner[data]
        ids[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        ids = ids[np.cumsum(inside[:-1]) > 0]
        size = size[live]
        rank = np.full(len(ids), NONE)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = NONE
        while len(live):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, first)
            going = best < NONE
            if not going.all():
                left[live[~going]] = size[~going]
                keep = np.repeat(going, size)
                ids, rank, live, size, best = ids[keep], rank[keep], live[going], size[going], best[going]
                if not len(live):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            own = np.repeat(np.arange(len(live)), size)[hit]
            at = hit[np.concatenate([[True], own[1:] != own[:-1]])]  # the leftmost of each piece
            ids[at] = self.made[best]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            size = size - 1
            first, at = np.cumsum(size) - size, at - np.arange(len(at))
            stop = first + size - 1
            here = at[at < stop]
            rank[at] = NONE
            rank[here] = self._ranks(ids[here], ids[here + 1])
            prior = at[at > first] - 1
            rank[prior] = self._ranks(ids[prior], ids[prior + 1])
        return left

    def count(self, piece: bytes) -> int:
        """Tokens left when the merge of least rank, the leftmost first, is applied until none fits."""
        ids: list[int | None] = [*self.inner[np.frombuffer(piece[:-1], np.uint8)].tolist(), int(self.last[piece[-1]])]
        after, before, left = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), len(ids)
        heap = [(*self.to[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.to]
        heapq.heapify(heap)
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue  # one of the two has been merged since
            ids[i], ids[j], left = new, None, left - 1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (p := (ids[k], ids[after[k]])) in self.to:
                    heapq.heappush(heap, (*self.to[p], k, p))
        return left


def entry_states(classes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """State before each column's first character; classes is (chunk length, chunks)."""
    n = classes.shape[1]
    maps = np.repeat(np.arange(7, dtype=np.uint8)[None, :], n, axis=0)
    for row in classes:
        maps = step[maps * np.uint8(10) + row[:, None]]
    reach = 1
    while reach < n:  # maps[i] becomes the composition of all maps up to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return np.concatenate([[np.uint8(START)], maps[:-1, START]])


def piece_bounds(classes: np.ndarray, step: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece; the last class must be SPACE."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    grid = np.zeros(chunks * CHUNK, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    state, bits = entry_states(grid, step), np.empty_like(grid)
    for i, row in enumerate(grid):
        at = state * np.uint8(10) + row
        bits[i] = out[at]
        state = step[at]
    bits = bits.T.ravel()[:n]
    starts = (bits & HERE).astype(bool)
    starts[:-1] |= bits[1:] >= BEFORE
    begin = np.flatnonzero(starts)
    stops = starts | (classes == SPACE)
    stop_at = np.flatnonzero(stops)
    end = stop_at[np.searchsorted(stop_at, begin, "right")] if len(begin) else begin
    return begin, end


class Counter:
    """Counts the tokens of batches of texts; one per Python worker."""

    _made: dict[str, Counter] = {}

    def __init__(self, path: str, tables: bytes):
        from tokenizers import Tokenizer

        flat, top = zlib.decompress(tables), 0x110000
        self.kind = np.frombuffer(flat, np.uint8, top)
        self.low = np.frombuffer(flat, np.uint32, top, top) + np.arange(top, dtype=np.uint32)
        self.plain = np.frombuffer(flat, bool, top, 5 * top)
        self.normal, self.merges = Tokenizer.from_file(path).normalizer.normalize_str, Merges(path)
        self.step, self.out = split_transducer()
        self.value = [mix(np.arange(top, dtype=np.uint64) + np.uint64(seed)) for seed in (12345, 67890)]
        self.keys, self.counts = np.zeros((2, 1 << 20), np.uint64), np.zeros(1 << 20, np.int32)

    @classmethod
    def get(cls, path: str, tables: bytes) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(path, tables)
        return cls._made[path]

    def _emitted(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens that each piece emits."""
        p, inv = powers(len(points) + 1)
        h = []
        for value in self.value:
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(value[points] * p[:-1], out=sums[1:])
            h.append(mix((sums[end] - sums[begin]) * inv[begin] + (end - begin).astype(np.uint64)) | np.uint64(1))
        slot = (h[0] >> np.uint64(44)).astype(np.int64)
        got = self.counts[slot]
        miss = np.flatnonzero((self.keys[0][slot] != h[0]) | (self.keys[1][slot] != h[1]))
        if len(miss):
            _, first, back = np.unique(h[0][miss] ^ (h[1][miss] << np.uint64(1)), return_index=True, return_inverse=True)
            new = miss[first]
            size = end[new] - begin[new]
            upto = np.concatenate([[0], np.cumsum(size)])
            own = points[np.repeat(begin[new] - upto[:-1], size) + np.arange(upto[-1])]
            width = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
            data = np.frombuffer(own.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            fresh = self.merges.counts(data, np.concatenate([[0], np.cumsum(width)])[upto]).astype(np.int32)
            self.keys[0][slot[new]], self.keys[1][slot[new]], self.counts[slot[new]] = h[0][new], h[1][new], fresh
            got[miss] = fresh[back]
        return got

    def _points(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        points, owner, n = [], [], np.zeros(len(texts), np.int64)
        space = np.array([32], np.uint32)
        for i, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text and ("<|startoftext|>" in text or "<|endoftext|>" in text):
                # Special strings are matched before normalising, so the text falls apart there.
                parts = [text]
                for special in ("<|startoftext|>", "<|endoftext|>"):
                    parts = [y for x in parts for y in x.split(special)]
                n[i] += text.count("<|startoftext|>") + text.count("<|endoftext|>")
            else:
                parts = [text]
            for part in parts:
                x = self._points(part)
                if not part.isascii() and not self.plain[x].all():
                    x = self._points(self.normal(part))
                else:
                    x = self.low[x]
                points += [x, space]
                owner.append((i, len(x) + 1))
        if not points:
            return n
        flat = np.concatenate(points)
        begin, end = piece_bounds(self.kind[flat], self.step, self.out)
        if len(begin):
            ids, lens = np.array(owner).T
            doc = ids[np.searchsorted(np.cumsum(lens), begin, "right")]
            n += np.bincount(doc, self._emitted(flat, begin, end), len(texts)).astype(np.int64)
        return n


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per input row."""
    tables = class_tables(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.get(tokenizer_path, tables)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            for i, j in slices(offsets, 500_000):
                tokens[i:j] = counter.count([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
