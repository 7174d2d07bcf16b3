"""Byte-pair merging of many words at once, from the vocabulary file of a public tokenizer.

All words of a batch are merged together: every round looks up the rank of each
neighbouring pair, finds each word's lowest rank and merges all its occurrences
from the left. That equals merging one pair at a time because every token of the
vocabulary is made by one merge only (checked on load), so a new pair never
outranks the pair just merged.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from tablewash.llm.lexicon import Lexicon

NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return [letters[b] for b in range(256)]


class PairTable:
    """Exact lookup of 64-bit keys: a few sparse hash tables, each taking what collided before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        seed = 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(8, int(np.ceil(np.log2(len(keys) * 8))))
            slot = (keys.astype(np.uint64) * np.uint64(seed)) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            k, v = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
            k[slot[first]], v[slot[first]] = keys[first], values[first]
            self.tables.append((np.uint64(seed), np.uint64(64 - bits), k, v))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
            seed = (seed * 0xD1B54A32D192ED03 | 1) % (1 << 64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        for seed, shift, k, v in self.tables:
            own = keys[todo]
            slot = ((own.astype(np.uint64) * seed) >> shift).astype(np.int64)
            there = k[slot]
            hit = there == own
            out[todo[hit]] = v[slot[hit]]
            todo = todo[~hit & (there != -1)]
            if not len(todo):
                break
        return out


class Merger:
    """Tokenizer file -> ids of words; ``suffix`` marks a word's last letter where the vocabulary has one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if model["type"] != "BPE" or len({a + b for a, b in pairs}) != len(pairs):
            raise ValueError("only BPE vocabularies whose tokens each come from one merge are supported")
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.table = PairTable(keys, np.arange(len(pairs), dtype=np.int64))
        self.made = made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {x: b for b, x in enumerate(letters)}
        self.bytes_of = [b""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            core = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            self.bytes_of[i] = bytes(byte_of[c] for c in core)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, concatenated, and the ids per word."""
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        sym = self.first[raw]
        if len(raw):
            last = ends[lengths > 0] - 1
            sym[last] = self.last[raw[last]]
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(raw))
        done_sym, done_place, done_word = [], [], []
        while len(sym):
            rank = np.full(len(sym), NONE, np.int64)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.table.get(sym[inside] * self.size + sym[inside + 1])
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            width = np.diff(np.append(starts, len(sym)))
            best = np.repeat(least, width)
            live = best < NONE
            if not live.all():  # words with no pair left to merge
                done_sym.append(sym[~live])
                done_place.append(place[~live])
                done_word.append(word[~live])
            hit = live & (rank == best)
            # equal neighbours (a a a): every second one, from the left of each streak
            at = np.flatnonzero(hit)
            if len(at) > 1:
                streak = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                offset = np.arange(len(at)) - np.repeat(streak, np.diff(np.append(streak, len(at))))
                at = at[offset % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = live
            keep[at + 1] = False
            sym, place, word = sym[keep], place[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        sym, place, word = (np.concatenate(x) for x in (done_sym, done_place, done_word))
        order = np.argsort(place, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(words))


#: Fixed value: the splitting pattern stated in the byte-level vocabulary file.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Marks that the pattern splits off the end of a word as a piece of their own.
ENDS = frozenset(".,;:!?")


class ByteWords:
    """Splitting of the byte-level vocabulary: pieces keep their leading space."""

    pattern = regex.compile(BYTE_PATTERN)

    def split(self, chunk: str) -> list[str]:
        return self.pattern.findall(chunk)

    def split_word(self, chunk: str) -> list[str]:
        """The same for ``chunk`` after a space."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1] in ENDS and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
        return self.pattern.findall(" " + chunk)


class LowerWords:
    r"""Splitting of the word vocabulary (lower case of the NFC form, white space dropped, pattern
    ``'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+``): all texts of a call are cut at once, as bytes."""

    #: Letters whose case, composition and class differ between Unicode versions, or whose lower case has
    #: more bytes: the library decides, about the whole chunk between ASCII white space. All others are NFC.
    exact = re.compile("[^\x00-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]")
    chunk = re.compile(rf"((?<![^ \t-\r])[^ \t-\r]*?{exact.pattern}[^ \t-\r]*)")
    #: Byte around such a chunk (no text in UTF-8 has it).
    WRAP = b"\xfe"
    SPACE, LETTER, DIGIT, OTHER, WRAPPED = range(5)

    def __init__(self):
        kinds = (regex.compile(r"\s"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}"))
        self.kind = np.array([next((k for k, p in enumerate(kinds) if p.match(chr(c))), self.OTHER) for c in range(0x800)], np.uint8)

    def plain(self, text: str) -> bytes:
        """The text in lower case, chunks that the library has to encode wrapped."""
        if text.isascii() or not self.exact.search(text):
            return text.lower().encode()
        parts = self.chunk.split(text)  # every second part is such a chunk
        return b"".join(self.wrapped(x) if k % 2 else x.lower().encode() for k, x in enumerate(parts))

    def wrapped(self, chunk: str) -> bytes:
        return self.WRAP + chunk.encode() + self.WRAP

    def cut(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct pieces of all texts, each place's piece, in order, and the places per text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        buf = np.frombuffer(b" ".join(texts) + b"   ", np.uint8)  # room for a mark's two letters
        kind = np.take(self.kind[:256], buf)
        wide = np.flatnonzero(buf >= 0x80)
        wrap = np.zeros(0, np.int64)
        if len(wide):
            high = buf[wide]
            wrap = wide[high == self.WRAP[0]]
            lead = wide[(high >= 0xC0) & (high < 0xE0)]
            own = self.kind[(buf[lead] & np.uint8(0x1F)).astype(np.int64) << 6 | buf[lead + 1] & np.uint8(0x3F)]
            kind[lead] = kind[lead + 1] = own
            for a, b in zip(wrap[::2].tolist(), wrap[1::2].tolist()):
                kind[a : b + 1] = self.WRAPPED
        edge = np.empty(len(buf), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == self.DIGIT
        edge[wrap[::2]] = True
        if len(wide):
            edge[lead + 1] = False
        # 's 't 're 've 'm 'll 'd: the mark alone before these letters
        mark = np.flatnonzero(buf == ord("'"))
        mark = mark[edge[mark] & (kind[mark] == self.OTHER) & (kind[mark + 1] == self.LETTER)]
        one, two = buf[mark + 1], buf[mark + 2]
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        single = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        edge[mark[single | pair] + 1] = False
        edge[mark[single] + 2] = True
        edge[mark[pair] + 3] = True
        at = np.flatnonzero(edge)
        lengths = np.diff(at, append=len(buf))
        word = kind[at] != self.SPACE
        at, lengths = at[word], lengths[word]
        first = np.searchsorted(at, np.cumsum(sizes) - sizes)
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(buf[kind != self.SPACE])])
        coded = pieces.dictionary_encode()
        _, bounds, raw = coded.dictionary.buffers()
        flat = raw.to_pybytes() if raw else b""
        words = [flat[a:b] for a, b in itertools.pairwise(np.frombuffer(bounds, np.int64, len(coded.dictionary) + 1).tolist())]
        return words, coded.indices.to_numpy(), np.diff(first, append=len(at))


#: Longer words are merged alone, with a heap.
LONG_WORD = 256
#: Longer pieces of texts cut as bytes are not remembered from call to call.
REMEMBERED_BYTES = 64


def merge_long(merger: Merger, word: bytes) -> np.ndarray:
    """One long word: lowest rank first, from the left, with a heap of pairs (n log n)."""
    raw = np.frombuffer(word, np.uint8)
    sym = merger.first[raw]
    sym[-1] = merger.last[raw[-1]]
    sym = sym.tolist()
    n, size = len(sym), merger.size
    if not hasattr(merger, "ranks"):
        merger.ranks = {int(k): int(v) for _, _, ks, vs in merger.table.tables for k, v in zip(ks, vs) if k >= 0}
    ranks, made = merger.ranks, merger.made
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(sym[i] * size + sym[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if sym[i] < 0 or j >= n or ranks.get(sym[i] * size + sym[j]) != rank:
            continue
        sym[i] = int(made[rank])
        sym[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(sym[a] * size + sym[b])) is not None:
                heapq.heappush(heap, (r, a))
    return np.array([s for s in sym if s >= 0], np.uint32)


SAFE = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """The text cut at single spaces between letters: no piece of either vocabulary crosses them."""
    parts = text.split(" ")
    return parts if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts) else SAFE.split(text)


def torn(chunk: str) -> bool:
    """Whether a cut beside this chunk was not between letters."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


class Encoder:
    """Texts -> ids as little-endian unsigned 32-bit integers. A chunk (of texts cut as bytes: a piece)
    seen before in this worker comes from a bounded memory; a new one is split, looked up in the lexicon
    (if any) and, where the lexicon lacks a piece, merged."""

    def __init__(self, path: str, splitter, lexicon: Lexicon | None = None, remembered: int = 500_000):
        self.merger, self.splitter, self.lexicon, self.remembered = Merger(path), splitter, lexicon, remembered
        self.inner: dict[str, bytes] = {}  # chunks after a space
        self.pieces: dict[str, bytes] = {}
        self.path, self._library = path, None
        self.words: dict[bytes, bytes] = {}  # pieces of texts cut as bytes
        self.marks = re.compile("(" + "|".join(map(re.escape, self.merger.special)) + ")")

    @property
    def library(self) -> Tokenizer:
        """Only for letters outside the plain ranges."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        got: list[bytes | None] = [None] * len(words)
        if self.lexicon is not None:
            for i, n in enumerate(self.lexicon.find(words).tolist()):
                if n >= 0:
                    got[i] = self.lexicon.ids_of(n).astype("<u4").tobytes()
        rest = [i for i, g in enumerate(got) if g is None and len(words[i]) <= LONG_WORD]
        ids, counts = self.merger.merge([words[i] for i in rest])
        flat, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        begin = 0
        for i, end in zip(rest, ends):
            got[i] = flat[begin:end]
            begin = end
        return [merge_long(self.merger, w).astype("<u4").tobytes() if g is None else g for w, g in zip(words, got)]

    def _learn(self, new: set[str], inner: bool) -> dict[str, bytes]:
        pieces, out = self.pieces, {}
        cut = self.splitter.split_word if inner else self.splitter.split
        split = list(map(cut, new))
        found = list(itertools.filterfalse(pieces.__contains__, set(itertools.chain.from_iterable(split))))
        pieces.update(zip(found, self._ids_of([p.encode("utf-8", "surrogatepass") for p in found])))
        for c, ps in zip(new, split):
            out[c] = pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The collector pauses meanwhile: nothing here makes cycles, and it would walk every remembered word."""
        running = gc.isenabled()
        gc.disable()
        try:
            return self._encode_cut(texts) if isinstance(self.splitter, LowerWords) else self._encode(texts)
        finally:
            if running:
                gc.enable()

    def _encode_cut(self, texts: list[str | None]) -> list[bytes]:
        """All texts cut as bytes; each distinct piece is looked up or merged once, its ids dealt to its places."""
        if not texts:
            return []
        plain, wrapped = self.splitter.plain, self.splitter.wrapped
        raw = [
            b"".join([wrapped(x) if k % 2 else plain(x) for k, x in enumerate(self.marks.split(t))]) if t and "<|" in t else plain(t or "")
            for t in texts
        ]
        words, places, per_text = self.splitter.cut(raw)
        if len(self.words) > self.remembered:
            self.words = {w: self.words[w] for w in words if w in self.words}  # the texts at hand hold the frequent ones
        known = self.words
        new = list(itertools.filterfalse(known.__contains__, words))
        odd = [w for w in new if w.startswith(self.splitter.WRAP)]
        if odd:
            found = self.library.encode_batch([w[1:-1].decode() for w in odd], add_special_tokens=False)
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(odd, found))
            new = list(itertools.filterfalse(known.__contains__, new))
        known.update(zip(new, self._ids_of(new)))
        ids = list(map(known.__getitem__, words))
        for w in (w for w in (*odd, *new) if len(w) > REMEMBERED_BYTES):
            del known[w]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        own = size[places]
        ends = np.cumsum(own)
        all_ids = flat[np.repeat(begin[places] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = (4 * np.append(0, ends)[np.append(0, np.cumsum(per_text))]).tolist()
        return [all_ids[a:b] for a, b in itertools.pairwise(bounds)]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        plans, new, heads = [], set(), set()
        if len(self.inner) + len(self.pieces) > self.remembered:
            self.inner.clear()
            self.pieces.clear()
        inner = self.inner
        for text in texts:
            plan = []
            # every second part is a special token's own string
            for k, part in enumerate(self.marks.split(text or "") if "<|" in (text or "") else [text or ""]):
                if k % 2:
                    plan.append(part)
                elif part:
                    first, *rest = part.split(" ")
                    missing = set(itertools.filterfalse(inner.__contains__, rest)).difference(new)  # each chunk is looked at once
                    if (rest and torn(first)) or any(map(torn, missing)):
                        first, *rest = SAFE.split(part)
                        missing = set(itertools.filterfalse(inner.__contains__, rest))
                    heads.add(first)
                    new.update(missing)
                    plan.append((first, rest))
            plans.append(plan)
        head = self._learn(heads, False)
        inner.update(self._learn(new, True))
        out = []
        for plan in plans:
            parts = []
            for x in plan:
                if isinstance(x, str):
                    parts.append(self.merger.special[x].to_bytes(4, "little"))
                else:
                    parts.append(head[x[0]])
                    parts.extend(map(inner.__getitem__, x[1]))
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text (stray bytes become the replacement character)."""
        raw = b"".join(map(self.merger.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()
