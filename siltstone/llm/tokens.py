"""Exact tokenizer ids at scan speed: texts are cut where the tokenizer always cuts, and the ids of a
chunk are kept, so that the tokenizer itself runs once for each distinct chunk a worker meets.  Ids and
spans equal those of the `tokenizers` library for the whole text; the tests compare them.

`byte` is for byte-level vocabularies whose pre-tokenizer is the usual expression with an optional
leading space: it always cuts just before a space that a visible character follows.  `word` is for
vocabularies that drop white space: they always cut at a space or line feed.  Only characters for
which every library agrees on "visible" count; elsewhere chunks are longer, never wrong.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Chunks a worker keeps; then it starts anew.
CACHE_CHUNKS = 1_000_000

_AFTER_SPACE = "!-~À-ɏ"
_ODD_SPACE = re.compile(f"[ \\n](?![{_AFTER_SPACE}])")
_CUT = re.compile(f" (?=[{_AFTER_SPACE}])")
#: Chunks whose words are plain to see: letters, then points and commas.  All others go to the library's own pre-tokenizer.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes that byte-level vocabularies use: visible Latin-1 characters stand for themselves, the others follow U+0100 in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: Word ends in vocabularies that mark them.
_END = "</w>"


class _Numbers(dict):
    """Numbers keys in order of first sight; new keys also go to `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.a, self.n = np.zeros(1024, dtype), 0

    def add(self, values) -> None:
        values = np.asarray(values, self.a.dtype)
        if self.n + len(values) > len(self.a):
            self.a = np.concatenate([self.a, np.zeros(max(len(self.a), len(values)), self.a.dtype)])
        self.a[self.n : self.n + len(values)] = values
        self.n += len(values)


class Merger:
    """The merges of a tokenizer file for single pre-tokens of plain letters, points and commas, run by tiktoken's
    kernel, which is some eight times faster for words not met before.  A word end that is part of a symbol
    becomes a byte value of its own: plain pre-tokens use few enough byte values for that."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, byte_of = model["vocab"], {c: b for b, c in _LETTERS.items()}
        ended = any(k.endswith(_END) for k in vocab)
        used = [*map(ord, ".,"), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)] if ended else range(256)
        free = (b for b in range(256) if b not in set(used))
        self.last = np.arange(256, dtype=np.uint8)
        if ended:
            for b in used:
                self.last[b] = next(free)
        known = set(used)

        def symbol(token: str) -> bytes | None:
            end = ended and token.endswith(_END)
            raw = bytes(byte_of[c] for c in (token[: -len(_END)] if end else token))
            if not known.issuperset(raw):
                return None
            return raw[:-1] + bytes([self.last[raw[-1]]]) if end else raw

        ranks = {bytes([b]): b for b in range(256)}
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            if (x := symbol(left + right)) is not None:
                ranks[x] = 256 + i
        self.id_of = np.zeros(256 + len(model["merges"]), np.uint32)
        for token, n in vocab.items():
            if (x := symbol(token)) is not None and x in ranks:
                self.id_of[ranks[x]] = n
        self.one = tiktoken.Encoding("pieces", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.ended = ended

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces and how many each has; no piece is empty or has a line feed."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.ended:
            got = np.array(self.one.encode_ordinary("\n".join(pieces)), np.int64)
            cut = np.flatnonzero(got == 0x0A)
            counts = np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1
            return self.id_of[np.delete(got, cut)], counts
        raw = np.frombuffer("\n".join(pieces).encode() + b"\n", np.uint8).copy()
        line = np.flatnonzero(raw == 0x0A)
        raw[line - 1] = self.last[raw[line - 1]]
        data, at, lists, single = raw.tobytes(), 0, [], self.one._core_bpe.encode_single_piece
        for stop in line.tolist():
            lists.append(single(data[at:stop]))
            at = stop + 1
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return self.id_of[np.fromiter((x for e in lists for x in e), np.int64, int(counts.sum()))], counts


class ChunkTokenizer:
    """Ids (and character spans) of whole texts, equal to the library's for the whole text."""

    def __init__(self, path: str, kind: str, spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merger = Merger(path) if not spans else None
        self.byte, self.spans = kind == "byte", spans
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers()
        self.starts, self.lengths, self.flat = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint32)
        self.begin, self.end, self.chars = _Grown(np.int32), _Grown(np.int32), _Grown(np.int64)

    def _chunks(self, text: str) -> list[str]:
        """Keys of the text's chunks.  byte: the chunk without its leading space, or NUL and a chunk that has none, as
        the first, a line feed between visible characters, and what follows it."""
        if not self.byte:
            return text.replace("\n", " ").split(" ")
        if _ODD_SPACE.search(text):
            return _CUT.split("\0" + text)
        return ("\0" + text).replace("\n", " \0\n \0").split(" ")

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        for i in range(0, len(fresh), 8192):
            part = fresh[i : i + 8192]
            texts = [k[1:] if k[0] == "\0" else " " + k for k in part] if self.byte else part
            if self.spans:
                got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
                ids = np.fromiter((x for e in got for x in e.ids), np.uint32)
                n = np.fromiter((len(e.ids) for e in got), np.int64, len(got))
                pairs = np.array([p for e in got for p in e.offsets], np.int32).reshape(-1, 2)
                self.begin.add(pairs[:, 0])
                self.end.add(pairs[:, 1])
                self.chars.add([len(t) for t in texts] if self.byte else [len(t) + 1 for t in texts])
            else:
                ids, n = self._ids(texts)
            self.starts.add(self.flat.n + np.cumsum(n) - n)
            self.lengths.add(n)
            self.flat.add(ids)

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks and how many each has.  Plain words are cut here and merged; all other chunks go to the library."""
        pieces, owner, odd, match, byte = [], [], [], _PLAIN.fullmatch, self.byte
        for j, chunk in enumerate(chunks):
            space = byte and chunk[:1] == " "
            m = match(chunk, 1 if space else 0)
            if m is None:
                odd.append(j)
                continue
            word, rest = m.groups()
            pieces.append(" " + word if space else word if byte else word.lower())
            owner.append(j)
            if rest:
                pieces.append(rest)
                owner.append(j)
        ids, counts = self.merger.encode(pieces)
        whose = np.repeat(np.array(owner, np.int64), counts)
        if odd:
            more = self.tokenizer.encode_batch_fast([chunks[j] for j in odd], add_special_tokens=False)
            lists = [e.ids for e in more]
            ids = np.concatenate([ids, np.fromiter((x for e in lists for x in e), np.uint32)])
            whose = np.concatenate([whose, np.repeat(np.array(odd, np.int64), [len(e) for e in lists])])
            ids, whose = ids[order := np.argsort(whose, kind="stable")], whose[order]
        return ids, np.bincount(whose, minlength=len(chunks)).astype(np.int64)

    def _gather(self, texts: list[str | None]):
        if len(self.numbers) > CACHE_CHUNKS:
            self._reset()
        number, parts, sizes = self.numbers.__getitem__, [], []
        for t in texts:
            chunks = self._chunks(t) if t else []
            parts.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
            sizes.append(len(chunks))
        if self.numbers.fresh:
            self._learn()
        which = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        firsts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        n = self.lengths.a[which]
        ends = np.cumsum(n)
        at = np.repeat(self.starts.a[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return at, which, n, np.concatenate([[0], ends])[firsts], firsts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one entry more than texts)."""
        at, _, _, bounds, _ = self._gather(texts)
        return self.flat.a[at], bounds

    def encode_spans(self, texts: list[str | None]):
        """ids, bounds, and each token's first and past-the-last character in its text."""
        at, which, n, bounds, firsts = self._gather(texts)
        before = np.concatenate([[0], np.cumsum(self.chars.a[which])])
        base = np.repeat(before[:-1] - np.repeat(before[firsts[:-1]], np.diff(firsts)), n)
        return self.flat.a[at], bounds, self.begin.a[at] + base, self.end.a[at] + base


_LOADED: dict[tuple, ChunkTokenizer] = {}


def tokenizer(path: str, kind: str, spans: bool = False) -> ChunkTokenizer:
    """One for each worker process, so that its chunks serve all tasks."""
    key = (path, kind, spans)
    if key not in _LOADED:
        _LOADED[key] = ChunkTokenizer(path, kind, spans)
    return _LOADED[key]
