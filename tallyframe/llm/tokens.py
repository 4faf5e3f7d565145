"""Token ids of whole texts through a cache of white-space chunks.

The vocabulary used here lower-cases, drops white space and never lets a
token span it, so the ids of a text are the ids of its white-space chunks one
after another. Chunks repeat, so each worker asks the tokenizer once per
distinct chunk and looks the rest up.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

#: Bytes at which a chunk may be cut off as a run of its own: ASCII signs that
#: are neither white space, letters, digits nor the apostrophe of contractions.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: Distinct chunks a worker keeps before it starts afresh.
MAX_CHUNKS = 300_000


class Memo(dict):
    """Number of each key in order of arrival; new keys wait in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class Ragged:
    """A growing list of integer arrays in flat storage."""

    def __init__(self):
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.n = self.used = 0

    def extend(self, rows: list[list[int]]) -> None:
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(lens.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(rows) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(rows), np.int32, total)
        self.ends[self.n + 1 : self.n + 1 + len(rows)] = self.used + np.cumsum(lens)
        self.n += len(rows)
        self.used += total

    def take(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows at ``idx`` one after another, and their lengths."""
        start = self.ends[idx]
        lens = self.ends[idx + 1] - start
        total = int(lens.sum())
        at = np.repeat(start - (np.cumsum(lens) - lens), lens) + np.arange(total)
        return self.flat[at], lens


def _merge(parts: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Plain byte-pair merging by listed pairs, lowest rank and leftmost first."""
    while len(parts) > 1:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not found:
            break
        i = min(found)[1]
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
    return parts


class RunEncoder:
    """Ids of a single letter or sign run, by a merge engine that works on ranks of bytes.

    The vocabulary marks word ends; a byte that UTF-8 never uses stands for
    the mark, and joining it to the last byte comes before every merge. The
    engine joins any neighbours that spell a token, while the vocabulary
    lists pairs. Both give the same ids as long as every token is what
    merging its own bytes gives: until two neighbours spell it, nothing
    outside has touched them. Tokens without that property can't arise from
    the listed pairs either, and are left out.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        # the printable stand-ins of bytes: most stand for themselves, the rest follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

        def spell(token: str) -> bytes:
            end = token.endswith(suffix) and len(token) > len(suffix)
            return bytes(byte_of[c] for c in (token[: -len(suffix)] if end else token)) + (self.END if end else b"")

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = [(spell(a), spell(b)) for a, b in pairs]
        ranks = {p: i for i, p in enumerate(pairs)}
        table = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        for i, (a, b) in enumerate(pairs):
            token = a + b
            end = token.endswith(self.END)
            parts = [bytes([x]) for x in (token[:-1] if end else token)]
            if end:
                parts[-1] += self.END
            if _merge(parts, ranks) == [token]:
                table[token] = 512 + i
        ids = {spell(t): n for t, n in model["vocab"].items()}
        self.ids = {r: ids.get(t, -1) for t, r in table.items()}
        self.engine = tiktoken.Encoding("runs", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})._core_bpe

    def encode(self, run: bytes) -> list[int]:
        ids = self.ids
        return [ids[r] for r in self.engine.encode_single_piece(run + self.END)]


class ChunkTokenizer:
    """``encode(texts as UTF-8)``: int32 ids per text, as the tokenizer gives for whole texts."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_chunks = max_chunks
        self.run_encoder = RunEncoder(path)
        self._reset()

    def _reset(self) -> None:
        self.chunks, self.chunk_rows = Memo(), Ragged()

    def _learn(self, fresh: list[bytes]) -> None:
        # most chunks are a letter run, a sign run or both; the tokenizer itself reads the others
        rows: list = []
        others: list[tuple[int, str]] = []
        encode = self.run_encoder.encode
        for c in fresh:
            core = c.rstrip(SIGNS)
            if not core:
                rows.append(encode(c))
                continue
            word = _plain_letters(core)
            if word is None:
                others.append((len(rows), c.decode()))
                rows.append(None)
            elif len(core) == len(c):
                rows.append(encode(word))
            else:
                rows.append(encode(word) + encode(c[len(core) :]))
        if others:
            found = self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)
            for (i, _), e in zip(others, found):
                rows[i] = e.ids
        self.chunk_rows.extend(rows)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.chunks) > self.max_chunks:
            self._reset()
        split = [t.split() for t in texts]  # at the six ASCII white-space bytes
        n = np.fromiter(map(len, split), np.int64, len(split))
        idx = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        del split
        if self.chunks.fresh:
            fresh, self.chunks.fresh = self.chunks.fresh, []
            self._learn(fresh)
        ids, lens = self.chunk_rows.take(idx)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(n)])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _plain_letters(core: bytes) -> bytes | None:
    """The lower-case run if ``core`` is letters of the Latin blocks alone, on which every engine agrees."""
    if core.isalpha():
        return core.lower()
    word = core.decode()
    if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
        return word.lower().encode()
    return None


_held: dict = {}


def worker_cache(key: object, make):
    """The worker's cache ``key``; making one drops that of another operator, so a worker holds one at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per worker and vocabulary file."""
    return worker_cache(("tokens", path), lambda: ChunkTokenizer(path))
