"""Byte-level BPE by speculation and verification.

A word (one match of the pre-tokeniser's pattern) is first cut greedily into the longest vocabulary entries. A cut is
the BPE result exactly if every token encodes to itself and no adjacent pair would have merged across its border.
Pairs are tested together: all distinct pairs of a batch walk back through their last merges in numpy. Only words with
a failing pair are merged exactly, with a heap of candidate merges. Words are memoised per worker, up to a bound.

Defined cases: a vocabulary file with other settings than those assumed here raises; null text is empty and has no
tokens; a special token's string inside a text gets its own id; texts of any length are encoded whole, and very long
words take n log n; repeated rows are encoded each; ``encode`` and ``decode`` carry extra columns along (n_tokens, ids and
the decoded text replace columns of their names), ``digest`` returns the id column and three values; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Fixed value: the pre-tokeniser pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# \s of the pattern is Unicode White_Space, which lacks U+001C to U+001F
PATTERN = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
CACHE_WORDS, CACHE_CHARS = 400_000, 16 << 20  # of memoised words per worker
BATCH_CHARS = 1 << 20
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def require_plain(spec: dict, path: str) -> None:
    """Raises for a vocabulary file whose settings are not those that this tokeniser follows."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wanted = {
        "model type": (model.get("type"), "BPE"), "normalizer": (spec.get("normalizer"), None), "pre-tokenizer": (before.get("type"), "ByteLevel"),
        "add_prefix_space": (before.get("add_prefix_space"), False), "use_regex": (before.get("use_regex", True), True),
        **{k: (model.get(k) or None, None) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
    }
    for token in spec["added_tokens"]:
        for flag in ("single_word", "lstrip", "rstrip", "normalized"):
            wanted[f"{flag} of {token['content']}"] = (bool(token.get(flag)), False)
    other = [f"{k} is {got!r}" for k, (got, want) in wanted.items() if got != want]
    if other:
        raise ValueError(f"{path}: {', '.join(other)}")


class SpeculativeBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        require_plain(spec, path)
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.lengths = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        n = len(self.bytes_of)
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes a token; -1: a single byte
        self.left, self.right = np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[i, j] = (r, made)
            keys.append(i << 20 | j)
            ranks.append(r)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, i, j
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.single = [vocab[c] for c in letters]
        # tokens that encode to themselves: their halves do, and nothing merges across before the last merge
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        fine = self.compatible(self.left[made], self.right[made], 2 * self.rank[made])
        whole = np.zeros(n, bool)
        whole[self.single] = True
        for t, good in zip(made.tolist(), fine.tolist()):
            whole[t] = good and whole[self.left[t]] and whole[self.right[t]]
        self.entry = {self.bytes_of[t]: t for t in np.flatnonzero(whole).tolist()}
        self.heads = {b[:k] for b in self.entry for k in range(1, len(b) + 1)}
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        self.cache: dict[str, bytes] = {}
        self.cached_chars = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of tokens stays apart, for all pairs at once.

        Both tokens are taken apart from their last merge on. While the pieces (x, y) touch at the border, a merge of
        them that comes before the next event would have crossed it. Of equal ranks the merge further left is first.
        """
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until = np.full(len(a), NEVER) if limit is None else limit.copy()
        while len(at):
            key = x << 20 | y
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossing = np.where(self.keys[place] == key, 2 * self.ranks[place], NEVER)
            bad = crossing < until
            out[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[on], x[on], y[on], rx[on], ry[on]
            first = rx > ry
            until = np.where(first, 2 * rx, 2 * ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, heads, entry = [], 0, len(word), self.heads, self.entry
        while at < n:
            end = best = at + 1
            while end < n and word[at : end + 1] in heads:
                end += 1
                if word[at:end] in entry:
                    best = end
            out.append(entry[word[at:best]])
            at = best
        return out

    def exact(self, word: bytes) -> list[int]:
        """BPE by its definition: the lowest-ranked merge first, the leftmost of equals."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for u, v in ((before[i], i), (i, k)):
                if u >= 0 and v < n and (p := (ids[u], ids[v])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], u, *p))
        return [t for t in ids if t >= 0]

    def learn(self, words: set[str]) -> None:
        """Encodes ``words`` into the cache: propose, test all distinct adjacent pairs, merge what fails."""
        words = list(words)
        raw = [w.encode() for w in words]
        cuts = [self.greedy(b) for b in raw]
        flat = np.fromiter((t for c in cuts for t in c), np.int64)
        owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        inside = owner[1:] == owner[:-1]
        pairs, which = np.unique((flat[:-1] << 20 | flat[1:])[inside], return_inverse=True)
        good = self.compatible(pairs >> 20, pairs & (1 << 20) - 1)
        for i in set(owner[1:][inside][~good[which]].tolist()):
            cuts[i] = self.exact(raw[i])
        for w, c in zip(words, cuts):
            self.cache[w] = np.array(c, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, start = [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            lists, marked = [], set()
            for text in texts[start:end]:
                if self.split and self.split.search(text):
                    marked.add(len(lists))
                    parts = filter(None, self.split.split(text))
                    lists.append([w for p in parts for w in ([p] if p in self.special else self.pattern.findall(p))])
                else:
                    lists.append(self.pattern.findall(text))
            seen = set().union(*lists)
            if marked:
                seen -= self.special.keys()
            new = seen - self.cache.keys()
            chars = sum(map(len, new))
            if len(self.cache) + len(new) > CACHE_WORDS or self.cached_chars + chars > CACHE_CHARS:
                self.cache.clear()
                new, self.cached_chars = seen, 0
                chars = sum(map(len, new))
            self.cached_chars += chars
            self.learn(new)
            known, marks = self.cache, {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
            for i, words in enumerate(lists):
                out.append(b"".join([marks.get(w) or known[w] for w in words] if i in marked else map(known.__getitem__, words)))
            start = end
        return out

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token ends."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


LOADED: dict[str, SpeculativeBpe] = {}


def load(path: str) -> SpeculativeBpe:
    """One tokeniser per worker and file."""
    if path not in LOADED:
        LOADED[path] = SpeculativeBpe(path)
    return LOADED[path]


def batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Rows of ``batch`` in runs of about BATCH_CHARS characters: first row, texts (null as empty)."""
    texts, chars, first = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if texts and chars + len(text) > BATCH_CHARS:
            yield first, texts
            texts, chars, first = [], 0, i
        texts.append(text)
        chars += len(text)
    if texts:
        yield first, texts


def encode(docs: DataFrame, path: str, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and ids (little-endian unsigned 32-bit integers, as binary) in place of equal names.

    ``decoded``: a column for the text that the ids decode to, made by the same worker (``decode`` would start others).
    """
    more = ["n_tokens", "ids", *([decoded] if decoded else [])]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {m.lower() for m in more}])
    at = docs.columns.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in stream:
            for first, texts in batches(batch, at):
                ids = bpe.encode_batch(texts)
                rows = batch.slice(first, len(texts))
                made = [pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    made.append(pa.array([bpe.decode(np.frombuffer(i, "<u4")) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], [*rows.schema.names, *more])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, n_tokens long, ids binary" + (f", `{decoded}` string" if decoded else ""))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text that ``ids_col`` (little-endian unsigned 32-bit integers) stands for; null ids give null."""
    rows = rows.drop(*[c for c in rows.columns if c.lower() == text_col.lower()])
    at = rows.columns.index(ids_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in stream:
            texts = [None if i is None else bpe.decode(np.frombuffer(i, "<u4")) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, `{text_col}` string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, then decoded from the ids."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in stream:
            for first, texts in batches(batch, 1):
                counts, sha_ids, sha_text = [], [], []
                for ids in bpe.encode_batch(texts):
                    counts.append(len(ids) // 4)
                    sha_ids.append(hashlib.sha256(ids).hexdigest())
                    sha_text.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(counts, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
