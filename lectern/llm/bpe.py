"""BPE encoding and decoding with a pair occurrence index.

The words of a block of texts stand in one array of symbols, linked left and right within each word. An index maps every
adjacent pair to all its positions. Pairs that the vocabulary can merge are active; they are taken in ascending rank, and
each is applied at all its positions from left to right. A merge makes at most two new pairs, which join
the lists of the index; positions that went stale are passed over when their list is read.

Words are encoded once each: texts are cut at white space, pieces into words, and what is known stays known
to the worker within a bound.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import prepare
from .common import Memory, byte_slices, held


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 for itself, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A BPE file of the tokenizers library with byte-level letters and word ends: merges, ids, tokens and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:  # installed with the workers' libraries, not an input table
            spec = json.load(f)
        model = spec["model"]
        if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE with a word-end suffix is supported")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        # (left id, right id) -> rank; rank -> merged id
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.ids[left], self.ids[right]] = rank
            self.merged.append(self.ids[left + right])
        letters = byte_letters()
        self.parts = {r: p for p, r in self.ranks.items()}
        self.inner = np.array([self.ids[x] for x in letters])
        self.final = np.array([self.ids[x + self.suffix] for x in letters])
        # ranks of two bytes, the right one inside a word or (from column 256 on) at its end
        rights = [*self.inner.tolist(), *self.final.tolist()]
        self.byte_ranks = np.array([[self.ranks.get((a, b), -1) for b in rights] for a in self.inner.tolist()])
        pattern, = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None


def encode_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of non-empty words, one after another, and the number of ids of each."""
    ranks, merged, parts = vocabulary.ranks, vocabulary.merged, vocabulary.parts
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    ends = np.cumsum(lengths)
    last = np.zeros(len(data), bool)
    last[ends - 1] = True
    # the index before any merge: positions by the rank of the pair that starts there
    start_rank = np.full(len(data), -1, np.int64)
    start_rank[:-1] = vocabulary.byte_ranks[data[:-1], data[1:] + 256 * last[1:]]
    start_rank[last] = -1
    places = np.flatnonzero(start_rank >= 0)
    places = places[np.argsort(start_rank[places], kind="stable")]
    first_ranks, at = np.unique(start_rank[places], return_index=True)
    index = {r: x.tolist() for r, x in zip(first_ranks.tolist(), np.split(places, at[1:]))}
    symbols = array("i", np.where(last, vocabulary.final[data], vocabulary.inner[data]).astype(np.int32).tobytes())
    link = np.arange(1, len(data) + 1, dtype=np.int32)
    link[last] = -1
    after = array("i", link.tobytes())
    link = np.arange(-1, len(data) - 1, dtype=np.int32)
    link[ends - lengths] = -1
    before = array("i", link.tobytes())

    rank_of = ranks.get
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right = parts[rank]
        new = merged[rank]
        for i in sorted(index.pop(rank)):
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue  # stale: a neighbour was merged meanwhile
            k = after[i] = after[j]
            symbols[i], symbols[j] = new, -1
            if k >= 0:
                before[k] = i
                r = rank_of((new, symbols[k]))
                if r is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heapq.heappush(active, r)
            h = before[i]
            if h >= 0:
                r = rank_of((symbols[h], new))
                if r is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(active, r)
    result = np.array(symbols, np.int32)
    kept = result >= 0
    return result[kept], np.add.reduceat(kept, ends - lengths, dtype=np.int64) if len(words) else lengths


class TextEncoder:
    """Encodes and decodes whole texts; equal to the tokenizers library's ``encode(text, add_special_tokens=False)`` and
    ``decode(ids, skip_special_tokens=False)`` for vocabularies that lower-case, drop white space and have no decoder.

    Pieces (text between white space) are remembered within ``limit`` bytes; new ones are learned ``block`` bytes at a time. Added tokens
    stand in the memory by their id, a number, so that no character of a text can be taken for a mark of them.
    """

    def __init__(self, path: str, limit: int = 48 << 20, block: int = 1 << 20):
        self.vocabulary, self.memory, self.block = Vocabulary(path), Memory(limit), block
        self.openers = {token[0] for token in self.vocabulary.added if token}
        self.counts, self.spelled, self.decoded = np.zeros(1024, np.int64), [], []

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, the ids in decimal joined by spaces, and the decoded text."""
        pieces, sizes = [], []
        for text in texts:
            before = len(pieces)
            for part, added in self._parts(text):
                if added:
                    pieces.append(self.vocabulary.added[part])
                else:
                    pieces += _pieces(_lower(part))
            sizes.append(len(pieces) - before)
        index = self.memory.number(pieces)
        self._learn()
        out, end = [], 0
        for size in sizes:
            row = index[end:end + size]
            end += size
            places = row[self.counts[row] > 0].tolist()
            out.append((int(self.counts[row].sum()), " ".join(map(self.spelled.__getitem__, places)),
                        " ".join(map(self.decoded.__getitem__, places))))
        if self.memory.full:
            kept = self.memory.forget(_size)
            self.counts = self.counts[kept]
            self.spelled, self.decoded = [self.spelled[i] for i in kept.tolist()], [self.decoded[i] for i in kept.tolist()]
        return out

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        special = self.vocabulary.special
        if special is None or not any(c in text for c in self.openers):
            return [(text, False)]
        return [(x, i % 2 == 1) for i, x in enumerate(special.split(text))]

    def _learn(self) -> None:
        fresh, known = self.memory.fresh(), self.memory.known
        if not fresh:
            return
        v = self.vocabulary
        count = known + len(fresh)
        if count > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(2 * count, np.int64)])
        sizes = np.fromiter(map(_size, fresh), np.int64, len(fresh))
        blocks = np.cumsum(sizes) // self.block
        starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]).tolist()
        for at, end in zip(starts, [*starts[1:], len(fresh)]):
            part = fresh[at:end]
            words = [[x] if type(x) is int else v.words.findall(x) for x in part]
            distinct = list(dict.fromkeys(w for ws in words for w in ws if type(w) is not int))
            ids, lengths = encode_words([w.encode() for w in distinct], v)
            ids, spelling = ids.tolist(), {}
            begin = 0
            for word, n in zip(distinct, lengths.tolist()):
                own = ids[begin:begin + n]
                spelling[word] = (n, " ".join(map(str, own)), " ".join(map(v.tokens.__getitem__, own)))
                begin += n
            counts = []
            for ws in words:
                if len(ws) == 1:
                    n, ids_text, decoded = spelling.get(ws[0]) or (1, str(ws[0]), v.tokens[ws[0]])
                else:
                    found = [spelling[w] for w in ws]
                    n, ids_text, decoded = sum(f[0] for f in found), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])
                counts.append(n)
                self.spelled.append(ids_text)
                self.decoded.append(decoded)
            self.counts[known + at:known + end] = counts
        self.memory.learned(int(sizes.sum()))


def _size(piece: str | int) -> int:
    """About the bytes that a piece, its ids and what they decode to take."""
    return 250 + 6 * len(piece) if type(piece) is str else 250


def _lower(text: str) -> str:
    """NFC and lower case, letter by letter: a final sigma is lowered like any other."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()
    else:
        text = text.lower()
    return text


#: What the vocabulary's normaliser takes for white space; Python's own split knows four separators more.
_SPACE = regex.compile("[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F) + "]+")


def _pieces(text: str) -> list[str]:
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def encoder(path: str) -> TextEncoder:
    """One per worker and vocabulary."""
    return held(("bpe", path), lambda: TextEncoder(path))


class _Encode:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(self.path)
        for batch in byte_slices(batches, 1):
            done = encode.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([d[0] for d in done], pa.int64()),
                pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as token ids and back: ``doc_id, n_tokens, ids`` (decimal, joined by spaces), ``decoded``.

    No shuffle: a document is encoded where it is read. Null texts are empty and give no ids and an empty text. Null
    ids and repeated rows are kept; extra columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_Encode(tokenizer), "doc_id bigint, n_tokens bigint, ids string, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """SHA-256 of the ids and of the decoded text, in place of both."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
