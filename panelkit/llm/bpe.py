"""Byte-level BPE encoding and decoding with a pair occurrence index.

The words of a stretch of documents are laid out as one linked list of byte
symbols. An index maps each adjacent pair that has a merge rank to all its
positions. Ranks that occur are applied in ascending order, each to all its
positions from left to right; a merge updates the position lists of the two
pairs it makes. A merge's product is only used by later ranks, so one ascending
pass gives the same result as merging each word on its own.

The vocabulary (about 50,000 merges, a fixed size) is read by the driver from a
tokenizer file whose path is a parameter, and sent to the tasks as a broadcast.
Tasks keep a bounded cache of words already encoded; it never changes a result.
Texts are worked off in stretches of at most ``STRETCH`` characters, or one
document, so memory does not depend on the number of rows.

Defined results: null counts as empty; empty text gives no tokens; the strings
of special tokens inside a text become these tokens, as the tokenizers library
does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import with_row

#: the pre-tokenizer's pattern (fixed value); \s is Unicode white space
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
STRETCH = 4_000_000
CACHE_WORDS = 600_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 characters stand for themselves, the others for the
    characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict:
    """Of a byte-level BPE file: ``special`` tokens, the ``bytes`` of each id, the
    ``start`` id of each byte, ``rank`` by pair (a << 32 | b), and by rank the
    pair and its ``product``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, chars = spec["model"]["vocab"], byte_chars()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = {"special": special, "rank": {}, "product": [], "start": [0] * 256,
           "bytes": {i: bytes(chars[c] for c in tok) for tok, i in vocab.items() if tok not in special}
           | {i: tok.encode() for tok, i in special.items()}}
    for c, b in chars.items():
        out["start"][b] = vocab[c]
    for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
        out["rank"][vocab[a] << 32 | vocab[b]] = len(out["product"])
        out["product"].append((vocab[a], vocab[b], vocab[a + b]))
    return out


def _sorted_pairs(v: dict) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.fromiter(v["rank"].keys(), np.int64, len(v["rank"]))
    ranks = np.fromiter(v["rank"].values(), np.int64, len(v["rank"]))
    order = np.argsort(pairs)
    return pairs[order], ranks[order]


def encode_words(words: list[bytes], v: dict) -> list[list[int]]:
    """Token ids of each word, by the pair occurrence index over all of them."""
    if not words:
        return []
    pairs, ranks = v["sorted_pairs"]
    # all words in one linked list; -1 stands after each word and belongs to no pair
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1)
    sym = np.full(int(ends[-1]), -1, np.int64)
    inner = np.ones(len(sym), bool)
    inner[ends - 1] = False
    sym[inner] = np.array(v["start"])[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    nxt, prv = np.minimum(np.arange(1, n + 1), n - 1), np.arange(-1, n - 1)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def file(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> None:
        """Enter the positions of those pairs that have a rank."""
        key = left << 32 | right
        i = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        ok = np.flatnonzero((pairs[i] == key) & (left >= 0) & (right >= 0))
        if not len(ok):
            return
        rank, at = ranks[i[ok]], at[ok]
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        for a, b in zip(cut, cut[1:]):
            r = int(rank[a])
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(active, r)

    file(sym[:-1], sym[1:], np.arange(n - 1))
    while active:
        r = heapq.heappop(active)
        left, right, made = v["product"][r]
        at = np.concatenate(index.pop(r))
        at = at[(sym[at] == left) & (sym[nxt[at]] == right)]  # some are gone since
        if left == right:  # in a run of one symbol every other place is taken, from the left
            take, free = [], -1
            for i in np.unique(at).tolist():
                if i >= free:
                    take.append(i)
                    free = nxt[nxt[i]]
            at = np.array(take, dtype=np.int64)
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        sym[at], sym[gone], nxt[at], prv[after] = made, -2, after, at
        before = prv[at]
        made_all = np.full(len(at), made)
        file(np.concatenate([made_all, np.where(before >= 0, sym[before], -1)]),
             np.concatenate([sym[after], made_all]), np.concatenate([at, before]))
    alive = sym >= 0
    ids = sym[alive].tolist()
    stops = np.cumsum(alive)[ends - 1].tolist()
    return [ids[a:b] for a, b in zip([0, *stops], stops)]


class Codec:
    """Splits texts into words and encodes each word once, while a bounded cache
    holds it: the number of its ids with these in decimal (``digests``) or as a
    list, and the bytes they decode to."""

    def __init__(self, v: dict, digests: bool = False):
        import regex

        self.v, self.special, self.digests = v, v["special"], digests
        self.find = regex.compile(PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split
        v["sorted_pairs"] = _sorted_pairs(v)
        self.cache: dict[str, tuple[int, list[int] | str, bytes]] = {}

    def words(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.find(text)
        out = []
        for piece in self.split(text):
            out.extend([piece] if piece in self.special else self.find(piece))
        return out

    def encode(self, texts: list[str]) -> Iterator[list[tuple[int, list[int] | str, bytes]]]:
        """Per text, what the cache holds of each of its words."""
        split = [self.words(t) for t in texts]
        known = self.cache
        new = list({w for ws in split for w in ws}.difference(known))
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list({w for ws in split for w in ws})
        table = self.v["bytes"]
        for w, ids in zip(new, encode_words([w.encode() for w in new], self.v)):
            if w in self.special:
                ids = [self.special[w]]
            known[w] = len(ids), ",".join(map(str, ids)) if self.digests else ids, b"".join([table[i] for i in ids])
        for ws in split:
            yield [known[w] for w in ws]


def ids_of(words: list[tuple]) -> list[int]:
    return [i for w in words for i in w[1]]


def decoded(words: list[tuple]) -> str:
    """The text of the tokens: their bytes joined, read as UTF-8."""
    return b"".join([w[2] for w in words]).decode("utf-8", errors="replace")


def _stretches(texts: pa.Array) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if some and size + len(t) > STRETCH:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, digests: bool = False,
        carry: bool = False) -> DataFrame:
    """Encode and decode: ``doc_id``, ``n_tokens``, and ``ids`` (array of int) with
    ``decoded`` or, with ``digests``, ``ids_sha256, decoded_sha256`` (the ids as
    decimal numbers joined by commas)."""
    tables = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # fixed size: the vocabulary
    rows = with_row(docs, carry, doc_id=F.col(id_col), text=F.col(text_col))
    keep = [f for f in rows.schema.fields if f.name != "text"]
    made = [("n_tokens", T.LongType())] + (
        [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests
        else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())])
    schema = T.StructType(keep + [T.StructField(n, t) for n, t in made])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process keeps its cache of words from task to task
        codec = tables.value.setdefault("codec", None) or Codec(tables.value, digests)
        tables.value["codec"] = codec
        for batch in batches:
            first = 0
            for texts in _stretches(batch["text"]):
                cols: list[list] = [[] for _ in made]
                for words in codec.encode(texts):
                    text = decoded(words)
                    cols[0].append(sum([w[0] for w in words]))
                    cols[1].append(hashlib.sha256(",".join([w[1] for w in words]).encode()).hexdigest() if digests else ids_of(words))
                    cols[2].append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
                types = [pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string()]
                part = batch.slice(first, len(texts))
                first += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [part[f.name] for f in keep] + [pa.array(c, t) for c, t in zip(cols, types)],
                    names=[f.name for f in schema.fields])

    return rows.mapInArrow(work, schema)
