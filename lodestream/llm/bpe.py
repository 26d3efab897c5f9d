"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over CONTEXT bytes cuts texts into chunks, at places that depend on the content alone. Each distinct
chunk is encoded once, as a text of its own, for all documents that a task reads, and kept in a cache of bounded size.

A chunk's ids are right but near its ends, where the neighbouring chunk may change them. So each join is encoded anew,
with REACH parts of both chunks around it, and the result must agree exactly with the chunks' own ids in its first and
last part; where it does not, the window is doubled and encoded again, over further chunks if need be, up to the whole
text. Windows begin and end at sure splits only: places where the pre-tokenizer ends a token whatever comes before or
after, so that what agrees there stays as it is.

Sure splits lie before a single space, and around one or two line ends, between characters that are no white space, and
before an ASCII mark that follows a Latin letter. What lies between two of them is a part; a worker encodes each
distinct part once. Texts without spaces (Chinese, say) have few sure splits: their windows grow to the whole text.
That no token of a tokenizer goes over a sure split is checked on a set of texts when it is loaded; where the check
fails, whole texts are encoded.

Null texts count as empty, and empty texts have no ids. Repeated rows are encoded alike; other columns are not read.
Chunks are kept for a task and parts for a Python worker, which serves many tasks; a lost executor loses only time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.common import documents, powers, prefix_hash, rows, utf8

CONTEXT, CHUNK_BITS, REACH = 16, 10, 2
CACHE_BYTES = 24_000_000
#: So many parts of up to PART_BYTES bytes are kept; longer ones are encoded whenever they occur.
CACHE_PARTS, PART_BYTES = 1_000_000, 64
STRETCH = 1 << 21
_encoders: dict[str, Encoder] = {}


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


_BLANK = _bytes((9, 13), (28, 32))
_WIDE = _bytes((0xC2, 0xC2), (0xE1, 0xE3))
_LETTER = _bytes((65, 90), (97, 122))
#: ASCII marks but the apostrophe, which begins a token of its own with some letters.
_MARK = _bytes((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))
#: Texts on which sure splits are tried when a tokenizer is loaded.
_TRIED = ["don't stop, it's\nover\n\nthere", "naïve: ́x ÀB. a1, 2b;3", "x é́ ́y 'll 's\n't", "ab!!\ncd$$ ef%% (gh) [ij]", "été,ß. 漢字 かな ك ل\nд, ж", "a b c 1 2 3 \x01 😀 😀!"]


def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.no_truncation()
    made.no_padding()
    return made


def found(data: bytes, wanted: list[bytes]) -> list[tuple[int, int]]:
    """Where the wanted strings lie."""
    out = []
    for x in wanted:
        at = data.find(x)
        while at >= 0:
            out.append((at, at + len(x)))
            at = data.find(x, at + 1)
    return out


def outside(places: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The places, in order, that lie within none of the spans."""
    for a, b in spans:
        places = np.delete(places, slice(np.searchsorted(places, a, "right"), np.searchsorted(places, b, "left")))
    return places


def sure_splits(data: np.ndarray, edges: np.ndarray, special: list[tuple[int, int]]) -> np.ndarray:
    """The sure splits of the texts between the edges, each seen on its own, by a tokenizer with special tokens at these spans."""
    n = len(data)
    if n < 3:
        return np.empty(0, np.int64)
    blank = _BLANK[data]
    wide = np.flatnonzero(_WIDE[data])
    if len(wide):
        first, second = data[wide], data[np.minimum(wide + 1, n - 1)]
        two = wide[(first == 0xC2) & ((second == 0x85) | (second == 0xA0))]
        three = wide[((first == 0xE1) & (second == 0x9A)) | ((first == 0xE2) & (second <= 0x81)) | ((first == 0xE3) & (second == 0x80))]
        for at, size in ((two, 2), (three, 3)):
            for j in range(size):
                blank[np.minimum(at + j, n - 1)] = True
    # A text ends before a special token and another begins after it.
    for a, b in special:
        blank[[a, b - 1]] = True
    edges = np.unique(edges)
    last, first = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    last[edges[1:] - 1] = first[edges[:-1]] = True
    space = np.flatnonzero(data[1:-1] == 32) + 1
    space = space[~blank[space - 1] & ~blank[space + 1] & ~last[space]]
    line = np.flatnonzero(data[1:-1] == 10) + 1
    line = line[~blank[line - 1] & ~first[line] & ~last[line]]
    one = line[~blank[line + 1]]
    two = line[(data[line + 1] == 10) & (line + 2 < n)]
    two = two[~blank[np.minimum(two + 2, n - 1)] & ~last[two + 1]]
    mark = np.flatnonzero(_MARK[data[1:]]) + 1
    before, lead = data[mark - 1], data[mark - 2]
    # Not the two signs among these letters, nor the one whose lower case ends in a mark.
    other = ((lead == 0xC3) & ((before == 0x97) | (before == 0xB7))) | ((lead == 0xC4) & (before == 0xB0))
    latin = (before >= 0x80) & (before <= 0xBF) & (lead >= 0xC3) & (lead <= 0xC9) & ~other
    mark = mark[_LETTER[before] | latin]
    return outside(np.sort(np.concatenate([space, one, one + 1, two, two + 1, two + 2, mark])), special)


class Encoder:
    """Encodes texts by their parts, and keeps the ids of parts."""

    def __init__(self, name: str) -> None:
        self.model = tokenizer(name)
        self.special = [x.content.encode() for x in self.model.get_added_tokens_decoder().values()]
        self.clear()
        self.by_parts = True
        held = np.frombuffer("".join(_TRIED).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in _TRIED)])
        _, ends, ids = self.encode(*held)
        self.by_parts = [x.ids for x in self.model.encode_batch(_TRIED, add_special_tokens=False)] == [x.tolist() for x in np.split(ids, ends[1:-1])]
        self.pieces = self._pieces()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.count, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.ids, self.n_ids = np.zeros(1 << 14, np.uint32), 0

    def _pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The bytes of each id, where they begin and how many they are; None unless they give what the library decodes."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        size = self.model.get_vocab_size()
        tokens = [self.model.id_to_token(i) for i in range(size)]
        if any(t is None or not all(c in byte for c in t) for t in tokens):
            return None
        each = [bytes(byte[c] for c in t) for t in tokens]
        if self.model.decode_batch([[i] for i in range(size)], skip_special_tokens=False) != [x.decode("utf-8", "replace") for x in each]:
            return None
        count = np.array([len(x) for x in each], np.int64)
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(count) - count, count

    def parts(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bounds of the parts of the texts between the edges, where each part's ids begin and the last end, and the ids."""
        at = np.zeros(len(data) + 1, bool)
        at[edges] = True
        if self.by_parts:
            at[sure_splits(data, edges, found(data.tobytes(), self.special))] = True
        bounds = np.flatnonzero(at)
        if len(bounds) < 2:
            return bounds[:1], np.zeros(1, np.int64), np.empty(0, np.uint32)
        each = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        kinds = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.n > CACHE_PARTS or self.n_ids > 8 * CACHE_PARTS:
            self.clear()
        at = np.fromiter((self.known.get(x, -1) for x in kinds), np.int64, len(kinds))
        new = np.flatnonzero(at < 0)
        at[new] = np.arange(self.n, self.n + len(new))
        for k in range(0, len(new), 4096):
            self._add([kinds[i] for i in new[k : k + 4096].tolist()])
        place = at[each.indices.to_numpy()]
        count = self.count[place]
        ends = np.concatenate([[0], np.cumsum(count)])
        return bounds, ends, self.ids[np.repeat(self.start[place] - ends[:-1], count) + np.arange(ends[-1])]

    def _add(self, texts: list[str]) -> None:
        ids, count = self._encoded(texts)
        n, n_ids = self.n + len(texts), self.n_ids + len(ids)
        while n > len(self.start):
            self.start, self.count = np.concatenate([self.start, self.start]), np.concatenate([self.count, self.count])
        while n_ids > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.start[self.n : n], self.count[self.n : n] = self.n_ids + np.cumsum(count) - count, count
        self.ids[self.n_ids : n_ids] = ids
        self.known.update((x, self.n + i) for i, x in enumerate(texts) if len(x) <= PART_BYTES)
        self.n, self.n_ids = n, n_ids

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has. A special token parts them, as it does within a text, which saves a call for each."""
        if self.special:
            mark = self.special[-1].decode()
            ids = np.array(self.model.encode_batch_fast([mark.join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.model.token_to_id(mark))
            if len(ends) == len(texts) - 1:  # else one of them holds the mark
                return np.delete(ids, ends), np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
        each = [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges, where the ids of each text between them begin and the last end, and the ids."""
        bounds, ends, ids = self.parts(data, edges)
        return edges, ends[np.searchsorted(bounds, edges)], ids

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """What the library decodes from the ids between the ends."""
        if self.pieces is None:
            return self.model.decode_batch([x.tolist() for x in np.split(ids, ends[1:-1])], skip_special_tokens=False)
        flat, start, count = self.pieces
        count = count[ids]
        upto = np.concatenate([[0], np.cumsum(count)])
        data = flat[np.repeat(start[ids] - upto[:-1], count) + np.arange(upto[-1])].tobytes()
        at = upto[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def encoder(name: str) -> Encoder:
    """This worker's encoder of a tokenizer."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def cuts(data: np.ndarray, edges: np.ndarray, special: list[bytes]) -> np.ndarray:
    """The edges and the places, set by the CONTEXT bytes before them, at which texts are cut; none lies within a character or a special token."""
    own = []
    for at in range(0, max(0, len(data) - CONTEXT), STRETCH):
        part = data[at : at + STRETCH + CONTEXT - 1]
        total, inverse = prefix_hash(part), powers(len(part))[1]
        h = (total[CONTEXT:] - total[:-CONTEXT]) * inverse[: len(part) - CONTEXT + 1] * np.uint64(0x9E3779B97F4A7C15)
        own.append(np.flatnonzero(h >> np.uint64(64 - CHUNK_BITS) == 0) + at + CONTEXT)
    place = np.concatenate(own) if own else np.empty(0, np.int64)
    place = place[place < len(data)]
    begin = edges[np.searchsorted(edges, place, "right") - 1]
    place = place[place - begin >= CONTEXT]
    for _ in range(3):
        place = place + ((place < len(data)) & (data[np.minimum(place, len(data) - 1)] & 0xC0 == 0x80))
    return np.unique(np.concatenate([edges, outside(np.unique(place), found(data.tobytes(), special))]))


class Chunk:
    """A chunk's ids, and where each of its parts ends in its bytes and in its ids."""

    def __init__(self, bounds: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        self.at, self.ends, self.ids = bounds, ends, ids
        self.n = len(bounds) - 1

    def of_part(self, k: int) -> list[int]:
        return self.ids[self.ends[k] : self.ends[k + 1]].tolist()


def windows(chunks: list[Chunk], reach: list[int]) -> list[list[int]]:
    """For the joins between chunks: from part i of chunk a to before part j of chunk b, as [a, i, b, j], none overlapping."""
    out, top = [], len(chunks) - 1
    for k in range(1, len(chunks)):
        a, i, b, j = k - 1, chunks[k - 1].n - reach[k], k, reach[k]
        while i <= 0 and a > 0:
            a -= 1
            i = chunks[a].n - reach[k]
        while j >= chunks[b].n and b < top:
            b, j = b + 1, reach[k]
        i, j = max(i, 0), min(j, chunks[b].n)
        if out and (a, i) < (out[-1][2], out[-1][3]):
            out[-1] = [*min(out[-1][:2], [a, i]), *max(out[-1][2:], [b, j])]
        else:
            out.append([a, i, b, j])
    return out


def repaired(texts: list[tuple[bytes, list[Chunk]]], encode: Callable[[list[str]], list[list[int]]]) -> list[np.ndarray]:
    """The ids of texts, given as their bytes and chunks: joins are encoded anew until both sides agree."""
    done: list[np.ndarray | None] = [c[0].ids if len(c) == 1 else np.empty(0, np.uint32) if not c else None for _, c in texts]
    reach = {t: [REACH] * len(c) for t, (_, c) in enumerate(texts) if len(c) > 1}
    while reach:
        asked = []
        for t, r in reach.items():
            data, chunks = texts[t]
            start = np.concatenate([[0], np.cumsum([c.at[-1] for c in chunks])])
            asked += [(t, w, data[start[w[0]] + chunks[w[0]].at[w[1]] : start[w[2]] + chunks[w[2]].at[w[3]]]) for w in windows(chunks, r)]
        made: dict[int, list] = {}
        wider: set[int] = set()
        for (t, (a, i, b, j), _), ids in zip(asked, encode([x.decode() for _, _, x in asked])):
            chunks = texts[t][1]
            whole_left, whole_right = (a, i) == (0, 0), (b, j) == (len(chunks) - 1, chunks[-1].n)
            head = [] if whole_left else chunks[a].of_part(i)
            tail = [] if whole_right else chunks[b].of_part(j - 1)
            if ids[: len(head)] != head or ids[len(ids) - len(tail) :] != tail or len(ids) < len(head) + len(tail):
                wider.add(t)
                for k in range(a + 1, b + 1):
                    reach[t][k] *= 2
                continue
            made.setdefault(t, []).append((a, i, b, j, ids[len(head) : len(ids) - len(tail)], whole_left, whole_right))
        for t in [t for t in reach if t not in wider]:
            chunks, out, held, upto = texts[t][1], [], 0, 0
            for a, i, b, j, ids, whole_left, whole_right in made[t]:
                # A chunk between two windows is the last of the one before and the first of the next.
                for k in range(held, a):
                    out.append(chunks[k].ids[upto:])
                    upto = 0
                if not whole_left:
                    out.append(chunks[a].ids[upto : chunks[a].ends[i + 1]])
                out.append(np.array(ids, np.uint32))
                held, upto = b, chunks[b].ends[-1] if whole_right else chunks[b].ends[j - 1]
            out.append(chunks[held].ids[upto:])
            done[t] = np.concatenate([*out, *(c.ids for c in chunks[held + 1 :])])
            del reach[t]
    return done


def encoded(data: np.ndarray, edges: np.ndarray, enc: Encoder, cache: dict[bytes, Chunk]) -> list[np.ndarray]:
    """The ids of each text between the edges; cache holds the chunks met so far."""
    bounds = cuts(data, edges, enc.special)
    if len(bounds) < 2:
        return [np.empty(0, np.uint32)] * (len(edges) - 1)
    each = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    kinds = each.dictionary.to_numpy(zero_copy_only=False).tolist()
    new = [x for x in kinds if x not in cache]
    if new:
        ends = np.cumsum([0, *map(len, new)])
        at, tokens, ids = enc.parts(np.frombuffer(b"".join(new), np.uint8), ends)
        of = np.searchsorted(at, ends).tolist()
        for x, a, b in zip(new, of, of[1:]):
            cache[x] = Chunk(at[a : b + 1] - at[a], tokens[a : b + 1] - tokens[a], ids[tokens[a] : tokens[b]].copy())
    chunks = [cache[x] for x in kinds]
    order = each.indices.to_pylist()
    of, whole, at = np.searchsorted(bounds, edges).tolist(), data.tobytes(), edges.tolist()
    texts = [(whole[s:e], [chunks[k] for k in order[a:b]]) for s, e, a, b in zip(at, at[1:], of, of[1:])]
    return repaired(texts, lambda asked: [x.ids for x in enc.model.encode_batch_fast(asked, add_special_tokens=False)])


def _encoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cache = encoder(name), {}
        for b in rows(batches):
            ids = encoded(*utf8(b), enc, cache)
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.empty(0, np.uint32), *ids])
            decoded = enc.decode(flat, ends)
            hashes = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), lists, pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"],
            )
            if sum(map(len, cache)) > CACHE_BYTES:
                cache.clear()

    return run


def encode(docs: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded, decoded_sha256) for each row of docs."""
    return docs.select("doc_id", "text").mapInArrow(_encoded(name), "doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string")


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
