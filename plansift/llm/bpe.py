"""Byte-level BPE by a segment tree over byte positions.

Each leaf holds the rank of the pair that begins at its byte, each inner node the least of its two, ties to the left; the root is
the leftmost pair of the least rank. A merge changes three leaves at most (the pair, the swallowed byte, the live neighbour before
it), each a logarithmic update. Trees of pieces of like size are worked on together, as rows of one numpy array.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1) << np.int64(62)
#: Cells of one array of trees.
CELLS = 1 << 20
#: Longer pieces (in bytes), and those with fewer of their like, are merged one by one.
TOGETHER, FEW = 64, 48
#: Half the bytes that a Python worker's memory of words takes: the older half goes when the newer one is full.
REMEMBERED = 80 << 20
#: Bytes of text that are encoded and decoded at a time: decoding takes some 20 bytes of memory for each.
PORTION = 2 << 20
#: Words of more characters aren't remembered, and what an entry takes besides its key and ids.
LONGEST, ENTRY = 64, 180
_WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Two white-space characters together, or one at an end: such texts aren't cut at their spaces.
LOOSE = rf"\A\z|{_WHITE}{{2}}|\A{_WHITE}|{_WHITE}\z"


class Ranks:
    """A rank file: token bytes by id, and the rank of each pair of tokens that merge."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = {i: token for token, i in self.ids.items()}
        tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_bytes, self.token_sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pattern = regex.compile(pattern)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], dtype=np.int64)
        self.rank_of = pairs
        # two bytes that no token has side by side are never merged over: a piece falls apart there
        inside = np.ones(len(self.token_bytes), bool)
        inside[np.cumsum(self.token_sizes)[self.token_sizes > 0] - 1] = False
        self.together = np.zeros(1 << 16, bool)
        at = np.flatnonzero(inside[:-1])
        self.together[self.token_bytes[at].astype(np.int64) << 8 | self.token_bytes[at + 1]] = True

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the two don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (whole := self.ids.get(piece)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif piece:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for size, ks in by_size.items():
            if size > TOGETHER or len(ks) < FEW:
                for k in ks:
                    out[k] = self._long(pieces[k])
                continue
            step = max(1, CELLS // size)
            for at in range(0, len(ks), step):
                part = ks[at : at + step]
                for k, ids in zip(part, self._trees([pieces[k] for k in part], size), strict=True):
                    out[k] = ids
        return out

    def _long(self, piece: bytes) -> bytes:
        """The ids of one piece, part by part: it is cut between bytes that no token holds side by side."""
        data = np.frombuffer(piece, np.uint8)
        cuts = np.flatnonzero(~self.together[data[:-1].astype(np.int64) << 8 | data[1:]]) + 1
        known: dict[bytes, bytes] = {}
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)], strict=True):
            part = piece[a:b]
            if part not in known:
                known[part] = self._tree(part)
            out.append(known[part])
        return b"".join(out)

    def _tree(self, piece: bytes) -> bytes:
        """The ids of one piece by its own segment tree: about 40 bytes of memory for each of its bytes."""
        n = len(piece)
        if n < 2:
            return self.bytes[list(piece)].astype("<u4").tobytes()
        size = 1 << (n - 1).bit_length()
        token = self.bytes[np.frombuffer(piece, np.uint8)]
        leaves = np.full(size, NONE)
        found = self.pair(token[:-1], token[1:])
        leaves[: n - 1] = np.where(found < NONE, found * size + np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("q", np.concatenate([np.zeros(1, np.int64), *levels[::-1]]).tobytes())
        ids, after, before = array("q", token.tobytes()), array("l", range(1, n + 1)), array("l", range(-1, n - 1))
        rank_of, none, shift = self.rank_of, int(NONE), size.bit_length() - 1

        while (root := tree[1]) < none:
            at, rank = root & size - 1, root >> shift
            gone, left = after[at], before[at]
            then = after[gone]
            ids[at], ids[gone], after[at] = rank, -1, then
            a = b = at + size
            c = gone + size
            if then < n:
                before[then] = at
                found = rank_of.get(rank << 32 | ids[then])
                tree[b] = none if found is None else found << shift | at
            else:
                tree[b] = none
            tree[c] = none
            if left >= 0:
                found = rank_of.get(ids[left] << 32 | rank)
                a = left + size
                tree[a] = none if found is None else found << shift | left
            while a != c:  # up, until the three paths are one
                a, b, c = a >> 1, b >> 1, c >> 1
                x, y = tree[2 * a], tree[2 * a + 1]
                tree[a] = x if x < y else y
                if b != a:
                    x, y = tree[2 * b], tree[2 * b + 1]
                    tree[b] = x if x < y else y
                if c != b:
                    x, y = tree[2 * c], tree[2 * c + 1]
                    tree[c] = x if x < y else y
            least = tree[a]
            while a > 1:
                other = tree[a ^ 1]
                a >>= 1
                if other < least:
                    least = other
                if tree[a] == least:
                    break
                tree[a] = least
        left_over = np.frombuffer(ids, np.int64)
        return left_over[left_over >= 0].astype("<u4").tobytes()

    def _trees(self, pieces: list[bytes], size: int) -> list[bytes]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        column = np.arange(size)
        live = column < lengths[:, None]
        token = np.zeros((n, size + 1), np.int64)
        token[:, :size][live] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, size + 2), (n, size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
        tree = np.full((n, 2 * size), NONE, np.int64)
        pairs = column[: size - 1] < lengths[:, None] - 1
        found = self.pair(token[:, : size - 1][pairs], token[:, 1:size][pairs])
        tree[:, size : 2 * size - 1][pairs] = np.where(found < NONE, found * size + np.broadcast_to(column[: size - 1], pairs.shape)[pairs], NONE)
        width = size // 2
        while width:
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
            width //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], size)
            gone = after[rows, at]
            then = after[rows, gone]
            token[rows, at] = rank
            live[rows, gone] = False
            after[rows, at] = then
            before[rows, np.minimum(then, size)] = at
            self._put(tree, rows, gone, np.full(len(rows), NONE), size)
            ends = then >= lengths[rows]
            found = self.pair(rank, token[rows, np.minimum(then, size)])
            self._put(tree, rows, at, np.where(ends | (found == NONE), NONE, found * size + at), size)
            left = before[rows, at]
            some = left >= 0
            r, at, left = rows[some], at[some], left[some]
            found = self.pair(token[r, left], token[r, at])
            self._put(tree, r, left, np.where(found == NONE, NONE, found * size + left), size)
            rows = rows[tree[rows, 1] < NONE]
        ids = token[:, :size][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, size: int) -> None:
        at = at + size
        tree[rows, at] = value
        while size > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            size >>= 1

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after another, and how many each has."""
        return gather(self.token_bytes, self.token_sizes, ids)


class Words:
    """Ids of texts by way of their words, each encoded once.

    A single space or line feed between two other characters always begins a match of the pattern (the line feed is one by itself),
    so texts fall apart there; in a key, a line feed stands for itself and a space is left out.
    """

    def __init__(self, encode):
        """encode: from a list of strings to the ids of each, as little-endian unsigned 32-bit integers."""
        self.encode, self.known, self.older, self.size = encode, {}, {}, 0

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), and the places where each text's begin, with the end."""
        loose = pc.match_substring_regex(texts, LOOSE).to_numpy(zero_copy_only=False)
        if not loose.any():
            return self._cut(texts)
        ids, ends = self._cut(texts.filter(pa.array(~loose)))
        own = self.encode(texts.filter(pa.array(loose)).to_pylist())
        lengths = np.zeros(len(texts), np.int64)
        lengths[~loose], lengths[loose] = np.diff(ends), [len(x) // 4 for x in own]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out, is_loose = np.zeros(starts[-1], "<u4"), np.repeat(loose, lengths)
        out[~is_loose], out[is_loose] = ids, np.frombuffer(b"".join(own), "<u4")
        return out, starts

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.size > REMEMBERED:
            self.known, self.older, self.size = {}, self.known, 0
        # the \r\n marks the first word: no key of another kind begins so, as white space twice makes a text loose
        marked = pc.binary_join_element_wise("\r\n", pc.replace_substring(texts, "\n", " \n"), "")
        words = pc.split_pattern(marked, " ")
        each = words.flatten().dictionary_encode()
        keys = each.dictionary.to_pylist()
        known, older = self.known, self.older
        missing = [w for w in keys if w not in known]
        if older:
            again = [w for w in missing if w in older]
            known.update((w, older[w]) for w in again)
            self.size += sum(len(w) + len(older[w]) + ENTRY for w in again)
            missing = [w for w in missing if w not in older]
        known.update(zip(missing, self.encode([w[2:] if w[:2] == "\r\n" else w if w[:1] == "\n" else " " + w for w in missing]), strict=True))
        found = [known[w] for w in keys]
        self.size += ENTRY * len(missing)
        for w in missing:
            if len(w) > LONGEST:
                del known[w]
            else:
                self.size += len(w) + len(known[w])
        at = each.indices.to_numpy()
        ids, taken = gather(np.frombuffer(b"".join(found), "<u4"), np.fromiter((len(x) // 4 for x in found), np.int64, len(found)), at)
        return ids, np.concatenate([[0], np.cumsum(taken)])[words.offsets.to_numpy()]


def gather(values: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values (of the given lengths, one after another) that `at` names, one after another, and their lengths."""
    taken = lengths[at]
    starts = (np.cumsum(lengths) - lengths)[at] - (np.cumsum(taken) - taken)
    places = np.repeat(starts, taken)
    places += np.arange(len(places))
    return values[places], taken


_open: dict = {}


def ranks(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _open:
        _open[path, pattern] = Ranks(path, pattern)
    return _open[path, pattern]


def _by_ranks(path: str, pattern: str) -> Words:
    if ("words", path, pattern) not in _open:
        rank = ranks(path, pattern)

        def encode(strings: list[str]) -> list[bytes]:
            pieces = [[x.encode("utf-8", "replace") for x in rank.pattern.findall(s)] for s in strings]
            each = list({x for ps in pieces for x in ps})
            ids = dict(zip(each, rank.pieces(each), strict=True))
            return [b"".join([ids[x] for x in ps]) for ps in pieces]

        _open["words", path, pattern] = Words(encode)
    return _open["words", path, pattern]


def portions(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column 1, a string, has at most `size` bytes in a portion unless it is one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            till = int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right"))
            till = min(max(till, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, till - at)
            at = till


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array: the memory of values cut at the byte offsets `ends`."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every whole text and decodes the ids again: columns key, ids, decoded.

    ids: binary, little-endian unsigned 32-bit integers; decoded: binary, the bytes that the ids stand for. A null text counts as
    empty and has no ids. Rows and keys may repeat or be null: each row is encoded for itself. Other columns don't matter.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rank = _by_ranks(path, pattern), ranks(path, pattern)
        for part in portions(batches, size=PORTION):
            ids, starts = words.texts(part.column(1))
            data, sizes = rank.decode(ids)
            ends = np.concatenate([[0], np.cumsum(sizes)])[starts]
            yield pa.RecordBatch.from_arrays([part.column(0), binaries(ids, 4 * starts), binaries(data, ends)], [key, "ids", "decoded"])

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)
