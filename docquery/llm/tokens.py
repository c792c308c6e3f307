"""Token ids of whole texts with a byte-level BPE of the tokenizers library, which sees each distinct word of a group of texts once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docquery.llm import common

#: Bytes of text that share a dictionary of words, and bytes that the tokenizer sees in one call.
GROUP = 1 << 24
CALL = 1 << 18
#: Words whose ids are laid out at once, and bytes in which spaces are looked for at once.
WORDS = 1 << 17
WINDOW = 1 << 19
#: Words of earlier groups whose ids a worker keeps at most, and the longest of them in bytes.
KNOWN = 1 << 18
KNOWN_BYTES = 48

_SPACE = 0x20
_ASCII_WHITE = common.byte_class([(0x09, 0x0D), (0x1C, 0x20)])
# The white-space characters beyond ASCII, in UTF-8.
_WIDE_WHITE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def default_path() -> str:
    """The vocabulary's place; the package that carries it is found at run time."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _white(data: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """Whether the character that ends before each place (or that begins there) is white space; places inside data."""
    near = data[at - 1] if before else data[at]
    out = _ASCII_WHITE[near]
    wide = np.flatnonzero(near >= 0x80)
    for white in _WIDE_WHITE:
        first = at[wide] - len(white) if before else at[wide]
        ok = (first >= 0) & (first + len(white) <= len(data))
        for j, byte in enumerate(white):
            ok[ok] = data[first[ok] + j] == byte
        out[wide[ok]] = True
    return out


def safe_cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places of the spaces between two characters of a row that are not white space: there its ids may be taken apart."""
    found = [np.zeros(0, np.int32)]
    for low in range(0, len(data), WINDOW):
        at = np.flatnonzero(data[low : low + WINDOW] == _SPACE) + low
        near = np.searchsorted(edges, at)  # the first edge at or after the space
        near = edges[np.minimum(near, len(edges) - 1)]
        at = at[(near != at) & (near != at + 1) & (at > 0) & (at + 1 < len(data))]
        at = at[~_white(data, at, True)]
        found.append(at[~_white(data, at + 1, False)].astype(np.int32))
    return np.concatenate(found)


class TextEncoder:
    """Ids are the tokenizer's own result for each whole text, as unsigned 32-bit integers.

    The tokenizer never joins bytes across a space between two characters that are not white space, so a text is a
    row of words that begin with such a space. Each distinct word of a group of texts is encoded once, many in one
    call: the ids fall to the words by the number of bytes that each id stands for. Words that begin or end otherwise
    (the first of a text, or with white space at its end) and those with a special token's string go alone. A word's ids
    depend on its bytes alone, so up to `known` words keep theirs for the groups that follow; where there would be more,
    those stay that were met again since the last time.
    """

    def __init__(self, path: str, group: int = GROUP, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer, self.group, self.known = Tokenizer.from_file(path), group, known
        self.words, self.met = pa.array([], pa.binary()), np.zeros(0, bool)
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # byte-level: a letter for each byte

    def whole(self, text: str) -> np.ndarray:
        return self._calls([text])[0]

    def _calls(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each of the distinct words has its own and how many."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.words) + np.arange(len(new))
        self.met[at[at < len(self.words)]] = True
        fresh = words.take(pa.array(new))
        ids, counts = self._encoded(fresh) if len(new) else (self.ids[:0], self.counts[:0])
        ids, counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        starts = np.cumsum(counts, dtype=np.int64) - counts
        self._keep(fresh, ids, starts, counts)
        return ids, starts[at], counts[at]

    def _keep(self, fresh: pa.Array, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Of the known words and then the fresh ones, whose ids are given, keep what later groups may look up."""
        n = len(self.words)
        short = np.flatnonzero(pc.less_equal(pc.binary_length(fresh), KNOWN_BYTES).to_numpy(zero_copy_only=False))[: self.known]
        if n + len(short) > self.known:
            old = np.flatnonzero(self.met)[: self.known - len(short)]
            self.words, self.ids, self.counts = self.words.take(pa.array(old)), ids[_spread(starts[old], counts[old])], counts[old]
            self.met = np.zeros(len(old), bool)
        which = n + short
        self.words = pa.concat_arrays([self.words, fresh.take(pa.array(short))])
        self.met = np.concatenate([self.met, np.zeros(len(short), bool)])
        self.ids, self.counts = np.concatenate([self.ids, ids[_spread(starts[which], counts[which])]]), np.concatenate([self.counts, counts[which]])

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words laid end to end, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        begin, end = offsets[:-1], offsets[1:]
        alone = (data[begin] != _SPACE) | (end - begin < 2) | _white(data, end, True)
        longer = np.flatnonzero(~alone)
        alone[longer] = _white(data, begin[longer] + 1, False)
        for mark in self.special:
            alone |= pc.match_substring(words.view(pa.string()), mark).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(words), np.int32)
        order, found = [], []
        which = np.flatnonzero(~alone)
        sizes = (end - begin)[which]
        total = np.cumsum(sizes)
        low = 0
        while low < len(which):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + CALL, side="right")))
            part = words.take(pa.array(which[low:high]))
            (ids,) = self._calls([np.frombuffer(part.buffers()[2], np.uint8).tobytes().decode()])
            ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum(sizes[low:high])
            at = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[np.minimum(at, len(ends) - 1)], wanted):
                raise ValueError("an id of the tokenizer crosses two words")
            counts[which[low:high]] = np.diff(at, prepend=-1)
            order.append(which[low:high])
            found.append(ids)
            low = high
        single = np.flatnonzero(alone)
        for low in range(0, len(single), 1024):
            part = single[low : low + 1024]
            got = self._calls([x.decode() for x in words.take(pa.array(part)).to_pylist()])
            counts[part] = [len(x) for x in got]
            order.append(part)
            found += got
        # the ids were found in another order than the words'
        order, ids = np.concatenate(order), np.concatenate(found)
        placed = np.empty(len(ids), np.uint32)
        before = np.cumsum(counts, dtype=np.int64) - counts
        placed[_spread(before[order], counts[order])] = ids
        return placed, counts

    def _segment(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of the rows of a group in parts, and the number of ids of each row."""
        rows = offsets[:-1][np.diff(offsets) > 0].astype(np.int32)
        cuts = np.sort(np.concatenate([safe_cuts(data, offsets), rows]), kind="stable")
        if not len(cuts):
            return [], np.zeros(len(offsets) - 1, np.int64)
        words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int32, copy=False)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        ids, starts, counts = self._word_ids(coded.dictionary)
        which = coded.indices.to_numpy()
        before = np.concatenate([[0], np.cumsum(counts[which], dtype=np.int64)])
        per_row = np.diff(before[np.searchsorted(cuts, offsets)])
        return [ids[_spread(starts[w], counts[w])] for w in (which[low : low + WORDS] for low in range(0, len(which), WORDS))], per_row

    def _groups(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """First row, last row + 1, start and stop of parts of about `group` bytes; a longer row is cut at safe spaces."""
        low, n = 0, len(offsets) - 1
        while low < n:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + self.group, side="right")) - 1)
            start, stop = int(offsets[low]), int(offsets[high])
            while stop - start > self.group:
                cut, at = stop, start + self.group
                while cut == stop and at < stop:
                    near = data[at - 1 : min(stop, at + CALL)]
                    if len(found := safe_cuts(near, np.array([0, len(near)]))):
                        cut = at - 1 + int(found[0])
                    at += len(near) - 1 if len(near) > 4 else len(near)
                yield low, high, start, cut
                start = cut
            if start < stop or low == high - 1:
                yield low, high, start, stop
            low = high

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column laid end to end, and how many each row has. Null: none."""
        data, offsets = common.text_buffer(texts)
        found, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for low, high, start, stop in self._groups(data, offsets):
            ids, per_row = self._segment(data[start:stop], np.clip(offsets[low : high + 1] - start, 0, stop - start))
            found += ids
            counts[low:high] += per_row
        return np.concatenate(found), counts

    def encode_closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_column, with the end id after each row."""
        ids, counts = self.encode_column(texts)
        counts += 1
        out = np.full(len(ids) + len(counts), end_id, np.uint32)
        own = np.ones(len(out), bool)
        own[np.cumsum(counts) - 1] = False
        out[own] = ids
        return out, counts

    def encode(self, text: str | None) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] places, and so on."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
