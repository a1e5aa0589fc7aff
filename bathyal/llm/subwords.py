"""Subword ids of many texts by a public byte-level BPE vocabulary.

Ids depend only on pieces between safe cuts: before a space that a visible character follows, and after a single line
break between two visible characters. The vocabulary's own splitting pattern always ends a match there, so equal pieces
have equal ids wherever they stand. Pieces are hashed in numpy; only those that aren't in a cache of fixed size are encoded.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa

from .bytestext import slices, span_hashes

#: Entries of the cache, a power of two, and ids that it may hold before it is emptied.
CACHE_SLOTS, CACHE_IDS = 1 << 20, 8 << 20

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_AFTER_SPACE = _VISIBLE.copy()
_AFTER_SPACE[0xC3] = True  # the first byte of U+00C0 to U+00FF, none of which is white space


#: First bytes of white space beyond ASCII.
_OTHER_SPACE = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")


class Subwords:
    """Encodes Arrow string arrays; ids fit 16 bits."""

    def __init__(self, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_ids = max(ranks.values()) + 1
        #: Ids after which a sentence or a line ends.
        self.ends = np.zeros(65536, bool)
        self.ends[[i for b, i in ranks.items() if b.strip()[-1:] in (b".", b"!", b"?") or b"\n" in b]] = True
        #: Ids that begin with a space.
        self.begins = np.zeros(65536, bool)
        self.begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(CACHE_SLOTS, np.uint64)
        self.at, self.n = np.zeros(CACHE_SLOTS, np.int64), np.zeros(CACHE_SLOTS, np.int32)
        self.held, self.used = np.zeros(1 << 20, np.uint16), 0

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, front: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw, encode = data.tobytes(), self.encoding.encode_ordinary
        spans = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        if front == b" " and (found := self._encoded_words(spans)) is not None:
            return found
        lists = [encode((front + x).decode("utf-8", "replace")) for x in spans]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint16, int(lengths.sum())), lengths

    def _encoded_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """All words in one call, parted again where an id begins with a space. Words that might hold other white space, before
        which the vocabulary's pattern could cut elsewhere in a line, are encoded alone; None if parts and words don't match."""
        line = b"".join([b" " + w for w in words])
        odd = [i for i, w in enumerate(words) if any(x in w for x in _OTHER_SPACE)] if any(x in line for x in _OTHER_SPACE) else []
        if odd:
            alone = set(odd)
            line = b"".join([b" " + w for i, w in enumerate(words) if i not in alone])
        ids = np.array(self.encoding.encode_ordinary(line.decode("utf-8", "replace")), np.uint16)
        opens = np.flatnonzero(self.begins[ids])
        if len(opens) != len(words) - len(odd):
            return None
        lengths = np.diff(np.append(opens, len(ids)))
        if not odd:
            return ids, lengths
        rest = [self.encoding.encode_ordinary((b" " + words[i]).decode("utf-8", "replace")) for i in odd]
        plain = np.ones(len(words), bool)
        plain[odd] = False
        n = np.zeros(len(words), np.int64)
        n[plain], n[odd] = lengths, [len(x) for x in rest]
        out, own = np.zeros(int(n.sum()), np.uint16), np.repeat(plain, n)
        out[own], out[~own] = ids, [i for x in rest for i in x]
        return out, n

    def located(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, front: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Where in `held` each span's ids begin, with `front` put before the span, and how many there are."""
        slots = (hashes & np.uint64(CACHE_SLOTS - 1)).astype(np.int64)
        if self.used > CACHE_IDS:
            self._empty()
        missed = np.flatnonzero(self.keys[slots] != hashes)
        new_hashes, chosen = np.unique(hashes[missed], return_index=True)
        new = missed[chosen]
        ids, lengths = self._encoded(data, starts[new], ends[new], front)
        if self.used + len(ids) > len(self.held):
            self.held = np.concatenate([self.held[: self.used], np.zeros(max(len(ids), self.used) + 1, np.uint16)])
        self.held[self.used : self.used + len(ids)] = ids
        offsets = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        # two new spans may claim one slot, so this call's answers don't go through the cache
        at, n = self.at[slots], self.n[slots]
        place = np.searchsorted(new_hashes, hashes[missed])
        at[missed], n[missed] = offsets[place], lengths[place]
        self.keys[slots[new]], self.at[slots[new]], self.n[slots[new]] = new_hashes, offsets, lengths
        return at, n

    def encode(self, texts: pa.Array):
        """Yields, for some rows at a time, the first row, the end row, all their ids, and the bounds of each row's ids."""
        for part in slices(texts):
            data = part.data
            cut = np.zeros(len(data) + 1, bool)
            cut[part.starts] = True
            if len(data) > 1:
                spaced = (data[:-1] == 0x20) & _AFTER_SPACE[data[1:]]
                spaced[part.starts[(part.starts > 0) & (part.starts < len(data))] - 1] = False  # the last space of a text
                cut[:-2] |= spaced
                cut[2:-1] |= (data[1:-1] == 0x0A) & _VISIBLE[data[:-2]] & _VISIBLE[data[2:]]
            cut[-1] = False
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            at, n = self.located(data, starts, ends, span_hashes(data, starts, ends))
            total = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(n, out=total[1:])
            index = np.repeat(at - total[:-1], n)
            index += np.arange(len(index))
            yield part.first, part.last, self.held[index], total[np.searchsorted(starts, np.append(part.starts, len(data)))]


_subwords: dict[tuple, Subwords] = {}


def subwords(ranks_path: str | None = None, use: str = "texts") -> Subwords:
    """One encoder, with a cache of its own, for each worker process, vocabulary and use."""
    key = (ranks_path, use)
    if key not in _subwords:
        _subwords[key] = Subwords(ranks_path)
    return _subwords[key]


def multi_subwords() -> Subwords:
    """The vocabulary for many languages, for words with a space in front."""
    import public_tokenizers

    return subwords(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), use="words")
