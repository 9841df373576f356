"""Token ids of whole texts by a file of the tokenizers library, a run of bytes at a time.

The vocabulary's pattern cuts a text into runs of letters, single digits and runs of other signs, and each run is encoded
for itself. So a run met before need not be encoded again: runs are found and fingerprinted with numpy, a direct-mapped
cache of bounded size gives the ids of known ones, and the library encodes the rest. A word with anything but ASCII and
the letters of U+00C0..U+00FF, or with an apostrophe or control sign, goes whole through the file's own normaliser and
pattern. Equality with ``encode`` of the whole text is tested.
"""

from __future__ import annotations

import json
import os

import numpy as np

from codeloom.llm.blocks import CHUNK, U64, _WHITE, chunks, runs, spans_hash

SLOTS = 1 << 21
MOST_IDS = 24_000_000
_LETTER, _DIGIT, _SIGN, _SPACE, _OTHER = 1, 2, 3, 0, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[_WHITE] = _SPACE
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("A") : ord("Z") + 1] = _LETTER
_KIND[ord("'")] = _OTHER
_PLAIN = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Encoder:
    """Encodes documents of a batch; keeps ids of runs between calls."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # the cut into runs holds for this family of files only; others are encoded text by text
        cut = json.dumps(spec.get("pre_tokenizer") or {})
        self.by_run = model.get("end_of_word_suffix") == "</w>" and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in cut
        self.specials = [t["content"].encode() for t in spec.get("added_tokens") or []]
        if self.by_run:
            spec |= {"normalizer": None, "pre_tokenizer": _PLAIN, "added_tokens": []}
            self.run = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(max(model["vocab"].values()) + 2 + len(self.specials), bool)
            for k, v in model["vocab"].items():
                self.ends[v] = k.endswith("</w>")
            self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(SLOTS, U64)
        self.first = np.zeros(SLOTS, np.int32)
        self.count = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def store(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        at = self.used
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one after the other and the number of ids of each document."""
        if not self.by_run:
            texts = [buf[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
            got = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(g) for g in got], np.int64)
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i, j in chunks(offsets, CHUNK):
            a = offsets[i]
            ids, n = self._chunk(buf[a : offsets[j]], offsets[i : j + 1] - a)
            parts.append(ids)
            counts.append(n)
        return np.concatenate(parts), np.concatenate(counts)

    def _chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        kind = _KIND[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        tail = buf[lead + 1]
        lead = lead[(tail != 0x97) & (tail != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        new = np.empty(len(buf), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == _DIGIT
        inner = offsets[1:-1]
        new[inner[inner < len(buf)]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(buf))
        odd = np.flatnonzero(kind == _OTHER)
        for s in self.specials:
            if len(buf) >= len(s) and (at := buf.tobytes().find(s)) >= 0:
                raw = buf.tobytes()
                while at >= 0:
                    odd = np.append(odd, at)
                    at = raw.find(s, at + 1)
        ink = kind[starts] != _SPACE
        slow: list[tuple[int, int]] = []
        if len(odd):
            # the words around odd bytes: from the white space or document start before to the one after
            edges = np.union1d(np.flatnonzero(kind == _SPACE), offsets)
            spaces = kind == _SPACE
            odd = np.sort(odd)
            right = np.searchsorted(edges, odd, "right")
            lo, hi = edges[right - 1], np.append(edges, len(buf))[right]
            lo = np.where((lo < len(buf)) & spaces[np.minimum(lo, len(buf) - 1)], lo + 1, lo)
            pairs = np.unique(np.stack([lo, hi], 1), axis=0)
            slow = [(int(x), int(y)) for x, y in pairs]
            inside = np.zeros(len(buf) + 1, np.int32)
            np.add.at(inside, pairs[:, 0], 1)
            np.add.at(inside, pairs[:, 1], -1)
            ink &= np.cumsum(inside)[starts] == 0
        starts, ends = starts[ink], ends[ink]
        h = spans_hash(buf, starts, ends, fold=False) if len(starts) else np.zeros(0, U64)
        first, count = self._lookup(buf, starts, ends, h)
        if slow:
            at, n = zip(*(self._word(buf[x:y].tobytes()) for x, y in slow))
            starts = np.concatenate([starts, np.array([x for x, _ in slow])])
            order = np.argsort(starts, kind="stable")
            starts = starts[order]
            first, count = np.concatenate([first, at])[order], np.concatenate([count, n])[order]
        index = np.repeat(first, count) + runs(count)
        per_doc = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offsets, "left")]
        ids = self.ids[index]
        if self.used > MOST_IDS:
            self.reset()
        return ids, np.diff(per_doc)

    def _word(self, raw: bytes) -> tuple[int, int]:
        ids = self.whole.encode(raw.decode(), add_special_tokens=False).ids
        return self.store(np.array(ids, np.uint32)), len(ids)

    def _lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (h & U64(SLOTS - 1)).astype(np.int64)
        first, count = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)
        miss = np.flatnonzero((self.keys[slot] != h) | (count == 0))
        if len(miss):
            keys, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[at]
            raw = buf.tobytes()
            texts = [raw[a:b].decode().lower() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            got = self.run.encode_batch_fast([" ".join(texts[k : k + 512]) for k in range(0, len(texts), 512)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
            stop = np.flatnonzero(self.ends[ids]) + 1
            assert len(stop) == len(keys), "a run is one word of the model"
            begin = np.concatenate([[0], stop[:-1]])
            base = self.store(ids)
            first[miss], count[miss] = (begin + base)[back], (stop - begin)[back]
            slots = (keys & U64(SLOTS - 1)).astype(np.int64)
            self.keys[slots], self.first[slots], self.count[slots] = keys, begin + base, stop - begin
        return first, count


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
