"""Token ids of whole texts by a public tokenizer, with a cache of pieces per worker."""

from __future__ import annotations

import numpy as np

from litscore.llm.common import SLICE_BYTES, _powers, mix
from litscore.worker import worker_state

#: Distinct pieces whose ids a worker keeps; beyond that it starts anew.
CACHE_PIECES = 1_000_000
#: Pieces encoded as one text.
_JOINED = 128


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedTokenizer:
    """Ids of texts, equal to those of the tokenizers library for the whole text.

    Texts are cut where no token can span: at white space, for tokenizers that ignore it
    (``drop_space``), or else in front of a space that precedes anything but white space.
    All pieces of a slice are hashed by whole-array operations; the library encodes each
    distinct piece once, and the ids of a text are gathered from them. Only hashes and ids
    are kept. Special tokens in a text count as ordinary text, or with ``special`` as the
    library takes them by default, each as its one id.
    """

    def __init__(self, path: str, drop_space: bool = False, special: bool = False) -> None:
        from tokenizers import Tokenizer

        # it cuts at its special token, so that many pieces are encoded as one text
        self.joined = Tokenizer.from_file(path)
        self.joint = "<|endoftext|>"
        self.joint_id = self.joined.token_to_id(self.joint)
        self.path, self.plain = path, None
        self.drop_space, self.special = drop_space, special
        self.values = np.random.default_rng(4099).integers(1, 1 << 63, 256, np.uint64)
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        # white space beyond ASCII begins with one of these bytes; such pieces stay uncut
        self.joins = self.blank.copy()
        self.joins[[28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
        if drop_space:
            self.values[self.blank] = 0
        self.powers = _powers(1 << 10)
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # ascending
        self.number = np.zeros(0, np.int32)  # of the piece of each hash
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    @classmethod
    def of_worker(cls, path: str, drop_space: bool = False, special: bool = False) -> CachedTokenizer:
        kept = worker_state()
        key = ("tokenizer", path, drop_space, special)
        if key not in kept:
            kept[key] = cls(path, drop_space, special)
        return kept[key]

    def _starts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First bytes of the pieces of a slice."""
        first = ends[:-1][np.diff(ends) > 0]
        if self.drop_space:
            inside = ~self.blank[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            begins[first] = inside[first]
        else:
            begins = data == 32
            begins[:-1] &= ~self.joins[data[1:]]
            if self.special:  # a special token ends the white space in front of it
                begins[:-2] &= (data[1:-1] != ord("<")) | (data[2:] != ord("|"))
            begins[-1:] = False
            last = ends[1:][np.diff(ends) > 0] - 1
            begins[last] = False
            begins[first] = True
        return np.flatnonzero(begins)

    def _ids_alone(self, piece: str) -> list[int]:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
            self.plain.encode_special_tokens = not self.special
        return self.plain.encode(piece, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode and keep new pieces; their hashes ascend."""
        own = {i: self._ids_alone(p) for i, p in enumerate(pieces) if "<|" in p}
        for i in own:
            pieces[i] = ""
        texts = [self.joint.join(pieces[i : i + _JOINED]) for i in range(0, len(pieces), _JOINED)]
        found: list[int] = []
        for k, text in enumerate(self.joined.encode_batch_fast(texts, add_special_tokens=False)):
            if k:
                found.append(self.joint_id)
            found += text.ids
        ids = np.array(found, np.uint32)
        marks = np.append(np.flatnonzero(ids == self.joint_id), len(ids))
        sizes = np.diff(marks, prepend=-1) - 1
        ids = ids[ids != self.joint_id]
        if own:  # pieces that look like special tokens
            starts = sizes.cumsum() - sizes
            cut = [ids[a : a + n] for a, n in zip(starts, sizes)]
            for i, x in own.items():
                cut[i] = np.array(x, np.uint32)
            ids, sizes = np.concatenate(cut), np.array([len(c) for c in cut])
        used, known = int(self.ends[-1]), len(self.ends) - 1
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(ids)] = ids
        self.ends = np.concatenate([self.ends, used + sizes.cumsum()])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.number = np.insert(self.number, place, np.arange(known, known + len(pieces), dtype=np.int32))

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a slice one after the other, and the number of ids of each."""
        if len(self.hashes) > CACHE_PIECES:
            self._clear()
        n = len(data)
        if len(self.powers[0]) < n:
            self.powers = _powers(max(n, SLICE_BYTES))
        starts = self._starts(data, ends) if n else np.zeros(0, np.int64)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(ends) - 1, np.int64)
        stops = np.append(starts[1:], n)
        if not self.drop_space:
            size = (stops - starts).astype(np.uint64)  # a byte of value 0 at the end counts, too
        else:
            size = np.uint64(0)
        sums = np.add.reduceat(self.values[data] * self.powers[0][:n], starts)
        hashes, at, which = np.unique(mix(sums * self.powers[1][starts] + size), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        unknown = self.hashes[place] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if unknown.any():
            raw, new = data.tobytes(), at[unknown]
            # the words of texts that ignore white space may have some after them, which does no harm
            pieces = [raw[a:b].decode("utf-8") for a, b in zip(starts[new].tolist(), stops[new].tolist())]
            self._learn(hashes[unknown], pieces)
            place = np.searchsorted(self.hashes, hashes)
        number = self.number[place][which]
        begin = self.ends[number]
        size = self.ends[number + 1] - begin
        total = size.cumsum()
        take = np.repeat(begin - total + size, size) + np.arange(int(total[-1]))
        done = np.concatenate([[0], total])[np.searchsorted(starts, ends)]
        return self.ids[take], np.diff(done)
