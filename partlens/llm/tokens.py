"""Token ids by a public tokenizer, through a cache of the pieces between blanks.

The vocabulary's own split never joins characters over a blank or a line feed, so a text's ids are
those of its pieces one after the other. Pieces repeat, so most are looked up and few are encoded.
"""

from __future__ import annotations

import gc
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries kept in each generation of a worker's cache. This bounds memory only: what is not kept is encoded again.
CACHE = 200_000
#: A longer piece is encoded but not kept.
KEEP = 48
#: Letters, whose ids don't depend on case, and the signs after them, which the vocabulary's split takes apart.
PLAIN = r"^(?P<core>[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}]+)(?P<end>[!-&(-/:-@\[-`{-~]*)$"


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell the bytes that aren't printable: as the letters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: chr(0x100 + i) for i, byte in enumerate(b for b in range(0x100) if b not in printable)}


class Recent:
    """A dict of two generations: when the younger is full, the older is forgotten."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.now) > CACHE:
            self.now, self.older = {}, self.now

    def missing(self, keys: set[str]) -> set[str]:
        """Those of the keys that neither generation has; what the older has moves to the younger."""
        new = keys.difference(self.now)
        again = new.intersection(self.older)
        self.now.update(zip(again, map(self.older.__getitem__, again), strict=True))
        return new - again


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces, self.cores, self.ends = Tokenizer.from_file(path), Recent(), Recent(), Recent()
        self.model, self.spelling = self.tokenizer.model, byte_letters()

    def _whole(self, texts: list[str]) -> dict[str, bytes]:
        """By the tokenizer as it is."""
        got: dict[str, bytes] = {}
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096]
            for text, made in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                got[text] = struct.pack(f"<{len(made.ids)}I", *made.ids)
        return got

    def _spell(self, cores: list[str]) -> dict[str, bytes]:
        """By the vocabulary's model alone: lower-case letters need no splitting or normalising."""
        tokenize, made = self.model.tokenize, {}
        for core in cores:
            ids = [t.id for t in tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(self.spelling))]
            made[core] = struct.pack(f"<{len(ids)}I", *ids)
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text (null: empty) its ids' bytes, without special tokens."""
        gc.disable()  # no cycles are made here, and looking for them in large dicts takes long
        try:
            return self._encode(texts)
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Arrow tells pieces, letters and the signs after them apart, so that each distinct one is looked up once; numpy puts the ids together."""
        self.pieces.turn()
        self.cores.turn()
        cut = pc.split_pattern(pc.replace_substring(pa.array([x or "" for x in texts], pa.large_string()), "\n", " "), " ")
        coded = pc.dictionary_encode(cut.flatten())
        which, matched = coded.indices.to_numpy(), pc.extract_regex(coded.dictionary, PLAIN)
        plain = np.asarray(matched.is_valid())
        odd = coded.dictionary.filter(pa.array(~plain)).to_pylist()
        segments, core = self._looked_up(pc.utf8_lower(matched.field("core")), plain, self.cores, self._spell)
        more, end = self._looked_up(matched.field("end"), plain, self.ends, self._whole)
        rest = self._found(odd, self.pieces, self._whole)
        # a piece is two segments: its letters and the signs, or the whole of it and nothing
        left, right = core, end + len(segments)
        left[~plain] = len(segments) + len(more) + np.arange(len(odd))
        right[~plain] = len(segments) + len(more) + len(rest)
        segments += [*more, *rest, b""]
        ids, sizes = np.frombuffer(b"".join(segments), "<u4"), np.fromiter(map(len, segments), np.int64, len(segments)) // 4
        both = np.column_stack([left[which], right[which]]).ravel()
        own, first = sizes[both], (np.cumsum(sizes) - sizes)[both]
        ends = np.cumsum(own)
        place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)  # a batch has far fewer ids than 2**31
        place += np.repeat((first - ends + own).astype(np.int32), own)
        made = ids[place]
        at = np.concatenate([[0], ends])[2 * (np.asarray(cut.offsets) - cut.offsets[0].as_py())]
        return [made[lo:hi].tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _looked_up(self, texts: pa.Array, valid: np.ndarray, cache: Recent, encode) -> tuple[list[bytes], np.ndarray]:
        """The ids of an Arrow array's distinct texts, and for each element the number of its own (0 where it isn't valid)."""
        coded = pc.dictionary_encode(texts.filter(pa.array(valid)))
        number = np.zeros(len(texts), np.int32)
        number[valid] = coded.indices.to_numpy()
        return self._found(coded.dictionary.to_pylist(), cache, encode), number

    def _found(self, distinct: list[str], cache: Recent, encode) -> list[bytes]:
        """The ids of distinct texts: from the cache, or encoded; long ones aren't kept."""
        new = cache.missing(set(distinct))
        cache.now.update(encode(list(new)))
        found = list(map(cache.now.__getitem__, distinct))
        for x in [x for x in new if len(x) > KEEP]:
            del cache.now[x]
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def chunks(texts: list, most: int = 4_000_000):
    """Slices of a batch with about `most` characters, to bound the memory of one round."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x) if x else 0
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
