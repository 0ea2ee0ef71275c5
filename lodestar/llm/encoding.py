"""Token ids of whole texts by the tokenizers library, each distinct word of some texts encoded once."""

from __future__ import annotations

import gc
import os
import re
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from lodestar.llm.common import release_memory, take_process

# A task has one core; threads of the library would only wait for each other.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words in one text that is encoded, and such texts in one call.
TOGETHER = 200
AT_ONCE = 100


def _byte_alphabet() -> dict[int, str]:
    """Byte → the character that byte-level vocabularies write for it: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


ALPHABET = _byte_alphabet()
#: Where this is found in a text, its white space is not single spaces and line feeds alone.
OTHER_WHITE = "  | \\n|\\n |\\n\\n|[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Texts that are handled at a time, of ``spaced`` vocabularies and of others: more share more words, and take more memory.
SLICE = {True: 2_000, False: 8_000}


class Encoder:
    """Texts → their ids as little-endian unsigned 32-bit integers in bytes: those of the library's own call, with
    ``add_special_tokens=False``. So a special token's string in a text becomes its id, as the library has it.

    Both kinds of vocabulary used here split a text into words before they merge. ``spaced`` vocabularies (byte level)
    keep a single space with the word that follows and a single line feed for itself; the others drop white space. So
    the ids of a text are those of its words in turn, and the distinct words of ``SLICE`` texts are encoded once, many
    at a time, with a separator between them whose id stands for itself. Texts for which that rule does not hold
    (white space next to white space, other white space, a special token's string) are encoded whole. Nothing is
    remembered from slice to slice. Use :func:`encoder`, which reads a vocabulary once for a process.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([*added, *([OTHER_WHITE] if spaced else [])])
        self.mark, self.between = ("\n", "\n") if spaced else ("9", " 9 ")
        ids = self._whole([self.mark])[0]
        if len(ids) != 4:
            raise ValueError(f"{path}: the separator is no single token")
        self.mark_id, self.line = int.from_bytes(ids, "little"), ids
        self.stops = dict(zip(".,", self._whole([".", ","]), strict=True))
        # Words of letters alone need neither normalizer nor pre-tokenizer: they are spelled out and merged only.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Split(ALPHABET[10], "isolated")
        self.letter_mark = self.letters.encode(ALPHABET[10], add_special_tokens=False).ids[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has.

        Words are handled as columns. A ``spaced`` vocabulary's word has the space before it, or starts with a line
        feed, whose id then comes first. A full stop or comma after letters is a word of its own to both vocabularies.
        """
        head = np.zeros(len(words), bool)
        lead = pa.scalar("")
        if self.spaced:
            is_head = pc.starts_with(words, "\n")
            head = _mask(is_head)
            words = pc.replace_with_mask(words, is_head, pc.utf8_slice_codeunits(words.filter(is_head), 1))
            lead = pc.if_else(is_head, "", " ")
        is_wide = pc.invert(pc.string_is_ascii(words))
        wide = words.filter(is_wide).to_pylist()
        if not self.spaced:
            # Lower case where the vocabulary lowers words whatever stands around.
            wide = [x.lower() if is_normalized("NFC", x) and "\u03a3" not in x and "\u0130" not in x else x for x in wide]
            words = pc.replace_with_mask(pc.ascii_lower(words), is_wide, pa.array(wide, pa.string()))
        stops = np.zeros(len(words), np.uint32)
        for mark, ids in self.stops.items():
            stops[_mask(pc.ends_with(words, mark))] = int.from_bytes(ids, "little")
        stopped = pa.array(stops > 0)
        core = pc.replace_with_mask(words, stopped, pc.utf8_slice_codeunits(words.filter(stopped), 0, -1))
        # Letters alone, and in the form that the vocabulary keeps, need neither normalizer nor pre-tokenizer.
        letters = _mask(pc.ascii_is_alpha(core)).copy()
        wide = [x[:-1] if x[-1] in self.stops else x for x in wide]
        letters[_mask(is_wide)] = [x.isalpha() and (self.spaced or (is_normalized("NFC", x) and "\u03a3" not in x and x.lower().isalpha())) for x in wide]
        alone = ~letters & (_mask(pc.equal(words, "")) | _mask(pc.match_substring(words, self.mark)))
        others = ~letters & ~alone
        flats, at = [np.zeros(1, np.uint32)], 1
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        led, whole = (pc.binary_join_element_wise(lead, x, "") for x in (core, words))
        for chosen, texts, encode in ((letters, led, self._spelled), (others, whole, self._joined), (alone, whole, self._singly)):
            if not chosen.any():
                continue
            coded = texts.filter(pa.array(chosen)).dictionary_encode()
            flat, first, size = encode(coded.dictionary)
            order = coded.indices.to_numpy()
            starts[chosen], sizes[chosen] = first[order] + at, size[order]
            flats.append(flat)
            at += len(flat)
        flat = np.concatenate([*flats, np.zeros(1, np.uint32)])
        after = letters & (stops > 0)
        own = sizes + head + after
        ends = np.cumsum(own)
        out = flat[np.repeat(starts - head - (ends - own), own) + np.arange(int(own.sum()))]
        out[(ends - own)[head]] = self.mark_id
        out[ends[after] - 1] = stops[after]
        return out, own

    def _spelled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of letters, spelled in the alphabet of bytes that the merges are made of; a line feed is the separator."""

        def spell(x: str) -> str:
            x = x if self.spaced else x.lower()
            return x.replace(" ", ALPHABET[32]).replace("\n", ALPHABET[10]) if x.isascii() else x.encode().decode("latin-1").translate(ALPHABET)

        return self._together(words, "\n", spell, self.letters, self.letter_mark)

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._together(words, self.between, str, self.tokenizer, self.mark_id)

    def _singly(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = self._whole(words.to_pylist())
        sizes = np.array([len(x) // 4 for x in parts], np.int64)
        return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes, sizes

    def _together(self, words: pa.Array, between: str, spell, tokenizer: Tokenizer, mark_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode ``TOGETHER`` words in one text and ``AT_ONCE`` texts in one call: what the library holds is bounded."""
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        bounds = np.r_[np.arange(0, len(words), TOGETHER), len(words)].astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words), between)
        flats, starts, sizes, at = [], [], [], 0
        for first in range(0, len(texts), AT_ONCE):
            group = texts.slice(first, AT_ONCE).to_pylist()
            for k, encoded in enumerate(encode([spell(x) for x in group], add_special_tokens=False), first):
                ids = np.array(encoded.ids, np.uint32)
                marks = np.flatnonzero(ids == mark_id)
                n = int(bounds[k + 1] - bounds[k])
                if len(marks) + 1 == n:
                    begin = np.r_[0, marks + 1]
                    size = np.r_[marks, len(ids)] - begin
                else:  # a word that holds the separator in another spelling
                    ids, begin, size = self._singly(words.slice(int(bounds[k]), n))
                flats.append(ids)
                starts.append(begin + at)
                sizes.append(size)
                at += len(ids)
        return np.concatenate(flats), np.concatenate(starts), np.concatenate(sizes)

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        array = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        out: list[bytes] = []
        collects = gc.isenabled()
        gc.disable()  # lists of many words make the collector walk them again and again, and no cycles are made here
        try:
            for at in range(0, len(array), SLICE[self.spaced]):
                out += self._some(array.slice(at, SLICE[self.spaced]))
        finally:
            if collects:
                gc.enable()
        return out

    def _some(self, texts: pa.Array) -> list[bytes]:
        """Split and number the words outside Python; only a slice's distinct words become Python strings."""
        texts = pc.fill_null(texts, "")
        is_odd = pc.match_substring_regex(texts, self.odd) if self.odd else pa.array(np.zeros(len(texts), bool))
        odd = np.flatnonzero(is_odd.to_numpy(zero_copy_only=False))
        whole = dict(zip(odd.tolist(), self._whole(texts.take(pa.array(odd)).to_pylist()), strict=True))
        texts = pc.if_else(is_odd, "", texts) if len(odd) else texts
        # A word at a line's start keeps the line feed before it; so does, for now, a text's first word.
        plain = pc.replace_substring(texts, "\n", " \n" if self.spaced else " ")
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", plain, "") if self.spaced else plain, " ")
        numbers = lists.flatten().dictionary_encode()
        flat, sizes = self._pieces(numbers.dictionary)
        bounds = np.r_[0, np.cumsum(sizes)] * 4
        coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).take(numbers.indices)
        _, ends, data = coded.buffers()
        raw = memoryview(data) if data else memoryview(b"")
        bounds = np.frombuffer(ends, np.int64)[coded.offset : coded.offset + len(coded) + 1][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        skip = len(self.line) if self.spaced else 0
        return [whole[i] if i in whole else bytes(raw[a + skip : b]) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]


def _mask(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """The process's encoder of a vocabulary; Python workers outlive tasks."""
    take_process("encoder", _ENCODERS.clear)
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
        release_memory()  # reading a vocabulary takes several times its size
    return _ENCODERS[path, spaced]
