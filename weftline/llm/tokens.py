"""Encoding whole texts with a public tokenizer, one distinct word at a time.

A byte-level BPE cuts a text into pre-tokens before it merges, and a run of white space always begins a
new one. So a text may be cut before every such run, and each distinct piece be encoded once: the ids of
the pieces, put together, are the ids of the text. Pieces are found, numbered and remembered in Arrow
arrays, which hold no object for each piece, and encoded by the tokenizers library.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = "\x1f"
#: White space as the tokenizer's own pattern takes it (Unicode White_Space).
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A letter and one sign at the end: the sign is a pre-token of its own.
SIGNED = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}][.,]$"
SIGNS = (".", ",")
#: Places where a long text may be cut: before white space that follows something else, or before a sign that
#: follows a letter, for texts without white space. No string of a special token has either inside.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLACE = re.compile(f"(?<=[^{_SPACES}])[{_SPACES}]|(?<=[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u3041-\u3096\u4e00-\u9fff\uac00-\ud7a3])[.,;:!?\u3001\u3002\uff0c]")
END_ID = 0
LONG = 1 << 20


def cuts(text: str, size: int) -> list[str]:
    """The text in parts of about `size` characters whose ids, put together, are its ids."""
    out, at = [], 0
    while len(text) - at > size:
        m = PLACE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Encoder:
    """Ids of texts, as the tokenizers library gives them for add_special_tokens=False.

    max_bytes bounds the remembered pieces with their ids; beyond it the memory starts anew.
    """

    def __init__(self, path: str, max_bytes: int = 40 << 20):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads only wait for it
        self.tokenizer = Tokenizer.from_file(path)
        self.max_bytes = max_bytes
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id; a byte is a character of its name
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self._forget()

    def _forget(self) -> None:
        self.pieces = pa.array([], pa.string())  # piece i has slot i + 1; slot 0 has the end id
        self.ids, self.ends, self.n = np.full(1 << 16, END_ID, np.uint32), np.ones(1 << 14, np.int64), 1
        self._encoded(pa.array(SIGNS))

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        """Of each piece, 0 if it isn't remembered."""
        return np.asarray(pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1)).astype(np.int64) + 1

    def _store(self, pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """ends: of each piece's ids among ids."""
        start, most = int(self.ends[self.n - 1]), self.n + len(pieces)
        if most > len(self.ends):
            self.ends = np.resize(self.ends, max(most, 2 * len(self.ends)))
        if start + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(start + len(ids), 2 * len(self.ids)))
        self.ends[self.n : most] = start + ends
        self.ids[start : start + len(ids)] = ids
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.n = most

    def _encoded(self, pieces: pa.Array, step: int = 1 << 14) -> None:
        """Remembers different pieces by the library's ids for them.

        Pieces that begin with white space and don't end with it are encoded as one text, as cuts before white space
        change nothing; the number of bytes of each id tells where a piece ends among the ids.
        """
        apart = np.asarray(pc.match_substring_regex(pieces, f"^[^\x00]*{SPACE}$")) | np.asarray(pc.match_substring(pieces, "<|"))
        apart |= ~np.asarray(pc.match_substring_regex(pieces, f"^{SPACE}"))
        joined, rest = pieces.filter(pa.array(~apart)), pieces.filter(pa.array(apart))
        order = np.argsort(apart, kind="stable")  # slots are in the order of the pieces
        ids, counts = [], []

        def alone(some: pa.Array) -> None:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(counts[-1].sum())))

        for at in range(0, len(joined), step):
            some = pa.concat_arrays([joined.slice(at, step)])
            ends = np.frombuffer(some.buffers()[1], np.int32, len(some) + 1, 4 * some.offset)
            text = some.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().decode()
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            upto, wanted = np.cumsum(self.sizes[got]), ends[1:] - ends[0]
            place = np.minimum(np.searchsorted(upto, wanted), len(upto) - 1)
            if (upto[place] == wanted).all():
                ids.append(got)
                counts.append(np.diff(place, prepend=-1))
            else:  # an id that reaches over the end of a piece, which no cut before white space gives
                alone(some)
        for at in range(0, len(rest), step):
            alone(rest.slice(at, step))
        if not ids:
            return
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        if len(joined) and len(rest):  # back to the order of the pieces
            begins = np.cumsum(counts) - counts
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            counts, begins = counts[back], begins[back]
            upto = np.cumsum(counts)
            ids = ids[np.repeat(begins - (upto - counts), counts) + np.arange(int(upto[-1]))]
        self._store(pieces, ids, np.cumsum(counts))

    def _found(self, pieces: pa.Array) -> np.ndarray:
        """The slots of different pieces, those that were unknown now remembered.

        Of an unknown piece that ends in a sign only what stands before the sign is encoded. Remembered pieces are
        looked up once, which takes longer than the rest: SIGNS and then new ones take the slots in their order.
        """
        signed = np.asarray(pc.match_substring_regex(pieces, SIGNED))
        cores = pc.utf8_slice_codeunits(pieces.filter(pa.array(signed)), 0, -1)
        slots = self._slots(pa.concat_arrays([pieces, cores]))
        slots, core_slots = slots[: len(pieces)], slots[len(pieces) :]
        new = slots == 0
        if not new.any():
            return slots
        if self.pieces.nbytes + self.ids.nbytes + self.ends.nbytes > self.max_bytes:
            self._forget()
            slots[:], core_slots[:], new[:] = 0, 0, True
        ending = pieces.filter(pa.array(new & signed))
        asked = new[signed]  # the cores that are needed
        cores, core_slots = cores.filter(pa.array(asked)), core_slots[asked]
        unknown = pa.concat_arrays([pieces.filter(pa.array(new & ~signed)), cores.filter(pa.array(core_slots == 0))]).dictionary_encode()
        places = self.n + np.asarray(unknown.indices).astype(np.int64)
        self._encoded(unknown.dictionary)
        n_plain = int((new & ~signed).sum())
        slots[new & ~signed] = places[:n_plain]
        core_slots[core_slots == 0] = places[n_plain:]
        if len(ending):
            sign = np.where(np.asarray(pc.ends_with(ending, ".")), *(self.ids[self.ends[k] - 1] for k in (1, 2)))
            begins, ends = self.ends[core_slots - 1], self.ends[core_slots]
            upto = np.cumsum(ends - begins + 1)
            ids = np.zeros(int(upto[-1]), np.uint32)
            ids[upto - 1] = sign
            rest = np.ones(len(ids), bool)
            rest[upto - 1] = False
            size = ends - begins
            ids[rest] = self.ids[np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            slots[new & signed] = self.n + np.arange(len(ending))
            self._store(ending, ids, upto)
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each followed by END_ID, and each text's start, with the end.

        Texts of more than LONG bytes are encoded in parts, so that beside the texts and their ids the
        working memory is bounded by the remembered pieces and what a run of texts of LONG bytes takes.
        """
        texts = pc.fill_null(texts, "")
        sizes = np.asarray(pc.binary_length(texts))
        out, lengths, at = [], [], 0
        while at < len(texts):
            if sizes[at] > LONG:
                parts = [self._encode(pa.array([x]))[0][:-1] for x in cuts(texts[at].as_py(), LONG)]
                out += [*parts, np.array([END_ID], np.uint32)]
                lengths.append([1 + sum(map(len, parts))])
                at += 1
                continue
            upto = np.cumsum(sizes[at : at + (1 << 16)])
            n = max(1, int(np.searchsorted(upto, 4 * LONG, side="right")))
            long = np.nonzero(sizes[at : at + n] > LONG)[0]
            n = int(long[0]) if len(long) else n
            ids, starts = self._encode(texts.slice(at, n))
            out.append(ids)
            lengths.append(np.diff(starts))
            at += n
        if not out:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", CUT + "\n")
        loose = np.asarray(pc.match_substring_regex(texts, SPACE + SPACE))
        if loose.any():
            runs = pc.replace_substring_regex(texts, f"({SPACE}+)", CUT + r"\1")
            marked = pc.if_else(pa.array(loose), runs, marked)
        whole = np.asarray(pc.match_substring(texts, CUT))  # these aren't cut
        parts = pc.split_pattern(marked, CUT)
        if whole.any():
            parts = pa.array([[t.as_py()] if w else p.as_py() for t, w, p in zip(texts, whole, parts)], pa.list_(pa.string()))
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        named = parts.flatten().dictionary_encode()
        slots = self._found(named.dictionary)
        which = np.insert(slots[np.asarray(named.indices)], offsets[1:], 0)  # with an end after each text
        begins = np.concatenate([[0], self.ends[: self.n - 1]])
        sizes, begins = (self.ends[: self.n] - begins)[which], begins[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        kind = np.int32 if upto[-1] + len(self.ids) < 1 << 31 else np.int64
        out = self.ids[np.repeat((begins - upto[:-1]).astype(kind), sizes) + np.arange(upto[-1], dtype=kind)]
        return out, upto[offsets + np.arange(len(offsets))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file, bounded in bytes."""
    return Encoder(path)
