"""Tokenising with published vocabularies, and small binary helpers."""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from itertools import chain, repeat

import numpy as np

#: Pieces of text whose ids a worker remembers unless told otherwise, and the longest of them; some 200 bytes a piece.
CACHE_PIECES, CACHE_CHARS = 600_000, 48
#: Words that are encoded as one string.
JOINED = 4000
#: Characters that are cut and encoded at once.
CHARS = 3_000_000
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Letters that stay one letter when a vocabulary normalises them: basic Latin, Latin-1, Latin Extended-A but U+0130, Russian.
SURE = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0410-\u044f"


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printed, else the next from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    return {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in shown)} | {b: b for b in shown}


BYTE_LETTERS = {k: v for k, v in _byte_letters().items() if k != 10}


def worker_cache() -> dict:
    """A dictionary that lasts as long as the Python process, also for functions that travel by value."""
    return sys.modules.setdefault("_quarry_worker_cache", types.ModuleType("_quarry_worker_cache")).__dict__


class Encoder:
    """Ids of whole texts, packed as little-endian unsigned integers (2 bytes if the vocabulary allows, else 4).

    Both vocabularies split text into pieces before merging, so ids of a piece depend on it alone and can be looked
    up. Cuts are made only where such a split is certain: at a space or a line feed between characters that are no
    white space, and between a SURE letter and the sentence marks that end its chunk. With keep_space (byte-level
    vocabulary) white space yields ids: a space belongs to the piece after it, a line feed stands alone. Without it
    white space only separates. Cutting and finding the distinct pieces of a batch is Arrow's work. The ids of
    remembered pieces lie in flat arrays; when they are too many the half that was used least is forgotten.

    Strings of special tokens in a text get the special token's id, as the library does by default.
    """

    def __init__(self, path: str, keep_space: bool, pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.keep_space, self.pieces = keep_space, pieces
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        # Texts that are encoded whole (RE2): white space beside a space or line feed, either at an end, the cut mark, special tokens.
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.uncut = "|".join([r"^[ \n]|[ \n]\z", rf"{_WHITE}[ \n]", rf"[ \n]{_WHITE}", r"\x02", *special])
        # The same model alone, for words of SURE letters: its normaliser and its splitting into words have no more to do.
        plain = json.loads(self.tok.to_str())
        plain |= {"added_tokens": [], "normalizer": None, "pre_tokenizer": None}
        self.model = Tokenizer.from_str(json.dumps(plain))
        self.word = re.compile(f"{' ' if keep_space else ''}[{SURE}]+")
        # Tokens that begin a word with a space, or that end a word.
        edge = [i for t, i in self.tok.get_vocab().items() if (t.startswith(chr(BYTE_LETTERS[32])) if keep_space else t.endswith("</w>"))]
        self.edge = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.edge[edge] = True
        self.codes: dict[str, int] = {}
        self.begin, self.flat, self.uses = np.zeros(1, np.int64), np.zeros(0, self.dtype), np.zeros(0, np.int64)

    @staticmethod
    def of(path: str, keep_space: bool, pieces: int = CACHE_PIECES) -> Encoder:
        held = worker_cache()
        if (path, keep_space) not in held:
            held[path, keep_space] = Encoder(path, keep_space)
        held[path, keep_space].pieces = pieces
        return held[path, keep_space]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.dtype, int(size.sum())), size

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _whole, of words of SURE letters, each with its leading space if there is one; many to a call."""
        flat, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), JOINED):
            joined = "\n".join(words[at : at + JOINED])
            part = (joined if self.keep_space else joined.lower()).encode().decode("latin-1").translate(BYTE_LETTERS).split("\n")
            ids = np.array(self.model.encode_batch_fast([part], add_special_tokens=False, is_pretokenized=True)[0].ids, self.dtype)
            edge = np.flatnonzero(self.edge[ids])
            size = np.diff(np.r_[edge, len(ids)] if self.keep_space else np.r_[-1, edge])
            if len(size) != len(part) or size.sum() != len(ids):
                ids, size = self._whole(words[at : at + JOINED])
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _forget(self) -> None:
        n = len(self.codes)
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[: self.pieces // 2])
        words, size = list(self.codes), np.diff(self.begin)
        ends = np.cumsum(size[keep])
        self.flat = self.flat[np.repeat(self.begin[keep] - (ends - size[keep]), size[keep]) + np.arange(int(ends[-1]))]
        self.begin, self.uses = np.r_[0, ends], self.uses[keep] // 2
        self.codes = {words[i]: k for k, i in enumerate(keep.tolist())}

    def _look_up(self, pieces: list[str], uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, ids) of distinct pieces, of which so many stand in the text."""
        if len(self.codes) > self.pieces:
            self._forget()
        code = np.fromiter(map(self.codes.get, pieces, repeat(-1)), np.int64, len(pieces))
        known = code >= 0
        self.uses[code[known]] += uses[known]
        need = np.flatnonzero(~known).tolist()
        if need:
            easy = [i for i in need if self.word.fullmatch(pieces[i]) and len(pieces[i]) <= CACHE_CHARS]
            rest = sorted(set(need).difference(easy), key=lambda i: len(pieces[i]) > CACHE_CHARS)  # those to remember first
            (ids, size), (more, its) = self._words([pieces[i] for i in easy]), self._whole([pieces[i] for i in rest])
            need, size = easy + rest, np.r_[size, its]
            code[need] = n = len(self.codes) + np.arange(len(need))
            begin, flat = np.r_[self.begin, self.begin[-1] + np.cumsum(size)], np.concatenate([self.flat, ids, more])
            kept = sum(len(pieces[i]) <= CACHE_CHARS for i in need)
            self.codes.update((pieces[i], k) for i, k in zip(need[:kept], n[:kept].tolist()))
            self.begin = begin[: len(self.codes) + 1]
            self.flat = flat[: self.begin[-1]]
            self.uses = np.r_[self.uses, uses[need[:kept]]]
            return begin[code], begin[code + 1] - begin[code], flat
        return self.begin[code], self.begin[code + 1] - self.begin[code], self.flat

    def encode(self, texts) -> list[bytes]:
        """Packed ids of each text; null counts as empty. At most CHARS characters, or one text, are worked on at once."""
        out, part, size = [], [], 0
        for t in texts:
            t = t if isinstance(t, str) else ""
            if part and size + len(t) > CHARS:
                out += self._encode(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        return out + self._encode(part) if part else out

    def _encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        arr = pa.array(texts, pa.large_string())
        whole = np.flatnonzero(pc.match_substring_regex(arr, self.uncut))
        ids, size = self._whole([texts[i] for i in whole])
        done = {i: ids[y - n : y].tobytes() for i, n, y in zip(whole.tolist(), size, np.cumsum(size))}
        rest = np.setdiff1d(np.arange(len(texts)), whole)
        if len(rest):
            cut = pc.replace_substring_regex(arr.take(pa.array(rest)), f"([{SURE}])([.,;:!?]+)([ \n]|\\z)", "\\1\x02\\2\\3")
            cut = pc.replace_substring(cut, "\n", "\x02\n\x02" if self.keep_space else "\x02")
            split = pc.split_pattern(pc.replace_substring(cut, " ", "\x02 " if self.keep_space else "\x02"), "\x02")
            bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
            coded = split.flatten().dictionary_encode()
            index, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            begin, size, flat = self._look_up(pieces, np.bincount(index, minlength=len(pieces)))
            n = size[index]
            ends = np.cumsum(n)
            out = flat[np.repeat(begin[index] - (ends - n), n) + np.arange(int(ends[-1]))] if len(ends) and ends[-1] else flat[:0]
            at = np.r_[0, ends][bounds]
            done |= {int(i): out[x:y].tobytes() for i, x, y in zip(rest, at[:-1], at[1:])}
            del arr, cut, split, coded
            pa.default_memory_pool().release_unused()
        return [done[i] for i in range(len(texts))]


def crc32_u32(ids: bytes, dtype: np.dtype) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
