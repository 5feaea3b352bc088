"""Whole-text tokenisation through the tokenizers library, which sees each new chunk of text once a worker where the tokenizer allows it.

A chunk is a maximal run of bytes other than ASCII white space. A word tokenizer drops white space, its
normaliser composes no character with white space and lower-cases one character at a time, and none of its
patterns crosses white space; so the ids of a text are the ids of its chunks in order. Each Python worker
keeps the packed ids of chunks that it has met. Two generations bound the memory: when the young one is
full it becomes the old one, and what is found there is taken along. Files whose parts are not just those of
such a tokenizer are told when they are opened, and texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are split and their chunks numbered for about so many bytes at a time; a longer text is cut at white space into pieces of about
#: so many bytes.
PIECE = 6 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    at = 0
    while len(text) - at > size:
        m = GAP.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of an array of strings: the distinct chunks, the number of each chunk in order, and each text's end in them.

    Splitting and numbering run inside Arrow. Null counts as empty; an empty chunk can stand where white space begins a text.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(lists.flatten())
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)[1:].astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about PIECE bytes, or one long text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, before + PIECE - size, "right"))
            if not held:
                upto = max(upto, at + 1)  # one long text
            if upto > at:
                held.append(b.slice(at, upto - at))
                size += int(ends[upto - 1]) - before
            if upto < len(ends):
                yield _one(held)
                held, size = [], 0
            at = upto
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


class Memory:
    """Bounded memory of a function of one key; fill(keys) gives the values of new keys, none of them None."""

    def __init__(self, fill: Callable[[list], list], most: int):
        self.fill, self.most = fill, most
        self.young: dict = {}
        self.old: dict = {}

    def values(self, keys: list) -> list:
        got = list(map(self.young.get, keys))
        new = dict.fromkeys(k for k, x in zip(keys, got, strict=True) if x is None)
        if not new:
            return got
        old, ask = self.old.get, []
        for k in new:
            if (x := old(k)) is None:
                ask.append(k)
            else:
                new[k] = x
        new.update(zip(ask, self.fill(ask), strict=True))
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, new
        else:
            self.young.update(new)
        return [new[k] if x is None else x for k, x in zip(keys, got, strict=True)]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = {}, 256
    for b in range(256):
        if b in prints:
            out[b] = chr(b)
        else:
            out[b], n = chr(n), n + 1
    return out


#: The parts of a tokenizer file for which chunks are told apart: lower-cased words, digits and signs, byte-level, with word ends.
WORD_PARTS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            # the fixed pattern of such tokenizers
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
    },
}


def by_chunks(tokenizer_file: str) -> bool:
    """Whether a tokenizer file is of the kind whose texts fall into chunks; added tokens may neither span nor take white space."""
    with open(tokenizer_file, encoding="utf-8") as f:
        parts = json.load(f)
    parts["model"] = {k: v for k, v in parts["model"].items() if k not in ("vocab", "merges")}
    added = parts.get("added_tokens") or []
    fine = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in added)
    return fine and not parts.get("truncation") and not parts.get("padding") and all(parts.get(k) == v for k, v in WORD_PARTS.items())


def opened(tokenizer_file: str) -> WordTokens | WholeTokens:
    """What encodes texts by this file: chunk by chunk if it allows that, else whole texts."""
    return WordTokens(tokenizer_file) if by_chunks(tokenizer_file) else WholeTokens(tokenizer_file)


def _library(tokenizer_file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file)


class WholeTokens:
    """Ids of texts under any tokenizer of the library, each text encoded whole."""

    def __init__(self, tokenizer_file: str):
        self.whole = _library(tokenizer_file)
        self.whole.no_truncation()
        self.whole.no_padding()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of strings, one text after the other, and each text's end in them; null counts as empty."""
        got = self.whole.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)
        ids = [np.array(x.ids, "<u4") for x in got]
        return np.concatenate([*ids, np.zeros(0, "<u4")]), np.cumsum([len(x) for x in ids], dtype=np.int64)


class WordTokens:
    """Ids of texts under a byte-level word BPE that drops white space and lower-cases; the file must be one of by_chunks()."""

    #: Lower-cased words of letters that no normaliser changes.
    PLAIN = "^[a-zß-öø-ÿ]+$"
    #: What may stand behind such a word; a run of these is one piece for the tokenizer.
    STOPS = string.punctuation.replace("'", "")

    def __init__(self, tokenizer_file: str, most: int = 300_000):
        if not by_chunks(tokenizer_file):
            raise ValueError(f"{tokenizer_file} is no word tokenizer of the kind whose texts fall into chunks")
        self.whole = _library(tokenizer_file)
        self.bare = type(self.whole)(self.whole.model)  # for words that are in normal form already
        self.letters = _byte_letters()
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words = Memory(self._words, most)
        self.others = Memory(lambda chunks: list(map(self._alone, chunks)), most // 4)

    def _alone(self, chunk: str) -> bytes:
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            part = [w.encode().decode("latin-1").translate(self.letters) for w in words[at : at + 2000]]
            ids = np.array(self.bare.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) != len(part):
                out += map(self._alone, words[at : at + 2000])
                continue
            raw, cut = ids.tobytes(), cut.tolist()
            out += [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)]
        return out

    def _parts(self, chunks: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """For each chunk the numbers of its two parts, and the packed ids of the parts.

        The parts are a plain word and the stops behind it, or the whole chunk and nothing.
        """
        low = pc.utf8_lower(chunks)
        word = pc.ascii_rtrim(low, self.STOPS)
        # the one letter with another lower case in full than letter by letter
        plain = pc.and_(pc.match_substring_regex(word, self.PLAIN), pc.invert(pc.match_substring(chunks, "\u0130")))
        is_plain = plain.to_numpy(zero_copy_only=False)
        words = pc.dictionary_encode(word.filter(plain))
        behind = pc.dictionary_encode(pc.replace_substring_regex(low.filter(plain), self.PLAIN[:-1], ""))
        others = chunks.filter(pc.invert(plain)).to_pylist()
        packed = [b"", *self.words.values(words.dictionary.to_pylist())]
        parts = np.zeros((len(chunks), 2), np.int64)
        parts[is_plain, 0] = 1 + words.indices.to_numpy(zero_copy_only=False)
        parts[is_plain, 1] = len(packed) + behind.indices.to_numpy(zero_copy_only=False)
        packed += self.others.values(behind.dictionary.to_pylist())
        parts[~is_plain, 0] = len(packed) + np.arange(len(others))
        packed += self.others.values(others)
        return parts, packed

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of strings, one text after the other, and each text's end in them; null counts as empty."""
        if len(texts) == 1 and texts[0].is_valid and len(raw := texts.cast(pa.binary())[0].as_py()) > PIECE:
            ids = np.concatenate([self._encode(pa.array([p.decode()]))[0] for p in pieces(raw)])
            return ids, np.array([len(ids)])
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks, number, ends = numbered(texts)
        parts, packed = self._parts(chunks)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        pool, start = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(size) - size
        of = parts[number].reshape(-1)
        n = size[of]
        upto = np.cumsum(n)
        ids = pool[np.repeat(start[of] - upto + n, n) + np.arange(int(upto[-1]) if len(upto) else 0)]
        return ids, np.concatenate([[0], upto])[2 * ends]
