"""Token ids of whole texts, with the tokenizers library."""

from __future__ import annotations

import codecs
import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

#: Texts of these characters alone are cut here; a text with any other is encoded by the library whole.
PLAIN = regex.compile(r"[\n\x20-\x7e\xa1-ɏ‐-‧‰-⁞]*+")
#: In texts of ASCII alone, those that are not among them.
CONTROL = bytes(b for b in range(128) if b != 10 and not 32 <= b <= 126)
#: White space next to white space belongs to one piece.
RUNS = ("  ", " \n", "\n ", "\n\n\n")
#: Each is a piece of its own after a word, at the end of a cut.
MARKS = ".,;:!?"
#: Words that a worker remembers, at most. Texts that are encoded together have so many bytes, or are one text.
CACHED, PORTION = 400_000, 8 << 20
#: How byte-level vocabularies write each byte: those that are no visible character of Latin-1 as letters from 256 on. Blanks stay, they keep words apart.
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
WRITTEN = "".join(chr(256 + HIDDEN.index(b)) if b in HIDDEN and b != 32 else chr(b) for b in range(256))


class Encoder:
    """Encodes texts to ids as little-endian unsigned 32-bit integers.

    Byte-level BPE never merges across the pieces of its split. So a text without runs of white space is cut at blanks and
    line ends, a mark after a word goes on its own, and each distinct word is encoded by the library once and remembered, for a portion of
    texts at a time. Tokenizers of other kinds and all other texts go to the library whole. The ids are those of
    ``Tokenizer.encode(text, add_special_tokens=False)``; null and empty texts have none.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.byte_level = (
            made["model"]["type"] == "BPE" and not made.get("normalizer") and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        )
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        if self.byte_level:
            self.model = Tokenizer(self.library.model)  # takes pieces
            self.model.pre_tokenizer = CharDelimiterSplit(" ")
            # the words that are remembered, where their ids start in the pool, and how many there are; marks come first, under names that no word has
            self.known = pa.array([" " + m for m in MARKS], pa.large_string())
            self.first, self.size, self.pool = _strung(self._whole(list(MARKS)))
            vocabulary = self.library.get_vocab()
            self.starts = {}
            for mark, written in ((" ", "Ġ"), ("\n", "Ċ")):  # as the vocabulary writes them
                self.starts[mark] = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
                self.starts[mark][[i for t, i in vocabulary.items() if t.startswith(written)]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> dict[str, bytes]:
        """Ids of each word with a blank or a line end before it, under the word or the line end and the word."""
        if not words:
            return {}
        # strung together they keep apart, and only their first ids start with a blank or line end
        names = words if before == " " else [before + w for w in words]
        ids = np.array(self.library.encode_batch_fast([before + before.join(words)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.starts[before][ids])
        if len(starts) != len(words):
            return dict(zip(names, self._whole([before + w for w in words])))
        raw, ends = ids.tobytes(), np.append(starts[1:], len(ids)).tolist()
        return {w: raw[4 * a: 4 * b] for w, a, b in zip(names, starts.tolist(), ends)}

    def _pieces(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters: with the blank before it each is one piece, which the model takes without the split."""
        found = {}
        for lo in range(0, len(words), 256):
            part = words[lo: lo + 256]
            text = codecs.charmap_decode(" ".join(part).encode(), "strict", WRITTEN)[0]
            ids = np.array(self.model.encode_batch_fast(["Ġ" + text.replace(" ", " Ġ")], add_special_tokens=False)[0].ids, "<u4")
            raw, starts = ids.tobytes(), (4 * np.flatnonzero(self.starts[" "][ids])).tolist()
            found.update((w, raw[a:b]) for w, a, b in zip(part, starts, [*starts[1:], len(raw)], strict=True))
        return found

    def _learned(self, new: list[str]) -> list[bytes]:
        letters, words, lines, rest = [], [], [], []
        for c in new:
            if c.isalpha():
                letters.append(c)
            elif c.split() == [c]:
                words.append(c)
            elif c[:1] == "\n" and c.split() == [c[1:]]:
                lines.append(c[1:])
            else:
                rest.append(c)
        found = self._pieces(letters) | self._words(words, " ") | self._words(lines, "\n")
        found.update(zip(rest, self._whole([c if c[:1] == "\n" else " " + c for c in rest])))
        return [found[c] for c in new]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words among the known; new ones become known, and if they are too many, all others are forgotten."""
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(self.known) + len(new) > CACHED:
            kept = np.union1d(np.arange(len(MARKS)), at[at >= 0])
            at[at >= 0] = np.searchsorted(kept, at[at >= 0])
            first, size = self.first[kept], self.size[kept]
            self.known, self.pool = self.known.take(pa.array(kept)), self.pool[_stretches(first, size)]
            self.first, self.size = np.cumsum(size) - size, size
        if len(new):
            first, size, pool = _strung(self._learned(words.take(pa.array(new)).to_pylist()))
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, words.take(pa.array(new))])
            self.first, self.size = np.append(self.first, first + len(self.pool)), np.append(self.size, size)
            self.pool = np.append(self.pool, pool)
        return at

    def _cut(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of plain texts."""
        cuts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        firsts, words = cuts.offsets.to_numpy(), cuts.flatten()
        heads = self._whole(words.take(pa.array(firsts[:-1])).to_pylist())
        later = np.ones(len(words), dtype=bool)
        later[firsts[:-1]] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        codes, cuts = coded.indices.to_numpy(), coded.dictionary
        mark = np.full(len(cuts), -1, np.int64)  # after a word of letters
        for i, m in enumerate(MARKS):
            mark[pc.ends_with(cuts, m).to_numpy(zero_copy_only=False)] = i
        bare = pc.utf8_slice_codeunits(cuts, 0, -1)
        mark[~pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False)] = -1
        bare = pc.if_else(pa.array(mark >= 0), bare, cuts).dictionary_encode()
        place = self._places(bare.dictionary)[bare.indices.to_numpy()]
        # the ids of the words and marks, one cut after the other
        first, size = self.first[place], self.size[place] + (mark >= 0)
        ends, mark = np.append(0, np.cumsum(size[codes])), mark[codes]
        at = _stretches(first[codes], size[codes])
        at[ends[1:][mark >= 0] - 1] = mark[mark >= 0]
        body, bounds = self.pool[at].tobytes(), (4 * ends[firsts - np.arange(len(firsts))]).tolist()
        return (head + body[a:b] for head, a, b in zip(heads, bounds, bounds[1:]))

    def _is_plain(self, text: str) -> bool:
        return (
            self.byte_level and not any(s in text for s in self.special) and not any(r in text for r in RUNS)
            and not text.endswith("\n\n")
            and (len((raw := text.encode()).translate(None, CONTROL)) == len(raw) if text.isascii() else PLAIN.fullmatch(text) is not None)
        )

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if t and self._is_plain(t)]
        out = [b""] * len(texts)
        if plain:
            for i, raw in zip(plain, self._cut([texts[i] for i in plain])):
                out[i] = raw
        done = set(plain)
        others = [i for i, t in enumerate(texts) if t and i not in done]
        for i, raw in zip(others, self._whole([texts[i] for i in others])):
            out[i] = raw
        return out


def _strung(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each one's ids start, how many there are, and all ids."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(ids), "<u4")


def _stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` numbers from ``first`` on, of one after the other."""
    ends = np.cumsum(size)
    at = np.repeat(first - ends + size, size)
    at += np.arange(len(at))
    return at


def portions(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Stretches of ``batch`` of at most PORTION bytes in column ``texts``, or of one row."""
    ends, lo = np.cumsum(pc.binary_length(batch.column(texts)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PORTION, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that tasks that follow each other share what it knows."""
    return Encoder(path)
