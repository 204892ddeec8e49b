"""Token ids of texts by a tokenizer whose pre-tokens never cross white space, a distinct word at a time."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts of words a Python worker remembers at least between batches; it holds twice as many at most.
REMEMBERED = 280_000
#: Words that one call of the library takes together.
TOGETHER = 512

# A Latin word and marks after it: the tokenizer lower-cases, and never puts a letter and such a mark in one pre-token.
_LATIN = "".join(map(chr, (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
_MARKS = ".,!?;:#*$%&"
_ALL_LATIN = "^[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+$"


class WordIds:
    """``ids`` of texts without special tokens added; the same as encoding each text whole.

    The tokenizer reads white space as a separator only, so a text's ids are those of its words in order.
    The library encodes each distinct word once; offsets give a word's share of the ids.
    """

    def __init__(self, path: str):
        # threads of their own in each worker would take memory and leave no core to other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each word the numbers of its two parts, lower-cased letters and marks (the whole word and nothing where it
        is not made so), and the ids of each part."""
        trimmed = pc.ascii_rtrim(words, characters=_MARKS)
        latin = pc.match_substring_regex(trimmed, _ALL_LATIN)
        letters = pc.if_else(latin, pc.utf8_lower(trimmed), words).dictionary_encode()
        marks = pc.if_else(latin, pc.utf8_ltrim(words, characters=_LATIN), "").dictionary_encode()
        names = [n for c in (letters, marks) for n in c.dictionary.to_numpy(zero_copy_only=False).tolist()]
        known, older = self.known, self.older
        known[""] = b""
        new = [n for n in dict.fromkeys(names) if n not in known]
        known.update((n, older[n]) for n in new if n in older)
        self._encode([n for n in new if n not in known])
        ids = list(map(known.__getitem__, names))
        return letters.indices.to_numpy(), marks.indices.to_numpy() + len(letters.dictionary), ids

    def _encode(self, words: list[str]) -> None:
        for i in range(0, len(words), TOGETHER * 8):
            groups = [words[j : j + TOGETHER] for j in range(i, min(i + TOGETHER * 8, len(words)), TOGETHER)]
            coded = self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
            for group, code in zip(groups, coded):
                lengths = np.fromiter(map(len, group), np.int64, len(group))
                starts = np.cumsum(lengths + 1) - lengths - 1
                raw = np.array(code.ids, np.uint32).astype(self.kind).tobytes()
                at = np.fromiter(chain.from_iterable(code.offsets), np.int64)[::2]
                width = self.kind.itemsize
                ends = [*(np.searchsorted(at, starts[1:], "left") * width).tolist(), len(raw)]
                self.known.update(zip(group, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = lists.values.dictionary_encode()
        letters, marks, ids = self._pieces(coded.dictionary)
        if len(self.known) > REMEMBERED:
            # parts not seen since the last turn are forgotten
            self.older, self.known = self.known, {}
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(ids), self.kind)
        first = np.cumsum(sizes) - sizes
        words = coded.indices.to_numpy()
        parts = np.empty(2 * len(words), np.int64)
        parts[::2], parts[1::2] = letters[words], marks[words]
        counts = sizes[parts]
        ends = np.cumsum(counts)
        # place in flat of every token of every part, in text order
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[parts] - (ends - counts), counts)
        tokens = flat[places]
        borders = np.concatenate([[0], ends])[2 * lists.offsets.to_numpy()]
        return [tokens[a:b] for a, b in zip(borders[:-1], borders[1:])]
