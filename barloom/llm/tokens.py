"""Token ids of whole texts with a tokenizer file, fast enough for many texts of few different words."""

from __future__ import annotations

import os
import re
import string
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a generation; one Python worker remembers two, and a word of the older one that comes again moves to the newer.
CACHE_WORDS = 500_000
#: Marks that end a word; together they are one pre-token of a byte-level BPE.
MARKS = string.punctuation
#: A blank between two characters that are no white space starts a new pre-token of a byte-level BPE, whatever surrounds it.
BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
#: Words up to this letter go to the model directly, which alone decides on a pre-token; Unicode has had these letters for long.
LAST_LETTER = "\u024f"
#: The characters by which a byte-level BPE writes the bytes that are no visible Latin-1 character.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


class PieceTokenizer:
    """Ids of a text, piece by piece: a piece ends before a blank or a line feed between two words, where no token can reach across.

    A piece is a blank or a line feed and a word, the latter kept with its line feed; words seen before come from a bounded cache,
    which a worker process keeps from task to task. The letters of a new one are a pre-token and go to the library's model as such.
    Words of other characters are joined and encoded together; each piece holds no other blank, so the tokens that start with one
    mark where the next piece begins. A text in which a blank stands beside other white space is cut at its plain boundaries only,
    and one with empty lines is not cut at line feeds.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.starts = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.starts[i] = token.startswith("Ġ")
        self.model = self.library.model
        self.numbers = [i.to_bytes(4, "little") for i in range(len(self.starts))]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _first(self, text: str) -> bytes:
        if (data := self.firsts.get(text)) is None:
            data = self.firsts[text] = self._ids([text])[0].tobytes()
        return data

    def _letters(self, word: str) -> bytes:
        """Ids of letters behind a blank, or of a line feed (a pre-token of its own) and letters."""
        line, body = word[0] == "\n", word.lstrip("\n")
        shown = body if body.isascii() else body.encode().decode("latin-1").translate(BYTE_LEVEL)
        ids = b"".join([self.numbers[t.id] for t in self.model.tokenize(shown if line else "Ġ" + shown)])
        return self._first("\n") + ids if line else ids

    def _learn(self, words: set[str]) -> None:
        """Letters and the marks after them are tokens apart, so a word that differs by its marks only is not encoded again."""
        known, older, whole, lines = self.known, self.older, [], []
        for word in words:
            letters = word.rstrip(MARKS)
            body = letters[1:] if letters[:1] == "\n" else letters
            if not body.isalpha() or max(body) > LAST_LETTER:
                (lines if word[0] == "\n" else whole).append(word)
                continue
            if (data := known.get(letters) or older.get(letters)) is None:
                data = known[letters] = self._letters(letters)
            if len(letters) != len(word):
                known[word] = data + self._first(word[len(letters):])
        known.update(zip(lines, [one.tobytes() for one in self._ids(lines)]))
        whole.sort()
        for at in range(0, len(whole), 2000):
            some = whole[at:at + 2000]
            ids = self._ids([" " + " ".join(some)])[0]
            begins = np.flatnonzero(self.starts[ids])
            if len(begins) == len(some) and begins[0] == 0:
                data, ends = ids.tobytes(), (begins * 4).tolist()
                known.update(zip(some, map(data.__getitem__, map(slice, ends, [*ends[1:], len(data)]))))
            else:
                known.update(zip(some, [one.tobytes() for one in self._ids([" " + w for w in some])]))

    def _by_boundaries(self, text: str) -> bytes:
        first, *parts = BOUNDARY.split(text)
        known = [self.known.get(p[1:]) for p in parts]
        return b"".join([self._first(first), *[k if k is not None else self._ids([p])[0].tobytes() for k, p in zip(known, parts)]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers.

        Arrow numbers the different words of these texts, so each is looked up once, and puts their ids in the order of the texts.
        """
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        if len(self.firsts) > CACHE_WORDS:
            self.firsts = {}
        empty_line = ["\n\n" in t for t in texts]
        lines = pa.array([t if e else t.replace("\n", " \n") for t, e in zip(texts, empty_line)], pa.large_string())
        words = pc.split_pattern(lines, " ")
        begins = np.asarray(words.offsets)
        numbered = words.flatten().dictionary_encode()
        different, code = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), np.array(numbered.indices)
        firsts = [different[i] for i in code[begins[:-1]].tolist()]
        code[begins[:-1]] = np.arange(len(different), len(different) + len(texts))

        known = self.known
        ids = list(map(known.get, different))
        new = {w for w, found in zip(different, ids) if found is None}
        odd = {w for w in new if not w or w[-1].isspace() or w[w[0] == "\n":][0].isspace()}
        again = new.intersection(self.older)
        known.update(zip(again, map(self.older.__getitem__, again)))
        self._learn(new.difference(odd, again))
        ids = [known.get(w, b"") if found is None else found for w, found in zip(different, ids)]
        ids += map(self._first, firsts)
        data = pa.array(ids, pa.large_binary()).take(pa.array(code))
        whole = data.buffers()[2] or b""
        ends = np.frombuffer(data.buffers()[1], np.int64, len(code) + 1)[begins].tolist()
        out = [bytes(whole[a:b]) for a, b in zip(ends, ends[1:])]

        aside = np.zeros(len(ids), bool)
        if odd:
            aside[:len(different)] = [w in odd for w in different]
        for i, (first, n) in enumerate(zip(firsts, np.diff(begins).tolist())):
            aside[len(different) + i] = n > 1 and (not first or first[-1].isspace()) or (empty_line[i] and " \n" in texts[i])
        for i in np.flatnonzero(np.logical_or.reduceat(aside[code], begins[:-1])).tolist() if texts else ():
            out[i] = self._by_boundaries(texts[i])
        return out


@cache
def tokenizer(path: str) -> PieceTokenizer:
    """The worker process's tokenizer of a file; Spark uses a worker for many tasks, so its words need not be learnt again."""
    return PieceTokenizer(path)
