"""Token ids of whole texts, piece by piece: a piece that was met before costs one lookup a batch.

Both ways give what the tokenizer gives for the whole text. A byte-level tokenizer starts a new word at every single
space between two visible characters, so a text may be cut there; one with the usual pattern also before a single line
break. A tokenizer that drops white space may be cut at any run of ASCII white space. Strings of special tokens in a text
are ordinary text.

The pieces of a batch are cut and numbered by Arrow, each different one is looked up, and the ids are gathered by number.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by a worker; beyond it the memory starts afresh.
REMEMBERED = 500_000
#: Bytes of text that are encoded at once: common words are then looked up once in many texts.
TOGETHER = 1 << 22
_TAIL = frozenset(".,;:!?")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_JOINED = 400


@dataclass(frozen=True)
class Ids:
    """The ids of some texts, one text after the other."""

    flat: np.ndarray
    edges: np.ndarray  # where each text starts in ``flat``, and the end

    def each(self) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        data, edges = self.flat.tobytes(), (self.edges * 4).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])]


def _ids(each: list[bytes]) -> Ids:
    sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
    return Ids(np.frombuffer(b"".join(each), dtype="<u4"), np.append(0, np.cumsum(sizes)))


def together(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches in a row as one, up to ``most`` bytes (``TOGETHER``) and one batch more, and after how many rows each of them
    ended. At the end Arrow gives back what it holds without using it: the worker stays, and so would its memory."""
    most = TOGETHER if most is None else most
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[pa.RecordBatch, list[int]]:
        columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)]
        return pa.RecordBatch.from_arrays(columns, schema=held[0].schema), np.cumsum([b.num_rows for b in held]).tolist()

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()
        held = []
    pa.default_memory_pool().release_unused()


def _numbered(pieces: pa.ListArray) -> tuple[list, np.ndarray, np.ndarray]:
    """The different pieces, the number of each piece, and where each text starts among the pieces."""
    edges = np.append(0, np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)))
    coded = pieces.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), edges


def gathered(found: Ids, number: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces by number, without the first ``skip`` of each, and how many each piece has."""
    starts, sizes = found.edges[number], np.diff(found.edges)[number]
    if skip is not None:
        starts, sizes = starts + skip, sizes - skip
    shift = starts - np.cumsum(sizes) + sizes
    return found.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _joined(self, texts: list[str], separator: str, marks: np.ndarray, at_start: bool) -> list[bytes]:
        """Ids of many pieces from a few long texts; ``marks`` tells which ids start (or end) a piece."""
        out: list[bytes] = []
        groups = [texts[i:i + _JOINED] for i in range(0, len(texts), _JOINED)]
        lines = [separator + separator.join(g) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(marks[ids])
            if len(cuts) != len(group):
                out += self._plain([separator + x if at_start else x for x in group])
                continue
            bounds = np.append(cuts, len(ids)) if at_start else np.append(0, cuts + 1)
            data = ids.tobytes()
            edges = (bounds * 4).tolist()
            out += [data[a:b] for a, b in zip(edges, edges[1:])]
        return out

    def _room(self) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()

    def ids(self, texts: pa.Array) -> Ids:
        return _ids(self._plain(texts.to_pylist()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        return self.ids(pa.array(texts, pa.string())).each()


class ByteEncoder(Encoder):
    """For byte-level tokenizers that keep white space."""

    _cut = re.compile(r" (?<=[!-~\w] )(?=[!-~\w])")

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for word, i in vocabulary.items() if word.startswith("Ġ")]] = True
        self.tails = dict(zip(_TAIL, self._plain(list(_TAIL))))
        self.breaks = np.zeros(len(self.starts), dtype=bool)
        self.breaks[[i for word, i in vocabulary.items() if word == "Ċ"]] = True
        form = json.loads(self.tokenizer.to_str())
        split = form["pre_tokenizer"] or {}
        self.usual = (form["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                      and not split["add_prefix_space"] and "Ċ" in vocabulary)

    def _learn(self, need: set[str]) -> None:
        """Ids of pieces after a space, for ``known``."""
        known = self.known
        tailed = [p for p in need if p and p[-1] in _TAIL and p[-2:-1].isalpha()]
        base = need.difference(tailed)
        base.update(p[:-1] for p in tailed)
        base = {p for p in base if p not in known}
        plain = [p for p in base if p and p.isprintable() and " " not in p]
        odd = list(base.difference(plain))
        known.update(zip(odd, self._plain([" " + p for p in odd])))
        known.update(zip(plain, self._joined(plain, " ", self.starts, True)))
        for p in tailed:
            known[p] = known[p[:-1]] + self.tails[p[-1]]

    def _learn_firsts(self, need: list[str]) -> None:
        """Ids of pieces after a line break, which they begin with."""
        tailed = [p for p in need if p[-1] in _TAIL and p[-2:-1].isalpha()]
        base = set(need).difference(tailed)
        base.update(p[:-1] for p in tailed)
        base = [p[1:] for p in base if p not in self.known]
        plain = [p for p in base if p.isprintable()]
        odd = ["\n" + p for p in base if not p.isprintable()]
        self.known.update(zip(odd, self._plain(odd)))
        self.known.update(zip(["\n" + p for p in plain], self._joined(plain, "\n", self.breaks, True)))
        for p in tailed:
            self.known[p] = self.known[p[:-1]] + self.tails[p[-1]]

    def _searched(self, texts: list[str]) -> list[bytes]:
        """For any text: cut where a space lies between two characters that are surely visible."""
        split = [self._cut.split(x) for x in texts]
        firsts = self._plain([x[0] for x in split])
        need: set[str] = set()
        for pieces in split:
            need.update(pieces[1:])
        self._learn({p for p in need if p not in self.known})
        get = self.known.__getitem__
        return [first + b"".join(map(get, pieces[1:])) for first, pieces in zip(firsts, split)]

    def ids(self, texts: pa.Array) -> Ids:
        self._room()
        if not self.usual or not len(texts):
            return _ids(self._searched(texts.to_pylist()))
        # Every line and the text itself begin a piece with a line break; that of the text is taken out below.
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        pieces, number, edges = _numbered(pc.split_pattern(marked, " "))
        known, good, firsts, others = self.known, [], [], []
        for p in pieces:
            if p in known:
                good.append(True)
            elif p[:1] == "\n":
                good.append(len(p) > 1 and not p[1].isspace() and not p[-1].isspace())
                if good[-1]:
                    firsts.append(p)
            else:
                good.append(p != "" and not p[0].isspace() and not p[-1].isspace())
                if good[-1]:
                    others.append(p)
        self._learn(set(others))
        self._learn_firsts(firsts)
        # A piece that is empty or has white space at an edge: the cut may be wrong, the text is done the other way.
        wrong = ~np.array(good)
        found = _ids([known[p] if x else b"" for p, x in zip(pieces, good)])
        skip = np.zeros(len(number), dtype=np.int64)
        skip[edges[:-1]] = 1
        skip[wrong[number]] = 0
        flat, sizes = gathered(found, number, skip)
        result = Ids(flat, np.append(0, np.cumsum(sizes))[edges])
        if not wrong.any():
            return result
        other = np.flatnonzero(np.add.reduceat(wrong[number], edges[:-1]))
        each = result.each()
        for i, data in zip(other.tolist(), self._searched(texts.take(pa.array(other)).to_pylist())):
            each[i] = data
        return _ids(each)


def _ends_plain(word: bytes) -> bool:
    """Whether ASCII marks after ``word`` begin a token: it ends in an ASCII letter or digit, or in a letter that stays one
    when it is normalised and lower-cased. A combining mark would go together with them."""
    if word[-1:].isalnum():
        return True
    return unicodedata.normalize("NFC", word[-4:].decode(errors="ignore")[-1:]).lower()[-1:].isalpha()


class WordEncoder(Encoder):
    """For tokenizers that drop white space and do not tell ASCII case apart."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def words(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, Ids]:
        """The different words, the number of each word, where each text starts among the words, and ids by number."""
        self._room()
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, number, edges = _numbered(split.cast(pa.list_(pa.binary())))
        known = self.known
        each = list(map(known.get, words))
        new = [i for i, x in enumerate(each) if x is None]
        self._learn([words[i] for i in new])
        for i in new:
            each[i] = known[words[i]]
        return words, number, edges, _ids(each)

    def _learn(self, need: list[bytes]) -> None:
        known, model = self.known, self.tokenizer.model
        base, marked = set(), []
        for w in need:
            bare = w.rstrip(_MARKS)
            if len(bare) < len(w) and _ends_plain(bare):
                marked.append((w, bare, w[len(bare):]))
                base.update(marked[-1][1:])
            else:
                base.add(w)
        rest = []
        for w in base:
            if w in known:
                continue
            if w.isalpha():  # of bytes: ASCII letters only, one word of the tokenizer's
                known[w] = array("I", [x.id for x in model.tokenize(w.decode())]).tobytes()
            else:
                rest.append(w)
        text = [w.decode() for w in rest]
        letters = [i for i, x in enumerate(text) if x.isalpha()]
        known.update(zip([rest[i] for i in letters], self._joined([text[i] for i in letters], " ", self.ends, False)))
        other = [i for i, x in enumerate(text) if not x.isalpha()]
        known.update(zip([rest[i] for i in other], self._plain([text[i] for i in other])))
        ends = {x: known[x] for x in {marks for _, _, marks in marked}}
        for w, bare, marks in marked:
            known[w] = known[bare] + ends[marks]

    def ids(self, texts: pa.Array) -> Ids:
        _, number, edges, found = self.words(texts)
        flat, sizes = gathered(found, number)
        return Ids(flat, np.append(0, np.cumsum(sizes))[edges])


class WholeEncoder(Encoder):
    """For any tokenizer: every text as a whole."""


_KINDS = {"byte": ByteEncoder, "word": WordEncoder, "whole": WholeEncoder}


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """One per worker; the file is read where the worker runs."""
    return _KINDS[kind](path)


@contextmanager
def borrowed(path: str, kind: str, remember: bool = True) -> Iterator[Encoder]:
    """The worker's encoder. Unless ``remember``, it goes at the end with all pieces it has met: the worker stays, and other
    stages need the room."""
    found = encoder(path, kind)
    yield found
    if not remember:
        found.known.clear()
        encoder.cache_clear()
