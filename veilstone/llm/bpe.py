"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A word is encoded from left to right with the longest token that fits.  A token may follow another
only if the merges, applied to the two alone, would give just these two; where none fits, the last
token is taken back and a shorter one tried.  No position is tried twice, so the time is linear, and
the result is that of the merges in their order.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType
from tokenizers import Regex, pre_tokenizers

from veilstone.llm.store import columns, mapped, small_batches, with_fields

#: Fixed value: the pattern that splits text before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Two white-space characters side by side; texts without them may be cut before each space.
SPACES = regex.compile(r"\s\s")
#: Words whose tokens a worker remembers in each of two generations, and the longest such word.
REMEMBERED, REMEMBERED_LENGTH = 80_000, 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable Latin-1 for itself, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=1)
def exact_words() -> tuple[str, str]:
    """WORDS with the letters and numbers that the tokenizers library knows, and the first character that it takes otherwise.

    The library's Unicode may be older than that of ``regex``: its own splitter is asked once about every
    character that ``regex`` takes for a letter or a number, and those that it doesn't become other signs.
    """
    every = "".join(chr(c) for c in chain(range(0xD800), range(0xE000, 0x110000)))
    asked, unknown = "".join(regex.findall(r"[\p{L}\p{N}]", every)), {}
    for name in (r"\p{L}", r"\p{N}"):
        left = pre_tokenizers.Split(Regex(f"{name}+"), behavior="removed").pre_tokenize_str(asked)
        unknown[name] = _ranges(regex.findall(name, "".join(part for part, _ in left)))
    if not any(unknown.values()):
        return WORDS, ""
    known = {name: f"[{name}--[{out}]]" if out else name for name, out in unknown.items()}
    signs = "".join(unknown.values())
    pattern = WORDS.replace(r" ?[^\s\p{L}\p{N}]+", rf" ?[[^\s\p{{L}}\p{{N}}]||[{signs}]]+")
    for name, to in known.items():
        pattern = pattern.replace(f" ?{name}+", f" ?{to}+")
    return f"(?V1){pattern}", min(regex.findall(rf"[{signs}]", asked))


def _ranges(chars: list[str]) -> str:
    """The inside of a character class for characters in ascending order."""
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Bpe:
    """Tables of a byte-level BPE vocabulary (the JSON file of the tokenizers library).

    Inside, a token's number is its rank: 256 single bytes first, then the merges in order.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        exact, first = exact_words()
        self.plain_words, self.words = regex.compile(WORDS), regex.compile(exact)
        #: Where a text has none of these, the plain pattern gives the same words, in less time.
        self.rare = re.compile(f"[{re.escape(first)}-\U0010ffff]") if first else re.compile("(?!)")
        self.number: dict[str, int] = {}
        self.parts: list[tuple[int, int]] = []
        self.joined: dict[tuple[int, int], int] = {}
        ids: list[int] = []
        plain = lambda token: bytes(letters[c] for c in token).decode("latin-1")
        for b in sorted(letters, key=letters.get):
            self.number[chr(letters[b])] = len(ids)
            self.parts.append((len(ids), len(ids)))
            ids.append(vocab[b])
        for m in spec["model"]["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, whole = plain(left), plain(right), plain(left + right)
            pair = (self.number[a], self.number[b])
            if pair in self.joined or whole in self.number:
                self.joined.setdefault(pair, self.number[whole])
                continue
            self.joined[pair] = self.number[whole] = len(ids)
            self.parts.append(pair)
            ids.append(vocab[left + right])
        self.ids = ids
        self.length = [0] * len(ids)
        self.automaton = ahocorasick.Automaton()
        for text, n in self.number.items():
            self.length[n] = len(text)
            self.automaton.add_word(text, n)
        self.automaton.make_automaton()
        self.text = {n: t for t, n in self.number.items()}
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        by_id = {int(ids[n]): t.encode("latin-1") for n, t in self.text.items()} | {i: t.encode() for t, i in self.special.items()}
        blobs = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.sizes = np.array([len(b) for b in blobs], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(blobs), dtype=np.uint8)
        self.memory = _Memory(self)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a, b as they are when one follows the other.

        Undoes merges from the last on, on whichever side merged later, and looks for a pair across
        the border that would have been merged before what is undone.
        """
        key = (a, b)
        if (known := self._fits.get(key)) is not None:
            return known
        limit, ok = len(self.parts) + 1, True
        while True:
            if (m := self.joined.get((a, b))) is not None and m < limit:
                ok = False
                break
            undo_left = a > b
            if undo_left and self.parts[a][1] == a:
                undo_left = False
            if not undo_left and self.parts[b][0] == b:
                if self.parts[a][1] == a:
                    break
                undo_left = True
            if undo_left:
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]
        if len(self._fits) > 120_000:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def shorter(self, n: int) -> int:
        """The longest token that is a proper prefix of token n; -1 if there is none."""
        if (known := self._shorter.get(n)) is not None:
            return known
        t = self.text[n]
        found = next((self.number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.number), -1)
        self._shorter[n] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Ranks of the tokens of one word."""
        text = word.decode("latin-1")
        longest = [-1] * len(text)
        for end, n in self.automaton.iter(text):
            longest[end - self.length[n] + 1] = n  # matches end further right each time
        return self._search(longest)

    def _search(self, longest: list[int]) -> list[int]:
        out: list[int] = []
        size, length = len(longest), self.length
        open_at = bytearray(b"\x01") * (size + 1)
        at, n = 0, longest[0] if longest else -1
        while at < size:
            end = at + length[n]
            if open_at[end] and (not out or self.fits(out[-1], n)):
                out.append(n)
                at = end
                n = longest[at] if at < size else -1
                continue
            s = self.shorter(n)
            if s >= 0:
                n = s
                continue
            open_at[at] = 0
            n = out.pop()
            at -= length[n]
            while (s := self.shorter(n)) < 0 and out:  # nothing shorter here either
                open_at[at] = 0
                n = out.pop()
                at -= length[n]
            n = s
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special strings in it become their own ids, as the library's default is."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self._encode_plain(text)
        out = []
        for part in self.special_pattern.split(text):
            out.append(np.array([self.special[part]], dtype=np.int32) if part in self.special else self._encode_plain(part))
        return np.concatenate(out)

    def _encode_plain(self, text: str) -> np.ndarray:
        """Ids of ordinary text.

        A space between two other characters always begins a word, so a text without white space side
        by side is looked up in parts that begin with one; only parts not seen lately meet the pattern.
        """
        if not text:
            return np.empty(0, dtype=np.int32)
        if SPACES.search(text) or text[-1].isspace() or "\0" in text:
            parts = self.split(text)
        else:
            parts = text.replace(" ", "\0 ").split("\0")
        return np.fromiter(chain.from_iterable(map(self.memory.__getitem__, parts)), dtype=np.int32)

    def split(self, text: str) -> list[str]:
        """The words of a text, as the library has them."""
        return (self.plain_words if text.isascii() or not self.rare.search(text) else self.words).findall(text)

    def encode_part(self, part: str) -> tuple[int, ...]:
        """Ids of the words of a part."""
        words, ids = self.split(part), self.ids
        if len(words) == 1:
            return tuple([ids[n] for n in self.encode_word(part.encode("utf-8", "surrogatepass"))])
        return tuple(chain.from_iterable(map(self.memory.__getitem__, words)))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: each id's bytes are gathered from one blob by the offset table."""
        sizes = self.sizes[ids]
        if not len(ids):
            return ""
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.blob[where].tobytes().decode("utf-8", errors="replace")


class _Memory(dict):
    """part -> ids for the parts met lately: when it is full it becomes the older generation."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.older = bpe, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.older.get(part)
        if ids is None:
            ids = self.bpe.encode_part(part)
        if len(part) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_texts(docs: DataFrame, vocabulary: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ids array<int> and, if asked for, decoded (the ids' text).

    Null and empty texts have no ids.  A row's text is encoded whole; Arrow batches are small, so that
    long texts don't add up.  Every row is encoded by itself, so repeated rows and ids are fine, and no
    rows give none.  Columns of ``docs`` named like the new ones, in whatever case, are replaced; the
    others are kept as they are.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*columns(docs, [c for c in docs.columns if c.lower() not in ("ids", "decoded")]))
    schema = with_fields(list(docs.schema), ids=ArrayType(IntegerType()), **({"decoded": StringType()} if decoded else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(text_col).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
            if decoded:
                new.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "ids", *["decoded"] * decoded])

    return mapped(docs, run, schema)
