"""Tokens of whole texts: the library's ids through a cache of words, and counts by heap-merged byte pairs.

Both tokenizers here cut a text before they merge, and never across a change from other characters to white
space. A text may therefore be cut there first, and each part's tokens be remembered: words repeat, texts
don't. Whatever the cut doesn't cover (special strings, control characters that count as white space in one
library and not in the other) goes to the library as a whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, slices, sole_cache

#: Entries of a cache's younger half; longer parts are not kept.
CACHE, LONGEST = 400_000, 48
#: Words whose ids are known at once to texts that are encoded together, and bytes of such texts.
KNOWN, TOGETHER = 1_000_000, 8 << 20

#: Marks a part without a space before it; half a surrogate pair is in no text.
FIRST = "\ud800"

#: White space in one library and not in the other; white space besides blanks and line ends.
_ODD, _ASCII_SPACE = "\x1c\x1d\x1e\x1f", "\t\r\v\f"
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Texts whose words Arrow's split at blanks and line ends does not give.
_UNEVEN = r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\r\v\f\x1c-\x1f]|" + _WIDE_SPACE.pattern
_PART = re.compile(r"\s*\S+|\s+")
_ENDS = frozenset(",.!?;:%&#*$\"|")


def _has(text: str, chars: str) -> bool:
    return any(c in text for c in chars)


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Kept(dict):
    """Computes what it lacks and passes long keys through. When full, its content becomes the older half, from
    which keys still in use come back; the rest goes with the next turn."""

    def __init__(self, of):
        self.of, self.old = of, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Known:
    """The ids of words in one array, by the words' numbers in an Arrow dictionary: a fraction of a dict's memory,
    and what is looked up are arrays. When full, it keeps the half used most of late."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.ids, self.start, self.size, self.uses = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def codes(self, words: pa.Array, of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each word; ``of`` gives new ones' ids in a row, and how many each has."""
        # one dictionary of all chunks, which begins with what is known
        coded = pa.chunked_array([self.words, words]).dictionary_encode().chunks[-1]
        new = coded.dictionary.slice(len(self.words)).to_pylist()
        ids, size = of(new)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size.astype(np.int32)])
        self.words, codes = coded.dictionary, coded.indices.to_numpy()
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)]) + np.bincount(codes, minlength=len(self.words))
        return codes

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers, and how many there are up to each word's end."""
        size = self.size[codes]
        upto = np.cumsum(size, dtype=np.int64)
        return self.ids[np.repeat(self.start[codes] - upto + size, size) + np.arange(upto[-1])], upto

    def turn(self) -> None:
        """Forget long words, and when full the words used least; numbers given before hold no more."""
        keep = pc.less_equal(pc.utf8_length(self.words), LONGEST).to_numpy(zero_copy_only=False)
        if len(self.words) > KNOWN:
            most = np.zeros(len(keep), bool)
            most[np.argpartition(self.uses, -KNOWN // 2)[-KNOWN // 2 :]] = True
            keep, self.uses = keep & most, self.uses // 2
        if not keep.all():
            codes = np.flatnonzero(keep)
            ids, upto = self.gather(codes) if len(codes) else (self.ids[:0], codes)
            self.words, self.ids, self.size, self.uses = self.words.take(pa.array(codes)), ids, self.size[codes], self.uses[codes]
            self.start = upto - self.size


class _Splitter:
    """Cuts texts as the tokenizer file says, into keys of ``parts`` and those into pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = spec["normalizer"] is not None  # lower case, white space dropped
        pre = spec["pre_tokenizer"]
        if self.words:
            kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
            if kinds != ["NFC", "Replace", "Lowercase"]:
                raise ValueError(f"this normalizer is not supported: {kinds}")
            self.cut = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
        elif pre["type"] == "ByteLevel" and pre["use_regex"]:
            self.cut = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        else:
            raise ValueError("this pre-tokenizer is not supported")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.chars = dict(enumerate(_byte_chars()))
        self.spec = spec

    def whole(self, text: str) -> bool:
        """Must the library see this text as a whole?"""
        return any(x in text for x in self.special) or _has(text, _ODD)

    def parts(self, text: str) -> list[str]:
        """Keys of the parts. For the byte-level kind a key stands for a space and itself, unless it begins
        with white space or the mark of a text's beginning."""
        if self.words:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            return text.lower().split()
        if not text:
            return []
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or "\n" in parts or _has(text, _ASCII_SPACE) or not text.isascii() and _WIDE_SPACE.search(text):
            parts = _PART.findall(text)
            return [p[1:] if p[0] == " " and p[1:2].strip() else p if p[0].isspace() else FIRST + p for p in parts]
        if parts[0][0] != "\n":
            parts[0] = FIRST + parts[0]
        return parts

    def pieces(self, key: str) -> list[str]:
        """The pre-tokens of a part, in byte characters."""
        if not self.words:
            first = key[0]
            key = key[1:] if first == FIRST else key if first.isspace() else " " + key
            if not key.isascii():
                return [p.encode().decode("latin-1").translate(self.chars) for p in self.cut.findall(key)]
            if first != FIRST and key[1:].isalpha():
                return [self.chars[32] + key[1:]] if first not in "\n\t" else [self.chars[ord(first)], key[1:]]
            if key[0] == " " and key[-1] in _ENDS and key[1:-1].isalpha():
                return [self.chars[32] + key[1:-1], key[-1]]
            return [p.translate(self.chars) for p in self.cut.findall(key)]
        if key.isalpha():
            return [key if key.isascii() else key.encode().decode("latin-1").translate(self.chars)]
        if key[-1] in _ENDS and key[:-1].isalpha():
            return [key[:-1] if key.isascii() else key[:-1].encode().decode("latin-1").translate(self.chars), key[-1]]
        return [p.encode().decode("latin-1").translate(self.chars) for p in self.cut.findall(key)]


class Encoder:
    """``ids(text)``: the library's ids without added special tokens, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split = _Splitter(path)
        model = self.library.model
        piece, pieces = _Kept(lambda p: np.array([t.id for t in model.tokenize(p)], "<u4").tobytes()), self.split.pieces

        def part(key: str) -> bytes:
            found = pieces(key)
            return piece[found[0]] if len(found) == 1 else b"".join([piece[p] for p in found])

        self.part, self.known = _Kept(part), _Known()
        if not self.split.words:
            vocabulary = self.split.spec["model"]["vocab"]
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[[i for s, i in vocabulary.items() if s[0] in (self.split.chars[32], self.split.chars[10])]] = True

    def ids(self, text: str) -> bytes:
        if self.split.whole(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.part.__getitem__, self.split.parts(text)))

    def batch(self, texts: pa.Array) -> list[bytes]:
        """``ids`` of each text, none of them null. Where single blanks and line ends cut the words, Arrow finds
        the different ones of all these texts at once, and only their numbers are worked on."""
        odd = np.ones(len(texts), bool)
        if not self.split.words:
            found = pc.match_substring_regex(texts, _UNEVEN)
            for x in self.split.special:
                found = pc.or_(found, pc.match_substring(texts, x))
            odd = found.to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.ids(texts[k].as_py())
        even = np.flatnonzero(~odd)
        if len(even):
            for k, ids in zip(even.tolist(), self._even(texts.take(pa.array(even)))):
                out[k] = ids
            self.known.turn()
        return out

    def _even(self, texts: pa.Array) -> Iterator[bytes]:
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends, words = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False), dtype=np.int64), cut.flatten()
        starts = np.concatenate([[0], ends[:-1]])
        # no blank is before a text's first word
        heads = [self.part[FIRST + w] for w in words.take(pa.array(starts)).to_pylist()]
        codes = self.known.codes(words, self.row)
        for at in range(0, len(ends), 200):
            a, b = starts[at], ends[min(at + 200, len(ends)) - 1]
            ids, upto = self.known.gather(codes[a:b])
            upto = np.concatenate([[0], upto])
            for head, i, j in zip(heads[at : at + 200], upto[starts[at : at + 200] + 1 - a].tolist(), upto[ends[at : at + 200] - a].tolist()):
                yield head + ids[i:j].tobytes()

    def row(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys of parts one after another, and how many each has."""
        got, sizes = [], []
        for at in range(0, len(keys), 2000):
            some = keys[at : at + 2000]
            short = [k if k[0] == "\n" else " " + k for k in some if len(k) <= LONGEST]
            ids = np.array(self.library.encode_batch_fast(["".join(short)], add_special_tokens=False)[0].ids, "<u4")
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) != len(short):
                raise ValueError("the tokens of words can't be told apart")
            n = np.diff(np.append(begin, len(ids)))
            if len(short) < len(some):
                parts = iter(np.split(ids, begin[1:]))
                each = [next(parts) if len(k) <= LONGEST else np.frombuffer(self.part[k], "<u4") for k in some]
                ids, n = np.concatenate(each), np.array([len(x) for x in each])
            got.append(ids)
            sizes.append(n)
        return np.concatenate([np.zeros(0, "<u4"), *got]), np.concatenate([np.zeros(0, np.int64), *sizes])


class PairCounter:
    """``count(text)``: how many tokens the merges leave, by heap and linked list, without making ids."""

    def __init__(self, path: str):
        self.path, self.split, self._library = path, _Splitter(path), None
        model = self.split.spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.numbers = {s: i for i, s in enumerate(model["vocab"])}
        rank = {}
        for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            rank.setdefault(self.numbers[a] << 20 | self.numbers[b], (r, self.numbers[a + b]))
        self.rank = rank
        piece = _Kept(self.left)
        self.part = _Kept(lambda key: sum([piece[p] for p in self.split.pieces(key)]))

    def left(self, piece: str) -> int:
        """Initial symbols minus merges: the lowest-ranked adjacent pair, leftmost first, is popped from a
        heap and joined in a doubly linked list until no pair is left."""
        symbols = [*piece[:-1], piece[-1] + self.end]
        ids = [self.numbers[s] for s in symbols if s in self.numbers]
        n, rank = len(ids), self.rank
        heap = [(*rank[k], i, k) for i in range(n - 1) if (k := ids[i] << 20 | ids[i + 1]) in rank]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = 0
        while heap:
            _, new, i, k = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] << 20 | ids[j] != k:
                continue
            ids[i], ids[j] = new, -1
            merged += 1
            after[i] = x = after[j]
            if x < n:
                before[x] = i
                if (k := new << 20 | ids[x]) in rank:
                    heapq.heappush(heap, (*rank[k], i, k))
            if (p := before[i]) >= 0 and (k := ids[p] << 20 | new) in rank:
                heapq.heappush(heap, (*rank[k], p, k))
        return n - merged

    def count(self, text: str) -> int:
        if not self.split.whole(text):
            return sum(map(self.part.__getitem__, self.split.parts(text)))
        # special strings stand as one token each, and the text between them is cut on its own
        total = 0
        for x in re.split("(" + "|".join(map(re.escape, self.split.special)) + ")", text):
            if x in self.split.special:
                total += 1
            elif _has(x, _ODD):
                total += self._odd(x)
            else:
                total += sum(map(self.part.__getitem__, self.split.parts(x)))
        return total

    def _odd(self, text: str) -> int:
        """A text with separators 28 to 31: the library's own cut decides what is white space, the merges stay ours."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        return sum(self.left(p) for p, _ in self._library.pre_tokenizer.pre_tokenize_str(text) if p)


_loaded: dict = {}


def loaded(kind: type, path: str):
    """One encoder or counter a process, with its cache."""
    sole_cache(f"{kind.__name__} {path}", lambda: _loaded.pop((kind, path), None))
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    Null and empty texts have no bytes and no tokens. Repeated rows repeat; other columns are ignored; very
    long texts and words are counted whole, in time n log n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = loaded(PairCounter, path).count
        for b in slices(batches):
            n = [count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    texts = doc_text(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
