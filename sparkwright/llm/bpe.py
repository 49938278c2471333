"""Word-level byte-pair tokenizers read from a ``tokenizers`` JSON file."""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the split pattern for which the quick splitter below is written.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts made of these characters alone need no Unicode normalisation, and
#: Python's classes agree on them with the library's; any other text is split by
#: the library itself.
_PLAIN = re.compile(r"[^\t\n\r -~¡«»¿À-įĲ-ž–—‘’“”…]")
_SIGN = r"(?:[^\s\w]|_)"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|{_SIGN}+")

#: Words that a task remembers; past it the memory starts anew.
MEMO_WORDS = 250_000
MEMO_IDS = 400_000
#: Longer words are not remembered.
MEMO_CHARS = 64


#: A comma or stop that is no word of its own, as more signs stand before it.
_JOINED = re.compile(rf"[,.](?<={_SIGN}.)\s")


def _chunks(text: str) -> list[str]:
    """What stands between white space.  Commas and stops that end a chunk are
    words of their own and stand apart, so fewer chunks differ."""
    if not _JOINED.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
    return text.split()


class Splitter:
    """Splits texts into the words of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        special = [re.escape(x["content"]) for x in self.spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        kinds = (self.spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.quick = kinds[0].get("pattern") == {"Regex": WORD_PATTERN}

    def plain(self, text: str) -> bool:
        """Whether ``words`` may split the text."""
        return self.quick and not _PLAIN.search(text) and not (self.special and self.special.search(text))

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORDS.findall(text.lower())


@lru_cache(maxsize=4)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies:
    printable Latin-1 stays, the rest follow from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of words by merging: a heap holds the ranks of adjacent
    pairs, a linked list the symbols still alive.  The count is the number of
    first symbols less the merges made; no identifiers come out."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        model = self.splitter.spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.number = {x: k for k, x in enumerate(model["vocab"])}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            head = a[: len(a) - len(self.suffix)] if self.suffix and a.endswith(self.suffix) else a
            self.pairs.setdefault((self.number[a] << 32) | self.number[b], (rank, self.number[head + b]))
        self.letters = byte_letters()
        self.memo: dict[str, int] = {}

    def symbols(self, letters: str) -> list[int]:
        number = self.number
        out = [number[c] for c in letters[:-1]]
        out.append(number[letters[-1] + self.suffix])
        return out

    def merged(self, symbols: list[int]) -> int:
        n, pairs = len(symbols), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0] << 32) | i for i in range(n - 1) if (p := pairs.get((symbols[i] << 32) | symbols[i + 1]))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            p = pairs.get((symbols[i] << 32) | symbols[j])
            if p is None or p[0] != rank:
                continue
            symbols[i], symbols[j] = p[1], -1
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if q := pairs.get((p[1] << 32) | symbols[k]):
                    heapq.heappush(heap, (q[0] << 32) | i)
            h = before[i]
            if h >= 0 and (q := pairs.get((symbols[h] << 32) | p[1])):
                heapq.heappush(heap, (q[0] << 32) | h)
        return n - merges

    def of_word(self, word: str) -> int:
        n = self.memo.get(word)
        if n is None:
            letters = self.letters
            n = self.merged(self.symbols("".join([letters[b] for b in word.encode()])))
            if len(word) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = n
        return n

    def of_text(self, text: str) -> int:
        s = self.splitter
        if s.plain(text):
            words, memo = s.words(text), self.memo
            try:
                return sum(map(memo.__getitem__, words))
            except KeyError:
                return sum(map(self.of_word, words))
        total, at = 0, 0
        for m in [*(s.special.finditer(text) if s.special else ()), None]:
            part = text[at : m.start() if m else len(text)]
            if m:
                total, at = total + 1, m.end()
            if part:
                if s.library.normalizer:
                    part = s.library.normalizer.normalize_str(part)
                for letters, _ in s.library.pre_tokenizer.pre_tokenize_str(part):
                    total += self.merged(self.symbols(letters))
        return total


class WordIds:
    """Identifiers of texts: each distinct word goes to the library once, ids are
    joined from the bytes of what stands between white space, two for each id where the vocabulary allows it,
    else four (little-endian)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.splitter = s = Splitter(path)
        self.wide = s.library.get_vocab_size() > 1 << 16
        self.memo: dict[str, bytes] = {}
        # The same merges for words that are split and in lower case already.
        model = s.spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=model.get("end_of_word_suffix") or ""))
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # Where the vocabulary marks ends of words, many words go as one text.
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(s.library.get_vocab(with_added_tokens=True).values()) + 1, bool) if suffix else None
        for piece, k in model["vocab"].items() if suffix else ():
            self.ends[k] = piece.endswith(suffix)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("I" if self.wide else "H", ids).tobytes()

    def _of_words(self, words: list[str]) -> list[bytes]:
        if self.ends is None:
            return [self._bytes(e.ids) for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        out: list[bytes] = []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            ids = np.array(self.words.encode(" ".join(part), add_special_tokens=False).ids, "<u4" if self.wide else "<u2")
            raw, width = ids.tobytes(), ids.itemsize
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(stops) != len(part):
                raise ValueError("the vocabulary does not mark each word's end once")
            out += [raw[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without special tokens added."""
        s, memo = self.splitter, self.memo
        split = [_chunks(t.lower()) if s.plain(t) else None for t in texts]
        seen = set().union(*[w for w in split if w])
        fresh = seen.difference(memo)
        if len(memo) + len(fresh) > MEMO_IDS:  # what these texts share with those before stays
            self.memo = memo = {w: memo[w] for w in seen.intersection(memo)}
        parts = {c: _WORDS.findall(c) for c in fresh}
        words = list(set().union(*parts.values()).difference(memo))
        memo.update(zip(words, self._of_words(words)))
        for c, w in parts.items():
            if len(w) != 1:
                memo[c] = b"".join(map(memo.__getitem__, w))
        out = [b"".join(map(memo.__getitem__, w)) if w is not None else self._bytes(s.library.encode(t, add_special_tokens=False).ids) for t, w in zip(texts, split)]
        for c in fresh:
            if len(c) > MEMO_CHARS:
                for w in (c, *parts[c]):
                    memo.pop(w, None)
        return out


@lru_cache(maxsize=4)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
