"""Exact BPE encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton finds every token in a word in one pass. The encoder
takes the longest token at each place and accepts it only if it may follow the last
one: a pair is compatible if no merge across its border would come before the
merges that made the two tokens. Otherwise it tries the next shorter token, or steps
back. Each position is ruled out at most once, so the work is linear in the word,
and the result equals merging pairs by rank.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from pathlib import Path
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from accesspanel.llm.common import held, per_slice, text_rows

#: Words whose tokens a worker remembers; it forgets all of them beyond that.
REMEMBERED_WORDS = 600_000
#: Separators that str.split takes and the pre-tokenizer does not.
NOT_SPACES = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file: a byte-level BPE model whose words
    end in a suffix, with NFC, white space and case folding before it."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.split = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_letters()))
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self._table(vocab)
        self._offsets({**vocab, **self.special})
        self._pairs(vocab, model["merges"])
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.parts_known: dict[str, tuple[bytes, bytes]] = {}

    def _symbols(self, token: str) -> str:
        """A token with its last letter and the suffix as one letter of another plane."""
        if self.suffix and token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(0x10000 + ord(token[-1]))
        return token

    def _table(self, vocab: dict[str, int]) -> None:
        self.ids = {self._symbols(t): i for t, i in vocab.items()}
        self.length = [0] * (max(vocab.values()) + 1)
        #: The longest shorter token that a token starts with, or -1.
        self.shorter = [-1] * len(self.length)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, (i, len(token) - 1))
            self.length[i] = len(token)
            self.shorter[i] = next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)
        self.automaton.make_automaton()

    def _offsets(self, vocab: dict[str, int]) -> None:
        """All tokens end to end, and where each starts."""
        named = sorted((i, t.encode()) for t, i in vocab.items())
        sizes = np.zeros(named[-1][0] + 2, np.int64)
        for i, t in named:
            sizes[i + 1] = len(t)
        self.offset = np.cumsum(sizes).tolist()
        self.blob = b"".join(t for _, t in named)

    def _pairs(self, vocab: dict[str, int], merges: list) -> None:
        """Age of each token (its merge's rank; letters come first), the pair it was
        made of and the token each pair makes."""
        self.age: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[left], vocab[right]
            token = vocab[left + right]
            if pair not in self.made:
                self.made[pair] = token
            if token not in self.parts:
                self.parts[token] = pair
                self.age[token] = rank
        for token in vocab.values():
            if token not in self.age:
                self.age[token], self.parts[token] = -1, (token, token)
        self.compatible = lru_cache(maxsize=1 << 18)(self._compatible)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a border between the two tokens. Undoes the
        younger of the two merges next to the border, step by step, and looks for a
        pair that would have merged across it before."""
        age, parts, made = self.age, self.parts, self.made
        limit = (len(age), 0)
        while True:
            across = made.get((left, right))
            # a merge of the same rank to the left of the border comes first
            if across is not None and (age[across], 0) < limit:
                return False
            if age[left] < 0 and age[right] < 0:
                return True
            if age[left] > age[right]:
                limit = (age[left], 0)
                left = parts[left][1]
            else:
                limit = (age[right], 1)
                right = parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Tokens of a pre-split word (bytes written as letters)."""
        if self.suffix:
            word = word[:-1] + chr(0x10000 + ord(word[-1]))
        n = len(word)
        longest = [-1] * (n + 1)
        # ends come in rising order, so the last token noted for a start is its longest
        for end, (token, before) in self.automaton.iter(word):
            longest[end - before] = token
        length, shorter, compatible = self.length, self.shorter, self.compatible
        tokens: list[int] = []
        dead = bytearray(n + 1)
        place, token = 0, longest[0]
        while place < n:
            while token >= 0:
                end = place + length[token]
                if not dead[end] and (not tokens or compatible(tokens[-1], token)):
                    tokens.append(token)
                    place = end
                    token = longest[place]
                    break
                token = shorter[token]
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks a letter")
                dead[place] = 1
                token = tokens.pop()
                place -= length[token]
                token = shorter[token]
        return tokens

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """Ids of what lies between two white spaces as little-endian integers, and
        the same decoded. No word crosses white space, nor does NFC."""
        codes, decoded = [], []
        for part in self.split_words(word):
            got = self.parts_known.get(part)
            if got is None:
                ids = self.encode_word(part if part.isascii() and part.isprintable() else "".join(map(self.letters.__getitem__, part.encode())))
                got = self.parts_known[part] = pack(f"<{len(ids)}I", *ids), self.decode(ids)
            codes.append(got[0])
            decoded.append(got[1])
        got = self.words[word] = b"".join(codes), b" ".join(decoded)
        if len(self.words) + len(self.parts_known) >= REMEMBERED_WORDS:
            self.words, self.parts_known = {}, {}
        return got

    def decode(self, ids: list[int]) -> bytes:
        """The tokens, separated by spaces (the vocabulary names no decoder), as UTF-8."""
        o, blob = self.offset, self.blob
        return b" ".join([blob[o[i] : o[i + 1]] for i in ids])

    def split_words(self, text: str) -> list[str]:
        if text.isascii():
            return self.split.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # one letter at a time, so a final sigma is a sigma like any other
        return self.split.findall(text.replace("Σ", "σ").lower())

    def encode_and_decode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a whole text (little-endian unsigned 32-bit) and the text decoded from them."""
        pairs, start = [], 0

        def plain(part: str) -> None:
            for word in [part] if NOT_SPACES.search(part) else part.split():
                pairs.append(self.words.get(word) or self._word(word))

        for found in self.special_split.finditer(text):
            plain(text[start : found.start()])
            token = self.special[found.group()]
            pairs.append((np.array([token], "<u4").tobytes(), self.decode([token])))
            start = found.end()
        plain(text[start:] if start else text)
        return b"".join([p[0] for p in pairs]), b" ".join([p[1] for p in pairs if p[0]])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_and_decode(text)[0], "<u4").tolist()


def tokenize(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``n_tokens`` and the SHA-256 of the ids (as
    little-endian unsigned 32-bit integers) and of the text decoded from them.

    ``vocabulary`` is the driver's path of the file; its contents (a fixed size)
    are broadcast. NULL and empty texts have no tokens. Repeated rows are encoded
    each. No rows: none."""
    spark: SparkSession = docs.sparkSession
    spec = spark.sparkContext.broadcast(Path(vocabulary).read_text())

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = held(("bpe", spec.value), lambda: Bpe(spec.value))
        coded = [bpe.encode_and_decode(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(ids) // 4 for ids, _ in coded], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in coded], pa.string()),
                pa.array([hashlib.sha256(decoded).hexdigest() for _, decoded in coded], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return text_rows(docs, doc_id, text).mapInArrow(
        per_slice(hashed), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
