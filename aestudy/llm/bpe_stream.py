"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Sufficient lookahead. Let two strings share a prefix of n symbols, and apply the merges in rank
order to both. Both have a common token boundary at n at first. A merge (u, v) can move the last
common boundary to the left only where u is the last common symbol and v stands right of the
boundary in just one of the strings; then the boundary moves by the length of u, and what stands
right of it begins with u in both strings. So the next merge that moves it has a right part that
begins with u, and a higher rank. The longest chain of such merges, weighted by the lengths of their
left parts, bounds how far the boundary moves: tokens that end that many symbols before the end of
what has been read are final. ``lookahead`` computes the chain in one pass over the merge list.

A boundary that no merge crosses separates the string into parts that are encoded independently, so
the transducer drops what it has emitted and goes on with the rest: it holds one window and the
lookahead, whatever the length of a word. Words are cut first (a pre-tokenizer piece never spans
ASCII white space), and a bounded memory of frequent stretches saves encoding them again.

The decoder is a state machine over identifiers: it emits the text of complete UTF-8 sequences and
keeps at most three bytes of an incomplete one. Null texts are empty; empty texts have no tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from aestudy.llm.common import keyed_texts
from aestudy.llm.tokens import byte_letters

WINDOW = 256
LONGEST_KEPT = 64
MOST_KEPT = 150_000
#: Fixed value: characters with the White_Space property.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = 1 << 60


class Recent:
    """A bounded memory of two generations: when the newer is full it becomes the older."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value



def lookahead(merges: list[tuple[str, str]], end: str) -> int:
    """Symbols after which a token can't change any more; ``end`` marks a word's end and has no length."""
    best: dict[str, int] = {}
    most = 0
    for left, right in merges:
        plain = right.removesuffix(end) if end else right
        behind = max((best.get(right[:i], 0) for i in range(1, len(plain) + 1)), default=0)
        reach = len(left) + behind
        best[left] = max(best.get(left, 0), reach)
        most = max(most, reach)
    return most


class WordTransducer:
    """Encodes one word at a time, given in parts of any length."""

    def __init__(self, ranks: dict[tuple[str, str], int], vocab: dict[str, int], end: str, ahead: int) -> None:
        self.ranks, self.vocab, self.end, self.ahead = ranks, vocab, end, ahead
        self.buffer = ""

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges."""
        rank = self.ranks.get
        order = [rank(pair, NONE) for pair in zip(symbols, symbols[1:])]
        while order:
            best = min(order)
            if best == NONE:
                break
            i = order.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank((symbols[i - 1], symbols[i]), NONE)
            if i < len(order):
                order[i] = rank((symbols[i], symbols[i + 1]), NONE)
        return symbols

    def feed(self, letters: str) -> Iterator[int]:
        """Tokens that are final once these letters have been read; the word goes on."""
        for at in range(0, len(letters), WINDOW):
            self.buffer += letters[at : at + WINDOW]
            if len(self.buffer) < WINDOW + self.ahead:
                continue
            final = len(self.buffer) - self.ahead
            done = 0
            for token in self.merged(list(self.buffer)):
                if done + len(token) > final:
                    break
                done += len(token)
                yield self.vocab[token]
            self.buffer = self.buffer[done:]

    def finish(self) -> Iterator[int]:
        """The rest of the word."""
        if self.buffer:
            symbols = list(self.buffer)
            symbols[-1] += self.end
            self.buffer = ""
            yield from (self.vocab[t] for t in self.merged(symbols))


class StreamTokenizer:
    """A tokenizer file with word ends: compose, lower-case, cut into words, merge."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ahead = lookahead(merges, self.end)
        self.words = WordTransducer({m: i for i, m in enumerate(merges)}, self.vocab, self.end, self.ahead)
        self.letter = {b: c for c, b in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = regex.compile(pattern.replace(r"\s", SPACE) if "[^" in pattern else pattern)
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.token_bytes = {i: t.encode() for i, t in self.token.items()}
        self.known = Recent(MOST_KEPT)
        self.known_words = Recent(MOST_KEPT)

    def word(self, word: str) -> bytes:
        found = self.known_words.get(word)
        if found is None:
            letters = "".join(map(self.letter.__getitem__, word.encode()))
            ids = [*self.words.feed(letters), *self.words.finish()]
            found = np.array(ids, dtype="<u4").tobytes()
            if len(word) <= LONGEST_KEPT:
                self.known_words.put(word, found)
        return found

    def stretch(self, text: str) -> bytes:
        """Identifiers of a text without ASCII white space, or of any whole text."""
        out = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            else:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += map(self.word, self.cut.findall(plain))
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit identifiers of a UTF-8 text."""
        out = []
        for part in text.split():
            ids = self.known.new.get(part)
            if ids is None:
                ids = self.known.get(part)
                if ids is None:
                    ids = self.stretch(part.decode())
                    if len(part) <= LONGEST_KEPT:
                        self.known.put(part, ids)
            out.append(ids)
        return b"".join(out)


class TokenJoiner:
    """Incremental decoding as the file has it without a decoder: the tokens' own letters, one space between."""

    def __init__(self, tokenizer: StreamTokenizer) -> None:
        self.bytes_of = tokenizer.token_bytes
        self.started = False

    def feed(self, ids: Iterable[int]) -> bytes:
        text = b" ".join(map(self.bytes_of.__getitem__, ids))
        if text and self.started:
            text = b" " + text
        self.started = self.started or bool(text)
        return text


class ByteDecoder:
    """Incremental decoding to plain text: letters back to bytes, word ends to spaces, bytes to UTF-8."""

    def __init__(self, tokenizer: StreamTokenizer) -> None:
        self.byte = byte_letters()
        self.tokenizer = tokenizer
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        out = bytearray()
        for i in ids:
            token = self.tokenizer.token[i]
            if token in self.tokenizer.special:
                out += token.encode()
                continue
            plain = token.removesuffix(self.tokenizer.end)
            out += bytes(self.byte[c] for c in plain)
            if plain != token:
                out += b" "
        return self.state.decode(bytes(out), last)


@lru_cache(maxsize=2)
def stream_tokenizer(path: str) -> StreamTokenizer:
    return StreamTokenizer(path)


#: Identifiers that are decoded at once.
DECODE_BLOCK = 1 << 16


def encode_texts(docs: DataFrame, tokenizer: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded, or with ``digests`` the SHA-256 of both in their place."""
    rows = keyed_texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    ends = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = stream_tokenizer(tokenizer)
        for batch in batches:
            counts, ids_out, decoded_out = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                packed = own.encode(text.as_py())
                ids = np.frombuffer(packed, dtype="<u4")
                joiner = TokenJoiner(own)
                decoded = (joiner.feed(ids[a : a + DECODE_BLOCK].tolist()) for a in range(0, len(ids), DECODE_BLOCK))
                counts.append(len(ids))
                if digests:
                    ids_out.append(hashlib.sha256(packed).hexdigest())
                    digest = hashlib.sha256()
                    for part in decoded:
                        digest.update(part)
                    decoded_out.append(digest.hexdigest())
                else:
                    ids_out.append(ids.astype(np.int32))
                    decoded_out.append(b"".join(decoded).decode())
            third = pa.array(ids_out, pa.string() if digests else pa.list_(pa.int32()))
            columns = [batch.column(0), pa.array(counts, pa.int64()), third, pa.array(decoded_out, pa.string())]
            names = ["doc_id", "n_tokens", *(f.split()[0] for f in ends.split(", "))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, {ends}")
