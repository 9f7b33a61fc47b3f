"""Byte-level BPE encoding and decoding over Arrow batches."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusquery.llm.arrow import append_columns, strings

# Chunks whose ids a worker remembers, and the length beyond which it does not.
REMEMBERED_CHUNKS = 200_000
MAX_REMEMBERED_LENGTH = 48

# A single space between two other characters always starts a match of the
# split patterns of these vocabularies, so texts can be cut there.
CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from
    U+0100 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own = set(printable)
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    """A byte-level tokenizer that merges like a rank file says.

    A pair may merge whenever it forms a token, and the lowest rank goes first;
    so each token lists all its cuts into two tokens, in the order of ranks.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    of_byte = byte_characters()
    named = {t: "".join(of_byte[b] for b in t) for t in ranks}
    merges = [
        (named[t[:cut]], named[t[cut:]])
        for t in sorted(ranks, key=ranks.get)
        for cut in range(1, len(t))
        if t[:cut] in ranks and t[cut:] in ranks
    ]
    vocabulary = {named[t]: r for t, r in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer


@lru_cache(maxsize=2)
def load_tokenizer(path: str, pattern: str | None = None):
    """A tokenizer from a ``.json`` or rank file; strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    if path.endswith(".json"):
        tokenizer = Tokenizer.from_file(path)
    else:
        tokenizer = tokenizer_from_ranks(read_ranks(path), pattern)
    tokenizer.encode_special_tokens = True
    return tokenizer


# The alternative of a split pattern that takes a space and all letters behind it.
LETTERS = r" ?\p{L}+"


def keeps_words(tokenizer, pattern: str | None) -> bool:
    """Whether letters, with or without a space before, are one piece for the merges of a tokenizer.

    So they are for the byte-level splitter of the library and for a pattern with that
    alternative whose others before it start with an apostrophe, unless text is
    normalised first or ordinary words were added to the vocabulary.
    """
    from tokenizers import pre_tokenizers

    if tokenizer.normalizer is not None or not all(t.special for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    if pattern is not None:
        before, found, _ = pattern.partition(LETTERS + "|")
        return bool(found) and all(re.fullmatch("'[a-z]+", p) for p in before.split("|")[:-1]) and before[-1:] in ("", "|")
    split = tokenizer.pre_tokenizer
    return isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space


@lru_cache(maxsize=2)
def token_bytes(path: str, pattern: str | None = None) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = load_tokenizer(path, pattern).get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        # Tokens outside the byte alphabet are not text.
        if all(c in byte_of for c in token):
            table[i] = bytes(byte_of[c] for c in token)
    return table


# Marks that often close a word, and letters and digits of long standing.
CLOSING = ".,;:!?)"
LAST_SETTLED = "\u1fff"


class _Chunks(dict):
    """Ids of chunks as bytes, found by the library once and then remembered.

    None marks a chunk that cannot be cut off at its spaces.  The split patterns
    of these vocabularies always have a border at a single line end between two
    other characters, and between a letter or digit and the mark that ends a
    chunk, so chunks are put together from their parts there.
    """

    def __init__(
        self,
        prefix: str,
        encode: Callable[[str], bytes],
        first: _Chunks | None = None,
        merge: Callable[[str], bytes] | None = None,
    ):
        super().__init__()
        self.prefix, self.encode, self.merge = prefix, encode, merge
        self.first = self if first is None else first
        self.line_end = encode("\n")

    def __missing__(self, chunk: str) -> bytes | None:
        if not chunk or chunk[-1].isspace() or (self.prefix and chunk[0].isspace()):
            return None
        if "\n" in chunk:
            head, *rest = chunk.split("\n")
            if all(p and not p[0].isspace() and not p[-1].isspace() for p in (head, *rest)):
                # Such a chunk hardly occurs again as a whole.
                return self.line_end.join((self[head], *map(self.first.__getitem__, rest)))
        if len(chunk) > 1 and chunk[-1] in CLOSING and chunk[-2].isalnum() and chunk[-2] <= LAST_SETTLED:
            ids = self[chunk[:-1]] + self.first[chunk[-1]]
        elif self.merge is not None and chunk.isalpha() and max(chunk) <= LAST_SETTLED:
            # One piece for the merges, which takes half the time of the whole library.
            ids = self.merge(self.prefix + chunk)
        else:
            ids = self.encode(self.prefix + chunk)
        if len(chunk) <= MAX_REMEMBERED_LENGTH:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of whole texts; the work per text is mostly look-ups of its words."""

    def __init__(self, path: str, pattern: str | None = None, remembered: int = REMEMBERED_CHUNKS):
        tokenizer = load_tokenizer(path, pattern)
        self.remembered = remembered
        self.dtype = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        encode = lambda x: np.array(
            tokenizer.encode(x, add_special_tokens=False).ids, self.dtype
        ).tobytes()
        self.encode = encode
        letters, tokenize, code = byte_characters(), tokenizer.model.tokenize, self.dtype.char

        def merge(word: str) -> bytes:
            return array(code, [t.id for t in tokenize("".join([letters[b] for b in word.encode()]))]).tobytes()

        whole_words = merge if keeps_words(tokenizer, pattern if not path.endswith(".json") else None) else None
        self.first = _Chunks("", encode, merge=whole_words)
        self.spaced = _Chunks(" ", encode, self.first, whole_words)
        self.whole = _Chunks("", encode)

    def raw(self, text: str) -> bytes:
        """Ids of a text, ``dtype`` each, as bytes."""
        if not text:
            return b""
        if len(self.first) + len(self.spaced) + len(self.whole) > self.remembered:
            for chunks in (self.first, self.spaced, self.whole):
                chunks.clear()
        head, *rest = text.split(" ")
        try:
            return b"".join((self.first[head], *map(self.spaced.__getitem__, rest)))
        except TypeError:  # runs of white space, or some at an end
            chunks = CUT.split(text)
            return b"".join(
                ids if (ids := self.whole[c]) is not None else self.encode(c) for c in chunks
            )

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), self.dtype)


def _lists(raws: list[bytes], dtype: np.dtype) -> pa.Array:
    """An Arrow list of ints per entry."""
    values = np.frombuffer(b"".join(raws), dtype).astype(np.int32)
    ends = np.cumsum([0, *(len(r) // dtype.itemsize for r in raws)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def character_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character span of every token, from the byte lengths of the tokens.

    A token that holds a part of a character covers the whole character.
    """
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return character[ends - lengths].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


def encode(
    docs: DataFrame, path: str, pattern: str | None = None, offsets: bool = False, keep_text: bool = False
) -> DataFrame:
    """Add ``ids`` (array<int>) of the whole ``text`` to documents, without special tokens.

    ``path`` is a ``.json`` file of a byte-level tokenizer, or a rank file that
    goes with a split ``pattern``; every executor must have it.  ``offsets``
    adds ``starts`` and ``ends``, the span of every token in characters.  The
    text itself is dropped unless ``keep_text`` is set.

    A null or empty text has no ids.  Repeated rows are encoded alike.  Other
    columns stay, but those named like a result are replaced.
    """

    def make():
        encoder = Encoder(path, pattern)
        sizes = np.array([len(b) for b in token_bytes(path, pattern)])

        def columns(batch):
            texts = strings(batch.column("text"))
            raws = [encoder.raw(t) for t in texts]
            out = [_lists(raws, encoder.dtype)]
            if offsets:
                spans = [
                    character_spans(t, sizes[np.frombuffer(r, encoder.dtype)]) if r else (np.zeros(0, "i4"),) * 2
                    for t, r in zip(texts, raws)
                ]
                out += [_lists([s[k].tobytes() for s in spans], np.dtype("<i4")) for k in (0, 1)]
            return out

        return columns

    ddl = "ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return append_columns(docs, "text", ddl, make, drop=() if keep_text else ("text",))


def decode(tokens: DataFrame, path: str, pattern: str | None = None, as_text: bool = True) -> DataFrame:
    """Turn ``ids`` back into ``bytes`` (binary) and, with ``as_text``, into ``text``.

    The ids may be any slice of a document.  A character that the slice cuts
    is whole in no token; ``bytes`` holds its part as it is, and ``text`` has
    one U+FFFD for it.  Null ids give null, ids outside the vocabulary nothing.
    """

    def make():
        table = token_bytes(path, pattern)
        known, padded = len(table), [*table, b""]

        def columns(batch):
            lists = batch.column("ids")
            ids = pc.fill_null(lists.values, -1).to_numpy(zero_copy_only=False)
            if ids.size and (ids.min() < 0 or ids.max() >= known):
                ids = np.where((ids < 0) | (ids >= known), known, ids)
            ends = lists.offsets.to_numpy()
            data = [
                b"".join(map(padded.__getitem__, ids[a:b].tolist())) if there else None
                for a, b, there in zip(ends, ends[1:], lists.is_valid().to_pylist())
            ]
            out = [pa.array(data, pa.binary())]
            if as_text:
                out.append([None if b is None else b.decode("utf-8", "replace") for b in data])
            return out

        return columns

    return append_columns(
        tokens, "ids", "bytes binary" + (", text string" if as_text else ""), make, drop=("ids",)
    )
