"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words that were not met before are inserted into a trie whose nodes are
prefixes. Every prefix of a BPE encoding is itself the encoding of the text it covers,
so one state a node is enough: the last token of its prefix. A depth-first walk finds
it from the states of shorter prefixes: it is the one vocabulary entry ending there
that may follow the last token of what precedes it. Shared prefixes are thus encoded
once, and a word's tokens are read off by following last tokens back. The trie is held
as the words in order, each with the length it shares with the one before: that order
is the walk's, so the states of one path are all that is kept of the nodes.

A worker's memory is bounded by bytes: texts are encoded in runs of ``RUN`` characters,
and what is known about words and tokens is dropped beyond ``KNOWN``, ``STEPS`` and ``PAIRS``.

Texts are split into words as the tokenizer file says (NFC, blanks, lower case, the
word pattern). Common Latin text is split here; anything else goes through the
library's own normaliser and pre-tokenizer, never through its model.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import batch_limits, free_name

END = "</w>"
#: Stands for END inside the trie: one symbol that no word holds.
STOP = "\n"
#: Characters of text encoded at once; a longer text is cut at blanks.
RUN = 1 << 20
#: About as many bytes of encoded words are kept between runs in a Python worker. When
#: there are more, those of the last such span are kept for one more.
KNOWN = 24 << 20
#: Steps and token pairs (of about 200 bytes each) kept by the trie's walk.
STEPS, PAIRS = 60_000, 120_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Trie:
    """Encodes words (strings of byte symbols) of a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocab
        if max(vocab.values(), default=0) >= 1 << 20:
            raise ValueError("too many tokens")
        self.rank: dict[int, int] = {}  # of a pair, left << 20 | right
        self.parts: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if made in self.parts:
                raise ValueError("two merges make the same token")
            if self.made(left) > k or self.made(right) > k:
                raise ValueError("a merge comes before its parts")
            self.parts[made] = (left, right)
            self.rank[left << 20 | right] = k
        # Tokens that encode as themselves: their halves do, and may stand side by side until the last merge.
        whole = {x for t, x in vocab.items() if len(t.removesuffix(END)) == 1}
        for k, (a, b) in enumerate(merges):
            if vocab[a] in whole and vocab[b] in whole and self.apart(vocab[a], vocab[b], k):
                whole.add(vocab[a + b])
        self.tokens = {t.removesuffix(END) + STOP if t.endswith(END) else t: x for t, x in vocab.items() if x in whole}
        self.ordered = sorted(self.tokens)
        self.forget()

    def made(self, token: int) -> int:
        """The rank of the merge that makes a token; -1 for a symbol."""
        pair = self.parts.get(token)
        return -1 if pair is None else self.rank[pair[0] << 20 | pair[1]]

    def forget(self) -> None:
        self.states: dict[str, tuple[str, list]] = {}
        self.steps: dict[str, tuple[str, list]] = {}
        self.follows: dict[int, dict[int, bool]] = {}
        self.pairs = 0

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols that are in turn the token's first (0) or last (1), each with the rank that ends it."""
        out: list[tuple[int, float]] = []
        until = float("inf")
        while True:
            out.append((token, until))
            pair = self.parts.get(token)
            if pair is None:
                return out
            until, token = self.rank[pair[0] << 20 | pair[1]], pair[side]

    def apart(self, left: int, right: int, below: float = float("inf")) -> bool:
        """Whether no merge of a rank under ``below`` crosses the border of two tokens.

        Merges apply in the order of rank, equal ones from the left: on a tie the pair
        inside ``left`` goes first and the one inside ``right`` comes too late.
        """
        edge = self.spine(right, 0)
        for x, x_until in self.spine(left, 1):
            for y, y_until in edge:
                rank = self.rank.get(x << 20 | y)
                if rank is not None and rank < below and rank < x_until and rank <= y_until:
                    return False
        return True

    def begins(self, text: str) -> bool:
        """Whether a token begins with ``text``."""
        at = bisect_left(self.ordered, text)
        return at < len(self.ordered) and self.ordered[at].startswith(text)

    def step(self, text: str) -> tuple[str, list]:
        """For the longest end of the last prefix and one more symbol: the longest end of ``text`` that begins a token, and the tokens ending there.

        Tokens come longest first, each with its length in symbols and what is known
        about tokens before it.
        """
        suffix = next((text[i:] for i in range(len(text)) if self.begins(text[i:])), "")
        state = self.states.get(suffix)
        if state is None:
            last = 2 if suffix.endswith(STOP) else 1
            ends = [(self.tokens[t], len(t) - last + 1, self.follows.setdefault(self.tokens[t], {})) for t in (suffix[i:] for i in range(len(suffix) - last + 1)) if t in self.tokens]
            state = self.states[suffix] = (suffix, ends)
        self.steps[text] = state
        return state

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its tokens, by one walk over the words' trie."""
        if len(self.steps) > STEPS or self.pairs > PAIRS:
            self.forget()
        # The path walked to: for the prefix of d + 1 symbols its state, last token, and that token's symbols.
        path: list[str] = []
        last: list[int] = []
        size: list[int] = []
        before = ""
        steps, get = self.steps, self.steps.get
        for word in sorted(words):
            depth = 0
            for a, b in zip(before[:-1], word[:-1]):
                if a != b:
                    break
                depth += 1
            del path[depth:], last[depth:], size[depth:]
            suffix = path[-1] if depth else ""
            for symbol in (*word[depth:-1], word[-1] + STOP):
                suffix, ends = get(suffix + symbol) or self.step(suffix + symbol)
                for token, n, follows in ends:
                    if n > depth:
                        break
                    left = last[depth - n]
                    fits = follows.get(left)
                    if fits is None:
                        fits = follows[left] = self.apart(left, token)
                        self.pairs += 1
                    if fits:
                        break
                else:
                    raise ValueError(f"no token for {symbol!r}")
                path.append(suffix)
                last.append(token)
                size.append(n)
                depth += 1
            found, at = [], depth - 1
            while at >= 0:
                found.append(last[at])
                at -= size[at]
            yield word, found[::-1]
            before = word


def latin(pattern: str) -> str:
    """The word pattern with its Unicode classes spelled out for the characters up to U+024F."""
    of = lambda kind: "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)
    return pattern.replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N"))


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["end_of_word_suffix"] != END or model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("only plain BPE with word ends")
        self.trie = Trie(model["vocab"], [tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.borders = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # The library's own splitting, without its model.
        library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        #: Any character for which the short way of words() may differ from the library.
        self.unusual = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]")
        self.word = re.compile(latin(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]))
        self.symbols = byte_symbols()
        self.bytes = {s: b for b, s in enumerate(self.symbols)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # about the bytes of ``known``

    def words(self, text: str) -> list[str]:
        """The words that are encoded on their own, and special tokens."""
        if not self.unusual.search(text) and "<|" not in text:
            return self.word.findall(text.lower())
        out = []
        for part in self.borders.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                part = self.normalizer.normalize_str(part)
                out.extend(bytes(map(self.bytes.__getitem__, w)).decode("utf-8") for w, _ in self.pre_tokenizer.pre_tokenize_str(part))
        return out

    def learn(self, fresh: set[str]) -> None:
        """Encode words that are not known yet."""
        known, spelled = self.known, {}
        for w in fresh:
            if w in self.special:
                known[w] = struct.pack("<I", self.special[w])
            elif w in self.older:
                known[w] = self.older[w]
            else:
                spelled[w if w.isascii() and w.isprintable() else "".join(map(self.symbols.__getitem__, w.encode("utf-8")))] = w
        for symbols, ids in self.trie.encode(spelled):
            known[spelled[symbols]] = struct.pack(f"<{len(ids)}I", *ids)
        self.held += sum(200 + len(w) + len(known[w]) for w in fresh)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for run in runs(texts, RUN):
            split = [(i, self.words(piece)) for i, piece in run]
            known = self.known
            self.learn({w for _, ws in split for w in ws if w not in known})
            for i, ws in split:
                out[i].append(b"".join(map(known.__getitem__, ws)))
            if self.held > KNOWN:
                self.known, self.older, self.held = {}, known, 0
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces, special tokens included: the file names no decoder."""
        import numpy as np

        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Where a text may be cut without changing its words: before a blank that a plain character follows.
_CUT = re.compile(r" (?=[A-Za-z0-9])")


def runs(texts: list[str], size: int = RUN) -> Iterator[list[tuple[int, str]]]:
    """Runs of about ``size`` characters: the texts, or pieces of longer ones, with their numbers."""
    run, held = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > size:
            cut = _CUT.search(text, at + size)
            end = cut.start() if cut else len(text)
            run.append((i, text[at:end]))
            yield run
            run, held, at = [], 0, end
        run.append((i, text[at:] if at else text))
        held += len(text) - at
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for each Python worker and file."""
    return Codec(path)


def encoded(text: Column, path: str | None = None) -> Column:
    """struct<ids: binary, decoded: string> of a text column, ids packed as little-endian unsigned 32-bit integers; a null text is empty."""
    path = path or default_path()

    @arrow_udf("ids binary, decoded string")
    def run(texts: pa.Array) -> pa.Array:
        own = codec(path)
        ids = own.encode([t or "" for t in texts.to_pylist()])
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())], ["ids", "decoded"])

    return run(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of packed ids; null stays null."""
    path = path or default_path()

    @arrow_udf("string")
    def run(packed: pa.Array) -> pa.Array:
        return pa.array([None if x is None else codec(path).decode(x) for x in packed.to_pylist()], pa.string())

    return run(ids)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (binary), ``n_tokens`` (long) and ``decoded`` (string).

    Columns of these names are replaced, all others kept. Null and empty texts give
    no ids and an empty decoded text; every row is kept; no table is too empty.
    Nothing is shuffled: words are shared within a run and a worker's cache.
    """
    batch_limits(docs.sparkSession)
    both = free_name(docs, "both")
    rows = docs.withColumn(both, encoded(F.col(text_col), path))
    return rows.withColumns({"ids": F.col(both)["ids"], "n_tokens": (F.octet_length(F.col(both)["ids"]) / 4).cast("long"), "decoded": F.col(both)["decoded"]}).drop(both)


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` gives."""
    return rows.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
