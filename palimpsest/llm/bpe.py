"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

The last token of a prefix's encoding is a function of the prefix alone: it is the one vocabulary
entry ``t`` ending there whose pairing with the last token of the shortened prefix survives merging.
So the words of a block are put into one trie, every trie node gets its last-token state from its
ancestors, and words that share a prefix share the work. Reading the states backwards gives the ids.

Defined results: a null text counts as empty (no ids, empty decoding). Null ids pass through,
repeated rows are encoded one by one, other columns are ignored. Special tokens inside texts become
their ids, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices
from palimpsest.session import ship, spread, table

#: Words of one generation of the store of encodings. A full generation becomes the old one, whose words
#: move on when they are met again, and the old one before it goes: memory is bounded, frequent words stay.
CACHE_WORDS = 100_000
#: Pairs of tokens whose merging a worker remembers, and moves of the automaton.
CACHE_PAIRS = 300_000
#: Texts whose distinct words make one trie.
TRIE_TEXTS = 512
#: Bytes from which a word is walked alone, without nodes.
LONG_WORD = 1024
END, WORD_END = "</w>", 256


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder for one tokenizer file of the kind "BPE with word ends"."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.letters = byte_letters()
        self.words = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        # The vocabulary as one automaton (Aho-Corasick): after each byte its place tells the vocabulary entries that
        # end there, the longest first. WORD_END is a symbol of its own.
        back = {c: b for b, c in self.letters.items()}
        self.step: dict[int, int] = {}
        self.entry: list[str | None] = [None]
        depth, above = [0], [(0, 0)]
        for token in self.vocab:
            ends = token.endswith(END) and len(token) > len(END)
            at = 0
            for x in [*map(back.__getitem__, token.removesuffix(END) if ends else token), *([WORD_END] if ends else [])]:
                key = at << 9 | x
                there = self.step.get(key)
                if there is None:
                    there = self.step[key] = len(depth)
                    depth.append(depth[at] + 1)
                    above.append((at, x))
                    self.entry.append(None)
                at = there
            self.entry[at] = token
        self.fall, self.next = [0] * len(depth), [0] * len(depth)  # the longest end that starts an entry, or is one
        for place in sorted(range(1, len(depth)), key=depth.__getitem__):
            at, x = above[place]
            fall = 0
            if at:
                fall = self.fall[at]
                while fall and fall << 9 | x not in self.step:
                    fall = self.fall[fall]
                fall = self.step.get(fall << 9 | x, 0)
            self.fall[place] = fall
            self.next[place] = fall if self.entry[fall] is not None else self.next[fall]
        self.first = [place if entry is not None else more for place, (entry, more) in enumerate(zip(self.entry, self.next, strict=True))]
        self.size = [n - (entry is not None and entry.endswith(END) and len(entry) > len(END)) for n, entry in zip(depth, self.entry, strict=True)]
        self.wholes: list[bool | None] = [None] * len(depth)
        self.moves: dict[int, int] = {}

    # -- words ---------------------------------------------------------------------------------

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
        symbols, rank = list(symbols), self.rank.get
        while len(symbols) > 1:
            ranks = [rank(pair, sys.maxsize) for pair in zip(symbols, symbols[1:], strict=False)]
            lowest = min(ranks)
            if lowest == sys.maxsize:
                break
            best = ranks.index(lowest)
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def spelled(self, token: str) -> list[str]:
        """The first symbols of a token: one per letter, the last with the word end if it has one."""
        ends = token.endswith(END) and len(token) > len(END)
        body = list(token.removesuffix(END)) if ends else list(token)
        if ends:
            body[-1] += END
        return body

    def joins(self, left: int, right: int) -> bool:
        """Do the entries of two places stay as they are when they stand side by side?"""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        a, b = self.entry[left], self.entry[right]
        ok = self.pairs[left << 24 | right] = self.merge(self.spelled(a) + self.spelled(b)) == [a, b]
        return ok

    def whole(self, place: int) -> bool:
        """Is a vocabulary entry the encoding of its own spelling?"""
        ok = self.wholes[place] = len(self.merge(self.spelled(self.entry[place]))) == 1
        return ok

    def move(self, at: int, x: int) -> int:
        """The place after one more symbol."""
        place = at
        while place and place << 9 | x not in self.step:
            place = self.fall[place]
        if len(self.moves) > CACHE_PAIRS:
            self.moves.clear()
        there = self.moves[at << 9 | x] = self.step.get(place << 9 | x, 0)
        return there

    def last_token(self, place: int, n: int, states: Sequence[int]) -> int:
        """The last token of a prefix of n bytes that ends at ``place``, from the states of its own prefixes."""
        pairs, wholes, size, more = self.pairs, self.wholes, self.size, self.next
        place = self.first[place]
        while place:
            ok = wholes[place]
            if self.whole(place) if ok is None else ok:
                rest = n - size[place]
                if not rest:
                    return place
                before = states[rest - 1]
                ok = pairs.get(before << 24 | place)
                if self.joins(before, place) if ok is None else ok:
                    return place
            place = more[place]
        raise ValueError("no token ends here")

    def follow(self, at: int, spelled: bytes, begin: int, states: list[int] | array) -> int:
        """Append the states of the prefixes of a word that end at ``begin`` and later, but for the word itself."""
        moves, first, wholes, size, pairs, more = self.moves, self.first, self.wholes, self.size, self.pairs, self.next
        for n in range(begin, len(spelled)):
            key = at << 9 | spelled[n - 1]
            there = moves.get(key)
            at = self.move(at, spelled[n - 1]) if there is None else there
            place = first[at]
            # The body of last_token, as this loop is where the time goes.
            while place:
                ok = wholes[place]
                if self.whole(place) if ok is None else ok:
                    rest = n - size[place]
                    if not rest:
                        break
                    before = states[rest - 1]
                    ok = pairs.get(before << 24 | place)
                    if self.joins(before, place) if ok is None else ok:
                        break
                place = more[place]
            else:
                raise ValueError("no token ends here")
            states.append(place)
        return at

    def tokens_of(self, at: int, spelled: Sequence[int], states: Sequence[int]) -> list[str]:
        """All tokens of a word; ``at`` is the place after all its bytes but the last."""
        n, moves = len(spelled), self.moves
        for x in (spelled[-1], WORD_END):
            there = moves.get(at << 9 | x)
            at = self.move(at, x) if there is None else there
        place = self.last_token(at, n, states)
        tokens, rest = [self.entry[place]], n - self.size[place]
        while rest > 0:
            place = states[rest - 1]
            tokens.append(self.entry[place])
            rest -= self.size[place]
        return tokens[::-1]

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word: insert them into a trie, then walk it depth first.

        A stretch without branches needs no nodes: the rest of a word hangs in place of a node. Words of more
        than ``LONG_WORD`` bytes, which could share as many nodes, are walked alone.
        """
        # A node: {byte: node, -1: word that ends there}; a rest: (bytes of the whole word, place in it, word).
        root: dict = {}
        out: dict[str, list[str]] = {}
        for word in words:
            spelled = word.encode("utf-8", "replace")
            n = len(spelled)
            if n > LONG_WORD:
                alone = array("i")
                out[word] = self.tokens_of(self.follow(0, spelled, 1, alone), spelled, alone)
                continue
            node, at = root, 0
            while at < n:
                there = node.get(spelled[at])
                if there is None:
                    node[spelled[at]] = (spelled, at + 1, word)
                    break
                at += 1
                if type(there) is tuple:  # the rest of another word: its next byte becomes a node
                    other, place, name = there
                    there = node[spelled[at - 1]] = {other[place]: (other, place + 1, name)} if place < len(other) else {-1: name}
                node = there
            else:
                node[-1] = word
        if -1 in root:
            out[root.pop(-1)] = []
        path: list[int] = []
        states: list[int] = []  # states[i]: last token of the first i + 1 bytes, no word end
        # An entry: depth, place before the byte, byte, what hangs there.
        stack: list[tuple[int, int, int, dict | tuple]] = [(0, 0, c, x) for c, x in root.items()]
        moves = self.moves
        while stack:
            depth, at, byte, node = stack.pop()
            del path[depth:], states[depth:]
            if type(node) is tuple:
                spelled, begin, word = node
                at = self.follow(at, spelled, begin, states)
                out[word] = self.tokens_of(at, spelled, states)
                continue
            path.append(byte)
            word = node.pop(-1, None)
            if word is not None:
                out[word] = self.tokens_of(at, path, states)
            if node:
                there = moves.get(at << 9 | byte)
                at = self.move(at, byte) if there is None else there
                states.append(self.last_token(at, depth + 1, states))
                stack.extend((depth + 1, at, c, x) for c, x in node.items())
        return out

    # -- texts ---------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The normalised words of a piece of text without special tokens."""
        if max(text, default="\0") > "\xff":  # beyond Latin-1 the library's own Unicode tables decide
            return self.library_split(text)
        return self.words.findall(text.lower())

    def library_split(self, text: str) -> list[str]:
        back = {c: b for b, c in self.letters.items()}
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(back[c] for c in piece).decode("utf-8", "replace") for piece, _ in cut]

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text in order."""
        if self.specials is None or "<|" not in text or not self.specials.search(text):
            return self.split(text)
        out: list[str] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.split(text[at:])

    def learn(self, words: set[str]) -> None:
        """Add the encodings of words to the store: ids, and tokens joined by a space."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = words - known.keys()
        for word in new & older.keys():
            known[word] = older[word]
        new -= known.keys()
        plain = new - self.special.keys()
        vocab = self.vocab
        for word, tokens in self.encode_words(plain).items():
            known[word] = (" ".join([str(vocab[t]) for t in tokens]), " ".join(tokens))
        for word in new - plain:
            known[word] = (str(self.special[word]), word)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut))
        return [[int(i) for w in c for i in self.known[w][0].split(" ")] for c in cut]

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids joined by a space, which is what a file without a decoder asks for."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def arrays(self, texts: list[str]) -> tuple[list[int], pa.ListArray, list[str]]:
        """n_tokens, ids as one Arrow list array, and decoded_sha256 of each text."""
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut))
        known = self.known
        lines, sizes, decoded = [], [], []
        for words in cut:
            got = [known[w] for w in words]
            ids = " ".join([x[0] for x in got])
            sizes.append(ids.count(" ") + 1 if ids else 0)
            if ids:
                lines.append(ids)
            decoded.append(hashlib.sha256(" ".join([x[1] for x in got]).encode()).hexdigest())
        flat = np.fromstring(" ".join(lines), np.int32, sep=" ") if lines else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return sizes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """n_tokens, ids_sha256 and decoded_sha256 of each text."""
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut))
        known = self.known
        out = []
        for words in cut:
            got = [known[w] for w in words]
            ids = " ".join([x[0] for x in got])
            decoded = " ".join([x[1] for x in got])
            out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The worker's tokenizer for a file, read once."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoding of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or tokenizer_path())
        for part in slices(batches, TRIE_TEXTS):
            n, ids, decoded = zip(*bpe.digests([t or "" for t in part["text"].to_pylist()]), strict=True)
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, ids and decoded_sha256 of every row of ``documents``."""
    ship(docs.sparkSession)
    names = ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or tokenizer_path())
        for part in slices(batches, TRIE_TEXTS):
            n, ids, decoded = bpe.arrays([t or "" for t in part["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["source"].cast(pa.string()), pa.array(n, pa.int64()), ids, pa.array(decoded, pa.string())], names=names)

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, the ids of every text and what they decode to."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or tokenizer_path())
        for part in slices(batches, TRIE_TEXTS):
            ids = bpe.encode_batch([t or "" for t in part["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of documents.

    Null texts count as empty (no tokens, digests of the empty string); null ids pass through; repeated rows
    come out alike; an empty table gives no rows. Other columns are not read.
    """
    return digest_tokens(spread(table(spark, sf_dir, "documents")))
