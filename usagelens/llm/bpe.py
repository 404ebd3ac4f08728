"""BPE encoding and decoding: a backtracking encoder, and an offset table for decoding.

Text is cut by the tokenizer's own rules (added tokens first, then the byte-level pattern). Each
piece is encoded left to right: an Aho-Corasick pass finds the longest token that starts at each
byte; a token may follow another only if the pair-compatibility test says that merging, in rank
order, would leave the two side by side; where none fits, the encoder steps back and takes the
next shorter one. Each position is given up at most once, so the work is linear, and the result
is exactly that of merging by rank. Decoding gathers byte ranges by a table of token offsets.

Spark deals the documents; tasks encode Arrow batches. Words and pieces recur, so a task keeps the
ids of the last ones of up to LONGEST characters, as many as take PIECE_BYTES and WORD_BYTES (a full
table is put aside and read until the next is full), until it ends: a worker that waits for its next
task, maybe beside another stage's, holds the vocabulary only. Results don't depend on it. The
vocabulary (1.5 MB, fixed by the tokenizer file) is broadcast.

Defined results: a null text counts as empty and has no tokens; repeated rows are each encoded;
an empty table gives an empty result; texts of any length are encoded whole; extra columns are
ignored by `encode`.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Longer words and pieces seldom recur and are not kept.
LONGEST = 64
#: What a table of pieces or of words may hold, and what an entry takes besides its contents.
PIECE_BYTES, WORD_BYTES, ENTRY = 30_000_000, 80_000_000, 190
PAIRS = 250_000
NOTHING: dict[int, bool] = {}
TOKENIZER = "byte_bpe_50k.json"
#: Letters up to this one are letters in every version of Unicode; these marks at a word's end are pieces of their own.
LATIN, STOPS = "\u024f", frozenset(".,;:!?")
#: Fixed value: the byte-level cutting pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in such files, turned round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one tokenizer file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE tokenizer without prefix space is needed")
        if spec["normalizer"] or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("normalizers, unknown tokens and ignored merges are not served")
        to_byte = byte_of_char()
        raw = lambda s: "".join(chr(to_byte[c]) for c in s)  # noqa: E731  bytes as characters 0 to 255
        ids = {raw(k): v for k, v in model["vocab"].items()}
        #: rank of each token (single bytes below all merges), its halves, the rank of each pair
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in ids.values()}
        for n, pair in enumerate(model["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            one, a, b = ids[left + right], ids[left], ids[right]
            self.merged.setdefault((a, b), n)
            if self.rank[one] < 0:
                self.rank[one], self.halves[one] = n, (a, b)
        usable = {t: i for t, i in ids.items() if len(t) == 1 or i in self.halves}
        self.sizes, self.shorter = [0] * (max(ids.values()) + 1), [None] * (max(ids.values()) + 1)
        for t, i in usable.items():
            self.sizes[i] = len(t)
            self.shorter[i] = next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), None)
        self.search = ahocorasick.Automaton()
        for t, i in usable.items():
            if len(t) > 1:
                self.search.add_word(t, (i, len(t) - 1))
        self.search.make_automaton()
        #: tokens of one byte: what starts at a byte if no longer one does
        self.single = [ids.get(chr(b), 0) for b in range(256)].__getitem__
        #: compatible pairs as far as they have come up; nothing goes before a first token
        self.none_before = {i: True for i in usable.values()}
        self.follows: dict[int, dict[int, bool]] = {-1: self.none_before}
        self.n_pairs = 0
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word ends are not served")
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cut = regex.compile(PATTERN)
        words = {i: t.encode("latin-1") for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.blob = np.frombuffer(b"".join(words.get(i, b"") for i in range(max(words) + 1)), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(words.get(i, b"")) for i in range(max(words) + 1)])])
        self.forget()
        self.narrow = len(self.offsets) <= 1 << 16
        self.told = [str(i) for i in range(len(self.offsets) - 1)]

    def forget(self) -> None:
        """Empties the tables of pieces and words."""
        self.cache: dict[str, bytes] = {}
        self.old_cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.held_pieces = self.held_words = 0

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave these two tokens side by side.

        Both are undone merge by merge, latest first. Whenever the tokens that meet at the border
        could have merged before the merge undone last, the border would not have survived.
        """
        a, b, ok = left, right, True
        # a merge over the border counts if it comes before `bound`, the rank undone last; on
        # equal rank the one further left comes first
        bound = len(self.merged) + 1
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < bound:
                ok = False
                break
            x, y = self.rank[a], self.rank[b]
            if x < 0 and y < 0:
                break
            if x > y:
                bound, a = x, self.halves[a][1]
            else:
                bound, b = y + 1, self.halves[b][0]
        self.follows.setdefault(left, {})[right] = ok
        self.n_pairs += 1
        return ok

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(data)
        longest = [*map(self.single, data), 0]
        for end, (token, back) in self.search.iter(data.decode("latin-1")):
            longest[end - back] = token  # of matches with one start, longer ones end later
        sizes, follows, shorter = self.sizes, self.follows, self.shorter
        last, token = -1, longest[0]
        after = follows[-1]  # what may follow the last token, as far as known
        out: list[int] = []
        shut = None  # positions given up
        at = 0
        while at < n:
            ok = after.get(token)
            if ok is None:
                ok = self.compatible(last, token)
                after = follows[last]
            if ok:
                end = at + sizes[token]
                if shut is None or not shut[end]:
                    out.append(token)
                    last, at, token, after = token, end, longest[end], follows.get(token, NOTHING)
                    continue
            token = shorter[token]
            if token is None:
                if shut is None:
                    shut = bytearray(n + 1)
                shut[at] = 1
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                after = follows.get(last, NOTHING)
        return out

    def known(self, piece: str) -> bytes:
        found = self.cache.get(piece) or self.words.get(piece) or self.old_words.get(piece)
        if not found:
            found = self.old_cache.get(piece)
            if found is None:
                found = self.fresh(piece)
            if len(piece) <= LONGEST:
                self.held_pieces += ENTRY + 4 * len(piece) + len(found)
                if self.held_pieces > PIECE_BYTES:
                    self.cache, self.old_cache, self.held_pieces = {}, self.cache, 0
                self.cache[piece] = found
        return found

    def fresh(self, piece: str) -> bytes:
        if self.n_pairs >= PAIRS:
            self.follows, self.n_pairs = {-1: self.none_before}, 0
        return array("i", self.piece(piece.encode())).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word with the space before it, or of a line end: these are cut alike wherever they stand."""
        found = self.words.get(word)
        if found is not None:
            return found
        found = self.old_words.get(word)
        if found is None:
            stem = word[1:] if word[:1] == " " else word
            if stem.isalpha() and (stem.isascii() or max(stem) <= LATIN):  # one piece, kept among the words only
                found = self.cache.get(word) or self.fresh(word)
            elif stem[-1:] in STOPS and stem[:-1].isalpha() and max(stem) <= LATIN:  # two pieces, whatever comes after
                found = self.known(word[:-1]) + self.known(word[-1])
            else:
                get = self.known
                found = b"".join([get(p) for p in self.cut.findall(word)])
        if len(word) <= LONGEST:
            self.held_words += ENTRY + 4 * len(word) + len(found)
            if self.held_words > WORD_BYTES:
                self.words, self.old_words, self.held_words = {}, self.words, 0
            self.words[word] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        """Ids of the text as 32-bit integers."""
        if self.cut_added is not None and self.cut_added.search(text):
            parts = self.cut_added.split(text)
            return b"".join([array("i", [self.added[p]]).tobytes() if p in self.added else self.encode_bytes(p) for p in parts])
        if "\x00" in text or " ".join(text.split()) != text.replace("\n", " "):
            get = self.known  # other white space than single spaces and line ends, or some at an end
            return b"".join([get(p) for p in self.cut.findall(text)])
        # a table put aside within a text is still looked at first, the new one in `word`
        get, word = self.words.get, self.word
        return b"".join([get(w) or word(w) for w in text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        first = self.offsets[ids]
        sizes = self.offsets[ids + 1] - first
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(first - (ends - sizes), sizes)
        return self.blob[where].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_LOADED: dict[str, Bpe] = {}


def loaded(content: str) -> Bpe:
    """The coder of this content, made once in a Python worker."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(content)
    return _LOADED[key]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def content_of(spark: SparkSession, path: str | None):
    """Broadcast of the file's content, read by the driver: its size is fixed by the tokenizer."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, the two checksums, the ids as little-endian 32-bit integers, and the columns `carry`."""
    content = content_of(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(content.value)
        told = bpe.told
        for batch in batches:
            counts, sums, back, packed = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = bpe.encode_bytes(text or "")
                ids = np.frombuffer(data, dtype=np.int32)
                counts.append(len(ids))
                sums.append(hashlib.sha256(",".join([told[i] for i in ids.tolist()]).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
                packed.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string()), pa.array(packed, pa.binary()), *batch.columns[2:]],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", *carry],
            )
        bpe.forget()

    kinds = dict(docs.dtypes)
    more = "".join(f", {c} {kinds[c]}" for c in carry)
    return docs.select("doc_id", "text", *carry).mapInArrow(
        run, f"doc_id {kinds['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary{more}"
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
