"""BPE encoding by tree concatenation, and decoding.

Long texts are cut into leaves that tasks encode independently. The leaves of a text are then
joined pairwise up a tree. A join re-encodes a window around the seam and keeps the tokens on
both sides of it:

* a place where white space follows another character is a border of the word pattern whatever
  the context, so the window between the nearest such places is encoded exactly by itself;
* a run without such a place near the seam is split into words first, and the one word across
  the seam is joined by windows of tokens that grow until their first and last tokens are the
  tokens found before. Then all neighbouring tokens are pairs that the merges leave apart, which
  makes the sequence the encoding of the whole word.

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows
give repeated results; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.llm.arrays import in_batches, lean, lean_group

LEAF_CHARS = 32_768
#: Seam windows up to this length are encoded whole.
WINDOW_CHARS = 4_096


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE of a tokenizer file (vocabulary, merges, special tokens)."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, kind = spec["model"], spec["pre_tokenizer"]
        plain = (model["type"], kind["type"], spec["normalizer"], kind["add_prefix_space"])
        if plain != ("BPE", "ByteLevel", None, False):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        alphabet = byte_alphabet()
        self.vocabulary = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        made = [model["vocab"]["".join(pair)] for pair in pairs]
        if made != sorted(made):
            raise ValueError("merges must make tokens in the order of their ids")
        # The word pattern of byte-level BPE, a fixed value.
        self.pattern = (
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.words = regex.compile(self.pattern)
        self.core = tiktoken.Encoding(
            "file", pat_str=self.pattern, mergeable_ranks=self.vocabulary, special_tokens={}
        )
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*self.vocabulary.values(), *self.special.values())
        self.bytes = [b""] * size
        for token, i in self.vocabulary.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(t) for t in self.bytes], dtype=np.int64)
        self.digits = [str(i) for i in range(size)]
        names = sorted(self.special, key=len, reverse=True)
        self.cuts = regex.compile("|".join(map(regex.escape, names))) if names else None

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Plain parts of the text, and special tokens with their id."""
        at = 0
        if self.cuts and any(name in text for name in self.special):
            for match in self.cuts.finditer(text):
                if match.start() > at:
                    yield text[at : match.start()], None
                yield match.group(), self.special[match.group()]
                at = match.end()
        if at < len(text):
            yield text[at:], None

    def encode(self, text: str) -> list[int]:
        """Tokens of a whole text; long words are encoded by halves."""
        out: list[int] = []
        for part, special in self.parts(text):
            if special is not None:
                out.append(special)
            elif len(part) <= WINDOW_CHARS or " " in part:
                out += self.core.encode_ordinary(part)
            else:
                for match in self.words.finditer(part):
                    out += self.word(match.group().encode())
        return out

    def word(self, word: bytes) -> list[int]:
        """Tokens of one word of the pattern: halves are encoded and joined."""
        if len(word) <= WINDOW_CHARS:
            return self.core._encode_single_piece(word)
        half = len(word) // 2
        return self.join_word(self.word(word[:half]), self.word(word[half:]))

    def join_word(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of a word from the tokens of its halves: windows around the seam grow until the
        first and the last token of the re-encoded window are the ones found before."""
        size = 4
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            window = b"".join(self.bytes[i] for i in left[a:] + right[:b])
            new = self.core._encode_single_piece(window)
            if (a == 0 or new[0] == left[a]) and (b == len(right) or new[-1] == right[b - 1]):
                return left[:a] + new + right[b:]
            size *= 2

    def join(self, left: tuple[str, list[int]], right: tuple[str, list[int]]):
        """Text and tokens of two neighbouring parts put together."""
        (a, x), (b, y) = left, right
        if not a or not b:
            return a + b, x + y
        start, end = last_border(a), first_border(b)
        window = a[start:] + b[:end]
        x_kept = self.tokens_before(x, len(a[:start].encode()))
        y_from = self.tokens_before(y, len(b[:end].encode()))
        if len(window) <= WINDOW_CHARS:
            new = self.encode(window)
        else:
            new = self.long_window(window, len(a) - start, x[x_kept:], y[:y_from])
        return a + b, x[:x_kept] + new + y[y_from:]

    def tokens_before(self, tokens: list[int], size: int) -> int:
        """Number of tokens that the first ``size`` bytes hold; a token ends there."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[np.array(tokens, dtype=np.int64)])])
        count = int(np.searchsorted(ends, size))
        if ends[count] != size:
            raise AssertionError("a border of the word pattern lies inside a token")
        return count

    def long_window(self, window: str, seam: int, x: list[int], y: list[int]) -> list[int]:
        """Tokens of a long window; the word across the seam is joined from the tokens of its
        sides, where each side has it as one word of its own."""
        left = [m.span() for p in (window[:seam],) for m in self.words.finditer(p)]
        right = [m.span() for p in (window[seam:],) for m in self.words.finditer(p)]
        if any(name in window for name in self.special):
            return self.encode(window)
        out: list[int] = []
        for match in self.words.finditer(window):
            start, end = match.span()
            whole = start < seam < end and (start, seam) == left[-1] and right[0][1] == end - seam
            if whole and end - start > WINDOW_CHARS:
                size = len(window[start:seam].encode())
                skip = int(self.lengths[np.array(x, dtype=np.int64)].sum()) - size
                keep = len(window[seam:end].encode())
                one = x[self.tokens_before(x, skip) :]
                out += self.join_word(one, y[: self.tokens_before(y, keep)])
            else:
                out += self.word(match.group().encode())
        return out

    def tree(self, leaves: list[tuple[str, list[int]]]) -> list[int]:
        """Tokens of a text from its encoded leaves, joined pairwise level by level."""
        while len(leaves) > 1:
            pairs = [self.join(*leaves[k : k + 2]) for k in range(0, len(leaves) - 1, 2)]
            leaves = pairs + (leaves[-1:] if len(leaves) % 2 else [])
        return leaves[0][1] if leaves else []

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text that the tokens stand for; broken sequences become U+FFFD."""
        raw = b"".join([self.bytes[i] for i in ids])
        return raw.decode("utf-8", errors="replace").encode()

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join([self.digits[i] for i in ids])
        return (
            len(ids),
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(self.decode(ids)).hexdigest(),
        )


def is_border(before: str, after: str) -> bool:
    return after in " \n\t\r" and not before.isspace() and before not in "\x1c\x1d\x1e\x1f\x85"


def last_border(text: str) -> int:
    """Last place where white space follows another character, else the start."""
    for k in range(len(text) - 1, 0, -1):
        if is_border(text[k - 1], text[k]):
            return k
    return 0


def first_border(text: str) -> int:
    for k in range(1, len(text)):
        if is_border(text[k - 1], text[k]):
            return k
    return len(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_type(df: DataFrame, column: str):
    return df.schema[column].dataType.simpleString()


def encode(
    df: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    leaf: int = LEAF_CHARS,
    with_ids: bool = False,
) -> DataFrame:
    """Token count, digests and, if asked for, the token ids of every text.

    Texts up to ``leaf`` characters are encoded where they are read. Of longer ones only the
    leaves are shuffled: by leaf for encoding, by text for joining, so neither a long text nor a
    source with many of them is encoded by one task.
    """
    kind = id_type(df, id_column)
    extra = ", ids binary" if with_ids else ""
    result = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"

    def rows(keys: pa.Array, tokens: list[list[int]], schema: pa.Schema) -> pa.RecordBatch:
        tool = encoder(path)
        counts, lists, texts = [], [], []
        for ids in tokens:
            n, a, b = tool.digests(ids)
            counts.append(n)
            lists.append(a)
            texts.append(b)
        columns = [keys, pa.array(counts, pa.int64()), pa.array(lists), pa.array(texts)]
        if with_ids:
            columns.append(pa.array([np.array(i, "<i4").tobytes() for i in tokens], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, schema.names)

    names = pa.schema([(n.strip().split(" ")[0], pa.null()) for n in result.split(", ")])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                tokens = [tool.encode(t or "") for t in part.column(1).to_pylist()]
                yield rows(part.column(0), tokens, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                pieces = [text[at : at + leaf] for at in range(0, len(text), leaf)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).slice(k, 1)] * n),
                        pa.array([hashlib.sha256(text.encode()).hexdigest()] * n),
                        pa.array(range(n), pa.int64()),
                        pa.array(pieces),
                    ],
                    ["id", "text_key", "leaf", "piece"],
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            tokens = [np.array(tool.encode(t), "<i4").tobytes() for t in batch.column(3).to_pylist()]
            yield batch.append_column("tokens", pa.array(tokens, pa.binary()))

    def joined(table: pa.Table) -> pa.Table:
        tool = encoder(path)
        table = table.combine_chunks().sort_by("leaf")
        order = table.column("leaf").to_pylist()
        times = order.count(0)
        first = [k for k, n in enumerate(order) if k == 0 or order[k - 1] != n]
        pieces, tokens = table.column("piece"), table.column("tokens")
        found = tool.tree(
            [
                (pieces[k].as_py(), np.frombuffer(tokens[k].as_py(), "<i4").tolist())
                for k in first
            ]
        )
        keys = pa.concat_arrays([table.column("id").chunk(0).slice(0, 1)] * times)
        return pa.Table.from_batches([rows(keys, [found] * times, names)])

    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    texts = in_batches(texts)
    is_long = F.coalesce(F.length("text"), F.lit(0)) > leaf
    parts = texts.where(is_long).mapInArrow(
        lean(cut), f"id {kind}, text_key string, leaf long, piece string"
    )
    # A leaf is the unit of work here, so leaves are dealt out evenly, not by text.
    encoded = parts.repartition("text_key", "leaf").mapInArrow(
        lean(leaves), f"id {kind}, text_key string, leaf long, piece string, tokens binary"
    )
    long_rows = encoded.groupBy("id", "text_key").applyInArrow(lean_group(joined), result)
    done = texts.where(~is_long).mapInArrow(lean(short), result).unionByName(long_rows)
    return done.withColumnRenamed("id", id_column)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the encoded documents, as counts and digests."""
    return encode(docs, default_path())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
