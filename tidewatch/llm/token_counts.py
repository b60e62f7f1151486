"""Token counts with a whole-token shortcut.

``whole_tokens`` proves, once and for the vocabulary alone, which of its strings are encoded as
just themselves: it runs the merges on each of them. A pre-token in that set counts as one
token without merging; only the others are merged, and their counts are kept in a table of
bounded size in each task.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.base import map_texts, query, table

#: How byte-level vocabularies cut a text before merging.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKEN_LIMIT = 1024
#: Counts of merged pre-tokens a task keeps before it starts anew, and how long (in characters) such a pre-token may be.
CACHE, CACHED = 200_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges of a byte-level vocabulary file, and its special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        merges = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.tokens = list(held["model"]["vocab"])
        self.special = [t["content"] for t in held["added_tokens"]]
        self.letters = byte_letters()

    def merged(self, letters: str) -> int:
        """Number of tokens of one pre-token in byte letters: always merges the leftmost pair of lowest rank."""
        if len(letters) < 2:
            return len(letters)
        part: list[str | None] = list(letters)
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        ranks = self.ranks
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(letters, letters[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        left = len(part)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            after[i] = k = after[j]
            if k < len(part):
                before[k] = i
                if (r := ranks.get((a + b, part[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, part[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((part[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, part[h], a + b))
            left -= 1
        return left

    def count(self, pre_token: str) -> int:
        letters = self.letters
        return self.merged("".join(letters[b] for b in pre_token.encode("utf-8", "replace")))

    def whole_tokens(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and that the merges turn into one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        cut = regex.compile(PRE_TOKEN)
        found = set()
        for token in self.tokens:
            try:
                text = bytes(back[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if cut.findall(text) == [text] and self.merged(token) == 1:
                found.add(text)
        return frozenset(found)


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = TOKEN_LIMIT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    Columns other than the two named ones are not read, so their names cannot clash. A null text
    counts as empty (0 bytes, 0 tokens), a null id stays null, repeated rows each give a row, an
    empty table gives none. Whole texts are counted however long they are. A special string inside a text is one token, as the
    vocabulary's library has it by default.
    """
    held = Vocabulary(vocabulary)
    whole = docs.sparkSession.sparkContext.broadcast((held.whole_tokens(), held))  # bounded by the vocabulary

    def make():
        ones, own = whole.value
        cut = regex.compile(PRE_TOKEN)
        special = regex.compile("|".join(map(regex.escape, own.special))) if own.special else None
        known: dict[str, int] = {}

        def count(text: str) -> int:
            parts = special.split(text) if special else [text]
            total = len(parts) - 1
            for part in parts:
                pieces = cut.findall(part)
                total += len(pieces)
                for piece in pieces:
                    if piece not in ones:
                        n = known.get(piece)
                        if n is None:
                            n = own.count(piece)
                            if len(piece) <= CACHED:
                                if len(known) >= CACHE:
                                    known.clear()
                                known[piece] = n
                        total += n - 1
            return total

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).fill_null("")
            sizes = pc.binary_length(texts).cast(pa.int64())
            counts = np.fromiter((count(t) for t in texts.to_pylist()), np.int64, batch.num_rows)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return each

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_texts(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_counts")
def token_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary_path("byte_bpe_50k.json"))
