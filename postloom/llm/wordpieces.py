"""Numbers of greedy word pieces without building the pieces.

A trie over the vocabulary with a failure link per node: where the walk through a word cannot go on, the
link leads to the node of what remains after taking off the longest pieces, and the node knows how many
pieces that takes off. A word is read once, so the walk is linear in its length.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from postloom.llm.common import id_and_text, text_slices, worker_memory

#: The symbol that ends a word; the others are bytes.
END = 256

#: Words a worker keeps in each of its two generations.
CACHE_WORDS = 500_000


def byte_level_pieces(path: str | None = None, end: str = "</w>") -> list[tuple[int, ...]]:
    """The vocabulary of a byte-level tokenizer file as sequences of bytes and `END`, without special tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {t["content"] for t in file.get("added_tokens", [])}
    # Such files write a byte as a visible character: itself if it has one, else the next free one from 256 on.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*visible}))}
    pieces = []
    for token in file["model"]["vocab"]:
        if token not in special:
            body = token.removesuffix(end)
            pieces.append(tuple(byte[c] for c in body) + (END,) * (body != token))
    return pieces


class PieceCounter:
    """Counts the pieces of words by greedy longest match; any piece may start or continue a word.

    A piece that ends in `END` matches only the end of a word, and is longer than the same one without; an end
    that no piece takes along is no piece of its own.
    """

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.goto: dict[int, int] = {}   # node * 512 + symbol
        is_piece, children = [False], [[]]
        for piece in [*pieces, (END,)]:
            node = 0
            for symbol in piece:
                step = self.goto.get(node << 9 | symbol)
                if step is None:
                    step = self.goto[node << 9 | symbol] = len(is_piece)
                    is_piece.append(False)
                    children.append([])
                    children[node].append((symbol, step))
                node = step
            is_piece[node] = node > 0
        self.fail, self.popped = [-1] * len(is_piece), [0] * len(is_piece)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for symbol, node in children[parent]:
                queue.append(node)
                if is_piece[node]:
                    self.fail[node], self.popped[node] = 0, int((parent, symbol) != (0, END))
                    continue
                rest, popped = self.fail[parent], self.popped[parent]
                while rest >= 0 and (step := self.goto.get(rest << 9 | symbol)) is None:
                    rest, popped = self.fail[rest], popped + self.popped[rest]
                if rest >= 0:
                    self.fail[node], self.popped[node] = step, popped

    def count(self, word: bytes) -> int:
        """Pieces of the word and its end; a word the pieces cannot spell is one unknown piece."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node = n = 0
        for symbol in (*word, END):
            while (step := goto.get(node << 9 | symbol)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = step
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def piece_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None) -> DataFrame:
    """`id, n_words, n_pieces` of every row: words between ASCII white space, in lower case.

    A null or empty text has no words. Repeated rows and null ids are kept; an empty table gives no rows.
    Only the two named columns are read. Each distinct word of a slice is looked up once.
    """
    pieces = byte_level_pieces(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: its size is fixed
    key = ("pieces", hash(tuple(pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_memory()
        if key not in kept:
            kept[key] = (PieceCounter(shared.value), [{}, {}])
        counter, caches = kept[key]
        for part in text_slices(batches):
            split = pc.ascii_split_whitespace(pc.utf8_lower(part.column("text")))
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.binary()).to_pylist()
            young, old = caches
            found = list(map(young.get, words))
            for i in [i for i, n in enumerate(found) if n is None]:
                n = old.get(words[i])
                found[i] = young[words[i]] = n if n is not None else counter.count(words[i]) if words[i] else 0
            if len(young) > CACHE_WORDS:
                caches[:] = [{}, young]
            codes = coded.indices.to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))

            def total(of_word: np.ndarray) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(of_word[codes])])
                return pa.array(np.diff(sums[np.concatenate([[0], ends])]))

            pieces_of = np.array(found, np.int64)
            real = np.fromiter(map(bool, words), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([part.column("id"), total(real), total(pieces_of)],
                                             ["id", "n_words", "n_pieces"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_words long, n_pieces long")
